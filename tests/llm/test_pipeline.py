import random

import pytest

import corpus_pipeline
from corvanta.llm.queries import QUERIES
from tests.llm.corpus import SCHEMA, words
from tests.llm.test_decontam import brute as overlaps
from tests.llm.test_mixing import targets
from tests.llm.test_ngram_join import brute as near
from tests.llm.test_toxicity import corpus


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    rows, labels = corpus(n=160)
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t, *_ in rows]
    item = " ".join(words(rng, 30, 4000))
    rows += [(500, rows[1][1], "en", "s1", 1), (501, "extra " + rows[2][1], "en", None, 1), (502, f"{rows[3][1]} {item} end", "en", "s2", 1)]
    rows += [(503, None, "en", "s2", None), (504, "", None, "s0", 0), (None, "alone without an id but of many words", "en", "s1", 1), (505, "x " * 4000, "en", "s3", 8000), rows[7]]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages_like_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("copy_", corpus_pipeline.F.lit(1)).withColumn("epochs", corpus_pipeline.F.lit(2))
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, folder).cache()
    assert clean.columns == docs.columns
    kept = {r.doc_id for r in clean.collect()}
    toxic = {i for i in range(0, 160, 4)}
    assert len(toxic & kept) <= 4 and len({i for i in range(160) if i % 4} - kept) <= 2 and {503, 504, None} <= kept
    unique = stages["near_duplicates"](spark, clean, folder).cache()
    rows = [tuple(r)[:5] for r in clean.collect()]
    want = sorted({r[0] for r in near(rows) if r[0] == r[2]}, key=repr)  # ids of this table name one text each
    got = [r.doc_id for r in unique.collect()]
    assert sorted(got, key=repr) == want and unique.columns == docs.columns
    left = stages["decontamination"](spark, unique, folder).cache()
    item = spark.read.parquet(f"{folder}/benchmark.parquet").first().text
    assert {r.doc_id for r in left.collect()} == {r.doc_id for r in unique.collect() if not overlaps(r.text, item, 13, 80)}
    mixed = stages["mixing"](spark, left, folder).cache()
    size = lambda t: len((t or "").split())
    sizes, taken = {}, {}
    for r in left.collect():
        sizes[r.source] = sizes.get(r.source, 0) + size(r.text)
    for r in mixed.collect():
        taken[r.source] = taken.get(r.source, 0) + size(r.text)
    goal = targets(sizes)
    assert mixed.columns == docs.columns and all(taken.get(s, 0) == int(goal[s]) for s in sizes)
    packed = stages["sharding"](spark, mixed, folder)
    assert packed.count() == mixed.count() and {r.shard for r in packed.collect()} <= set(range(8))


def odd(spark):
    """Rows that ids do not tell apart, with further columns of names that operators use."""
    x, y, z = (" ".join(words(random.Random(i), 40, 5000)) for i in range(3))
    rows = [(3, x), (5, y), (5, x), (5, y), (6, y + " end"), (None, z), (None, z), (None, x + " end"), (None, "another one without id"), (7, None), (7, None), (8, ""), (None, None), (9, z + " end")]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "c", 2) for i, t in rows], SCHEMA + ", class int, content string, key long"), (x, y, z)


def test_near_duplicates_by_row(spark, folder):
    docs, (x, y, z) = odd(spark)
    out = corpus_pipeline.near_duplicates(spark, docs, folder)
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    assert out.columns == docs.columns
    assert got == sorted([(3, x), (5, y), (9, z + " end"), (None, "another one without id"), (7, None), (7, None), (8, ""), (None, None)], key=repr)


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_and_empty_tables(spark, folder, name):
    docs, _ = odd(spark)
    stage = dict(corpus_pipeline.STAGES)[name]
    out, none = stage(spark, docs, folder), stage(spark, docs.limit(0), folder)
    assert none.count() == 0 and none.columns == out.columns
    if name != "sharding":
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    rows = out.count()
    assert rows == {"near_duplicates": 8, "mixing": 10}.get(name, 14)


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "shard", "slot"} <= set(out.columns) and out.count() > 50


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_on_the_smallest_tables(spark, name):
    out = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert out.count() > 0
