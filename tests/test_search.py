import json
import math
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Thread

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvanta.functions.text import tokenize, tokens_of
from corvanta.operators import answers, index, search, store

DOCS = [("a", "cats like warm milk and warm beds"), ("b", "dogs like bones"), ("c", "milk milk milk"), ("d", "!!"), ("e", None), ("f", "cats and dogs")]


@pytest.fixture(scope="module")
def units(spark):
    return spark.createDataFrame(DOCS, "chunk_id string, chunk_text string")


def plain_scores(query):
    docs = {i: Counter(w for w in (t or "").split() if len(w) > 1 and w.isalnum()) for i, t in DOCS}
    docs = {i: c for i, c in docs.items() if c}
    q = Counter(query.split())
    idf = {t: math.log((len(docs) + 1) / (sum(t in c for c in docs.values()) + 1)) + 1 for t in q}
    qw = {t: (1 + math.log(n)) * idf[t] for t, n in q.items()}
    out = {}
    for i, c in docs.items():
        dw = {t: (1 + math.log(c[t])) * idf[t] for t in q if c[t]}
        if dw:
            dot = sum(qw[t] * dw[t] for t in dw)
            out[i] = max(0, min(1, dot / (math.sqrt(sum(x * x for x in qw.values())) * math.sqrt(sum(x * x for x in dw.values())) + 1e-9)))
    return out


def test_keyword(spark, units):
    asked = ["cats milk milk", "milk", "nothing here", "", "!"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id long, query string")
    got = {}
    for r in search.keyword_search(units, queries, 3).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.unit_id, r.score))
    for i, q in enumerate(asked):
        want = sorted(plain_scores(q).items(), key=lambda x: (-round(x[1], 12), x[0]))[:3] if q.strip("!") else []
        assert [x[1] for x in sorted(got.get(i, []))] == [k for k, _ in want]
        assert [x[2] for x in sorted(got.get(i, []))] == pytest.approx([s for _, s in want])
    one = search.keyword_search(units, queries.where("query_id = 0"), 3).collect()
    assert sorted((r.rank, r.unit_id) for r in one) == [x[:2] for x in sorted(got[0])]


def test_keyword_plan(spark, units):
    queries = spark.createDataFrame([(0, "cats")], "query_id long, query string")
    plan = search.keyword_search(units, queries, 3)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastHashJoin" in plan and "WindowGroupLimit" in plan


def test_vector(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 8))
    x[7] = x[3]
    x[9] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)]
    vectors = spark.createDataFrame(rows, "unit_id long, vector array<double>").repartition(3)
    queries = vectors.where("unit_id in (3, 9, 20) or unit_id = 99").withColumnRenamed("unit_id", "query_id")
    got = {}
    for r in search.vector_search(vectors, queries, 5, block=2).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.unit_id, round(r.score, 9)))
    length = np.linalg.norm(x, axis=1)
    for q in (3, 9, 20):
        cosine = np.where(length * length[q] == 0, 0, x @ x[q] / np.where(length * length[q] == 0, 1, length * length[q]))
        want = sorted(range(50), key=lambda i: (-round(cosine[i], 12), i))[:5]
        assert sorted(got[q]) == [(k + 1, i, round(float(cosine[i]), 9)) for k, i in enumerate(want)]
    assert 99 not in got and [u for _, u, _ in sorted(got[3])][:2] == [3, 7]


def test_hybrid_and_modes(spark):
    chunks = store.ingest(spark.createDataFrame([(i, t) for i, t in DOCS if t], "doc_id string, text string")).chunks
    queries = store.embed(spark.createDataFrame([(0, "warm milk")], "query_id long, query string"), "query")
    words = search.keyword_search(chunks, queries, 10)
    near = search.vector_search(chunks.select(chunks.chunk_id.alias("unit_id"), "vector"), queries, 10)
    score = Counter()
    for hits, share in ((words, "k"), (near, "v")):
        for r in hits.collect():
            score[r.unit_id] += 0.7 * 0.5 * r.score + 0.3 * 10 / (60 + r.rank)
    got = search.hybrid_search(chunks, queries, 1).collect()
    assert [(r.unit_id, pytest.approx(r.score)) for r in got] == [max(score.items(), key=lambda x: x[1])]
    modes = search.compare_modes(chunks, queries, 2).groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in modes} == {"hybrid": 2, "keyword": 2, "vector": 2}
    assert search.rank_fusion(words, near).count() >= near.count()
    with pytest.raises(ValueError):
        search.search(chunks, queries, "fuzzy")
    with pytest.raises(ValueError):
        search.search(chunks, queries, "VECTOR", 0)


def test_index(spark, units):
    found = {(r.term, r.unit_id): r.tf for r in index.postings(units).collect()}
    assert found[("milk", "c")] == 3 and ("warm", "a") in found and len({u for _, u in found}) == 4
    assert index.corpus_size(units).first()[0] == 4


def test_kept_index(spark, units, tmp_path):
    index.write_index(units, str(tmp_path))
    kept = index.read_index(spark, str(tmp_path))
    queries = spark.createDataFrame([(0, "cats milk nothing"), (1, "dogs"), (2, "!")], "query_id long, query string")
    rows = lambda df: sorted((r.query_id, r["rank"], r.unit_id, round(r.score, 9)) for r in df.collect())
    found = search.search_index(kept, queries, 3)
    assert rows(found) == rows(search.keyword_search(units, queries, 3))
    assert {(r.term, r.df) for r in kept.terms.collect()} == {(r.term, r.n) for r in index.postings(units).groupBy("term").count().toDF("term", "n").collect()}
    assert "PushedFilters: [In(term" in found._jdf.queryExecution().executedPlan().toString()


def test_kept_index_of_many_terms(spark, units, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "PUSHED_TERMS", 1)
    index.write_index(units, str(tmp_path))
    queries = spark.createDataFrame([(0, "cats milk nothing"), (1, "dogs")], "query_id long, query string")
    rows = lambda df: sorted((r.query_id, r["rank"], r.unit_id, round(r.score, 9)) for r in df.collect())
    found = search.search_index(index.read_index(spark, str(tmp_path)), queries, 3)
    assert rows(found) == rows(search.keyword_search(units, queries, 3)) and len(rows(found)) > 2


def test_http_generator(spark):
    asked = []

    class Server(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            self.reply({"models": [{"name": "small"}, {"name": "broken"}, {}]})

        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append(body)
            self.reply({"response": body["model"] + " says hello"}) if body["model"] != "broken" else self.send_error(500)

        def reply(self, body):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    assert answers.is_reachable(url) and answers.installed_models(url) == ["small", "broken"]
    models = answers.http_models(url, ["broken", None, "broken"])
    assert list(models) == ["broken", "small"]
    prompts = spark.createDataFrame([(1, "why?")], "query_id long, prompt string")
    assert [tuple(r) for r in answers.generate(prompts, models).collect()] == [(1, "small says hello", "small")]
    assert asked[-1] == {"model": "small", "prompt": "why?", "stream": False, "options": answers.SAMPLING}
    server.shutdown()
    server.server_close()
    assert not answers.is_reachable(url, 1) and answers.installed_models(url, 1) == [] and answers.http_models(url, ["x"], 1).keys() == {"x"}


def test_answers(spark, units):
    hits = spark.createDataFrame([(0, 1, "a", 0.5), (0, 2, "zz", 0.25)], "query_id long, rank long, unit_id string, score double")
    queries = spark.createDataFrame([(0, "why?"), (1, "what?")], "query_id long, query string")
    chunks = units.withColumn("doc_id", units.chunk_id)
    contexts = {r.query_id: r.context for r in answers.build_context(answers.hydrate(hits, chunks), queries).collect()}
    assert contexts[1] == answers.NO_CONTEXT and contexts[0].startswith("[1] (doc: a, score: 0.5000)\ncats like")
    prompts = answers.build_prompt(answers.build_context(answers.hydrate(hits, chunks), queries), queries)
    assert all(r.prompt.endswith("?\n\nAnswer:") and r.prompt.startswith("You are") for r in prompts.collect())

    def broken(prompt):
        raise OSError("down")

    got = answers.generate(prompts, {"broken": broken, "echo": answers.echo}, ["broken"]).collect()
    assert {r.model_used for r in got} == {"echo"} and any("why?" in r.answer for r in got)
    with pytest.raises(Exception, match="down"):
        answers.generate(prompts, {"broken": broken}).collect()
    with pytest.raises(ValueError):
        answers.generate(prompts, {}, ["none"])
    assert answers.candidate_models(["b", None, "a"], ["a", "c"]) == ["b", "a", "c"]


def test_tokens_outside_spark(spark):
    texts = ["", "A bc 42", "café CAFÉ", "Kelvin İstanbul xİ", "a_bc-D9", "ＡＢ ǅab ẞSS", "naïveİK9"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(tokenize(F.col("t"))).collect()
    assert [[x.decode() for x in tokens_of(t.encode())] for t in texts] == [r[0] for r in got]


def test_postings_shuffle_nothing_unless_ids_repeat(spark):
    units = spark.createDataFrame([("a", "warm milk milk"), ("b", None), ("c", "!")], "chunk_id string, chunk_text string")
    assert "Exchange" not in index.postings(units)._jdf.queryExecution().executedPlan().toString()
    again = units.unionByName(spark.createDataFrame([("a", "milk"), (None, "cold"), (None, "cold milk")], units.schema))
    assert {(r.term, r.unit_id): r.tf for r in index.postings(again).collect()} == {("warm", "a"): 1, ("milk", "a"): 3, ("cold", None): 2, ("milk", None): 1}


def test_segments(spark, tmp_path, monkeypatch):
    words = ["cat", "dog", "milk", "warm", "cold", "bird"]
    units = spark.createDataFrame([(f"u{i}", " ".join(words[(i * k) % 6] for k in range(1, 2 + i % 5))) for i in range(60)], "chunk_id string, chunk_text string")
    queries = spark.createDataFrame([(i, f"{words[i % 6]} {words[(i + 2) % 6]} nothing") for i in range(8)] + [(9, "?")], "query_id int, query string")
    rows = lambda df: sorted((r.query_id, r["rank"], r.unit_id, round(r.score, 9)) for r in df.collect())
    for name, size in ((index, "SEGMENT"), (search, "SENT_TERMS"), (search, "SCORED")):
        monkeypatch.setattr(name, size, 3)
    index.write_index(units, str(tmp_path / "one"))
    kept = index.read_index(spark, str(tmp_path / "one"))
    assert kept.segments.select("segment").distinct().count() > 10
    found = rows(search.search_index(kept, queries, 4))
    assert found == rows(search.keyword_search(units, queries, 4)) and len(found) == 32
    assert sorted(map(tuple, kept.postings.collect())) == sorted(map(tuple, index.postings(units).collect()))
    # Rows that share an id are one unit, and cannot be in two segments.
    twice = units.unionByName(units.limit(7))
    index.write_index(twice, str(tmp_path / "two"))
    kept = index.read_index(spark, str(tmp_path / "two"))
    assert kept.segments is None
    assert sorted(map(tuple, kept.postings.collect())) == sorted(map(tuple, index.postings(twice).collect()))


def test_vectors_are_compared_in_parts(spark, monkeypatch):
    monkeypatch.setattr(search, "COMPARED", 7)
    numbers = np.random.default_rng(5).normal(size=(40, 8)).round(1)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(numbers)], "unit_id long, vector array<double>")
    found = search.vector_search(vectors, vectors.select(F.col("unit_id").alias("query_id"), "vector"), 3).collect()
    units = numbers / np.linalg.norm(numbers, axis=1, keepdims=True)
    scores = (units @ units.T).round(12)
    wanted = {(q, n + 1, int(u)) for q in range(40) for n, u in enumerate(np.lexsort((np.arange(40), -scores[q]))[:3])}
    assert {(r.query_id, r["rank"], r.unit_id) for r in found} == wanted


def test_texts_that_are_not_hits_stay_where_they_are(spark):
    hits = spark.createDataFrame([(0, 1, "a", 0.5), (0, 2, "gone", 0.4)], "query_id long, rank long, unit_id string, score double")
    chunks = spark.range(1000).selectExpr("'d' as doc_id", "if(id = 7, 'a', cast(id as string)) as chunk_id", "concat('text ', id) as chunk_text")
    found = answers.hydrate(hits, chunks)
    assert sorted((r.unit_id, r.doc_id, r.chunk_text) for r in found.collect()) == [("a", "d", "text 7"), ("gone", None, "")]
    assert "LeftSemi, BuildRight" in found._jdf.queryExecution().executedPlan().toString()
