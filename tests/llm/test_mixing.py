import re
from collections import Counter, defaultdict

import pytest

from corvanta.llm.mixing import mix_sources, mixed_rows
from tests.llm.corpus import SCHEMA, documents


def targets(sizes, weights=(5, 2, 1), most=3):
    """Targets by repeated sharing of what exceeds a cap."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        rest, share = total - sum(capped.values()), sum(weight[s] for s in free)
        above = [s for s in free if weight[s] * rest > most * sizes[s] * share]
        if not above:
            return {s: capped.get(s, weight[s] * rest / share if share else 0) for s in names}
        capped |= {s: most * sizes[s] for s in above}


def test_targets_and_totals(spark):
    rows = documents(n=80)
    df = spark.createDataFrame([(*r, 9, 9) for r in rows], SCHEMA + ", size long, range long")
    got = mix_sources(df).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += size(r[1])
    want = targets(sizes)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.epochs * r.size + r.cut
        taken[r.source] += r.taken
    for s, t in taken.items():
        assert t == int(want[s])
    assert sorted(map(repr, got)) == sorted(map(repr, mix_sources(df.repartition(7)).collect()))


def test_empty_and_all_zero(spark):
    assert mix_sources(spark.createDataFrame([], SCHEMA)).count() == 0
    zero = spark.createDataFrame([(1, None, "en", "a", 0), (2, "", "en", None, 0)], SCHEMA)
    assert [(r.size, r.taken, r.target) for r in mix_sources(zero).collect()] == [(0, 0, 0.0)] * 2


def odd_rows():
    """Null and repeated ids, equal rows, equal texts, texts without words."""
    rows = documents(n=30)
    rows += [(None, f"no id {i} " * (i + 3), "en", "s1", i) for i in range(40)]
    rows += [(7, f"same id {i} of many", "en", "s2", i) for i in range(20)]
    rows += [(8, "a row that is here very often", "en", "s3", 1)] * 50
    rows += [(None, "neither id nor source", "en", None, 1)] * 9
    return rows + [(9, "long " * 5000, "en", "s4", 1)]


@pytest.mark.parametrize("ranges", [4096, 2])
def test_rows_of_the_mix(spark, ranges):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", cut string, key long")
    out = mixed_rows(df, ranges=ranges)
    assert out.columns == [*df.columns, "is_cut"]
    got = out.collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r[3]] += size(r[1])
    for r in got:
        taken[r.source] += size(r.text)
    want = targets(sizes)
    assert {s: taken[s] for s in sizes} == {s: int(t) for s, t in want.items()}
    # Whole rows: as often as the whole epochs of the source, or once more.
    there, copies = Counter(rows), Counter(tuple(r)[:5] for r in got if not r.is_cut)
    for row, n in there.items():
        whole = int(want[row[3]]) // sizes[row[3]] if sizes[row[3]] else 0
        if size(row[1]):
            assert whole * n <= copies[row] <= (whole + 1) * n
        else:
            assert copies[row] == 0
    cut = [r for r in got if r.is_cut]
    assert len(cut) == len({r.source for r in cut}) and all(any(t[1].startswith(r.text) and t[0] == r.doc_id for t in rows if t[1]) for r in cut)
    assert sorted(map(repr, got)) == sorted(map(repr, mixed_rows(df.repartition(5), ranges=ranges).collect()))


def test_rows_of_an_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert mixed_rows(df).columns == [*df.columns, "is_cut"] and mixed_rows(df).count() == 0
    with pytest.raises(ValueError):
        mixed_rows(df.withColumn("is_cut", df.doc_id))
