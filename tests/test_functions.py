import hashlib
import math
import re

import pytest
from pyspark.sql import functions as F

from corvanta.functions import keys, scoring, text


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


@pytest.mark.parametrize(
    ("given", "tokens"),
    [("", []), ("  \t", []), ("a b c", []), ("café", ["caf"]), ("a_bc 42 x9", ["bc", "42", "x9"]), ("HELLO, world!!", ["hello", "world"]), (None, []), ("Kelvin Kn", ["kelvin", "kn"])],
)
def test_tokenize(spark, given, tokens):
    assert values(spark, [(given,)], "t string", text.tokenize(F.col("t"))) == [(tokens,)]


def strip_lines(t):
    return "\n".join(line.rstrip() for line in t.replace("\r\n", "\n").split("\n"))


def plain_chunks(t):
    t = strip_lines(t)
    if re.search(r"^#{1,6}\s", t, re.M):
        parts = re.split(r"(?m)^(?=#{1,6}\s)", t)
    else:
        parts = re.split(r"\n{2,}", t)
    return [p.strip() for p in parts if p.strip()]


CHUNKY = [
    "", "\n\n\n", "one\n\ntwo", "one\r\n\r\ntwo\r\n", "one\n \t\ntwo", "# h\nbody\n## g\nmore", "pre\n\n# h\nbody", "####### seven\n\nx", " # indented\n\nx", "##\nbare", "end #", "a\n#",
    "```\n# in a fence\n```", "# nbsp", "lone\rcr\n\nx", "x # y\n\nz", "　wide　\n\n\x1cfs\x1d", "a\n\n\n\nb\n", "#x no\n\ny", "\u0085# n\n\nq",
]


def test_chunks(spark):
    got = values(spark, [(t,) for t in CHUNKY] + [(None,)], "t string", text.chunk_text(F.col("t")))
    assert [g[0] for g in got] == [plain_chunks(t) for t in CHUNKY] + [[]]


def test_chunk_ids(spark):
    got = values(spark, [("d", 3), ("a::chunk::b", 0)], "d string, i int", text.chunk_id(F.col("d"), F.col("i")), text.document_of(text.chunk_id(F.col("d"), F.col("i"))))
    assert got == [("d::chunk::3", "d"), ("a::chunk::b::chunk::0", "a")]


def test_blank(spark):
    rows = [(None,), ("",), (" 　\n",), ("x",)]
    assert [x[0] for x in values(spark, rows, "t string", text.is_blank(F.col("t")))] == [True, True, True, False]


def test_weights(spark):
    got = values(spark, [(0,), (1,), (5,)], "c long", scoring.term_weight(F.col("c")))
    assert [x[0] for x in got] == pytest.approx([0, 1, 1 + math.log(5)])
    got = values(spark, [(0, 0), (10, 0), (10, 10)], "n long, d long", scoring.rarity(F.col("n"), F.col("d")))
    assert [x[0] for x in got] == pytest.approx([1, math.log(11) + 1, 1])


def test_cosine_and_unit(spark):
    rows = [([1.0, 2.0], [1.0, 2.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 1.0]), ([3.0, 4.0], [4.0, 3.0])]
    got = values(spark, rows, "a array<float>, b array<float>", scoring.cosine(F.col("a"), F.col("b")), scoring.unit(F.col("a"), 1))
    assert [x[0] for x in got] == pytest.approx([1, -1, 0, 24 / 25])
    assert [x[1] for x in got] == [[1.0], [1.0], [0.0], [1.0]]


def test_fused(spark):
    got = values(spark, [(0.5, None, 1 / 61), (None, -0.4, 1 / 62), (1.0, 1.0, 2 / 61)], "k double, v double, r double", scoring.fused(F.col("k"), F.col("v"), F.col("r")))
    want = [0.7 * 0.25 + 0.3 * 10 / 61, 0.7 * -0.2 + 0.3 * 10 / 62, 0.7 + 0.3 * 20 / 61]
    assert [x[0] for x in got] == pytest.approx(want)


def test_keys(spark):
    got = values(spark, [("é|x", "hybrid", 5)], "q string, m string, k int", keys.cache_key(F.col("q"), F.col("m"), F.col("k")), keys.ring_hash(F.col("q")))
    assert got == [(hashlib.sha256("é|x|hybrid|5".encode()).hexdigest(), int.from_bytes(hashlib.md5("é|x".encode()).digest()[:8], "big", signed=True))]


def test_utility_and_rate(spark):
    got = values(spark, [(1, 300.0), (7, -5.0)], "n long, s double", keys.eviction_utility(F.col("n"), F.col("s")))
    assert [x[0] for x in got] == pytest.approx([math.log(2) * math.exp(-0.693147), math.log(8)])
    assert values(spark, [(0, 0), (1, 2)], "h long, m long", keys.hit_rate(F.col("h"), F.col("m"))) == [(0.0,), (0.3333,)]


def test_lines_are_trimmed_without_regular_expressions(spark):
    texts = spark.createDataFrame([("\u3000 a \t\r\n\x1f\n\n b\u2003c \x85\n \u1680",), (" \n",), ("",), (None,)], "t string")
    assert [r[0] for r in texts.select(text.chunk_text(F.col("t"))).collect()] == [["a", "b\u2003c"], [], [], []]
    plan = texts.select(text.chunk_text(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and plan.count("replace(t#") == 1
