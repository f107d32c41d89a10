from functools import lru_cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvanta.plans import fixtures
from corvanta.operators import revisions
from corvanta.operators.revisions import align, common_length, deltas, similarity

few = st.lists(st.sampled_from("abc"), max_size=9)


def plain_length(a, b):
    @lru_cache(None)
    def best(i, j):
        if i == len(a) or j == len(b):
            return 0
        return best(i + 1, j + 1) + 1 if a[i] == b[j] else max(best(i + 1, j), best(i, j + 1))

    return best(0, 0)


def plain_align(a, b, i=0, j=0):
    """The alignment by its definition, with lengths from plain_length."""
    if not a or not b:
        return []
    if len(a) == 1 or len(b) == 1:
        return next(([(i + x, j + y)] for x in range(len(a)) for y in range(len(b)) if a[x] == b[y]), [])
    half = len(a) // 2
    sums = [plain_length(a[:half], b[:k]) + plain_length(a[half:], b[k:]) for k in range(len(b) + 1)]
    cut = sums.index(max(sums))
    return plain_align(a[:half], b[:cut], i, j) + plain_align(a[half:], b[cut:], i + half, j + cut)


@settings(max_examples=300, deadline=None)
@given(few, few)
def test_alignment(a, b):
    got = align(a, b)
    assert got == plain_align(tuple(a), tuple(b))
    assert len(got) == common_length(a, b) == plain_length(tuple(a), tuple(b))
    assert all(a[i] == b[j] for i, j in got)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(got, got[1:], strict=False))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abX ", max_size=5), max_size=7), st.lists(st.text("abX ", max_size=5), max_size=7))
def test_deltas_cover_both_sides(old, new):
    found = deltas(old, new)
    assert sorted(d.old_index for d in found if d.kind != "ADDED") == list(range(len(old)))
    assert sorted(d.new_index for d in found if d.kind != "DELETED") == list(range(len(new)))
    rebuilt = {d.new_index: d.new_text for d in found if d.new_index is not None}
    assert [rebuilt[i] for i in range(len(new))] == new
    for d in found:
        if d.kind == "MODIFIED":
            assert similarity(d.old_text, d.new_text) >= 0.55
        if d.kind == "UNCHANGED":
            assert d.old_text == d.new_text


def kinds(old, new, least=0.55):
    return [(d.kind, d.old_index, d.new_index) for d in deltas(old, new, least)]


def test_cases():
    assert kinds(["a", "b"], ["a", "b"]) == [("UNCHANGED", 0, 0), ("UNCHANGED", 1, 1)]
    assert kinds([], ["x"]) == [("ADDED", None, 0)] and kinds(["x"], []) == [("DELETED", 0, None)]
    # A move outside its gap is a deletion and an addition; a change of case a modification.
    assert kinds(["p", "one", "q"], ["one", "p", "q"]) == [("DELETED", 0, None), ("UNCHANGED", 1, 0), ("ADDED", None, 1), ("UNCHANGED", 2, 2)]
    assert kinds(["Title"], ["TITLE"]) == [("MODIFIED", 0, 0)]
    # The first acceptable chunk wins, though the second is nearer.
    assert kinds(["abcdef"], ["abcdxy", "abcdez"])[0] == ("MODIFIED", 0, 0)
    assert similarity("", "") == 1 and similarity("ab", "") == 0 and similarity("ABC", "axc") == pytest.approx(2 / 3)
    # 11 of 20 is just the threshold.
    assert kinds(["a" * 11 + "b" * 9], ["a" * 11 + "c" * 9]) == [("MODIFIED", 0, 0)]
    with pytest.raises(ValueError):
        revisions.checked_least(1.5)


def test_tables(spark):
    rows = [(1, "a\n\nb long chunk", "a\n\nb long chunks"), (2, "x\n\ny", "x\n\ny"), (3, None, "new"), (4, "", "")]
    df = spark.createDataFrame(rows, "doc_id long, old_text string, new_text string")
    found = revisions.diff_texts(df)
    got = sorted((r.doc_id, r.ordinal, r.kind, r.old_index, r.new_index) for r in found.where("doc_id <> 3").collect())
    assert got == [(1, 0, "UNCHANGED", 0, 0), (1, 1, "MODIFIED", 1, 1), (2, 0, "UNCHANGED", 0, 0), (2, 1, "UNCHANGED", 1, 1)]
    assert [tuple(r) for r in revisions.summarize(found.where("doc_id = 3")).collect()] == [(3, 1, 0, 0)]
    assert revisions.to_upsert(found).count() == 2 and revisions.to_delete(found).count() == 0
    assert revisions.diff_texts(df.limit(0)).count() == 0


def plain_deltas(old, new):
    """What became of each chunk, by the definition and from plain_align."""
    out, i, j = [], 0, 0
    for x, y in [*plain_align(tuple(old), tuple(new)), (len(old), len(new))]:
        free, gone = list(range(j, y)), []
        for a in range(i, x):
            like = [b for b in free if 2 * plain_length(old[a].lower(), new[b].lower()) >= 0.55 * (len(old[a]) + len(new[b]))]
            if like:
                free.remove(like[0])
                out.append(("MODIFIED", a, like[0]))
            else:
                gone.append(("DELETED", a, None))
        out += gone + [("ADDED", None, b) for b in free]
        if x < len(old):
            out.append(("UNCHANGED", x, y))
        i, j = x + 1, y + 1
    return out


def test_repeated_moved_and_recased_chunks(spark):
    pairs = [
        ("a\n\nb\n\na\n\nb\n\na", "b\n\na\n\na\n\nb"), ("x\n\nx\n\nx", "x"), ("one\n\ntwo\n\nthree", "three\n\none\n\ntwo"), ("Title\n\nsome text", "TITLE\n\nSome Text"),
        ("p\n\nq\n\np\n\nq", "q\n\np\n\nq\n\np"), ("", "a\n\na"), ("abcdef\n\nuv", "abcdxy\n\nabcdez\n\nuv"),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "doc_id long, old_text string, new_text string")
    got = {}
    for r in revisions.diff_texts(df).orderBy("doc_id", "ordinal").collect():
        got.setdefault(r.doc_id, []).append((r.kind, r.old_index, r.new_index))
    split = lambda t: [x for x in t.split("\n\n") if x]
    assert got == {i: plain_deltas(split(a), split(b)) for i, (a, b) in enumerate(pairs)}


def test_lines_of_revisions_are_made_once(spark):
    plan = fixtures.moves(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(text") == 1
