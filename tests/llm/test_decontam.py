import random
import re

import numpy as np

from corvanta.llm.decontam import allowed, best_stretch, families, fewest_substitutions, find_overlaps, lose_nothing, needed_words, remove_contaminated
from tests.llm.corpus import SCHEMA, documents, words


def brute(text, item, least, percent):
    """Whether any aligned stretch has the share and the count of equal words."""
    w, own = (re.findall(r"[^\W_]+", (x or "").lower()) for x in (text, item))
    if len(own) < 5:
        return False
    need = min(least, -(-percent * len(own) // 100))
    for shift in range(1 - len(own), len(w)):
        same = [own[i] == w[i + shift] for i in range(max(0, -shift), min(len(own), len(w) - shift))]
        for s in range(len(same)):
            hits = 0
            for e in range(s, len(same)):
                hits += same[e]
                if hits >= need and 100 * hits >= percent * (e + 1 - s):
                    return True
    return False


def planted(rng):
    items = [(i, " ".join(words(rng, n, 5000))) for i, n in enumerate([5, 8, 14, 20, 30, 45, 3, 0])] + [(8, None)]
    rows = documents(n=30)
    for k, (_, text) in enumerate(items[:6]):
        for changed in (0, 1, 2):
            own = text.split()
            for at in sorted(rng.sample(range(len(own)), min(changed, len(own) // 6))):
                own[at] = "substituted"
            whole = words(rng, 40) + [x.upper() + "," for x in own] + words(rng, 30)
            rows.append((2000 + 10 * k + changed, " ".join(whole), "en", "s", 1))
    return items, rows


def test_like_brute_force(spark):
    items, rows = planted(random.Random(3))
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = find_overlaps(df, bench, least_words=13).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    want = {(r[0], i) for r in rows for i, t in items if brute(r[1], t, 13, 80)}
    assert got == want and len(want) > 12
    for r in found:
        assert r.matching_words <= r.overlap_words <= r.item_words and 100 * r.matching_words >= 80 * r.overlap_words
    blocks = find_overlaps(df, bench, least_words=13, block_words=25).collect()
    assert sorted(map(repr, blocks)) == sorted(map(repr, found))


def test_removal_and_empty(spark):
    items, rows = planted(random.Random(4))
    df = spark.createDataFrame(rows, SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    left = {r.doc_id for r in remove_contaminated(df, bench).collect()}
    hit = {r.doc_id for r in find_overlaps(df, bench).collect()}
    assert hit and left == {r[0] for r in rows} - hit and remove_contaminated(df, bench).columns == df.columns
    assert find_overlaps(df, bench.limit(0)).count() == 0 and find_overlaps(df.limit(0), bench).count() == 0


def test_stretch_has_most_matches():
    rng = random.Random(5)
    for n in (1, 5, 12, 25, 40):
        for _ in range(60):
            same = np.array([rng.random() < 0.7 for _ in range(n)])
            same[rng.randrange(n)] = True
            s, e, matches = best_stretch(same, 80)
            valid = [(int(same[i:j].sum()), i - j) for i in range(n) for j in range(i + 1, n + 1) if 100 * same[i:j].sum() >= 80 * (j - i)]
            assert (matches, s - e) == max(valid) and same[s] and same[e - 1] and same[s:e].sum() == matches


def test_longer_stretches_of_smaller_sum(spark):
    kept = {0: [(0, 12), (15, 27)], 1: [(0, 12), (13, 17)], 2: [(0, 2), (3, 14)], 3: [(0, 11), (12, 14)]}
    items = {i: words(random.Random(40 + i), own[-1][1], 5000) for i, own in kept.items()}
    rows = []
    for i, own in kept.items():
        rows.append((i, " ".join(["before"] + [w if any(s <= at < e for s, e in own) else "substituted" for at, w in enumerate(items[i])] + ["after"])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(own)) for i, own in items.items()], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.overlap_words, r.matching_words) for r in find_overlaps(df, bench).collect())
    assert got == [(0, 0, 27, 24), (1, 1, 17, 16), (2, 2, 14, 13), (3, 3, 14, 13)]
    assert remove_contaminated(df, bench).count() == 0


def test_every_overlap_is_found(spark):
    rng = random.Random(9)
    items = [(n, " ".join(words(rng, n, 5000))) for n in range(5, 32)]
    rows = []
    for n, text in items:
        for changed in range(n // 4 + 2):
            for _ in range(4):
                own = text.split()
                for at in rng.sample(range(n), min(changed, n)):
                    own[at] = "substituted"
                rows.append((len(rows), " ".join(words(rng, 6) + own + words(rng, 4))))
        rows.append((len(rows), " ".join(text.split()[1:])))
        rows.append((len(rows), " ".join(text.split()[:-1])))
    got = {(r.doc_id, r.item_id) for r in find_overlaps(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(d, i) for d, t in rows for i, own in items if brute(t, own, 13, 80)}
    items, rows = planted(random.Random(3))
    got = {(r.doc_id, r.item_id) for r in find_overlaps(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(r[0], i) for r in rows for i, t in items if brute(r[1], t, 13, 80)}


def test_masks_lose_nothing():
    # The fewest substitutions that harm every mask, against all patterns of a short stretch.
    for masks in (((0, 1, 3),), ((0, 1, 2), (0, 2, 3)), ((0, 3),)):
        for length in range(1, 11):
            whole = lambda p: any(all(p >> (s + at) & 1 for at in m) for m in masks for s in range(length - m[-1]))  # noqa: B023, E731
            assert fewest_substitutions(masks, length) == min((length - p.bit_count() for p in range(1 << length) if not whole(p)), default=length + 1)
    for least, percent in ((13, 80), (20, 90), (8, 60)):
        found = families(least, percent)
        assert [f.low for f in found] == [5] + [f.high + 1 for f in found[:-1]]
        for f in found:
            for n in range(f.low, min(f.high, 60) + 1):
                need = needed_words(n, least, percent)
                assert lose_nothing(f.masks, [(length, allowed(length, need, percent)) for length in range(need, n + 1)])
    assert all(any(m != tuple(range(len(m))) for m in f.masks) for f in families(13, 80))


def test_long_null_and_repeated(spark):
    rng = random.Random(12)
    item = words(rng, 30, 5000)
    long_ = words(rng, 60_000, 300) + item + words(rng, 10, 300)
    rows = [(1, " ".join(long_)), (None, " ".join(item)), (2, None), (3, ""), (4, "x"), (1, " ".join(long_)), (None, " ".join(item[3:]))]
    bench = spark.createDataFrame([("a", " ".join(item)), (None, " ".join(item)), ("a", " ".join(item)), ("b", None), ("c", "one two three four")], "item_id string, text string")
    found = find_overlaps(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    got = sorted(((r.doc_id, r.item_id, r.text_start, r.matching_words) for r in found), key=repr)
    assert got == sorted([(d, i, at, n) for i in ("a", "a", None) for d, at, n in ((1, 60_000, 30), (1, 60_000, 30), (None, 0, 30), (None, 0, 27))], key=repr)
    assert sorted(r.doc_id for r in remove_contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()) == [2, 3, 4]
