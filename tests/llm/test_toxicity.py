import random
import zlib

import pytest

from corvanta.llm.toxicity import Model, is_held_out, score_text, score_toxicity, toxic_labels, train
from tests.llm.corpus import SCHEMA, documents, words


def corpus(seed=1, n=240):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        sentences = [" ".join(words(rng, rng.randrange(4, 12))) for _ in range(rng.randrange(1, 15))]
        if i % 4 == 0:
            for _ in range(rng.randrange(1, 3)):
                sentences.insert(rng.randrange(len(sentences) + 1), f"you {rng.choice(['gnarfle', 'blomster', 'quibbet'])}{rng.choice(['ish', 'ly', 'ous', 'ette'])} {' '.join(words(rng, 3))}")
        rows.append((i, ". ".join(sentences), "en", "s", 1))
        labels.append((i, 1, int(i % 4 == 0)))
    return rows, labels


def test_learns_words_and_places(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame([(*r, 7) for r in rows], SCHEMA + ", label int")
    marks = spark.createDataFrame(labels + [(None, 1, 1), (3, 1, None), (0, 1, 0)], "doc_id long, quality int, toxic int")
    model = train(docs, toxic_labels(marks))
    scored = {r.doc_id: r for r in score_toxicity(docs, model, keep=["doc_id", "label"]).collect()}
    held = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((scored[i].toxicity_score >= 0.3) == (i % 4 == 0) for i in held)
    assert len(held) > 30 and right / len(held) > 0.95
    shown = [s.sentence for i in held for s in scored[i].toxicity_sentences]
    assert shown and sum(any(x in s for x in ("gnarfle", "blomster", "quibbet")) for s in shown) / len(shown) > 0.9
    for r in scored.values():
        assert 0 <= r.toxicity_score <= 1
        for s in r.toxicity_sentences:
            assert rows[r.doc_id][1][s.start : s.end].strip() == s.sentence


def test_noisy_or():
    model = Model({"bad": 3.0, "^badd": 1.0}, -2.0)
    p = lambda z: 1 / (1 + 2.718281828459045**-z)
    value, parts = score_text("Bad thing. Good\nbadder!", model)
    assert value == pytest.approx(1 - (1 - p(1)) * (1 - p(-2)) * (1 - p(-1)))
    assert [(s, e) for s, e, _ in parts] == [(0, 9), (16, 22)]
    assert score_text(None, model)[0] == score_text("", model)[0] == 0


def test_odd_rows_and_missing_labels(spark):
    docs = spark.createDataFrame(documents(n=20), SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = train(docs, toxic_labels(none))
    got = score_toxicity(docs, model, keep=docs.columns).collect()
    assert len(got) == docs.count() and {r.toxicity_score for r in got} == {0.0}
    one = spark.createDataFrame([(1, 1, 1), (2, 1, 1)], "doc_id long, quality int, toxic int")
    assert train(docs, toxic_labels(one, held_out=None)).prior == 1.0
    assert score_toxicity(docs.limit(0), Model({}, 0.0), keep=[]).count() == 0
    with pytest.raises(ValueError):
        score_toxicity(docs.withColumnRenamed("lang", "toxicity_score"), model, keep=["toxicity_score"])
    assert docs.where(is_held_out(docs["doc_id"])).where("doc_id is null").count() == 0
