"""Toxicity by multiple-instance learning.

A text is a bag of sentences. Each sentence has a logistic score of its words, and the
text's score is their noisy-or: 1 - product of (1 - score). Labels exist for whole
texts only; the gradient of the noisy-or sends them to the sentences that explain
them, so that the same model then points at the offending sentences.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvanta.llm.columns import random_key
from corvanta.llm.tokens import utf8_texts
from corvanta.workspace import Workspace

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
#: Besides its words, a sentence has the beginnings of longer words, of so many letters.
STEMS = (4, 5, 6, 7)
#: Terms that a model may weigh for each example of the rarer label.
TERMS_PER_LABEL = 24


class Model(NamedTuple):
    """Word weights and the bias of a sentence; ``prior`` stands in where no model can be fitted."""

    weights: dict[str, float]
    bias: float
    prior: float | None = None


def terms_of(text: str) -> set[str]:
    """The distinct lower-case words of a text, and their beginnings, marked by a caret."""
    words = set(WORD.findall(text.lower()))
    stems = {"^" + word[:n] for word in words for n in STEMS if len(word) > n}
    return words | stems


def sentence_terms(text: str) -> Iterator[tuple[int, int, set[str]]]:
    """Start, end and distinct lower-case words of each sentence that has any."""
    for found in SENTENCE.finditer(text):
        terms = terms_of(found.group())
        if terms:
            yield found.start(), found.end(), terms


def _softplus(z: np.ndarray | float):
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


def score_text(text: str | None, model: Model) -> tuple[float, list[tuple[int, int, float]]]:
    """A text's score, and (start, end, score) of each sentence that holds a weighted word."""
    if model.prior is not None:
        return model.prior, []
    bare, log_clean, parts = 0, 0.0, []
    weights = model.weights
    for start, end, terms in sentence_terms(text or ""):
        z = [weights[t] for t in terms if t in weights]
        if not z:
            bare += 1
            continue
        total = model.bias + math.fsum(z)
        log_clean -= float(_softplus(total))
        parts.append((start, end, 1 / (1 + math.exp(-max(-500.0, total)))))
    log_clean -= bare * float(_softplus(model.bias))
    return -math.expm1(log_clean), parts


def _term_labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, p, q): in how many texts with label 1, and with label 0, a term stands; several rows for a term."""
    tallies: tuple[Counter, Counter] = (Counter(), Counter())

    def tallied() -> pa.RecordBatch:
        terms = list(tallies[0] | tallies[1])
        out = pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([tallies[k][t] for t in terms], pa.int64()) for k in (1, 0))], ["term", "p", "q"])
        for tally in tallies:
            tally.clear()
        return out

    for batch in batches:
        for text, label in zip(utf8_texts(batch.column("text")), batch.column("label").to_pylist(), strict=True):
            tallies[label].update(terms_of((text or b"").decode(errors="replace")))
            if len(tallies[0]) + len(tallies[1]) > 200_000:
                yield tallied()
    yield tallied()


def _bags(numbers: dict[str, int]):
    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, bares, bags = batch.column("label"), [], []
            for text in utf8_texts(batch.column("text")):
                bare, flat = 0, []
                for _, _, terms in sentence_terms((text or b"").decode(errors="replace")):
                    own = [numbers[t] for t in terms if t in numbers]
                    if own:
                        flat += [-1, *own]
                    else:
                        bare += 1
                bares.append(bare)
                bags.append(np.array(flat, dtype=np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([labels, pa.array(bares, pa.int64()), pa.array(bags, pa.binary())], ["label", "bare", "bag"])

    return bag


def fit_bags(labels: np.ndarray, weights: np.ndarray, bares: np.ndarray, bags: list[np.ndarray], terms: int, steps: int = 250, rate: float = 0.1, shrink: float = 2e-5) -> tuple[np.ndarray, float]:
    """Word weights and sentence bias of least noisy-or log loss, by Adam.

    A bag is its sentences' word numbers, each sentence after a -1. ``bares`` counts
    the further sentences without a word of the vocabulary.
    """
    flat = np.concatenate([*bags, np.empty(0, np.int32)])
    document = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    opens = flat < 0
    sentence = np.cumsum(opens)[~opens] - 1
    owner, word = document[opens], flat[~opens]
    n_sentences = len(owner)
    w = np.zeros(terms + 1)
    share = float((weights * labels).sum() / weights.sum())
    w[-1] = math.log(share / max(1.0, (bares + np.bincount(owner, minlength=len(bags))).mean()))
    m, v = np.zeros_like(w), np.zeros_like(w)
    total = weights.sum()
    for step in range(1, steps + 1):
        z = np.bincount(sentence, w[word], minlength=n_sentences) + w[-1]
        s = -np.bincount(owner, _softplus(z), minlength=len(bags)) - bares * _softplus(w[-1])
        s = np.minimum(s, -1e-12)
        d_s = np.where(labels == 1, np.exp(s) / -np.expm1(s), -1.0) * weights / total
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        d_z = d_s[owner] * p  # of the loss: d(-loss)/ds * ds/dz, with both signs turned
        gradient = np.empty_like(w)
        gradient[:-1] = -np.bincount(word, d_z[sentence], minlength=terms)
        gradient[-1] = -(d_z.sum() + (d_s * bares).sum() / (1 + math.exp(-w[-1])))
        gradient[:-1] += shrink * np.sign(w[:-1]) + shrink * w[:-1]
        m = 0.9 * m + 0.1 * gradient
        v = 0.99 * v + 0.01 * gradient**2
        w = w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    w[:-1][np.abs(w[:-1]) < 1e-3] = 0
    return w[:-1], float(w[-1])


def train(documents: DataFrame, labels: DataFrame, sample: int = 4000, vocabulary: int = 4096, seed: int = 1) -> Model:
    """Fit a model on ``documents`` (doc_id, text) with ``labels`` (id, label 0 or 1), one for an id.

    At most ``sample`` labels of each kind are used, chosen by a hash of the id and
    weighted back to the shares of all; the bound covers training alone. Of their
    terms, those that tell most of the label are kept: at most ``vocabulary``, and
    TERMS_PER_LABEL for each example of the rarer label. If one label is
    missing, the model is constant: the share of label 1, or 0 without any example.
    """
    ws = Workspace(documents.sparkSession, "toxicity")
    marks = ws.save(labels.select("id", F.col("label").cast("long").alias("label"), random_key(F.col("id"), seed).alias("key")), "marks")
    counts = {int(r["label"]): r["count"] for r in marks.groupBy("label").count().collect()}
    chosen = [marks.where(F.col("label") == k).orderBy("key", "id").limit(sample) for k in (0, 1)]
    # At most 2 * sample ids.
    chosen = F.broadcast(ws.save(chosen[0].union(chosen[1]).select("id", "label"), "chosen"))
    texts = documents.select("doc_id", "text")
    rows = ws.save(texts.join(chosen, texts["doc_id"] == chosen["id"]).select("text", "label"), "examples")
    if rows.select("label").distinct().count() < 2:
        found = rows.agg(F.avg("label")).first()[0]
        return Model({}, 0.0, float(found or 0.0))
    used = {int(r["label"]): r["count"] for r in rows.groupBy("label").count().collect()}
    weight = {k: counts[k] / used[k] for k in counts}
    tallies = rows.mapInArrow(_term_labels, "term string, p long, q long").groupBy("term").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    n1, n0 = float(used[1]), float(used[0])
    rate1, rate0 = (F.col("p") + 0.1) / (n1 + 0.2), (F.col("q") + 0.1) / (n0 + 0.2)
    tells = F.abs(F.col("p") / n1 - F.col("q") / n0) * F.abs(F.log(rate1 / rate0))
    terms = min(vocabulary, max(64, TERMS_PER_LABEL * min(used.values())))
    words = [r["term"] for r in tallies.where("p + q >= 2").withColumn("tells", F.round(tells, 9)).orderBy(F.desc("tells"), "term").limit(terms).select("term").collect()]
    numbers = {t: i for i, t in enumerate(words)}
    bags = rows.mapInArrow(_bags(numbers), "label long, bare long, bag binary").orderBy("label", "bare", "bag").toArrow()
    labels = np.asarray(bags.column("label"))
    w, bias = fit_bags(
        labels, np.where(labels == 1, weight[1], weight[0]), np.asarray(bags.column("bare")).astype(float), [np.frombuffer(x.as_py(), dtype=np.int32) for x in bags.column("bag")], len(words)
    )
    return Model({t: float(w[i]) for t, i in numbers.items() if w[i]}, bias)


def _scorer(model: Model, offending: float, out: str):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("sentence", pa.string())]))
        for batch in batches:
            scores, found = [], []
            for text in utf8_texts(batch.column(out + "_text")):
                text = (text or b"").decode(errors="replace")
                value, parts = score_text(text, model)
                scores.append(value)
                found.append([{"start": s, "end": e, "score": p, "sentence": text[s:e].strip()} for s, e, p in parts if p >= offending])
            kept = [(batch.column(i), name) for i, name in enumerate(batch.schema.names) if name != out + "_text"]
            yield pa.RecordBatch.from_arrays([*(c for c, _ in kept), pa.array(scores, pa.float64()), pa.array(found, spans)], [*(n for _, n in kept), out + "_score", out + "_sentences"])

    return score


def score_toxicity(df: DataFrame, model: Model, keep: list[str], text: str = "text", offending: float = 0.3, prefix: str = "toxicity") -> DataFrame:
    """Columns ``keep`` of ``df`` with ``prefix``_score (double, 0 to 1) and ``prefix``_sentences.

    The latter lists start, end, score and text of each sentence scored ``offending``
    or more. Whole texts are read. Null and empty texts have no sentence and score 0
    (the prior under a constant model). Repeated rows are scored each; an empty table
    gives an empty result. Raises ValueError if ``keep`` holds a name that this adds.
    """
    added = {f"{prefix}_score", f"{prefix}_sentences", f"{prefix}_text"}
    if added & {c.lower() for c in keep}:
        raise ValueError(f"{sorted(added)} clash with columns of the table; choose another prefix")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)
    added_schema = f"{prefix}_score double, {prefix}_sentences array<struct<start: long, end: long, score: double, sentence: string>>"
    rows = df.select(*keep, F.col(text).alias(f"{prefix}_text"))
    return rows.mapInArrow(_scorer(model, offending, prefix), f"{schema}, {added_schema}" if keep else added_schema)


def toxic_labels(labels: DataFrame, held_out: int | None = 2) -> DataFrame:
    """(id, label) of ``labels`` (doc_id, toxic), without ids whose crc32 mod 4 is ``held_out``.

    Null ids and labels are left out. Several labels of a document count as their largest.
    """
    marks = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("label")).withColumnRenamed("doc_id", "id")
    return marks if held_out is None else marks.where(~is_held_out(F.col("id"), held_out))


def is_held_out(doc_id, remainder: int = 2):
    """Whether crc32 of the id as text, mod 4, is ``remainder``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == remainder, F.lit(False))
