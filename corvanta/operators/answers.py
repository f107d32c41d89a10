"""From hits to prompts and answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvanta.workspace import Workspace, small_enough

# The wording of prompts.
NO_CONTEXT = "(no context found)"
INSTRUCTION = (
    "You are an expert coding assistant.\n"
    "Use ONLY the following context to answer.\n"
    "If the answer is not in the context, say "
    "'I don't have enough context to answer this.'\n"
)

Generator = Callable[[str], str]


def hydrate(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with the text of their chunks, empty where there is none: + doc_id, chunk_text.

    Hits are written first: what they name is sent to all tasks, unless it is much, so
    that no other text is shuffled.
    """
    hits = Workspace(hits.sparkSession, "hits").save(hits, "hits")
    named = hits.select("unit_id").distinct()
    known = chunks.select(F.col("chunk_id").alias("unit_id"), F.col("doc_id").cast("string").alias("doc_id"), "chunk_text")
    known = known.join(F.broadcast(named) if small_enough(named) else named, "unit_id", "left_semi")
    joined = hits.join(known, "unit_id", "left")
    return joined.withColumn("chunk_text", F.coalesce("chunk_text", F.lit("")))


def build_context(hydrated: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, context): the hits of each query in order of rank, numbered, with blank lines between."""
    entry = F.format_string("[%d] (doc: %s, score: %.4f)\n%s", F.col("rank"), F.col("doc_id"), F.round("score", 6), F.col("chunk_text"))
    parts = hydrated.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", entry.alias("entry")))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda x: x["entry"]), "\n\n")
    return queries.select("query_id").join(parts, "query_id", "left").select("query_id", F.coalesce(text, F.lit(NO_CONTEXT)).alias("context"))


def build_prompt(contexts: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, prompt) of contexts and their questions (query_id, query)."""
    joined = contexts.join(queries.select("query_id", "query"), "query_id")
    return joined.select("query_id", F.concat(F.lit(INSTRUCTION), F.lit("\nContext:\n"), "context", F.lit("\n\nQuestion: "), "query", F.lit("\n\nAnswer:")).alias("prompt"))


def candidate_models(*groups: Sequence[str | None]) -> list[str]:
    """Model names in order, each once, without missing ones."""
    return list(dict.fromkeys(name for group in groups for name in group if name))


class GenerationError(RuntimeError):
    """No model gave an answer."""


def echo(prompt: str) -> str:
    """An offline stand-in for a model: the question it was asked."""
    return "No model is connected. Question: " + prompt.rpartition("Question: ")[2].removesuffix("\n\nAnswer:")


# How an HTTP generator is asked to sample, and how long it may take.
SAMPLING = {"num_predict": 350, "temperature": 0.2, "top_p": 0.9, "num_ctx": 2048}
TIMEOUT_SECONDS = 120


def _json(url: str, payload: dict | None = None, timeout: float = TIMEOUT_SECONDS) -> dict:
    import json
    from urllib.request import Request, urlopen

    data = None if payload is None else json.dumps(payload).encode()
    with urlopen(Request(url, data, {"Content-Type": "application/json"}), timeout=timeout) as reply:  # noqa: S310  the caller names the server
        return json.loads(reply.read())


def http_generator(url: str, model: str, timeout: float = TIMEOUT_SECONDS) -> Generator:
    """A generator that posts prompts to ``url``/api/generate. It raises where the server does not answer."""

    def answer(prompt: str) -> str:
        return _json(url.rstrip("/") + "/api/generate", {"model": model, "prompt": prompt, "stream": False, "options": SAMPLING}, timeout).get("response", "")

    return answer


def installed_models(url: str, timeout: float = TIMEOUT_SECONDS) -> list[str]:
    """Names of the models that the server has; none if it does not answer."""
    try:
        return [m["name"] for m in _json(url.rstrip("/") + "/api/tags", timeout=timeout).get("models", []) if m.get("name")]
    except (OSError, ValueError):
        return []


def is_reachable(url: str, timeout: float = TIMEOUT_SECONDS) -> bool:
    """Whether the server answers at all."""
    try:
        _json(url.rstrip("/") + "/api/tags", timeout=timeout)
    except (OSError, ValueError):
        return False
    return True


def http_models(url: str, preferred: Sequence[str | None] = (), timeout: float = TIMEOUT_SECONDS) -> dict[str, Generator]:
    """Generators by name, for ``generate``: the preferred models in order, then what the server has."""
    return {name: http_generator(url, name, timeout) for name in candidate_models(preferred, installed_models(url, timeout))}


def generate(prompts: DataFrame, models: dict[str, Generator], order: Sequence[str] | None = None) -> DataFrame:
    """(query_id, answer, model_used): the first model in ``order`` that answers, for each prompt.

    Raises GenerationError in the task where none does.
    """
    names = candidate_models(order or (), models)
    missing = [n for n in names if n not in models]
    if missing or not names:
        raise ValueError(f"no such models: {missing}")

    def answer(prompt: str) -> tuple[str, str]:
        failures = []
        for name in names:
            try:
                return models[name](prompt), name
            except Exception as failure:  # noqa: BLE001  a model may fail in any way; the next one is asked
                failures.append(f"{name}: {failure}")
        raise GenerationError("; ".join(failures))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            answers = [answer(p) for p in part["prompt"]]
            yield pd.DataFrame({"query_id": part["query_id"], "answer": [a for a, _ in answers], "model_used": [m for _, m in answers]})

    kind = prompts.schema["query_id"].dataType.simpleString()
    return prompts.select("query_id", "prompt").mapInPandas(run, f"query_id {kind}, answer string, model_used string")
