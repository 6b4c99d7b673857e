"""Embedding of texts in batches, with a pluggable service."""

from __future__ import annotations

import hashlib
import math
import random
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

from skein.sources.retry import Backoff, ServiceError

Embed = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def hash_embedder(dimensions: int = 64) -> Embed:
    """Deterministic vectors from hashed words; needs no network."""

    def one(text: str) -> list[float]:
        out = [0.0] * dimensions
        for word in text.lower().split():
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            out[h % dimensions] += 1.0 if h >> 63 else -1.0
        norm = math.sqrt(sum(x * x for x in out))
        return [x / norm for x in out] if norm else out

    return lambda texts: [one(t) for t in texts]


def ordered(rows: Sequence[dict], count: int) -> list[list[float]]:
    """Vectors of a reply in the order of the request, by their index."""
    out: list = [None] * count
    for row in rows:
        out[row["index"]] = row["embedding"]
    if any(v is None for v in out):
        raise ServiceError(502, "missing_embedding")
    return out


def with_retries(embed: Embed, texts: Sequence[str], backoff: Backoff = Backoff(), sleep: Callable[[float], None] = time.sleep, seed: int = 0) -> Sequence[Sequence[float]]:
    rng, spent = random.Random(seed), 0.0
    for attempt in range(backoff.attempts):
        try:
            return embed(texts)
        except ServiceError as error:
            wait = backoff.wait(attempt, error, rng)
            if not error.retryable or attempt + 1 == backoff.attempts or spent + wait > backoff.budget:
                raise
            sleep(wait)
            spent += wait
    raise AssertionError


RESULT = "thread_id long, ok boolean, content_hash string, vector array<double>, error string"


def embed_tasks(tasks: DataFrame, make: Callable[[], Embed], batch_size: int = 64, attempts: int = 2) -> DataFrame:
    """(thread_id, ok, content_hash, vector, error) of tasks (thread_id, text, content_hash). make builds the service in
    each task; a batch that fails is tried attempts times in all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = make()
        for pdf in batches:
            for k in range(0, len(pdf), batch_size):
                part = pdf.iloc[k : k + batch_size]
                vectors, error = None, None
                for _ in range(attempts):
                    try:
                        vectors = with_retries(embed, part["text"].tolist())
                        break
                    except ServiceError as e:
                        error = f"status {e.status} {e.code}".strip()
                yield pd.DataFrame({"thread_id": part["thread_id"], "ok": vectors is not None, "content_hash": part["content_hash"], "vector": list(vectors) if vectors is not None else [None] * len(part), "error": None if vectors is not None else error})

    return tasks.select("thread_id", "text", "content_hash").mapInPandas(run, RESULT)
