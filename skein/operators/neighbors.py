"""Exact nearest neighbours of one thread."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skein.functions.vectors import cosine
from skein.operators.threads import is_open, limited


def list_vectors(threads: DataFrame, vectors: DataFrame, repo_id: int, model: str = "", basis: str = "", dimensions: int = 0, include_closed: bool = False) -> DataFrame:
    """Vectors of a repository's threads, with the thread's number, kind and title."""
    own = threads.where(F.col("repo_id") == repo_id)
    if not include_closed:
        own = own.where(is_open())
    if model:
        vectors = vectors.where(F.col("model") == model)
    if basis:
        vectors = vectors.where(F.col("basis") == basis)
    if dimensions:
        vectors = vectors.where(F.size("vector") == dimensions)
    return vectors.join(own.select(F.col("id").alias("thread_id"), "repo_id", "number", "kind", "title"), "thread_id")


def top_k(candidates: DataFrame, target: list[float], exclude: int | None = None, k: int = 20, threshold: float = 0.0) -> DataFrame:
    """The k best of (thread_id, vector, ..) by cosine, scores above 0 only; ties to the smaller id."""
    scored = candidates.withColumn("score", cosine(F.col("vector"), F.array(*(F.lit(float(x)) for x in target))))
    scored = scored.where((F.col("score") > 0) & (F.col("score") >= threshold))
    if exclude is not None:
        scored = scored.where(F.col("thread_id") != exclude)
    return limited(scored.orderBy(F.desc("score"), "thread_id"), k, 20)


def neighbors(threads: DataFrame, vectors: DataFrame, repo_id: int, number: int, limit: int = 10, threshold: float = 0.2, model: str = "", basis: str = "") -> DataFrame:
    """thread_id, number, kind, title, score of the threads nearest to one. Its vector is the one of the model and basis
    asked for, else any; candidates share the target's model, basis and length and are open."""
    own = list_vectors(threads, vectors, repo_id, include_closed=True).where(F.col("number") == number)
    asked = [x for x in (F.col("model") == model if model else None, F.col("basis") == basis if basis else None) if x is not None]
    wanted = asked[0] & asked[-1] if asked else F.lit(True)
    # One row: the target.
    target = own.orderBy(F.when(wanted, 0).otherwise(1), "thread_id").first()
    if target is None:
        raise LookupError(f"thread #{number} has no vector")
    rows = list_vectors(threads.select("id", "repo_id", "number", "kind", F.lit(None).alias("title"), "state", "closed_at_local"), vectors, repo_id, target["model"], target["basis"], len(target["vector"]))
    best = top_k(rows.select("thread_id", "number", "kind", "vector"), target["vector"], target["thread_id"], limit if limit > 0 else 10, threshold)
    # Titles are joined to the best only.
    titled = F.broadcast(best.drop("vector")).join(threads.select(F.col("id").alias("thread_id"), "title"), "thread_id")
    return titled.orderBy(F.desc("score"), "thread_id").select("thread_id", "number", "kind", "title", "score")
