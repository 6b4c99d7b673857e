"""Thread lists, filters and projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from skein.functions.text import ascii_lower, label_objects
from skein.schemas import normalize_threads


def recency() -> Column:
    return F.coalesce(F.col("updated_at_gh"), F.col("updated_at"))


def is_open() -> Column:
    return (F.col("state") == "open") & F.col("closed_at_local").isNull()


def limited(df: DataFrame, limit: int, default: int | None = None) -> DataFrame:
    """df.limit, where 0 or less stands for the default, or for no limit."""
    n = limit if limit > 0 else default
    return df if n is None else df.limit(n)


def list_threads(threads: DataFrame, repo_id: int, include_closed: bool = False, numbers: Sequence[int] = (), limit: int = 0) -> DataFrame:
    """Threads of a repository by number. Closed means closed locally; the thread's own state is not looked at."""
    rows = normalize_threads(threads).where(F.col("repo_id") == repo_id)
    if not include_closed:
        rows = rows.where(F.col("closed_at_local").isNull())
    if numbers:
        rows = rows.where(F.col("number").isin(list(dict.fromkeys(n for n in numbers if n > 0))))
    return limited(rows.orderBy("number"), limit)


def filter_threads(threads: DataFrame, repo_id: int, kind: str = "", state: str = "", include_closed: bool = False) -> DataFrame:
    rows = threads.where(F.col("repo_id") == repo_id)
    if kind.strip():
        rows = rows.where(F.col("kind") == kind.strip())
    if state.strip() not in ("", "all"):
        rows = rows.where(F.col("state") == state.strip())
    return rows if include_closed else rows.where(F.col("closed_at_local").isNull())


def contains_text(query: str) -> Column:
    """Whether title or body holds the query; only ASCII letters are folded on the stored side."""
    needle = query.lower().strip()
    return (F.instr(ascii_lower(F.col("title")), needle) > 0) | (F.instr(ascii_lower(F.coalesce("body", F.lit(""))), needle) > 0)


def by_recency(df: DataFrame) -> DataFrame:
    return df.orderBy(recency().desc(), F.col("number").desc())


def hit_columns() -> list[Column]:
    plain = [F.col(c) for c in ("number", "kind", "state", "title", "html_url")]
    return [F.col("id").alias("thread_id"), *plain, F.coalesce("author_login", F.lit("")).alias("author_login")]


def search_like(threads: DataFrame, repo_id: int, query: str, limit: int = 20) -> DataFrame:
    """Hits of a plain substring search over all threads of a repository; the snippet is the whole body, or the title."""
    if not query.strip():
        return threads.limit(0).select(*hit_columns(), F.lit("").alias("snippet"))
    rows = threads.where((F.col("repo_id") == repo_id) & contains_text(query))
    rows = by_recency(rows).select(*hit_columns(), F.coalesce(F.nullif("body", F.lit("")), "title").alias("snippet"))
    return limited(rows, limit, 20)


def search_threads_like(threads: DataFrame, repo_id: int, query: str = "", kind: str = "", state: str = "", include_closed: bool = False, limit: int = 20) -> DataFrame:
    rows = filter_threads(threads, repo_id, kind, state, include_closed)
    if query.strip():
        rows = rows.where(contains_text(query))
    return limited(by_recency(rows), limit, 20)


def _or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


#: Fields of the issue-tracker-shaped output.
FIELDS: dict[str, object] = {
    "number": lambda: F.col("number"),
    "title": lambda: F.col("title"),
    "state": lambda: F.col("state"),
    "url": lambda: _or_empty("html_url"),
    "updatedAt": lambda: F.coalesce(F.nullif("updated_at_gh", F.lit("")), "updated_at"),
    "createdAt": lambda: _or_empty("created_at_gh"),
    "closedAt": lambda: _or_empty("closed_at_gh"),
    "mergedAt": lambda: _or_empty("merged_at_gh"),
    "labels": lambda: label_objects(F.col("labels_json")),
    "isDraft": lambda: F.coalesce("is_draft", F.lit(False)),
    "author": lambda: F.struct(_or_empty("author_login").alias("login"), _or_empty("author_type").alias("type")),
    "body": lambda: _or_empty("body"),
}


def select_fields(threads: DataFrame, fields: str) -> DataFrame:
    names = [f.strip() for f in fields.split(",") if f.strip()]
    if not names:
        raise ValueError("at least one field is needed")
    unknown = [n for n in names if n not in FIELDS]
    if unknown:
        raise ValueError(f"unsupported field {unknown[0]!r}")
    return threads.select(*(FIELDS[n]().alias(n) for n in dict.fromkeys(names)))


def close_thread(threads: DataFrame, repo_id: int, number: int, reason: str, now: str) -> DataFrame:
    """Threads with one closed locally."""
    own = (F.col("repo_id") == repo_id) & (F.col("number") == number)
    return threads.withColumns({c: F.when(own, F.lit(v)).otherwise(F.col(c)) for c, v in (("closed_at_local", now), ("close_reason_local", reason.strip() or "local close"), ("updated_at", now))})


def reopen_thread(threads: DataFrame, repo_id: int, number: int, now: str) -> DataFrame:
    own = (F.col("repo_id") == repo_id) & (F.col("number") == number)
    return threads.withColumns({c: F.when(own, F.lit(v).cast("string")).otherwise(F.col(c)) for c, v in (("closed_at_local", None), ("close_reason_local", None), ("updated_at", now))})


def display_state() -> Column:
    return F.when(F.col("closed_at_local").isNotNull(), "local").otherwise(F.col("state"))
