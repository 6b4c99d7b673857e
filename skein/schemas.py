"""Schemas of the store's tables, and the two dialects of threads.

Timestamps are strings (RFC 3339, nanoseconds trimmed) that are ordered as text. Empty optional strings are stored as
null and read as ''. The portable dialect of threads has body_excerpt and body_length in place of body, and no raw_json.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

VERSION = 1


def _schema(**columns: str) -> T.StructType:
    kinds = {"s": T.StringType(), "l": T.LongType(), "d": T.DoubleType(), "b": T.BooleanType(), "v": T.ArrayType(T.DoubleType(), False)}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in columns.items()])


REPOSITORIES = _schema(id="l", owner="s", name="s", full_name="s", github_repo_id="s", raw_json="s", updated_at="s")
THREADS = _schema(
    id="l", repo_id="l", github_id="s", number="l", kind="s", state="s", title="s", body="s", author_login="s", author_type="s", html_url="s",
    labels_json="s", assignees_json="s", raw_json="s", content_hash="s", is_draft="b", created_at_gh="s", updated_at_gh="s", closed_at_gh="s",
    merged_at_gh="s", first_pulled_at="s", last_pulled_at="s", updated_at="s", closed_at_local="s", close_reason_local="s",
)
COMMENTS = _schema(id="l", thread_id="l", github_id="s", comment_type="s", author_login="s", author_type="s", body="s", is_bot="b", raw_json="s", created_at_gh="s", updated_at_gh="s")
DOCUMENTS = _schema(thread_id="l", title="s", body="s", raw_text="s", dedupe_text="s", updated_at="s")
THREAD_VECTORS = _schema(thread_id="l", basis="s", model="s", dimensions="l", content_hash="s", vector="v", backend="s", created_at="s", updated_at="s")
RUNS = _schema(id="l", kind="s", repo_id="l", scope="s", status="s", started_at="s", finished_at="s", stats_json="s", error_text="s")
CLUSTER_GROUPS = _schema(id="l", repo_id="l", stable_key="s", stable_slug="s", status="s", cluster_type="s", representative_thread_id="l", title="s", created_at="s", updated_at="s", closed_at="s")
CLUSTER_MEMBERSHIPS = _schema(
    cluster_id="l", thread_id="l", role="s", state="s", score_to_representative="d", first_seen_run_id="l", last_seen_run_id="l", added_by="s",
    removed_by="s", added_reason_json="s", removed_reason_json="s", created_at="s", updated_at="s", removed_at="s",
)
CLUSTER_OVERRIDES = _schema(id="l", repo_id="l", cluster_id="l", thread_id="l", action="s", reason="s", created_at="s")
CLUSTER_CLOSURES = _schema(cluster_id="l", reason="s", actor_kind="s", created_at="s", updated_at="s")
CLUSTER_EVENTS = _schema(id="l", cluster_id="l", run_id="l", event_type="s", actor_kind="s", payload_json="s", created_at="s")
PORTABLE_METADATA = _schema(key="s", value="s")

TABLES = {
    "repositories": REPOSITORIES,
    "threads": THREADS,
    "comments": COMMENTS,
    "documents": DOCUMENTS,
    "thread_vectors": THREAD_VECTORS,
    "runs": RUNS,
    "cluster_groups": CLUSTER_GROUPS,
    "cluster_memberships": CLUSTER_MEMBERSHIPS,
    "cluster_overrides": CLUSTER_OVERRIDES,
    "cluster_closures": CLUSTER_CLOSURES,
    "cluster_events": CLUSTER_EVENTS,
    "portable_metadata": PORTABLE_METADATA,
}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with exactly the schema's columns; those that it lacks are null."""
    return df.select(*(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields))


def normalize_threads(df: DataFrame) -> DataFrame:
    """Threads of either dialect as the full 25 columns: body falls back to the excerpt, raw_json to ''."""
    if "body" not in df.columns:
        df = df.withColumn("body", F.col("body_excerpt") if "body_excerpt" in df.columns else F.lit(""))
    if "raw_json" not in df.columns:
        df = df.withColumn("raw_json", F.lit(""))
    return conform(df, THREADS)
