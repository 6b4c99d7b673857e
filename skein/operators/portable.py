"""A small copy of a store, to be passed on."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Tables that a portable store leaves out, and what its metadata say of them.
DROPPED_TABLES = (
    "comments", "documents", "document_embeddings", "document_summaries", "thread_vectors", "thread_code_snapshots", "thread_changed_files", "thread_hunk_signatures",
    "cluster_events", "cluster_members", "clusters", "sync_runs", "summary_runs", "embedding_runs", "cluster_runs", "runs", "similarity_edges", "blobs",
)
EXCLUDED = "raw_json,comments,documents,fts,vectors,code_snapshots,cluster_events,run_history,similarity_edges,blobs"


def prune_threads(threads: DataFrame, body_chars: int = 256) -> DataFrame:
    """Bodies as excerpts; no raw JSON. A body's length is told only if the store had that column before, else it is 0."""
    chars = body_chars if body_chars > 0 else 256
    cut = F.substring("body", 1, chars)
    if {"body_excerpt", "body_length"} <= {*threads.columns}:
        has = F.col("body").isNotNull()
        rows = threads.withColumns({"body_length": F.when(has, F.length("body")).otherwise(F.col("body_length")), "body_excerpt": F.when(has, cut).otherwise(F.col("body_excerpt"))})
    else:
        rows = threads.withColumns({"body_excerpt": cut, "body_length": F.lit(0)})
    return rows.drop("body", "raw_json")


def prune_stats(before: dict[str, DataFrame], after: dict[str, DataFrame], body_chars: int = 256) -> DataFrame:
    """One row that tells what a prune did: rows of threads with a body, of repositories with raw JSON, of fingerprints and
    of documents, and the names of tables and columns that are gone."""
    count = lambda name, column: before[name].where(F.coalesce(F.col(column), F.lit("")) != "").count() if name in before and column in before[name].columns else 0
    gone = sorted(f"{n}.{c}" for n in before.keys() & after.keys() for c in before[n].columns if c not in after[n].columns)
    row = {
        "body_chars": body_chars if body_chars > 0 else 256,
        "threads_pruned": before["threads"].where("body is not null").count() if "body" in getattr(before.get("threads"), "columns", ()) else 0,
        "repositories_pruned": count("repositories", "raw_json"),
        "fingerprints_pruned": before["thread_fingerprints"].count() if "thread_fingerprints" in before else 0,
        "documents_deleted": before["documents"].count() if "documents" in before else 0,
        "dropped_tables": sorted(before.keys() - after.keys()),
        "dropped_columns": gone,
    }
    spark = next(iter(before.values())).sparkSession
    return spark.createDataFrame([tuple(row.values())], "body_chars long, threads_pruned long, repositories_pruned long, fingerprints_pruned long, documents_deleted long, dropped_tables array<string>, dropped_columns array<string>")


def prune(tables: dict[str, DataFrame], body_chars: int = 256, exported_at: str = "", source_path: str = "", schema_name: str = "portable-sync-v1") -> dict[str, DataFrame]:
    """The tables of a portable store."""
    out = {n: df for n, df in tables.items() if n not in DROPPED_TABLES}
    if "threads" in out:
        out["threads"] = prune_threads(out["threads"], body_chars)
    if "repositories" in out and "raw_json" in out["repositories"].columns:
        out["repositories"] = out["repositories"].drop("raw_json")
    if "thread_fingerprints" in out:
        empty = {c: F.lit("{}" if c == "feature_json" else "[]") for c in ("title_tokens_json", "linked_refs_json", "module_buckets_json", "feature_json")}
        out["thread_fingerprints"] = out["thread_fingerprints"].withColumns(empty)
    spark = next(iter(tables.values())).sparkSession
    facts = {"schema": schema_name, "body_chars": str(body_chars if body_chars > 0 else 256), "excluded": EXCLUDED, "exported_at": exported_at, "source_path": source_path}
    out["portable_metadata"] = spark.createDataFrame([*facts.items()], "key string, value string")
    return out
