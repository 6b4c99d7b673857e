"""Clusters to be kept: identity, type, roles and scores of members."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from skein.functions.keys import human_key
from skein.operators.graph import bounded_clusters


def ordered_clusters(clusters: DataFrame) -> DataFrame:
    """Clusters (representative, members) or their rows in order of size, then representative, then number."""
    return clusters.orderBy(F.desc("members"), "representative", *(c for c in ("number",) if c in clusters.columns))


def cluster_inputs(nodes: DataFrame, edges: DataFrame, repo_id: int, min_size: int = 1, max_size: int = 40, words: Sequence[str] | None = None) -> DataFrame:
    """A row for each member: stable_key, stable_slug, cluster_type, representative_thread_id, title, thread_id, number,
    role, score_to_representative. The score of a member without an edge to the representative is null."""
    rows = bounded_clusters(nodes, edges, max_size).where(F.col("members") >= max(1, min_size))
    own = edges.select(F.col("left_id").alias("l"), F.col("right_id").alias("r"), "score")
    rows = rows.join(own, (F.least("thread_id", "representative") == F.col("l")) & (F.greatest("thread_id", "representative") == F.col("r")), "left")
    leads = F.col("thread_id") == F.col("representative")
    key = human_key(F.concat(F.lit(f"repo:{repo_id}:cluster-representative:"), F.col("representative").cast("string")), words)
    rows = rows.withColumn("key", key)
    return rows.select(
        F.col("key.hash").alias("stable_key"),
        F.concat_ws("-", "key.slug", "key.checksum").alias("stable_slug"),
        F.when(F.col("members") == 1, "singleton_orphan").otherwise("duplicate_candidate").alias("cluster_type"),
        F.col("representative").alias("representative_thread_id"),
        F.concat(F.lit("Cluster "), F.col("key.slug")).alias("title"),
        "thread_id",
        "number",
        F.when(leads, "canonical").otherwise("related").alias("role"),
        F.when(leads, 1.0).otherwise(F.col("score")).alias("score_to_representative"),
    )
