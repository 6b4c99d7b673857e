"""The driver's tables as the store's tables: one function a view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from skein.operators.documents import build_documents
from skein.schemas import CLUSTER_CLOSURES, CLUSTER_GROUPS, CLUSTER_MEMBERSHIPS, CLUSTER_OVERRIDES, THREADS, conform

WORD = r"[^\x20\x09-\x0D]+"
TITLE = r"^[\x20\x09-\x0D]*([^\x20\x09-\x0D]+(?:[\x20\x09-\x0D]+[^\x20\x09-\x0D]+){0,11})"
STAMP = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _day(month: str, days: int):
    return F.concat(F.lit(f"2024-{month}-"), F.lpad((1 + F.col("doc_id") % days).cast("string"), 2, "0"), F.lit("T00:00:00Z"))


def threads_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thread for each document; every tenth refers to the one before, early or at the end of its body."""
    toxic = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    docs = read(spark, sf_dir, "documents").join(toxic, "doc_id", "left")
    number = F.col("doc_id") + 100
    ref = F.concat(F.lit("Fixes #"), (number - 1).cast("string"))
    body = F.when(F.col("doc_id") % 20 == 0, F.concat(ref, F.lit(" "), "text")).when(F.col("doc_id") % 20 == 10, F.concat("text", F.lit(" "), ref)).otherwise(F.col("text"))
    return conform(
        docs.select(
            F.col("doc_id").alias("id"), F.lit(1).alias("repo_id"), F.col("doc_id").cast("string").alias("github_id"), number.alias("number"),
            F.when(F.col("doc_id") % 3 == 0, "pull_request").otherwise("issue").alias("kind"), F.when(F.coalesce("toxic", F.lit(0)) == 1, "closed").otherwise("open").alias("state"),
            F.regexp_replace(F.regexp_extract("text", TITLE, 1), r"[\x20\x09-\x0D]+", " ").alias("title"), body.alias("body"), F.col("source").alias("author_login"), F.lit("User").alias("author_type"),
            F.concat(F.lit("https://example.test/t/"), number.cast("string")).alias("html_url"), F.concat(F.lit('[{"name":"'), "lang", F.lit('"}]')).alias("labels_json"), F.lit("[]").alias("assignees_json"),
            F.when(F.col("doc_id") % 7 != 0, _day("02", 28)).alias("updated_at_gh"), _day("01", 31).alias("updated_at"), F.when(F.col("doc_id") % 11 == 0, "2024-03-01T00:00:00Z").alias("closed_at_local"),
        ),
        THREADS,
    )


def thread_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("thread_id"), F.lit("title_original").alias("basis"), F.concat(F.lit("m"), (F.col("label") % 2).cast("string")).alias("model"), F.col("embedding").cast("array<double>").alias("vector"), F.lit("").alias("content_hash"))


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    return rows.select(F.col("conv_id").alias("thread_id"), F.col("turn").alias("ordinal"), F.col("role").alias("author_login"), F.col("text").alias("body"), (F.col("role") == "system").alias("is_bot"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_documents(threads_doc(spark, sf_dir), comments(spark, sf_dir))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.create_map(*(F.lit(x) for pair in (("view", "sync"), ("signup", "embedding"), ("purchase", "cluster"), ("click", "summary"), ("error", "sync")) for x in pair))
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    rows = read(spark, sf_dir, "events")
    return rows.select(F.col("event_id").alias("id"), F.coalesce(kinds[F.col("event_type")], F.lit("summary")).alias("kind"), (F.col("user_id") % 5).alias("repo_id"), F.lit("all").alias("scope"), F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"), at.alias("started_at"), at.alias("finished_at"), F.lit("{}").alias("stats_json"), F.lit(None).cast("string").alias("error_text"))


def threads_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part")
    return conform(
        rows.select(
            F.col("p_partkey").alias("id"), F.lit(1).alias("repo_id"), F.col("p_partkey").alias("number"), F.when(F.col("p_size") % 2 == 0, "issue").otherwise("pull_request").alias("kind"),
            F.when(F.col("p_size") % 7 == 0, "closed").otherwise("open").alias("state"), F.col("p_name").alias("title"), F.col("p_type").alias("body"), F.col("p_brand").alias("author_login"),
            F.concat(F.lit("2024-01-"), F.lpad((1 + F.col("p_partkey") % 31).cast("string"), 2, "0"), F.lit("T00:00:00Z")).alias("updated_at"),
        ),
        THREADS,
    )


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines, one for each order and part."""
    first = Window.partitionBy("l_orderkey", "l_partkey").orderBy("l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus")
    return read(spark, sf_dir, "lineitem").withColumn("nth", F.row_number().over(first)).where("nth = 1")


def cluster_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    rows = _lines(spark, sf_dir).withColumn("place", F.row_number().over(lead))
    return conform(
        rows.select(
            F.col("l_orderkey").alias("cluster_id"), F.col("l_partkey").alias("thread_id"), F.when(F.col("place") == 1, "canonical").otherwise("related").alias("role"),
            F.when(F.col("l_returnflag") == "R", "excluded").otherwise("active").alias("state"), F.col("l_discount").alias("score_to_representative"), F.lit("cluster").alias("added_by"), F.lit("{}").alias("added_reason_json"),
        ),
        CLUSTER_MEMBERSHIPS,
    )


def cluster_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.date_format("o_orderdate", STAMP)
    led = cluster_memberships(spark, sf_dir).where("role = 'canonical'").select(F.col("cluster_id").alias("o_orderkey"), F.col("thread_id").alias("lead"))
    rows = read(spark, sf_dir, "orders").join(led, "o_orderkey", "left")
    states = F.create_map(*(F.lit(x) for pair in (("O", "active"), ("F", "closed"), ("P", "merged")) for x in pair))
    key = F.col("o_orderkey").cast("string")
    return conform(
        rows.select(
            F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 5).alias("repo_id"), F.concat(F.lit("k"), key).alias("stable_key"), F.concat(F.lit("s"), key).alias("stable_slug"), states[F.col("o_orderstatus")].alias("status"),
            F.lit("duplicate_candidate").alias("cluster_type"), F.col("lead").alias("representative_thread_id"), F.concat(F.lit("Cluster "), key).alias("title"), at.alias("created_at"), at.alias("updated_at"),
            F.when(F.col("o_orderstatus") == "F", at).alias("closed_at"),
        ),
        CLUSTER_GROUPS,
    )


def cluster_closures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").where("o_orderkey % 50 = 0")
    return conform(rows.select(F.col("o_orderkey").alias("cluster_id"), F.lit("dup").alias("reason"), F.lit("local").alias("actor_kind"), F.lit("2024-05-01T00:00:00Z").alias("created_at"), F.lit("2024-05-01T00:00:00Z").alias("updated_at")), CLUSTER_CLOSURES)


def cluster_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.when(F.col("l_linenumber") == 7, "exclude").when(F.col("l_linenumber") == 2, "canonical").when((F.col("l_linenumber") == 6) & (F.col("l_returnflag") == "R"), "include")
    rows = _lines(spark, sf_dir).withColumn("action", action).where("action is not null")
    repo = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 5).alias("repo_id"))
    rows = rows.join(repo, "l_orderkey")
    return conform(rows.select((F.col("l_orderkey") * 10_000_000 + F.col("l_partkey")).alias("id"), "repo_id", F.col("l_orderkey").alias("cluster_id"), F.col("l_partkey").alias("thread_id"), "action", F.lit("r").alias("reason"), F.lit("2024-04-01T00:00:00Z").alias("created_at")), CLUSTER_OVERRIDES)


def raw_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(1, 1, "success", "2024-01-01T00:00:00Z", "2024-01-01T01:00:00Z"), (2, 1, "completed", "2024-01-01T00:00:00Z", "2024-01-02T01:00:00Z"), (3, 1, "failed", "2024-01-03T00:00:00Z", "2024-01-03T01:00:00Z")], "id long, repo_id long, status string, started_at string, finished_at string")


def raw_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select(F.col("l_orderkey").alias("cluster_id"), F.col("l_partkey").alias("thread_id"), F.col("l_discount").alias("score_to_representative"))


def raw_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = raw_members(spark, sf_dir).groupBy(F.col("cluster_id").alias("o_orderkey")).agg(F.count("*").alias("member_count"), F.min("thread_id").alias("representative_thread_id"))
    rows = read(spark, sf_dir, "orders").join(sizes, "o_orderkey")
    return rows.select(F.col("o_orderkey").alias("id"), F.lit(1).cast("long").alias("repo_id"), (1 + F.col("o_orderkey") % 2).alias("cluster_run_id"), "representative_thread_id", "member_count", F.date_format("o_orderdate", STAMP).alias("created_at"), F.lit(None).cast("string").alias("closed_at_local"), F.when(F.col("o_orderstatus") == "F", "closed").alias("close_reason_local"))


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id").distinct()
    return rows.select(F.col("conv_id").alias("id"), F.col("conv_id").alias("thread_id"), F.lit("2024-01-01T00:00:00Z").alias("created_at"))


def key_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").where("role = 'assistant'")
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("thread_revision_id"), F.when(F.col("turn") % 2 == 1, "llm_key_summary").otherwise("llm_key_3line").alias("summary_kind"), F.col("text").alias("key_text"), F.lpad(F.col("turn").cast("string"), 6, "0").alias("created_at"))


def repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "supplier")
    return rows.select(F.col("s_suppkey").alias("id"), F.lit("o").alias("owner"), F.col("s_name").alias("name"), F.concat(F.lit("o/"), "s_name").alias("full_name"), F.concat(F.lit("2024-01-"), F.lpad((1 + F.col("s_nationkey") % 28).cast("string"), 2, "0")).alias("updated_at"))
