"""Derived documents and the queue of texts to embed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from skein.functions.keys import EMBEDDING_RUNES, embedding_hash
from skein.functions.text import label_names, normalize_dedupe, present, trim_space
from skein.operators.threads import is_open, recency


def build_documents(threads: DataFrame, comments: DataFrame) -> DataFrame:
    """thread_id, title, body, raw_text, dedupe_text, updated_at of each thread, from its title, body, labels and the
    comments (thread_id, ordinal, author_login, body, is_bot) of people, in order of ordinal."""
    said = comments.where(~F.coalesce("is_bot", F.lit(False)))
    one = F.struct("ordinal", F.coalesce("author_login", F.lit("")).alias("login"), F.coalesce("body", F.lit("")).alias("said"))
    talk = said.groupBy(F.col("thread_id").alias("talk_id")).agg(F.array_sort(F.collect_list(one)).alias("talk"))
    rows = threads.join(talk, F.col("id") == F.col("talk_id"), "left")
    rows = rows.withColumns({"talk": F.coalesce("talk", F.array().cast(talk.schema["talk"].dataType)), "body": F.coalesce("body", F.lit("")), "labels": label_names(F.col("labels_json"))})
    lines = F.transform(F.filter("talk", lambda c: present(c["said"])), lambda c: F.concat(c["login"], F.lit(": "), trim_space(c["said"])))
    sections = F.concat(
        F.array(F.concat(F.lit("# "), F.col("title"))),
        F.when(present(F.col("body")), F.array(trim_space(F.col("body")))).otherwise(F.array().cast("array<string>")),
        F.when(F.size("labels") > 0, F.array(F.concat(F.lit("Labels: "), F.array_join("labels", ", ")))).otherwise(F.array().cast("array<string>")),
        lines,
    )
    parts = F.concat(F.array("title", "body", F.array_join("labels", " ")), F.transform("talk", lambda c: c["said"]))
    return rows.select(
        F.col("id").alias("thread_id"), "title", "body", F.array_join(sections, "\n\n").alias("raw_text"), normalize_dedupe(F.array_join(parts, " ")).alias("dedupe_text"), "updated_at"
    )


KEY_SUMMARIES = ("llm_key_summary", "llm_key_3line")


def latest_key_summaries(revisions: DataFrame, summaries: DataFrame) -> DataFrame:
    """(thread_id, key_text): the newest key summary of each thread."""
    own = summaries.where(F.col("summary_kind").isin(*KEY_SUMMARIES)).select(F.col("id").alias("summary_id"), "thread_revision_id", "key_text", F.col("created_at").alias("summary_at"))
    rows = own.join(revisions.select(F.col("id").alias("thread_revision_id"), "thread_id", F.col("created_at").alias("revision_at")), "thread_revision_id")
    newest = Window.partitionBy("thread_id").orderBy(F.desc("summary_at"), F.desc("revision_at"), F.desc("summary_id"))
    return rows.withColumn("nth", F.row_number().over(newest)).where("nth = 1").select("thread_id", "key_text")


def embedding_text(basis: str, title: Column, body: Column, raw_text: Column, dedupe_text: Column, key_summary: Column) -> Column:
    """What is embedded on a basis; '' where there is nothing."""
    if basis in ("", "title_original"):
        rest = F.when(present(body), trim_space(body)).when(present(raw_text), trim_space(raw_text))
        return trim_space(F.concat_ws("\n\n", trim_space(title), rest))
    if basis == "dedupe_text":
        return trim_space(dedupe_text)
    if basis == "llm_key_summary":
        filled = F.concat(F.lit("title: "), trim_space(title), F.lit("\n\nkey_summary:\n"), trim_space(key_summary))
        return F.when(present(key_summary), trim_space(filled)).otherwise("")
    raise ValueError(f"embedding basis {basis!r} is not supported")


def embedding_tasks(
    threads: DataFrame, documents: DataFrame, vectors: DataFrame, key_summaries: DataFrame, repo_id: int, basis: str = "title_original", model: str = "", number: int = 0, limit: int = 0, force: bool = False, include_closed: bool = False
) -> DataFrame:
    """Threads whose text changed since their vector was made, newest first. The limit comes before unchanged ones are
    left out, so fewer than limit tasks may come out."""
    basis = basis.strip() or "title_original"
    rows = threads.where(F.col("repo_id") == repo_id)
    if not include_closed:
        rows = rows.where(is_open())
    if number > 0:
        rows = rows.where(F.col("number") == number)
    rows = rows.withColumn("recency", recency())
    if limit > 0:
        rows = rows.orderBy(F.desc("recency"), F.desc("number")).limit(limit)
    docs = documents.select(F.col("thread_id").alias("doc_of"), F.col("body").alias("doc_body"), "raw_text", "dedupe_text")
    made = vectors.where((F.col("basis") == basis) & (F.col("model") == model)).select(F.col("thread_id").alias("made_for"), F.col("content_hash").alias("made_hash"))
    rows = rows.join(docs, F.col("id") == F.col("doc_of"), "left").join(made, F.col("id") == F.col("made_for"), "left")
    rows = rows.join(key_summaries.select(F.col("thread_id").alias("summary_of"), "key_text"), F.col("id") == F.col("summary_of"), "left")
    body, empty = F.coalesce("body", F.lit("")), F.lit("")
    whole = embedding_text(basis, F.col("title"), F.coalesce("doc_body", body), F.coalesce("raw_text", body), F.coalesce("dedupe_text", F.concat("title", F.lit(" "), body)), F.coalesce("key_text", empty))
    rows = rows.withColumn("whole", whole).where(F.col("whole") != "")
    rows = rows.withColumns({"text": F.substring("whole", 1, EMBEDDING_RUNES), "original_text_runes": F.length("whole").cast("long")})
    rows = rows.withColumns({"content_hash": embedding_hash(basis, model, F.col("text")), "text_runes": F.length("text").cast("long"), "text_truncated": F.col("original_text_runes") > EMBEDDING_RUNES})
    if not force:
        rows = rows.where(F.coalesce("made_hash", empty) != F.col("content_hash"))
    out = rows.select(F.col("id").alias("thread_id"), "number", "kind", "title", "text", "content_hash", "text_truncated", "original_text_runes", "text_runes", "recency")
    return out.orderBy(F.desc("recency"), F.desc("number")).drop("recency")


def embed_outcome(tasks: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row: selected, embedded, failed, truncated and the run's status, from (thread_id, ok)."""
    rows = tasks.join(outcomes, "thread_id", "left").agg(
        F.count("*").alias("selected"), F.count_if("ok").alias("embedded"), F.count_if(~F.coalesce("ok", F.lit(False))).alias("failed"), F.count_if("text_truncated").alias("truncated")
    )
    status = F.when(F.col("failed") == 0, "success").when(F.col("embedded") > 0, "partial").otherwise("error")
    return rows.withColumn("status", status)
