"""Rows of the issue tracker's interface as threads and comments, and their merge into the store."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from skein.functions.keys import content_hash
from skein.operators.numbering import numbered
from skein.schemas import COMMENTS, THREADS, conform

#: What a merge of threads keeps of the old row: when it was first pulled, and that it was closed locally.
KEPT_ON_UPSERT = ("id", "first_pulled_at", "closed_at_local", "close_reason_local")


def compact_json(value: object) -> str:
    """JSON with sorted keys and without spaces, with <, > and & escaped."""
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    for c in "<>&  ":
        text = text.replace(c, f"\\u{ord(c):04x}")
    return text


def _text(value: object) -> str:
    return value if isinstance(value, str) else ""


def _id(value: object) -> str:
    return str(value) if isinstance(value, int) and not isinstance(value, bool) else str(int(value)) if isinstance(value, float) else _text(value)


def _row(raw: str | None) -> dict | None:
    """The object of a JSON text, or None."""
    try:
        value = json.loads(raw or "")
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def _parse_issue(raw: str | None) -> dict:
    row = _row(raw)
    if row is None:
        return dict.fromkeys(ISSUE.fieldNames())
    user = row.get("user") if isinstance(row.get("user"), dict) else {}
    return {
        "github_id": _id(row.get("id")), "number": int(row.get("number") or 0), "kind": "pull_request" if "pull_request" in row else "issue", "state": _text(row.get("state")), "title": _text(row.get("title")),
        "body": _text(row.get("body")), "author_login": _text(user.get("login")), "author_type": _text(user.get("type")), "html_url": _text(row.get("html_url")),
        "labels_json": compact_json(row["labels"]) if row.get("labels") is not None else "[]", "assignees_json": compact_json(row["assignees"]) if row.get("assignees") is not None else "[]", "raw_json": compact_json(row),
        "created_at_gh": _text(row.get("created_at")), "updated_at_gh": _text(row.get("updated_at")), "closed_at_gh": _text(row.get("closed_at")),
    }


ISSUE = T.StructType([T.StructField(n, T.LongType() if n == "number" else T.StringType()) for n in _parse_issue("{}")])


@F.pandas_udf(ISSUE)
def parse_issues(raw: pd.Series) -> pd.DataFrame:
    out = pd.DataFrame([_parse_issue(r) for r in raw], columns=ISSUE.fieldNames(), dtype=object)
    return out.astype({"number": "Int64"})


def threads_from_api(rows: DataFrame, repo_id: int, pulled_at: str, json_column: str = "raw", order: Column | None = None) -> DataFrame:
    """Threads of JSON rows; rows that are no JSON object are left out. A row is a pull request if it has the key
    pull_request, even with null; drafts and merges are not told by these rows. order: the place of a row among others,
    from which _order is made: by updated_at_gh, then place."""
    parsed = rows.select(parse_issues(F.col(json_column)).alias("t"), (F.lit(0) if order is None else order).alias("_place"))
    parsed = parsed.where("t.state is not null").select("t.*", "_place")
    parsed = parsed.withColumns({"repo_id": F.lit(repo_id).cast("long"), "is_draft": F.lit(False), "content_hash": content_hash(F.col("title"), F.col("body"), F.col("labels_json"))})
    parsed = parsed.withColumns({c: F.lit(pulled_at) for c in ("first_pulled_at", "last_pulled_at", "updated_at")})
    blank = ("body", "author_login", "author_type", "created_at_gh", "updated_at_gh", "closed_at_gh")
    parsed = parsed.withColumns({c: F.nullif(c, F.lit("")) for c in blank})
    if order is None:
        return conform(parsed, THREADS)
    return conform(parsed.withColumn("_order", F.struct("updated_at_gh", "_place")), T.StructType([*THREADS.fields, T.StructField("_order", parsed.select(F.struct("updated_at_gh", "_place").alias("o")).schema["o"].dataType)]))


def is_bot(login: Column, kind: Column) -> Column:
    return F.coalesce((F.lower(kind) == "bot") | F.lower(login).endswith("[bot]"), F.lit(False))


COMMENT = T.StructType([T.StructField(n, T.StringType()) for n in ("github_id", "author_login", "author_type", "body", "raw_json", "created_at_gh", "updated_at_gh")])


@F.pandas_udf(COMMENT)
def parse_comments(raw: pd.Series) -> pd.DataFrame:
    out = []
    for text in raw:
        if (row := _row(text)) is None:
            out.append((None,) * len(COMMENT.fields))
            continue
        user = row.get("user") if isinstance(row.get("user"), dict) else {}
        out.append((_id(row.get("id")), _text(user.get("login")), _text(user.get("type")), _text(row.get("body")), compact_json(row), _text(row.get("created_at")), _text(row.get("updated_at"))))
    return pd.DataFrame(out, columns=COMMENT.fieldNames())


def comments_from_api(rows: DataFrame, comment_type: str, json_column: str = "raw") -> DataFrame:
    """Comments of JSON rows (thread_id, raw) of one kind; those with an empty body, and rows that are no JSON object, are
    left out."""
    parsed = rows.select("thread_id", parse_comments(F.col(json_column)).alias("c")).select("thread_id", "c.*")
    parsed = parsed.where(F.col("body") != "").withColumns({"comment_type": F.lit(comment_type), "is_bot": is_bot(F.col("author_login"), F.col("author_type"))})
    return conform(parsed, COMMENTS)


#: The kinds of comments in the order in which a thread's are listed.
COMMENT_TYPES = ("issue_comment", "pull_review", "pull_review_comment")


def thread_comments(rows: DataFrame, json_column: str = "raw") -> DataFrame:
    """Comments of JSON rows (thread_id, comment_type, page, place, raw) of all three kinds as one table, with ordinal:
    from 0 for each thread, by kind, page and place. Reviews and their comments are those of pull requests only."""
    parsed = rows.select("thread_id", "comment_type", "page", "place", parse_comments(F.col(json_column)).alias("c")).select("thread_id", "comment_type", "page", "place", "c.*")
    parsed = parsed.where(F.col("comment_type").isin(*COMMENT_TYPES) & (F.col("body") != ""))
    rank = F.array_position(F.array(*map(F.lit, COMMENT_TYPES)), F.col("comment_type"))
    listed = Window.partitionBy("thread_id").orderBy(rank, "page", "place", "github_id")
    parsed = parsed.withColumns({"ordinal": F.row_number().over(listed).cast("long") - 1, "is_bot": is_bot(F.col("author_login"), F.col("author_type"))})
    return conform(parsed, T.StructType([*COMMENTS.fields, T.StructField("ordinal", T.LongType())]))


def last_of_key(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last row of each key: by _order if there is that column (which goes), else by updated_at_gh and updated_at
    where there are; rows that are equal so far by a hash, so that reruns agree."""
    order = [c for c in (("_order",) if "_order" in rows.columns else ("updated_at_gh", "updated_at")) if c in rows.columns]
    names = [c for c in rows.columns if c != "_order"]
    last = Window.partitionBy(*keys).orderBy(*(F.col(c).desc_nulls_last() for c in order), F.xxhash64(*names))
    return rows.withColumn("_nth", F.row_number().over(last)).where("_nth = 1").select(*names)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], kept: Sequence[str] = ()) -> DataFrame:
    """old with rows of new in place of those of equal key; of new rows of one key the last counts (last_of_key). Columns
    in kept keep the old row's value where it has one."""
    new = last_of_key(new.select(*old.columns, *(c for c in new.columns if c == "_order")), keys)
    names = [c for c in old.columns if c not in keys]
    both = old.select(*keys, F.struct(*names).alias("o")).join(new.select(*keys, F.struct(*names).alias("n")), list(keys), "full")
    value = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")) if c in kept else F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return both.select(*(F.col(c) if c in keys else value(c).alias(c) for c in old.columns))


THREAD_KEY, COMMENT_KEY = ("repo_id", "kind", "number"), ("thread_id", "comment_type", "github_id")


def upsert_threads(old: DataFrame, new: DataFrame) -> DataFrame:
    """Merge by repository, kind and number. Threads that are new get ids above the old ones; only these are numbered."""
    last = old.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    known = upsert(old, new.join(old.select(*THREAD_KEY), list(THREAD_KEY), "left_semi"), THREAD_KEY, KEPT_ON_UPSERT)
    fresh = last_of_key(new.join(old.select(*THREAD_KEY), list(THREAD_KEY), "left_anti"), THREAD_KEY)
    return known.unionByName(numbered(fresh, THREAD_KEY, "id", last).select(*old.columns))


def upsert_repositories(old: DataFrame, new: DataFrame) -> DataFrame:
    """Merge by full name; an old repository keeps its id, a new one gets the next."""
    last = old.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    known = upsert(old, new.join(old.select("full_name"), "full_name", "left_semi"), ("full_name",), ("id",))
    fresh = last_of_key(new.join(old.select("full_name"), "full_name", "left_anti"), ("full_name",))
    return known.unionByName(numbered(fresh, ("full_name",), "id", last).select(*old.columns))


VECTOR_KEY = ("thread_id", "basis", "model")


def upsert_vectors(old: DataFrame, new: DataFrame) -> DataFrame:
    """Merge by thread, basis and model; an old vector keeps when it was created."""
    return upsert(old, new, VECTOR_KEY, ("created_at",))


def reconcile_closed(old: DataFrame, closed: DataFrame) -> DataFrame:
    """old with rows of closed (by repository, kind, number; of several the last) taken over where the old thread is open
    and not closed locally; others stay."""
    fixed = (*THREAD_KEY, *KEPT_ON_UPSERT)
    names = [c for c in old.columns if c not in fixed]
    new = last_of_key(closed, THREAD_KEY).select(*THREAD_KEY, F.struct(*names).alias("_n"))
    rows = old.join(new, list(THREAD_KEY), "left")
    hit = F.col("_n").isNotNull() & (F.col("state") == "open") & F.col("closed_at_local").isNull()
    state = F.coalesce(F.nullif("_n.state", F.lit("")), F.lit("closed"))
    return rows.select(*(F.when(hit, state if c == "state" else F.col(f"_n.{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in old.columns))


def sync_threads(old: DataFrame, new: DataFrame) -> DataFrame:
    """old after a batch of versions of threads: the last version of each (last_of_key) counts; open ones are merged,
    closed ones taken over where the old thread is open."""
    last = last_of_key(new, THREAD_KEY)
    return reconcile_closed(upsert_threads(old, last.where("state = 'open'")), last.where("state <> 'open'"))


def sync_stats(threads: DataFrame, comments: DataFrame, closed: DataFrame) -> DataFrame:
    """One row of counters of a synchronisation."""
    rows = threads.agg(F.count("*").alias("threads_synced"), F.count_if(F.col("kind") == "issue").alias("issues_synced"), F.count_if(F.col("kind") == "pull_request").alias("pull_requests_synced"))
    return rows.crossJoin(comments.agg(F.count("*").alias("comments_synced"))).crossJoin(closed.agg(F.count("*").alias("threads_closed")))
