"""Cluster lists and details, run history, status."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from skein.functions.keys import cluster_name
from skein.functions.text import snippet
from skein.operators.graph import components
from skein.operators.threads import is_open, limited, recency

LEAD_ROLES = ("canonical", "representative")
SUMMARY = ("id", "source", "stable_slug", "status", "title", "representative_thread_id", "representative_number", "representative_kind", "representative_title", "member_count", "updated_at", "closed_at")


def _or_empty(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def _is_closed(prefix: str = "") -> Column:
    return F.col(f"{prefix}closed_at_local").isNotNull() | (F.col(f"{prefix}state") != "open")


def with_representative(rows: DataFrame, threads: DataFrame) -> DataFrame:
    rep = threads.select(F.col("id").alias("rep_id"), F.col("number").alias("rep_number"), F.col("kind").alias("rep_kind"), F.col("title").alias("rep_title"))
    rows = rows.join(rep, F.col("representative_thread_id") == F.col("rep_id"), "left")
    return rows.withColumns({
        "representative_thread_id": F.coalesce("representative_thread_id", F.lit(0)),
        "representative_number": F.coalesce("rep_number", F.lit(0)),
        "representative_kind": _or_empty("rep_kind"),
        "representative_title": _or_empty("rep_title"),
    })


# Raw clusters of a run


def latest_run(runs: DataFrame, clusters: DataFrame, repo_id: int) -> int | None:
    """The last finished run that has clusters."""
    rows = runs.where((F.col("repo_id") == repo_id) & F.col("status").isin("completed", "success"))
    rows = rows.join(clusters.select("repo_id", F.col("cluster_run_id").alias("id")), ["repo_id", "id"], "left_semi")
    row = rows.orderBy(F.coalesce("finished_at", "started_at").desc(), F.desc("id")).select("id").first()
    return None if row is None else row["id"]


def run_members(clusters: DataFrame, members: DataFrame, threads: DataFrame) -> DataFrame:
    """Members of raw clusters with their threads, counted by cluster: latest, closed and open members."""
    own = threads.select(F.col("id").alias("thread_id"), "state", "closed_at_local", recency().alias("recent"))
    opened = (F.col("state") == "open") & F.col("closed_at_local").isNull()
    rows = members.select("cluster_id", "thread_id").join(clusters.select(F.col("id").alias("cluster_id")), "cluster_id", "left_semi").join(own, "thread_id")
    return rows.groupBy("cluster_id").agg(F.max("recent").alias("latest"), F.max(F.when(opened, F.col("recent"))).alias("latest_open"), F.count_if(_is_closed()).alias("closed_members"), F.count_if(opened).alias("open_members"))


def run_summaries(runs: DataFrame, clusters: DataFrame, members: DataFrame, threads: DataFrame, repo_id: int, include_closed: bool = True, min_size: int = 1, limit: int = 0, sort: str = "recent", words: Sequence[str] | None = None) -> DataFrame | None:
    """Summaries of the latest run's clusters; None without such a run."""
    run = latest_run(runs, clusters, repo_id)
    if run is None:
        return None
    own = clusters.where((F.col("repo_id") == repo_id) & (F.col("cluster_run_id") == run))
    rows = own.join(run_members(own, members, threads), F.col("id") == F.col("cluster_id")).where(F.col("member_count") >= max(1, min_size))
    if not include_closed:
        rows = rows.where(F.col("close_reason_local").isNull() & (F.col("closed_members") < F.col("member_count")))
    return _sorted_summaries(_run_columns(rows, threads, repo_id, F.col("latest"), words), sort, limit, sizes_by_id=True)


def _run_columns(rows: DataFrame, threads: DataFrame, repo_id: int, latest: Column, words: Sequence[str] | None) -> DataFrame:
    rows = rows.withColumns({"updated_at": F.coalesce(latest, "created_at"), "stable_slug": cluster_name(F.lit(repo_id), F.col("representative_thread_id"), F.col("id"), words)})
    status = F.when(F.col("close_reason_local").isNotNull() | (F.col("closed_members") >= F.col("member_count")), "closed").otherwise("active")
    rows = with_representative(rows, threads).withColumns({"source": F.lit("run_cluster"), "status": status, "title": F.lit(""), "closed_at": _or_empty("closed_at_local")})
    return rows.select(*SUMMARY)


def _sorted_summaries(rows: DataFrame, sort: str, limit: int, sizes_by_id: bool) -> DataFrame:
    """By one source's order (sizes_by_id), or by the order of merged lists."""
    count, updated = F.desc("member_count"), F.col("updated_at")
    if sizes_by_id:
        order = {"size": [count, "id"], "oldest": [updated.asc(), "id"]}.get(sort, [updated.desc(), F.desc("id")])
    else:
        order = {"size": [count, updated.desc(), "id"], "oldest": [updated.asc(), count, "id"]}.get(sort, [updated.desc(), count, "id"])
    return limited(rows.orderBy(*order), limit)


# Durable clusters


def active_primaries(groups: DataFrame, memberships: DataFrame) -> DataFrame:
    """(thread_id, repo_id, lead_of): active canonical and representative memberships of active clusters."""
    live = groups.where((F.col("status") == "active") & F.col("closed_at").isNull()).select(F.col("id").alias("lead_of"), "repo_id")
    led = memberships.where((F.col("state") == "active") & F.col("role").isin(*LEAD_ROLES)).select(F.col("cluster_id").alias("lead_of"), "thread_id")
    return led.join(live, "lead_of")


def visible_members(groups: DataFrame, memberships: DataFrame, threads: DataFrame) -> DataFrame:
    """Memberships, with repo_id of their cluster, that are shown: the thread is open, and the member leads its cluster or
    leads no other active cluster of the repository. Leads are counted by thread first, so no pair is joined."""
    led = active_primaries(groups, memberships).groupBy("thread_id", "repo_id").agg(F.count_distinct("lead_of").alias("leads"), F.min("lead_of").alias("one_lead"))
    rows = memberships.join(groups.select(F.col("id").alias("cluster_id"), "repo_id"), "cluster_id")
    rows = rows.join(threads.where(is_open()).select(F.col("id").alias("thread_id")), "thread_id", "left_semi")
    rows = rows.join(led, ["thread_id", "repo_id"], "left")
    elsewhere = (F.col("leads") > 1) | ((F.col("leads") == 1) & (F.col("one_lead") != F.col("cluster_id")))
    return rows.where(F.col("role").isin(*LEAD_ROLES) | ~F.coalesce(elsewhere, F.lit(False))).drop("leads", "one_lead")


def durable_summaries(groups: DataFrame, memberships: DataFrame, threads: DataFrame, repo_id: int, include_closed: bool = False, min_size: int = 1, limit: int = 0, sort: str = "recent") -> DataFrame:
    own = groups.where(F.col("repo_id") == repo_id)
    counted = memberships.where(F.col("state") == "active")
    if include_closed:
        counted = counted.join(threads.select(F.col("id").alias("thread_id")), "thread_id", "left_semi")
    else:
        own = own.where((F.col("status") == "active") & F.col("closed_at").isNull())
        counted = visible_members(groups, memberships, threads).where(F.col("state") == "active")
    counts = counted.groupBy(F.col("cluster_id").alias("of")).agg(F.count("*").alias("n"))
    rows = own.join(counts, F.col("id") == F.col("of"), "left").withColumn("member_count", F.coalesce("n", F.lit(0))).where(F.col("member_count") >= max(1, min_size))
    rows = with_representative(rows, threads).withColumns({"source": F.lit("durable_cluster"), "title": _or_empty("title"), "closed_at": _or_empty("closed_at"), "updated_at": _or_empty("updated_at")})
    return _sorted_summaries(rows.select(*SUMMARY), sort, limit, sizes_by_id=True)


def closed_candidates(groups: DataFrame, memberships: DataFrame, threads: DataFrame, closures: DataFrame, repo_id: int, min_size: int = 1) -> DataFrame:
    """Closed durable clusters with member_ids: closed by hand, by status, or because all counted members are closed."""
    own = threads.select(F.col("id").alias("thread_id"), recency().alias("recent"), _is_closed().alias("gone"))
    counted = memberships.where(F.col("state") != "removed_by_user").select("cluster_id", "thread_id").join(own, "thread_id")
    counted = counted.groupBy("cluster_id").agg(F.count("*").alias("member_count"), F.max("recent").alias("latest"), F.count_if("gone").alias("closed_members"), F.array_sort(F.collect_set("thread_id")).alias("member_ids"))
    closed = closures.select(F.col("cluster_id").alias("closed_of"), F.col("updated_at").alias("closure_at"))
    rows = groups.where(F.col("repo_id") == repo_id).join(counted, F.col("id") == F.col("cluster_id")).join(closed, F.col("id") == F.col("closed_of"), "left")
    over = F.col("closed_of").isNotNull() | F.col("status").isin("closed", "merged", "split") | (F.col("closed_members") >= F.col("member_count"))
    rows = rows.where((F.col("member_count") >= max(1, min_size)) & over)
    rows = with_representative(rows, threads).withColumns({"source": F.lit("durable_cluster"), "status": F.lit("closed"), "title": _or_empty("title"), "closed_at": _or_empty(F.coalesce("closure_at", "closed_at")), "updated_at": _or_empty("latest")})
    return rows.select(*SUMMARY, "member_ids")


def drop_overlapping(candidates: DataFrame, ratio: float = 0.8) -> DataFrame:
    """Candidates in order of size, recency and id, without those that share at least ratio of the smaller member set
    with one that stays.

    Overlaps are found by a join on members; clusters that overlap none stay, and the others are decided one connected
    component at a time, in order."""
    rows = candidates.select("id", "member_count", "updated_at", F.size("member_ids").alias("n"), F.explode("member_ids").alias("m"))
    other = rows.select(F.col("id").alias("id2"), F.col("n").alias("n2"), "m")
    shared = rows.join(other, "m").where("id < id2").groupBy("id", "id2", "n", "n2").agg(F.count("*").alias("shared"))
    close = shared.where(F.col("shared") >= F.lit(ratio) * F.least("n", "n2")).select("id", "id2")
    parts = components(close, "id", "id2")
    near = close.join(parts, F.col("id") == F.col("node")).select("component", "id", "id2")
    ranked = candidates.select(F.col("id").alias("node"), "member_count", "updated_at").join(parts, "node")
    edges = near.groupBy("component").agg(F.collect_list(F.struct("id", "id2")).alias("pairs"))
    listed = ranked.groupBy("component").agg(F.sort_array(F.collect_list(F.struct((-F.col("member_count")).alias("size"), F.col("updated_at").alias("at"), F.col("node").alias("id")))).alias("nodes")).join(edges, "component")

    def decide(batches):
        for pdf in batches:
            gone = []
            for nodes, pairs in zip(pdf["nodes"], pdf["pairs"], strict=True):
                near_to: dict[int, set[int]] = {}
                for p in pairs:
                    near_to.setdefault(p["id"], set()).add(p["id2"])
                    near_to.setdefault(p["id2"], set()).add(p["id"])
                kept: set[int] = set()
                order = sorted(sorted((n["id"], n["at"], n["size"]) for n in nodes), key=lambda n: n[1], reverse=True)
                for i, _, _ in sorted(order, key=lambda n: n[2]):
                    (gone.append(i) if near_to.get(i, set()) & kept else kept.add(i))
            yield pd.DataFrame({"gone": pd.Series(gone, dtype="int64")})

    dropped = listed.mapInPandas(decide, "gone long")
    return candidates.join(dropped, F.col("id") == F.col("gone"), "left_anti").drop("member_ids")


def display_summaries(runs: DataFrame, clusters: DataFrame, members: DataFrame, groups: DataFrame, memberships: DataFrame, threads: DataFrame, closures: DataFrame, repo_id: int, include_closed: bool = True, min_size: int = 1, limit: int = 0, sort: str = "recent", words: Sequence[str] | None = None) -> DataFrame:
    """The latest run's clusters; with closed ones also closed durable clusters whose representative isn't among them, sorted
    and limited anew. Without any cluster of a run the durable ones."""
    raw = run_summaries(runs, clusters, members, threads, repo_id, include_closed, min_size, limit, sort, words)
    if raw is None or raw.isEmpty():
        return durable_summaries(groups, memberships, threads, repo_id, include_closed, min_size, limit, sort)
    if not include_closed:
        return raw
    shown = raw.where("representative_thread_id <> 0").select(F.col("representative_thread_id").alias("shown"))
    closed = closed_candidates(groups, memberships, threads, closures, repo_id, min_size)
    closed = drop_overlapping(closed.join(shown, F.col("representative_thread_id") == F.col("shown"), "left_anti"))
    return _sorted_summaries(raw.unionByName(closed), sort, limit, sizes_by_id=False)


def role_rank() -> Column:
    return F.when(F.col("role") == "canonical", 0).when(F.col("role") == "representative", 1).otherwise(2)


def _members(rows: DataFrame, body_chars: int) -> DataFrame:
    return rows.select("role", F.col("member_state").alias("state"), "score_to_representative", "thread_id", "number", "kind", F.col("state").alias("thread_state"), F.col("title"), snippet(_or_empty("body"), body_chars).alias("body_snippet"))


def durable_detail(groups: DataFrame, memberships: DataFrame, threads: DataFrame, cluster_id: int, include_closed: bool = False, limit: int = 20, body_chars: int = 280) -> DataFrame:
    """Members of a durable cluster: leads first, then by score and number."""
    rows = memberships.where(F.col("cluster_id") == cluster_id)
    if not include_closed:
        rows = visible_members(groups, memberships, threads).where((F.col("cluster_id") == cluster_id) & (F.col("state") == "active"))
    rows = rows.select("role", F.col("state").alias("member_state"), "score_to_representative", "thread_id").join(threads.withColumnRenamed("id", "thread_id"), "thread_id")
    return _members(limited(rows.orderBy(role_rank(), F.coalesce("score_to_representative", F.lit(0.0)).desc(), "number", "thread_id"), limit, 20), body_chars)


def run_detail(clusters: DataFrame, members: DataFrame, threads: DataFrame, cluster_id: int, run_id: int, include_closed: bool = False, limit: int = 20, body_chars: int = 280) -> DataFrame:
    """Members of a raw cluster: the representative, then by score, issues first, by recency and number."""
    own = clusters.where((F.col("id") == cluster_id) & (F.col("cluster_run_id") == run_id)).select(F.col("id").alias("cluster_id"), "representative_thread_id")
    rows = members.join(own, "cluster_id").join(threads.withColumnRenamed("id", "thread_id"), "thread_id")
    if not include_closed:
        rows = rows.where(is_open())
    leads = F.col("thread_id").eqNullSafe(F.col("representative_thread_id"))
    rows = rows.withColumns({"role": F.when(leads, "representative").otherwise("member"), "member_state": F.lit("active")})
    order = [F.when(leads, 0).otherwise(1), F.coalesce("score_to_representative", F.lit(0.0)).desc(), F.when(F.col("kind") == "issue", 0).otherwise(1), recency().desc(), F.desc("number")]
    return _members(limited(rows.orderBy(*order), limit, 20), body_chars)


def durable_summary_by_id(groups: DataFrame, memberships: DataFrame, threads: DataFrame, closures: DataFrame, repo_id: int, cluster_id: int, include_closed: bool = False) -> DataFrame:
    """One durable cluster. With closed ones included, one whose active members are all closed is closed."""
    own = groups.where((F.col("repo_id") == repo_id) & (F.col("id") == cluster_id))
    if include_closed:
        side = threads.select(F.col("id").alias("thread_id"), _is_closed().alias("gone"))
        counted = memberships.where((F.col("cluster_id") == cluster_id) & (F.col("state") == "active")).join(side, "thread_id", "left")
        counts = counted.groupBy(F.col("cluster_id").alias("of")).agg(F.count("*").alias("n"), F.count_if("gone").alias("closed_members"))
    else:
        own = own.where((F.col("status") == "active") & F.col("closed_at").isNull())
        counted = visible_members(groups, memberships, threads).where((F.col("cluster_id") == cluster_id) & (F.col("state") == "active"))
        counts = counted.groupBy(F.col("cluster_id").alias("of")).agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("closed_members"))
    closed = closures.select(F.col("cluster_id").alias("closed_of"), F.col("updated_at").alias("closure_at"))
    rows = own.join(counts, F.col("id") == F.col("of"), "left").join(closed, F.col("id") == F.col("closed_of"), "left")
    rows = rows.withColumn("member_count", F.coalesce("n", F.lit(0)))
    status = F.when((F.col("status") == "active") & (F.col("member_count") > 0) & (F.col("closed_members") >= F.col("member_count")), "closed").otherwise(F.col("status"))
    rows = with_representative(rows, threads).withColumns({"source": F.lit("durable_cluster"), "status": status, "title": _or_empty("title"), "closed_at": _or_empty(F.coalesce("closure_at", "closed_at"))})
    return rows.select(*SUMMARY)


def run_summary_by_id(runs: DataFrame, clusters: DataFrame, members: DataFrame, threads: DataFrame, repo_id: int, cluster_id: int, include_closed: bool = False, words: Sequence[str] | None = None) -> DataFrame | None:
    """One raw cluster; without closed ones its open members are counted, not the stored number."""
    run = latest_run(runs, clusters, repo_id)
    if run is None:
        return None
    own = clusters.where((F.col("repo_id") == repo_id) & (F.col("cluster_run_id") == run) & (F.col("id") == cluster_id))
    rows = own.join(run_members(own, members, threads), F.col("id") == F.col("cluster_id"))
    latest = F.col("latest")
    if not include_closed:
        rows = rows.withColumn("member_count", F.col("open_members")).where((F.col("member_count") > 0) & F.col("close_reason_local").isNull())
        latest = F.col("latest_open")
    return _run_columns(rows, threads, repo_id, latest, words)


def cluster_of_thread(groups: DataFrame, memberships: DataFrame, threads: DataFrame, repo_id: int, include_closed: bool = False) -> DataFrame:
    """(number, cluster_id): for every thread of the repository the cluster that it is looked up in."""
    rows = memberships.join(groups.select(F.col("id").alias("cluster_id"), F.col("repo_id").alias("group_repo"), "status", F.col("closed_at"), F.col("updated_at").alias("group_at")), "cluster_id")
    if not include_closed:
        shown = visible_members(groups, memberships, threads).select("cluster_id", "thread_id")
        rows = rows.where((F.col("state") == "active") & (F.col("status") == "active") & F.col("closed_at").isNull()).join(shown, ["cluster_id", "thread_id"], "left_semi")
    rows = rows.join(threads.where(F.col("repo_id") == repo_id).select(F.col("id").alias("thread_id"), "number"), "thread_id")
    active = lambda c: F.when(F.col(c) == "active", 0).otherwise(1)
    first = Window.partitionBy("number").orderBy(active("state"), active("status"), role_rank(), _or_empty("group_at").desc(), F.desc("cluster_id"))
    return rows.withColumn("nth", F.row_number().over(first)).where("nth = 1").select("number", "cluster_id")


def member_summaries(threads: DataFrame, document_summaries: DataFrame, revisions: DataFrame, key_summaries: DataFrame) -> DataFrame:
    """(thread_id, summaries): a map by kind; document summaries come before key summaries, newer before older."""
    keyed = key_summaries.join(revisions.select(F.col("id").alias("thread_revision_id"), "thread_id"), "thread_revision_id").select("thread_id", "summary_kind", F.col("key_text").alias("text"), F.lit(1).alias("source"), F.col("created_at").alias("at"), "id")
    rows = document_summaries.select("thread_id", "summary_kind", F.col("summary_text").alias("text"), F.lit(0).alias("source"), F.col("updated_at").alias("at"), "id").unionByName(keyed)
    rows = rows.join(threads.select(F.col("id").alias("thread_id")), "thread_id", "left_semi")
    first = Window.partitionBy("thread_id", "summary_kind").orderBy("source", F.desc("at"), F.desc("id"))
    rows = rows.withColumn("nth", F.row_number().over(first)).where("nth = 1")
    return rows.groupBy("thread_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("summary_kind", "text")))).alias("summaries"))


# Runs, repositories, status


def list_runs(runs: DataFrame, repo_id: int, kind: str, limit: int = 20) -> DataFrame:
    if kind not in ("sync", "summary", "embedding", "cluster"):
        raise ValueError(f"unknown run kind {kind!r}")
    rows = runs.where((F.col("kind") == kind) & (F.col("repo_id") == repo_id)).orderBy(F.desc("id"))
    return limited(rows, limit, 20).select("id", "kind", "repo_id", "scope", "status", "started_at", *(_or_empty(c).alias(c) for c in ("finished_at", "stats_json", "error_text")))


def last_sync(runs: DataFrame) -> DataFrame:
    """(repo_id, last_sync_at) of successful synchronisations, the largest as text."""
    done = runs.where((F.col("kind") == "sync") & F.col("status").isin("success", "completed"))
    return done.groupBy("repo_id").agg(_or_empty(F.max("finished_at")).alias("last_sync_at"))


def list_repositories(repositories: DataFrame, limit: int = 0) -> DataFrame:
    return limited(repositories.orderBy(F.desc("updated_at"), F.desc("id")), limit)


def status(repositories: DataFrame, threads: DataFrame, groups: DataFrame, runs: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """One row of counts and the last sync; without a successful one, when the store was exported."""
    parts = [
        repositories.agg(F.count("*").alias("repository_count")),
        threads.agg(F.count("*").alias("thread_count"), F.count_if(is_open()).alias("open_thread_count")),
        groups.agg(F.count("*").alias("cluster_count")),
        runs.where((F.col("kind") == "sync") & F.col("status").isin("success", "completed")).agg(F.max("finished_at").alias("synced")),
    ]
    if metadata is not None:
        parts.append(metadata.where("key = 'exported_at'").agg(F.max("value").alias("exported")))
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(part)  # one row each
    last = [F.nullif("synced", F.lit("")), *([F.nullif("exported", F.lit(""))] if metadata is not None else [])]
    return out.select("repository_count", "thread_count", "open_thread_count", "cluster_count", F.coalesce(*last, F.lit("")).alias("last_sync_at"))


# Browser


def filter_clusters(summaries: DataFrame, query: str = "", min_size: int = 1, show_closed: bool = False) -> DataFrame:
    rows = summaries.where(F.col("member_count") >= min_size)
    if not show_closed:
        rows = rows.where((F.col("status") == "active") & (F.col("closed_at") == ""))
    if needle := query.strip().lower():
        rows = rows.where(F.contains(F.lower(F.concat_ws(" ", "stable_slug", "title", "representative_title", "representative_kind")), F.lit(needle)))
    return rows


def relaxed_clusters(summaries: DataFrame, query: str = "", min_size: int = 1, show_closed: bool = False) -> DataFrame:
    """filter_clusters; if nothing is left, closed ones and all sizes are shown."""
    rows = filter_clusters(summaries, query, min_size, show_closed)
    return filter_clusters(summaries, query, 1, True) if rows.isEmpty() else rows


def sort_clusters(summaries: DataFrame, sort: str = "recent") -> DataFrame:
    """Order of the browser: timestamps are compared as times, and equal ones keep the order of position."""
    at = F.try_to_timestamp(F.col("updated_at"))
    order = {"size": [F.desc("member_count"), at.desc_nulls_last()], "oldest": [at.asc_nulls_first(), "id"]}.get(sort, [at.desc_nulls_last()])
    return summaries.orderBy(*order, "position")


def sort_members(members: DataFrame, mode: str = "kind") -> DataFrame:
    at = F.try_to_timestamp(F.col("updated_at_gh"))
    orders = {"recent": [at.desc_nulls_last()], "oldest": [at.asc_nulls_first()], "number": ["number"], "state": [F.desc("state"), "number"], "title": [F.lower("title")]}
    return members.orderBy(*orders.get(mode, ["kind", "number"]), "id")


def merge_working_set(first: DataFrame, second: DataFrame, limit: int = 500) -> DataFrame:
    """first, then what second has besides by (source, id), in order of position."""
    rest = second.join(first, ["source", "id"], "left_anti")
    rows = first.withColumn("_list", F.lit(0)).unionByName(rest.withColumn("_list", F.lit(1)))
    return limited(rows.orderBy("_list", "position"), limit).drop("_list")


def kind_counts(members: DataFrame) -> DataFrame:
    return members.agg(F.count_if(F.col("kind") == "issue").alias("issues"), F.count_if(F.col("kind") == "pull_request").alias("pulls"), F.count_if(~F.col("kind").isin("issue", "pull_request")).alias("others"))


def list_signature(summaries: DataFrame) -> DataFrame:
    """One text that changes when a list does: id:count:updated by position."""
    one = F.concat_ws(":", F.col("id").cast("string"), F.col("member_count").cast("string"), "updated_at")
    return summaries.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", one.alias("t")))), lambda s: s["t"]), "|").alias("signature"))
