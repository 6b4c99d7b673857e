"""Operators that join others to what a user asks for in one call."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, functions as F

from skein.operators import reports
from skein.operators.reports import filter_clusters
from skein.schemas import RUNS, conform
from skein.sources.arguments import is_stale

RUN_KINDS = ("sync", "summary", "embedding", "cluster")


# Run records


def run_scope(state: str, numbers: Sequence[int] = ()) -> str:
    """What a synchronisation covers: a state, or the threads named."""
    return f"numbers:{','.join(map(str, numbers))}" if numbers else state


def expected_total(open_count: int, state: str, since: str = "", limit: int = 0) -> int:
    """How many rows a synchronisation should list, by the repository's own count; 0: not known."""
    if state != "open" or since or open_count <= 0:
        return 0
    return min(limit, open_count) if limit > 0 else open_count


def record_run(runs: DataFrame, kind: str, repo_id: int, scope: str, status: str, started_at: str, finished_at: str = "", stats: object = None, error: str = "") -> DataFrame:
    """runs with one more; its id is the next of its kind."""
    if kind not in RUN_KINDS:
        raise ValueError(f"unknown run kind {kind!r}")
    values = {"kind": kind, "repo_id": repo_id, "scope": scope, "status": status, "started_at": started_at, "finished_at": finished_at or None, "stats_json": None if stats is None else json.dumps(stats), "error_text": error or None}
    one = runs.agg((F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("id"))), F.lit(0)) + 1).alias("id"))
    return conform(runs, RUNS).unionByName(conform(one.select("id", *(F.lit(v).alias(c) for c, v in values.items())), RUNS))


# Refresh


def refresh(sync: Callable[[], object] | None = None, embed: Callable[[], object] | None = None, cluster: Callable[[], object] | None = None) -> dict[str, object]:
    """Runs the stages that are given, in this order, and tells which were selected and what each returned; a stage that
    fails ends it. At least one is needed."""
    stages = {"sync": sync, "embed": embed, "cluster": cluster}
    if not any(stages.values()):
        raise ValueError("a refresh needs at least one stage")
    out: dict[str, object] = {"selected": {name: stage is not None for name, stage in stages.items()}}
    return out | {name: stage() for name, stage in stages.items() if stage is not None}


def searched_fresh(last_sync: str, max_age: timedelta, now: datetime, sync: Callable[[], object], search: Callable[[], DataFrame]) -> DataFrame:
    """A search, after a synchronisation if the last one is missing or older than max_age."""
    if is_stale(last_sync, max_age, now):
        sync()
    return search()


# Details and jumps


@dataclass(frozen=True)
class Tables:
    """What cluster lookups read."""

    runs: DataFrame
    clusters: DataFrame
    members: DataFrame
    groups: DataFrame
    memberships: DataFrame
    closures: DataFrame
    threads: DataFrame


def cluster_detail(tables: Tables, repo_id: int, cluster_id: int, include_closed: bool = False, limit: int = 20, body_chars: int = 280) -> tuple[DataFrame, DataFrame]:
    """The summary and the members of a cluster: the latest run's, or else the durable one of that id; LookupError if there
    is neither."""
    t = tables
    raw = reports.run_summary_by_id(t.runs, t.clusters, t.members, t.threads, repo_id, cluster_id, include_closed)
    if raw is not None and not raw.isEmpty():
        run = reports.latest_run(t.runs, t.clusters, repo_id)
        return raw, reports.run_detail(t.clusters, t.members, t.threads, cluster_id, run, include_closed, limit, body_chars)
    durable = reports.durable_summary_by_id(t.groups, t.memberships, t.threads, t.closures, repo_id, cluster_id, include_closed)
    if durable.isEmpty():
        raise LookupError(f"cluster {cluster_id} was not found")
    return durable, reports.durable_detail(t.groups, t.memberships, t.threads, cluster_id, include_closed, limit, body_chars)


@dataclass(frozen=True)
class View:
    """The browser's filters, and its limit of clusters (0: none)."""

    query: str = ""
    min_size: int = 1
    show_closed: bool = False
    limit: int = 0


@dataclass(frozen=True)
class Jump:
    cluster_id: int
    clusters: DataFrame
    view: View
    has_member: bool


def jump(tables: Tables, repo_id: int, number: int, loaded: DataFrame, view: View, detail_limit: int = 200) -> Jump:
    """To the cluster of a thread's number: one among those loaded that it represents, or the one that it is looked up in,
    which then joins them. Filters that hide the cluster are relaxed. LookupError if the thread is in no cluster."""
    if number <= 0:
        raise ValueError("a positive number is needed")
    row = loaded.where(F.col("representative_number") == number).orderBy("position").select("id").first()
    if row is None:
        found = reports.cluster_of_thread(tables.groups, tables.memberships, tables.threads, repo_id, include_closed=True)
        row = found.where(F.col("number") == number).select(F.col("cluster_id").alias("id")).first()
        if row is None:
            raise LookupError(f"thread #{number} is in no cluster")
    own = row["id"]
    summary, members = cluster_detail(tables, repo_id, own, include_closed=True, limit=detail_limit, body_chars=1600)
    if loaded.where(F.col("id") == own).isEmpty():
        last = loaded.agg(F.coalesce(F.max("position"), F.lit(-1)) + 1).first()[0]
        loaded = loaded.unionByName(summary.withColumn("position", F.lit(last).cast(loaded.schema["position"].dataType)), allowMissingColumns=True)
    shown = lambda v: filter_clusters(loaded, v.query, v.min_size, v.show_closed)
    if shown(view).where(F.col("id") == own).isEmpty():
        one = loaded.where(F.col("id") == own).first()
        view = replace(view, query="", min_size=1 if view.min_size > one["member_count"] else view.min_size, show_closed=view.show_closed or one["status"] != "active" or bool(one["closed_at"]), limit=max(view.limit, loaded.count()) if view.limit else 0)
    return Jump(own, shown(view), view, not members.where(F.col("number") == number).isEmpty())


def require_durable(source: str) -> None:
    """Clusters of a run can't be governed; PermissionError for them."""
    if source not in ("", "durable_cluster"):
        raise PermissionError("only durable clusters can be changed")


# Output


def output(title: str, payload: object, form: str = "text") -> str:
    """A payload (or the rows of a short DataFrame) as json, text (the title, then JSON) or log (one line)."""
    value = [row.asDict(recursive=True) for row in payload.toLocalIterator()] if isinstance(payload, DataFrame) else payload
    if form == "log":
        return f"{title}={json.dumps(value, ensure_ascii=False)}\n"
    text = json.dumps(value, indent=2, ensure_ascii=False)
    return f"{text}\n" if form == "json" else f"{title}\n{text}\n"
