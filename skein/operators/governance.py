"""Durable clusters across runs: saving a run, overrides by people, closing and reopening.

Every operation is a function of snapshots to new snapshots; times and run numbers are arguments.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F

from skein.operators.reports import role_rank
from skein.operators.numbering import numbered
from skein.schemas import CLUSTER_CLOSURES, CLUSTER_EVENTS, CLUSTER_GROUPS, CLUSTER_MEMBERSHIPS, CLUSTER_OVERRIDES, conform
from skein.sources.shared import written

NOT_SEEN = '{"reason":"not seen in latest cluster run"}'
OVERRIDDEN = '{"reason":"local override"}'


@dataclass(frozen=True)
class State:
    groups: DataFrame
    memberships: DataFrame
    overrides: DataFrame
    closures: DataFrame


def settled(state: State) -> State:
    """The same state from written tables. Operations are plans over their inputs; settle between them, or commit to a
    store, so that plans do not grow from one operation to the next."""
    return State(*(written(df, name) for name, df in (("groups", state.groups), ("memberships", state.memberships), ("overrides", state.overrides), ("closures", state.closures))))


def change(df: DataFrame, where: Column, **values: object) -> DataFrame:
    """df with columns set where a condition holds; it and Column values see the old row."""
    where = F.coalesce(where, F.lit(False))
    new = {c: F.when(where, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)).cast(df.schema[c].dataType) for c, v in values.items()}
    return df.withColumns(new)


def _flag(df: DataFrame, keys: DataFrame, on: list[str], name: str) -> DataFrame:
    """df with a boolean column: whether keys has the row's key."""
    return df.join(keys.select(*on).distinct().withColumn(name, F.lit(True)), on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def missing_removed(memberships: DataFrame, seen: DataFrame, now: str) -> DataFrame:
    """Active members of clusters in seen (cluster_id, thread_id) that seen does not name are removed. Clusters that seen
    does not name stay as they are."""
    rows = _flag(_flag(memberships, seen, ["cluster_id"], "_asked"), seen, ["cluster_id", "thread_id"], "_seen")
    gone = F.col("_asked") & ~F.col("_seen") & (F.col("state") == "active")
    return change(rows, gone, state="removed", removed_by="cluster", removed_reason_json=NOT_SEEN, removed_at=now, updated_at=now).drop("_asked", "_seen")


def best_members(memberships: DataFrame, threads: DataFrame) -> DataFrame:
    """(cluster_id, best): the active member that leads, by role, score and number."""
    rows = memberships.where(F.col("state") == "active").join(threads.select(F.col("id").alias("thread_id"), "number"), "thread_id")
    key = F.struct(role_rank(), -F.coalesce("score_to_representative", F.lit(0.0)), "number", "thread_id")
    return rows.groupBy("cluster_id").agg(F.min_by("thread_id", key).alias("best"))


def ensure_representatives(groups: DataFrame, memberships: DataFrame, threads: DataFrame, asked: DataFrame, now: str) -> DataFrame:
    """Clusters of asked (id) whose representative is missing or no active member get their best member."""
    rows = _flag(groups, asked, ["id"], "_asked")
    active = memberships.where(F.col("state") == "active").select(F.col("cluster_id").alias("id"), F.col("thread_id").alias("representative_thread_id"))
    rows = _flag(rows, active, ["id", "representative_thread_id"], "_leads")
    rows = rows.join(best_members(memberships, threads).withColumnRenamed("cluster_id", "id"), "id", "left")
    return change(rows, F.col("_asked") & ~F.col("_leads"), representative_thread_id=F.col("best"), updated_at=now).select(*groups.columns)


def apply_overrides(state: State, threads: DataFrame, asked: DataFrame, now: str) -> State:
    """Overrides of the clusters in asked (id): exclude, then include, then the newest canonical; clusters without a
    canonical one get a representative if they lack one."""
    own = state.overrides.join(asked.select(F.col("id").alias("cluster_id")), "cluster_id", "left_semi")
    own = own.join(state.groups.select(F.col("id").alias("cluster_id"), F.col("repo_id").alias("_repo")), "cluster_id").where(F.col("repo_id") == F.col("_repo"))
    of = lambda action: own.where(F.col("action") == action)
    rows = _flag(state.memberships, of("exclude"), ["cluster_id", "thread_id"], "_out")
    rows = change(rows, F.col("_out"), state="excluded", removed_by="local", removed_reason_json=F.coalesce("removed_reason_json", F.lit(OVERRIDDEN)), removed_at=F.coalesce("removed_at", F.lit(now)), updated_at=now).drop("_out")
    rows = _flag(rows, of("include"), ["cluster_id", "thread_id"], "_in")
    rows = change(rows, F.col("_in"), state="active", removed_by=None, removed_reason_json=None, removed_at=None, updated_at=now).drop("_in")
    newest = of("canonical").groupBy("cluster_id").agg(F.max_by("thread_id", F.struct("created_at", "id")).alias("_lead"))
    rows = rows.join(newest, "cluster_id", "left")
    leads = F.when(F.col("thread_id") == F.col("_lead"), "canonical").otherwise("member")
    memberships = change(rows, F.col("_lead").isNotNull() & (F.col("state") == "active"), role=leads, updated_at=now).select(*state.memberships.columns)
    groups = state.groups.join(newest.withColumnRenamed("cluster_id", "id"), "id", "left")
    groups = change(groups, F.col("_lead").isNotNull(), representative_thread_id=F.col("_lead"), updated_at=now).select(*state.groups.columns)
    others = asked.select("id").join(newest.select(F.col("cluster_id").alias("id")), "id", "left_anti")
    return replace(state, groups=ensure_representatives(groups, memberships, threads, others, now), memberships=memberships)


def save_clusters(state: State, inputs: DataFrame, threads: DataFrame, repo_id: int, run_id: int, now: str) -> tuple[State, DataFrame]:
    """The state after a run's clusters (rows of cluster_inputs) are saved, and the events to append. New members become
    active, absent ones of these clusters removed, overrides are applied again, and legacy clusters of type similarity go."""
    new = inputs.groupBy("stable_key").agg(*(F.first(c).alias(c) for c in ("stable_slug", "cluster_type", "representative_thread_id", "title"))).where(F.trim("stable_key") != "")
    old = state.groups.where(F.col("repo_id") == repo_id)
    last = state.groups.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh = numbered(new.select("stable_key").join(old.select("stable_key"), "stable_key", "left_anti"), ("stable_key",), "fresh_id", last)
    paired = new.alias("n").join(old.alias("o"), "stable_key", "left").join(fresh, "stable_key", "left").withColumn("_id", F.coalesce("o.id", "fresh_id"))
    known, closed = F.col("o.id").isNotNull(), F.col("o.status") == "closed"
    seen = paired.select(
        F.col("_id").alias("id"), F.lit(repo_id).cast("long").alias("repo_id"), "stable_key", F.coalesce(F.nullif(F.trim("n.stable_slug"), F.lit("")), "stable_key").alias("stable_slug"),
        F.coalesce("o.status", F.lit("active")).alias("status"), F.coalesce(F.nullif("n.cluster_type", F.lit("")), F.lit("duplicate_candidate")).alias("cluster_type"),
        F.when(known & closed, F.col("o.representative_thread_id")).otherwise(F.col("n.representative_thread_id")).alias("representative_thread_id"), F.nullif("n.title", F.lit("")).alias("title"),
        F.coalesce("o.created_at", F.lit(now)).alias("created_at"), F.lit(now).alias("updated_at"), F.col("o.closed_at").alias("closed_at"),
    )
    groups = conform(seen, CLUSTER_GROUPS).unionByName(conform(state.groups.join(seen.select("id"), "id", "left_anti"), CLUSTER_GROUPS))
    # All of the run's members, under their cluster's id.
    listed = inputs.join(seen.select("stable_key", F.col("id").alias("cluster_id")), "stable_key").select("cluster_id", "thread_id", F.col("role").alias("new_role"), F.col("score_to_representative").alias("new_score")).dropDuplicates(["cluster_id", "thread_id"])
    rows = state.memberships.join(listed.withColumn("_new", F.lit(True)), ["cluster_id", "thread_id"], "full")
    fresh_row, hit = F.col("state").isNull(), F.col("_new").isNotNull()
    rows = change(rows.withColumn("_fresh", fresh_row), F.col("_fresh"), first_seen_run_id=run_id, added_by="cluster", added_reason_json="{}", created_at=now)
    rows = change(rows, hit, role=F.coalesce(F.nullif(F.trim("new_role"), F.lit("")), F.lit("member")), state="active", score_to_representative=F.col("new_score"), last_seen_run_id=run_id, removed_by=None, removed_reason_json=None, removed_at=None, updated_at=now)
    memberships = missing_removed(conform(rows, CLUSTER_MEMBERSHIPS), listed, now)
    asked = seen.select("id")
    after = apply_overrides(replace(state, groups=groups, memberships=memberships), threads, asked, now)
    legacy = (F.col("repo_id") == repo_id) & F.coalesce(F.col("cluster_type") == "similarity", F.lit(False))
    kept = after.groups.where(~legacy)
    events = conform(asked.select(F.col("id").alias("cluster_id"), F.lit(run_id).alias("run_id"), F.lit("seen").alias("event_type"), F.lit("cluster").alias("actor_kind"), F.lit("{}").alias("payload_json"), F.lit(now).alias("created_at")), CLUSTER_EVENTS)
    gone = after.groups.where(legacy).select(F.col("id").alias("cluster_id"))
    return replace(after, groups=kept, memberships=after.memberships.join(gone, "cluster_id", "left_anti")), events


def find_member(state: State, threads: DataFrame, repo_id: int, cluster_id: int, number: int, active: bool = False) -> int:
    """The thread of a member; LookupError if there is none."""
    rows = state.memberships.where(F.col("cluster_id") == cluster_id)
    if active:
        rows = rows.where(F.col("state") == "active")
    rows = rows.join(state.groups.where((F.col("id") == cluster_id) & (F.col("repo_id") == repo_id)).select(F.col("id").alias("cluster_id")), "cluster_id", "left_semi")
    row = rows.join(threads.where((F.col("repo_id") == repo_id) & (F.col("number") == number)).select(F.col("id").alias("thread_id")), "thread_id").select("thread_id").first()
    if row is None:
        raise LookupError(f"{'active ' if active else ''}thread #{number} is not in cluster {cluster_id}")
    return row["thread_id"]


def _with_override(overrides: DataFrame, repo_id: int, cluster_id: int, thread_id: int, action: str, reason: str, now: str, drop: Column) -> DataFrame:
    own = (F.col("cluster_id") == cluster_id) & (F.col("thread_id") == thread_id) & (F.col("action") == action)
    kept = overrides.where(~(drop | own))
    ids = overrides.agg(F.coalesce(F.max(F.when(own, F.col("id"))), F.max("id") + 1, F.lit(1)).alias("id"))
    one = ids.select("id", *(F.lit(v).alias(c) for c, v in (("repo_id", repo_id), ("cluster_id", cluster_id), ("thread_id", thread_id), ("action", action), ("reason", reason), ("created_at", now))))
    return conform(kept, CLUSTER_OVERRIDES).unionByName(conform(one, CLUSTER_OVERRIDES))


def _asked(df: DataFrame, cluster_id: int) -> DataFrame:
    return df.sparkSession.range(cluster_id, cluster_id + 1)


def exclude_member(state: State, threads: DataFrame, repo_id: int, cluster_id: int, number: int, reason: str, now: str) -> State:
    thread, reason = find_member(state, threads, repo_id, cluster_id, number), reason.strip() or "local exclude"
    own = (F.col("cluster_id") == cluster_id) & (F.col("thread_id") == thread)
    why = F.to_json(F.struct(F.lit(reason).alias("reason")))
    memberships = change(state.memberships, own, state="excluded", removed_by="local", removed_reason_json=why, removed_at=now, updated_at=now)
    overrides = _with_override(state.overrides, repo_id, cluster_id, thread, "exclude", reason, now, own & F.col("action").isin("include", "canonical"))
    groups = ensure_representatives(state.groups, memberships, threads, _asked(state.groups, cluster_id), now)
    return replace(state, groups=groups, memberships=memberships, overrides=overrides)


def include_member(state: State, threads: DataFrame, repo_id: int, cluster_id: int, number: int, reason: str, now: str) -> State:
    thread, reason = find_member(state, threads, repo_id, cluster_id, number), reason.strip() or "local include"
    own = (F.col("cluster_id") == cluster_id) & (F.col("thread_id") == thread)
    memberships = change(state.memberships, own, state="active", removed_by=None, removed_reason_json=None, removed_at=None, updated_at=now)
    overrides = _with_override(state.overrides, repo_id, cluster_id, thread, "include", reason, now, own & (F.col("action") == "exclude"))
    groups = ensure_representatives(state.groups, memberships, threads, _asked(state.groups, cluster_id), now)
    return replace(state, groups=groups, memberships=memberships, overrides=overrides)


def set_canonical(state: State, threads: DataFrame, repo_id: int, cluster_id: int, number: int, reason: str, now: str) -> State:
    thread, reason = find_member(state, threads, repo_id, cluster_id, number, active=True), reason.strip() or "local canonical"
    role = F.when(F.col("thread_id") == thread, "canonical").otherwise("member")
    memberships = change(state.memberships, (F.col("cluster_id") == cluster_id) & (F.col("state") == "active"), role=role, updated_at=now)
    groups = change(state.groups, (F.col("repo_id") == repo_id) & (F.col("id") == cluster_id), representative_thread_id=thread, updated_at=now)
    stale = (F.col("cluster_id") == cluster_id) & ((F.col("action") == "canonical") | ((F.col("thread_id") == thread) & (F.col("action") == "exclude")))
    return replace(state, groups=groups, memberships=memberships, overrides=_with_override(state.overrides, repo_id, cluster_id, thread, "canonical", reason, now, stale))


def close_cluster(state: State, repo_id: int, cluster_id: int, reason: str, now: str) -> State:
    own = (F.col("repo_id") == repo_id) & (F.col("id") == cluster_id)
    if state.groups.where(own).isEmpty():
        raise LookupError(f"cluster {cluster_id} was not found")
    groups = change(state.groups, own, status="closed", closed_at=now, updated_at=now)
    since = state.closures.where(F.col("cluster_id") == cluster_id).agg(F.coalesce(F.min("created_at"), F.lit(now)).alias("created_at"))
    one = since.select("created_at", *(F.lit(v).alias(c) for c, v in (("cluster_id", cluster_id), ("reason", reason.strip() or "local close"), ("actor_kind", "local"), ("updated_at", now))))
    closures = conform(state.closures.where(F.col("cluster_id") != cluster_id), CLUSTER_CLOSURES).unionByName(conform(one, CLUSTER_CLOSURES))
    return replace(state, groups=groups, closures=closures)


def reopen_cluster(state: State, repo_id: int, cluster_id: int, now: str) -> State:
    own = (F.col("repo_id") == repo_id) & (F.col("id") == cluster_id)
    if state.groups.where(own).isEmpty():
        raise LookupError(f"cluster {cluster_id} was not found")
    groups = change(state.groups, own, status="active", closed_at=None, updated_at=now)
    return replace(state, groups=groups, closures=state.closures.where(F.col("cluster_id") != cluster_id))
