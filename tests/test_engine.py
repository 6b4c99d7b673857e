"""Operators on small tables: search, graphs, clusters, governance, reports, ingest, stores and streams."""

import json
import random
import sqlite3
from collections import defaultdict
from datetime import datetime, timedelta, timezone

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from skein import schemas
from skein.operators import commands, documents, governance, graph, ingest, portable, reports, search, similarity, threads as threads_op
from skein.operators.clusters import cluster_inputs, ordered_clusters
from skein.operators.neighbors import neighbors
from skein.sources.store import Store
from skein.streaming.incremental import stream_threads

NOW, LATER = "2024-06-01T00:00:00Z", "2024-06-02T00:00:00Z"


def table(spark, schema, *rows):
    """Rows as dicts; columns that a row lacks are null."""
    return spark.createDataFrame([[r.get(f.name) for f in schema.fields] for r in rows], schema)


def thread(n, **more):
    return {"id": n, "repo_id": 1, "number": n, "kind": "issue", "state": "open", "title": f"title {n}", "body": "", "html_url": "u", "labels_json": "[]", "updated_at": f"2024-01-{n % 28 + 1:02d}"} | more


def threads(spark, *rows):
    return table(spark, schemas.THREADS, *rows)


# Search


def test_bm25_is_fts5s(spark):
    rng = random.Random(2)
    words = "alpha beta gamma delta eps large file stalls the the the foo_bar Café".split()
    rows = [(k, *(" ".join(rng.choice(words) for _ in range(rng.randint(0, n))) for n in (4, 12, 20, 20))) for k in range(120)]
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(title, body, raw_text, dedupe_text)")
    db.executemany("insert into f(rowid, title, body, raw_text, dedupe_text) values(?,?,?,?,?)", rows)
    index = search.index_documents(spark.createDataFrame(rows, "thread_id long, title string, body string, raw_text string, dedupe_text string"))
    for query, match in (("alpha", '"alpha"'), ("large file", '"large" "file"'), ("the", '"the"'), ("foo_bar", '"foo_bar"'), ("cafe", '"cafe"')):
        want = dict(db.execute("select rowid, bm25(f) from f where f match ?", (match,)).fetchall())
        got = {r["doc_id"]: r["score"] for r in search.bm25(index, query).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert search.bm25(index, "!!") is None


def test_snippets():
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(t)")
    for text in ("Large file download stalls", "a Café, b foo_bar!"):
        db.execute("delete from f")
        db.execute("insert into f values(?)", (text,))
        for term in ("file", "cafe"):
            row = db.execute("select snippet(f, 0, '[', ']', '...', 18) from f where f match ?", (term,)).fetchone()
            if row:
                assert search.mark_snippet(text, [term]) == row[0]
    long = " ".join(f"w{k}" for k in range(50))
    assert search.mark_snippet(long, ["w30"]).startswith("...[w30] w31") and search.mark_snippet(long, ["w1"]).endswith("...")


def test_search_documents_and_fallback(spark):
    own = threads(spark, thread(1, title="large file", body="Download STALLS here"), thread(2, title="other", state="closed"), thread(3, repo_id=2, title="large"), thread(4, closed_at_local=NOW, title="file closed"))
    docs = documents.build_documents(own, spark.createDataFrame([], "thread_id long, ordinal long, author_login string, body string, is_bot boolean"))
    hits = search.search_documents(own, docs, 1, "large file").collect()
    assert [h["thread_id"] for h in hits] == [1] and hits[0]["snippet"].startswith("[large] [file]")
    hits = search.search_documents(own, docs, 1, "ownload stall").collect()
    assert [(h["thread_id"], h["snippet"]) for h in hits] == [(1, "Download STALLS here")]
    assert search.search_documents(own, docs, 1, "%_").count() == 0
    assert [t["id"] for t in search.search_threads(own, docs, 1, "file").collect()] == [1]
    assert [t["id"] for t in search.search_threads(own, docs, 1).collect()] == [2, 1]
    assert [t["id"] for t in search.search_threads(own, docs, 1, kind="issue", state="closed", include_closed=True).collect()] == [2]


# Documents and the queue


def test_documents_of_threads(spark):
    own = threads(spark, thread(1, title="Download", body=" Stalls\n", labels_json='[{"name":"bug"},{"name":"net"}]'), thread(2, labels_json="oops"))
    said = spark.createDataFrame([(1, 2, "ann", "me too", False), (1, 1, "bot", "ignored", True), (1, 0, "bob", " ", False)], "thread_id long, ordinal long, author_login string, body string, is_bot boolean")
    rows = {r["thread_id"]: r for r in documents.build_documents(own, said).collect()}
    assert rows[1]["raw_text"] == "# Download\n\nStalls\n\nLabels: bug, net\n\nann: me too"
    assert rows[1]["dedupe_text"] == "download stalls bug net me too"
    assert (rows[2]["raw_text"], rows[2]["dedupe_text"]) == ("# title 2", "title 2")


def test_embedding_queue(spark):
    own = threads(spark, thread(1, body="b" * 7000), thread(2, state="closed"), thread(3, title=""), thread(4), thread(5))
    docs = documents.build_documents(own, spark.createDataFrame([], "thread_id long, ordinal long, author_login string, body string, is_bot boolean"))
    keyed = spark.createDataFrame([(4, "key")], "thread_id long, key_text string")
    none = table(spark, schemas.THREAD_VECTORS)
    queue = lambda v, **o: documents.embedding_tasks(own, docs, v, keyed, 1, model="m", **o).collect()
    rows = queue(none)
    assert [r["thread_id"] for r in rows] == [5, 4, 3, 1] and rows[-1]["text_truncated"] and rows[-1]["text_runes"] == 6000
    made = table(spark, schemas.THREAD_VECTORS, *({"thread_id": r["thread_id"], "basis": "title_original", "model": "m", "content_hash": r["content_hash"]} for r in rows if r["thread_id"] in (4, 5)))
    assert [r["thread_id"] for r in queue(made)] == [3, 1] and queue(made, limit=2) == []
    assert len(queue(made, force=True, include_closed=True)) == 5
    assert [(r["thread_id"], r["text"]) for r in queue(none, basis="llm_key_summary")] == [(4, "title: title 4\n\nkey_summary:\nkey")]
    with pytest.raises(ValueError):
        queue(none, basis="nope")


# Graphs and clusters


def brute(nodes, edges, most):
    where, degree = {n: {n} for n in nodes}, defaultdict(int)
    for a, b, _ in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if where[a] is not where[b]:
            if most and len(where[a]) + len(where[b]) > most:
                continue
            both = where[a] | where[b]
            for n in both:
                where[n] = both
        degree[a] += 1
        degree[b] += 1
    return {frozenset(m): min(m, key=lambda n: (-degree[n], n)) for m in {frozenset(m) for m in where.values()}}


@pytest.mark.parametrize("most", [0, 3, 7])
def test_bounded_clusters_by_brute_force(spark, most):
    rng = random.Random(most)
    nodes = list(range(1, 61))
    edges = {(a, b): round(rng.random(), 1) for a, b in (sorted(rng.sample(nodes, 2)) for _ in range(70))}
    edges = [(a, b, s) for (a, b), s in edges.items()]
    rows = graph.bounded_clusters(spark.createDataFrame([(n, n) for n in nodes], "thread_id long, number long"), spark.createDataFrame(edges, "left_id long, right_id long, score double"), most).collect()
    got = defaultdict(set)
    for r in rows:
        got[r["representative"]].add(r["thread_id"])
        assert not most or r["members"] <= most
    assert {frozenset(m): k for k, m in got.items()} == brute(nodes, edges, most)


def test_chain_is_cut(spark):
    edges = [(k, k + 1, 0.9) for k in range(1, 6)]
    rows = graph.bounded_clusters(spark.createDataFrame([(k, k) for k in range(1, 7)], "thread_id long, number long"), spark.createDataFrame(edges, "left_id long, right_id long, score double"), 3).collect()
    assert {r["thread_id"]: r["representative"] for r in rows} == {1: 2, 2: 2, 3: 2, 4: 5, 5: 5, 6: 5}


def test_components_are_cut_once(spark):
    rows = graph.bounded_clusters(spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "thread_id long, number long"), spark.createDataFrame([(1, 2, 0.9)], "left_id long, right_id long, score double"))
    assert "FlatMapGroupsInPandas" not in rows._jdf.queryExecution().toString() and {r["thread_id"]: r["members"] for r in rows.collect()} == {1: 2, 2: 2, 3: 1}


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 1), (9, 9), (8, None), (7, 6), (7, 6)], "a long, b long")
    assert {r["node"]: r["component"] for r in graph.components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6, 7: 6, 9: 9}


def test_edge_policy(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_BYTES", 32)
    own = threads(spark, thread(10, title="download stalls badly"), thread(11, title="download stalls"), thread(12, title="nothing alike", kind="pull_request"), thread(13, title="fixes #12"), thread(14, body="x" * 400 + " #10"), thread(15, body="see #10"))
    vectors = spark.createDataFrame([(1, 10, [1.0, 0.0]), (1, 11, [0.9, 0.4358]), (1, 12, [0.95, 0.3122]), (1, 13, [0.0, 1.0]), (1, 14, [0.0, -1.0]), (1, 15, [-1.0, 0.0])], "repo_id long, thread_id long, vector array<double>")
    policy = similarity.EdgePolicy()
    pairs = {(r["left_id"], r["right_id"]): round(r["score"], 3) for r in similarity.cosine_pairs(vectors, policy.threshold).collect()}
    assert pairs == {(10, 11): 0.9, (10, 12): 0.95, (11, 12): 0.991}
    edges = {(r["left_id"], r["right_id"]) for r in similarity.build_edges(own, vectors, policy).collect()}
    assert edges == {(10, 11), (10, 12), (11, 12), (12, 13), (10, 15)}
    weak = similarity.EdgePolicy(confident=0.96, cross_kind=0.995)
    assert {(r["left_id"], r["right_id"]) for r in similarity.build_edges(own, vectors, weak).collect()} == {(10, 11), (12, 13), (10, 15)}


@pytest.mark.parametrize("size", [200, 1 << 20])
def test_cosine_pairs_of_keys_and_lengths(spark, monkeypatch, size):
    monkeypatch.setattr(similarity, "BLOCK_BYTES", size)
    rng = random.Random(1)
    rows = [(rng.choice((1, 1, 1, 2, None)), k, [rng.gauss(0, 1) for _ in range(rng.choice((3, 3, 5)))]) for k in range(120)] + [(1, 200, [0.0, 0.0, 0.0]), (1, 201, [])]
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / ((sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5 or 1)
    want = {(a, b) for k, a, v in rows for m, b, w in rows if a < b and k == m and len(v) == len(w) > 0 and cosine(v, w) >= 0.7}
    got = [(r["left_id"], r["right_id"]) for r in similarity.cosine_pairs(spark.createDataFrame(rows, "repo_id long, thread_id long, vector array<double>"), 0.7).collect()]
    assert sorted(got) == sorted(want)


def test_cosine_pairs_are_shared_by_tasks(spark):
    rng = random.Random(2)
    rows = [(1, k, [rng.gauss(0, 1) for _ in range(4)]) for k in range(3000)]
    pairs = similarity.cosine_pairs(spark.createDataFrame(rows, "repo_id long, thread_id long, vector array<double>"), 0.99)
    assert pairs.select(F.spark_partition_id()).distinct().count() > 3


@pytest.mark.parametrize(("fanout", "title_overlap"), [(1, 0.4), (3, 0.4), (3, 0.0), (0, 0.4)])
def test_edges_are_those_of_all_pairs_and_read_no_text_again(spark, monkeypatch, fanout, title_overlap):
    monkeypatch.setattr(similarity, "BLOCK_ROWS", 40)
    rng = random.Random(fanout)
    words = ["alpha", "bravo", "carol", "delta", "eagle"]
    own = threads(spark, *(thread(k, title=rng.choice((None, "", " ".join(rng.choices(words, k=4)))), kind=rng.choice(("issue", "pull_request", None)), body=f"#{rng.randrange(10, 199)}" if k % 9 == 0 else None) for k in range(10, 200)))
    common = [1.0, 2.0, 2.0]
    rows = [(1 + k % 2, k, common if k % 6 == 0 else [float(rng.randint(-2, 2)) for _ in range(rng.choice((3, 3, 2)))]) for k in [*range(10, 210), *range(10, 60)]]
    vectors = spark.createDataFrame(rows, "repo_id long, thread_id long, vector array<double>")
    policy = similarity.EdgePolicy(threshold=0.3, confident=0.9, title_overlap=title_overlap, cross_kind=0.8, reference=0.85, fanout=fanout)
    nodes = own.join(vectors.select(F.col("thread_id").alias("id")), "id", "left_semi")
    whole = similarity.merge_edges(similarity.filter_edges(similarity.cosine_pairs(vectors, policy.threshold), nodes, policy), similarity.reference_edges(nodes, policy))
    made = similarity.build_edges(own, vectors, policy)
    assert made.inputFiles() and {tuple(r) for r in made.collect()} == {tuple(r) for r in similarity.best_edges(whole, fanout).collect()}


def test_best_of_many_tiles(monkeypatch):
    monkeypatch.setattr(similarity, "TILE", 1)
    monkeypatch.setattr(similarity, "CHUNK", 50)
    rng = np.random.default_rng(3)
    x = rng.integers(-2, 3, (150, 4)).astype(float)
    ids, blocks, policy = rng.permutation(150) + 7, np.arange(150) % 2, similarity.EdgePolicy(threshold=0.2, confident=0.9, title_overlap=0.5, cross_kind=0.8, fanout=3)
    part = pa.table({"kind": [("issue", "pull_request")[k % 3 > 0] for k in range(150)], "tokens": [[("alpha", "bravo", "carol")[k % n] for n in (2, 3)] for k in range(150)]})
    for i, j in ((0, 0), (0, 1)):
        best = similarity._Best(ids, policy.fanout)
        allowed = similarity._allowed(part, policy)
        similarity._block_best(np.arange(150), blocks, x, i, j, policy.threshold, best, allowed)
        got = {(r["left_id"], r["right_id"], r["score"]) for b in best.batches() for r in b.to_pylist()}
        pairs = [r for b in similarity._block_pairs(ids, blocks, x, i, j, policy.threshold) for r in b.to_pylist()]
        at = {n: np.array([k]) for k, n in enumerate(ids.tolist())}
        pairs = [(r["left_id"], r["right_id"], r["score"]) for r in pairs if allowed(at[r["left_id"]], at[r["right_id"]], np.array([r["score"]]))[0]]
        ends = defaultdict(list)
        for a, b, score in pairs:
            ends[a].append((-score, b, (a, b, score)))
            ends[b].append((-score, a, (a, b, score)))
        assert got == {e for of in ends.values() for _, _, e in sorted(of)[:3]} and len(got) < len(pairs)


def test_best_edges_score_few_of_many_pairs(monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1200, 16))
    x[7], x[8], x[9] = np.nan, np.inf, 0
    ids, blocks, policy = rng.permutation(1200), np.arange(1200) % 2, similarity.EdgePolicy(threshold=0.2, confident=0.6, title_overlap=0.5, cross_kind=0.7, fanout=2)
    part = pa.table({"kind": [("issue", "pull_request")[k % 3 > 0] for k in range(1200)], "tokens": [["alpha", f"t{k % 4}"] if k % 50 else [f"own{k}"] for k in range(1200)]})
    scored, exact = [], similarity._summed
    for i, j in ((0, 0), (0, 1)):
        best, allowed = similarity._Best(ids, policy.fanout), similarity._allowed(part, policy)
        monkeypatch.setattr(similarity, "_summed", lambda a, b: scored.append(len(a)) or exact(a, b))
        similarity._block_best(np.arange(1200), blocks, x, i, j, policy.threshold, best, allowed)
        monkeypatch.setattr(similarity, "_summed", exact)
        got = {(r["left_id"], r["right_id"], r["score"]) for b in best.batches() for r in b.to_pylist()}
        found = pa.Table.from_batches(list(similarity._block_pairs(ids, blocks, x, i, j, policy.threshold)))
        place = np.argsort(ids)
        p, q, score = place[found["left_id"].to_numpy()], place[found["right_id"].to_numpy()], found["score"].to_numpy()
        stays = allowed(p, q, score)
        ends = defaultdict(list)
        for a, b, s in zip(ids[p[stays]].tolist(), ids[q[stays]].tolist(), score[stays].tolist(), strict=True):
            ends[a].append((-s, b, (a, b, s)))
            ends[b].append((-s, a, (a, b, s)))
        assert got == {e for of in ends.values() for _, _, e in sorted(of)[:2]}
        assert sum(scored) - 1200 < len(found) / 3
        scored.clear()


def test_best_edges_keep_either_end(spark):
    edges = spark.createDataFrame([(1, k, 0.9 - k / 100) for k in range(2, 6)] + [(5, 6, 0.99)], "left_id long, right_id long, score double")
    assert {(r[0], r[1]) for r in similarity.best_edges(edges, 1).collect()} == {(1, 2), (1, 3), (1, 4), (5, 6)}
    merged = similarity.merge_edges(edges, spark.createDataFrame([(2, 1, 0.94), (3, 3, 1.0)], "left_id long, right_id long, score double"))
    assert {(r[0], r[1]): r[2] for r in merged.collect()}[1, 2] == 0.94 and merged.count() == 5


def test_neighbors_of_a_thread(spark):
    own = threads(spark, *(thread(k) for k in range(1, 5)), thread(5, state="closed"))
    rows = [(1, "m", [1.0, 0.0]), (2, "m", [1.0, 0.1]), (3, "m", [-1.0, 0.0]), (4, "n", [1.0, 0.0]), (5, "m", [1.0, 0.0])]
    vectors = spark.createDataFrame([(t, "b", m, v) for t, m, v in rows], "thread_id long, basis string, model string, vector array<double>")
    assert [r["thread_id"] for r in neighbors(own, vectors, 1, 1, model="m").collect()] == [2]
    assert [r["thread_id"] for r in neighbors(own, vectors, 1, 4, model="m").collect()] == []
    with pytest.raises(LookupError):
        neighbors(own, vectors, 1, 99)


# Governance and reports


def inputs(spark, *members, lead=1, key="k1"):
    rows = [(key, "slug", "duplicate_candidate", lead, "Cluster x", m, m, "canonical" if m == lead else "related", 1.0 if m == lead else 0.9) for m in members]
    return spark.createDataFrame(rows, "stable_key string, stable_slug string, cluster_type string, representative_thread_id long, title string, thread_id long, number long, role string, score_to_representative double")


def states(state):
    return {r["thread_id"]: (r["state"], r["role"]) for r in state.memberships.collect()}


def test_overrides_across_runs(spark):
    own = threads(spark, *(thread(k) for k in range(1, 7)))
    empty = governance.State(*(table(spark, schemas.TABLES[t]) for t in ("cluster_groups", "cluster_memberships", "cluster_overrides", "cluster_closures")))
    state, events = governance.save_clusters(empty, inputs(spark, 1, 2, 3), own, 1, 1, NOW)
    state = governance.settled(governance.settled(state))
    assert events.count() == 1 and states(state) == {1: ("active", "canonical"), 2: ("active", "related"), 3: ("active", "related")}
    cluster = state.groups.first()["id"]
    state = governance.settled(governance.exclude_member(state, own, 1, cluster, 1, "no", NOW))
    assert states(state)[1][0] == "excluded" and state.groups.first()["representative_thread_id"] == 2
    state = governance.settled(governance.set_canonical(state, own, 1, cluster, 3, "", NOW))
    assert states(state) == {1: ("excluded", "canonical"), 2: ("active", "member"), 3: ("active", "canonical")}
    with pytest.raises(LookupError):
        governance.set_canonical(state, own, 1, cluster, 1, "", NOW)
    state = governance.settled(governance.settled(governance.save_clusters(state, inputs(spark, 1, 3, 4), own, 1, 2, LATER)[0]))
    assert states(state) == {1: ("excluded", "canonical"), 2: ("removed", "member"), 3: ("active", "canonical"), 4: ("active", "member")}
    assert state.groups.first()["representative_thread_id"] == 3 and state.groups.count() == 1
    state = governance.settled(governance.include_member(state, own, 1, cluster, 2, "", LATER))
    state = governance.settled(governance.settled(governance.save_clusters(state, inputs(spark, 3, 4), own, 1, 3, LATER)[0]))
    assert states(state)[2][0] == "active"
    state = governance.settled(governance.close_cluster(state, 1, cluster, " ", LATER))
    assert (state.groups.first()["status"], state.closures.first()["reason"]) == ("closed", "local close")
    state = governance.settled(governance.settled(governance.save_clusters(state, inputs(spark, 4, 5, lead=4), own, 1, 4, LATER)[0]))
    assert state.groups.first()["status"] == "closed"
    state = governance.settled(governance.reopen_cluster(state, 1, cluster, LATER))
    assert state.groups.first()["status"] == "active" and state.closures.count() == 0
    with pytest.raises(LookupError):
        governance.close_cluster(state, 1, 999, "", NOW)


def group(n, **more):
    return {"id": n, "repo_id": 1, "stable_slug": f"s{n}", "status": "active", "title": f"c{n}", "representative_thread_id": n, "updated_at": f"2024-01-0{n}"} | more


def member(c, t, role="related", **more):
    return {"cluster_id": c, "thread_id": t, "role": role, "state": "active"} | more


def test_visibility_of_members(spark):
    own = threads(spark, *(thread(k) for k in range(1, 5)), thread(5, state="closed"))
    groups = table(spark, schemas.CLUSTER_GROUPS, group(1), group(2), group(3, status="closed", closed_at=NOW), group(4, repo_id=2))
    ships = table(spark, schemas.CLUSTER_MEMBERSHIPS, member(1, 1, "canonical"), member(1, 2), member(1, 3), member(1, 4), member(1, 5), member(2, 2, "canonical"), member(3, 3, "canonical"), member(4, 4, "canonical"))
    assert {(r["cluster_id"], r["thread_id"]) for r in reports.visible_members(groups, ships, own).collect()} == {(1, 1), (1, 3), (1, 4), (2, 2), (3, 3), (4, 4)}
    rows = {r["id"]: r["member_count"] for r in reports.durable_summaries(groups, ships, own, 1).collect()}
    assert rows == {1: 3, 2: 1}
    assert {r["id"]: r["member_count"] for r in reports.durable_summaries(groups, ships, own, 1, include_closed=True).collect()} == {1: 5, 2: 1, 3: 1}
    detail = reports.durable_detail(groups, ships, own, 1).collect()
    assert [r["thread_id"] for r in detail] == [1, 3, 4]
    closures = table(spark, schemas.CLUSTER_CLOSURES)
    assert reports.durable_summary_by_id(groups, ships, own, closures, 1, 1).first()["member_count"] == 3
    assert reports.durable_summary_by_id(groups, ships, own, closures, 1, 1, include_closed=True).first()["member_count"] == 5


def test_overlapping_closed_clusters(spark):
    rng = random.Random(5)
    sets = {k: sorted(rng.sample(range(30), rng.randint(1, 8))) for k in range(1, 40)} | {40: [100, 101], 41: [100, 101, 102], 42: [101]}
    rows = [(k, len(m), f"2024-01-{rng.randint(1, 9):02d}", m) for k, m in sets.items()]
    got = {r["id"] for r in reports.drop_overlapping(spark.createDataFrame(rows, "id long, member_count long, updated_at string, member_ids array<long>")).collect()}
    kept = []
    for k, _, _, m in sorted(sorted(sorted(rows), key=lambda r: r[2], reverse=True), key=lambda r: -r[1]):
        if not any(len({*m} & {*sets[o]}) >= 0.8 * min(len(m), len(sets[o])) for o in kept):
            kept.append(k)
    assert got == {*kept}


def test_run_clusters(spark):
    own = threads(spark, thread(1), thread(2, state="closed"), thread(3, state="closed"))
    runs = spark.createDataFrame([(1, 1, "success", NOW, NOW), (2, 1, "success", NOW, LATER), (3, 1, "success", LATER, None), (4, 1, "failed", LATER, LATER)], "id long, repo_id long, status string, started_at string, finished_at string")
    clusters = spark.createDataFrame([(7, 1, 2, 1, 2, NOW, None, None), (8, 1, 2, 3, 1, NOW, None, None), (9, 1, 1, 1, 1, NOW, None, None)], "id long, repo_id long, cluster_run_id long, representative_thread_id long, member_count long, created_at string, closed_at_local string, close_reason_local string")
    links = spark.createDataFrame([(7, 1, 1.0), (7, 2, 0.5), (8, 3, 1.0)], "cluster_id long, thread_id long, score_to_representative double")
    assert reports.latest_run(runs, clusters, 1) == 2 and reports.latest_run(runs, clusters, 9) is None
    assert {r["id"]: (r["status"], r["member_count"]) for r in reports.run_summaries(runs, clusters, links, own, 1).collect()} == {7: ("active", 2), 8: ("closed", 1)}
    assert [r["id"] for r in reports.run_summaries(runs, clusters, links, own, 1, include_closed=False).collect()] == [7]
    assert reports.run_summary_by_id(runs, clusters, links, own, 1, 7).first()["member_count"] == 1
    assert [r["role"] for r in reports.run_detail(clusters, links, own, 7, 2, include_closed=True).collect()] == ["representative", "member"]
    with pytest.raises(ValueError):
        reports.list_runs(runs, 1, "nope")


def test_browser_lists(spark):
    rows = [(1, "durable_cluster", "slug", "Alpha", "rep", "issue", "active", "", 3, NOW, 0), (2, "durable_cluster", "x", "", "rep two", "issue", "closed", NOW, 1, LATER, 1)]
    lists = spark.createDataFrame(rows, "id long, source string, stable_slug string, title string, representative_title string, representative_kind string, status string, closed_at string, member_count long, updated_at string, position long")
    assert [r["id"] for r in reports.filter_clusters(lists, "ALPHA").collect()] == [1] and reports.filter_clusters(lists, "two").count() == 0
    assert {r["id"] for r in reports.relaxed_clusters(lists, "two", 5).collect()} == {2}
    assert [[r["id"] for r in reports.sort_clusters(lists, s).collect()] for s in ("recent", "oldest", "size")] == [[2, 1], [1, 2], [1, 2]]
    assert reports.list_signature(lists).first()["signature"] == f"1:3:{NOW}|2:1:{LATER}"


# Ingest, stores, streams, portable copies


def api_row(n, **more):
    return json.dumps({"id": n * 1000, "number": n, "title": f"t{n}", "state": "open", "body": None, "labels": [{"name": "b<"}], "user": {"login": "ci[bot]", "type": "Bot"}} | more)


def test_threads_of_api_rows(spark):
    raw = spark.createDataFrame([(api_row(1),), (api_row(2, pull_request=None, labels=None),)], "raw string")
    one, two = ingest.threads_from_api(raw, 1, NOW).orderBy("number").collect()
    assert (one["kind"], one["labels_json"], one["github_id"], one["body"]) == ("issue", '[{"name":"b\\u003c"}]', "1000", None)
    assert (two["kind"], two["labels_json"], two["is_draft"]) == ("pull_request", "[]", False) and one["content_hash"] != two["content_hash"]
    said = spark.createDataFrame([(1, json.dumps({"id": 5, "body": "x", "user": {"login": "ci[bot]"}})), (1, json.dumps({"id": 6, "body": " "})), (1, json.dumps({"id": 7, "body": ""})), (1, "oops"), (1, None), (1, "[]")], "thread_id long, raw string")
    assert [(r["github_id"], r["is_bot"]) for r in ingest.comments_from_api(said, "issue_comment").collect()] == [("5", True), ("6", False)]  # only empty bodies are left out
    broken = spark.createDataFrame([("{",), (None,), ("[1]",), (api_row(3),)], "raw string")
    assert [r["number"] for r in ingest.threads_from_api(broken, 1, NOW).collect()] == [3]


def test_comments_of_a_thread_in_order(spark):
    body = lambda n: json.dumps({"id": n, "body": f"c{n}"})
    rows = [(1, "pull_review_comment", 1, 0, body(5)), (1, "issue_comment", 2, 0, body(2)), (1, "issue_comment", 1, 1, body(1)), (1, "pull_review", 1, 0, body(3)), (1, "issue_comment", 1, 0, json.dumps({"id": 9, "body": ""})), (2, "issue_comment", 1, 0, body(7)), (2, "other", 1, 0, body(8))]
    out = ingest.thread_comments(spark.createDataFrame(rows, "thread_id long, comment_type string, page int, place int, raw string")).orderBy("thread_id", "ordinal").collect()
    assert [(r["thread_id"], r["ordinal"], r["body"]) for r in out] == [(1, 0, "c1"), (1, 1, "c2"), (1, 2, "c3"), (1, 3, "c5"), (2, 0, "c7")]


def test_merges(spark):
    old = threads(spark, thread(1, first_pulled_at="a", closed_at_local="x"), thread(2), thread(3, state="closed"))
    new = threads(spark, thread(1, id=None, title="new", first_pulled_at="b"), thread(9, id=None))
    rows = {r["number"]: r for r in ingest.upsert_threads(old, new).collect()}
    assert (rows[1]["title"], rows[1]["first_pulled_at"], rows[1]["closed_at_local"], rows[1]["id"], rows[9]["id"]) == ("new", "a", "x", 1, 4)
    closed = threads(spark, *(thread(k, state="closed", title="gone") for k in (1, 2, 3)), thread(2, state="closed", title="older", updated_at="2000"))
    assert {r["number"]: r["title"] for r in ingest.reconcile_closed(old, closed).collect()} == {1: "title 1", 2: "gone", 3: "title 3"}
    local = threads_op.close_thread(old, 1, 2, "dup", NOW)
    assert threads_op.list_threads(local, 1).count() == 1 and threads_op.list_threads(threads_op.reopen_thread(local, 1, 2, NOW), 1).count() == 2
    with pytest.raises(ValueError):
        threads_op.select_fields(old, "number,nope")


def test_repeated_keys_count_once(spark):
    old = threads(spark, thread(1), thread(2), thread(3))
    at = lambda n, **more: thread(n, id=None, **more)
    new = threads(spark, at(1, title="b", updated_at_gh="2"), at(1, title="a", updated_at_gh="1"), at(8, title="x", updated_at_gh="1"), at(8, title="y", updated_at_gh="2"), at(7), at(2, state="closed", updated_at_gh="1"), at(2, updated_at_gh="2"), at(3, updated_at_gh="1"), at(3, state="closed", title="gone", updated_at_gh="2"))
    for rows in (new, new.repartition(3), new.orderBy(F.desc("title"))):
        out = {r["number"]: (r["id"], r["title"], r["state"]) for r in ingest.sync_threads(old, rows).collect()}
        assert out == {1: (1, "b", "open"), 2: (2, "title 2", "open"), 3: (3, "gone", "closed"), 7: (4, "title 7", "open"), 8: (5, "y", "open")}
        assert ingest.sync_threads(old, rows).count() == 5
    ordered = new.withColumn("_order", F.when(F.col("title") == "a", 9).otherwise(0))
    assert {r["title"] for r in ingest.upsert(old, ordered, ingest.THREAD_KEY, ingest.KEPT_ON_UPSERT).where("number = 1").collect()} == {"a"}


def test_numbers_of_new_rows(spark):
    from skein.operators.numbering import numbered

    rows = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5000).alias("k"))
    got = {r["k"]: r["n"] for r in numbered(rows, ("k",), "n", 10).collect()}
    assert got == {k: k + 11 for k in range(5000)} and numbered(rows.limit(0), ("k",), "n").count() == 0


def test_repositories_and_vectors(spark):
    old = table(spark, schemas.REPOSITORIES, {"id": 4, "full_name": "o/a", "name": "a"})
    new = table(spark, schemas.REPOSITORIES, {"full_name": "o/a", "name": "A"}, {"full_name": "o/b"}, {"full_name": "o/b"})
    assert {r["full_name"]: (r["id"], r["name"]) for r in ingest.upsert_repositories(old, new).collect()} == {"o/a": (4, "A"), "o/b": (5, None)}
    one = {"thread_id": 1, "basis": "b", "model": "m"}
    out = ingest.upsert_vectors(table(spark, schemas.THREAD_VECTORS, one | {"created_at": "a", "vector": [1.0]}), table(spark, schemas.THREAD_VECTORS, one | {"created_at": "z", "vector": [2.0]})).collect()
    assert [(r["created_at"], r["vector"]) for r in out] == [("a", [2.0])]


def test_store_and_stream(spark, tmp_path):
    store, folder = Store(spark, f"{tmp_path}/s"), tmp_path / "in"
    store.commit({"threads": threads(spark, thread(1), thread(2))})
    folder.mkdir()
    versions = [api_row(5, updated_at="2"), api_row(5, updated_at="3", title="last"), api_row(5, updated_at="1", state="closed")]
    (folder / "a.txt").write_text("\n".join([api_row(1), api_row(2, state="closed"), api_row(3), api_row(4, state="closed"), *versions]))
    for _ in range(2):
        stream_threads(spark, str(folder), store, 1, f"{tmp_path}/c", lambda n: NOW).awaitTermination()
    rows = {r["number"]: (r["title"], r["state"]) for r in store.table("threads").collect()}
    assert rows == {1: ("t1", "open"), 2: ("t2", "closed"), 3: ("t3", "open"), 5: ("last", "open")}
    assert store.tables() == ["threads"] and Store(spark, f"{tmp_path}/s").table("comments").count() == 0
    with pytest.raises(PermissionError):
        Store(spark, f"{tmp_path}/s", read_only=True).commit({})
    (tmp_path / "s" / "CURRENT").write_text('{"version": 99, "tables": {}}')
    with pytest.raises(ValueError):
        Store(spark, f"{tmp_path}/s")


def test_portable_copy(spark):
    own = threads(spark, thread(1, body="é" * 300, raw_json="{}"))
    out = portable.prune({"threads": own, "documents": own, "runs": own}, 10, NOW)
    row = out["threads"].first()
    assert {*out} == {"threads", "portable_metadata"} and (row["body_excerpt"], row["body_length"]) == ("é" * 10, 0) and "body" not in out["threads"].columns
    again = portable.prune_threads(out["threads"].withColumn("body", F.lit("longer text")), 5).first()
    assert (again["body_excerpt"], again["body_length"]) == ("longe", 11)
    made = portable.prune_stats({"threads": own, "documents": own, "runs": own}, out, 10).first()
    assert (made["threads_pruned"], made["documents_deleted"], made["dropped_tables"], made["dropped_columns"]) == (1, 1, ["documents", "runs"], ["threads.body", "threads.raw_json"])
    assert schemas.normalize_threads(out["threads"]).first()["body"] == "é" * 10


def test_cluster_inputs(spark):
    nodes = spark.createDataFrame([(k, k) for k in (1, 2, 3, 9)], "thread_id long, number long")
    edges = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8)], "left_id long, right_id long, score double")
    rows = {r["thread_id"]: r for r in cluster_inputs(nodes, edges, 1).collect()}
    assert (rows[2]["role"], rows[2]["score_to_representative"], rows[1]["score_to_representative"], rows[9]["cluster_type"]) == ("canonical", 1.0, 0.9, "singleton_orphan")
    assert rows[1]["stable_slug"].startswith(rows[1]["title"].removeprefix("Cluster ")) and cluster_inputs(nodes, edges, 1, min_size=2).count() == 3


def test_cluster_inputs_built_reads_its_tables_once(spark):
    rows = entry_point.queries()["cluster_inputs_built"](spark, "/root/testdata/sf0.001")
    assert not [f for f in rows.inputFiles() if "/testdata/" in f] and rows.where("role = 'canonical'").count() == rows.select("stable_key").distinct().count() > 0


def test_orders_runs_and_outputs(spark):
    rows = spark.createDataFrame([(3, 1, 2), (2, 9, 2), (7, 4, 5)], "representative long, number long, members long")
    assert [r["representative"] for r in ordered_clusters(rows).collect()] == [7, 2, 3]
    runs = commands.record_run(table(spark, schemas.RUNS), "sync", 1, commands.run_scope("open", [3, 5]), "success", NOW, LATER, {"n": 1})
    runs = commands.record_run(commands.record_run(runs, "sync", 1, commands.run_scope("open"), "failed", NOW, error="x"), "cluster", 1, "all", "success", NOW)
    assert [(r["kind"], r["id"], r["scope"], r["stats_json"]) for r in runs.collect()] == [("sync", 1, "numbers:3,5", '{"n": 1}'), ("sync", 2, "open", None), ("cluster", 1, "all", None)]
    with pytest.raises(ValueError):
        commands.record_run(runs, "nope", 1, "", "", NOW)
    assert [commands.expected_total(*a) for a in ((9, "open"), (9, "open", "", 4), (9, "closed"), (9, "open", NOW), (0, "open"))] == [9, 4, 0, 0, 0]
    done = commands.refresh(embed=lambda: 5, sync=lambda: 3)
    assert done == {"selected": {"sync": True, "embed": True, "cluster": False}, "sync": 3, "embed": 5}
    with pytest.raises(ValueError):
        commands.refresh()
    now, called = datetime(2024, 6, 1, tzinfo=timezone.utc), []
    for last in ("", "2024-05-31T00:00:00Z", "2024-05-31T23:59:00Z"):
        commands.searched_fresh(last, timedelta(hours=1), now, lambda: called.append(1), lambda: rows)
    assert len(called) == 2
    assert commands.output("t", {"a": 1}) == 't\n{\n  "a": 1\n}\n' and commands.output("t", 1, "json") == "1\n" and commands.output("t", rows.limit(1), "log").startswith("t=[{")
    with pytest.raises(PermissionError):
        commands.require_durable("run_cluster")
    assert commands.require_durable("durable_cluster") is None


def test_details_and_jumps(spark):
    own = threads(spark, *(thread(k) for k in (1, 2, 3)), thread(4, state="closed"), thread(5))
    runs = spark.createDataFrame([(2, 1, "success", NOW, LATER)], "id long, repo_id long, status string, started_at string, finished_at string")
    clusters = spark.createDataFrame([(7, 1, 2, 1, 2, NOW, None, None)], "id long, repo_id long, cluster_run_id long, representative_thread_id long, member_count long, created_at string, closed_at_local string, close_reason_local string")
    members = spark.createDataFrame([(7, 1, 1.0), (7, 2, 0.5)], "cluster_id long, thread_id long, score_to_representative double")
    groups = table(spark, schemas.CLUSTER_GROUPS, group(8, representative_thread_id=3), group(9, representative_thread_id=4, status="closed", closed_at=NOW))
    ships = table(spark, schemas.CLUSTER_MEMBERSHIPS, member(8, 3, "canonical"), member(8, 2), member(9, 4, "canonical"))
    t = commands.Tables(runs, clusters, members, groups, ships, table(spark, schemas.CLUSTER_CLOSURES), own)
    summary, rows = commands.cluster_detail(t, 1, 7)
    assert summary.first()["source"] == "run_cluster" and [r["number"] for r in rows.collect()] == [1, 2]
    summary, rows = commands.cluster_detail(t, 1, 8)
    assert summary.first()["source"] == "durable_cluster" and {r["number"] for r in rows.collect()} == {3, 2}
    with pytest.raises(LookupError):
        commands.cluster_detail(t, 1, 99)
    loaded = reports.durable_summaries(groups, ships, own, 1).withColumn("position", F.lit(0).cast("long"))
    to = commands.jump(t, 1, 3, loaded, commands.View(query="nothing", min_size=5))
    assert (to.cluster_id, to.view, to.has_member, to.clusters.count()) == (8, commands.View(), True, 1)
    to = commands.jump(t, 1, 4, loaded, commands.View(min_size=1))
    assert (to.cluster_id, to.view.show_closed, {r["id"] for r in to.clusters.collect()}) == (9, True, {8, 9})
    with pytest.raises(LookupError):
        commands.jump(t, 1, 5, loaded, commands.View())


def test_entry_point(spark):
    assert entry_point.entry(spark).columns == ["thread_id", "number", "kind", "title", "score"]
    assert {*entry_point.oracle_sql()} <= {*entry_point.queries()}
