"""The engine's queries over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from skein.functions import display
from skein.functions.keys import content_hash, default_words, human_key
from skein.functions.text import age_label, clean_title, first_present, label_names, links, overlap, reference_evidence, title_tokens, without_controls
from skein.functions.vectors import cosine
from skein.operators import commands, documents as docs_op, governance, ingest, portable, reports, search, similarity, threads as threads_op
from skein.operators.clusters import cluster_inputs
from skein.operators.graph import bounded_clusters, components
from skein.operators.neighbors import list_vectors, neighbors, top_k
from skein.plans import fixtures as fx
from skein.plans.views_sql import sql
from skein.streaming.incremental import kind_counts

#: Thresholds that suit the synthetic vectors.
POLICY = similarity.EdgePolicy(threshold=0.20, confident=0.35, title_overlap=0.18, cross_kind=0.30, fanout=4)
NOW = "2024-06-01T00:00:00Z"
REPO = 1

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE[f.__name__] = oracle
        return f

    return add


_NEIGHBORS = """
  SELECT v.thread_id, t.number, t.kind, t.title, round(list_cosine_similarity(v.vector, q.vector), 6) AS score FROM vectors v JOIN threads t ON t.id = v.thread_id AND t.state = 'open' AND t.closed_at_local IS NULL,
    (SELECT vector, model FROM vectors WHERE thread_id = 0) q
  WHERE v.thread_id <> 0 {model} AND list_cosine_similarity(v.vector, q.vector) >= 0.2
  ORDER BY list_cosine_similarity(v.vector, q.vector) DESC, v.thread_id LIMIT 10"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


@query(sql(_NEIGHBORS.format(model="AND v.model = q.model"), "vectors", "threads"))
def neighbors_of_thread(spark, sf_dir):
    return _rounded(neighbors(fx.threads_doc(spark, sf_dir), fx.thread_vectors(spark, sf_dir), REPO, 100, limit=10, threshold=0.2))


@query(sql(_NEIGHBORS.format(model=""), "vectors", "threads"))
def neighbors_any_model(spark, sf_dir):
    rows = list_vectors(fx.threads_doc(spark, sf_dir), fx.thread_vectors(spark, sf_dir), REPO)
    target = fx.thread_vectors(spark, sf_dir).where("thread_id = 0").first()["vector"]
    return _rounded(top_k(rows, target, exclude=0, k=10, threshold=0.2)).select("thread_id", "number", "kind", "title", "score")


_OPENED = "SELECT id, number, kind, state, title FROM threads WHERE closed_at_local IS NULL"


@query(sql(f"{_OPENED}", "threads"))
def threads_list(spark, sf_dir):
    return threads_op.list_threads(fx.threads_doc(spark, sf_dir), REPO).select("id", "number", "kind", "state", "title")


@query(sql("SELECT id, number, kind, state, title FROM threads WHERE number IN (105, 111, 120, 99999) ORDER BY number", "threads"))
def threads_by_numbers(spark, sf_dir):
    return threads_op.list_threads(fx.threads_doc(spark, sf_dir), REPO, include_closed=True, numbers=[111, 105, 105, 120, 99999]).select("id", "number", "kind", "state", "title")


@query(sql(f"{_OPENED} AND state = 'open' AND kind = 'issue' ORDER BY coalesce(updated_at_gh, updated_at) DESC, number DESC LIMIT 50", "threads"))
def threads_recent(spark, sf_dir):
    rows = search.search_threads(fx.threads_doc(spark, sf_dir), fx.documents(spark, sf_dir), REPO, "", kind="issue", state="open", limit=50)
    return rows.select("id", "number", "kind", "state", "title")


@query(sql("SELECT s_suppkey AS id, 'o/' || s_name AS full_name FROM supplier ORDER BY '2024-01-' || lpad((1 + s_nationkey % 28)::VARCHAR, 2, '0') DESC, s_suppkey DESC LIMIT 1"))
def repo_default(spark, sf_dir):
    return reports.list_repositories(fx.repositories(spark, sf_dir), 1).select("id", "full_name")


@query(sql("SELECT id, kind, status, finished_at FROM runs WHERE kind = 'sync' AND repo_id = 1 ORDER BY id DESC LIMIT 20", "runs"))
def runs_by_kind(spark, sf_dir):
    return reports.list_runs(fx.runs(spark, sf_dir), REPO, "sync").select("id", "kind", "status", "finished_at")


@query(sql("SELECT repo_id, max(finished_at) AS last_sync_at FROM runs WHERE kind = 'sync' AND status = 'success' GROUP BY repo_id", "runs"))
def last_sync(spark, sf_dir):
    return reports.last_sync(fx.runs(spark, sf_dir))


@query(sql("""SELECT (SELECT count(*) FROM supplier) AS repository_count, (SELECT count(*) FROM threads) AS thread_count, (SELECT count(*) FROM threads WHERE state = 'open' AND closed_at_local IS NULL) AS open_thread_count,
  (SELECT count(*) FROM orders) AS cluster_count, (SELECT max(finished_at) FROM runs WHERE kind = 'sync' AND status = 'success') AS last_sync_at""", "threads", "runs"))  # fmt: skip
def status(spark, sf_dir):
    return reports.status(fx.repositories(spark, sf_dir), fx.threads_doc(spark, sf_dir), fx.cluster_groups(spark, sf_dir), fx.runs(spark, sf_dir))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_HAS = f"(contains({_LOWER.format('title')}, '{{0}}') OR contains({_LOWER.format('body')}, '{{0}}'))"


@query(sql(f"SELECT id AS thread_id, number, kind, state, title, coalesce(nullif(body, ''), title) AS snippet FROM threads WHERE {_HAS.format('mit license')} ORDER BY coalesce(updated_at_gh, updated_at) DESC, number DESC LIMIT 20", "threads"))
def search_like(spark, sf_dir):
    return threads_op.search_like(fx.threads_doc(spark, sf_dir), REPO, "MIT License").drop("html_url", "author_login")


@query(sql(f"SELECT id, number, kind FROM threads WHERE closed_at_local IS NULL AND state = 'open' AND kind = 'issue' AND {_HAS.format('license')} ORDER BY coalesce(updated_at_gh, updated_at) DESC, number DESC LIMIT 20", "threads"))
def search_filtered_like(spark, sf_dir):
    return threads_op.search_threads_like(fx.threads_doc(spark, sf_dir), REPO, "license", kind="issue", state="open").select("id", "number", "kind")


def _bm25_sql(*terms: str) -> str:
    """BM25 over whole columns: a token list for each document, and the terms counted in it."""
    tokens = " || ".join(f"regexp_extract_all(strip_accents(lower(coalesce({c}, ''))), '[\\p{{L}}\\p{{N}}]+')" for c in ("title", "body", "raw_text", "dedupe_text"))
    parts = [f"len(list_filter(tokens, lambda x: x = '{t}')) AS f{k}" for k, t in enumerate(terms)]
    idf = [f"(SELECT CASE WHEN ln((n.d - n.c + 0.5) / (n.c + 0.5)) <= 0 THEN 1e-6 ELSE ln((n.d - n.c + 0.5) / (n.c + 0.5)) END FROM (SELECT count(*)::DOUBLE AS d, count(*) FILTER (f{k} > 0) AS c FROM c) n)" for k in range(len(terms))]
    score = " + ".join(f"{i} * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * size / (SELECT avg(size) FROM c)))" for k, i in enumerate(idf))
    return sql(f"SELECT thread_id, round(-({score}), 6) AS score FROM c WHERE {' AND '.join(f'f{k} > 0' for k in range(len(terms)))}", "docs", recursive=f"k AS (SELECT thread_id, {tokens} AS tokens FROM docs), c AS (SELECT thread_id, len(tokens) AS size, {', '.join(parts)} FROM k)")


@cache
def _index(application: str, sf_dir: str) -> search.Index:
    """Documents are indexed once an application, as they would be when they come in. The driver's table is one file, so it
    is dealt to all cores first."""
    spark = SparkSession.active()
    return search.index_documents(fx.documents(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism))


def _indexed(spark, sf_dir) -> search.Index:
    return _index(spark.sparkContext.applicationId, sf_dir)


def _scores(spark, sf_dir, text: str) -> DataFrame:
    return search.bm25(_indexed(spark, sf_dir), text).select(F.col("doc_id").alias("thread_id"), F.round("score", 6).alias("score"))


@query(_bm25_sql("license"))
def search_bm25(spark, sf_dir):
    return _scores(spark, sf_dir, "License")


@query(_bm25_sql("license", "with"))
def search_bm25_and(spark, sf_dir):
    return _scores(spark, sf_dir, "license WITH")


@query(_bm25_sql("the"))
def search_bm25_common_term(spark, sf_dir):
    return _scores(spark, sf_dir, "the")


@query(sql(f"SELECT id AS thread_id, number FROM threads WHERE {_HAS.format('icense, versio')} ORDER BY coalesce(updated_at_gh, updated_at) DESC, number DESC LIMIT 20", "threads"))
def search_fallback(spark, sf_dir):
    return search.search_documents(fx.threads_doc(spark, sf_dir), fx.documents(spark, sf_dir), REPO, "icense, versio", index=_indexed(spark, sf_dir)).select("thread_id", "number")


@query(sql("""SELECT number, title, state, html_url AS url, coalesce(updated_at_gh, updated_at) AS "updatedAt", author_login AS login, lang AS label FROM threads""", "threads"))
def issue_fields(spark, sf_dir):
    rows = threads_op.select_fields(fx.threads_doc(spark, sf_dir), "number,title,state,url,updatedAt,labels,author")
    return rows.select("number", "title", "state", "url", "updatedAt", F.col("author.login").alias("login"), F.get("labels", F.lit(0))["name"].alias("label"))


@query(sql("SELECT thread_id, sha256(raw_text) AS raw_sha, sha256(dedupe_text) AS dedupe_sha FROM docs", "docs"))
def doc_build(spark, sf_dir):
    return fx.documents(spark, sf_dir).select("thread_id", F.sha2("raw_text", 256).alias("raw_sha"), F.sha2("dedupe_text", 256).alias("dedupe_sha"))


@query(sql("SELECT id, lang AS labels FROM threads", "threads"))
def label_texts(spark, sf_dir):
    return fx.threads_doc(spark, sf_dir).select("id", F.array_join(label_names(F.col("labels_json")), ",").alias("labels"))


@query(sql("SELECT id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(title), '[A-Za-z0-9]{4,}'))), ' ') AS tokens FROM threads", "threads"))
def title_token_sets(spark, sf_dir):
    return fx.threads_doc(spark, sf_dir).select("id", F.array_join(F.array_sort(title_tokens(F.col("title"))), " ").alias("tokens"))


@query(sql("""SELECT a.id, round(CASE WHEN least(len(a.k), len(b.k)) = 0 THEN 0 ELSE len(list_intersect(a.k, b.k))::DOUBLE / least(len(a.k), len(b.k)) END, 6) AS titled FROM
  (SELECT id, list_distinct(regexp_extract_all(lower(title), '[A-Za-z0-9]{4,}')) AS k FROM threads) a JOIN (SELECT id, list_distinct(regexp_extract_all(lower(title), '[A-Za-z0-9]{4,}')) AS k FROM threads) b ON b.id = a.id + 1""", "threads"))  # fmt: skip
def title_overlap(spark, sf_dir):
    rows = fx.threads_doc(spark, sf_dir).select("id", title_tokens(F.col("title")).alias("k"))
    after = rows.select((F.col("id") - 1).alias("id"), F.col("k").alias("k2"))
    return rows.join(after, "id").select("id", F.round(overlap(F.col("k"), F.col("k2")), 6).alias("titled"))


@query(sql("SELECT id, ref_number, false AS in_title, early_body FROM refs", "refs"))
def refs_by_location(spark, sf_dir):
    found = fx.threads_doc(spark, sf_dir).select("id", F.explode(reference_evidence(F.lit(""), F.col("body"), F.col("number"))).alias("r"))
    return found.select("id", F.col("r.number").alias("ref_number"), F.col("r.in_title").alias("in_title"), F.col("r.early_body").alias("early_body"))


_WORDS = "[" + ", ".join(f"'{w}'" for w in default_words()) + "]"
_BYTE = "('0x' || substr(h, {}, 2))::INT % 248 + 1"
_DIGIT = "substr('0123456789abcdefghijklmnopqrstuvwxyz', ((('0x' || substr(h, 7, 6))::BIGINT // {}) % 36 + 1)::INT, 1)"


@query(sql(f"SELECT id, h AS hash, w[{_BYTE.format(1)}] || '-' || w[{_BYTE.format(3)}] || '-' || w[{_BYTE.format(5)}] AS slug, {' || '.join(_DIGIT.format(36**k) for k in (3, 2, 1, 0))} AS checksum FROM (SELECT id, sha256('repo:1:cluster-representative:' || id) AS h, {_WORDS} AS w FROM threads)", "threads"))
def human_keys(spark, sf_dir):
    key = human_key(F.concat(F.lit("repo:1:cluster-representative:"), F.col("id").cast("string")))
    return fx.threads_doc(spark, sf_dir).select("id", key.alias("k")).select("id", "k.hash", "k.slug", "k.checksum")


@query(sql("SELECT id, sha256(title || chr(0) || body || chr(0) || labels_json || chr(0)) AS hash FROM threads", "threads"))
def content_hashes(spark, sf_dir):
    return fx.threads_doc(spark, sf_dir).select("id", content_hash(F.col("title"), F.col("body"), F.col("labels_json")).alias("hash"))


_TEXT = r"""SELECT id, number, coalesce(updated_at_gh, updated_at) AS newest, regexp_replace(title || CASE WHEN trim(body) <> '' THEN chr(10) || chr(10) || regexp_replace(body, '^\s+|\s+$', '', 'g') ELSE '' END, '^\s+|\s+$', '', 'g') AS whole FROM threads WHERE state = 'open' AND closed_at_local IS NULL"""
_TASK = "id AS thread_id, number, sha256('embedding:v2:max_runes=24000:title_original:m0' || chr(10) || substr(whole, 1, 6000)) AS content_hash, len(whole) > 6000 AS text_truncated, len(whole) AS original_text_runes"


def _queue(spark, sf_dir, **options) -> DataFrame:
    # Every third thread has a vector of its present text.
    threads, docs, none = fx.threads_doc(spark, sf_dir), fx.documents(spark, sf_dir), fx.thread_vectors(spark, sf_dir)
    keyed = docs_op.latest_key_summaries(fx.revisions(spark, sf_dir), fx.key_summaries(spark, sf_dir))
    fresh = docs_op.embedding_tasks(threads, docs, none.limit(0), keyed, REPO, model="m0", include_closed=True)
    made = fresh.where("thread_id % 3 = 0").select("thread_id", F.lit("title_original").alias("basis"), F.lit("m0").alias("model"), "content_hash")
    return docs_op.embedding_tasks(threads, docs, made, keyed, REPO, model="m0", **options)


@query(sql(f"SELECT {_TASK} FROM ({_TEXT}) WHERE id % 3 <> 0", "threads"))
def embed_queue(spark, sf_dir):
    return _queue(spark, sf_dir).select("thread_id", "number", "content_hash", "text_truncated", "original_text_runes")


@query(sql(f"SELECT {_TASK} FROM (SELECT * FROM ({_TEXT}) ORDER BY newest DESC, number DESC LIMIT 40) WHERE id % 3 <> 0", "threads"))
def embed_queue_limit_before_skip(spark, sf_dir):
    return _queue(spark, sf_dir, limit=40).select("thread_id", "number", "content_hash", "text_truncated", "original_text_runes")


@query(sql("SELECT thread_id, key_text FROM keyed QUALIFY row_number() OVER (PARTITION BY thread_id ORDER BY created_at DESC, id DESC) = 1", "keyed"))
def key_summary_latest(spark, sf_dir):
    return docs_op.latest_key_summaries(fx.revisions(spark, sf_dir), fx.key_summaries(spark, sf_dir))


@query(sql("SELECT thread_id, kind AS summary_kind, key_text AS summary FROM keyed WHERE thread_id IN (SELECT id FROM threads) QUALIFY row_number() OVER (PARTITION BY thread_id, kind ORDER BY created_at DESC, id DESC) = 1", "keyed", "threads"))
def member_summary_texts(spark, sf_dir):
    none = spark.createDataFrame([], "id long, thread_id long, summary_kind string, summary_text string, updated_at string")
    rows = reports.member_summaries(fx.threads_doc(spark, sf_dir), none, fx.revisions(spark, sf_dir), fx.key_summaries(spark, sf_dir))
    return rows.select("thread_id", F.explode("summaries").alias("summary_kind", "summary"))


def _nodes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    threads = fx.threads_doc(spark, sf_dir)
    return threads, list_vectors(threads, fx.thread_vectors(spark, sf_dir), REPO)


@query(sql("SELECT left_id, right_id, round(score, 6) AS score FROM pairs", "pairs"))
def cosine_pairs(spark, sf_dir):
    return _rounded(similarity.cosine_pairs(_nodes(spark, sf_dir)[1], POLICY.threshold))


@query(sql("SELECT left_id, right_id, round(score, 6) AS score FROM near", "near"))
def edges_filtered(spark, sf_dir):
    threads, vectors = _nodes(spark, sf_dir)
    return _rounded(similarity.filter_edges(similarity.cosine_pairs(vectors, POLICY.threshold), threads, POLICY))


@query(sql("SELECT left_id, right_id, round(score, 6) AS score FROM all_edges", "all_edges"))
def edges_with_refs(spark, sf_dir):
    threads, vectors = _nodes(spark, sf_dir)
    own = threads.join(vectors.select(F.col("thread_id").alias("id")), "id", "left_semi")
    similar = similarity.filter_edges(similarity.cosine_pairs(vectors, POLICY.threshold), own, POLICY)
    return _rounded(similarity.merge_edges(similar, similarity.reference_edges(own, POLICY)))


def _edges(spark, sf_dir) -> DataFrame:
    threads, vectors = _nodes(spark, sf_dir)
    return similarity.build_edges(threads, vectors, POLICY)


@query(sql("SELECT left_id, right_id, round(score, 6) AS score FROM best", "best"))
def edges_topk(spark, sf_dir):
    return _rounded(_edges(spark, sf_dir))


@query(sql("SELECT node, min(reached) AS component FROM walk GROUP BY node", "best", recursive="""
  ends AS (SELECT left_id AS a, right_id AS b FROM best WHERE score >= 0.4 UNION SELECT right_id, left_id FROM best WHERE score >= 0.4),
  walk AS (SELECT a AS node, a AS reached FROM ends UNION SELECT w.node, e.b FROM walk w JOIN ends e ON w.reached = e.a)"""))  # fmt: skip
def components_of_edges(spark, sf_dir):
    return components(_edges(spark, sf_dir).where("score >= 0.4"), "left_id", "right_id")


#: Edge after edge, the root of every node as a list; an edge whose components are too large together is passed over.
_GREEDY = """
  nodes AS (SELECT thread_id, number, row_number() OVER (ORDER BY thread_id) AS i FROM sides),
  ranked AS (SELECT a.i AS a, b.i AS b, row_number() OVER (ORDER BY e.score DESC, e.left_id, e.right_id) AS k FROM best e JOIN nodes a ON a.thread_id = e.left_id JOIN nodes b ON b.thread_id = e.right_id),
  walk AS (
    SELECT 0::BIGINT AS k, (SELECT list(i ORDER BY i) FROM nodes) AS r, false AS taken, 0::BIGINT AS a, 0::BIGINT AS b
    UNION ALL
    SELECT k, CASE WHEN taken THEN list_transform(r, lambda x: CASE WHEN x = rb THEN ra ELSE x END) ELSE r END, taken, a, b FROM (
      SELECT *, ra = rb OR len(list_filter(r, lambda x: x = ra OR x = rb)) <= 10 AS taken FROM (
        SELECT e.k, e.a, e.b, w.r, w.r[e.a] AS ra, w.r[e.b] AS rb FROM walk w JOIN ranked e ON e.k = w.k + 1))),
  rooted AS (SELECT n.thread_id, n.number, w.r[n.i] AS root, coalesce(d.degree, 0) AS degree
    FROM nodes n, (SELECT r FROM walk ORDER BY k DESC LIMIT 1) w LEFT JOIN (SELECT i, count(*) AS degree FROM (SELECT a AS i FROM walk WHERE taken UNION ALL SELECT b FROM walk WHERE taken) GROUP BY i) d ON d.i = n.i),
  cut AS (SELECT thread_id, number, first(thread_id) OVER best_first AS representative, count(*) OVER (PARTITION BY root) AS members FROM rooted WINDOW best_first AS (PARTITION BY root ORDER BY degree DESC, number, thread_id))"""


@query(sql("SELECT thread_id, number, representative, members FROM cut", "sides", "best", recursive=_GREEDY))
def clusters_bounded(spark, sf_dir):
    return bounded_clusters(_nodes(spark, sf_dir)[1], _edges(spark, sf_dir), max_size=10)


_SLUG = f"w[{_BYTE.format(1)}] || '-' || w[{_BYTE.format(3)}] || '-' || w[{_BYTE.format(5)}]"


@query(sql(f"""SELECT h AS stable_key, slug || '-' || {' || '.join(_DIGIT.format(36**k) for k in (3, 2, 1, 0))} AS stable_slug, CASE WHEN members = 1 THEN 'singleton_orphan' ELSE 'duplicate_candidate' END AS cluster_type, representative AS representative_thread_id,
    'Cluster ' || slug AS title, thread_id, number, CASE WHEN thread_id = representative THEN 'canonical' ELSE 'related' END AS role, round(CASE WHEN thread_id = representative THEN 1.0 ELSE score END, 6) AS score
  FROM (SELECT *, {_SLUG} AS slug FROM (SELECT c.*, sha256('repo:1:cluster-representative:' || representative) AS h, {_WORDS} AS w, e.score FROM cut c LEFT JOIN best e ON e.left_id = least(c.thread_id, c.representative) AND e.right_id = greatest(c.thread_id, c.representative)))""", "sides", "best", recursive=_GREEDY))  # fmt: skip
def cluster_inputs_built(spark, sf_dir):
    rows = cluster_inputs(_nodes(spark, sf_dir)[1], _edges(spark, sf_dir), REPO, min_size=1, max_size=10)
    return rows.withColumn("score", F.round("score_to_representative", 6)).drop("score_to_representative")


def _durable(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    return fx.cluster_groups(spark, sf_dir), fx.cluster_memberships(spark, sf_dir), fx.threads_part(spark, sf_dir)


_DURABLE_OPEN = "(SELECT g.*, (SELECT count(*) FROM visible v WHERE v.cluster_id = g.id AND v.state = 'active') AS n FROM groups g WHERE g.repo_id = 1 AND g.status = 'active' AND g.closed_at IS NULL)"
_DURABLE_ALL = "(SELECT g.*, coalesce(c.n, 0) AS n FROM groups g LEFT JOIN (SELECT cluster_id, count(*) AS n FROM members WHERE state = 'active' GROUP BY cluster_id) c ON c.cluster_id = g.id WHERE g.repo_id = 1)"
_DURABLE = "SELECT d.id, d.stable_slug, d.status, d.title, coalesce(d.lead, 0) AS representative_thread_id, coalesce(p.number, 0) AS representative_number, d.n AS member_count, d.updated_at FROM {} d LEFT JOIN parts p ON p.id = d.lead WHERE d.n >= {}"
_DURABLE_COLUMNS = ("id", "stable_slug", "status", "title", "representative_thread_id", "representative_number", "member_count", "updated_at")


def _durable_query(name: str, rows: str, **options) -> None:
    def run(spark, sf_dir):
        return reports.durable_summaries(*_durable(spark, sf_dir), REPO, **options).select(*_DURABLE_COLUMNS)

    run.__name__ = name
    query(sql(_DURABLE.format(rows, options.get("min_size", 1)), "groups", "members", "parts", "visible"))(run)


_durable_query("durable_open_recent", _DURABLE_OPEN)
_durable_query("durable_open_size", _DURABLE_OPEN, sort="size", min_size=2)
_durable_query("durable_open_oldest", _DURABLE_OPEN, sort="oldest")
_durable_query("durable_all_recent", _DURABLE_ALL, include_closed=True)
_durable_query("durable_all_size", _DURABLE_ALL, include_closed=True, sort="size")
_durable_query("durable_all_oldest", _DURABLE_ALL, include_closed=True, sort="oldest", min_size=3)

_RUN = "(SELECT r.id, r.rep, r.member_count, r.created_at, r.close_reason, max(t.updated_at) AS latest, count(*) FILTER (t.state <> 'open') AS gone FROM raw r JOIN lines l ON l.l_orderkey = r.id JOIN parts t ON t.id = l.l_partkey WHERE r.run = 2 GROUP BY ALL)"
_RUN_COLUMNS = ("id", "status", "representative_thread_id", "member_count", "updated_at")


def _raw(spark, sf_dir):
    return fx.raw_runs(spark, sf_dir), fx.raw_clusters(spark, sf_dir), fx.raw_members(spark, sf_dir), fx.threads_part(spark, sf_dir)


_RUN_SELECT = "SELECT id, CASE WHEN close_reason IS NOT NULL OR gone >= member_count THEN 'closed' ELSE 'active' END AS status, rep AS representative_thread_id, member_count, coalesce(latest, created_at) AS updated_at FROM "


@query(sql(f"{_RUN_SELECT} {_RUN}", "raw", "lines", "parts"))
def run_summary(spark, sf_dir):
    return reports.run_summaries(*_raw(spark, sf_dir), REPO).select(*_RUN_COLUMNS)


@query(sql(f"{_RUN_SELECT} {_RUN} WHERE close_reason IS NULL AND gone < member_count AND member_count >= 2", "raw", "lines", "parts"))
def run_summary_hide_closed(spark, sf_dir):
    return reports.run_summaries(*_raw(spark, sf_dir), REPO, include_closed=False, min_size=2, sort="size").select(*_RUN_COLUMNS)


@query("SELECT 2::BIGINT AS run_id")
def latest_run(spark, sf_dir):
    return spark.range(1).select(F.lit(reports.latest_run(fx.raw_runs(spark, sf_dir), fx.raw_clusters(spark, sf_dir), REPO)).cast("long").alias("run_id"))


_CLOSED = """SELECT g.id, coalesce(g.lead, 0) AS representative_thread_id, c.n AS member_count, c.latest AS updated_at, coalesce(k.updated_at, g.closed_at, '') AS closed_at FROM groups g JOIN
  (SELECT m.cluster_id, count(*) AS n, max(t.updated_at) AS latest, count(*) FILTER (t.state <> 'open') AS gone FROM members m JOIN parts t ON t.id = m.thread_id GROUP BY m.cluster_id) c ON c.cluster_id = g.id LEFT JOIN closures k ON k.cluster_id = g.id
  WHERE g.repo_id = 1 AND c.n >= 2 AND (k.cluster_id IS NOT NULL OR g.status IN ('closed', 'merged', 'split') OR c.gone >= c.n)"""


@query(sql(_CLOSED, "groups", "members", "parts", "closures"))
def closed_history_candidates(spark, sf_dir):
    rows = reports.closed_candidates(*_durable(spark, sf_dir), fx.cluster_closures(spark, sf_dir), REPO, min_size=2)
    return rows.select("id", "representative_thread_id", "member_count", "updated_at", "closed_at")


def _closed_sql(shown: str) -> str:
    """Closed candidates but those that shown leaves out, and of them those that overlap none before them that stays, one
    after another; cands and kept are what a statement selects from."""
    return f"""
  cands AS (SELECT *, row_number() OVER (ORDER BY member_count DESC, updated_at DESC, id) AS place FROM (
    SELECT g.id, g.stable_slug, g.title, coalesce(g.lead, 0) AS representative_thread_id, c.n AS member_count, c.latest AS updated_at, coalesce(k.updated_at, g.closed_at, '') AS closed_at, c.who
    FROM groups g JOIN (SELECT m.cluster_id, count(*) AS n, max(t.updated_at) AS latest, count(*) FILTER (t.state <> 'open') AS gone, list(DISTINCT t.id) AS who FROM members m JOIN parts t ON t.id = m.thread_id GROUP BY m.cluster_id) c ON c.cluster_id = g.id
    LEFT JOIN closures k ON k.cluster_id = g.id WHERE g.repo_id = 1 AND (k.cluster_id IS NOT NULL OR g.status IN ('closed', 'merged', 'split') OR c.gone >= c.n)) WHERE {shown}),
  held AS (SELECT place, len(who) AS n, unnest(who) AS t FROM cands),
  close AS (SELECT b.place, list(a.place) AS before FROM (SELECT a.place AS a, b.place AS b FROM held a JOIN held b ON a.t = b.t AND a.place < b.place GROUP BY a.place, b.place, a.n, b.n HAVING count(*) >= 0.8 * least(a.n, b.n)) p JOIN cands a ON a.place = p.a JOIN cands b ON b.place = p.b GROUP BY b.place),
  steps AS (SELECT place, before, row_number() OVER (ORDER BY place) AS k FROM close),
  decided AS (
    SELECT 0::BIGINT AS k, []::BIGINT[] AS gone UNION ALL
    SELECT s.k, CASE WHEN len(list_filter(s.before, lambda x: NOT list_contains(d.gone, x))) > 0 THEN list_append(d.gone, s.place) ELSE d.gone END FROM decided d JOIN steps s ON s.k = d.k + 1),
  kept AS (SELECT c.*, coalesce(p.number, 0) AS representative_number, coalesce(p.kind, '') AS representative_kind, coalesce(p.title, '') AS representative_title FROM cands c LEFT JOIN parts p ON p.id = c.representative_thread_id
    WHERE NOT list_contains((SELECT gone FROM decided ORDER BY k DESC LIMIT 1), c.place))"""


_SUMMARY = "id, 'durable_cluster' AS source, stable_slug, 'closed' AS status, title, representative_thread_id, representative_number, representative_kind, representative_title, member_count, updated_at, closed_at"


@query(sql(f"SELECT {_SUMMARY} FROM kept", "groups", "members", "parts", "closures", recursive=_closed_sql("true")))
def closed_history_dedupe(spark, sf_dir):
    return reports.drop_overlapping(reports.closed_candidates(*_durable(spark, sf_dir), fx.cluster_closures(spark, sf_dir), REPO))


_SHOWN = f"""(SELECT id, 'run_cluster' AS source, {_SLUG} AS stable_slug, status, '' AS title, rep AS representative_thread_id, number AS representative_number, kind AS representative_kind, ptitle AS representative_title, member_count, updated_at, '' AS closed_at
  FROM (SELECT r.*, p.number, p.kind, p.title AS ptitle, sha256(CASE WHEN r.rep <> 0 THEN 'repo:1:cluster-representative:' || r.rep ELSE 'repo:1:cluster:' || r.id END) AS h, {_WORDS} AS w, CASE WHEN close_reason IS NOT NULL OR gone >= member_count THEN 'closed' ELSE 'active' END AS status, coalesce(latest, created_at) AS updated_at FROM {_RUN} r LEFT JOIN parts p ON p.id = r.rep))"""


@query(sql(f"SELECT * FROM {_SHOWN} UNION ALL SELECT {_SUMMARY} FROM kept", "raw", "lines", "groups", "members", "parts", "closures", recursive=_closed_sql(f"representative_thread_id NOT IN (SELECT rep FROM {_RUN} WHERE rep <> 0)")))
def display_list(spark, sf_dir):
    runs, clusters, members, threads = _raw(spark, sf_dir)
    return reports.display_summaries(runs, clusters, members, *_durable(spark, sf_dir)[:2], threads, fx.cluster_closures(spark, sf_dir), REPO)


@query(sql(f"SELECT id, member_count, updated_at FROM ({_RUN_SELECT} {_RUN} WHERE close_reason IS NULL AND gone < member_count)", "raw", "lines", "parts"))
def display_list_open(spark, sf_dir):
    runs, clusters, members, threads = _raw(spark, sf_dir)
    rows = reports.display_summaries(runs, clusters, members, *_durable(spark, sf_dir)[:2], threads, fx.cluster_closures(spark, sf_dir), REPO, include_closed=False)
    return rows.select("id", "member_count", "updated_at")


_DETAIL = "role, m.state, score AS score_to_representative, thread_id, t.number, substr(t.body, 1, 12) AS body_snippet"
_RANK = "CASE role WHEN 'canonical' THEN 0 WHEN 'representative' THEN 1 ELSE 2 END"


@query(sql(f"SELECT {_DETAIL} FROM members m JOIN parts t ON t.id = m.thread_id WHERE cluster_id = (SELECT min(id) FROM groups WHERE repo_id = 1) ORDER BY {_RANK}, coalesce(score, 0) DESC, t.number LIMIT 20", "groups", "members", "parts"))
def cluster_detail_durable(spark, sf_dir):
    groups, memberships, threads = _durable(spark, sf_dir)
    own = groups.where(F.col("repo_id") == REPO).agg(F.min("id")).first()[0]
    rows = reports.durable_detail(groups, memberships, threads, own, include_closed=True, body_chars=12)
    return rows.select("role", "state", "score_to_representative", "thread_id", "number", "body_snippet")


@query(sql("""SELECT CASE WHEN t.id = r.rep THEN 'representative' ELSE 'member' END AS role, l_discount AS score_to_representative, t.id AS thread_id, t.kind FROM raw r JOIN lines ON l_orderkey = r.id JOIN parts t ON t.id = l_partkey AND t.state = 'open'
  WHERE r.id = (SELECT max(id) FROM raw WHERE run = 2) ORDER BY CASE WHEN t.id = r.rep THEN 0 ELSE 1 END, l_discount DESC, CASE t.kind WHEN 'issue' THEN 0 ELSE 1 END, t.updated_at DESC, t.number DESC LIMIT 20""", "raw", "lines", "parts"))  # fmt: skip
def cluster_detail_run(spark, sf_dir):
    _, clusters, members, threads = _raw(spark, sf_dir)
    own = clusters.where("cluster_run_id = 2").agg(F.max("id")).first()[0]
    return reports.run_detail(clusters, members, threads, own, 2).select("role", "score_to_representative", "thread_id", "kind")


@query(sql(f"""SELECT number, id AS cluster_id FROM (SELECT t.number, g.id, row_number() OVER (PARTITION BY t.number ORDER BY CASE v.state WHEN 'active' THEN 0 ELSE 1 END, CASE g.status WHEN 'active' THEN 0 ELSE 1 END, {_RANK}, g.updated_at DESC, g.id DESC) AS nth
  FROM members v JOIN groups g ON g.id = v.cluster_id JOIN parts t ON t.id = v.thread_id) WHERE nth = 1""", "members", "groups", "parts"))  # fmt: skip
def cluster_of_thread(spark, sf_dir):
    return reports.cluster_of_thread(*_durable(spark, sf_dir), REPO, include_closed=True)


@query(sql(f"""SELECT number, id AS cluster_id FROM (SELECT t.number, g.id, row_number() OVER (PARTITION BY t.number ORDER BY {_RANK}, g.updated_at DESC, g.id DESC) AS nth
  FROM visible v JOIN groups g ON g.id = v.cluster_id AND g.status = 'active' AND g.closed_at IS NULL JOIN parts t ON t.id = v.thread_id WHERE v.state = 'active') WHERE nth = 1""", "visible", "groups", "parts"))  # fmt: skip
def cluster_of_open_thread(spark, sf_dir):
    return reports.cluster_of_thread(*_durable(spark, sf_dir), REPO)


_AFTER = """SELECT m.cluster_id, m.thread_id,
    CASE WHEN i.thread_id IS NOT NULL THEN 'active' WHEN x.thread_id IS NOT NULL THEN 'excluded' ELSE m.state END AS state,
    CASE WHEN k.lead IS NOT NULL AND (CASE WHEN i.thread_id IS NOT NULL THEN 'active' WHEN x.thread_id IS NOT NULL THEN 'excluded' ELSE m.state END) = 'active' THEN CASE WHEN m.thread_id = k.lead THEN 'canonical' ELSE 'member' END ELSE m.role END AS role
  FROM members m LEFT JOIN (SELECT cluster_id, thread_id FROM overrides WHERE action = 'exclude') x USING (cluster_id, thread_id) LEFT JOIN (SELECT cluster_id, thread_id FROM overrides WHERE action = 'include') i USING (cluster_id, thread_id)
  LEFT JOIN (SELECT cluster_id, max_by(thread_id, id) AS lead FROM overrides WHERE action = 'canonical' GROUP BY cluster_id) k USING (cluster_id)"""


def _state(spark, sf_dir) -> governance.State:
    groups, memberships, _ = _durable(spark, sf_dir)
    return governance.State(groups, memberships, fx.cluster_overrides(spark, sf_dir), fx.cluster_closures(spark, sf_dir))


@query(sql(_AFTER, "members", "overrides"))
def overrides_applied(spark, sf_dir):
    state = _state(spark, sf_dir)
    after = governance.apply_overrides(state, fx.threads_part(spark, sf_dir), state.groups.select("id"), NOW)
    return after.memberships.select("cluster_id", "thread_id", "state", "role")


@query(sql(f"""SELECT g.id, CASE WHEN k.lead IS NOT NULL THEN k.lead WHEN EXISTS (SELECT 1 FROM a WHERE a.cluster_id = g.id AND a.thread_id = g.lead AND a.state = 'active') THEN g.lead ELSE
    (SELECT min_by(a.thread_id, ({_RANK}) * 1e12 - coalesce(m.score, 0) * 1e10 + a.thread_id) FROM a JOIN members m USING (cluster_id, thread_id) WHERE a.cluster_id = g.id AND a.state = 'active') END AS representative_thread_id
  FROM groups g LEFT JOIN (SELECT cluster_id, max_by(thread_id, id) AS lead FROM overrides WHERE action = 'canonical' GROUP BY cluster_id) k ON k.cluster_id = g.id""".replace("CASE role", "CASE a.role"), "groups", "members", "overrides", recursive=f"a AS ({_AFTER})"))  # fmt: skip
def representatives_after_overrides(spark, sf_dir):
    state = _state(spark, sf_dir)
    after = governance.apply_overrides(state, fx.threads_part(spark, sf_dir), state.groups.select("id"), NOW)
    return after.groups.select("id", "representative_thread_id")


@query(sql("""SELECT cluster_id, thread_id, CASE WHEN cluster_id % 2 = 0 AND thread_id % 3 = 0 AND state = 'active' AND cluster_id IN (SELECT cluster_id FROM members WHERE cluster_id % 2 = 0 AND thread_id % 3 <> 0) THEN 'removed' ELSE state END AS state FROM members""", "members"))
def missing_removed(spark, sf_dir):
    memberships = fx.cluster_memberships(spark, sf_dir)
    seen = memberships.where("cluster_id % 2 = 0 and thread_id % 3 <> 0").select("cluster_id", "thread_id")
    return governance.missing_removed(memberships, seen, NOW).select("cluster_id", "thread_id", "state")


_FIRST = "(SELECT min(id) FROM groups WHERE repo_id = 1 AND status = 'active')"


def _first_open(state: governance.State) -> int:
    return state.groups.where((F.col("repo_id") == REPO) & (F.col("status") == "active")).agg(F.min("id")).first()[0]


@query(sql(f"SELECT id, CASE WHEN id = {_FIRST} THEN 'closed' ELSE status END AS status, CASE WHEN id = {_FIRST} THEN '{NOW}' ELSE closed_at END AS closed_at FROM groups", "groups"))
def close_cluster(spark, sf_dir):
    state = _state(spark, sf_dir)
    return governance.close_cluster(state, REPO, _first_open(state), "dup", NOW).groups.select("id", "status", "closed_at")


def _member_query(name: str, act, select: str) -> None:
    """An override of the smallest thread of the first open cluster."""

    def run(spark, sf_dir):
        state = _state(spark, sf_dir)
        own = _first_open(state)
        member = state.memberships.where((F.col("cluster_id") == own) & (F.col("state") == "active")).agg(F.min("thread_id")).first()[0]
        after = act(state, fx.threads_part(spark, sf_dir).withColumn("repo_id", F.lit(REPO).cast("long")), REPO, own, member, "why", NOW)
        return after.memberships.where(F.col("cluster_id") == own).select("thread_id", "state", "role")

    run.__name__ = name
    query(sql(f"SELECT thread_id, {select} FROM members WHERE cluster_id = {_FIRST}", "groups", "members"))(run)


_LEAST = f"(SELECT min(thread_id) FROM members WHERE cluster_id = {_FIRST} AND state = 'active')"
_member_query("override_exclude", governance.exclude_member, f"CASE WHEN thread_id = {_LEAST} THEN 'excluded' ELSE state END AS state, role")
_member_query("override_include", governance.include_member, "state, role")
_member_query("override_canonical", governance.set_canonical, f"state, CASE WHEN state <> 'active' THEN role WHEN thread_id = {_LEAST} THEN 'canonical' ELSE 'member' END AS role")


@query(sql("SELECT number, CASE WHEN id % 5 = 0 AND state = 'open' AND closed_at_local IS NULL THEN 'closed' ELSE state END AS state, CASE WHEN id % 5 = 0 AND state = 'open' AND closed_at_local IS NULL THEN 'gone' ELSE title END AS title FROM threads", "threads"))
def reconcile_closed(spark, sf_dir):
    threads = fx.threads_doc(spark, sf_dir)
    closed = threads.where("id % 5 = 0").withColumns({"state": F.lit("closed"), "title": F.lit("gone")})
    return ingest.reconcile_closed(threads, closed).select("number", "state", "title")


@query(sql("SELECT number, CASE WHEN id % 2 = 0 AND id >= 10 THEN 'new' ELSE title END AS title, closed_at_local FROM threads WHERE id >= 10 UNION ALL SELECT number, 'new', CASE WHEN id % 2 = 0 THEN closed_at_local END FROM threads WHERE id < 10 AND id % 2 = 0", "threads"))
def upsert_threads(spark, sf_dir):
    threads = fx.threads_doc(spark, sf_dir)
    new = threads.where("id % 2 = 0").withColumn("title", F.lit("new"))
    return ingest.upsert_threads(threads.where("id >= 10"), new).select("number", "title", "closed_at_local")


@query(sql("SELECT number, CASE WHEN id % 5 = 0 AND state = 'open' AND closed_at_local IS NULL THEN 'closed' WHEN id % 5 = 1 THEN 'open' ELSE state END AS state, CASE WHEN id % 5 = 0 AND state = 'open' AND closed_at_local IS NULL THEN 'v2' WHEN id % 5 = 1 THEN 'v2' ELSE title END AS title FROM threads", "threads"))
def sync_repeated_keys(spark, sf_dir):
    """Three versions of a thread in one batch, out of order: of every fifth the last is closed, of the next open."""
    threads = fx.threads_doc(spark, sf_dir)
    version = F.explode(F.array(*map(F.lit, (2, 0, 1)))).alias("v")
    batch = threads.where("id % 5 < 2").select("*", version).withColumns({"title": F.concat(F.lit("v"), F.col("v").cast("string")), "updated_at_gh": F.concat(F.lit("2025-01-0"), (F.col("v") + 1).cast("string"))})
    batch = batch.withColumn("state", F.when((F.col("v") == 2) == (F.col("id") % 5 == 0), "closed").otherwise("open")).drop("v")
    return ingest.sync_threads(threads, batch).select("number", "state", "title")


@query(sql("SELECT number, CASE WHEN number = 105 THEN '2024-06-01T00:00:00Z' ELSE closed_at_local END AS closed_at_local, CASE WHEN number = 105 THEN 'dup' END AS close_reason_local FROM threads", "threads"))
def thread_closed(spark, sf_dir):
    return threads_op.close_thread(fx.threads_doc(spark, sf_dir), REPO, 105, " dup ", NOW).select("number", "closed_at_local", "close_reason_local")


@query(sql("SELECT number, CASE WHEN number <> 111 THEN closed_at_local END AS closed_at_local FROM threads", "threads"))
def thread_reopened(spark, sf_dir):
    return threads_op.reopen_thread(fx.threads_doc(spark, sf_dir), REPO, 111, NOW).select("number", "closed_at_local")


@query(sql("SELECT id, CASE WHEN id = (SELECT max(id) FROM groups WHERE repo_id = 1 AND status = 'closed') THEN 'active' ELSE status END AS status, CASE WHEN id <> (SELECT max(id) FROM groups WHERE repo_id = 1 AND status = 'closed') THEN closed_at END AS closed_at FROM groups", "groups"))
def reopen_cluster(spark, sf_dir):
    state = _state(spark, sf_dir)
    own = state.groups.where((F.col("repo_id") == REPO) & (F.col("status") == "closed")).agg(F.max("id")).first()[0]
    return governance.reopen_cluster(state, REPO, own, NOW).groups.select("id", "status", "closed_at")


@query(sql("SELECT count(*) AS threads_synced, count(*) FILTER (kind = 'issue') AS issues_synced, count(*) FILTER (kind = 'pull_request') AS pull_requests_synced, (SELECT count(*) FROM conversations) AS comments_synced, count(*) FILTER (state = 'closed') AS threads_closed FROM threads", "threads"))
def sync_counters(spark, sf_dir):
    threads = fx.threads_doc(spark, sf_dir)
    return ingest.sync_stats(threads, fx.comments(spark, sf_dir), threads.where("state = 'closed'"))


@query(sql("SELECT t.id, CASE WHEN m.state <> 'active' THEN m.state ELSE t.state END AS shown, m.cluster_id, '#' || t.number || ' [' || CASE WHEN m.state <> 'active' THEN m.state ELSE t.state END || '] ' || CASE WHEN t.kind = 'issue' THEN 'Issue' ELSE 'PR' END || ' ' || t.title || ' ' AS line, m.state = 'active' AND t.state = 'open' AS visible FROM members m JOIN parts t ON t.id = m.thread_id", "members", "parts"))
def member_lines(spark, sf_dir):
    _, memberships, threads = _durable(spark, sf_dir)
    rows = memberships.select("cluster_id", F.col("thread_id").alias("id"), F.col("state").alias("member_state")).join(threads, "id")
    states = (F.col("member_state"), F.col("state"), F.col("closed_at_local"))
    return rows.select("id", display.member_state(*states).alias("shown"), "cluster_id", display.member_line().alias("line"), display.member_visible(*states).alias("visible"))


@query(sql(f"SELECT d.id, 'C' || d.id || ' [active] ' || d.n || ' items ' || d.stable_slug || ' - ' || coalesce(p.title, d.title) || ' (' || CASE WHEN coalesce(p.number, 0) = 0 THEN 'none' WHEN p.kind = 'issue' THEN 'issue #' || p.number ELSE 'PR #' || p.number END || ')' AS line FROM {_DURABLE_OPEN} d LEFT JOIN parts p ON p.id = d.lead WHERE d.n >= 1", "groups", "members", "parts", "visible"))
def cluster_lines(spark, sf_dir):
    return reports.durable_summaries(*_durable(spark, sf_dir), REPO).select("id", display.cluster_line().alias("line"))


@query(sql("SELECT id, CASE WHEN state = 'open' THEN 'no' ELSE state END AS closed FROM parts", "parts"))
def closed_labels(spark, sf_dir):
    rows = fx.threads_part(spark, sf_dir)
    return rows.select("id", display.closed_label(*(F.col(c) for c in ("state", "closed_at_local", "closed_at_gh", "close_reason_local"))).alias("closed"))


@query(sql("SELECT CASE kind WHEN 'issue' THEN 0 ELSE 1 END AS section, CASE kind WHEN 'issue' THEN 'ISSUES (' ELSE 'PULL REQUESTS (' END || count(*) || ')' AS label, count(*) AS n FROM parts GROUP BY kind", "parts"))
def member_sections(spark, sf_dir):
    return display.sections(fx.threads_part(spark, sf_dir))


@query("SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9._-]', '-', 'g'), '-.') AS name FROM pages")
def file_names(spark, sf_dir):
    return fx.read(spark, sf_dir, "pages").select("page_id", display.file_safe(F.col("url")).alias("name"))


@query(r"SELECT doc_id, sha256(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g')) AS plain FROM documents")
def texts_without_controls(spark, sf_dir):
    return fx.read(spark, sf_dir, "documents").select("doc_id", F.sha2(without_controls(F.col("text")), 256).alias("plain"))


@query("SELECT conv_id, turn, CASE WHEN trim(text) <> '' THEN text ELSE role END AS first FROM conversations")
def first_texts(spark, sf_dir):
    rows = fx.read(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", first_present(F.col("text"), F.col("role")).alias("first"))


@query(sql("SELECT id, status, n AS member_count FROM (SELECT g.id, CASE WHEN g.status = 'active' AND c.n > 0 AND c.gone >= c.n THEN 'closed' ELSE g.status END AS status, coalesce(c.n, 0) AS n FROM groups g LEFT JOIN (SELECT m.cluster_id, count(*) AS n, count(*) FILTER (t.state <> 'open') AS gone FROM members m LEFT JOIN parts t ON t.id = m.thread_id WHERE m.state = 'active' GROUP BY 1) c ON c.cluster_id = g.id) WHERE id = (SELECT min(id) FROM groups WHERE repo_id = 1)", "groups", "members", "parts"))
def durable_by_id(spark, sf_dir):
    groups, memberships, threads = _durable(spark, sf_dir)
    own = groups.where(F.col("repo_id") == REPO).agg(F.min("id")).first()[0]
    return reports.durable_summary_by_id(groups, memberships, threads, fx.cluster_closures(spark, sf_dir), REPO, own, include_closed=True).select("id", "status", "member_count")


@query(sql(f"SELECT id, member_count FROM (SELECT r.id, count(*) FILTER (t.state = 'open') AS member_count FROM raw r JOIN lines l ON l.l_orderkey = r.id JOIN parts t ON t.id = l.l_partkey WHERE r.id = (SELECT max(id) FROM raw WHERE run = 2 AND close_reason IS NULL) GROUP BY r.id) WHERE member_count > 0", "raw", "lines", "parts"))
def run_by_id(spark, sf_dir):
    own = fx.raw_clusters(spark, sf_dir).where("cluster_run_id = 2 and close_reason_local is null").agg(F.max("id")).first()[0]
    return reports.run_summary_by_id(*_raw(spark, sf_dir), REPO, own).select("id", "member_count")


@query(sql("SELECT 'sync' AS kind, (SELECT max(id) FROM runs WHERE kind = 'sync') + 1 AS id, 'numbers:4,7' AS scope UNION ALL SELECT kind, id, scope FROM (SELECT kind, id, 'all' AS scope FROM runs)", "runs"))
def run_recorded(spark, sf_dir):
    return commands.record_run(fx.runs(spark, sf_dir), "sync", REPO, commands.run_scope("open", [4, 7]), "success", NOW).select("kind", "id", "scope")


@query(sql(f"SELECT place, id FROM (SELECT id, row_number() OVER (ORDER BY n DESC, updated_at DESC, id) AS place FROM {_DURABLE_OPEN}) WHERE place <= 25", "groups", "members", "parts", "visible"))
def durable_merged_order(spark, sf_dir):
    """The first of a list in the order of merged lists, by place."""
    rows = reports.durable_summaries(*_durable(spark, sf_dir), REPO)
    rows = reports._sorted_summaries(rows, "size", 25, sizes_by_id=False)
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("member_count"), F.desc("updated_at"), "id")).cast("long")).select("place", "id")


@query(sql("SELECT number, kind, title, author_login, sha256(title || chr(0) || coalesce(body, '') || chr(0) || labels_json || chr(0)) AS content_hash FROM threads", "threads"))
def thread_from_api(spark, sf_dir):
    rows = fx.threads_doc(spark, sf_dir)
    plain = ["id", "number", "state", "title", "body", "html_url", F.struct(F.col("author_login").alias("login"), F.col("author_type").alias("type")).alias("user"), F.array(F.struct(F.regexp_extract("labels_json", '"name":"([^"]*)"', 1).alias("name"))).alias("labels")]
    raw = F.when(F.col("kind") == "pull_request", F.to_json(F.struct(*plain, F.struct(F.lit("u").alias("url")).alias("pull_request")))).otherwise(F.to_json(F.struct(*plain)))
    return ingest.threads_from_api(rows.select(raw.alias("raw")), REPO, NOW).select("number", "kind", "title", "author_login", "content_hash")


@query(sql("SELECT id, substr(body, 1, 64) AS body_excerpt, 0 AS body_length FROM threads", "threads"))
def prune_portable(spark, sf_dir):
    return portable.prune_threads(fx.threads_doc(spark, sf_dir), 64).select("id", "body_excerpt", F.col("body_length").cast("long").alias("body_length"))


def _sort_query(mode: str, order: str) -> None:
    def run(spark, sf_dir):
        rows = fx.threads_part(spark, sf_dir).withColumn("updated_at_gh", F.col("updated_at"))
        return reports.sort_members(rows, mode).withColumn("place", F.row_number().over(Window.orderBy(F.monotonically_increasing_id()))).select("id", F.col("place").cast("long").alias("place"))

    run.__name__ = f"member_sort_{mode}"
    query(sql(f"SELECT id, row_number() OVER (ORDER BY {order}) AS place FROM parts", "parts"))(run)


_sort_query("kind", "kind, number, id")
_sort_query("recent", "updated_at DESC, id")
_sort_query("oldest", "updated_at, id")
_sort_query("number", "number, id")
_sort_query("state", "state DESC, number, id")
_sort_query("title", "lower(title), id")


@query(sql(f"SELECT d.id, d.n AS member_count FROM {_DURABLE_OPEN} d LEFT JOIN parts p ON p.id = d.lead WHERE d.n >= 2 AND contains(lower(d.stable_slug || ' ' || d.title || ' ' || coalesce(p.title, '') || ' ' || coalesce(p.kind, '')), 'er 1')", "groups", "members", "parts", "visible"))
def browser_filter(spark, sf_dir):
    rows = reports.durable_summaries(*_durable(spark, sf_dir), REPO)
    return reports.filter_clusters(rows, " er 1", 2).select("id", "member_count")


@query(sql("SELECT id FROM (SELECT id, 0 AS part FROM groups WHERE repo_id = 1 AND id % 3 = 0 UNION ALL SELECT id, 1 FROM groups WHERE repo_id = 1 AND id % 3 <> 0 AND id % 2 = 0) ORDER BY part, id LIMIT 500", "groups"))
def merge_working_set(spark, sf_dir):
    rows = fx.cluster_groups(spark, sf_dir).where(F.col("repo_id") == REPO).select("id", F.lit("durable_cluster").alias("source"), F.col("id").alias("position"))
    return reports.merge_working_set(rows.where("id % 3 = 0"), rows.where("id % 2 = 0")).select("id")


@query(sql("SELECT count(*) FILTER (kind = 'issue') AS issues, count(*) FILTER (kind = 'pull_request') AS pulls, 0::BIGINT AS others FROM parts", "parts"))
def member_kind_counts(spark, sf_dir):
    return reports.kind_counts(fx.threads_part(spark, sf_dir))


@query(sql("SELECT page_id, rtrim(url, '.,;:!?') AS links FROM pages"))
def page_links(spark, sf_dir):
    text = F.concat(F.lit("[p]("), "url", F.lit(") and "), "url", F.lit("."))
    return fx.read(spark, sf_dir, "pages").select("page_id", F.array_join(links(text), ",").alias("links"))


@query(sql("SELECT id, title FROM threads", "threads"))
def clean_titles(spark, sf_dir):
    title = F.concat(F.lit(" \U0001f600 "), F.replace("title", F.lit(" "), F.lit("  ✨ ")), F.lit("️ "))
    return fx.threads_doc(spark, sf_dir).select("id", clean_title(title).alias("title"))


@query(sql("SELECT event_id, CASE WHEN m < 1 THEN 'now' WHEN m < 60 THEN m || 'm ago' WHEN m < 1440 THEN m // 60 || 'h ago' WHEN m < 86400 THEN m // 1440 || 'd ago' ELSE greatest(1, m // 43200) || 'mo ago' END AS age FROM (SELECT event_id, (epoch_us((SELECT max(ts) FROM events)) - epoch_us(ts)) // 60000000 AS m FROM events)"))
def age_labels(spark, sf_dir):
    rows = fx.read(spark, sf_dir, "events")
    stamp = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
    now = rows.agg(F.date_format(F.max("ts"), stamp).alias("now"))
    return rows.crossJoin(F.broadcast(now)).select("event_id", age_label(F.date_format("ts", stamp), F.col("now")).alias("age"))


@query(sql("SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 1)), 6) AS score FROM embeddings"))
def cosine_to_one(spark, sf_dir):
    rows = fx.read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    one = rows.where("vec_id = 1").select(F.col("v").alias("w"))
    return rows.crossJoin(F.broadcast(one)).select("vec_id", F.round(cosine(F.col("v"), F.col("w")), 6).alias("score"))


@query(sql("SELECT date_trunc('hour', ts) AS start, event_type AS kind, count(*) AS n FROM events GROUP BY ALL"))
def events_by_hour(spark, sf_dir):
    return kind_counts(fx.read(spark, sf_dir, "events"))
