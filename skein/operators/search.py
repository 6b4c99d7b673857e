"""Full-text search: postings over four document columns, and BM25.

An index holds each document's terms by column and place; statistics are over the documents of all repositories, and the
repository filter comes after the match. All query phrases must occur, each in any column.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from skein.functions.text import TOKEN, query_terms, search_terms, search_tokens
from skein.operators.threads import by_recency, filter_threads, hit_columns, limited, recency, search_like, search_threads_like
from skein.sources.shared import work_path, written

COLUMNS = ("title", "body", "raw_text", "dedupe_text")
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
SNIPPET_TOKENS = 18


@dataclass(frozen=True)
class Index:
    """postings: (key, a hash of the term; term, doc_id, col, pos). lengths: (doc_id, tokens in all columns). Both are tables below one folder."""

    postings: DataFrame
    lengths: DataFrame

    @staticmethod
    def opened(spark: SparkSession, path: str) -> Index:
        return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths"))


def index_documents(documents: DataFrame, path: str | None = None) -> Index:
    """The index of documents (thread_id and the four columns), written once below path, or to the shared folder; doc_id
    is the thread's.

    Each task writes the postings of its documents in order of key, so nothing is shuffled, and a search for a term skips
    all pages of a file but those that may hold its key."""
    path = path or work_path(documents.sparkSession, "search-index")
    columns = F.array(*(F.struct(F.lit(k).cast("tinyint").alias("col"), search_terms(F.col(c)).alias("terms")) for k, c in enumerate(COLUMNS)))
    rows = documents.select(F.col("thread_id").alias("doc_id"), F.explode(columns).alias("c"))
    rows = rows.select("doc_id", "c.col", F.posexplode("c.terms").alias("pos", "term")).select(F.xxhash64("term").alias("key"), "term", "doc_id", "col", "pos")
    written(rows.sortWithinPartitions("key"), "postings", f"{path}/postings")
    # Documents without a term count as well.
    counts = documents.sparkSession.read.parquet(f"{path}/postings").groupBy("doc_id").agg(F.count("*").alias("tokens"))
    lengths = documents.select(F.col("thread_id").alias("doc_id")).join(counts, "doc_id", "left").select("doc_id", F.coalesce("tokens", F.lit(0)).alias("tokens"))
    written(lengths, "lengths", f"{path}/lengths")
    return Index.opened(documents.sparkSession, path)


def phrase_hits(index: Index, phrase: list[str]) -> DataFrame:
    """(doc_id, f): how often the phrase occurs in each document. Only the postings of its terms are read."""
    steps = [index.postings.where((F.col("key") == F.xxhash64(F.lit(t))) & (F.col("term") == t)).select("doc_id", "col", (F.col("pos") - k).alias("start")) for k, t in enumerate(phrase)]
    joined = reduce(lambda a, b: a.join(b, ["doc_id", "col", "start"]), steps)
    return joined.groupBy("doc_id").agg(F.count("*").alias("f"))


def bm25(index: Index, query: str) -> DataFrame | None:
    """(doc_id, score) of documents that match all of the query's phrases, best (smallest) scores first to be sorted;
    None if the query has no phrases."""
    phrases = [p for t in query_terms(query) if (p := search_tokens(t))]
    if not phrases:
        return None
    lengths = index.lengths
    stats = lengths.agg(F.count("*").cast("double").alias("n_docs"), F.avg("tokens").alias("avg_tokens"))
    scored = None
    for k, phrase in enumerate(phrases):
        hits = phrase_hits(index, phrase)
        n = hits.agg(F.count("*").cast("double").alias("n"))
        raw = F.log((F.col("n_docs") - F.col("n") + 0.5) / (F.col("n") + 0.5))
        # One-row tables: the numbers that every score needs.
        rows = hits.join(lengths, "doc_id").join(F.broadcast(stats)).join(F.broadcast(n))
        idf = F.when(raw <= 0, LEAST_IDF).otherwise(raw)
        part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("tokens") / F.col("avg_tokens")))
        rows = rows.select("doc_id", part.alias(f"part{k}"))
        scored = rows if scored is None else scored.join(rows, "doc_id")
    total = reduce(lambda a, b: a + b, (F.col(f"part{k}") for k in range(len(phrases))))
    return scored.select("doc_id", (-total).alias("score"))


def mark_snippet(text: str, terms: list[str]) -> str:
    """Up to 18 tokens of a text from its first match on, with matches in brackets; shorter texts are shown whole."""
    spans = [(m.start(), m.end(), "".join(search_tokens(m[0]))) for m in TOKEN.finditer(text)]
    if not spans:
        return text
    wanted = set(terms)
    hit = next((k for k, s in enumerate(spans) if s[2] in wanted), 0)
    first = max(0, min(hit, len(spans) - SNIPPET_TOKENS))
    last = min(len(spans), first + SNIPPET_TOKENS)
    at, end, out = (spans[first][0] if first else 0), (spans[last - 1][1] if last < len(spans) else len(text)), []
    for a, b, term in spans[first:last]:
        out += [text[at:a], f"[{text[a:b]}]" if term in wanted else text[a:b]]
        at = b
    return ("..." if first else "") + "".join([*out, text[at:end]]) + ("..." if last < len(spans) else "")


def search_documents(threads: DataFrame, documents: DataFrame, repo_id: int, query: str, limit: int = 20, snippets: bool = True, index: Index | None = None) -> DataFrame:
    """Hits by BM25; if the query has no terms, or nothing matches, by substring. index: of documents, made now if none
    is given."""
    scored = bm25(index or index_documents(documents), query) if query_terms(query) else None
    fallback = search_like(threads, repo_id, query, limit)
    if scored is None:
        return fallback
    rows = scored.join(threads.where(F.col("repo_id") == repo_id), F.col("doc_id") == F.col("id"))
    best = written(limited(rows.orderBy("score", "doc_id"), limit, 20), "search-hits")
    if best.isEmpty():
        return fallback
    terms = [t for q in query_terms(query) for t in search_tokens(q)]
    texts = documents.select(F.col("thread_id").alias("own"), "dedupe_text")
    shown = best.join(texts, F.col("own") == F.col("doc_id"))

    @F.pandas_udf("string")
    def marked(text):
        return text.fillna("").map(lambda t: mark_snippet(t, terms))

    return shown.select(*hit_columns(), (marked("dedupe_text") if snippets else F.lit("")).alias("snippet"), "score").orderBy("score", "thread_id")


def search_threads(threads: DataFrame, documents: DataFrame, repo_id: int, query: str = "", kind: str = "", state: str = "", include_closed: bool = False, limit: int = 20, index: Index | None = None) -> DataFrame:
    """Threads that match, by score, recency and number; without matches by substring; without a query by recency."""
    if not query.strip():
        return limited(by_recency(filter_threads(threads, repo_id, kind, state, include_closed)), limit, 20)
    scored = bm25(index or index_documents(documents), query) if query_terms(query) else None
    if scored is not None:
        rows = filter_threads(threads, repo_id, kind, state, include_closed).join(scored, F.col("doc_id") == F.col("id"))
        order = ("score", recency().desc(), F.col("number").desc())
        found = written(limited(rows.orderBy(*order), limit, 20), "search-hits")
        if not found.isEmpty():
            return found.orderBy(*order).select(*threads.columns)
    return search_threads_like(threads, repo_id, query, kind, state, include_closed, limit)
