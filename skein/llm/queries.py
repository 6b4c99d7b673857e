"""The queries of the training-data operators, with production parameters over whole tables, and SQL for some."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import public_tokenizers
from skein.llm import licenses
from skein.llm.bpe import encode_and_decode
from skein.llm.chat import format_conversations, read_back
from skein.llm.fingerprints import fingerprint_edits
from skein.llm.hash_forest import nearest
from skein.llm.jaccard_join import join_classes
from skein.llm.licenses import scan
from skein.llm.mixing import mix, word_count
from skein.llm.shared import bounded_batches, written
from skein.llm.token_counts import count_tokens
from skein.llm.toxicity import REJECT, fit, score
from skein.llm.warc import archive_and_read

BYTE_BPE = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(BYTE_BPE)
    back = encode_and_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "severity", (F.col("severity") >= REJECT).alias("toxic"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_sentences", F.array_join("licenses", ",").alias("licenses"), F.array_join("unmatched", ",").alias("unmatched"))


def _op3_sql() -> str:
    """Runs of fragments as substrings of a run's text, held against the sentences (names as patterns), one after another;
    rules are replacements in the text of identifiers."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    word = "[a-z0-9]+"
    name = f"{word}(?: {word}){{0,{licenses.NAME_WORDS - 1}}}"
    works = "|".join(w for w in licenses.WORKS if w and "*" not in w)
    told = f"(?:{'|'.join(licenses.VERBS)})(?:the terms of the |the |a )?"
    known, open_ = [], []
    for licence, names in licenses.NAMES.items():
        own, tag = "|".join(names), " ".join(re.findall(word, licence.lower()))
        known.append((f"(?:{works})?{told}(?:{own})(?: see {name})?|(?:the )?(?:{own})|spdx license identifier {tag}", licence))
        open_.append((f"{name} is {told}(?:{own})", licence))
    known += [(text.replace("*", name), licence) for text, licence in licenses.TEXTS.items()]
    table = lambda rows: ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in rows)
    ruled = "names"
    for licence, rule in licenses.RULES:
        ruled = f"replace({ruled}, {quoted(''.join(f'<{x}>' for x in rule))}, '[{licence}]')"
    soft, hard, line = "chr(3)", "chr(2)", "chr(4)"
    return rf"""
WITH RECURSIVE m AS (
  SELECT doc_id, replace(regexp_replace(regexp_replace(lower(text), '[.!?](\s|$)', {hard} || '\1', 'g'), '[:;](\s|$)', {soft} || '\1', 'g'), chr(10), {line}) AS t
  FROM documents WHERE regexp_matches(lower(text), {quoted("|".join(licenses.TRIGGERS))})
), p AS (
  SELECT doc_id, string_split_regex(t, '[\x02\x03\x04]') AS parts, regexp_extract_all(t, '[\x02\x03\x04]') AS seps FROM m
), f AS (
  SELECT doc_id, unnest(range(1, len(parts) + 1)) AS i, parts, seps FROM p
), g AS (
  SELECT doc_id, i, trim(regexp_replace(parts[i], '[^a-z0-9]+', ' ', 'g')) AS words, coalesce(seps[i - 1] = {hard}, true)::INT AS begins FROM f
), h AS (
  SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g
), o AS (
  SELECT *, sum(len(words) + (words <> '')::INT) OVER (PARTITION BY doc_id, run ORDER BY i) AS stop FROM h
), r AS (
  SELECT doc_id, run, string_agg(words || ' ', '' ORDER BY i) FILTER (words <> '') AS whole FROM h GROUP BY ALL
), c AS (
  SELECT a.doc_id, a.i, z.i AS k, substr(r.whole, (a.stop - len(a.words))::BIGINT, (z.stop - a.stop + len(a.words))::BIGINT) AS s
  FROM o a JOIN o z ON a.doc_id = z.doc_id AND a.run = z.run AND a.i <= z.i AND z.stop - a.stop < 2000 JOIN r ON r.doc_id = a.doc_id AND r.run = a.run
  WHERE a.words <> ''
), n AS (
  SELECT c.doc_id, c.i, c.k, v.name FROM c JOIN (VALUES {table(known)}) v(pattern, name) ON regexp_full_match(trim(c.s), v.pattern)
  UNION ALL SELECT c.doc_id, c.i, c.k, v.name FROM c JOIN (VALUES {table(open_)}) v(pattern, name) ON c.i = c.k AND regexp_full_match(trim(c.s), v.pattern)
), b AS (
  SELECT doc_id, i, max(k) AS k, max_by(name, k) AS name FROM n GROUP BY ALL
), x AS (
  SELECT b.doc_id, b.i, any_value(b.name) AS name, min(d.i) AS after FROM b LEFT JOIN b d ON d.doc_id = b.doc_id AND d.i > b.k GROUP BY ALL
), y AS (
  SELECT x.* FROM x JOIN (SELECT doc_id, min(i) AS i FROM x GROUP BY doc_id) USING (doc_id, i)
  UNION ALL SELECT x.* FROM y JOIN x ON x.doc_id = y.doc_id AND x.i = y.after
), z AS (
  SELECT doc_id, count(*) AS n, string_agg('<' || name || '>', '' ORDER BY i) AS names FROM y GROUP BY doc_id
), w AS (
  SELECT doc_id, n, {ruled} AS found FROM z
), l AS (
  SELECT doc_id, n, regexp_extract_all(found, '\[([^\]]+)\]', 1) AS named, regexp_extract_all(found, '<([^>]+)>', 1) AS free FROM w
)
SELECT d.doc_id, coalesce(l.n, 0) AS n_sentences, coalesce(array_to_string(list_filter(l.named, lambda e, k: list_position(l.named, e) = k), ','), '') AS licenses, coalesce(array_to_string(l.free, ','), '') AS unmatched
FROM documents d LEFT JOIN l USING (doc_id)
"""


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path(BYTE_BPE), limit=512).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op5_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_and_read(spark, table(spark, sf_dir, "pages"), least=0, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first, sha1(coalesce(html, '')) AS hex
  FROM pages
)
SELECT page_id, strlen(html) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(hex, ((k // 8) * 10 + 1)::INT, 10))::BIGINT >> (35 - 5 * (k % 8))::INT) & 31)::INT + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM p
"""


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents").select("doc_id", "text"), size=None)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_classes(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


OP8_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS gram
  FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * shared >= 85 * (x.n + y.n - shared)
), r AS (
  SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reached = l.a
)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reached) AS component_id FROM r LEFT JOIN n ON r.doc_id = n.doc_id GROUP BY r.doc_id
"""


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = written(table(spark, sf_dir, "documents").select("doc_id", "source", word_count().alias("size")), "mix-sizes")
    return mix(sizes, share=1.5, weights=(5, 2, 1), cap=2, size=F.col("size")).select("doc_id", "size", "source_size", "target", "taken")


#: The same bucketless: rows are numbered in one window for each source.
OP9_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, coalesce(doc_id::VARCHAR, '') AS id
  FROM documents
), e AS (
  SELECT *, length(bin(size)) * 16 + (size >> greatest(length(bin(size)) - 4, 0)::INT) AS class, ('0x' || substr(md5(id), 1, 8))::BIGINT AS hash
  FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM e GROUP BY source
), t AS (
  SELECT *, source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total, sum(w) OVER () AS weights FROM s
), u AS (
  SELECT *, coalesce(sum(cap) OVER before, 0) AS caps, coalesce(sum(w) OVER before, 0) AS ws
  FROM t WINDOW before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), v AS (
  SELECT *, cap * (weights - ws) <= w * (total - caps) AS whole FROM u
), x AS (
  SELECT *, total - sum(CASE WHEN whole THEN cap ELSE 0 END) OVER () AS rest, weights - sum(CASE WHEN whole THEN w ELSE 0 END) OVER () AS open FROM v
), y AS (
  SELECT source, source_size, CASE WHEN whole THEN cap ELSE w * rest / nullif(open, 0) END AS target,
    ('0x' || substr(md5('mix:' || coalesce('=' || source, '')), 1, 6))::BIGINT / 16777216.0::DOUBLE AS start
  FROM x
), z AS (
  SELECT e.doc_id, e.size, y.source_size, y.target, y.start, CASE WHEN y.source_size > 0 THEN y.target / y.source_size ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY e.source ORDER BY e.class, e.hash, e.id, e.size) AS place
  FROM e JOIN y ON e.source IS NOT DISTINCT FROM y.source
)
SELECT doc_id, size, source_size, target, ((floor(rate * place + start) - floor(rate * (place - 1) + start)) * size)::BIGINT AS taken
FROM z
"""


#: The conversation of control strings that every run formats as well.
CONTROL_TALK = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame(CONTROL_TALK, "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return read_back(format_conversations(rows))


OP10_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    role AS raw_role, text AS raw_text FROM c
), u AS (
  SELECT *, len(text) + len(regexp_extract_all(text, '\\|</?s>|\[/?INST\]|\[/?ROLE\]|\[END\]')) AS own,
    len(role) + len(regexp_extract_all(role, '\\|</?s>|\[/?INST\]|\[/?ROLE\]|\[END\]')) AS own_role
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, raw_role NULLS FIRST, raw_text NULLS FIRST)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN len(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, raw_role NULLS FIRST, raw_text NULLS FIRST)) AS loss_sha256,
  sum(own + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 ELSE own_role + 18 END)::BIGINT AS formatted_chars
FROM u GROUP BY conv_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": op1_bpe,
        "op2_toxicity": op2_toxicity,
        "op3_licenses": op3_licenses,
        "op4_token_counts": op4_token_counts,
        "op5_hash_forest": op5_hash_forest,
        "op6_warc": op6_warc,
        "op7_fingerprints": op7_fingerprints,
        "op8_jaccard_join": op8_jaccard_join,
        "op9_mixing": op9_mixing,
        "op10_chat": op10_chat,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_licenses": _op3_sql(), "op6_warc": OP6_SQL, "op8_jaccard_join": OP8_SQL, "op9_mixing": OP9_SQL, "op10_chat": OP10_SQL}
