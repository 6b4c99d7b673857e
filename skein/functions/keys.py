"""Hashes and readable keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

#: Part of the hash of embedding texts; it names another cap than EMBEDDING_RUNES and must stay.
EMBEDDING_HASH_TAG = "embedding:v2:max_runes=24000"
EMBEDDING_RUNES = 6000


def default_words(count: int = 248) -> list[str]:
    """Words by rule: consonant, vowel, consonant, vowel. Pass a list of one's own where keys must equal another tool's."""
    onsets, vowels = "bdfgklmnprstvz", "aeiou"
    pairs = [c + v for c in onsets for v in vowels]
    return [pairs[k % len(pairs)] + pairs[(k * 17 + k // len(pairs)) % len(pairs)] for k in range(count)]


def human_key(value: Column, words: Sequence[str] | None = None) -> Column:
    """(hash, slug, checksum) of a text: its SHA-256; three words by its first three bytes; the last four base-36 digits
    of its bytes 3 to 5."""
    words = list(words or default_words())
    table, digest = F.array(*map(F.lit, words)), F.sha2(value, 256)
    word = lambda at: F.element_at(table, (F.conv(F.substring(digest, at, 2), 16, 10).cast("int") % len(words) + 1).cast("int"))
    checksum = F.right(F.lpad(F.lower(F.conv(F.substring(digest, 7, 6), 16, 36)), 8, "0"), F.lit(4))
    return F.struct(digest.alias("hash"), F.concat_ws("-", word(1), word(3), word(5)).alias("slug"), checksum.alias("checksum"))


def cluster_name(repo_id: Column, representative: Column, cluster_id: Column, words: Sequence[str] | None = None) -> Column:
    """The slug by representative, or by cluster where there is none."""
    own = F.concat(F.lit("repo:"), repo_id.cast("string"), F.lit(":cluster:"), cluster_id.cast("string"))
    named = F.concat(F.lit("repo:"), repo_id.cast("string"), F.lit(":cluster-representative:"), representative.cast("string"))
    return human_key(F.when(F.coalesce(representative, F.lit(0)) != 0, named).otherwise(own), words)["slug"]


def content_hash(*values: Column) -> Column:
    """SHA-256 of the values, each followed by a NUL byte."""
    return F.sha2(F.concat(*(x for v in values for x in (F.coalesce(v, F.lit("")), F.lit("\0")))), 256)


def embedding_hash(basis: str, model: str, text: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{EMBEDDING_HASH_TAG}:{basis}:{model}\n"), text), 256)
