"""Text functions as Column expressions. Character classes are explicit: engines differ in \\s, \\b and lower()."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable
from functools import cache

import pandas as pd
import regex
from pyspark.sql import Column, functions as F, types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Unicode white space, as a Java character class.
WHITE = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_WHITE_CHARACTERS = "".join(map(chr, (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: What a Perl \s matches.
BLANK = r"[\t\n\f\r ]"
# Patterns of references, links and control characters.
REFERENCE = r"(?i)(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])[A-Za-z0-9_.-]++/[A-Za-z0-9_.-]++#[0-9]+|(?<=[A-Za-z0-9_])(?=[.-])[A-Za-z0-9_.-]++/[A-Za-z0-9_.-]++#[0-9]+|(?:issues|pull)/[0-9]+|#[0-9]{2,})"
#: What every reference holds; far cheaper to look for.
MAY_REFER = "[#/][0-9]"
EARLY_BODY_BYTES = 240
MARKDOWN_LINK = r"\[([^\]]+)\]\((https?://[^)\t\n\f\r ]+)\)"
BARE_LINK = r"(^|[\t\n\f\r (<])(https?://[^\t\n\f\r <>)]+)"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
EMOJI = r"[\x{200D}\x{20E3}\x{FE00}-\x{FE0F}\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{3030}\x{303D}\x{3297}\x{3299}]"


def ascii_lower(value: Column) -> Column:
    return F.translate(value, UPPER, LOWER)


def trim_space(value: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.btrim(value, F.lit(_WHITE_CHARACTERS))


def present(value: Column) -> Column:
    return trim_space(F.coalesce(value, F.lit(""))) != ""


def first_present(*values: Column) -> Column:
    """The first that is not blank, else ''."""
    return F.coalesce(*(F.when(present(v), v) for v in values), F.lit(""))


def normalize_dedupe(value: Column) -> Column:
    """Lower case, NUL and runs of blanks as one space, trimmed."""
    lowered = F.replace(F.lower(trim_space(value)), F.lit("\0"), F.lit(" "))
    return trim_space(F.regexp_replace(lowered, f"{BLANK}+", " "))


def title_tokens(title: Column) -> Column:
    """Distinct runs of four or more ASCII letters and digits, lower-cased."""
    return F.array_distinct(F.regexp_extract_all(F.lower(title), F.lit("[A-Za-z0-9]{4,}"), 0))


def overlap(left: Column, right: Column) -> Column:
    """Share of the smaller set that both have; 0 if either is empty."""
    least = F.least(F.size(left), F.size(right))
    return F.when(least > 0, F.size(F.array_intersect(left, right)) / least).otherwise(F.lit(0.0))


def references(text: Column, own: Column) -> Column:
    """Referenced thread numbers with the byte at which each match begins: array of (number, at). Not the own number."""
    text = F.coalesce(text, F.lit(""))
    none = F.array().cast("array<struct<number:bigint,at:int>>")
    # No match holds a space or looks beyond one, so only the runs between spaces that may refer are searched.
    runs = F.transform(F.split(text, " ", -1), lambda run, k: F.when(run.contains("#") | run.contains("/"), F.struct(run.alias("run"), k.alias("nth"))))
    runs = F.filter(runs, lambda r: r["run"].rlike(MAY_REFER))

    def placed(r: Column, found: Column) -> Column:
        begin = F.when(r["nth"] > 0, F.octet_length(F.call_function("substring_index", text, F.lit(" "), r["nth"])) + 1).otherwise(0)
        step = F.zip_with(F.split(r["run"], REFERENCE, -1), found, lambda gap, match: F.struct(match.alias("match"), F.octet_length(gap).alias("gap")))
        return F.aggregate(
            F.filter(step, lambda s: s["match"].isNotNull()),
            F.struct(begin.alias("end"), none.alias("refs")),
            lambda acc, s: F.struct(
                (acc["end"] + s["gap"] + F.octet_length(s["match"])).alias("end"),
                F.concat(acc["refs"], F.array(F.struct(F.regexp_extract(s["match"], "[0-9]+$", 0).try_cast("bigint").alias("number"), (acc["end"] + s["gap"]).alias("at")))).alias("refs"),
            ),
            lambda acc: acc["refs"],
        )

    every = F.flatten(F.transform(runs, lambda r: _once(F.regexp_extract_all(r["run"], F.lit(REFERENCE), 0), lambda found: F.when(F.size(found) > 0, placed(r, found)).otherwise(none))))
    return F.when(text.rlike(MAY_REFER), F.filter(every, lambda r: (r["number"] > 0) & (r["number"] != own))).otherwise(none)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def reference_evidence(title: Column, body: Column, number: Column) -> Column:
    """array of (number, in_title, early_body): one entry for each referenced number."""

    def evidence(both: Column) -> Column:
        numbers = F.array_distinct(F.transform(F.concat(both["title"], both["body"]), lambda r: r["number"]))
        return F.transform(
            numbers,
            lambda n: F.struct(
                n.alias("number"),
                F.exists(both["title"], lambda r: r["number"] == n).alias("in_title"),
                F.exists(both["body"], lambda r: (r["number"] == n) & (r["at"] <= EARLY_BODY_BYTES)).alias("early_body"),
            ),
        )

    return _once(F.struct(references(title, number).alias("title"), references(body, number).alias("body")), evidence)


def snippet(text: Column, limit: int) -> Column:
    """The first code points; none for a limit of 0 or less."""
    return F.substring(text, 1, limit) if limit > 0 else F.lit("")


def links(text: Column) -> Column:
    """Targets of Markdown links, then bare links, without trailing punctuation, each once."""
    both = F.concat(F.regexp_extract_all(text, F.lit(MARKDOWN_LINK), 2), F.regexp_extract_all(text, F.lit(BARE_LINK), 2))
    return F.array_distinct(F.transform(both, lambda link: F.regexp_replace(link, "[.,;:!?]+$", "")))


def clean_title(title: Column) -> Column:
    """Without emoji, with single spaces."""
    return F.regexp_replace(trim_space(F.regexp_replace(title, EMOJI, "")), f"{WHITE}+", " ")


def plain_markdown(text: Column) -> Column:
    linked = F.regexp_replace(text, MARKDOWN_LINK, "$1 <$2>")
    return trim_space(F.regexp_replace(linked, r"`|\*\*|__|~~", ""))


def without_controls(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, "")


def age_label(value: Column, now: Column) -> Column:
    """How long ago a timestamp was, in words; '' is never, and what is no timestamp stays as it is."""
    then = F.coalesce(F.try_to_timestamp(value), F.lit(None))
    minutes = F.floor((F.unix_micros(F.to_timestamp(now)) - F.unix_micros(then)) / F.lit(60_000_000))
    text = lambda n, unit: F.concat(n.cast("bigint").cast("string"), F.lit(f"{unit} ago"))
    return (
        F.when(~present(value), "never")
        .when(then.isNull(), value)
        .when(minutes < 1, "now")
        .when(minutes < 60, text(minutes, "m"))
        .when(minutes < 24 * 60, text(F.floor(minutes / 60), "h"))
        .when(minutes < 60 * 24 * 60, text(F.floor(minutes / (24 * 60)), "d"))
        .otherwise(text(F.greatest(F.lit(1), F.floor(minutes / (30 * 24 * 60))), "mo"))
    )


def query_terms(query: str) -> list[str]:
    """Runs of letters, digits and underscores of a search query."""
    terms, term = [], ""
    for c in query + " ":
        if unicodedata.category(c)[0] == "L" or unicodedata.category(c) == "Nd" or c == "_":
            term += c
        elif term:
            terms.append(term)
            term = ""
    return terms


TOKEN = regex.compile(r"[\p{L}\p{N}\p{Co}][\p{L}\p{N}\p{Co}\p{M}]*")


@cache
def _plain_characters() -> dict[int, str]:
    """Letters with diacritics, and what they are without; marks, and nothing."""
    out = {}
    for c in range(0x80, 0x110000):
        if unicodedata.category(chr(c))[0] == "M":
            out[c] = ""
        elif unicodedata.decomposition(chr(c)):
            bare = [x for x in unicodedata.normalize("NFD", chr(c)) if unicodedata.category(x)[0] != "M"]
            if len(bare) == 1 and ord(bare[0]) != c:
                out[c] = bare[0]
    return out


def search_tokens(text: str) -> list[str]:
    """Index terms: runs of letters, numbers and private use, lower-cased, without diacritics."""
    lower = text.lower()
    return TOKEN.findall(lower if lower.isascii() else lower.translate(_plain_characters()))


def search_terms(text: Column) -> Column:
    """search_tokens of a text; null: none."""
    plain = _plain_characters()
    letters = {c: p for c, p in plain.items() if p}
    marks = "".join(chr(c) for c, p in plain.items() if not p)  # those without a counterpart are deleted
    bare = F.translate(F.lower(text), "".join(map(chr, letters)) + marks, "".join(letters.values()))
    return F.coalesce(F.regexp_extract_all(bare, F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0)), F.array().cast("array<string>"))


LABELS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("color", T.StringType()), T.StructField("description", T.StringType())]))


def _labels(raw: str | None) -> list[tuple] | None:
    try:
        value = json.loads(raw or "")
    except ValueError:
        return None
    if not isinstance(value, list):
        return None
    out = []
    for item in value:
        if isinstance(item, dict):
            known = {k.lower(): v for k, v in item.items()}
            fields = [known.get(k) for k in ("name", "color", "description")]
            if any(f is not None and not isinstance(f, str) for f in fields):
                return None
            out.append(tuple(f or "" for f in fields))
        elif item is None:
            out.append(("", "", ""))
        else:
            out = None
            break
    if out and any(o[0] for o in out):
        return out
    if all(isinstance(i, str) or i is None for i in value):
        return [((i or "").strip(), "", "") for i in value]
    return out


@F.pandas_udf(LABELS)
def label_objects(raw: pd.Series) -> pd.Series:
    """Labels of a JSON text: objects with a name, or strings; anything else has none."""
    return raw.map(lambda r: [dict(zip(("name", "color", "description"), o, strict=True)) for o in _labels(r) or [] if o[0]])


def label_names(raw: Column) -> Column:
    names = F.transform(label_objects(raw), lambda o: trim_space(o["name"]))
    return F.filter(names, lambda n: n != "")


def label_display(raw: Column) -> Column:
    """Names as they are, blank ones left out, joined by commas."""
    return F.array_join(F.transform(F.filter(label_objects(raw), lambda o: present(o["name"])), lambda o: o["name"]), ", ")


#: Summaries that stand first, in this order, and their labels.
SUMMARY_LABELS = {"key_summary": "Key summary", "problem_summary": "Purpose", "solution_summary": "Solution", "maintainer_signal_summary": "Maintainer signal", "dedupe_summary": "Cluster signal"}


def summary_keys(values: Column) -> Column:
    """The keys of a map of summaries that aren't blank: the fixed ones, then the others by byte order."""
    fixed = F.array(*map(F.lit, SUMMARY_LABELS))
    keys = F.map_keys(F.map_filter(values, lambda _, v: present(v)))
    return F.concat(F.array_intersect(fixed, keys), F.sort_array(F.array_except(keys, fixed)))


def summary_label(key: Column) -> Column:
    labels = F.create_map(*(F.lit(x) for pair in SUMMARY_LABELS.items() for x in pair))
    return F.coalesce(F.try_element_at(labels, key), F.replace(key, F.lit("_"), F.lit(" ")))


def cluster_url(repository: Column, kind: Column, number: Column, site: str = "https://github.com") -> Column:
    """Of a cluster's representative; null without repository or number."""
    path = F.when(kind == "pull_request", "pull").otherwise("issues")
    return F.when((number > 0) & present(repository), F.concat(F.lit(f"{site}/"), repository, F.lit("/"), path, F.lit("/"), number.cast("string")))


def action_url(thread_url: Column, cluster: Column) -> Column:
    """The selected thread's URL, or the cluster's where no thread is selected (null)."""
    return F.coalesce(thread_url, cluster)
