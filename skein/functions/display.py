"""How threads, members and clusters are shown: labels, states and lines of text reports, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from skein.functions.text import first_present, present, summary_keys, summary_label, trim_space

# Short forms of states.
STATE_GLYPHS = {"open": "opn", "closed": "cls", "excluded": "exc", "local": "loc", "merged": "mrg"}


def kind_label(kind: Column) -> Column:
    return F.when(kind == "pull_request", "PR").when(kind == "issue", "issue").otherwise(first_present(kind, F.lit("thread")))


def kind_glyph(kind: Column) -> Column:
    return F.when(kind == "pull_request", "PR").when(kind == "issue", "I").otherwise(F.left(first_present(kind, F.lit("?")), F.lit(2)))


def kind_title(kind: Column) -> Column:
    return F.when(kind == "pull_request", "PR").otherwise("Issue")


def state_glyph(state: Column) -> Column:
    glyphs = F.create_map(*(F.lit(x) for pair in STATE_GLYPHS.items() for x in pair))
    return F.coalesce(F.try_element_at(glyphs, state), F.left(first_present(state, F.lit("?")), F.lit(3)))


def thread_state(state: Column, closed_at_local: Column) -> Column:
    """local where a thread is closed locally, else its own state."""
    return F.when(F.coalesce(closed_at_local, F.lit("")) != "", "local").otherwise(first_present(state, F.lit("unknown")))


def member_state(member: Column, state: Column, closed_at_local: Column) -> Column:
    """The state of a membership, unless it is active: then the thread's."""
    return F.when(~F.coalesce(member, F.lit("")).isin("", "active"), member).otherwise(thread_state(state, closed_at_local))


def member_visible(member: Column, state: Column, closed_at_local: Column, show_closed: bool = False) -> Column:
    """Whether a member is shown: all with closed ones, else active members of open threads."""
    if show_closed:
        return F.lit(True)
    return F.coalesce(member, F.lit("")).isin("", "active") & F.coalesce((state == "open") & (F.coalesce(closed_at_local, F.lit("")) == ""), F.lit(False))


def closed_label(state: Column, closed_at_local: Column, closed_at: Column, reason: Column) -> Column:
    """no, or when (or how) a thread was closed, and why."""
    at, why = first_present(closed_at_local, closed_at, state), F.coalesce(reason, F.lit(""))
    shown = F.when(why != "", F.concat(at, F.lit(" ("), why, F.lit(")"))).otherwise(at)
    return F.when((F.coalesce(closed_at_local, F.lit("")) == "") & F.coalesce(state == "open", F.lit(False)), "no").otherwise(shown)


def cluster_state(status: Column, closed_at: Column) -> Column:
    upper = F.upper(first_present(status, F.lit("active")))
    return F.when(upper.isin("CLOSED", "MERGED", "SPLIT"), upper).when(F.coalesce(closed_at, F.lit("")) != "", "CLOSED").otherwise("OPEN")


def thread_ref(kind: Column, number: Column) -> Column:
    """A cluster's representative by kind and number; none where the number is 0."""
    return F.when(F.coalesce(number, F.lit(0)) == 0, "none").otherwise(F.concat(kind_label(kind), F.lit(" #"), number.cast("string")))


def file_safe(value: Column) -> Column:
    """Lower case, with hyphens for all but ASCII letters, digits and - _ . , and none of - . at either end."""
    return F.btrim(F.regexp_replace(F.lower(value), "[^a-z0-9._-]", "-"), F.lit("-."))


def repository_of(remote: str) -> str:
    """owner/name of a repository's remote address; empty for other addresses."""
    value = remote.strip().removesuffix(".git")
    if value.startswith("git@github.com:"):
        value = value.removeprefix("git@github.com:")
    elif "github.com/" in value:
        value = value.partition("github.com/")[2]
    else:
        return ""
    return "/".join(value.strip("/").split("/")[-2:]) if "/" in value.strip("/") else ""


# Lines and reports


def member_line() -> Column:
    """Of rows with number, kind, title, html_url, state, closed_at_local and member_state."""
    state = member_state(F.col("member_state"), F.col("state"), F.col("closed_at_local"))
    return F.concat(F.lit("#"), F.col("number").cast("string"), F.lit(" ["), state, F.lit("] "), kind_title(F.col("kind")), F.lit(" "), "title", F.lit(" "), F.coalesce("html_url", F.lit("")))


def cluster_line() -> Column:
    """Of cluster summaries."""
    title = first_present(F.col("representative_title"), F.col("title"), F.lit("Untitled cluster"))
    ref = thread_ref(F.col("representative_kind"), F.col("representative_number"))
    return F.concat(F.lit("C"), F.col("id").cast("string"), F.lit(" ["), first_present(F.col("status"), F.lit("unknown")), F.lit("] "), F.col("member_count").cast("string"), F.lit(" items "), "stable_slug", F.lit(" - "), title, F.lit(" ("), ref, F.lit(")"))


def cluster_text() -> Column:
    """The report of one cluster summary."""
    title = first_present(F.col("representative_title"), F.col("title"), F.lit("Untitled cluster"))
    lines = [
        F.concat(F.lit("Cluster "), F.col("id").cast("string")), F.concat(F.lit("Name: "), "stable_slug"), F.concat(F.lit("Title: "), title),
        F.concat(F.lit("State: "), first_present(F.col("status"), F.lit("unknown"))), F.concat(F.lit("Members: "), F.col("member_count").cast("string")),
        F.concat(F.lit("Updated: "), first_present(F.col("updated_at"), F.lit("unknown"))), F.concat(F.lit("Representative: "), thread_ref(F.col("representative_kind"), F.col("representative_number"))),
    ]
    return F.concat_ws("\n", *lines)


def neighbor_line() -> Column:
    """Of neighbours (number, kind, title, score)."""
    return F.concat(F.lit("#"), F.col("number").cast("string"), F.lit(" "), kind_title(F.col("kind")), F.format_string(" %.1f%% ", F.col("score") * 100), "title")


def summaries_text(summaries: Column) -> Column:
    """Labels and texts of a map of summaries, in their order."""
    parts = F.transform(summary_keys(summaries), lambda k: F.concat(summary_label(k), F.lit(":\n"), F.try_element_at(summaries, k), F.lit("\n")))
    return trim_space(F.array_join(parts, "\n"))


def thread_text(summaries: Column, body_snippet: Column) -> Column:
    """The report of one member (as member_line, with author_login, updated_at_gh and updated_at)."""
    state = member_state(F.col("member_state"), F.col("state"), F.col("closed_at_local"))
    section = lambda name, text: F.when(present(text), F.concat(F.lit(f"\n{name}\n"), text))
    lines = [
        F.concat(kind_title(F.col("kind")), F.lit(" #"), F.col("number").cast("string"), F.lit(": "), "title"), F.concat(F.lit("State: "), state), F.concat(F.lit("Author: "), first_present(F.col("author_login"), F.lit("unknown"))),
        F.concat(F.lit("Updated: "), first_present(F.col("updated_at_gh"), F.col("updated_at"), F.lit("unknown"))), F.concat(F.lit("URL: "), F.coalesce("html_url", F.lit(""))), section("Summaries", summaries_text(summaries)), section("Body preview", body_snippet),
    ]
    return F.concat_ws("\n", *lines)


def report(rows: DataFrame, line: Column, *order: Column | str) -> DataFrame:
    """One text of a short list: a line a row, in order."""
    return rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("_line")))), lambda s: s["_line"]), "\n").alias("text"))


def sections(members: DataFrame) -> DataFrame:
    """(section, label, n) of members by kind, for the headers of a list sorted by kind: those that have members."""
    place = F.when(F.col("kind") == "issue", 0).when(F.col("kind") == "pull_request", 1).otherwise(2)
    names = F.array(*map(F.lit, ("ISSUES", "PULL REQUESTS", "OTHER")))
    rows = members.groupBy(place.alias("section")).agg(F.count("*").alias("n"))
    return rows.select("section", F.concat(F.get(names, "section"), F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("label"), "n").orderBy("section")
