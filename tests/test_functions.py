"""Scalar functions, arguments, configuration and connectors."""

import json
import math
import time
import random
import struct
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from skein.functions import display as dx, keys, text as tx, vectors as vec
from skein.sources import arguments, config, embedder, rest
from skein.sources.retry import Backoff, ServiceError, parse_retry_after, rate_limit_wait

NOW = datetime(2024, 6, 1, 12, tzinfo=timezone.utc)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lit(v):
    return F.lit(v).cast("string")


@pytest.mark.parametrize(("raw", "want"), [("  Fix\0 the\t BUG  ", "fix the bug"), ("", ""), (" A\x0bb ", "a\x0bb")])
def test_normalize_dedupe(spark, raw, want):
    assert value(spark, tx.normalize_dedupe(lit(raw))) == want


def test_titles(spark):
    assert sorted(value(spark, tx.title_tokens(lit("Large FILE file up-load éabcd")))) == ["abcd", "file", "large", "load"]
    pair = lambda a, b: value(spark, tx.overlap(tx.title_tokens(lit(a)), tx.title_tokens(lit(b))))
    assert (pair("alpha beta", "beta gamma delta"), pair("a", "beta")) == (0.5, 0.0)
    assert value(spark, tx.clean_title(lit(" \U0001f600 A ✨  b️ "))) == "A b"


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("see #12 and #7", [(12, 4)]),
        ("o/r#7 x", [(7, 0)]),
        ("éfoo/bar#77", [(77, 2)]),
        ("https://h/o/r/pull/9?x Issues/10", [(9, 14), (10, 23)]),
        ("#100 #99999999999999999999", []),
        (None, []),
    ],
)
def test_references(spark, body, want):
    assert [(r["number"], r["at"]) for r in value(spark, tx.references(lit(body), F.lit(100)))] == want


def test_references_search_a_text_once_and_runs_that_may_refer_only(spark):
    body = "é " * 20 + "plain words\ta/b#31 (#32) pull/33/x/y#34#35  #36"
    refs = value(spark, tx.references(lit(body), F.lit(36)))
    assert [(r["number"], r["at"] - len(body[: body.index(f"{r['number']}")].encode())) for r in refs] == [(31, -4), (32, -1), (33, -5), (34, -4), (35, -1)]
    found = spark.createDataFrame([("#11 b", body)], "title string, body string").select(tx.reference_evidence(F.col("title"), F.col("body"), F.lit(36)).alias("r"))
    assert [tuple(r) for r in found.first()["r"]] == [(n, n == 11, n != 11) for n in (11, 31, 32, 33, 34, 35)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("issues|pull") <= 4


def test_reference_evidence(spark):
    body = "x" * 300 + " #21 #22"
    rows = value(spark, tx.reference_evidence(lit("about #22"), lit(body), F.lit(1)))
    assert {tuple(r) for r in rows} == {(22, True, False), (21, False, False)}


def test_links_and_markdown(spark):
    text = "[a](https://x.test/a.) and (https://y.test/b), https://x.test/a! <https://z.test>"
    assert value(spark, tx.links(lit(text))) == ["https://x.test/a", "https://y.test/b", "https://z.test"]
    assert value(spark, tx.plain_markdown(lit("**b** `c` [l](http://u)"))) == "b c l <http://u>"
    assert value(spark, tx.without_controls(lit("a\x07b\nc"))) == "ab\nc"


@pytest.mark.parametrize(
    ("raw", "want"),
    [('[{"name":" bug "},{"name":""}]', ["bug"]), ('["a"," b ",""]', ["a", "b"]), ("nonsense", []), ('[{"name":3}]', []), ('{"name":"x"}', []), (None, []), ('[{"Name":"x","color":"c"}]', ["x"])],
)
def test_labels(spark, raw, want):
    assert value(spark, tx.label_names(lit(raw))) == want
    assert [x.strip() for x in (value(spark, tx.label_display(lit(raw))) or "").split(", ") if x] == want


@pytest.mark.parametrize(("at", "want"), [("", "never"), ("soon", "soon"), ("2024-06-01T11:59:30Z", "now"), ("2024-06-01T11:00:00Z", "1h ago"), ("2024-05-01T12:00:00Z", "31d ago"), ("2024-01-01T12:00:00Z", "5mo ago")])
def test_age(spark, at, want):
    assert value(spark, tx.age_label(lit(at), F.lit("2024-06-01T12:00:00Z"))) == want


def test_terms_in_columns_are_those_of_python(spark):
    texts = ["Café foo_bar x", "ÀÉÎ e\u0301 \u0301abc", "Straße Ωmega ЁЖ 中文 각", "½ x² #a1 İI", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.search_terms(F.col("t")).alias("w")).collect()
    assert [r["w"] for r in rows] == [tx.search_tokens(t or "") for t in texts]


def test_trimming_long_runs_of_blanks_is_fast(spark):
    text, began = "a" + " " * 40_000 + "b", time.time()
    assert value(spark, tx.trim_space(F.lit("\u2003 " + text + "\u00a0\n"))) == text and value(spark, tx.present(F.lit("\u2028 "))) is False
    assert time.time() - began < 3


def test_states_and_lines(spark):
    rows = [(1, "issue", "t1", "u", "open", None, "active", "ann", None), (2, "pull_request", "t2", None, "closed", None, "", None, "2024-01-02"), (3, "x y", "t3", "u", "open", "2024", "active", "b", None), (4, None, "t4", "u", None, None, "excluded", "", None)]
    df = spark.createDataFrame([(*r, "why" if r[0] == 3 else None, "2024-01-01") for r in rows], "number long, kind string, title string, html_url string, state string, closed_at_local string, member_state string, author_login string, closed_at_gh string, reason string, updated_at string").withColumn("updated_at_gh", F.lit(None).cast("string"))
    c = F.col
    got = df.select(dx.kind_label(c("kind")), dx.kind_glyph(c("kind")), dx.member_state(c("member_state"), c("state"), c("closed_at_local")), dx.state_glyph(dx.member_state(c("member_state"), c("state"), c("closed_at_local"))), dx.member_visible(c("member_state"), c("state"), c("closed_at_local")), dx.closed_label(c("state"), c("closed_at_local"), c("closed_at_gh"), c("reason"))).collect()
    assert [tuple(r) for r in got] == [("issue", "I", "open", "opn", True, "no"), ("PR", "PR", "closed", "cls", False, "2024-01-02"), ("x y", "x ", "local", "loc", False, "2024 (why)"), ("thread", "?", "excluded", "exc", False, "")]
    assert dx.report(df.where("number < 3"), dx.member_line(), "number").first()["text"] == "#1 [open] Issue t1 u\n#2 [closed] PR t2 "
    assert [(r["label"], r["n"]) for r in dx.sections(df.where("kind is not null")).collect()] == [("ISSUES (1)", 1), ("PULL REQUESTS (1)", 1), ("OTHER (1)", 1)]
    text = df.where("number = 1").select(dx.thread_text(F.create_map(F.lit("solution_summary"), F.lit("s"), F.lit("key_summary"), F.lit("k")), F.lit("body"))).first()[0]
    assert text == "Issue #1: t1\nState: open\nAuthor: ann\nUpdated: 2024-01-01\nURL: u\n\nSummaries\nKey summary:\nk\n\nSolution:\ns\n\nBody preview\nbody"
    one = spark.createDataFrame([(5, "slug", "active", "", "", 0, "", 3, "", "")], "id long, stable_slug string, status string, title string, representative_title string, representative_number long, representative_kind string, member_count long, updated_at string, closed_at string")
    assert one.select(dx.cluster_line()).first()[0] == "C5 [active] 3 items slug - Untitled cluster (none)" and one.select(dx.cluster_text()).first()[0].endswith("Members: 3\nUpdated: unknown\nRepresentative: none")
    assert [value(spark, dx.cluster_state(F.lit(s), F.lit(at))) for s, at in (("merged", ""), ("active", ""), ("active", "x"), ("", ""))] == ["MERGED", "OPEN", "CLOSED", "OPEN"]
    assert value(spark, dx.file_safe(F.lit("-A b/É.x-"))) == "a-b--.x"
    assert [dx.repository_of(x) for x in ("git@github.com:o/r.git", "https://github.com/o/r/", "https://x/y", "github.com/o")] == ["o/r", "o/r", "", ""]
    near = spark.createDataFrame([(7, "pull_request", "t", 0.4567)], "number long, kind string, title string, score double")
    assert near.select(dx.neighbor_line()).first()[0] == "#7 PR 45.7% t"


def test_search_terms():
    assert tx.query_terms('foo_bar "baz" é-1!') == ["foo_bar", "baz", "é", "1"]
    assert tx.search_tokens("Café foo_bar x") == ["cafe", "foo", "bar", "x"]


def test_cosine(spark):
    arr = lambda *v: F.array(*(F.lit(float(x)) for x in v)).cast("array<double>")
    assert value(spark, vec.cosine(arr(1, 0), arr(1, 1))) == pytest.approx(1 / math.sqrt(2))
    assert [value(spark, vec.cosine(arr(*a), arr(*b))) for a, b in (((), ()), ((1, 0), (1,)), ((0, 0), (1, 0)))] == [0.0, 0.0, 0.0]
    assert vec.decode_vector(struct.pack("<2f", 0.25, -0.5)) == [0.25, -0.5] == vec.decode_vector("[0.25, -0.5]")
    with pytest.raises(ValueError):
        vec.decode_vector(b"12345")


def test_human_key(spark):
    import hashlib

    digest = hashlib.sha256(b"repo:1:cluster-representative:546").hexdigest()
    words = [f"w{k}" for k in range(248)]
    key = value(spark, keys.human_key(lit("repo:1:cluster-representative:546"), words))
    assert key["hash"] == digest and key["slug"] == "-".join(f"w{int(digest[k : k + 2], 16) % 248}" for k in (0, 2, 4))
    n, digits = int(digest[6:12], 16), ""
    while n:
        n, d = divmod(n, 36)
        digits = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + digits
    assert key["checksum"] == digits.rjust(4, "0")[-4:]
    assert len({*keys.default_words()}) == 248
    assert value(spark, keys.cluster_name(F.lit(1), F.lit(0), F.lit(5))) == value(spark, keys.human_key(lit("repo:1:cluster:5")))["slug"]


def test_arguments():
    assert arguments.parse_since("1mo", NOW) == "2024-05-02T12:00:00Z" and arguments.parse_since("90m", NOW) == "2024-06-01T10:30:00Z"
    assert arguments.parse_since("2024-01-01T00:00:00.5+01:00", NOW) == "2023-12-31T23:00:00.5Z" and arguments.parse_since(" ", NOW) == ""
    assert arguments.parse_max_age("90") == timedelta(seconds=90) and arguments.parse_max_age("1h30m") == timedelta(minutes=90)
    assert arguments.parse_query("repo:o/r is:open is:issue slow  download") == {"text": "slow download", "repo": "o/r", "state": "open"}
    assert arguments.parse_repository("o/r") == ("o", "r") and arguments.numbers("3,1,3") == [3, 1] and [arguments.next_min_size(s) for s in (1, 50)] == [2, 1]
    assert arguments.is_stale("", timedelta(1), NOW) and not arguments.is_stale("2024-06-01T11:59:59Z", timedelta(seconds=5), NOW)
    for bad in (lambda: arguments.parse_since("5x", NOW), lambda: arguments.parse_since("0d", NOW), lambda: arguments.parse_max_age("0"), lambda: arguments.parse_repository("o"), lambda: arguments.positive("-1"), lambda: arguments.one_of("x", ("a",))):
        with pytest.raises(ValueError):
            bad()


def test_config(tmp_path):
    config.save(config.Config(batch_size=7, embed_model='a"b'), f"{tmp_path}/c.toml")
    got = config.load(f"{tmp_path}/c.toml", {"SKEIN_EMBED_DIMENSIONS": "3", "GITHUB_TOKEN": "t"})
    assert (got.batch_size, got.embed_model, got.embed_dimensions, got.has_token({"GITHUB_TOKEN": "t"}), got.has_token({})) == (7, 'a"b', 3, True, False)


def test_retry_rules():
    assert [ServiceError(s, c).retryable for s, c in ((429, ""), (429, "insufficient_quota"), (408, ""), (503, ""), (501, ""), (400, ""))] == [True, False, True, True, False, False]
    assert ServiceError(503, "overloaded").overloaded and ServiceError(529, kind="overloaded_error").overloaded
    assert [parse_retry_after(h, NOW) for h in ("2", "1.5", "-1", "x", "Sat, 01 Jun 2024 12:00:30 GMT", "")] == [2.0, 1.5, 0.0, 0.0, 30.0, 0.0]
    assert rate_limit_wait(429, {"Retry-After": "3"}, NOW) == 3.0 and rate_limit_wait(500, {"Retry-After": "3"}, NOW) is None
    assert rate_limit_wait(403, {"X-RateLimit-Remaining": "0", "X-RateLimit-Reset": str(int(NOW.timestamp()) + 9)}, NOW) == 9.0 and rate_limit_wait(403, {}, NOW) is None
    waits = [Backoff(jitter=0).wait(k, ServiceError(503, c), random.Random(0)) for k, c in ((0, ""), (3, ""), (9, ""), (0, "overloaded"))]
    assert waits == [1.0, 8.0, 60.0, 15.0]


def test_resources_and_comments():
    told = {"/repos/o/r": {"id": 1}, "/repos/o/r/pulls/7": {"id": 2}, "/repos/o/r/issues/7/comments?per_page=100": [{"id": 3}, {"id": 4}], "/repos/o/r/pulls/7/reviews?per_page=100": [{"id": 5}], "/repos/o/r/pulls/7/comments?per_page=100": []}
    get = lambda path: (200, {}, json.dumps(told[path]).encode())
    assert rest.resource(get, rest.resource_path("o", "r"))["id"] == 1 and rest.resource(get, rest.resource_path("o", "r", "pull_request", 7))["id"] == 2
    assert rest.files_path("o", "r", 7) == "/repos/o/r/pulls/7/files?per_page=100"
    rows = [*rest.thread_comment_rows(get, "o", "r", 7, "pull_request", 9)]
    assert [(r[0], r[1], r[2], r[3], json.loads(r[4])["id"]) for r in rows] == [(9, "issue_comment", 0, 0, 3), (9, "issue_comment", 0, 1, 4), (9, "pull_review", 0, 0, 5)]
    last = '<https://x/y?page=3>; rel="last"'
    assert [rest.page_total(1, last), rest.page_total(1, "", 250), rest.page_total(4, last), rest.page_total(2), rest.page_total(1, last, 950)] == [3, 3, 4, 0, 10]


def test_pages_follow_links():
    asked, waits = [], []
    replies = {
        "/a": [(429, {"Retry-After": "1"}, b""), (200, {"Link": '<https://h/b?page=2>; rel="next", <https://h/b?page=9>; rel="last"'}, b'[{"n":1},{"n":2}]')],
        "/b?page=2": [(200, {}, b'[{"n":3}]')],
    }

    def get(path):
        asked.append(path)
        return replies[path].pop(0)

    assert [len(p) for p in rest.pages(get, "/a", sleep=waits.append)] == [2, 1] and asked == ["/a", "/a", "/b?page=2"] and waits == [1.0]
    assert rest.last_page('<https://h/b?page=9>; rel="last"') == 9 and rest.links("nothing") == {}
    assert "since=x" in rest.issues_path("o", "r", "all", "x") and len(rest.comment_paths("o", "r", 1, "pull_request")) == 3
    with pytest.raises(OSError):
        list(rest.pages(lambda p: (404, {}, b""), "/a"))
    assert [len(p) for p in rest.pages(lambda p: (200, {}, b"[1,2,3]"), "/a", limit=2)] == [2]


def test_pages_source(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"{k}.json").write_text(json.dumps([{"number": k * 10 + j} for j in range(3)]))
    spark.dataSource.register(rest.PagesSource)
    rows = spark.read.format("skein_pages").option("path", str(tmp_path)).load()
    assert sorted(json.loads(r["raw"])["number"] for r in rows.collect()) == [0, 1, 2, 10, 11, 12]


class Flaky:
    def __init__(self, failures):
        self.failures = failures

    def __call__(self, texts):
        if self.failures:
            self.failures -= 1
            raise ServiceError(400 if "bad" in texts else 503)
        return [[float(len(t))] for t in texts]


def test_embedding(spark):
    waits = []
    assert embedder.with_retries(Flaky(2), ["ab"], sleep=waits.append) == [[2.0]] and len(waits) == 2
    with pytest.raises(ServiceError):
        embedder.with_retries(Flaky(9), ["bad"], sleep=waits.append)
    assert embedder.ordered([{"index": 1, "embedding": [2]}, {"index": 0, "embedding": [1]}], 2) == [[1], [2]]
    tasks = spark.createDataFrame([(1, "ab", "h"), (2, "abc", "h")], "thread_id long, text string, content_hash string")
    rows = embedder.embed_tasks(tasks, lambda: embedder.hash_embedder(8)).orderBy("thread_id").collect()
    assert [r["ok"] for r in rows] == [True, True] and all(abs(sum(x * x for x in r["vector"]) - 1) < 1e-9 for r in rows)

    def refuse(texts):
        raise ServiceError(400, "no")

    assert {r["error"] for r in embedder.embed_tasks(tasks, lambda: refuse).collect()} == {"status 400 no"}


def test_summary_keys_and_labels(spark):
    own = {"z_key": "1", "dedupe_summary": "2", "Zed": "3", "key_summary": "4", "solution_summary": " \t ", "none": None}
    row = spark.createDataFrame([(own,), ({},)], "m map<string,string>").select(tx.summary_keys(F.col("m")).alias("k")).collect()
    assert [r["k"] for r in row] == [["key_summary", "dedupe_summary", "Zed", "z_key"], []]
    assert [value(spark, tx.summary_label(lit(k))) for k in ("problem_summary", "dedupe_summary", "z_key_a")] == ["Purpose", "Cluster signal", "z key a"]


@pytest.mark.parametrize(
    ("repository", "kind", "number", "want"),
    [("o/r", "issue", 7, "https://github.com/o/r/issues/7"), ("o/r", "pull_request", 8, "https://github.com/o/r/pull/8"), ("o/r", None, 7, "https://github.com/o/r/issues/7"), (" ", "issue", 7, None), ("o/r", "issue", 0, None), (None, "issue", 7, None)],
)
def test_cluster_url(spark, repository, kind, number, want):
    url = tx.cluster_url(lit(repository), lit(kind), F.lit(number))
    assert value(spark, url) == want
    assert value(spark, tx.action_url(lit(None), url)) == want and value(spark, tx.action_url(lit("t"), url)) == "t"
