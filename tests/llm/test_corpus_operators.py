"""Neighbours, archives, fingerprints, joins, mixing, chats and the pipeline, against brute force."""

import hashlib
import itertools
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from skein.llm import chat, fingerprints, hash_forest, jaccard_join, mixing, warc
from skein.llm.shared import work_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# Nearest neighbours


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string, rank string")


def test_forest_recall_and_exact_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 16)) * rng.uniform(0.5, 2, (600, 1))
    rows = [(k, v.astype(np.float32).tolist(), "s", "r") for k, v in enumerate(x)]
    found = hash_forest.nearest(vectors(spark, rows), k=10, every=20).toPandas()
    x = x.astype(np.float32).astype(float)
    hits = 0
    for q, own in found.groupby("query_id"):
        scores = x @ x[q]
        scores[q] = -np.inf
        best = np.lexsort((np.arange(600), -scores))[:10]
        own = own.sort_values("rank")
        assert own["rank"].tolist() == [*range(1, 11)]
        assert np.allclose(own["score"], x[own["vec_id"]] @ x[q]) and (np.diff(own["score"]) <= 0).all()
        hits += len({*best} & {*own["vec_id"]})
    assert found["query_id"].nunique() == 30 and hits / 300 >= 0.9


@pytest.mark.parametrize("norms", ["one doubled", 0.3, 0.6])
def test_forest_recall_where_norms_differ(spark, norms):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x *= np.where(np.arange(2000) == 7, 2, 1)[:, None] if norms == "one doubled" else np.exp(rng.normal(0, norms, (2000, 1)))
    x = x.astype(np.float32)
    found = hash_forest.nearest(vectors(spark, [(k, v.tolist(), "", "") for k, v in enumerate(x)]), k=20, every=20).toPandas()
    x, hits = x.astype(float), 0
    for q, own in found.groupby("query_id"):
        scores = x @ x[q]
        scores[q] = -np.inf
        hits += len({*np.lexsort((np.arange(2000), -scores))[:20]} & {*own["vec_id"]})
        assert np.allclose(own["score"], x[own["vec_id"]] @ x[q]) and len(own) == 20
    assert found["query_id"].nunique() == 100 and hits / 2000 >= 0.93


def test_forest_takes_every_length(spark, monkeypatch):
    monkeypatch.setattr(hash_forest, "SHARD_ROWS", 30)
    monkeypatch.setattr(hash_forest, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(2)
    x = [rng.standard_normal(8 if k % 3 else 5).astype(np.float32) for k in range(240)]
    found = hash_forest.nearest(vectors(spark, [(k, v.tolist(), "", "") for k, v in enumerate(x)]), k=5, every=20).toPandas()
    by = {q: g.sort_values("rank")["vec_id"].tolist() for q, g in found.groupby("query_id")}
    # Bands are of fewer than 4 * k rows, so all are scored.
    assert by == {q: sorted((k for k in range(240) if k != q and len(x[k]) == len(x[q])), key=lambda k: (-float(x[k].astype(float) @ x[q].astype(float)), k))[:5] for q in range(0, 240, 20)}


def test_forest_edges(spark):
    same, nan = [1.0, 0.0], float("nan")
    rows = [(k, same, "", "") for k in range(0, 60)] + [(100, None, "", ""), (120, [0.0, 0.0], "", ""), (140, [nan, 1.0], "", ""), (160, [1.0], "", ""), (180, [None, 1.0], "", ""), (None, same, "", ""), (3, same, "", "")]
    found = hash_forest.nearest(vectors(spark, rows), k=5, every=20).toPandas()
    by = {q: g.sort_values("rank")["vec_id"].tolist() for q, g in found.groupby("query_id")}
    assert by == {0: [1, 2, 3, 4, 5], 20: [0, 1, 2, 3, 4], 40: [0, 1, 2, 3, 4]}
    few = hash_forest.nearest(vectors(spark, [(0, same, "", ""), (1, [0.5, 0.5], "", "")]), k=5, every=20).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in few] == [(0, 1, 1, 0.5)]
    assert hash_forest.nearest(vectors(spark, []), k=5).count() == 0
    assert hash_forest.nearest(vectors(spark, [(1, same, "", "")]), k=5).count() == 0


# Archives


def test_archive_round_trip(spark):
    pages = [(1, "http://a/ b\n", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", "x" * 300_000), (None, "u", "<p>é</p>"), (1, "again", "<p>é</p>"), (6, "u", "one"), (None, "u", "two"), (None, "u", "two")]
    df = spark.createDataFrame([(*p, "r") for p in pages], "page_id long, url string, html string, record_type string")
    rows = warc.archive_and_read(spark, df).collect()
    least = defaultdict(list)
    for p, _, h in pages:
        least[h or ""].append(p)
    first = {h: min((p for p in ps if p is not None), default=None) for h, ps in least.items()}
    want = Counter((p, len((h or "").encode()), warc.sha1_base32((h or "").encode()), "response" if p == first[h or ""] else "revisit", None if p == first[h or ""] else first[h or ""]) for p, _, h in pages)
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows) == want
    assert {bytes(r["payload"]) for r in rows if r["page_id"] == 5} == {b"x" * 300_000}
    assert warc.archive_and_read(spark, df.limit(0)).count() == 0
    assert {r["record_type"] for r in warc.archive_and_read(spark, df.where("page_id < 3"), least=100).collect()} == {"response"}


def test_small_archives_and_damage(spark):
    df = spark.createDataFrame([(k, "u", f"page {k}") for k in range(50)], "page_id long, url string, html string")
    folder = work_path(spark, "warc-test")
    manifest = warc.write_archives(warc.with_first_of_payload(df), folder, archive_bytes=2000)
    assert manifest.count() > 5 and manifest.agg(F.sum("n_records")).first()[0] == 50
    assert warc.read_archives(manifest).select("page_id").distinct().count() == 50
    good = warc.record(1, "u", b"payload", None, "2000-01-01T00:00:00Z")
    assert warc.parse(good)["payload"] == b"payload"
    for bad in (good[:-5], good.replace(b"payload", b"paylaod"), b"HTTP" + good, good.replace(b"sha1:", b"sha1:A", 1)):
        with pytest.raises(ValueError):
            warc.parse(bad)

    class Stream:
        def __init__(self, data):
            self.data = data

        def read(self, n):
            out, self.data = self.data[:3], self.data[3:]
            return out

    press = lambda b: (c := zlib.compressobj(6, zlib.DEFLATED, 31)).compress(b) + c.flush()
    assert list(warc.members(Stream(press(b"one") + press(b"two")))) == [b"one", b"two"]
    for cut in (-4, -1, 1, 3, 8, 10, 12):
        with pytest.raises(ValueError):
            list(warc.members(Stream(press(b"one") + press(b"two" * 50)[:cut])))
    assert list(warc.members(Stream(b""))) == []
    with pytest.raises(Exception, match="records, not"):
        warc.read_archives(manifest.withColumn("n_records", F.col("n_records") + 1)).count()


def test_hot_payloads(spark, monkeypatch):
    monkeypatch.setattr(warc, "HOT_RECORDS", 5)
    rows = [(k, "hot" if k % 3 else f"own {k // 6}") for k in range(60)] + [(None, "hot"), (100, "lone")]
    got = warc.with_first_of_payload(spark.createDataFrame(rows, "page_id long, html string")).collect()
    least = {h: min(p for p, x in rows if x == h and p is not None) for _, h in rows}
    assert Counter((r["page_id"], r["refers_to"], r["url"]) for r in got) == Counter((p, None if p == least[h] else least[h], None) for p, h in rows)


# Fingerprints


def longs(*values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<Q", v), seed)
    return seed


def signed_hash(text):
    value = xxhash.xxh64_intdigest(text.encode(), 42)
    return value - 2**64 if value >> 63 else value


def brute_sketch(text):
    own = WORD.findall(text)
    if not own:
        return []
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in own]
    s = [longs(a, b) for a, b in itertools.pairwise(h)]
    signed = lambda v: v - 2**64 if v >> 63 else v
    found = {longs(s[i], s[i + 2], s[i + 3]) & 0xFFFFFFFF for i in range(len(own) - 4) if min(s[i : i + 4], key=signed) in (s[i], s[i + 3])}
    return sorted(found)[:128] or [xxhash.xxh64_intdigest(" ".join(own).encode(), 42) & 0xFFFFFFFF]


def brute_likeness(a, b):
    if not a or not b:
        return float(not a and not b)
    least = sorted({*a, *b})[:128]
    return len([h for h in least if h in a and h in b]) / len(least)


def text_of(rng, n, words="the of one two three four red blue high low étage".split()):
    return " ".join(rng.choice(words) + str(rng.randint(0, 9)) for _ in range(n))


@pytest.mark.parametrize("quantiles", [4096, 4])
def test_fingerprints_by_brute_force(spark, monkeypatch, quantiles):
    monkeypatch.setattr(fingerprints, "STRETCH_ROWS", 3)
    monkeypatch.setattr(fingerprints, "QUANTILES", quantiles)
    rng = random.Random(3)
    texts = [text_of(rng, rng.choice((0, 1, 4, 5, 30, 400))) for _ in range(40)] + [None, "", " \n ", "lone", text_of(rng, 30_000)]
    texts += [texts[5], texts[5]]
    ids = rng.sample(range(-50, 500), len(texts) - 2)
    ids += [ids[5], None]
    texts += [text_of(rng, 6) for _ in range(60)]  # one id has a third of the rows, and as many have none
    ids += [77] * 30 + [None] * 30
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, n_chars int, near_next string")
    rows = fingerprints.fingerprint_edits(df).collect()
    order = sorted(((i, t or "") for i, t in zip(ids, texts, strict=True)), key=lambda r: (r[0] is None, -(r[0] or 0), signed_hash(r[1]), r[1]))
    want = Counter()
    for (i, t), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        a, b, c = map(brute_sketch, (t, edited, after))
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), "".join(f"{h:08X}" for h in a), "".join(f"{h:08X}" for h in b), round(brute_likeness(a, b), 9), round(brute_likeness(a, c), 9)] += 1
    got = Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in rows)
    assert got == want
    assert fingerprints.fingerprint_edits(df.limit(0)).count() == 0


def brute_anchors(text):
    """(hash, place) of every anchor, uncut."""
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORD.findall(text)]
    s = [longs(a, b) for a, b in itertools.pairwise(h)]
    signed = lambda v: v - 2**64 if v >> 63 else v
    return [(longs(s[i], s[i + 2], s[i + 3]) & 0xFFFFFFFF, i) for i in range(len(h) - 4) if min(s[i : i + 4], key=signed) in (s[i], s[i + 3])]


def op7_texts():
    """By id; each is followed by that of the next smaller id, and 0 by the greatest."""
    rng = random.Random(9)
    passage = text_of(rng, 60)
    return {0: f"{text_of(rng, 3000)} {passage}", 1: f"{passage} {text_of(rng, 2000)}", 2: text_of(rng, 300), 3: "", 4: "lone word", 5: f"{passage} {passage} {text_of(rng, 20)} {passage}"}


def op7_rows(spark, tmp_path, texts):
    from skein.llm import queries

    spark.createDataFrame([*texts.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return {r["doc_id"]: r for r in queries.op7_fingerprints(spark, str(tmp_path)).collect()}


def test_query_fingerprints_have_all_anchors(spark, tmp_path):
    texts = op7_texts()
    rows = op7_rows(spark, tmp_path, texts)
    assert {*rows} == {*texts}

    def whole(t):
        return {h for h, _ in brute_anchors(t)} or {*brute_sketch(t)}

    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i, t in texts.items():
        after = texts[(i - 1) % len(texts)]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, b, c, r = whole(t), whole(edited), whole(after), rows[i]
        assert r["fingerprint"] == "".join(f"{h:08X}" for h in sorted(a)) and r["edited_fingerprint"] == "".join(f"{h:08X}" for h in sorted(b))
        assert abs(r["near_edited"] - jaccard(a, b)) < 1e-12 and abs(r["near_next"] - jaccard(a, c)) < 1e-12
    assert len(rows[0]["fingerprint"]) > 8 * 1000 and 0 < rows[1]["near_next"] < 0.05


def test_anchors_match_by_place(spark):
    rng = random.Random(4)
    passage, before = text_of(rng, 60), text_of(rng, 37)
    df = spark.createDataFrame([(passage, f"{before} {passage}")], "a string, b string")
    found = df.select(fingerprints.matches(fingerprints.anchors(F.col("a")), fingerprints.anchors(F.col("b"))).alias("m")).first()["m"]
    assert len(found) > 10 and Counter(m["offset"] for m in found).most_common(1)[0][0] == 37


def test_anchors_match_at_every_place(spark, tmp_path):
    texts = op7_texts()
    df = spark.createDataFrame([(texts[1], texts[5]), (texts[5], texts[5]), (texts[5], texts[2]), ("", texts[2]), (texts[2], "")], "a string, b string")
    for r in df.select("a", "b", fingerprints.matches(fingerprints.anchors(F.col("a")), fingerprints.anchors(F.col("b"))).alias("m")).collect():
        want = [(p, q - p) for h, p in brute_anchors(r["a"]) for g, q in brute_anchors(r["b"]) if g == h]
        assert [(m["place"], m["offset"]) for m in r["m"]] == want
    rows = op7_rows(spark, tmp_path, texts)
    for i, t in texts.items():
        after = texts[(i - 1) % len(texts)]
        own, edited = brute_anchors(t), brute_anchors(t[: len(t) - len(t) // 2] + after[: len(t) // 2])
        held, others, r = {h for h, _ in edited}, {h for h, _ in brute_anchors(after)}, rows[i]
        assert (r["n_anchors"], r["placed_edited"]) == (len(own), len({*own} & {*edited}))
        assert (r["matched_edited"], r["matched_next"]) == (sum(h in held for h, _ in own), sum(h in others for h, _ in own))
    assert rows[5]["matched_edited"] > rows[5]["placed_edited"] > 0 and rows[1]["matched_next"] > 10


# Similarity join


def near_texts(rng, families=12, copies=8):
    out = []
    for _ in range(families):
        base = text_of(rng, rng.choice((5, 9, 40, 120))).split()
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = f"edit{rng.randint(0, 999)}"
            out.append(" ".join(own))
    return out + [None, "", " \t", "two words", "Two WORDS", "lone", "lone"]


def grams(text, n):
    own = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in WORD.findall(text or "")]
    return {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if len(own) >= n else ({tuple(own)} if own else set())


def brute_components(ids, texts, n, num, den):
    sets, parent = [grams(t, n) for t in texts], list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    least = defaultdict(list)
    for k, i in enumerate(ids):
        if i is not None:
            least[root(k)].append(i)
    return [(i, len(s), min(least[root(k)], default=None) if s else i) for k, (i, s) in enumerate(zip(ids, sets, strict=True))]


@pytest.mark.parametrize(("n", "num", "small"), [(4, 85, True), (5, 80, False)])
def test_join_by_brute_force(spark, monkeypatch, n, num, small):
    if small:  # many groups and parts; frequent tokens in force, and split over buckets; families found late
        monkeypatch.setattr(jaccard_join, "MEMBERS", 3)
        monkeypatch.setattr(jaccard_join, "PIVOTS", 0)
        monkeypatch.setattr(jaccard_join, "FREQUENT", 2)
        monkeypatch.setattr(jaccard_join, "HOT", 2)
        monkeypatch.setattr(jaccard_join, "BUCKET_TOKENS", 700)
    texts = near_texts(random.Random(num))
    ids = [*range(500, 500 - len(texts), -1)]
    ids[-1], ids[3], ids[20] = ids[-2], None, ids[21]
    df = spark.createDataFrame([(i, t, 5, "x") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, size int, entity string")
    rows = jaccard_join.join_classes(df, n, num, 100).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows) == Counter(brute_components(ids, texts, n, num, 100))
    kept = jaccard_join.one_of_each_class(df, n, num, 100).collect()
    classes = brute_components([*range(len(ids))], texts, n, num, 100)
    assert len(kept) == len({c for _, s, c in classes if s}) + sum(not s for _, s, _ in classes)
    assert jaccard_join.join_classes(df.limit(0), n, num, 100).count() == 0


def thue_morse(letters, length=1024):
    """A word whose sums by powers of any odd number modulo 2^64 are those of its complement."""
    return "".join(letters[k.bit_count() % 2] for k in range(length))


def test_words_that_defeat_power_sums_are_not_linked(spark):
    texts = [thue_morse("ab"), thue_morse("ba"), f"{thue_morse('ab')} a b c d e", f"{thue_morse('ba')} a b c d f"]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    assert {r["component_id"] for r in jaccard_join.join_classes(df, 4, 85, 100).collect()} == {0, 1, 2, 3}


def test_near_copies_are_compared_with_few(spark, monkeypatch):
    rng = random.Random(11)
    base = text_of(rng, 300).split()
    texts = []
    for k in range(600):  # a large family, and documents that share half a passage with it but aren't linked
        own = list(base) if k % 6 else base[:150] + text_of(rng, 150).split()
        own[rng.randrange(150)] = f"edit{k}"
        texts.append(" ".join(own))
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    made = {}

    def counted(name, own):
        def run(*args):
            out = own(*args)
            made[name] = out.count()
            return out

        return run

    for name in ("pairs", "stars", "qualified"):
        monkeypatch.setattr(jaccard_join.JaccardJoin, name, counted(name, getattr(jaccard_join.JaccardJoin, name)))
    rows = jaccard_join.join_classes(df, 5, 80, 100).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows) == Counter(brute_components([*range(600)], texts, 5, 80, 100))
    assert made["stars"] < 1200 and made["qualified"] < 600 and made["pairs"] < 50  # 500 * 499 / 2 pairs are linked


def test_one_of_rows_that_repeat(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a  b c d e f", "y"), (1, "other words of one kind here", "z"), (None, "a b c d e f", "u"), (None, "lone", "v"), (None, "lone", "v"), (2, "", "w"), (2, None, "w"), (3, "lone two", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _entity string")
    want = None
    for own in (df, df.repartition(3), df.orderBy(F.desc("_entity"))):
        got = sorted(map(tuple, jaccard_join.one_of_each_class(own, 5, 80, 100).collect()), key=str)
        want = want or got
        assert got == want
    assert [r[0] for r in want].count(1) == 2 and [r[0] for r in want].count(None) == 1 and [r[0] for r in want].count(2) == 2 and len(want) == 6


# Mixing


@pytest.mark.parametrize("bucket", [8192, 40])
def test_mix_by_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", bucket)
    rng = random.Random(6)
    sources = ["b", "a", None, "c", "", "z"]
    rows = [(k, "w " * rng.choice((0, 1, 3, 50, 900)), rng.choices(sources, (60, 5, 5, 20, 5, 5))[0], 1.5) for k in range(400)] + [(7, None, "a", 0.0), (None, "w w", None, 0.0), (None, "w w", None, 0.0), (900, " ", "only", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, target double")
    got = mixing.mix(df).toPandas()
    totals = Counter()
    for _, t, s, _ in rows:
        totals[s] += len((t or "").split())
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    weights, rest, capped = dict(zip(order, itertools.cycle((5, 2, 1)))), 1.5 * sum(totals.values()), set()
    while True:
        open_ = [s for s in order if s not in capped]
        room = rest - sum(2 * totals[s] for s in capped)
        share = {s: room * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * totals[s] or not totals[s]}
        if not over:
            break
        capped |= over
    target = {s: 2.0 * totals[s] if s in capped else share[s] for s in order}
    for s, own in got.assign(source=got["source"].where(got["source"].notna(), None)).groupby(got["source"].fillna("~none")):
        name = None if s == "~none" else s
        assert (own["source_size"] == totals[name]).all() and np.allclose(own["target"], target[name])
        assert abs(own["taken"].sum() - target[name]) <= max(1, own["size"].max())
        assert (own["taken"] <= 2 * own["size"]).all()
    assert len(got) == len(rows)
    again = mixing.mix(df.repartition(7)).toPandas()
    key = lambda d: sorted(map(str, d[["doc_id", "size", "taken"]].values.tolist()))
    assert key(again) == key(got)
    assert mixing.take(mixing.mix(df.withColumn("_copy", F.lit(1)))).count() == got["copies"].sum()
    assert mixing.mix(df.limit(0)).count() == 0


# Chats


def render(source, **env):
    return "".join(t for t, _ in chat.compile_template(source)(env))


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("{# no #}a{{ 1 + 2 * 3 }}", "a7"),
        ("{% if x == 'y' and not z %}A{% elif z %}B{% else %}C{% endif %}", "A"),
        ("{% for i in xs %}{{ loop.index }}{{ i|upper }}{% if loop.first %}!{% endif %}{% endfor %}", "1P!2Q"),
        ("{% set k = 'a' ~ 1 %}{{ k }}{{ d.b[0] }}{{ none_such }}", "a17"),
        ('{{ "it\'s"|length }}', "4"),
        ("{{ 'p' in xs }}{{ 'r' not in xs }}{{ missing|default('d') }}", "truetrued"),
        ("a  {%- if true -%}  b {%- endif %} c\n{{- 1 -}} \n{#- x -#} d", "ab c1d"),
    ],
)
def test_template_language(source, want):
    assert render(source, x="y", z=False, xs=["p", "q"], d={"b": [7]}) == want


@pytest.mark.parametrize("source", ["{{ x.y( }}", "{% if x %}", "{{ x|nothing }}", "{% import os %}", "{{ x() }}", "{% for in x %}{% endfor %}", "{{ 1 2 }}", "{{ 1 < 'a' }}", "{{ 'a' * 3 }}", "{{ '%s' % 1 }}", "{{ 1 % 0 }}", "{{ " + "9" * 999 + " * " + "9" * 999 + " }}"])
def test_template_refuses(source):
    with pytest.raises(chat.TemplateError):
        chat.compile_template(source)


def test_sandbox_and_folding():
    assert render("{{ x.__class__ }}{{ x.upper }}", x="s") == ""
    tree = chat.fold(chat.parse("a{{ 'b' ~ 1 }}{% if 1 == 1 %}c{% endif %}{{ x }}"), chat.FILTERS)
    assert tree == chat.Sequence((chat.Output(chat.Const("ab1c")), chat.Output(chat.Name("x"))))
    with pytest.raises(chat.TemplateError):
        render("{% set t = 'ab' %}{% for x in xs %}" + "{% set t = t ~ t %}" + "{% endfor %}", xs=["p"]) or render("{% set t = 'ab' %}" + "{% set t = t ~ t %}" * 40)
    with pytest.raises(chat.TemplateError):
        render("{{ x < 1 }}", x="s")
    marked = list(chat.compile_template("a{% generation %}{{ x }}{% endgeneration %}")({"x": "g"}))
    assert marked == [("a", False), ("g", True)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "[/ROLE]"]), st.text(alphabet="\\01<>/s[]INSTROLED ab", max_size=30))))
def test_turns_read_back(turns):
    messages = iter({"role": r, "text": t} for r, t in turns)
    text = "".join(t for t, _ in chat.chat_template(chat.TEMPLATE)({"messages": messages}))
    assert list(chat.turns_of(iter(text))) == turns
    assert all(chat.unescape(chat.escape(t)) == t and not any(c in chat.escape(t) for c in chat.CONTROLS) for _, t in turns)


def test_conversations(spark):
    talk = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, None, None, None), (2, 3, "assistant", ""), (None, 1, "tool", "</s>[INST] x"), (3, 0, "assistant", "é[END]\\" * 20_000)]
    df = spark.createDataFrame([(*t, "x") for t in talk], "conv_id long, turn long, role string, text string, loss string")
    pieces = chat.format_conversations(df)
    want = {}
    for c, group in itertools.groupby(sorted(talk, key=lambda t: (t[0] or 0, t[1] if t[1] is not None else -1)), key=lambda t: t[0]):
        own = [(r or "", t or "") for _, _, r, t in group]
        loss = "".join(t for r, t in own if r == "assistant")
        want[c] = (len(own), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for rows in (chat.read_back(pieces), chat.read_back(pieces.repartition(5), ordered=False)):
        assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in rows.collect()} == want
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


# Pipeline


def test_pipeline_by_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline
    import public_tokenizers

    rng = random.Random(8)
    texts = [t or "" for t in near_texts(rng, families=8, copies=5)] + [f"{text_of(rng, 12)} vile slur{k % 3} {text_of(rng, 5)}" for k in range(20)] + [text_of(rng, 15) for _ in range(40)]
    rows = [(k, t, "en", rng.choice(("s0", "s0", "s1", None)), len(t)) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    toxic = {k for k, t in enumerate(texts) if "vile" in t}
    spark.createDataFrame([(k, 1, int(k in toxic)) for k in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    names, stages = zip(*corpus_pipeline.STAGES, strict=True)
    assert names == ("toxicity", "near duplicates", "mixing", "byte-pair encoding")
    clean = stages[0](spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in clean.collect()} == {*range(len(texts))} - toxic
    left = sorted({*range(len(texts))} - toxic)
    classes = brute_components(left, [texts[k] for k in left], 5, 80, 100)
    stay = {i for i, size, c in classes if i == c}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    mixed = mixing.mix(docs.where(F.col("doc_id").isin(sorted(stay)))).collect()
    assert Counter(r["doc_id"] for r in out) == Counter({r["doc_id"]: r["copies"] for r in mixed if r["copies"]})
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in out:
        assert r["ids"] == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
