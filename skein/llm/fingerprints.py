"""Document fingerprints from closed syncmers, in DataFrame operations only.

A text is a sequence of words ([^\\x20\\x09-\\x0D]+). A run of ``K`` words is an anchor if, among the hashes of its inner
runs of ``S`` words, the smallest stands at its first or last place. Whether a run is an anchor depends on its own words
alone, so the same passage has the same anchors in any document, and they can be matched by place.

A fingerprint is all distinct anchor hashes (32 bits, as 8 hex digits each, ascending), and likeness of two fingerprints
is their Jaccard index. With a size, it is only that many of the smallest hashes, and likeness is an estimate: of the
smallest hashes of both, that many, the share that both have. The query has no size; ``SKETCH`` is the functions'. Equal texts have equal fingerprints. A text with words but without an anchor has the hash of its whole word
sequence. Null texts and texts without words have the empty fingerprint; two empty fingerprints have likeness 1, an
empty and another one 0.

Documents are followed in order of descending id, nulls last; those of one id, or without one, in order of a hash of the
text, then of the text. Of the input only id and text are read; other columns are not in the result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

K, S, SKETCH = 5, 2, 128
SPACES = " \t\n\x0b\f\r"
#: Rows of a stretch of documents in id order; quantiles that stretches are cut by, and stretches that are broadcast.
STRETCH_ROWS, QUANTILES, BROADCAST_ROWS = 4096, 4096, 10_000


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def word_list(text: Column) -> Column:
    """The words of a text; no words: an empty array."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed != "", F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def _runs(text: Column, anchor: Callable[[Column, Column], Column]) -> Column:
    """anchor(inner hashes, place from 0) of each anchor of a text; null without words."""

    def over(words: Column) -> Column:
        size = F.size(words)
        hashes = F.transform(words, lambda w: F.xxhash64(w))
        inner = let(hashes, lambda h: F.transform(F.sequence(F.lit(0), size - S), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(S)))))

        def chosen(s: Column) -> Column:
            def at(i: Column) -> Column:
                first, last = F.get(s, i), F.get(s, i + (K - S))
                least = F.least(*(F.get(s, i + j) for j in range(K - S + 1)))
                return F.when((least == first) | (least == last), anchor(s, i))

            return F.filter(F.transform(F.sequence(F.lit(0), size - K), at), lambda x: x.isNotNull())

        return F.when(size >= K, let(inner, chosen))

    return let(word_list(text), over)


def anchor_hash(s: Column, i: Column) -> Column:
    """32 bits of all K words of the run at i, from inner hashes that cover them."""
    places = sorted({*range(0, K - S + 1, S), K - S})
    return F.xxhash64(*(F.get(s, i + j) for j in places)).bitwiseAND(F.lit(0xFFFFFFFF))


def packed(text: Column) -> Column:
    """All anchors of a text in order, a whole number each: the hash in the upper 32 bits, the place of the first word
    below; empty for fewer than K words."""
    found = _runs(text, lambda s, i: F.shiftleft(anchor_hash(s, i), 32).bitwiseOR(i.cast("long")))
    return F.coalesce(found, F.array().cast("array<bigint>"))


def hash_of(anchor: Column) -> Column:
    return F.shiftrightunsigned(anchor, 32)


def anchors(text: Column) -> Column:
    """All anchors of a text in order: array of (hash, place of the first word); empty for fewer than K words."""
    return F.transform(packed(text), lambda p: F.struct(hash_of(p).alias("hash"), p.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("place")))


def _below(table: Column, value: Column) -> Column:
    """How many elements of an ascending array are less than value, by binary search."""
    steps = F.transform(F.sequence(F.ceil(F.log2(F.size(table) + 1)).cast("int"), F.lit(0), F.lit(-1)), lambda b: F.call_function("shiftleft", F.lit(1), b))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(F.get(table, at + step - 1) < value, F.lit(False)), at + step).otherwise(at))


def matches(left: Column, right: Column) -> Column:
    """Anchors of left that stand in right: array of (place in left, offset to a place in right), one for every such
    place, by place in left and then by offset. A repeated passage has as many as its occurrences multiplied."""
    table = F.array_sort(F.transform(right, lambda a: F.struct(a["hash"].alias("hash"), a["place"].alias("place"))))

    def of(t: Column, hashes: Column) -> Column:
        def places(a: Column) -> Column:
            first, end = _below(hashes, a["hash"]), _below(hashes, a["hash"] + 1)
            return F.transform(F.slice(t, first + 1, end - first), lambda b: F.struct(a["place"].alias("place"), (b["place"] - a["place"]).alias("offset")))

        return F.flatten(F.transform(left, places))

    return let(table, lambda t: let(F.transform(t, lambda a: a["hash"]), lambda hashes: of(t, hashes)))


def matched(left: Column, right: Column) -> Column:
    """How many of the packed anchors of left, each place counted, stand anywhere in right."""
    table = F.sort_array(F.array_distinct(F.transform(right, hash_of)))
    return let(table, lambda t: F.size(F.filter(left, lambda p: F.coalesce(F.get(t, _below(t, hash_of(p))) == hash_of(p), F.lit(False)))))


def sketch(text: Column, found: Column, size: int | None = SKETCH) -> Column:
    """The hashes of a fingerprint, ascending, of a text and its packed anchors; size None: all."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    whole = F.when(trimmed != "", F.array(F.xxhash64(F.regexp_replace(trimmed, r"[\x20\x09-\x0D]+", " ")).bitwiseAND(F.lit(0xFFFFFFFF)))).otherwise(F.array().cast("array<bigint>"))
    return F.when(F.size(found) > 0, _least(F.array_distinct(F.transform(found, hash_of)), size)).otherwise(whole)


def _least(hashes: Column, size: int | None) -> Column:
    """The size smallest hashes, or all, ascending."""
    ordered = F.sort_array(hashes)
    return ordered if size is None else F.slice(ordered, 1, size)


def fingerprint(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.hex(h), 8, "0")), "")


def likeness(left: Column, right: Column, size: int | None = SKETCH) -> Column:
    """Of two sketches of that size, from 0 to 1; size None: exact."""
    if size is None:
        both = let(F.size(F.array_intersect(left, right)), lambda n: n / (F.size(left) + F.size(right) - n))
    else:
        both = let(_least(F.array_union(left, right), size), lambda u: F.size(F.array_intersect(F.array_intersect(u, left), right)) / F.size(u))
    return F.when(F.size(left) + F.size(right) == 0, 1.0).when((F.size(left) == 0) | (F.size(right) == 0), 0.0).otherwise(both)


def _share(text: Column, pieces: Column) -> Column:
    """Which of so many equal ranges of hashes that of the text falls in, the largest hashes in 0."""
    return F.greatest(F.lit(0).cast("long"), pieces - 1 - F.floor((F.xxhash64(text).cast("double") / F.lit(2.0**64) + 0.5) * pieces))


def _stretch(doc_id: Column, text: Column, cuts: list[int], pieces: int, missing: int) -> Column:
    """The stretch of a row, a struct (cut, piece, hashed) that falls along the order of rows. cut: how many of cuts
    (ascending, from the least id to above the greatest; each as often as it is a quantile) the id has reached. piece: the
    interval of ids above that cut is split evenly in so many. hashed: an id that is several cuts is split by the hash of
    the text; rows without id are, in missing pieces."""
    own = sorted(set(cuts))
    array = lambda values: F.array(*(F.lit(v).cast("long") for v in values))
    lows, highs, often = array(own), array([*own[1:], own[-1] + 1]), array([cuts.count(c) * pieces for c in own])
    steps = array(1 << b for b in reversed(range(len(own).bit_length())))

    def at(place: Column) -> Column:
        low, high, several = (F.get(a, (place - 1).cast("int")) for a in (lows, highs, often))
        inside = F.floor((doc_id - low - 1).cast("double") / (high - low) * pieces)
        hashed = F.when((doc_id == low) & (several > pieces), _share(text, several)).otherwise(F.lit(0).cast("long"))
        return F.struct(place.alias("cut"), F.when(doc_id == low, F.lit(-1).cast("long")).otherwise(F.least(inside, F.lit(pieces - 1).cast("long"))).alias("piece"), hashed.alias("hashed"))

    zero = F.lit(0).cast("long")
    found = F.aggregate(steps, zero, lambda n, step: F.when(F.coalesce(F.get(lows, (n + step - 1).cast("int")) <= doc_id, F.lit(False)), n + step).otherwise(n))
    none = F.struct(F.lit(-1).cast("long").alias("cut"), zero.alias("piece"), _share(text, F.lit(missing).cast("long")).alias("hashed"))
    return F.when(doc_id.isNull(), none).otherwise(let(found, at))


def with_next(df: DataFrame, add: dict[str, Column], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """_id, _text and the columns add, with those of the next row as _next_<name>: in order of descending id (nulls
    last), then of the text's hash, then text; after the last row comes the first.

    The ids are cut into stretches by their quantiles, and between quantiles evenly where there are more stretches than
    ``QUANTILES``; ids that many rows share, or lack, are cut by the text's hash. Rows are put in order within a stretch, and
    only the first row of each stretch is passed on to the one before. Rows are dealt with their texts alone; add is
    computed after that."""
    names = ["_text", *add]
    rows = df.select(F.col(doc_id).cast("long").alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    ids = rows.select("_id")
    n, missing, least, most = ids.agg(F.count("*"), F.count_if(F.col("_id").isNull()), F.min("_id"), F.max("_id")).first()
    parts, quantiles = max(1, -(-n // STRETCH_ROWS)), max(1, min(-(-n // STRETCH_ROWS), QUANTILES))
    inner = ids.approxQuantile("_id", [k / quantiles for k in range(1, quantiles)], 0.1 / quantiles) if quantiles > 1 and least is not None else []
    cuts = [0] if least is None else sorted([least, *map(int, inner), most + 1])
    stretch = _stretch(F.col("_id"), F.col("_text"), cuts, -(-parts // quantiles), max(1, -(-missing // STRETCH_ROWS)))
    rows = rows.withColumns({"_stretch": stretch, "_hash": F.xxhash64("_text")})
    # One row a stretch: the stretch that it follows, and the id that it begins with.
    tops = rows.groupBy("_stretch").agg(F.max("_id").alias("_top"))
    downwards, everything = Window.orderBy(F.col("_stretch").desc()), Window.partitionBy()
    firsts = tops.withColumns({"_before": F.lag("_stretch").over(downwards), "_last": F.min("_stretch").over(everything)})
    firsts = firsts.select("_top", F.col("_stretch").alias("_own"), F.coalesce("_before", "_last").alias("_for"))
    firsts = F.broadcast(firsts) if parts <= BROADCAST_ROWS else firsts
    heads = rows.join(firsts, (F.col("_stretch") == F.col("_own")) & F.col("_top").eqNullSafe(F.col("_id")))
    heads = heads.withColumn("_nth", F.row_number().over(Window.partitionBy("_for").orderBy("_hash", "_text"))).where("_nth = 1")
    heads = heads.withColumns(add).select("_for", F.struct(*names).alias("_head"))
    order = Window.partitionBy("_stretch").orderBy(F.col("_id").desc_nulls_last(), "_hash", "_text")
    rows = rows.repartition("_stretch").withColumns(add).withColumn("_lead", F.lead(F.struct(*names)).over(order))
    rows = rows.join(heads, F.col("_stretch") == F.col("_for"), "left")
    following = F.coalesce("_lead", "_head")
    return rows.select("_id", *names, *(following[n].alias(f"_next{n}") for n in names))


def fingerprint_edits(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int | None = SKETCH) -> DataFrame:
    """Fingerprints of each document and of its edited text (its last half replaced by the start of the next document),
    and their likenesses to the document's and the next document's; size None: of all anchors.

    Whatever the size, all anchors are counted, each place by itself: those of the document, those of them that stand in
    the edited text, there at the same place, and in the next document."""
    rows = with_next(df, {"_anchors": packed(F.col("_text"))}, doc_id, text)
    rows = rows.withColumn("n_chars", F.length("_text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("_text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("_next_text"), F.lit(1), half))
    rows = rows.withColumn("_edited", edited).withColumn("_edited_anchors", packed(F.col("_edited")))
    rows = rows.withColumns({f"{n}_sketch": sketch(F.col(t), F.col(f"{n}_anchors"), size) for n, t in (("", "_text"), ("_edited", "_edited"), ("_next", "_next_text"))})
    return rows.select(
        F.col("_id").alias("doc_id"),
        "n_chars",
        F.sha2("_edited", 256).alias("edited_sha256"),
        fingerprint(F.col("_sketch")).alias("fingerprint"),
        fingerprint(F.col("_edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("_sketch"), F.col("_edited_sketch"), size).alias("near_edited"),
        likeness(F.col("_sketch"), F.col("_next_sketch"), size).alias("near_next"),
        F.size("_anchors").cast("long").alias("n_anchors"),
        matched(F.col("_anchors"), F.col("_edited_anchors")).cast("long").alias("matched_edited"),
        F.size(F.array_intersect("_anchors", "_edited_anchors")).cast("long").alias("placed_edited"),
        matched(F.col("_anchors"), F.col("_next_anchors")).cast("long").alias("matched_next"),
    )
