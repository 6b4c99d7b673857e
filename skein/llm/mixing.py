"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every document of a source is expected as often as the source's target asks for: target / size of the source. These
expected copies are summed along the source's documents, a random offset of the source's own is added, and a document
is emitted once for each whole number that the sum passes on it. Documents stand in order of size (in classes an eighth
wide), so what is taken stays near the target however sizes are spread; within a class a hash orders them.

The prefix sum needs no task to see a whole source: a source is cut into buckets (size class, range of the hash) of
about ``BUCKET_ROWS`` rows, whose counts are summed first, and rows are numbered within their bucket.

Sizes are words ([^\\x20\\x09-\\x0D]+); null texts and empty texts have size 0. Sources are weighed in code point order,
null last and a source like any other. A source of size 0 has target 0. A row without an id is hashed by all its columns
instead, so rows without ids are no hot bucket; which of equal rows is taken makes no difference. Rows that repeat an id
are documents of their own. An empty table gives an empty table. All columns stay; one that has the
name of a result is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from skein.llm.shared import free_name, written

WORD = r"[^\x20\x09-\x0D]+"
BUCKET_ROWS = 8192
ADDED = ("size", "source_size", "target", "copies", "taken")


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


#: Grows with _size: its number of bits, then the first four of them.
SIZE_CLASS = "cast(length(bin(_size)) * 16 + shiftright(_size, greatest(length(bin(_size)) - 4, 0)) as int)"


def source_targets(sizes: DataFrame, share: float, weights: tuple[int, ...], cap: int) -> DataFrame:
    """For each source of (_source, source_size): its target. Targets above cap times the size stop there, and the rest
    is shared by weight among the others. One row a source goes in and out."""
    everything = Window.partitionBy()
    order = Window.orderBy(F.col("_source").asc_nulls_last())
    rows = sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1).cast("double"))
    rows = rows.withColumns({"_cap": F.col("source_size") * F.lit(float(cap)), "_all": F.sum("source_size").over(everything) * F.lit(share), "_weights": F.sum("_w").over(everything)})
    before = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0.0))
    rows = rows.withColumns({"_caps": earlier("_cap"), "_ws": earlier("_w")})
    rows = rows.withColumn("_full", F.col("_cap") * (F.col("_weights") - F.col("_ws")) <= F.col("_w") * (F.col("_all") - F.col("_caps")))
    summed = lambda c: F.sum(F.when(F.col("_full"), F.col(c)).otherwise(0.0)).over(everything)
    rows = rows.withColumns({"_rest": F.col("_all") - summed("_cap"), "_open": F.col("_weights") - summed("_w")})
    target = F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_w") * F.col("_rest") / F.nullif(F.col("_open"), F.lit(0.0)))
    return rows.select("_source", "source_size", target.alias("target"))


def mix(df: DataFrame, share: float = 1.5, weights: tuple[int, ...] = (5, 2, 1), cap: int = 2, seed: str = "mix", size: Column | None = None, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """df with size, source_size, target, copies (how often the mix takes the row) and taken (copies * size)."""
    buckets = max(1, -(-df.count() // BUCKET_ROWS))
    hashable = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    hashed = lambda c, digits: F.conv(F.substring(F.md5(c), 1, digits), 16, 10).cast("long")
    rows = df.select(F.struct(*df.columns).alias("_row"), F.col(source).alias("_source"), F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("row "), F.xxhash64(*hashable).cast("string"))).alias("_id"), (word_count(text) if size is None else size).alias("_size"))
    rows = rows.withColumns({"_class": F.expr(SIZE_CLASS), "_hash": hashed("_id", 8)})
    rows = rows.withColumn("_bucket", F.floor(F.col("_hash") * F.lit(buckets) / F.lit(2.0**32)).cast("int"))
    keys = ["_source", "_class", "_bucket"]
    counts = written(rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.sum("_size").alias("_words")), "mix-buckets")
    targets = source_targets(counts.groupBy("_source").agg(F.sum("_words").alias("source_size")), share, weights, cap)
    before = Window.partitionBy("_source").orderBy("_class", "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    plan = counts.alias("c").join(targets.alias("t"), F.col("c._source").eqNullSafe(F.col("t._source"))).select("c.*", "t.source_size", "t.target")
    plan = plan.select(*(F.col(k).alias(f"{k}2") for k in keys), "_before", "source_size", "target")
    joined = rows.join(plan, [F.col(k).eqNullSafe(F.col(f"{k}2")) for k in keys])
    rank = F.col("_before") + F.row_number().over(Window.partitionBy(*keys).orderBy("_hash", "_id", "_size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = hashed(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("="), F.col("_source")), F.lit(""))), 6) / F.lit(2.0**24)
    joined = joined.withColumns({"_rank": rank, "_rate": rate, "_offset": offset})
    copies = F.floor(F.col("_rate") * F.col("_rank") + F.col("_offset")) - F.floor(F.col("_rate") * (F.col("_rank") - 1) + F.col("_offset"))
    kept = [F.col(f"_row.{c}").alias(c) for c in df.columns if c not in ADDED]
    return joined.withColumn("_copies", copies).select(*kept, F.col("_size").alias("size"), "source_size", "target", F.col("_copies").alias("copies"), (F.col("_copies") * F.col("_size")).alias("taken"))


def take(mixed: DataFrame) -> DataFrame:
    """Each row of a mix as often as it is taken, without the columns that mix added."""
    columns, copy = [c for c in mixed.columns if c not in ADDED], free_name(mixed, "_copy")
    return mixed.where("copies > 0").select(*columns, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(copy)).select(*columns)
