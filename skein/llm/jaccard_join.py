"""N-gram Jaccard join by a token-group matrix.

A document's tokens are hashes of its word n-grams. Documents with equal token sets are one entity, so exact copies cost
one. Similar entities are partitioned into groups; a group stores the union of its members' tokens. A query's overlap
with any member is at most its overlap with the union, so a group is opened (its members compared) only if that bound
reaches what a link needs: two sets of Jaccard index >= num / den share at least ceil(num * size / den) tokens of either.

How it scales:

- Token sets are larger than texts, so none is stored or shuffled but those that bit vectors can't tell apart; texts are
  read once for sizes and bit vectors, once to count frequent tokens and once for prefixes. Tables between
  steps are deleted.
- Which groups a query can qualify for is read off the sparse rows of the matrix: in an order of all tokens that puts
  frequent ones last, two linked sets share a token among the first size - need + 1 of each (the prefix). Only prefix
  tokens are shuffled, packed by hash bucket; a very frequent one is split over several buckets. Frequent tokens are
  counted over all documents; at most ``MOST_FREQUENT`` of them are broadcast. The order is the same everywhere, so that
  bound costs speed only, never a link.
- Entities are first brought together by the prefix token that they share with most others, in batches of ``MEMBERS``
  with the token's first entity in each, and compared with few of the batch. What is linked so (exactly) is a family.
- Groups are parts of a family, of ``MEMBERS`` entities at most, or (small families of one such token) several of them.
  Entities of one family need no further comparison, so N near copies cost N comparisons or so and not N * N; only groups
  that share a prefix token and aren't of the same single family are paired. A pair is a piece of work of its own, of
  bounded size, so a group that many others share tokens with is no hot key.
- Unions and queries are first held as bit vectors of two to four bits a token: bits of a query that the union (or a
  member) lacks are tokens that it lacks, so the bound holds. Only what passes gets its whole token set, by hash of
  which overlaps are then counted exactly. A pair returns a spanning forest of its links instead of all of them.

Token sets are compared by 64-bit hashes, entities told apart by a 64-bit hash of the set: two different n-grams, or sets, count as one
with the chance of random numbers. Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased. With fewer words than the
n-gram has, the whole sequence is one token. Null texts and texts without words have no tokens and no links. Documents
without an id take part, but a component has the smallest id that is not null. Rows that repeat an id are documents of
their own. An empty table gives an empty table. Input columns besides id and text are not read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from skein.llm.blocks import U64, SpanHasher, mix, text_blocks, words
from skein.llm.shared import Scratch, free_name, freed_shuffles, small_batches, written
from skein.operators.graph import components

#: A token of more documents than this is frequent; only so many frequent ones are told to all tasks.
FREQUENT, MOST_FREQUENT = 16, 1 << 20
#: A bucket takes a share of a token's documents if it has more than so many.
HOT = 1 << 16
MEMBERS = 128
#: Members of a batch that the others are compared with when families are made, besides the token's first entity.
PIVOTS = 8
BUCKET_TOKENS = 1 << 20
#: Tokens that a task gathers, over batches, before it packs and hands them on.
PACK_TOKENS = 1 << 19
#: Entities that a task remembers so as not to hand on copies of them; all are forgotten beyond that.
MOST_MET = 1 << 18
#: Bytes of a batch that goes back to the JVM.
OUT_BYTES = 4 << 20


def token_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The distinct tokens of each text, ascending."""
    for block in text_blocks(column):
        starts, ends, first = words(block)
        hashes = SpanHasher(block.data, fold=True)(starts, ends)
        grams = np.zeros(max(0, len(hashes) - n + 1), U64)
        for j in range(n):
            grams = mix(grams * U64(3) + hashes[j : j + len(grams)] + U64(j + 1))
        for a, z in itertools.pairwise(first.tolist()):
            if z - a >= n:
                own = np.sort(grams[a : z - n + 1])
                yield own[np.concatenate([[True], own[1:] != own[:-1]])]
            elif z > a:
                one = np.zeros(1, U64)
                for j in range(z - a):
                    one = mix(one * U64(3) + hashes[a + j : a + j + 1] + U64(j + 1))
                yield one
            else:
                yield np.empty(0, U64)


def entity_of(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def need(size, num: int, den: int):
    """The least overlap of a set of that size with one that it is linked to."""
    return -(-num * size // den)


def bits_of(tokens: np.ndarray) -> bytes:
    """A bit vector of a power of two of bits, two to four a token."""
    width = max(64, 1 << (2 * max(1, len(tokens)) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(tokens & U64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def narrowed(bits: np.ndarray, width: int) -> np.ndarray:
    """Bit vectors (rows of 64-bit words) of at most so many words, by joining what falls on the same bit."""
    while bits.shape[-1] > width:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


def spanning(edges: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those edges that join what earlier ones had not joined."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in edges:
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


def _packed(buckets: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket with its part of every column, as bytes."""
    order = np.argsort(buckets, kind="stable")
    own, begins = np.unique(buckets[order], return_index=True)
    cuts = [*begins.tolist(), len(order)]
    arrays = [pa.array(own.astype(np.int64))]
    for values in columns.values():
        values = values[order]
        arrays.append(pa.array([values[a:b].tobytes() for a, b in itertools.pairwise(cuts)], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, ["bucket", *columns])


def _gathered(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[dict[int, np.ndarray]]:
    """Entities of the batches' texts and their token sets, as many at a time as have PACK_TOKENS together. Copies that a task has met lately are left
    out, so a text that stands in many documents comes once a task or so."""
    own: dict[int, np.ndarray] = {}
    held, met = 0, set()
    for batch in batches:
        for tokens in token_sets(batch.column("text"), n):
            if not len(tokens) or (key := entity_of(tokens)) in met:
                continue
            if len(met) >= MOST_MET:
                met.clear()
            met.add(key)
            own[key] = tokens
            held += len(tokens)
            if held >= PACK_TOKENS:
                yield own
                own, held = {}, 0
    if own:
        yield own


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows that follow each other with equal first columns."""
    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for _, group in itertools.groupby(rows, key=lambda r: r[:keys]):
        yield list(group)


def _rows(rows: list[tuple], *more: str) -> pa.RecordBatch:
    names = ["a", "b", "role", "entity", *more]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int32() if n == "role" else pa.int64()) for c, n in enumerate(names)], names)


def _links(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"])


def with_entity(df: DataFrame, n: int, text: str, entity: str) -> DataFrame:
    """df with each text's entity (null without tokens)."""
    kept = [f for f in df.schema.fields if f.name != entity]
    schema = T.StructType([*kept, T.StructField(entity, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [entity_of(s) if len(s) else None for s in token_sets(batch.column(text), n)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(found, pa.int64())], schema.names)

    return df.mapInArrow(run, schema)


class JaccardJoin:
    """The join of one table of documents. Tables that callers read: sizes, a row a document (doc_id, entity, null
    without tokens; size), and families, (entity, family) of entities that may be linked to others: the smallest entity
    that links reach."""

    def __init__(self, scratch: Scratch, df: DataFrame, n: int, num: int, den: int, doc_id: str = "doc_id", text: str = "text"):
        self.n, self.num, self.den, self.scratch = n, num, den, scratch
        self.docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
        measured = scratch.written(self._tokenised(self.docs, bits=True), "join-sizes")
        self.sizes = measured.select("doc_id", "entity", "size")
        tokens, self.no_ids = self.sizes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count_if(F.col("doc_id").isNull()) > 0).first()
        self.buckets = 1 + tokens // BUCKET_TOKENS
        self.files = 8 + self.buckets // 4  # of a small table
        shared = scratch.written(self.shared_prefixes(), "join-prefixes", self.buckets + 8)
        best = self._kept(shared.groupBy("entity", "size").agg(F.max(F.struct("n", "token"))["token"].alias("grp")), "best")
        entities = measured.where("entity is not null").groupBy("entity").agg(F.min("doc_id").alias("doc_id"), F.any_value("content").alias("bits"))
        entities = self._kept(entities.join(best.select("entity"), "entity", "left_semi"), "entities")
        stars = self._kept(self.stars(best, entities), "stars")
        first = components(self.links(stars, entities), keep=scratch)
        groups = self._kept(self.groups(best, first), "groups")
        holding = self._kept(self.holding(shared, groups), "holding")
        scratch.drop(shared, best, stars)
        pairs = self._kept(self.pairs(holding), "pairs")
        scratch.drop(holding)
        qualified = self._kept(self.qualified(pairs, groups, entities), "qualified")
        second = components(self.links(qualified, entities), keep=scratch).withColumnRenamed("node", "family")
        self.families = groups.select("entity", "family").join(second, "family", "left").select("entity", F.coalesce("component", "family").alias("family"))

    def _kept(self, table: DataFrame, name: str) -> DataFrame:
        return self.scratch.written(table, f"join-{name}", self.files)

    def _tokenised(self, docs: DataFrame, bits: bool) -> DataFrame:
        """(doc_id, entity, size, content) of each row: content is the token set, or its bit vector."""
        n = self.n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sets, begin = token_sets(batch.column("text"), n), 0
                while begin < batch.num_rows:
                    held, total = [], 0
                    for tokens in sets:
                        held.append((entity_of(tokens) if len(tokens) else None, len(tokens), bits_of(tokens) if bits else tokens.tobytes()))
                        total += len(held[-1][2])
                        if total > OUT_BYTES:
                            break
                    columns = [pa.array([row[c] for row in held], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.binary()))]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(begin, len(held)), *columns], ["doc_id", "entity", "size", "content"])
                    begin += len(held)

        return docs.mapInArrow(run, "doc_id long, entity long, size long, content binary")

    def low(self) -> np.uint64:
        return U64(min(2**64 - 1, int(2 * (1 - self.num / self.den) * 2**64)))

    def frequent(self) -> tuple[np.ndarray, np.ndarray]:
        """Tokens (ascending) that more than FREQUENT texts have, and how many have them; the most frequent, at most
        MOST_FREQUENT. Only the low part of the hash range is counted, from which prefixes are taken."""
        n, buckets, low = self.n, self.buckets, self.low()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for sets in _gathered(batches, n):
                tokens, counts = np.unique(np.concatenate([tokens[: np.searchsorted(tokens, low)] for tokens in sets.values()]), return_counts=True)
                place = (mix(tokens) % U64(buckets)).astype(np.int64)
                # Most tokens are met once: those come as they are, the others with their counts.
                for several in (counts == 1, counts > 1):
                    yield _packed(place[several], tokens=tokens[several], counts=counts[several].astype(np.int32) if counts[several].max(initial=1) > 1 else np.empty((several.sum(), 0), np.int32))

        def count(table: pa.Table) -> pa.Table:
            tokens = [np.frombuffer(x, U64) for x in table.column("tokens").to_pylist()]
            counts = [np.frombuffer(x, np.int32) if x else np.ones(len(t), np.int32) for x, t in zip(table.column("counts").to_pylist(), tokens, strict=True)]
            distinct, which = np.unique(np.concatenate(tokens), return_inverse=True)
            total = np.bincount(which, np.concatenate(counts), len(distinct)).astype(np.int64)
            often = total > FREQUENT
            return pa.table({"token": distinct[often].view(np.int64), "n": total[often]})

        packed = self.docs.select("text").mapInArrow(run, "bucket long, tokens binary, counts binary")
        counted = packed.groupBy("bucket").applyInArrow(count, "token long, n long")
        with freed_shuffles(self.docs.sparkSession):
            rows = counted.orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).toPandas()
        tokens, n = rows["token"].to_numpy(np.int64).view(U64), rows["n"].to_numpy(np.int64)
        order = np.argsort(tokens)
        return tokens[order], n[order]

    def shared_prefixes(self) -> DataFrame:
        """(entity, size, tokens, n, token): prefix tokens that other entities have in their prefixes, a row for each
        bucket that holds some, and that of them which most (n) have."""
        num, den, width, buckets, low = self.num, self.den, self.n, self.buckets, self.low()
        told = self.sizes.sparkSession.sparkContext.broadcast(self.frequent())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            often, n_of = told.value
            for sets in _gathered(batches, width):
                own, ranks, lengths, sizes = [], [], [], []
                for tokens in sets.values():
                    size = len(tokens)
                    length, rank = size - need(size, num, den) + 1, np.zeros(size, np.int64)
                    if len(often):
                        part = tokens[: np.searchsorted(tokens, low)]
                        at = np.minimum(np.searchsorted(often, part), len(often) - 1)
                        rank[: len(part)] = np.where(often[at] == part, n_of[at], 0)
                        if rank.any():
                            order = np.argsort(rank, kind="stable")[:length]
                            tokens, rank = tokens[order], rank[order]
                    own.append(tokens[:length])
                    ranks.append(rank[:length])
                    lengths.append(length)
                    sizes.append(size)
                tokens, entities, sizes = np.concatenate(own), np.repeat(np.array(list(sets), np.int64), lengths), np.repeat(np.array(sizes, np.int32), lengths)
                # A hot token goes to several buckets. It is known to be shared, which a size below zero says.
                salts = np.concatenate(ranks) // HOT
                place = mix(tokens) + np.where(salts > 0, mix(entities.view(U64)) % (salts + 1).astype(U64), U64(0))
                yield _packed((place % U64(buckets)).astype(np.int64), tokens=tokens, entities=entities, sizes=np.where(salts > 0, -sizes, sizes))

        def shared(table: pa.Table) -> pa.Table:
            tokens, entities, sizes = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("tokens", U64), ("entities", np.int64), ("sizes", np.int32)))
            order = np.lexsort((entities, tokens))
            tokens, entities, sizes = tokens[order], entities[order], sizes[order]
            new = np.ones(len(tokens), bool)  # copies of an entity come from different tasks
            new[1:] = (tokens[1:] != tokens[:-1]) | (entities[1:] != entities[:-1])
            tokens, entities, sizes = tokens[new], entities[new], sizes[new]
            _, which, counts = np.unique(tokens, return_inverse=True, return_counts=True)
            n = counts[which].astype(np.int64)
            several = (n > 1) | (sizes < 0)
            tokens, entities, sizes, n = tokens[several], entities[several], np.abs(sizes[several]).astype(np.int64), n[several]
            order = np.lexsort((tokens, n, entities))
            tokens, entities, sizes, n = tokens[order], entities[order], sizes[order], n[order]
            begins = np.flatnonzero(np.diff(entities, prepend=entities[:1] - 1))
            ends = np.append(begins[1:], len(entities))[: len(begins)]
            content = pa.array([tokens[a:b].tobytes() for a, b in zip(begins.tolist(), ends.tolist(), strict=True)], pa.binary())
            return pa.table({"entity": entities[begins], "size": sizes[begins], "tokens": content, "n": n[ends - 1], "token": tokens[ends - 1].view(np.int64)})

        packed = self.docs.select("text").mapInArrow(run, "bucket long, tokens binary, entities binary, sizes binary")
        return packed.groupBy("bucket").applyInArrow(shared, "entity long, size long, tokens binary, n long, token long")

    def stars(self, best: DataFrame, entities: DataFrame) -> DataFrame:
        """(a, b, role, entity, family): some entities (role 0) of each grp of best (entity, size, grp), and those of its
        others (role 1) that may be linked to one, as bit vectors tell."""
        num, den = self.num, self.den
        several = best.groupBy("grp").agg(F.count("*").alias("n"), pieces(F.count("*"), F.sum("size")).alias("batches"), F.min_by(F.struct("entity", "size"), "entity").alias("leader")).where("n > 1")
        several = self._kept(several, "several")  # so that the join below has nothing but exchanges on either side, and a hot grp is split
        rows = best.join(several, "grp").select("grp", F.pmod(F.xxhash64("entity"), F.col("batches")).alias("batch"), F.lit(1).alias("role"), "entity", "size")
        leaders = several.where("batches > 1").select("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("batches") - 1)).alias("batch"), F.lit(0).alias("role"), "leader.entity", "leader.size")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in _groups(batches, 2):
                left, out = [{"entity": r[3], "family": r[3], "size": r[4], "bits": r[5]} for r in rows], []
                for k in range(PIVOTS + 1):
                    if len(left) < 2:
                        break
                    pivot, left = left[0], left[1:]
                    near = {*may_link([pivot], left, num, den)[1]}
                    if near:
                        star = int(mix(np.array([rows[0][1] * (PIVOTS + 1) + k], U64)).view(np.int64)[0])
                        out += [(rows[0][0], star, role, m["entity"]) for role, ms in ((0, [pivot]), (1, [left[i] for i in near])) for m in ms]
                    left = [m for i, m in enumerate(left) if i not in near]
                if out:
                    yield _rows(out)

        beside = rows.unionByName(leaders).join(entities.select("entity", "bits"), "entity").select("grp", "batch", "role", "entity", "size", "bits")
        found = beside.repartition("grp", "batch").sortWithinPartitions("grp", "batch", "role", "entity").mapInArrow(run, "a long, b long, role int, entity long")
        return found.withColumn("family", F.col("entity"))

    def groups(self, best: DataFrame, first: DataFrame) -> DataFrame:
        """(entity, size, family, part): entities of one grp are dealt to parts, a family of over MEMBERS to its own."""
        members = best.join(first.select(F.col("node").alias("entity"), F.col("component").alias("family")), "entity", "left").withColumn("family", F.coalesce("family", "entity"))
        counts = members.groupBy("grp", "family").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
        large = counts.select("grp", "family", pieces(F.col("n"), F.col("total")).alias("own")).where("own > 1")
        small = counts.where(pieces(F.col("n"), F.col("total")) == 1).groupBy("grp").agg(pieces(F.sum("n"), F.sum("total")).alias("pool")).where("pool > 1")
        large, small = self._kept(large, "large"), self._kept(small, "small")  # for the same reason
        dealt = members.join(large, ["grp", "family"], "left").join(small, "grp", "left")
        part = F.when(F.col("own").isNotNull(), F.xxhash64("grp", "family", F.pmod(F.xxhash64("entity"), F.col("own")))).otherwise(F.xxhash64("grp", F.pmod(F.xxhash64("family"), F.coalesce("pool", F.lit(1)))))
        return dealt.select("entity", "size", "family", part.alias("part"))

    def holding(self, shared: DataFrame, groups: DataFrame) -> DataFrame:
        """(token, part, least, most, lo, hi): sizes and families of a part's entities with the token in their prefix, for
        the tokens that several families have."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                tokens = [np.frombuffer(x.as_buffer(), np.int64) for x in batch.column("tokens")]
                lengths = [len(t) for t in tokens]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), *(pa.array(np.repeat(np.asarray(batch.column(c)), lengths)) for c in ("part", "size", "family"))], ["token", "part", "size", "family"])

        rows = shared.select("entity", "tokens").join(groups, "entity").select("tokens", "part", "size", "family").mapInArrow(run, "token long, part long, size long, family long")
        held = rows.groupBy("token", "part").agg(F.min("size").alias("least"), F.max("size").alias("most"), F.min("family").alias("lo"), F.max("family").alias("hi"))
        everywhere = Window.partitionBy("token")
        return held.withColumns({"first": F.min("lo").over(everywhere), "last": F.max("hi").over(everywhere)}).where("first < last").drop("first", "last")

    def pairs(self, holding: DataFrame) -> DataFrame:
        """(a, b), a <= b: parts that share a token, unless all who have it are of one family, or of too different sizes."""
        num, den = self.num, self.den
        right = holding.select("token", *(F.col(c).alias(f"{c}2") for c in holding.columns if c != "token"))
        differ = F.least("lo", "lo2") < F.greatest("hi", "hi2")
        near = (F.col("most2") * den >= F.col("least") * num) & (F.col("least2") * num <= F.col("most") * den)
        return holding.join(right, "token").where((F.col("part") <= F.col("part2")) & differ & near).select(F.col("part").alias("a"), F.col("part2").alias("b")).distinct()

    def qualified(self, pairs: DataFrame, groups: DataFrame, entities: DataFrame) -> DataFrame:
        """(a, b, role, entity, family): for each pair the queries (role 1, of a) for which the group b opens and may hold
        a partner, and the members (role 0, of b) that may be partners, as bit vectors tell."""
        num, den = self.num, self.den

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list[tuple] = []
                for a, b, own, other in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "queries", "members")), strict=True):
                    queries, members = may_link(own, other, num, den)
                    if a == b:
                        queries, members = [], sorted({*queries, *members})
                    out += [(a, b, 1, own[k]["entity"], own[k]["family"]) for k in queries]
                    out += [(a, b, 0, other[k]["entity"], other[k]["family"]) for k in members]
                if out:
                    yield _rows(out, "family")

        named = pairs.select(F.col("a").alias("part")).union(pairs.select("b")).distinct()
        rows = groups.join(named, "part", "left_semi").join(entities.select("entity", "bits"), "entity")
        # A part has MEMBERS entities or so, so a list of them is bounded.
        matrix = rows.groupBy("part").agg(F.collect_list(F.struct("entity", "size", "family", "bits")).alias("rows"))
        beside = pairs.join(matrix.select(F.col("part").alias("a"), F.col("rows").alias("queries")), "a").join(matrix.select(F.col("part").alias("b"), F.col("rows").alias("members")), "b")
        return beside.mapInArrow(run, "a long, b long, role int, entity long, family long")

    def links(self, rows: DataFrame, entities: DataFrame) -> DataFrame:
        """(a, b): families that links join, of the queries and members in rows (a, b, role, entity, family)."""
        num, den = self.num, self.den

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in _groups(batches, 2):
                if edges := spanning(linked([(r[2], r[4], np.frombuffer(r[5], U64)) for r in rows], num, den)):
                    yield _links(edges)

        beside = rows.join(self._sets_of(rows, entities), "entity").select("a", "b", "role", "entity", "family", "content")
        return beside.repartition("a", "b").sortWithinPartitions("a", "b", "role", "entity").mapInArrow(run, "a long, b long")

    def _sets_of(self, rows: DataFrame, entities: DataFrame) -> DataFrame:
        """(entity, content): the token sets of the entities named and some more, each from the text of its document with
        the least id. If some document has no id, all texts without one are read."""
        ids = entities.join(rows.select("entity").distinct(), "entity", "left_semi").select("doc_id").distinct()
        texts = self.docs.join(ids, "doc_id", "left_semi")
        if self.no_ids:
            texts = texts.unionByName(self.docs.where("doc_id is null"))
        found = self._tokenised(texts, bits=False).select("entity", "content")
        # Rows that repeat an id, or have none, may give an entity several times.
        return found.dropDuplicates(["entity"])

    def classes(self) -> DataFrame:
        """One row a document: doc_id, n_shingles, component_id."""
        least = self.sizes.where("entity is not null").groupBy("entity").agg(F.min("doc_id").alias("least"))
        joined = self.families.join(least, "entity").groupBy("family").agg(F.min("least").alias("reached"))
        reached = self.families.join(joined, "family").select("entity", "reached")
        # A table of its own, so that the join with it has nothing but exchanges on either side and hot entities are split.
        named = self._kept(least.join(reached, "entity", "left").select("entity", F.coalesce("reached", "least").alias("component_id")), "named")
        rows = self.sizes.where("entity is not null").join(named, "entity").select("doc_id", F.col("size").alias("n_shingles"), "component_id")
        return rows.unionByName(self.sizes.where("entity is null").select("doc_id", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id")))

    def kept(self) -> DataFrame:
        """(entity, doc_id) of the document that stays of each class with tokens: the smallest id (nulls last), then entity."""
        order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("entity").alias("entity"))
        own = self.sizes.where("entity is not null").groupBy("entity").agg(F.min(order).alias("one"))
        return own.join(self.families, "entity", "left").groupBy(F.coalesce("family", "entity").alias("class")).agg(F.min("one").alias("one")).select("one.entity", "one.doc_id")


def pieces(n: Column, tokens: Column) -> Column:
    """How many parts n entities with so many tokens together make."""
    return F.greatest(F.ceil(n / MEMBERS), F.ceil(tokens / BUCKET_TOKENS))


def may_link(queries: list[dict], members: list[dict], num: int, den: int) -> tuple[list[int], list[int]]:
    """Which queries (entity, size, family, bits) can be linked to a member of another family, and which members to one."""
    families, sizes = (np.array([m[c] for m in members], np.int64) for c in ("family", "size"))
    bits = [np.frombuffer(m["bits"], U64) for m in members]
    width = max(map(len, bits))
    union = np.zeros(width, U64)
    for b in bits:
        union |= np.tile(b, width // len(b))
    by_width: dict[int, np.ndarray] = {}
    kept, partners = [], np.zeros(len(members), bool)
    for k, q in enumerate(queries):
        own, size = np.frombuffer(q["bits"], U64), q["size"]
        both, least = min(len(own), width), need(size, num, den)
        if size - int(np.bitwise_count(narrowed(own, both) & ~narrowed(union, both)).sum()) < least:
            continue  # the group stays closed
        if len(own) not in by_width:
            by_width[len(own)] = np.stack([narrowed(b, len(own)) if len(b) >= len(own) else np.tile(b, len(own) // len(b)) for b in bits])
        missing = np.bitwise_count(own & ~by_width[len(own)]).sum(axis=1).astype(np.int64)
        likely = (size - missing >= least) & (sizes * den >= size * num) & (sizes * num <= size * den) & (families != q["family"])
        if likely.any():
            kept.append(k)
            partners |= likely
    return kept, np.flatnonzero(partners).tolist()


def linked(rows: list[tuple[int, int, np.ndarray]], num: int, den: int) -> Iterator[tuple[int, int]]:
    """Links between families of rows (role, family, token set): of queries (role 1) to members (role 0), or, without
    queries, of members to each other."""
    members = [r for r in rows if r[0] == 0]
    queries = [r for r in rows if r[0] == 1] or members
    size = np.array([len(s) for _, _, s in members], np.int64)
    tokens = np.concatenate([s for _, _, s in members])
    order = np.argsort(tokens, kind="stable")
    union, begins = np.unique(tokens[order], return_index=True)
    holders = np.repeat(np.arange(len(members)), size)[order]
    ends = np.append(begins[1:], len(order))
    for _, family, own in queries:
        at = np.minimum(np.searchsorted(union, own), len(union) - 1)
        at = at[union[at] == own]
        if len(at) < need(len(own), num, den):
            continue  # the group stays closed
        from_, lengths = begins[at], ends[at] - begins[at]
        stops = np.cumsum(lengths)
        places = np.repeat(from_ - (stops - lengths), lengths) + np.arange(stops[-1])
        overlap = np.bincount(holders[places], minlength=len(members))
        for k in np.flatnonzero(den * overlap >= num * (len(own) + size - overlap)).tolist():
            if members[k][1] != family:
                yield family, members[k][1]


def join_classes(df: DataFrame, n: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Classes of documents that are linked, over others or directly, by a Jaccard index of at least num / den."""
    with small_batches(df.sparkSession), Scratch(df.sparkSession) as scratch:
        return written(JaccardJoin(scratch, df, n, num, den, doc_id, text).classes(), "join-classes")


def one_of_each_class(df: DataFrame, n: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df without the rows that are linked to one that stays: of each class the smallest id stays, once. Texts without
    words all stay. Of rows with equal id and equal token set, that with the smallest hash of all columns stays.

    Rows are kept by id; only those whose id is null or repeated have their token sets made again."""
    with small_batches(df.sparkSession), Scratch(df.sparkSession) as scratch:
        join = JaccardJoin(scratch, df, n, num, den, doc_id, text)
        kept = written(join.kept(), "join-kept")
        repeated = written(join.sizes.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "join-repeated")
        ids = kept.select("doc_id").union(join.sizes.where("entity is null").select("doc_id")).where("doc_id is not null")
        ids = written(ids.join(repeated, "doc_id", "left_anti"), "join-ids")
        odd = not (repeated.isEmpty() and join.sizes.where("doc_id is null").isEmpty())
    entity, nth, own, other = (free_name(df, x) for x in ("_entity", "_nth", "_kept_id", "_kept_entity"))
    id_ = F.col(doc_id).cast("long")
    stay = df.join(ids.withColumnRenamed("doc_id", own), id_ == F.col(own), "left_semi")
    if not odd:
        return stay
    rows = df.where(id_.isNull()).unionByName(df.join(repeated.withColumnRenamed("doc_id", own), id_ == F.col(own), "left_semi"))
    rows = with_entity(rows, n, text, entity)
    one = rows.join(kept.select(F.col("entity").alias(other), F.col("doc_id").alias(own)), (F.col(entity) == F.col(other)) & id_.eqNullSafe(F.col(own)), "left_semi")
    order = F.xxhash64(*(f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()))
    one = one.withColumn(nth, F.row_number().over(Window.partitionBy(entity, doc_id).orderBy(order))).where(F.col(nth) == 1)
    return stay.unionByName(one.select(*df.columns)).unionByName(rows.where(F.col(entity).isNull()).select(*df.columns))
