"""Similarity edges between threads: cosine pairs, edge policy, references, best edges of each node."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from skein.functions.text import overlap, reference_evidence, title_tokens
from skein.sources.shared import Scratch

#: Bytes of a block's vectors. All pairs of n rows take n * n / (rows of a block) row copies, so blocks are as large as a
#: task can hold two of.
BLOCK_BYTES = 32 << 20
#: Pairs of blocks for each core, where blocks keep so many rows.
PAIRS_A_CORE, BLOCK_ROWS = 4, 1024
#: Products at once, and those of them that are scored at once.
TILE, CHUNK = 1 << 20, 1 << 16
#: How many times the best edges of a row are looked at first; rows of a block that tell the score of so many.
PER_ROW, SAMPLE = 8, 512
EDGE = "left_id long, right_id long, score double"
#: BLAS sums in another order than the exact score; pairs this close below the threshold are scored as well.
MARGIN = 1e-9


@dataclass(frozen=True)
class EdgePolicy:
    threshold: float = 0.80
    confident: float = 0.90
    title_overlap: float = 0.18
    cross_kind: float = 0.93
    reference: float = 0.94
    fanout: int = 16


def cosine_pairs(vectors: DataFrame, threshold: float, key: str = "repo_id") -> DataFrame:
    """(left_id, right_id, score): pairs of (key, thread_id, vector) rows of equal key with cosine >= threshold, left <
    right. All pairs are compared, in blocks: a key's rows are dealt to blocks, as many as its rows need, each pair of blocks
    is one task's product of two matrices, and what may pass is scored in double precision from left to right."""
    dealt = _dealt(vectors.select(F.col(key).alias("key"), "thread_id", "vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), part in _runs(batches, ("key", "i", "j")):
            ids, block = np.asarray(part.column("thread_id")), np.asarray(part.column("block"))
            for same, x in _matrices(part):
                yield from _block_pairs(ids[same], block[same], x, i, j, threshold)

    return dealt.mapInArrow(run, EDGE)


def policy_pairs(vectors: DataFrame, policy: EdgePolicy) -> DataFrame:
    """Of what filter_edges leaves of cosine_pairs, each block's fanout best edges of each end: all that best_edges can
    take, also beside other edges. vectors: (repo_id, thread_id, kind, tokens, vector) rows. Pairs that are worse than the
    best of both ends so far are neither scored nor is their policy looked up."""
    dealt = _dealt(vectors.select(F.col("repo_id").alias("key"), "thread_id", "kind", "tokens", "vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), part in _runs(batches, ("key", "i", "j")):
            best = _Best(np.asarray(part.column("thread_id")), policy.fanout)
            allowed = _allowed(part, policy)
            block = np.asarray(part.column("block"))
            for same, x in _matrices(part):
                _block_best(same, block[same], x, i, j, policy.threshold, best, allowed)
            yield from best.batches()

    return dealt.mapInArrow(run, EDGE)


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows (key, thread_id, vector, ..) for each pair of blocks (i, j) that needs them, with their own block. A key has as
    many blocks as its rows need, or more if that gives every core a pair. Partitions are ranges, as hashes would put
    several of the few pairs into one task."""
    rows = rows.where(F.size("vector") > 0)
    cores = rows.sparkSession.sparkContext.defaultParallelism
    shared = F.least(F.lit(math.ceil((2 * PAIRS_A_CORE * cores) ** 0.5)), F.ceil(F.count("*") / BLOCK_ROWS))
    needed = F.ceil(F.count("*") * F.max(F.size("vector")) * 8 / F.lit(BLOCK_BYTES))
    counts = rows.groupBy("key").agg(F.greatest(F.lit(1), shared, needed).cast("int").alias("blocks")).withColumnRenamed("key", "of")
    dealt = rows.join(counts, F.col("key").eqNullSafe(F.col("of"))).withColumn("block", F.pmod(F.xxhash64("thread_id"), F.col("blocks")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda n: F.struct(F.least(n, F.col("block")).alias("i"), F.greatest(n, F.col("block")).alias("j")))
    dealt = dealt.select("*", F.explode(pair).alias("p")).select(F.col("p.i").alias("i"), F.col("p.j").alias("j"), "block", *rows.columns)
    dealt = dealt.withColumn("vector", F.col("vector").cast("array<double>"))
    return dealt.repartitionByRange(PAIRS_A_CORE * cores, "key", "i", "j").sortWithinPartitions("key", "i", "j")


def _matrices(part: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of vectors its rows and their matrix."""
    column = pa.concat_arrays([c.cast(pa.list_(pa.float64())) for c in part.column("vector").chunks])
    lengths, flat = np.asarray(pc.list_value_length(column)), np.asarray(column.flatten())
    begins = np.cumsum(lengths) - lengths
    for size in np.unique(lengths).tolist():
        same = np.flatnonzero(lengths == size)
        yield same, flat.reshape(-1, size) if len(same) == len(lengths) else flat[begins[same][:, None] + np.arange(size)]


def _runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows that follow each other with equal keys, as tables."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        rows = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        begin = 0
        for own, group in itertools.groupby(rows):
            end = begin + sum(1 for _ in group)
            if held and own != last:
                yield last, pa.Table.from_batches(held)
                held = []
            last = own
            held.append(batch.slice(begin, end - begin))
            begin = end
    if held:
        yield last, pa.Table.from_batches(held)


def _block_pairs(ids: np.ndarray, blocks: np.ndarray, x: np.ndarray, i: int, j: int, threshold: float) -> Iterator[pa.RecordBatch]:
    norms = np.sqrt(_summed(x, x))
    unit = np.divide(x, norms[:, None], out=np.zeros_like(x), where=norms[:, None] > 0)
    left, right = np.flatnonzero(blocks == i), np.flatnonzero(blocks == j)
    for part in range(0, len(left), 512):
        a = left[part : part + 512]
        p, q = np.nonzero(unit[a] @ unit[right].T >= threshold - MARGIN)
        p, q = a[p], right[q]
        keep = ids[p] < ids[q] if i == j else ids[p] != ids[q]
        p, q = p[keep], q[keep]
        p, q = np.where(ids[p] < ids[q], p, q), np.where(ids[p] < ids[q], q, p)
        both = norms[p] * norms[q]
        score = np.divide(_summed(x[p], x[q]), both, out=np.zeros(len(p)), where=both > 0)
        hit = score >= threshold
        if hit.any():
            yield pa.RecordBatch.from_arrays([pa.array(ids[p][hit]), pa.array(ids[q][hit]), pa.array(score[hit])], ["left_id", "right_id", "score"])


class _Best:
    """The most best edges of each of ids (score, then the smaller other end), of those added; of an edge that is added
    several times, the highest score."""

    def __init__(self, ids: np.ndarray, most: int):
        self.ids, self.node = np.unique(ids, return_inverse=True)
        self.most, self.held, self.fresh = most, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), []
        #: The last edge that counts, by its score and other end, of nodes that have so many.
        self.score, self.other = np.full(len(self.ids), -np.inf), np.full(len(self.ids), len(self.ids))

    def may_take(self, p: np.ndarray, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Whether rows p and q have an edge of this score that is among the best of either."""
        a, b = self.node[p], self.node[q]
        return (score > self.score[a]) | (score > self.score[b]) | (score == self.score[a]) & (b <= self.other[a]) | (score == self.score[b]) & (a <= self.other[b])

    def add(self, p: np.ndarray, q: np.ndarray, score: np.ndarray) -> None:
        a, b = self.node[p], self.node[q]
        self.fresh.append((np.minimum(a, b), np.maximum(a, b), score))

    def settle(self) -> None:
        """Leaves only edges among the best of either end."""
        if not self.fresh:
            return
        a, b, score = (np.concatenate(c) for c in zip(self.held, *self.fresh, strict=True))
        self.fresh = []
        order = np.lexsort((-score, b, a))
        a, b, score = a[order], b[order], score[order]
        first = np.ones(len(a), bool)
        first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        a, b, score = a[first], b[first], score[first]
        node, other, twice = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([score, score])
        order = np.lexsort((other, -twice, node))
        begins = np.searchsorted(node[order], node[order])
        nth = np.arange(len(order)) - begins
        last = order[nth == self.most - 1]
        self.score[node[last]], self.other[node[last]] = twice[last], other[last]
        keep = np.zeros(len(a), bool)
        keep[order[nth < self.most] % len(a)] = True
        self.held = a[keep], b[keep], score[keep]

    def batches(self) -> Iterator[pa.RecordBatch]:
        self.settle()
        a, b, score = self.held
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[a]), pa.array(self.ids[b]), pa.array(score)], ["left_id", "right_id", "score"])


def _allowed(part: pa.Table, policy: EdgePolicy) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """filter_edges for rows of part: whether their edges of these scores stay."""
    kinds = part.column("kind").combine_chunks().dictionary_encode()
    kind = np.asarray(kinds.indices.fill_null(-1))
    tokens = pa.concat_arrays([c.cast(pa.list_(pa.string())) for c in part.column("tokens").chunks])
    count = np.asarray(pc.list_value_length(tokens)).astype(np.int64)
    coded = tokens.flatten().dictionary_encode()
    code, width = np.asarray(coded.indices).astype(np.int64), max(1, len(coded.dictionary))
    begin = np.cumsum(count) - count
    #: A token of a row as one number.
    owned = np.sort(np.repeat(np.arange(len(count)), count) * width + code)

    def titled(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        pair = np.repeat(np.arange(len(p)), count[p])
        nth = np.arange(len(pair)) - np.repeat(np.cumsum(count[p]) - count[p], count[p])
        wanted = q[pair] * width + code[begin[p][pair] + nth]
        at = np.minimum(np.searchsorted(owned, wanted), max(0, len(owned) - 1))
        shared = np.bincount(pair[owned[at] == wanted], minlength=len(p)) if len(pair) else np.zeros(len(p))
        least = np.minimum(count[p], count[q])
        return np.divide(shared, least, out=np.zeros(len(p)), where=least > 0) >= policy.title_overlap

    def allowed(p: np.ndarray, q: np.ndarray, score: np.ndarray) -> np.ndarray:
        keep = (score >= policy.cross_kind) | (kind[p] == kind[q]) & (kind[p] >= 0)
        unsure = np.flatnonzero(keep & (score < policy.confident))
        keep[unsure] = titled(p[unsure], q[unsure])
        return keep

    return allowed


def _block_best(rows: np.ndarray, blocks: np.ndarray, x: np.ndarray, i: int, j: int, threshold: float, best: _Best, allowed: Callable) -> None:
    """Adds the allowed edges between blocks i and j to best. rows: what best and allowed call the rows of x. High scores are
    looked at first: after each floor only rows that may still take an edge below it are compared again."""
    norms = np.sqrt(_summed(x, x))
    unit = np.divide(x, norms[:, None], out=np.zeros_like(x), where=norms[:, None] > 0).astype(np.float32)
    left, right = np.flatnonzero(blocks == i), np.flatnonzero(blocks == j)
    if not len(left) or not len(right):
        return
    begun = False
    for floor in _floors(unit[left], unit[right], threshold, best.most):
        if not begun:
            parts = ((left, right),)
        else:
            best.settle()
            lacks = best.score[best.node[rows]] < last
            # Within one block the pairs of b and a are those of a and b.
            parts = ((left[lacks[left]], right),) if i == j else ((left[lacks[left]], right), (left[~lacks[left]], right[lacks[right]]))
        for some, others in parts:
            _tiles_best(some, others, i == j and not begun, rows, x, unit, norms, floor, threshold, best, allowed)
        begun, last = True, floor


def _floors(a: np.ndarray, b: np.ndarray, threshold: float, most: int) -> list[float]:
    """Scores down to threshold: that of so many times the most edges of a row as PER_ROW says, then of PER_ROW times as many
    each. By some rows of a and b; floors change how much is scored, not what is found."""
    found = a[:: max(1, len(a) // SAMPLE)] @ b[:: max(1, len(b) // SAMPLE)].T
    high = np.sort(found[found > threshold])
    floors, count = [], PER_ROW * most
    while (nth := int(found.size * count / len(b))) < len(high):
        floors.append(float(high[-1 - nth]))
        count *= PER_ROW
    return [*floors, threshold]


def _tiles_best(left: np.ndarray, right: np.ndarray, half: bool, rows: np.ndarray, x: np.ndarray, unit: np.ndarray, norms: np.ndarray, floor: float, threshold: float, best: _Best, allowed: Callable) -> None:
    """Tile by tile, the pairs from floor on. half: left is right, and a pair counts once."""
    # What a sum of products of numbers up to 1 can lose in single precision, twice.
    margin = (x.shape[1] + 4) * 2.0**-22
    tile = max(16, TILE // max(1, len(right)))
    for part in range(0, len(left), tile):
        a, b = left[part : part + tile], right[part:] if half else right
        least = np.maximum(best.score[best.node[rows]], floor) - margin
        found = unit[a] @ unit[b].T
        hits = np.flatnonzero((found >= least[a][:, None].astype(np.float32)) | (found >= least[b][None, :].astype(np.float32)))
        near = found.ravel()[hits].astype(np.float64) + margin
        p, q = a[hits // max(1, len(b))], b[hits % max(1, len(b))]
        for some in range(0, len(p), CHUNK):
            _score_best(p[some : some + CHUNK], q[some : some + CHUNK], near[some : some + CHUNK], rows, x, norms, threshold, best, allowed)
            # To settle costs as much as all that is held.
            if 2 * sum(len(c[2]) for c in best.fresh) >= len(best.held[2]):
                best.settle()


def _score_best(p: np.ndarray, q: np.ndarray, near: np.ndarray, rows: np.ndarray, x: np.ndarray, norms: np.ndarray, threshold: float, best: _Best, allowed: Callable) -> None:
    """near: what scores do not exceed. A pair that is not allowed with it isn't with a lower score."""
    hit = best.node[rows[p]] != best.node[rows[q]]
    p, q, near = p[hit], q[hit], near[hit]
    hit = allowed(rows[p], rows[q], near)
    p, q = p[hit], q[hit]
    both = norms[p] * norms[q]
    score = np.divide(_summed(x[p], x[q]), both, out=np.zeros(len(p)), where=both > 0)
    hit = (score >= threshold) & best.may_take(rows[p], rows[q], score)
    p, q, score = rows[p[hit]], rows[q[hit]], score[hit]
    hit = allowed(p, q, score)
    best.add(p[hit], q[hit], score[hit])


def _summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products, summed from left to right."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += a[:, k] * b[:, k]
    return total


def _titles(title: Column) -> Column:
    return F.coalesce(title_tokens(title), F.array().cast("array<string>"))


def _titles(title: Column) -> Column:
    return F.coalesce(title_tokens(title), F.array().cast("array<string>"))


def filter_edges(pairs: DataFrame, threads: DataFrame, policy: EdgePolicy) -> DataFrame:
    """Drops weak scores, middling ones whose titles share too little, and those between kinds below their own minimum."""
    return _allowed_pairs(pairs, threads.select("id", "kind", _titles(F.col("title")).alias("tokens")), policy)


def _allowed_pairs(pairs: DataFrame, side: DataFrame, policy: EdgePolicy) -> DataFrame:
    rows = pairs.where(F.col("score") >= policy.threshold)
    for name in ("left", "right"):
        rows = rows.join(side.select(F.col("id").alias(f"{name}_id"), F.col("kind").alias(f"{name}_kind"), F.col("tokens").alias(f"{name}_tokens")), f"{name}_id")
    titled = overlap(F.col("left_tokens"), F.col("right_tokens")) >= policy.title_overlap
    same = F.col("left_kind") == F.col("right_kind")
    return rows.where(((F.col("score") >= policy.confident) | titled) & (same | (F.col("score") >= policy.cross_kind))).select("left_id", "right_id", "score")


def facts(threads: DataFrame) -> DataFrame:
    """What a thread brings to its edges: repo_id, id, number, kind, tokens of its title, refs of its title and body."""
    return threads.select("repo_id", "id", "number", "kind", _titles(F.col("title")).alias("tokens"), reference_evidence(F.col("title"), F.coalesce("body", F.lit("")), F.col("number")).alias("refs"))


def reference_edges(threads: DataFrame, policy: EdgePolicy) -> DataFrame:
    """Edges by explicit references between the threads given: in the title, early in the body, or anywhere if titles
    share enough."""
    return _reference_edges(facts(threads), policy)


def _reference_edges(own: DataFrame, policy: EdgePolicy) -> DataFrame:
    rows = own.select("repo_id", "id", "tokens", F.explode("refs").alias("ref"))
    to = own.select(F.col("repo_id").alias("to_repo"), F.col("id").alias("to_id"), F.col("number").alias("to_number"), F.col("tokens").alias("to_tokens"))
    found = rows.join(to, (F.col("repo_id") == F.col("to_repo")) & (F.col("ref.number") == F.col("to_number")) & (F.col("id") != F.col("to_id")))
    titled = overlap(F.col("tokens"), F.col("to_tokens")) >= policy.title_overlap
    found = found.where(F.col("ref.in_title") | F.col("ref.early_body") | titled)
    return found.select(F.least("id", "to_id").alias("left_id"), F.greatest("id", "to_id").alias("right_id"), F.lit(policy.reference).alias("score")).distinct()


def merge_edges(*edges: DataFrame) -> DataFrame:
    """One edge for each pair, with the highest score."""
    rows = edges[0]
    for more in edges[1:]:
        rows = rows.unionByName(more)
    rows = rows.select(F.least("left_id", "right_id").alias("left_id"), F.greatest("left_id", "right_id").alias("right_id"), "score")
    return rows.where("left_id <> right_id").groupBy("left_id", "right_id").agg(F.max("score").alias("score"))


def best_edges(edges: DataFrame, fanout: int) -> DataFrame:
    """Edges that are among the fanout best of either end (score, then the smaller other end)."""
    if fanout <= 0:
        return edges
    ends = edges.select("*", F.explode(F.array("left_id", "right_id")).alias("node"))
    ends = ends.withColumn("other", F.when(F.col("node") == F.col("left_id"), F.col("right_id")).otherwise(F.col("left_id")))
    nth = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), "other"))
    return ends.withColumn("nth", nth).where(F.col("nth") <= fanout).select("left_id", "right_id", "score").distinct()


def build_edges(threads: DataFrame, vectors: DataFrame, policy: EdgePolicy) -> DataFrame:
    """All edges of threads that have a vector (repo_id, thread_id, vector), as a table of the shared folder: texts are
    read and pairs compared once, however often the edges are read."""
    with Scratch(threads.sparkSession) as scratch:
        # Bodies end here, so that joins carry none.
        own = scratch.written(facts(threads).join(vectors.select(F.col("thread_id").alias("id")), "id", "left_semi"), "nodes")
        if policy.fanout > 0:
            sides = vectors.select("repo_id", "thread_id", "vector").join(own.select(F.col("id").alias("thread_id"), "kind", "tokens"), "thread_id")
            similar = policy_pairs(scratch.written(sides, "sides"), policy)
        else:
            similar = _allowed_pairs(cosine_pairs(vectors, policy.threshold), own, policy)
        edges = scratch.written(best_edges(merge_edges(similar, _reference_edges(own, policy)), policy.fanout), "edges")
        return scratch.release(edges)
