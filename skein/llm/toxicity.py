"""Toxicity by cumulative-link ordinal regression on sparse text features.

Severity grades are 0, 1, 2. P(grade <= k) = logistic(threshold_k - w . x): one weight a feature for all grades,
and ascending thresholds. x holds which features a text has: its words and their first four and five bytes (runs of
letters, A-Z as a-z): all whose share among toxic texts is at least ``LEAST_ERRORS`` standard errors from that among
others, which takes ``LEAST_TEXTS`` texts that have them. The result is the expected severity.

Labels say toxic or not, so grades above 1 are made by a rule: the labelled texts are dealt into two halves by a hash of
the id, and a toxic text has grade 2 if it has at least as many features that in the *other* half several toxic texts and
no others have as the median toxic text of its half, else grade 1. No text's own label or words take part in its grade.
Where all toxic texts would have one grade, there is no grade 2. The model is fitted on a bounded sample: ``MOST_LABELLED`` labelled
documents (about), chosen by a hash of the id. All documents are scored, whole.

Null texts and texts without letters have no features. Without labels of both kinds, or where no feature tells them
apart (as where none is in ``LEAST_TEXTS`` labelled texts), the model has no feature and all severities are 0. Labels that are null, or of documents that aren't there, are not used; of repeated labels the most toxic counts. Input columns
stay; one that has the name of a result is replaced. Repeated rows are scored each; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from skein.llm.blocks import U64, Block, SpanHasher, mix, spans, text_blocks
from skein.llm.shared import written

MOST_LABELLED, LEAST_TEXTS, GRADES = 20_000, 5, 3
PREFIXES = (4, 5)
#: Labelled texts that have a feature, by kind and half.
COUNTS = ("good0", "good1", "bad0", "bad1")
LEAST_ERRORS = 5.0
ROUNDS, RATE, PENALTY = 1000, 0.1, 1e-6

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True


def word_features(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes of each word (a row a word: the word and its prefixes), and each row's first word."""
    starts, ends, first = spans(block, _LETTERS)
    hashes = SpanHasher(block.data, fold=True)
    columns = [hashes(starts, ends)]
    for n, length in enumerate(PREFIXES):
        columns.append(mix(hashes(starts, np.minimum(starts + length, ends)) ^ U64(n + 1)))
    return np.stack(columns, axis=1).view(np.int64), first


@dataclass(frozen=True)
class OrdinalModel:
    features: np.ndarray  # ascending
    weights: np.ndarray
    thresholds: np.ndarray

    def severity(self, score: np.ndarray) -> np.ndarray:
        """Expected grade: the sum over thresholds of P(grade > k)."""
        return (1 / (1 + np.exp(np.clip(self.thresholds[None] - score[:, None], -50, 50)))).sum(axis=1)


def present(features: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(row, number of the feature) of each feature that a row of the block has, once, in order."""
    found, first = word_features(block)
    if not len(features):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(features, found), len(features) - 1)
    hit = features[at] == found
    rows = np.repeat(np.arange(block.rows), np.diff(first))
    keys = np.unique(np.broadcast_to(rows[:, None], hit.shape)[hit] * len(features) + at[hit])
    return keys // len(features), keys % len(features)


def likelihood(value: np.ndarray, rows: np.ndarray, columns: np.ndarray, grades: np.ndarray, n_features: int) -> tuple[float, np.ndarray]:
    """The mean negative log-likelihood of grades with a ridge on the weights, and its gradient. value: weights, the first
    threshold, and logarithms of the gaps between thresholds; (rows, columns) are the ones of the design matrix."""
    n, line = len(grades), np.arange(len(grades))
    weights, raw = value[:n_features], value[n_features:]
    cuts = np.cumsum([raw[0], *np.exp(raw[1:])])
    score = np.bincount(rows, weights[columns], n)
    below = 1 / (1 + np.exp(-np.clip(cuts[None] - score[:, None], -30, 30)))  # P(grade <= k)
    padded = np.column_stack([np.zeros(n), below, np.ones(n)])
    chance = np.maximum(padded[line, grades + 1] - padded[line, grades], 1e-9)
    slope = padded * (1 - padded)
    upper, lower = slope[line, grades + 1] / chance, slope[line, grades] / chance
    by_score = (upper - lower) / n
    by_cut = np.array([lower[grades == k + 1].sum() - upper[grades == k].sum() for k in range(len(raw))]) / n
    by_raw = np.array([by_cut.sum(), *(np.exp(raw[k]) * by_cut[k:].sum() for k in range(1, len(raw)))])
    loss = -np.log(chance).mean() + PENALTY / 2 * np.square(weights).sum()
    return loss, np.concatenate([np.bincount(columns, by_score[rows], n_features) + PENALTY * weights, by_raw])


def fit_cumulative(rows: np.ndarray, columns: np.ndarray, grades: np.ndarray, n_features: int, n_grades: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the least likelihood(), by Adam."""
    first = np.log((grades == 0).mean() / max(1e-9, 1 - (grades == 0).mean()))
    value = np.concatenate([np.zeros(n_features), [first], np.zeros(n_grades - 2)])
    m, v = np.zeros_like(value), np.zeros_like(value)
    for step in range(1, ROUNDS + 1):
        _, gradient = likelihood(value, rows, columns, grades, n_features)
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        value = value - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return value[:n_features], np.cumsum([value[n_features], *np.exp(value[n_features + 1 :])])


def graded(toxic: np.ndarray, half: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Grades of texts: marks[h] says how many features a text has that only toxic texts of the half besides h have."""
    own, grades = marks[half, np.arange(len(half))], (toxic > 0).astype(np.int64)
    for h in (0, 1):
        mine = (toxic > 0) & (half == h)
        if mine.any():
            grades[mine] += own[mine] >= np.median(own[mine])
    return np.minimum(grades, 1) if (grades[toxic > 0] == 2).all() else grades


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, doc_id: str = "doc_id", text: str = "text") -> OrdinalModel:
    """A model from the documents that labels (doc_id, toxic) tell about, most of them at most (about)."""
    told = labels.select(F.col("doc_id").cast("long").alias("own"), F.col("toxic").cast("int").alias("toxic")).where("own is not null and toxic is not null").groupBy("own").agg(F.max("toxic").alias("toxic"))
    told = told.withColumn("half", F.pmod(F.xxhash64("own", F.lit("half")), F.lit(2)).cast("int"))
    share = min(1.0, most / max(1, told.count()))
    chosen = told.where(F.pmod(F.xxhash64("own"), F.lit(1_000_000)) < int(share * 1_000_000))
    # Bounded by most, so it may be broadcast.
    sample = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("own")).select("text", "toxic", "half")
    sample = written(sample, "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = (np.asarray(batch.column("toxic")) > 0) * 2 + np.asarray(batch.column("half"))
            for block in text_blocks(batch.column("text"), 1 << 20):
                found, first = word_features(block)
                own = [(np.unique(found[a:b]), kind[block.first + r]) for r, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True))]
                features, which = np.unique(np.concatenate([f for f, _ in own]), return_inverse=True)
                kinds = np.repeat([t for _, t in own], [len(f) for f, _ in own])
                sums = [np.bincount(which[kinds == t], minlength=len(features)).astype(np.int64) for t in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array(features), *map(pa.array, sums)], ["feature", *COUNTS])

    kinds = {bool(r["toxic"]): r["n"] for r in sample.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    none = OrdinalModel(np.empty(0, np.int64), np.empty(0), np.full(GRADES - 1, 50.0))
    if len(kinds) < 2:
        return none
    # How far the share of toxic texts that have the feature is from that of the others, in standard errors.
    share_of = lambda c, n: F.col(c) / F.lit(float(n))
    mean = (F.col("bad") + F.col("good")) / F.lit(float(sum(kinds.values())))
    spread = F.sqrt((mean * (F.lit(1.0) - mean) + F.lit(1e-9)) * F.lit(1 / kinds[True] + 1 / kinds[False]))
    apart = F.abs(share_of("bad", kinds[True]) - share_of("good", kinds[False])) / spread
    best = sample.mapInArrow(count, f"feature long, {', '.join(f'{c} long' for c in COUNTS)}").groupBy("feature").agg(*(F.sum(c).alias(c) for c in COUNTS))
    best = best.withColumns({"good": F.col("good0") + F.col("good1"), "bad": F.col("bad0") + F.col("bad1")})
    rows = best.where((F.col("bad") + F.col("good") >= LEAST_TEXTS) & (apart >= LEAST_ERRORS)).toPandas().sort_values("feature")
    # Features of a bounded sample's texts, so bounded as well.
    features = rows["feature"].to_numpy(np.int64)
    if not len(features):
        return none

    def design(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = (np.asarray(batch.column("toxic")) > 0) * 2 + np.asarray(batch.column("half"))
            for block in text_blocks(batch.column("text")):
                own, columns = present(features, block)
                cuts = np.searchsorted(own, np.arange(block.rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(columns.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(kind[block.first : block.first + block.rows].astype(np.int32)), lists], ["kind", "columns"])

    # At most `most` rows (about) of numbers of features.
    table = sample.mapInArrow(design, "kind int, columns array<int>").toPandas()
    kind, lengths = table["kind"].to_numpy(), table["columns"].map(len).to_numpy()
    columns = np.concatenate([np.asarray(c, np.int64) for c in table["columns"]])
    texts = np.repeat(np.arange(len(table)), lengths)
    told_of = {h: ((rows[f"good{1 - h}"] == 0) & (rows[f"bad{1 - h}"] >= 2)).to_numpy() for h in (0, 1)}
    grades = graded(kind // 2, kind % 2, np.stack([np.bincount(texts, told_of[h][columns], len(table)) for h in (0, 1)]))
    weights, thresholds = fit_cumulative(texts, columns, grades, len(features), int(grades.max()) + 1)
    return OrdinalModel(features, weights, thresholds)


def score(docs: DataFrame, model: OrdinalModel, text: str = "text") -> DataFrame:
    """docs with severity, the expected grade of each whole text."""
    kept = [f for f in docs.schema.fields if f.name != "severity"]
    schema = T.StructType([*kept, T.StructField("severity", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch.column(text)):
                rows, columns = present(model.features, block)
                severity = model.severity(np.bincount(rows, model.weights[columns], block.rows) if len(rows) else np.zeros(block.rows))
                part = batch.slice(block.first, block.rows)
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(severity)], schema.names)

    return docs.mapInArrow(run, schema)


#: A document is rejected from this expected severity on: it is more likely toxic than not.
REJECT = 0.5
