"""Token counts from distinct pre-tokens.

Texts are taken in blocks of some megabytes. Within a block each distinct pre-token has its pieces counted once; the
counts are joined to the frequencies (row, pre-token) -> n of the block and summed for each row. No list of ids is made,
and no row leaves its task: a table of distinct pre-tokens for all documents would have to be shuffled, together with
every document's frequencies, and is larger than the input where most words are rare.

Null and empty texts count 0 bytes and 0 tokens. Bytes that are no UTF-8 count as they are, and as U+FFFD for tokens. All columns of the input stay; one that has the name of a result is
replaced. Repeated rows are counted each; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, types as T

from skein.llm.blocks import Block, text_blocks
from skein.llm.bpe import WORD_BLOCK_BYTES, BpeModel, Pretokens, load_bpe


def pretoken_pieces(model: BpeModel, tokens: Pretokens) -> np.ndarray:
    """Pieces of each distinct pre-token."""
    counts = np.ones(len(tokens.starts), np.int64)
    plain = np.flatnonzero(tokens.special < 0)
    counts[plain] = model.count_distinct(tokens.data, tokens.starts[plain], tokens.lengths[plain])
    return counts


def block_counts(model: BpeModel, block: Block) -> np.ndarray:
    """Tokens of each row of a block."""
    tokens = Pretokens(block, model.specials)
    pieces, distinct = pretoken_pieces(model, tokens), max(1, len(tokens.starts))
    rows = np.repeat(np.arange(block.rows), np.diff(tokens.first))
    keys, times = np.unique(rows * distinct + tokens.which, return_counts=True)
    return np.bincount(keys // distinct, times * pieces[keys % distinct], block.rows).astype(np.int64)


def _sentencepiece_counts(path: str, texts: list[str]) -> list[int]:
    """A sentencepiece model normalises and splits by itself, so its library counts each whole text."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [len(ids) for ids in model.encode(texts, num_threads=1)]


def count_tokens(df: DataFrame, path: str, limit: int = 512, text: str = "text") -> DataFrame:
    """df with n_bytes, n_tokens and over_limit (n_tokens > limit) of each whole text, by the tokenizer file at path."""
    added = {"n_bytes": T.LongType(), "n_tokens": T.LongType(), "over_limit": T.BooleanType()}
    kept = [f for f in df.schema.fields if f.name not in added]
    schema = T.StructType([*kept, *(T.StructField(n, t) for n, t in added.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch.column(text), WORD_BLOCK_BYTES):
                part = batch.slice(block.first, block.rows)
                if path.endswith(".model"):
                    n = np.array(_sentencepiece_counts(path, [x or "" for x in part.column(text).to_pylist()]), np.int64)
                else:
                    n = block_counts(load_bpe(path), block)
                columns = [*(part.column(f.name) for f in kept), pa.array(np.diff(block.offsets)), pa.array(n), pa.array(n > limit)]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return df.mapInArrow(run, schema)
