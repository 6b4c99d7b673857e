"""Byte-pair encoding and decoding by a contiguous rank array.

A short word is a row of part ids with, beside it, the rank of each pair of neighbours. The smallest rank is looked
for by a scan, its boundary is deleted (what follows moves down by one) and the ranks of the two new neighbours are
refreshed, until no pair has a rank. All distinct words of one length go through these steps together, as the rows of a
matrix; a word of over ``SHORT`` bytes is merged with a heap over a linked list, in n log n steps.

Words are split off as the byte-level pattern of ``public_tokenizers.PATTERN`` splits them, by character classes over
whole blocks of texts. Special tokens whose strings occur in a text are single ids, as is the library's default.

Both operators keep every column of their input and add theirs under a name that the caller gives (an existing column
of that name is replaced). Bytes of a text that are no UTF-8 are read as U+FFFD. Null texts and empty texts have no ids; null and empty id lists decode to the empty text. Rows that repeat,
texts of any length and empty tables need no special case.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, types as T

from skein.llm.blocks import Block, SpanHasher, ragged, text_blocks

SHORT = 48
#: Each distinct word of so much text is merged once.
WORD_BLOCK_BYTES = 1 << 20
_NONE = np.int32(2**31 - 1)

#: Character classes.
OTHER, LETTER, NUMBER, SPACE, SPECIAL = range(5)

#: The endings that the byte-level pattern splits off after an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(1)
def char_classes() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    plain = np.concatenate([np.arange(0xD800, dtype=np.uint32), np.arange(0xE000, 0x110000, dtype=np.uint32)])
    everything = plain.tobytes().decode("utf-32-le")
    for code, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        for m in regex.finditer(f"{pattern}+", everything):
            out[plain[m.start() : m.end()]] = code
    for c in range(0x1C, 0x20):  # separators that are no white space in Unicode
        out[c] = OTHER
    return out


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class BpeModel:
    """The merges of a byte-level tokenizer file, as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        self.specials = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.pieces: dict[int, bytes] = {i: bytes(alphabet[c] for c in s) for s, i in vocab.items() if s.encode() not in self.specials}
        self.pieces |= {i: s for s, i in self.specials.items()}
        self.byte_ids = np.zeros(256, np.int64)
        for c, b in alphabet.items():
            self.byte_ids[b] = vocab[c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self._keys, self._ranks = np.append(keys[order], 2**62), np.append(order.astype(np.int32), _NONE)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self._rank_of = {int(k): r for r, k in enumerate(keys)}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.searchsorted(self._keys, keys)
        return np.where(self._keys[at] == keys, self._ranks[at], _NONE)

    def merge_rows(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """ids: a row of bytes' ids for each word, all of one length. Yields (row numbers, their ids when done)."""
        rows = np.arange(len(ids))
        ranks = self.ranks(ids[:, :-1], ids[:, 1:]) if ids.shape[1] > 1 else np.empty((len(ids), 0), np.int32)
        while len(rows):
            if ids.shape[1] == 1:
                yield rows, ids
                return
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(rows)), at]
            over = best == _NONE
            if over.any():
                yield rows[over], ids[over]
                rows, ids, ranks, at, best = (x[~over] for x in (rows, ids, ranks, at, best))
                if not len(rows):
                    return
            line, width = np.arange(len(rows)), ids.shape[1]
            ids[line, at] = self.merged[best]
            columns = np.arange(width - 1)
            ids = np.take_along_axis(ids, columns + (columns > at[:, None]), axis=1)
            columns = columns[:-1]
            ranks = np.take_along_axis(ranks, columns + (columns >= at[:, None]), axis=1)
            has = np.flatnonzero(at > 0)
            ranks[has, at[has] - 1] = self.ranks(ids[has, at[has] - 1], ids[has, at[has]])
            has = np.flatnonzero(at < width - 2)
            ranks[has, at[has]] = self.ranks(ids[has, at[has]], ids[has, at[has] + 1])

    def merge_long(self, word: bytes) -> list[int]:
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        heap = [(r, k) for k in range(len(ids) - 1) if (r := self._rank_of.get(ids[k] << 32 | ids[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k = heapq.heappop(heap)
            n = after[k] if ids[k] >= 0 else -1
            if n < 0 or self._rank_of.get(ids[k] << 32 | ids[n]) != rank:
                continue
            ids[k], ids[n], after[k] = int(self.merged[rank]), -1, after[n]
            if after[k] >= 0:
                before[after[k]] = k
            for left, right in ((before[k], k), (k, after[k])):
                if left >= 0 and right >= 0 and (r := self._rank_of.get(ids[left] << 32 | ids[right])) is not None:
                    heapq.heappush(heap, (r, left))
        return [i for i in ids if i >= 0]

    def count_distinct(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """How many ids each word has, without the ids."""
        counts = np.zeros(len(starts), np.int64)
        for own, parts in self._merged(data, starts, lengths):
            counts[own] = parts.shape[1]
        return counts

    def encode_distinct(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words given as spans of data, end to end, and how many each word has."""
        done = list(self._merged(data, starts, lengths))
        counts = np.zeros(len(starts), np.int64)
        for own, parts in done:
            counts[own] = parts.shape[1]
        flat, offsets = np.empty(int(counts.sum()), np.int32), np.cumsum(counts) - counts
        for own, parts in done:
            flat[offsets[own][:, None] + np.arange(parts.shape[1])] = parts
        return flat, counts

    def _merged(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of words of one length, and as many rows of ids."""
        if not len(starts):
            return
        order = np.argsort(lengths, kind="stable")
        sizes, begins = np.unique(lengths[order], return_index=True)
        for size, begin, end in zip(sizes.tolist(), begins.tolist(), [*begins.tolist()[1:], len(order)], strict=True):
            if size > SHORT:
                for k in order[begin:end].tolist():
                    yield np.array([k]), np.array([self.merge_long(data[starts[k] : starts[k] + size].tobytes())], np.int64)
                continue
            step = max(1, (1 << 18) // size)
            for k in range(begin, end, step):
                own = order[k : min(end, k + step)]
                for rows, ids in self.merge_rows(self.byte_ids[data[starts[own][:, None] + np.arange(size)]]):
                    yield own[rows], ids


@lru_cache(4)
def load_bpe(path: str) -> BpeModel:
    return BpeModel(path)


def distinct_spans(hasher: SpanHasher, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An occurrence of each distinct span, and for each span the number of its distinct one. Spans of equal hashes are
    compared byte by byte; should any differ, all are told apart by their bytes instead."""
    lengths = ends - starts
    _, at, which = np.unique(hasher(starts, ends), return_index=True, return_inverse=True)
    if (lengths == lengths[at][which]).all() and hasher.same(starts, starts[at][which], lengths).all():
        return at, which
    numbers: dict[bytes, int] = {}
    which = np.array([numbers.setdefault(raw[a:b], len(numbers)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
    return np.unique(which, return_index=True)[1], which


def valid(block: Block) -> Block:
    """The block, or one of its texts with U+FFFD in place of what is no UTF-8."""
    raw = block.data.tobytes()
    try:
        raw.decode("utf-8")
        return block
    except UnicodeDecodeError:
        texts = [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(block.offsets, block.offsets[1:], strict=False)]
        return Block(block.first, np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))


class Pretokens:
    """The pre-tokens of a block: for each occurrence the number of its distinct pre-token, and for each row the number
    of its first occurrence. Distinct pre-tokens are spans of the block; special holds the id of those that are special
    tokens, else -1."""

    def __init__(self, block: Block, specials: dict[bytes, int]):
        block = valid(block)
        self.data, raw = block.data, block.data.tobytes()
        found = self._specials(raw, block.offsets, specials)
        cuts = np.unique(np.concatenate([block.offsets[:-1], *([s, e] for s, e, _ in found)])) if found else np.unique(block.offsets[:-1])
        cuts = cuts[cuts < len(raw)]
        starts, ends = self._split(raw, cuts, found)
        self.first = np.searchsorted(starts, block.offsets)
        at, self.which = distinct_spans(SpanHasher(block.data), raw, starts, ends)
        self.starts, self.lengths = starts[at], (ends - starts)[at]
        self.special = np.full(len(at), -1, np.int64)
        if found:  # a special token's string never occurs but as that token
            by_start = {s: i for s, _, i in found}
            for k in np.flatnonzero(np.isin(self.starts, np.array(list(by_start)))).tolist():
                self.special[k] = by_start[int(self.starts[k])]

    @staticmethod
    def _specials(raw: bytes, offsets: np.ndarray, specials: dict[bytes, int]) -> list[tuple[int, int, int]]:
        out = []
        if any(s in raw for s in specials):
            pattern = regex.compile(b"|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True)))
            for k in range(len(offsets) - 1):
                for m in pattern.finditer(raw, int(offsets[k]), int(offsets[k + 1])):
                    out.append((m.start(), m.end(), specials[m[0]]))
        return out

    @staticmethod
    def _split(raw: bytes, cuts: np.ndarray, found: list) -> tuple[np.ndarray, np.ndarray]:
        """Spans in bytes; cuts: where texts (or what lies between special tokens) begin."""
        chars = np.frombuffer(raw.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(chars)
        if not n:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        places = None  # the byte at which each character begins, if not every character is a byte
        if n != len(raw):
            wide = np.uint8(1) + (chars > 0x7F).astype(np.uint8) + (chars > 0x7FF) + (chars > 0xFFFF)
            places = np.zeros(n + 1, np.int64)
            np.cumsum(wide, dtype=np.int64, out=places[1:])
        to_char = (lambda x: np.searchsorted(places, x)) if places is not None else (lambda x: x)
        kind = char_classes()[chars]
        for s, e, _ in found:
            kind[to_char(np.array(s)) : to_char(np.array(e))] = SPECIAL
        hard = np.zeros(n + 1, bool)
        hard[to_char(cuts)] = hard[n] = True
        start = np.empty(n + 1, bool)
        start[0] = start[n] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:n])
        start |= hard
        # The last white space before something else goes with it if it is a space, else it stands alone.
        follows = np.flatnonzero(start[1:n] & ~hard[1:n] & (kind[:-1] == SPACE)) + 1
        start[follows - 1] = True
        start[follows[chars[follows - 1] == 0x20]] = False
        # Contractions at an apostrophe that begins a pre-token.
        quotes = np.flatnonzero((chars == 0x27) & start[:n])
        for k in quotes[quotes + 1 < n].tolist():
            if start[k] and start[k + 1] and not hard[k + 1] and kind[k + 1] == LETTER:
                for ending in CONTRACTIONS:
                    e = k + 1 + len(ending)
                    if e <= n and all(chars[k + 1 + j] == ord(c) for j, c in enumerate(ending)) and not hard[k + 2 : e].any():
                        start[k + 1], start[e] = False, True
                        break
        at = np.flatnonzero(start)
        if places is not None:
            at = places[at]
        return at[:-1], at[1:]


def encode_block(model: BpeModel, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a block, end to end, and for each row (and the end) where its ids begin."""
    tokens = Pretokens(block, model.specials)
    flat, counts = encode_pretokens(model, tokens)
    begins = np.cumsum(counts) - counts
    lengths = counts[tokens.which]
    ids = flat[ragged(begins[tokens.which], lengths)]
    return ids, np.concatenate([[0], np.cumsum(lengths)])[tokens.first]


def encode_pretokens(model: BpeModel, tokens: Pretokens) -> tuple[np.ndarray, np.ndarray]:
    special = tokens.special >= 0
    if not special.any():
        return model.encode_distinct(tokens.data, tokens.starts, tokens.lengths)
    plain = np.flatnonzero(~special)
    own, some = model.encode_distinct(tokens.data, tokens.starts[plain], tokens.lengths[plain])
    counts = np.ones(len(special), np.int64)
    counts[plain] = some
    flat, begins = np.empty(int(counts.sum()), np.int32), np.cumsum(counts) - counts
    flat[ragged(begins[plain], some)] = own
    flat[begins[special]] = tokens.special[special]
    return flat, counts


Batches = Iterator[pa.RecordBatch]


def _encoder(path: str, text: str, ids: str) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        model = load_bpe(path)
        for batch in batches:
            others = [n for n in batch.schema.names if n != ids]
            for block in text_blocks(batch.column(text), WORD_BLOCK_BYTES):
                found, begins = encode_block(model, block)
                lists = pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(found))
                part = batch.slice(block.first, block.rows)
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in others), lists], [*others, ids])

    return run


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the ids of each whole text as array<int>; no token is added before or after."""
    schema = T.StructType([*(f for f in df.schema.fields if f.name != ids), T.StructField(ids, T.ArrayType(T.IntegerType(), False))])
    return df.mapInArrow(_encoder(path, text, ids), schema)


def encode_and_decode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """decode(encode(df)) without the column text, in one pass and one Python worker a task."""
    kept = [f for f in df.schema.fields if f.name not in (text, ids, decoded)]
    schema = T.StructType([*kept, T.StructField(ids, T.ArrayType(T.IntegerType(), False)), T.StructField(decoded, T.StringType())])
    encoder, decoder = _encoder(path, text, ids), _decoder(path, ids, decoded)

    def run(batches: Batches) -> Batches:
        return decoder(batch.select([*(f.name for f in kept), ids]) for batch in encoder(batches))

    return df.mapInArrow(run, schema)


def _decoder(path: str, ids: str, text: str) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        pieces = load_bpe(path).pieces
        table = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
        places = np.zeros(len(table) + 1, np.int64)
        np.cumsum([len(p) for p in table], out=places[1:])
        store = np.frombuffer(b"".join(table), np.uint8)
        sizes = np.diff(places)
        for batch in batches:
            column = batch.column(ids)
            others = [n for n in batch.schema.names if n != text]
            begins = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(column).fill_null(0)))]).astype(np.int64)
            found = np.asarray(column.flatten().cast(pa.int64()).fill_null(-1))
            row = 0
            while row < len(column):  # some rows at a time, to bound what a batch of long lists needs
                last = max(row + 1, int(np.searchsorted(begins, begins[row] + (1 << 18), "right")) - 1)
                own = found[begins[row] : begins[last]]
                known = (own >= 0) & (own < len(table))
                own = np.where(known, own, 0)
                lengths = np.where(known, sizes[own], 0)
                data = store[ragged(places[own], lengths)].tobytes()
                ends = np.concatenate([[0], np.cumsum(lengths)])[begins[row : last + 1] - begins[row]].tolist()
                texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(ends, ends[1:], strict=False)]
                part = batch.slice(row, last - row)
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in others), pa.array(texts, pa.string())], [*others, text])
                row = last

    return run


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text of each list of ids; special tokens are kept, and bytes that are no UTF-8 become U+FFFD.
    Nulls among the ids and ids outside of the vocabulary have no text."""
    schema = T.StructType([*(f for f in df.schema.fields if f.name != text), T.StructField(text, T.StringType())])

    return df.mapInArrow(_decoder(path, ids, text), schema)
