"""Benchmark decontamination by winnowing.

Both sides keep, of every run of ``window - gram + 1`` neighbouring k-grams, the
one with the smallest hash, so any shared span of ``window`` words shares a kept
fingerprint. Training fingerprints are looked up in the test fingerprints and
every hit is extended word by word to both sides; a hit counts if it reaches
``window`` words. Items shorter than a window are one window each and are found
by the fingerprint of all their words.

A fingerprint that occurs several times in one item (a repeated word, a table)
would pair every place with every place. Its hits are not extended: the windows
around it are looked up whole, so that a text costs its own length there.

The test side is held in blocks of bounded size: one block is the usual case;
larger test sets pass over the documents block by block, one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmscope.llm import textkernel as tk
from firmscope.llm.shared import need, saved

WINDOW = 10
GRAM = 5
#: Bytes of item texts that one broadcast block may hold.
BLOCK_BYTES = 32 << 20
#: Pairs of a text's and an item's fingerprints that are looked at at once.
PAIRS = 1 << 20
_BITS = 20


def winnow(g: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Positions kept of the gram hashes g; starts: where runs of ``width`` grams
    stay inside one text. Ties keep every smallest gram, so that both sides agree."""
    n = len(g) - width + 1
    if n <= 0 or not len(starts):
        return np.zeros(0, np.int64)
    low = g[:n].copy()
    for j in range(1, width):
        np.minimum(low, g[j : j + n], out=low)
    inside = np.zeros(n, bool)
    inside[starts[starts < n]] = True
    keep = np.zeros(len(g), bool)
    for j in range(width):
        keep[j : j + n] |= inside & (g[j : j + n] == low)
    return np.flatnonzero(keep)


class TestIndex:
    """Fingerprints of a block of test items; equal texts are one item."""

    def __init__(self, texts: pa.Array, window: int, gram: int):
        self.window, self.gram = window, gram
        distinct = pc.fill_null(texts, "").dictionary_encode()
        self.rows = np.argsort(distinct.indices.to_numpy(), kind="stable")
        self.rows_of = np.searchsorted(distinct.indices.to_numpy()[self.rows], np.arange(len(distinct.dictionary) + 1))
        data, offsets = tk.buffers(distinct.dictionary)
        w = tk.words(data, offsets, tk.ALNUM)
        self.h, self.first, n = w.hashes(), w.first, w.n_words
        self.item_of = w.doc()
        g = tk.grams(self.h, gram)
        at = winnow(g, tk.gram_starts(self.first, window), window - gram + 1)
        order = np.lexsort((at, g[at]))
        key, at = g[at][order], at[order]
        again = (key[1:] == key[:-1]) & (self.item_of[at[1:]] == self.item_of[at[:-1]])
        self.repeated = np.unique(key[1:][again])
        many = np.isin(key, self.repeated)
        self.key, self.at = key[~many], at[~many]
        self.whole, self.whole_item = self._windows(at[many])
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for m in range(1, window):
            items = np.flatnonzero(n == m)
            if len(items):
                key = tk.grams(self.h, m)[self.first[items]]
                order = np.argsort(key, kind="stable")
                self.short[m] = (key[order], items[order])
        self.maybe = np.zeros(1 << _BITS, bool)
        for key in (self.key, self.repeated, *(k for k, _ in self.short.values())):
            self.maybe[key >> np.uint64(64 - _BITS)] = True

    def _around(self, at: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where the windows start that hold a gram at one of the places given."""
        reach = self.window - self.gram
        text = np.searchsorted(first, at, "right") - 1
        low, high = np.maximum(at - reach, first[text]), np.minimum(at, first[text + 1] - self.window)
        return np.unique(tk.ranges(low, np.maximum(high - low + 1, 0)))

    def _windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sorted hash, item) of the different windows around these fingerprints."""
        start = self._around(at, self.first) if len(at) else at
        if not len(start):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        key, item = tk.grams(self.h, self.window)[start], self.item_of[start]
        order = np.lexsort((item, key))
        key, item = key[order], item[order]
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (item[1:] != item[:-1])])
        return key[new], item[new]

    def _pairs(self, g: np.ndarray, at: np.ndarray, key: np.ndarray, value: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(text position, value) for each equal pair of g[at] and key, in pieces."""
        low, high = np.searchsorted(key, g[at], "left"), np.searchsorted(key, g[at], "right")
        some = high > low
        at, low, count = at[some], low[some], (high - low)[some]
        total, x = np.concatenate([[0], np.cumsum(count)]), 0
        while x < len(at):
            y = max(int(np.searchsorted(total, total[x] + PAIRS, "right")) - 1, x + 1)
            yield np.repeat(at[x:y], count[x:y]), value[tk.ranges(low[x:y], count[x:y])]
            x = y

    def _extended(self, w: tk.Words, h: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, word after the last, item) of the hits that reach a window."""
        item = self.item_of[q]
        doc = np.searchsorted(w.first, p, "right") - 1
        room_left = np.minimum(p - w.first[doc], q - self.first[item])
        room_right = np.minimum(w.first[doc + 1] - p, self.first[item + 1] - q) - self.gram
        ends = []
        for step, room, base in ((-1, room_left, 0), (1, room_right, self.gram - 1)):
            reach, going = np.zeros(len(p), np.int64), np.ones(len(p), bool)
            for d in range(1, self.window - self.gram + 1):
                going &= room >= d
                i = base + step * d
                going &= h[np.where(going, p + i, 0)] == self.h[np.where(going, q + i, 0)]
                reach += going
            ends.append(reach)
        ok = ends[0] + ends[1] + self.gram >= self.window
        return (p - ends[0])[ok], (p + self.gram + ends[1])[ok], item[ok]

    def hits(self, w: tk.Words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(first word, word after the last, item) of every hit in a chunk, in pieces."""
        h = w.hashes()
        for m, (key, items) in self.short.items():
            if len(h) >= m:
                g = tk.grams(h, m)
                at = tk.gram_starts(w.first, m)
                for p, item in self._pairs(g, at[self._known(g[at])], key, items):
                    yield p, p + m, item
        if len(self.key) + len(self.repeated) and len(h) >= self.window:
            g = tk.grams(h, self.gram)
            at = winnow(g, tk.gram_starts(w.first, self.window), self.window - self.gram + 1)
            at = at[self._known(g[at])]
            for p, q in self._pairs(g, at, self.key, self.at):
                yield self._extended(w, h, p, q)
            at = at[np.isin(g[at], self.repeated)]
            if len(at):
                for p, item in self._pairs(tk.grams(h, self.window), self._around(at, w.first), self.whole, self.whole_item):
                    yield p, p + self.window, item

    def _known(self, g: np.ndarray) -> np.ndarray:
        return self.maybe[g >> np.uint64(64 - _BITS)]


def _blocks(bench: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[tuple[pa.Table, bool]]:
    """(different rows of a block, whether it is the last), one block at a time."""
    rows = need(bench, item_col, text_col).distinct()
    total = rows.agg(F.sum(F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    for k in range(n):
        block = rows if n == 1 else rows.where(F.pmod(F.xxhash64(F.col(f"`{item_col}`"), F.col(f"`{text_col}`")), F.lit(n)) == k)
        yield block.toArrow(), k == n - 1


def decontaminate(
    docs: DataFrame,
    bench: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
    block_bytes: int = BLOCK_BYTES,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row a document: id, n_words, spans, items, and the columns to carry along.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.
    ``spans`` are the disjoint [start, end) word ranges inside any occurrence of
    a window, ``items`` the distinct items that have one. Null or empty texts and
    an empty test table give empty spans; equal items all count; repeated
    documents give a row each.
    """
    item_type = bench.schema[item_col].dataType
    others = [c for c in carry if c not in (id_col, text_col)]
    out = T.StructType(
        [
            T.StructField("id", docs.schema[id_col].dataType),
            T.StructField("text", T.StringType()),
            T.StructField("n_words", T.LongType()),
            T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
            T.StructField("items", T.ArrayType(item_type)),
            *[T.StructField(f"_{k}", docs.schema[c].dataType) for k, c in enumerate(others)],
        ]
    )
    spark = docs.sparkSession
    state = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.lit(0).cast("long").alias("n_words"), F.lit(None).cast(out["spans"].dataType).alias("spans"), F.lit(None).cast(out["items"].dataType).alias("items"), *[F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(others)])
    for block, last in _blocks(bench, item_col, item_text_col, block_bytes):
        sent = spark.sparkContext.broadcast(block)
        del block

        def run(batches: Iterator[pa.RecordBatch], sent=sent, last=last) -> Iterator[pa.RecordBatch]:
            index = ids = None
            for b in batches:
                if index is None:
                    index = TestIndex(sent.value.column(1).combine_chunks(), window, gram)
                    ids = sent.value.column(0).combine_chunks()
                yield _scan(b, index, ids, last and text_col not in carry)

        state = state.mapInArrow(run, out)
        if not last:
            state = saved(state, "decontaminate")
            sent.unpersist()
    carried = [F.col("text").alias(text_col)] * (text_col in carry) + [F.col(f"_{k}").alias(c) for k, c in enumerate(others)]
    return state.select(F.col("id").alias(id_col), *carried, "n_words", F.coalesce("spans", F.array().cast(out["spans"].dataType)).alias("spans"), F.coalesce("items", F.array().cast(out["items"].dataType)).alias("items"))


def _scan(b: pa.RecordBatch, index: TestIndex, ids: pa.Array, drop_text: bool) -> pa.RecordBatch:
    """Add what a block of items hits to a batch (id, text, n_words, spans, items)."""
    spans: list[list[dict] | None] = b.column(3).to_pylist() if b.column(3).null_count < len(b) else [None] * len(b)
    items: list[list | None] = b.column(4).to_pylist() if b.column(4).null_count < len(b) else [None] * len(b)
    n_words = np.zeros(len(b), np.int64)
    for at, to, data, offsets in tk.chunks(b.column(1)):
        w = tk.words(data, offsets, tk.ALNUM)
        n_words[at:to] = w.n_words
        change, met = np.zeros(len(w.starts) + 1, np.int64), np.zeros(0, np.int64)
        for s, e, item in index.hits(w):
            np.add.at(change, s, 1)
            np.add.at(change, e, -1)
            met = np.unique(np.concatenate([met, (np.searchsorted(w.first, s, "right") - 1) * len(index.rows_of) + item]))
        hit = np.cumsum(change[:-1]) > 0
        doc, item = met // len(index.rows_of), met % len(index.rows_of)
        for d in np.unique(doc).tolist():
            mask = hit[w.first[d] : w.first[d + 1]]
            for x in spans[at + d] or ():
                mask[x["start"] : x["end"]] = True
            edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
            spans[at + d] = [{"start": int(x), "end": int(y)} for x, y in edge.reshape(-1, 2)]
            mine = item[np.searchsorted(doc, d) : np.searchsorted(doc, d, "right")]
            rows = index.rows[tk.ranges(index.rows_of[mine], index.rows_of[mine + 1] - index.rows_of[mine])]
            items[at + d] = list(dict.fromkeys((items[at + d] or []) + ids.take(pa.array(rows)).to_pylist()))
    text = pa.nulls(len(b), b.schema.field(1).type) if drop_text else b.column(1)
    return pa.RecordBatch.from_arrays(
        [b.column(0), text, pa.array(n_words), pa.array(spans, b.schema.field(3).type), pa.array(items, b.schema.field(4).type), *b.columns[5:]], b.schema.names
    )
