"""Quality rules: gradient-boosted trees over document statistics.

Statistics are array passes over the text bytes. The trees are fitted on a
bounded sample of labelled documents, with monotonic constraints on chosen
statistics, and flattened into node arrays, so that scoring a batch is a fixed
number of gathers per tree level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmscope.llm import textkernel as tk
from firmscope.llm.shared import need, saved

#: Labelled documents that the trees are fitted on at most (about so many are
#: drawn by a hash of their id where there are more).
MAX_TRAIN = 20_000
#: Documents with a lower probability of good quality are rejected.
THRESHOLD = 0.5
REPEAT_WINDOW = 8

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics the trees see, with the direction in which they may move the verdict.
FEATURES: dict[str, int] = {
    "log_words": 0,
    "word_length": 0,
    "symbol_share": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "upper_share": -1,
    "digit_share": 0,
    "punctuation_share": 0,
    "bang_share": -1,
    "pipe_share": -1,
    "wide_share": 0,
    "distinct_share": 0,
    "line_words": 0,
    "capital_share": 0,
    "stop_share": 0,
    "long_share": 0,
    "repeat_next_share": -1,
    "top_share": 0,
}

_CLASS = np.zeros(256, np.uint8)  # 0: other
for _k, _bytes in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?'\"()-", b"!", b"|", b"#*$%&<>", bytes(range(0xC0, 0x100)), bytes(range(0x80, 0xC0)), bytes([0x20, *range(0x09, 0x0E)])), 1):
    _CLASS[list(_bytes)] = _k
_LINES = np.arange(256, dtype=np.uint8)
_LINES[0], _LINES[0x0A] = 0xFF, 0


def _by_doc(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return tk.mix(key + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _later_equal(key: np.ndarray) -> np.ndarray:
    """True where an equal key stands before."""
    order = np.argsort(key, kind="stable")
    out = np.zeros(len(key), bool)
    out[order[1:]] = key[order[1:]] == key[order[:-1]]
    return out


def statistics(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts [docs x COUNTS] int64, features [docs x FEATURES] float32) of a chunk."""
    n = len(offsets) - 1
    w = tk.words(data, offsets)
    words, doc = w.n_words, w.doc()
    h = w.hashes()
    length = np.diff(offsets)
    byte_doc = np.repeat(np.arange(n), length)
    classes = np.bincount(byte_doc * 10 + _CLASS[data], minlength=10 * n).reshape(n, 10)
    upper, digit, punct, bang, pipe, symbol, lead, follow, space = (classes[:, k] for k in range(1, 10))
    chars = length - follow - space

    lines = tk.words(data, offsets, _LINES)
    ink = np.concatenate([[0], np.cumsum(w.mapped != 0)])
    lined = ink[lines.ends] > ink[lines.starts]
    line_doc = lines.doc()[lined]
    again = _later_equal(_by_doc(lines.hashes()[lined], line_doc))
    n_lines, dup_lines = np.bincount(line_doc, minlength=n), np.bincount(line_doc[again], minlength=n)

    repeat = np.zeros(n, np.int64)
    at = tk.gram_starts(w.first, REPEAT_WINDOW)
    if len(at):
        key = _by_doc(tk.grams(h, REPEAT_WINDOW)[at], doc[at])
        ordered = np.sort(key)
        twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        if len(twice):
            found = at[twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key]
            covered = tk.spans_to_mask(len(h), found, found + REPEAT_WINDOW)
            repeat = np.bincount(doc[covered], minlength=n)
    counts = np.stack([words, chars, symbol + pipe, dup_lines, repeat], 1).astype(np.int64)

    wlen = w.ends - w.starts
    capital = (data[w.starts] >= 0x41) & (data[w.starts] <= 0x5A)
    key = np.sort(_by_doc(h, doc))
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    # Equal keys stand together, but documents don't: count per document by any member.
    order = np.argsort(_by_doc(h, doc), kind="stable")
    runs = np.diff(np.concatenate([edge, [len(key)]]))
    run_doc = doc[order[edge]] if len(edge) else np.zeros(0, np.int64)
    distinct = np.bincount(run_doc, minlength=n)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, run_doc, runs)
    next_equal = np.zeros(len(h), bool)
    if len(h):
        next_equal[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    per_word = lambda flag: np.bincount(doc[flag], minlength=n) / np.maximum(words, 1)
    c = np.maximum(chars, 1)
    f = np.stack(
        [
            np.log1p(words),
            chars / np.maximum(words, 1),
            symbol / c,
            dup_lines / np.maximum(n_lines, 1),
            repeat / np.maximum(words, 1),
            upper / c,
            digit / c,
            punct / c,
            bang / c,
            pipe / c,
            lead / c,
            distinct / np.maximum(words, 1),
            words / np.maximum(n_lines, 1),
            per_word(capital),
            per_word(wlen <= 3),
            per_word(wlen >= 20),
            per_word(next_equal),
            top / np.maximum(words, 1),
        ],
        1,
    )
    return counts, f.astype(np.float32)


@dataclass
class Trees:
    """Complete binary trees as arrays [tree, node]; leaves stand behind the inner nodes."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), self.feature.shape[1]
        depth = (inner + 1).bit_length() - 1
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += leaf[node - inner]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit_trees(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, n_trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 48, min_child: float = 4.0, l2: float = 1.0) -> Trees:
    """Boost trees on the logistic loss; monotone: -1, 0 or 1 for each feature.

    A split on a constrained feature must order its children's values, and both
    sides' later leaves are bounded by the middle of the two, so that the whole
    ensemble is monotone.
    """
    n, k = x.shape
    inner = (1 << depth) - 1
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(k)]
    code = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1) if n else np.zeros((0, k), np.int64)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3) if n else 0.5
    base = float(np.log(share / (1 - share)))
    margin = np.full(n, base)
    feature, threshold, leaf = np.zeros((n_trees, inner), np.int64), np.full((n_trees, inner), np.inf, np.float64), np.zeros((n_trees, inner + 1))
    flat = code + np.arange(k) * bins
    for t in range(n_trees if n else 0):
        p = 1 / (1 + np.exp(-margin))
        g, hess = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        low, high = np.full(2 * inner + 1, -np.inf), np.full(2 * inner + 1, np.inf)
        for i in range(inner):
            mine = np.flatnonzero(node == i)
            left_child, right_child = 2 * i + 1, 2 * i + 2
            low[[left_child, right_child]], high[[left_child, right_child]] = low[i], high[i]
            if len(mine):
                split = _best_split(flat[mine], g[mine], hess[mine], k, bins, cuts, monotone, low[i], high[i], min_child, l2)
                if split is not None:
                    j, b, a, c = split
                    feature[t, i], threshold[t, i] = j, cuts[j][b]
                    if monotone[j]:
                        middle = (a + c) / 2
                        bound = (high, low) if monotone[j] > 0 else (low, high)
                        bound[0][left_child] = middle
                        bound[1][right_child] = middle
                    node[mine] = np.where(code[mine, j] > b, right_child, left_child)
                else:
                    node[mine] = left_child
        for i in range(inner, 2 * inner + 1):
            mine = node == i
            value = -g[mine].sum() / (hess[mine].sum() + l2)
            leaf[t, i - inner] = rate * np.clip(value, low[i], high[i])
        margin += leaf[t][node - inner]
    return Trees(feature, threshold, leaf, base)


def _best_split(flat, g, hess, k, bins, cuts, monotone, low, high, min_child, l2):
    where = flat.ravel()
    gs = np.bincount(where, np.repeat(g, k), k * bins).reshape(k, bins).cumsum(1)
    hs = np.bincount(where, np.repeat(hess, k), k * bins).reshape(k, bins).cumsum(1)
    ns = np.bincount(where, minlength=k * bins).reshape(k, bins).cumsum(1)
    total_g, total_h, total_n = gs[:, -1:], hs[:, -1:], ns[:, -1:]
    a, c = np.clip(-gs / (hs + l2), low, high), np.clip(-(total_g - gs) / (total_h - hs + l2), low, high)

    def gain(value, gg, hh):
        return -(2 * gg * value + (hh + l2) * value * value)

    whole = np.clip(-total_g / (total_h + l2), low, high)
    better = gain(a, gs, hs) + gain(c, total_g - gs, total_h - hs) - gain(whole, total_g, total_h)
    allowed = (ns >= min_child) & (total_n - ns >= min_child) & ~((monotone[:, None] > 0) & (a > c)) & ~((monotone[:, None] < 0) & (a < c))
    allowed &= np.arange(bins)[None, :] < np.array([len(x) for x in cuts])[:, None]
    better = np.where(allowed, better, -np.inf)
    j, b = np.unravel_index(np.argmax(better), better.shape)
    return (int(j), int(b), float(a[j, b]), float(c[j, b])) if better[j, b] > 1e-6 else None


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, COUNTS as long, ``features`` (array of float)."""
    out = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("features", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [statistics(data, offsets) for _, _, data, offsets in tk.chunks(b.column(1))]
            counts = np.concatenate([np.zeros((0, len(COUNTS)), np.int64), *[p[0] for p in parts]])
            f = np.concatenate([np.zeros((0, len(FEATURES)), np.float32), *[p[1] for p in parts]])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1, dtype=np.int32) * len(FEATURES)), pa.array(f.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(counts[:, k]) for k in range(len(COUNTS))], lists], ["id", *COUNTS, "features"])

    return need(docs, id_col, text_col).mapInArrow(run, out)


def training_sample(features: DataFrame, labels: DataFrame, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Labelled feature rows for the driver, about ``bound`` at most, drawn by a hash
    of the id, one an id (the smallest). features: (id, features); labels: (id, y)."""
    known = labels.where(F.col("y").isNotNull() & F.col("id").isNotNull()).groupBy("id").agg(F.max("y").alias("y"))
    n = known.count()
    if n > bound:
        known = known.where(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 20)) < int((1 << 20) * bound / n))
    # One text an id, so that the bound on labels holds for rows.
    drawn = features.where(F.col("id").isNotNull()).join(known, "id").groupBy("id").agg(F.min(F.struct("features", "y")).alias("r"))
    t = drawn.select("id", "r.features", "r.y").toArrow().sort_by("id")
    if not t.num_rows:
        return np.zeros((0, len(FEATURES))), np.zeros(0)
    x = np.array(t["features"].combine_chunks().flatten()).reshape(t.num_rows, -1)
    return x.astype(np.float64), t["y"].to_numpy().astype(np.float64)


def apply_rules(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = THRESHOLD,
    max_train: int = MAX_TRAIN,
) -> DataFrame:
    """One row a document: id, COUNTS, base_failed, kept, good (probability).

    base_failed: fewer than 20 words, or more than 30 % of the words inside
    8-word windows that occur twice in the text. kept: not base_failed, and the
    trees give at least ``threshold``. Null texts count as empty (base_failed);
    without usable labels the trees give 0.5 and keep everything. Repeated rows
    get a row each; labels that contradict each other count as the higher one.
    """
    stats = saved(document_statistics(docs, id_col, text_col), "quality-stats")
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y"))
    x, y = training_sample(stats.select("id", "features"), marks, max_train)
    trees = fit_trees(x, y, np.array(list(FEATURES.values())))
    sent = docs.sparkSession.sparkContext.broadcast(trees)
    out = T.StructType([*[f for f in stats.schema if f.name != "features"], T.StructField("good", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.array(b.column(b.num_columns - 1).flatten()).reshape(len(b), -1).astype(np.float64)
            good = sent.value.probability(f) if len(b) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(good)], out.names)

    scored = stats.mapInArrow(run, out)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return scored.select(F.col("id").alias(id_col), *COUNTS, failed.alias("base_failed"), (~failed & (F.col("good") >= threshold)).alias("kept"), "good")
