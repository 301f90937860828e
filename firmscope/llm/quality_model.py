"""Quality classifier: random-indexing vectors, pooled, and a two-layer network.

Every unit (a word, and its ending) has a fixed sparse ternary index vector. A
unit's meaning is the sum of the index vectors around it over all documents,
added up in the map tasks in tables of fixed size. Documents are the mean and
spread of their units' vectors; a small network trained on labelled documents
turns them into a probability, whose temperature is set on rows held back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmscope.llm import textkernel as tk
from firmscope.llm.shared import n_parts, need, saved

DIM = 32
#: Buckets of words and of word endings; the tables' size is fixed by them.
WORDS, ENDINGS = 1 << 15, 1 << 13
BUCKETS = WORDS + ENDINGS
#: Neighbours on each side that count as context.
REACH = 2
#: Pieces that a task's table is shuffled in.
SLICES = 128
#: Labelled documents for training at most (drawn by a hash of the id beyond).
MAX_TRAIN = 20_000
POOLED = 4 * DIM + 1


def units(w: tk.Words) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word and of its ending (the last three bytes and its length class)."""
    h = w.hashes()
    ending = np.zeros(len(h), np.uint64)
    for back in (1, 2, 3):
        at = w.ends - back
        ending = ending * np.uint64(257) + np.where(at >= w.starts, w.data[np.maximum(at, 0)], 0).astype(np.uint64)
    ending = tk.mix(ending * np.uint64(7) + np.minimum((w.ends - w.starts) // 4, 6).astype(np.uint64))
    return tk.bucket(h, WORDS), WORDS + tk.bucket(ending, ENDINGS)


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(two dimensions, two signs) of each bucket's index vector."""
    x = tk.mix(np.arange(BUCKETS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    dims = np.stack([x % np.uint64(DIM), (x >> np.uint64(16)) % np.uint64(DIM)], 1).astype(np.int64)
    signs = np.stack([1 - 2 * ((x >> np.uint64(40)) & np.uint64(1)).astype(np.int64), 1 - 2 * ((x >> np.uint64(41)) & np.uint64(1)).astype(np.int64)], 1)
    return dims, signs.astype(np.float64)


def context_table(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """[BUCKETS, DIM] sums of the index vectors around each unit, over all documents."""
    out = T.StructType([T.StructField("slice", T.IntegerType()), T.StructField("sums", T.BinaryType())])
    step = -(-BUCKETS // SLICES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims, signs = _index_vectors()
        table, rows = np.zeros(BUCKETS * DIM), 0
        for b in batches:
            rows += len(b)
            for _, _, data, offsets in tk.chunks(b.column(0)):
                w = tk.words(data, offsets)
                doc = w.doc()
                for u in units(w):
                    where, value = [], []
                    for o in range(1, REACH + 1):
                        same = np.flatnonzero(doc[o:] == doc[:-o]) if len(doc) > o else np.zeros(0, np.int64)
                        for x, y in ((u[same], u[same + o]), (u[same + o], u[same])):
                            where.append((x[:, None] * DIM + dims[y]).ravel())
                            value.append(signs[y].ravel())
                    table += np.bincount(np.concatenate(where), np.concatenate(value), BUCKETS * DIM)
        if rows:
            t = table.reshape(BUCKETS, DIM).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES, dtype=np.int32)), pa.array([t[k * step : (k + 1) * step].tobytes() for k in range(SLICES)], pa.binary())], out.names)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                v = np.frombuffer(x.as_buffer(), np.int32).astype(np.int64)
                sums[k] = sums[k] + v if k in sums else v
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], out.names)

    parts = need(docs, text_col).mapInArrow(count, out)
    summed = parts.repartition(min(SLICES, n_parts(docs.sparkSession)), "slice").mapInArrow(add, out).toArrow().sort_by("slice")
    table = np.zeros((BUCKETS, DIM))
    for k, x in zip(summed["slice"].to_pylist(), summed["sums"].to_pylist(), strict=True):
        v = np.frombuffer(x, np.int64).reshape(-1, DIM)
        table[k * step : k * step + len(v)] = v
    return table


def unit_vectors(table: np.ndarray) -> np.ndarray:
    """Contexts without their common direction, at length 1; unseen units are 0."""
    size = np.linalg.norm(table, axis=1, keepdims=True)
    v = np.where(size > 0, table / np.maximum(size, 1e-9), 0)
    for part in (slice(0, WORDS), slice(WORDS, BUCKETS)):
        weight = size[part]
        if weight.sum():
            v[part] -= np.where(weight > 0, (v[part] * weight).sum(0) / weight.sum(), 0)
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return np.where(size > 0, v / np.maximum(size, 1e-9), 0).astype(np.float32)


def pool(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """[docs, POOLED] mean and spread of the units' vectors and the log length."""
    w = tk.words(data, offsets)
    n = w.n_words
    out = np.zeros((len(n), POOLED), np.float32)
    some = np.flatnonzero(n)
    if len(some):
        at = w.first[:-1][some]
        for k, u in enumerate(units(w)):
            v = vectors[u]
            mean = np.add.reduceat(v, at, 0) / n[some, None]
            square = np.add.reduceat(v * v, at, 0) / n[some, None]
            out[some, 2 * k * DIM : (2 * k + 1) * DIM] = mean
            out[some, (2 * k + 1) * DIM : (2 * k + 2) * DIM] = np.sqrt(np.maximum(square - mean * mean, 0))
        out[some, -1] = np.log1p(n[some]) / 8
    return out


@dataclass
class Network:
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum((x - self.centre) / self.scale @ self.w1 + self.b1, 0)
        return h @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, rate: float = 2e-3, decay: float = 1e-3, seed: int = 7) -> Network:
    """Fit the network by Adam on four fifths of the rows, the temperature on the rest.
    Without both labels it gives 0.5, or the only label there is."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    net = Network(np.zeros(d), np.ones(d), rng.normal(0, (2 / d) ** 0.5, (d, hidden)), np.zeros(hidden), np.zeros(hidden), 0.0)
    if not len(y) or y.min() == y.max():
        net.b2 = 0.0 if not len(y) else (20.0 if y[0] else -20.0)
        return net
    net.centre, net.scale = x.mean(0), x.std(0) + 1e-3
    net.w2 = rng.normal(0, hidden**-0.5, hidden)
    order = rng.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5 :]
    z = (x - net.centre) / net.scale
    p = [net.w1, net.b1, net.w2, np.array([net.b2])]
    m, v, step = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    for epoch in range(epochs):
        rng.shuffle(used)
        for at in range(0, len(used), 256):
            i = used[at : at + 256]
            pre = z[i] @ p[0] + p[1]
            h = np.maximum(pre, 0)
            out = h @ p[2] + p[3][0]
            g = (1 / (1 + np.exp(-np.clip(out, -40, 40))) - y[i]) / len(i)
            back = np.outer(g, p[2]) * (pre > 0)
            grads = [z[i].T @ back + decay * p[0], back.sum(0), h.T @ g + decay * p[2], np.array([g.sum()])]
            step += 1
            for k, q in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * q
                v[k] = 0.999 * v[k] + 0.001 * q * q
                p[k] -= rate * (1 - epoch / epochs) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = p[0], p[1], p[2], float(p[3][0])
    if len(held):
        z, t = net.logit(x[held]), np.exp(np.linspace(np.log(0.25), np.log(8), 61))
        loss = [np.logaddexp(0, np.where(y[held] > 0, -z, z) / s).mean() for s in t]
        net.temperature = float(t[int(np.argmin(loss))])
    return net


def classify(
    docs: DataFrame,
    labels: DataFrame,
    learn_from: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    max_train: int = MAX_TRAIN,
) -> DataFrame:
    """One row a document: id, score (0 to 1, higher: label 1 likelier).

    Vectors come from all texts; labels only from rows of ``labels`` where
    ``learn_from`` (a condition on the id) holds. Only the text is an input. Null
    texts count as empty and get the score of an empty text; without labels every
    score is 0.5. Repeated rows get a row each; of several texts with one id the
    network learns from one (that with the smallest vector).
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(unit_vectors(context_table(docs, text_col)))
    out = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("pooled", T.ArrayType(T.FloatType()))])

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.concatenate([np.zeros((0, POOLED), np.float32), *[pool(data, offsets, sent.value) for _, _, data, offsets in tk.chunks(b.column(1))]])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * POOLED), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], out.names)

    vectors = saved(need(docs, id_col, text_col).mapInArrow(pooled, out), "quality-vectors")
    marks = labels if learn_from is None else labels.where(learn_from)
    marks = marks.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    n = marks.count()
    if n > max_train:
        marks = marks.where(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 20)) < int((1 << 20) * max_train / n))
    # One text an id, so that the bound on labels holds for rows.
    drawn = vectors.join(marks, "id").groupBy("id").agg(F.min(F.struct("pooled", "y")).alias("r"))
    t = drawn.select("id", "r.pooled", "r.y").toArrow().sort_by("id")
    x = np.array(t["pooled"].combine_chunks().flatten(), np.float64).reshape(t.num_rows, POOLED)
    net = spark.sparkContext.broadcast(train(x, t["y"].to_numpy().astype(np.float64)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column(1).flatten(), np.float64).reshape(len(b), POOLED)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(net.value.probability(x))], ["id", "score"])

    scored = vectors.mapInArrow(score, T.StructType([out["id"], T.StructField("score", T.DoubleType())]))
    return scored.withColumnRenamed("id", id_col)
