"""LM scoring: a count model over words, and causal self-attention over subwords.

Everything counted covers all training documents: word counts for the base
score, and the subword classes, rows and tables of ``attention``. Texts are
encoded once, to a table of subword ids by training round; all passes that learn,
and the model's scoring, read that. Frequent words
are counted in the map tasks in a table of fixed size; the others travel once, as
packed hashes, to the block that counts them, and send their documents partial
sums. The attention weights learn from every window of every training document,
once: in rounds that double, each task trains on its own documents, and the
weights are averaged between rounds.
"""

from __future__ import annotations

import base64
import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmscope.llm import attention
from firmscope.llm import textkernel as tk
from firmscope.llm.shared import n_parts, need, new_path, saved, small_batches
from firmscope.llm.token_counts import PATTERN

#: Documents (by a hash of the id) whose words are candidates for FREQUENT. This
#: only decides where a word is counted, not what is counted.
SAMPLE_DOCS = 4000
#: Training rounds; the first two take 2 ** -(ROUNDS - 1) of the documents each.
ROUNDS, RATE, BATCH = 7, 3e-3, 256
#: Words counted in the map tasks.
FREQUENT = 1 << 15
#: Subword lists that a worker keeps at most.
CACHE_SIZE = 600_000
_CHUNK = 2 << 20
_BLOCKS, _SLICES = 4, 64

_ROW = np.dtype([("id", "<i8"), ("key", "<i8"), ("train", "u1")])
_ENTRY = np.dtype([("word", "<u8"), ("row", "<u4")])
_CELL = np.dtype([("at", "<u4"), ("n", "<u8")])
_WORD = np.dtype([("word", "<u8"), ("n", "<i8")])
_BLOB = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("rows", T.BinaryType()), T.StructField("entries", T.BinaryType())])
_PART = "block int, sums binary, words long, total long, cells binary"
_SUM = np.dtype([("id", "<i8"), ("key", "<i8"), ("part", "<f8"), ("known", "<i8")])

_ODD_SPACE = regex.compile(r"[^\S\n ]")
_encodings: dict[str, object] = {}
_caches: dict[str, list[_Lists]] = {}


def _encoding(path: str):
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        _encodings[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


@dataclass
class _Lists:
    """Subword lists of words; the words' hashes are in order."""

    words: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    ids: np.ndarray

    @staticmethod
    def empty() -> _Lists:
        return _Lists(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32))

    def find(self, words: np.ndarray) -> np.ndarray:
        """Place of each word; -1 for words that have none."""
        if not len(self.words):
            return np.full(len(words), -1)
        i = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[i] == words, i, -1)

    def lists(self, i: np.ndarray) -> np.ndarray:
        """The lists at the places i, one behind the other."""
        return self.ids[tk.ranges(self.begin[i], self.size[i])]

    def add(self, words: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        """Words in order, none of which is here."""
        at = np.searchsorted(self.words, words)
        begin = len(self.ids) + np.cumsum(size) - size
        self.words, self.begin, self.size = np.insert(self.words, at, words), np.insert(self.begin, at, begin), np.insert(self.size, at, size)
        self.ids = np.concatenate([self.ids, ids])


def _encode(w: tk.Words, at: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(sizes, ids): the subwords of the words ``at``; words come behind a blank.

    One call encodes all words, parted by line ends, which the pattern keeps
    apart; words with odd white space inside are encoded one by one.
    """
    e, n = _encoding(path), w.ends[at] - w.starts[at]
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    # A blank before each word, a line end behind it.
    raw = np.full(int(n.sum()) + 2 * len(at), ord("\n"), np.uint8)
    to = np.cumsum(n + 2) - n - 1
    raw[to - 1] = ord(" ")
    raw[tk.ranges(to, n)] = w.mapped[tk.ranges(w.starts[at], n)]
    joined = raw.tobytes().replace(b"\xff", b"\0").decode("utf-8")
    if _ODD_SPACE.search(joined):
        lists = [e.encode_ordinary(x) for x in joined[:-1].split("\n")]
        return np.array(list(map(len, lists))), np.array([i for x in lists for i in x], np.uint32)
    ids = np.array(e.encode_ordinary(joined), np.uint32)
    inside = ids != e.encode_single_token("\n")
    return np.diff(np.flatnonzero(~inside), prepend=-1) - 1, ids[inside]


def subwords(w: tk.Words, h: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, first): the subwords of each document of a chunk, word by word.

    Workers keep the lists of two generations of words: one that is filled, and
    the one filled before, whose words move over when they are seen again.
    """
    unique, where, inverse = np.unique(h, return_index=True, return_inverse=True)
    _cache = _caches.setdefault(path, [_Lists.empty(), _Lists.empty()])
    if len(_cache[0].words) > CACHE_SIZE // 2:
        _cache[1], _cache[0] = _cache[0], _Lists.empty()
    young, old = _cache
    missing = np.flatnonzero(young.find(unique) < 0)
    place = old.find(unique[missing])
    again, place = missing[place >= 0], place[place >= 0]
    young.add(unique[again], old.size[place], old.lists(place))
    new = np.setdiff1d(missing, again, assume_unique=True)
    young.add(unique[new], *_encode(w, where[new], path))
    i = young.find(unique)[inverse]
    first = np.concatenate([[0], np.cumsum(young.size[i])])[w.first]
    return young.lists(i).astype(np.int64), first


class FrequentWords:
    """A bounded list of words, by hash, with places for their counts."""

    def __init__(self, words: np.ndarray):
        self.words = np.sort(words)
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[self.words >> np.uint64(46)] = True

    def places(self, h: np.ndarray) -> np.ndarray:
        """Place of each word; -1 for words that aren't listed."""
        out = np.full(len(h), -1, np.int64)
        if len(self.words):
            some = np.flatnonzero(self.maybe[h >> np.uint64(46)])
            i = np.minimum(np.searchsorted(self.words, h[some]), len(self.words) - 1)
            out[some] = np.where(self.words[i] == h[some], i, -1)
        return out


def _count(batches: Iterator[pa.RecordBatch], frequent: FrequentWords, n_blocks: int) -> Iterator[pa.RecordBatch]:
    """Per batch the other words as blobs by block; per task the listed words, by slice."""
    listed = np.zeros(len(frequent.words), np.int64)
    any_rows = False

    def batch(out: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], _BLOB.names)

    for b in batches:
        any_rows |= len(b) > 0
        rows = np.zeros(len(b), _ROW)
        rows["id"], rows["key"], rows["train"] = b.column(0).to_numpy(), b.column(1).to_numpy(), np.array(b.column(2))
        entries = [np.zeros(0, _ENTRY)]
        for at, to, data, offsets in tk.chunks(b.column(3), _CHUNK):
            w = tk.words(data, offsets, tk.LOWER)
            h, doc = w.hashes(), w.doc()
            train = rows["train"][at:to] > 0
            place = frequent.places(h)
            listed += np.bincount(place[(place >= 0) & train[doc]], minlength=len(listed))
            rare = place < 0
            e = np.zeros(int(rare.sum()), _ENTRY)
            e["word"], e["row"] = h[rare], doc[rare] + at
            entries.append(e)
        e = np.concatenate(entries)
        block = tk.bucket(e["word"], n_blocks)
        order = np.argsort(block, kind="stable")
        edges = np.searchsorted(block[order], np.arange(n_blocks + 1))
        out = []
        for k in range(n_blocks):
            mine = e[order[edges[k] : edges[k + 1]]]
            if len(mine):
                used, mine["row"] = np.unique(mine["row"], return_inverse=True)
                out.append((k, rows[used].tobytes(), mine.tobytes()))
        yield batch(out)
    if any_rows:
        yield batch([(-1 - k, b"", c) for k, c in _cells(listed)])


def _cells(table: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The filled cells of a table, dealt to slices in turn."""
    at = np.flatnonzero(table)
    order = np.argsort(at % _SLICES, kind="stable")
    cells = np.zeros(len(at), _CELL)
    cells["at"], cells["n"] = at[order], table[at[order]]
    edges = np.searchsorted(cells["at"] % _SLICES, np.arange(_SLICES + 1))
    for k in range(_SLICES):
        if edges[k + 1] > edges[k]:
            yield k, cells[edges[k] : edges[k + 1]].tobytes()


def _reduce(batches: Iterator[pa.RecordBatch], table_size: int, n_blocks: int) -> Iterator[pa.RecordBatch]:
    """Blocks: count words, send documents the sums of theirs. Slices: add cells."""
    block, parts = None, []
    held: list[np.ndarray] = []
    totals = [0, 0]

    def out(**k) -> pa.RecordBatch:
        n = len(next(iter(k.values())))
        return pa.RecordBatch.from_arrays([pa.array(k[f.name], f.type) if f.name in k else pa.nulls(n, f.type) for f in _ARROW], _ARROW.names)

    def done() -> Iterator[pa.RecordBatch]:
        if block < 0:
            table = np.zeros(table_size // _SLICES + 1, np.uint64)
            for _, c in parts:
                table[c["at"] // _SLICES] += c["n"]
            at = np.flatnonzero(table)
            cells = np.zeros(len(at), _CELL)
            cells["at"], cells["n"] = at * _SLICES + (-1 - block), table[at]
            yield out(cells=[cells.tobytes()])
            return
        shift = np.cumsum([0, *[len(r) for r, _ in parts[:-1]]])
        rows = np.concatenate([r for r, _ in parts])
        word = np.concatenate([e["word"] for _, e in parts])
        row = np.concatenate([e["row"].astype(np.int64) + s for (_, e), s in zip(parts, shift, strict=True)])
        order = np.argsort(word, kind="stable")
        new = np.concatenate([[True], word[order[1:]] != word[order[:-1]]])
        group = np.cumsum(new) - 1
        c = np.bincount(group, rows["train"][row[order]])
        totals[0] += int((c > 0).sum())
        totals[1] += int(c.sum())
        sums = np.zeros(len(rows), _SUM)
        sums["id"], sums["key"] = rows["id"], rows["key"]
        sums["part"] = np.bincount(row[order], np.log10(c + 0.1)[group], len(rows))
        sums["known"] = np.bincount(row[order], (c > 0)[group], len(rows))
        held.append(sums)

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            sums = _added(held)
            held.clear()
            to = tk.bucket(tk.mix(sums["id"].view(np.uint64) ^ tk.mix(sums["key"].view(np.uint64))), n_blocks)
            order = np.argsort(to, kind="stable")
            edges = np.searchsorted(to[order], np.arange(n_blocks + 1))
            some = np.flatnonzero(np.diff(edges))
            yield out(block=some, sums=[sums[order[edges[k] : edges[k + 1]]].tobytes() for k in some])

    for batch in batches:
        for k, r, e in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            if k != block and parts:
                yield from done()
                parts = []
                if sum(map(len, held)) > 1 << 20:
                    yield from flush()
            block = k
            parts.append((np.frombuffer(r.as_buffer(), _ROW), np.frombuffer(e.as_buffer(), _CELL if k < 0 else _ENTRY)))
    if parts:
        yield from done()
    yield from flush()
    yield out(words=[totals[0]], total=[totals[1]])


def _added(parts: list[np.ndarray]) -> np.ndarray:
    """One entry for each (id, key), with the sums of its entries."""
    sums = np.concatenate(parts)
    sums = sums[np.lexsort((sums["key"], sums["id"]))]
    first = np.flatnonzero(np.concatenate([[True], (sums["id"][1:] != sums["id"][:-1]) | (sums["key"][1:] != sums["key"][:-1])]))
    out = sums[first]
    out["part"], out["known"] = np.add.reduceat(sums["part"], first), np.add.reduceat(sums["known"], first)
    return out


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each (id, key) of the packed sums, which come sorted by block."""
    block, parts = None, []

    def done() -> pa.RecordBatch:
        s = _added(parts)
        return pa.RecordBatch.from_arrays([pa.array(s[c].copy()) for c in _SUM.names], _SUM.names)

    for batch in batches:
        for k, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if k != block and parts:
                yield done()
                parts = []
            block = k
            parts.append(np.frombuffer(x.as_buffer(), _SUM))
    if parts:
        yield done()


_ARROW = pa.schema([("block", pa.int32()), ("sums", pa.binary()), ("words", pa.int64()), ("total", pa.int64()), ("cells", pa.binary())])
_BASE = T.StructType([T.StructField(c, t) for c, t in (("id", T.LongType()), ("key", T.LongType()), ("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("known", T.LongType()), ("part", T.DoubleType()))])


def _base(batches: Iterator[pa.RecordBatch], frequent: FrequentWords, listed: np.ndarray, ends: int) -> Iterator[pa.RecordBatch]:
    """What the listed words add to the base score."""
    logs = np.log10(listed + 0.1)
    for b in batches:
        n, known, part = ([np.zeros(0)] for _ in range(3))
        for _, _, data, offsets in tk.chunks(b.column(3), _CHUNK):
            w = tk.words(data, offsets, tk.LOWER)
            h, doc = w.hashes(), w.doc()
            place = frequent.places(h)
            some = place >= 0
            size = len(offsets) - 1
            n.append(w.n_words + 1)
            known.append(np.bincount(doc[some], listed[place[some]] > 0, size) + (ends > 0))
            part.append(np.bincount(doc[some], logs[place[some]], size) + np.log10(ends + 0.1))
        ints = lambda x: pa.array(np.concatenate(x).astype(np.int64))
        held_out = pa.array(~np.array(b.column(2), bool))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), held_out, ints(n), ints(known), pa.array(np.concatenate(part))], _BASE.names)


def _score(batches: Iterator[pa.RecordBatch], model: attention.Model) -> Iterator[pa.RecordBatch]:
    """Scores of the stored texts by the model."""
    for b in batches:
        for row, (ids, first) in zip(b.column(2), _texts([b], model.vocabulary.size), strict=True):
            name = np.frombuffer(row.as_buffer(), _NAME)
            score = model.scores(*attention.sequences(model.vocabulary, ids, first)) / np.log(10)
            yield pa.RecordBatch.from_arrays([pa.array(name["id"].copy()), pa.array(name["key"].copy()), pa.array(score)], ["id", "key", "score"])


def score_texts(docs: DataFrame, path: str, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts are lower-cased (A-Z); tokens are the words ``[^\\x20\\x09-\\x0D]+`` and
    one end a text. ``base_score`` is the add-0.1 count model over words,
    ``score`` the log10 probability of the same text and its end under the
    attention model over subwords. Both learn from the rows where ``held_out`` (a
    condition on the id; none: all rows) is not true. Null texts count as empty
    (the end alone). Without training rows the counts are empty and the scores
    still proper. Repeated rows count and are scored each; rows without id train.
    ``path`` is the subword vocabulary's file.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    train = F.lit(True) if held_out is None else ~F.coalesce(held_out, F.lit(False))
    ident = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(1 << 63)))
    base = need(docs, id_col, text_col).select(ident.alias("id"), F.xxhash64(text).alias("key"), train.alias("train"), text.alias("text"))

    size = _encoding(path).n_vocab
    stored = _stored(base, path, size)
    encoded = stored.where(F.col("round") < ROUNDS)
    vocabulary = _vocabulary(encoded, size)
    model = attention.Model.start(vocabulary, _counts(encoded, vocabulary))
    model.p, _ = _trained(encoded, model)

    frequent = _frequent(base)
    ends = base.where("train").count()
    sent = spark.sparkContext.broadcast(frequent)
    n_blocks = _BLOCKS * n_parts(spark)
    blobs = base.mapInArrow(lambda it: _count(it, sent.value, n_blocks), _BLOB)
    dealt = blobs.repartition(n_parts(spark), "block").sortWithinPartitions("block")
    parts = saved(dealt.mapInArrow(lambda it: _reduce(it, len(frequent.words), n_blocks), _PART), "lm-parts")
    listed = np.zeros(len(frequent.words), np.int64)
    for cells in parts.where("cells is not null").select("cells").toArrow()["cells"]:
        c = np.frombuffer(cells.as_buffer(), _CELL)
        listed[c["at"]] = c["n"]
    rare = parts.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("words"), F.coalesce(F.sum("total"), F.lit(0)).alias("total")).first()
    total = int(listed.sum()) + rare["total"] + ends
    distinct = int((listed > 0).sum()) + rare["words"] + (ends > 0)
    ready, learned = spark.sparkContext.broadcast((frequent, listed, ends)), spark.sparkContext.broadcast(model)
    scored = base.mapInArrow(lambda it: _base(it, *ready.value), _BASE)
    scores = stored.select("first", "ids", "names").mapInArrow(lambda it: _score(it, learned.value), "id long, key long, score double")
    packed = parts.where("block is not null").select("block", "sums").repartition(n_parts(spark), "block").sortWithinPartitions("block")
    sums = packed.mapInArrow(_gather, "id long, key long, part double, known long").withColumnsRenamed({"part": "_part", "known": "_known"})
    # Rows that repeat share one sum: each row's share is the sum over the number of them.
    # They have one text, so any one's score is all theirs.
    repeats = scores.groupBy("id", "key").agg(F.count("*").alias("count"), F.max("score").alias("score"))
    sums = repeats.join(sums, ["id", "key"], "left").select("score", "id", "key", (F.col("_part") / F.col("count")).alias("_part"), (F.col("_known") / F.col("count")).cast("long").alias("_known"))
    out = scored.join(sums, ["id", "key"])
    norm = float(np.log10(total + 0.1 * (distinct + 1)))
    return out.select(
        F.when(F.col("id") > F.lit(-(1 << 63)), F.col("id")).alias(id_col),
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("part") + F.coalesce("_part", F.lit(0.0)) - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        "score",
    )


_IDS = T.StructType([T.StructField("round", T.IntegerType()), T.StructField("first", T.BinaryType()), T.StructField("ids", T.BinaryType()), T.StructField("names", T.BinaryType())])
_NAME = np.dtype([("id", "<i8"), ("key", "<i8")])


def _encoded(base: DataFrame, path: str, size: int) -> DataFrame:
    """Those of ``_stored`` that train."""
    return _stored(base, path, size).where(F.col("round") < ROUNDS)


def _stored(base: DataFrame, path: str, size: int) -> DataFrame:
    """(first, ids, names) of all texts, a row for each chunk and training round, in a
    table that is laid out by round; those that are held out are in round ROUNDS."""
    spark, kind = base.sparkSession, np.uint16 if size < 1 << 16 else np.uint32
    draw = F.pmod(F.xxhash64(F.lit("round"), "id", "key"), F.lit(1 << (ROUNDS - 1)))
    round_of = F.when(draw == 0, 0).otherwise(F.floor(F.log2(draw.cast("double"))) + 1).cast("int")
    texts = base.select(F.when(F.col("train"), round_of).otherwise(ROUNDS).alias("round"), "id", "key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rounds, names = b.column(0).to_numpy(), np.zeros(len(b), _NAME)
            names["id"], names["key"] = b.column(1).to_numpy(), b.column(2).to_numpy()
            for at, to, data, offsets in tk.chunks(b.column(3), _CHUNK):
                w = tk.words(data, offsets, tk.LOWER)
                ids, first = subwords(w, w.hashes(), path)
                ids, n, out = ids.astype(kind), np.diff(first), []
                for k in range(ROUNDS + 1):
                    mine = rounds[at:to] == k
                    if mine.any():
                        out.append((k, np.concatenate([[0], np.cumsum(n[mine])]).tobytes(), ids[np.repeat(mine, n)].tobytes(), names[at:to][mine].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), *[pa.array([x[j] for x in out], pa.binary()) for j in (1, 2, 3)]], _IDS.names)

    where = new_path(spark, "lm-ids")
    with small_batches(spark):
        texts.mapInArrow(run, _IDS).write.partitionBy("round").parquet(where)
    return spark.read.schema(_IDS).parquet(where)


def _texts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The subwords of texts, as (ids, first), chunk by chunk."""
    kind = np.uint16 if size < 1 << 16 else np.uint32
    for b in batches:
        for first, ids in zip(b.column(0), b.column(1), strict=True):
            yield np.frombuffer(ids.as_buffer(), kind).astype(np.int64), np.frombuffer(first.as_buffer(), np.int64)


def _round(batches: Iterator[pa.RecordBatch], model: attention.Model, rate: float, groups: int) -> Iterator[pa.RecordBatch]:
    """Train a copy of the model on a task's texts."""
    model = replace(model, p={k: w.copy() for k, w in model.p.items()})
    adam, n = attention.Adam.start(model.p), 0
    for ids, first in _texts(batches, model.vocabulary.size):
        x, y, offsets = attention.sequences(model.vocabulary, ids, first)
        model.train(x, y, offsets, rate=rate, batch=BATCH, adam=adam)
        n += len(x)
    if n:
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([task % groups], pa.int32()), pa.array([task], pa.int32()), pa.array([n], pa.int64()), pa.array([pickle.dumps(model.p)], pa.binary())], _WEIGHTS.names)


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a group: the mean of its weights by tokens, in the order of tasks."""
    group, parts = None, []

    def done() -> pa.RecordBatch:
        n, p = _mean(parts)
        return pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([0], pa.int32()), pa.array([n], pa.int64()), pa.array([pickle.dumps(p)], pa.binary())], _WEIGHTS.names)

    for b in batches:
        for k, n, w in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
            if k != group and parts:
                yield done()
                parts = []
            group = k
            parts = [_mean([*parts, (n, pickle.loads(w.as_buffer()))])]
    if parts:
        yield done()


def _mean(parts: list[tuple[int, dict[str, np.ndarray]]]) -> tuple[int, dict[str, np.ndarray]]:
    total = sum(n for n, _ in parts)
    return total, {k: sum(p[k] * (n / total) for n, p in parts) for k in parts[0][1]}


_WEIGHTS = T.StructType([T.StructField("group", T.IntegerType()), T.StructField("task", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("weights", T.BinaryType())])


def _trained(encoded: DataFrame, model: attention.Model) -> tuple[dict[str, np.ndarray], int]:
    """(weights, tokens): one pass over all training texts, in rounds of doubling size."""
    spark = encoded.sparkSession
    groups, tokens = math.isqrt(n_parts(spark)) + 1, 0
    for k in range(ROUNDS):
        sent = spark.sparkContext.broadcast(replace(model, share=None))
        rate = RATE * 0.75**k
        texts = encoded.where(F.col("round") == k).select("first", "ids")
        rows = texts.mapInArrow(lambda it, sent=sent, rate=rate: _round(it, sent.value, rate, groups), _WEIGHTS)
        means = rows.repartition(groups, "group").sortWithinPartitions("group", "task").mapInArrow(_averaged, _WEIGHTS)
        parts = [(r["n"], pickle.loads(r["weights"])) for r in sorted(means.collect(), key=lambda r: r["group"])]
        sent.unpersist()
        if parts:
            n, p = _mean(parts)
            model = replace(model, p={k: w.astype(np.float32) for k, w in p.items()})
            tokens += n
    return model.p, tokens


def _table(encoded: DataFrame, vocabulary: attention.Vocabulary, start: Callable[[], np.ndarray], add: Callable[[np.ndarray, np.ndarray, np.ndarray], None]) -> np.ndarray:
    """A table that all training texts add to, with the subwords x before the subwords y."""
    spark, size = encoded.sparkSession, len(start())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = start()
        for ids, first in _texts(batches, vocabulary.size):
            x, y, _ = attention.sequences(vocabulary, ids, first)
            add(table, x, y)
        for k, c in _cells(table):
            yield pa.RecordBatch.from_arrays([pa.array([-1 - k], pa.int32()), pa.array([b""], pa.binary()), pa.array([c], pa.binary())], _BLOB.names)

    dealt = encoded.select("first", "ids").mapInArrow(run, _BLOB).repartition(n_parts(spark), "block").sortWithinPartitions("block")
    table = np.zeros(size, np.int64 if size < 1 << 20 else np.uint32)
    for cells in dealt.mapInArrow(lambda it: _reduce(it, size, 1), _PART).where("cells is not null").select("cells").toArrow()["cells"]:
        c = np.frombuffer(cells.as_buffer(), _CELL)
        table[c["at"]] = c["n"]
    return table


def _vocabulary(encoded: DataFrame, size: int) -> attention.Vocabulary:
    """Subword classes and rows, from counts over all training texts."""
    blank = attention.Vocabulary(size, np.zeros(0), np.zeros(0))

    def add(table: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
        table += np.bincount(y, minlength=size + 1)

    contexts = attention.Contexts.of(_table(encoded, blank, lambda: np.zeros(size + 1, np.int64), add))
    return contexts.vocabulary(_table(encoded, blank, contexts.empty, contexts.add))


def _counts(encoded: DataFrame, v: attention.Vocabulary) -> attention.Counts:
    """What follows what, counted over all training texts."""
    empty = attention.Counts.empty(v)
    cut = empty.pair.size

    def add(table: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
        attention.Counts(table[:cut].reshape(empty.pair.shape), table[cut:].reshape(empty.follow.shape)).add_pairs(v, x, y)

    table = _table(encoded, v, lambda: np.zeros(cut + empty.follow.size, np.int32), add)
    return attention.Counts(table[:cut].reshape(empty.pair.shape), table[cut:].reshape(empty.follow.shape))


def _frequent(base: DataFrame) -> FrequentWords:
    """Words to be counted in the map tasks, from documents drawn by a hash."""
    n = max(base.where("train").count(), 1)
    share = min(1 << 20, -(-(1 << 20) * SAMPLE_DOCS // n))
    drawn = base.where("train").where(F.pmod(F.xxhash64(F.lit("lm"), "id"), F.lit(1 << 20)) < share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, data, offsets in tk.chunks(b.column(0), _CHUNK):
                word, count = np.unique(tk.words(data, offsets, tk.LOWER).hashes(), return_counts=True)
                out = np.zeros(len(word), _WORD)
                out["word"], out["n"] = word, count
                yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["words"])

    parts = [np.frombuffer(w.as_buffer(), _WORD) for w in drawn.select("text").mapInArrow(run, "words binary").toArrow()["words"]]
    all_words = np.concatenate([np.zeros(0, _WORD), *parts])
    word, inverse = np.unique(all_words["word"], return_inverse=True)
    count = np.bincount(inverse, all_words["n"], len(word))
    often = np.argsort(-count, kind="stable")[:FREQUENT]
    return FrequentWords(word[often[count[often] >= 2]])
