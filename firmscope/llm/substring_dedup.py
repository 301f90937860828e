"""Substring dedup by relative Lempel-Ziv parsing.

A document is read as a sequence of *phrases*: runs of neighbouring windows whose
smallest k-gram is the same occurrence. The cut depends on content alone, so a
passage that two documents share is cut alike in both. The reference is every
phrase of every document, indexed in blocks by the phrase's smallest k-gram; a
phrase goes to the one block that can hold an equal one, which stands for looking
it up in all blocks.

1. A block answers each phrase with its source: the place of the equal phrase in
   the document of the smallest id, if that is an earlier document.
2. The parse takes a document's phrases in order and extends the factor that it
   is in for as long as the next phrase continues the same source; where it does
   not, the next factor starts. Each phrase covers a window at least, so every
   factor is long enough to be a duplicate span.
3. At factor boundaries stand phrases without a source whose k-gram other phrases
   have too: there the windows are checked one by one against the windows of
   those phrases, and windows found extend the factors.
4. Factors and windows become spans, and spans are cut out of the text.

Equal phrases are combined in the map tasks (the smallest document is kept, the
others have their source on the spot), so a passage that a third of all documents
share sends one entry a task. A k-gram with many different phrases in one piece of
text is hot: those phrases go straight to the check of single windows, spread by
window, and its block gets one marker a piece. Only hashes and positions are
shuffled, as packed blobs; texts travel once, to meet their spans.
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
from firmscope.llm.shared import blocks_by_size, n_parts, need, saved

WINDOW = 13
GRAM = 6
#: Input bytes for each block of the reference index, and for each block of documents
#: to parse. Their numbers follow the data, so that blobs do not get smaller with more
#: partitions.
INDEX_BYTES, PARSE_BYTES = 4 << 20, 16 << 20
#: Text handled in one piece by the map tasks.
PIECE_BYTES = 8 << 20
#: Different phrases of one k-gram in a piece from which on it is hot.
HOT = 64
_NO_ID = -(1 << 63)

_ENTRY = np.dtype([("gram", "<u8"), ("phrase", "<u8"), ("row", "<u4"), ("at", "<u4"), ("n", "u1")])
_ROW = np.dtype([("id", "<i8"), ("key", "<i8")])
#: A phrase, or window, of a document with its source; ``CHECK`` ones have none yet.
_FOUND = np.dtype([("source", "<i8"), ("row", "<u4"), ("at", "<u4"), ("from", "<u4"), ("n", "u1"), ("kind", "u1")])
_BLOB = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("rows", T.BinaryType()), T.StructField("entries", T.BinaryType())])
MATCHED, CHECK = 1, 2
#: ``n`` of the entry that marks a hot k-gram.
_MARK = 0


def phrases(w: tk.Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(entries with row = index of the document in the chunk, at = first word
    counted from the document's start, n = windows; their absolute first words)."""
    h = w.hashes()
    at = tk.gram_starts(w.first, window)
    if not len(at):
        return np.zeros(0, _ENTRY), at
    g = tk.grams(h, gram)
    n = len(g) - (window - gram)
    low, arg = g[:n].copy(), np.zeros(n, np.int8)
    for j in range(1, window - gram + 1):
        less = g[j : j + n] < low
        np.copyto(low, g[j : j + n], where=less)
        arg[less] = j
    where = at + arg[at]
    first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]]))
    count = np.diff(np.concatenate([first, [len(at)]]))
    begin, centre = at[first], where[first]
    power, inverse = tk._power_tables(len(h) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power[:-1])])
    end = begin + count + window - 1
    doc = np.searchsorted(w.first, begin, "right") - 1
    out = np.zeros(len(first), _ENTRY)
    out["gram"] = g[centre]
    out["phrase"] = tk.mix((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    out["row"], out["at"], out["n"] = doc, begin - w.first[doc], count
    return out, begin


def _first(key: np.ndarray, ident: np.ndarray) -> np.ndarray:
    """For every entry the index of the entry with its key that has the smallest ident."""
    if not len(key):
        return np.zeros(0, np.int64)
    order = np.lexsort((ident, key))
    first = np.flatnonzero(np.concatenate([[True], key[order[1:]] != key[order[:-1]]]))
    out = np.empty(len(key), np.int64)
    out[order] = np.repeat(order[first], np.diff(np.concatenate([first, [len(key)]])))
    return out


def _dealt(entries: np.ndarray, rows: np.ndarray, block: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """(block, rows, entries): each blob carries the rows that its entries name."""
    order = np.argsort(block, kind="stable")
    edges = np.flatnonzero(np.diff(block[order], prepend=-1, append=-1)) if len(block) else np.zeros(0, np.int64)
    for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        mine = entries[order[x:y]]
        used, mine["row"] = np.unique(mine["row"], return_inverse=True)
        yield int(block[order[x]]), rows[used].tobytes(), mine.tobytes()


def _to_documents(found: np.ndarray, rows: np.ndarray, n_blocks: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Deal what was found to its documents; such blobs have negative block numbers."""
    spread = tk.bucket(tk.mix(rows["id"].view(np.uint64) ^ tk.mix(rows["key"].view(np.uint64))), n_blocks)
    return ((-1 - k, r, e) for k, r, e in _dealt(found, rows, spread[found["row"]]))


def _batch(blobs: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in blobs], pa.int32()), pa.array([x[1] for x in blobs], pa.binary()), pa.array([x[2] for x in blobs], pa.binary())], _BLOB.names)


def _unpack(batches: Iterator[pa.RecordBatch], dtype: np.dtype) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, entries) of one block after the other; blobs come sorted by block."""
    block, rows, entries = None, [], []

    def joined():
        out, at, shift = np.empty(sum(map(len, entries)), dtype), 0, 0
        for r, e in zip(rows, entries, strict=True):
            out[at : at + len(e)] = e
            out["row"][at : at + len(e)] += np.uint32(shift)
            at, shift = at + len(e), shift + len(r)
        return np.concatenate(rows), out

    for batch in batches:
        for b, r, e in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            if b != block and rows:
                yield joined()
                rows, entries = [], []
            block = b
            rows.append(np.frombuffer(r.as_buffer(), _ROW))
            entries.append(np.frombuffer(e.as_buffer(), dtype))
    if rows:
        yield joined()


def _pieces(b: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(first row, rows) of pieces of a batch (id, key, text, ...) of bounded text."""
    for at, to, _, _ in tk.chunks(b.column(2), PIECE_BYTES):
        yield at, b.slice(at, to - at)


def _rows(b: pa.RecordBatch) -> np.ndarray:
    rows = np.zeros(len(b), _ROW)
    rows["id"], rows["key"] = b.column(0).to_numpy(), b.column(1).to_numpy()
    return rows


def _found(e: np.ndarray, kind: int, source: np.ndarray | int = 0, begin: np.ndarray | int = 0) -> np.ndarray:
    out = np.zeros(len(e), _FOUND)
    out["row"], out["at"], out["n"], out["kind"], out["source"], out["from"] = e["row"], e["at"], e["n"], kind, source, begin
    return out


def _with_sources(e: np.ndarray, ids: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(True for entries with an equal one in an earlier document, what is found for them)."""
    first = _first(key, ids)
    matched = ids > ids[first]
    source = first[matched]
    return matched, _found(e[matched], MATCHED, ids[source], e["at"][source])


def _several(key: np.ndarray, value: np.ndarray) -> np.ndarray:
    """True for the entries whose key has more than one value."""
    if not len(key):
        return np.zeros(0, bool)
    order = np.argsort(key, kind="stable")
    k, v = key[order], value[order]
    edge = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    out = np.empty(len(key), bool)
    out[order] = np.repeat(np.minimum.reduceat(v, edge) != np.maximum.reduceat(v, edge), np.diff(np.concatenate([edge, [len(k)]])))
    return out


def _index(batches: Iterator[pa.RecordBatch], window: int, gram: int, n_blocks: int, n_parse: int, hot_at: int) -> Iterator[pa.RecordBatch]:
    """Map side: the phrases of a piece of text, combined, as blobs by block."""
    for b in batches:
        for _, piece in _pieces(b):
            rows, parts = _rows(piece), [np.zeros(0, _ENTRY)]
            for at, _, data, offsets in tk.chunks(piece.column(2)):
                e, _ = phrases(tk.words(data, offsets), window, gram)
                e["row"] += np.uint32(at)
                parts.append(e)
            e = np.concatenate(parts)
            e = e[rows["id"][e["row"]] > _NO_ID]
            matched, found = _with_sources(e, rows["id"][e["row"]], e["phrase"])
            e = e[~matched]
            # Equal phrases are one by now but for rows of one id, so entries stand for phrases.
            unique, of, times = np.unique(e["gram"], return_inverse=True, return_counts=True)
            hot = times[of] >= hot_at if len(e) else np.zeros(0, bool)
            found = np.concatenate([found, _found(e[hot], CHECK)])
            marks = e[hot][np.unique(of[hot], return_index=True)[1]]
            marks["n"] = _MARK
            e = np.concatenate([e[~hot], marks])
            yield _batch([*_dealt(e, rows, tk.bucket(e["gram"], n_blocks)), *_to_documents(found, rows, n_parse)])


def _answers(batches: Iterator[pa.RecordBatch], n_parse: int, answer) -> Iterator[pa.RecordBatch]:
    """Blobs of documents pass; blobs of a block are answered with blobs of documents."""
    ready: list[pa.RecordBatch] = []

    def split():
        for b in batches:
            to_document = pa.array(np.array(b.column(0)) < 0)
            ready.append(b.filter(to_document))
            yield b.filter(pc.invert(to_document))

    for rows, e in _unpack(split(), _ENTRY):
        while ready:
            yield ready.pop()
        found = answer(rows, e)
        if len(found):
            yield _batch(list(_to_documents(found, rows, n_parse)))
    yield from ready


def _look_up(rows: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Sources of a block's phrases, and the phrases whose windows must be checked:
    the first ones of different phrases that two documents have around one k-gram."""
    marked = e["n"] == _MARK
    hot = np.unique(e["gram"][marked])
    e = e[~marked]
    ids = rows["id"][e["row"]]
    matched, found = _with_sources(e, ids, e["phrase"])
    e, ids = e[~matched], ids[~matched]
    check = _several(e["gram"], ids) | np.isin(e["gram"], hot)
    return np.concatenate([found, _found(e[check], CHECK)])


def _windows(batches: Iterator[pa.RecordBatch], window: int, n_blocks: int, n_parse: int) -> Iterator[pa.RecordBatch]:
    """Hashes of the single windows inside the phrases to check, combined, as blobs by hash."""
    for b in batches:
        for _, piece in _pieces(b):
            rows, parts = _rows(piece), [np.zeros(0, _ENTRY)]
            lists = piece.column(3)
            s_off = lists.offsets.to_numpy().astype(np.int64)
            start, end = (lists.values.field(k).to_numpy().astype(np.int64) for k in (0, 1))
            for at, to, data, offsets in tk.chunks(piece.column(2)):
                w = tk.words(data, offsets)
                mine = slice(s_off[at], s_off[to])
                doc = np.repeat(np.arange(at, to), np.diff(s_off[at : to + 1]))
                count = end[mine] - start[mine] - window + 1
                p = tk.ranges(start[mine] + w.first[doc - at], count)
                row = np.repeat(doc, count)
                e = np.zeros(len(p), _ENTRY)
                if len(p):
                    e["gram"] = tk.grams(w.hashes(), window)[p]
                e["row"], e["at"], e["n"] = row, p - w.first[row - at], 1
                parts.append(e)
            e = np.concatenate(parts)
            matched, found = _with_sources(e, rows["id"][e["row"]], e["gram"])
            e = e[~matched]
            yield _batch([*_dealt(e, rows, tk.bucket(e["gram"], n_blocks)), *_to_documents(found, rows, n_parse)])


def _look_up_windows(rows: np.ndarray, e: np.ndarray) -> np.ndarray:
    return _with_sources(e, rows["id"][e["row"]], e["gram"])[1]


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_FACTORS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("source", T.LongType()), T.StructField("source_start", T.IntegerType())]))
_PARSED = T.StructType([T.StructField("id", T.LongType()), T.StructField("key", T.LongType()), T.StructField("factors", _FACTORS), T.StructField("checks", _SPANS)])


def parse(found: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The greedy parse: (phrase that starts each factor, phrase that ends it).

    ``found`` holds the phrases with a source by document and place. A factor goes
    on while the next phrase follows in the document and in the same source."""
    if not len(found):
        return (np.zeros(0, np.int64),) * 2
    a, b = found[:-1], found[1:]
    step = b["at"].astype(np.int64) - a["at"]
    goes_on = (a["row"] == b["row"]) & (step == a["n"]) & (a["source"] == b["source"]) & (step == b["from"].astype(np.int64) - a["from"])
    begin = np.flatnonzero(np.concatenate([[True], ~goes_on]))
    return begin, np.concatenate([begin[1:], [len(found)]]) - 1


def _parsed(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """One row a document: its factors, and the phrases to check. Blobs come sorted."""
    for rows, e in _unpack(batches, _FOUND):
        ident, of = np.unique(rows, return_inverse=True)
        e["row"] = of[e["row"]]
        e = e[np.lexsort((e["kind"], e["at"], e["row"]))]
        e = e[np.concatenate([[True], (e["row"][1:] != e["row"][:-1]) | (e["at"][1:] != e["at"][:-1])])]
        until = e["at"].astype(np.int64) + e["n"] + window - 1
        is_match = e["kind"] == MATCHED
        m, u = e[is_match], until[is_match]
        begin, end = parse(m, window)
        edges = np.arange(len(ident) + 1)
        ints = lambda x: pa.array(x.astype(np.int32))
        factors = pa.ListArray.from_arrays(
            ints(np.searchsorted(m["row"][begin], edges)), pa.StructArray.from_arrays([ints(m["at"][begin]), ints(u[end]), pa.array(m["source"][begin]), ints(m["from"][begin])], ["start", "end", "source", "source_start"])
        )
        c, v = e[~is_match], until[~is_match]
        checks = pa.ListArray.from_arrays(ints(np.searchsorted(c["row"], edges)), pa.StructArray.from_arrays([ints(c["at"]), ints(v)], ["start", "end"]))
        yield pa.RecordBatch.from_arrays([pa.array(ident["id"].copy()), pa.array(ident["key"].copy()), factors, checks], _PARSED.names)


_RESULT = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("key", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("spans", _SPANS),
        T.StructField("factors", _FACTORS),
        T.StructField("kept", T.StringType()),
    ]
)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the factors of (id, key, text, factors) and join the kept words by one space."""
    for b in batches:
        lists = b.column(3)
        s_off = lists.offsets.to_numpy().astype(np.int64)
        start, end = (lists.values.field(k).to_numpy().astype(np.int64) for k in (0, 1))
        for at, to, data, offsets in tk.chunks(b.column(2)):
            w = tk.words(data, offsets)
            doc = np.repeat(np.arange(to - at), np.diff(s_off[at : to + 1]))
            mine = slice(s_off[at], s_off[to])
            gone = tk.spans_to_mask(len(w.starts), w.first[doc] + start[mine], w.first[doc] + end[mine])
            kept = np.flatnonzero(~gone)
            of = np.searchsorted(w.first, kept, "right") - 1
            # A kept word takes the byte behind it along, unless it is its text's last one.
            space = np.ones(len(kept), np.int64)
            if len(kept):
                space[np.concatenate([of[1:] != of[:-1], [True]])] = 0
            length = w.ends[kept] - w.starts[kept] + space
            change = np.zeros(len(data) + 1, np.int8)
            change[w.starts[kept]] += 1
            change[w.ends[kept] + space] -= 1
            text = np.where(w.mapped == 0, np.uint8(0x20), data)[np.cumsum(change[:-1], dtype=np.int8).view(bool)]
            bytes_of = np.bincount(of, length, to - at).astype(np.int64)
            kept_text = pa.LargeStringArray.from_buffers(to - at, pa.py_buffer(np.concatenate([[0], np.cumsum(bytes_of)]).astype(np.int64)), pa.py_buffer(text)).cast(pa.string())
            edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
            # Spans of neighbouring documents may touch: cut them at document starts.
            inner = w.first[1:-1][(w.first[1:-1] > 0) & (w.first[1:-1] < len(gone))]
            touch = np.unique(inner[gone[inner] & gone[inner - 1]]) if len(inner) else inner
            edge = np.sort(np.concatenate([edge, touch, touch]))
            s, e = edge[::2], edge[1::2]
            sd = np.searchsorted(w.first, s, "right") - 1
            spans = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(sd, np.arange(to - at + 1)).astype(np.int32)),
                pa.StructArray.from_arrays([pa.array((s - w.first[sd]).astype(np.int32)), pa.array((e - w.first[sd]).astype(np.int32))], ["start", "end"]),
            )
            removed = np.bincount(np.searchsorted(w.first, np.flatnonzero(gone), "right") - 1, minlength=to - at)
            yield pa.RecordBatch.from_arrays([b.column(0)[at:to], b.column(1)[at:to], pa.array(w.n_words), pa.array(removed), spans, lists[at:to], kept_text], _RESULT.names)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, keep_key: bool = False, hot: int = HOT) -> DataFrame:
    """One row a document: id (long), n_words, n_removed, spans, factors, kept.

    Removes each word covered by a window of ``window`` words (unchanged, split
    at ASCII white space) that also starts in a document with a smaller id;
    ``spans`` are the removed word ranges, ``factors`` the copied ranges of the
    parse with the document and word that each was found at (they may overlap),
    ``kept`` the other words joined by one space. Windows are judged on the input.
    Rows of equal id never remove from each other, whether their texts agree or
    not; rows without id neither lose words nor remove any; null and empty texts
    keep nothing. Ids are integers. ``keep_key`` adds ``key``, xxhash64 of the
    text, to tell rows of one id apart.
    """
    spark = docs.sparkSession
    n = n_parts(spark)
    n_blocks, n_parse = blocks_by_size(docs, INDEX_BYTES), blocks_by_size(docs, PARSE_BYTES)
    ident = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NO_ID))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    base = need(docs, id_col, text_col).select(ident.alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))

    def dealt(blobs: DataFrame) -> DataFrame:
        return blobs.repartition(n, "block").sortWithinPartitions("block")

    def parsed(blobs: DataFrame, look_up) -> DataFrame:
        answers = dealt(blobs).mapInArrow(lambda it: _answers(it, n_parse, look_up), _BLOB)
        return dealt(answers).mapInArrow(lambda it: _parsed(it, window), _PARSED)

    found = saved(parsed(base.mapInArrow(lambda it: _index(it, window, gram, n_blocks, n_parse, hot), _BLOB), _look_up), "dedup-factors")
    unsure = base.join(found.where(F.size("checks") > 0).select("id", "key", "checks"), ["id", "key"]).select("id", "key", "text", "checks")
    borders = parsed(unsure.mapInArrow(lambda it: _windows(it, window, n_blocks, n_parse), _BLOB), _look_up_windows)
    factors = F.array_sort(F.concat(*[F.coalesce(F.col(c), F.array().cast(_FACTORS)) for c in ("factors", "_more")]))
    more = borders.select("id", "key", F.col("factors").alias("_more"))
    cut = base.join(found.select("id", "key", "factors"), ["id", "key"], "left").join(more, ["id", "key"], "left")
    cut = cut.select("id", "key", "text", factors.alias("factors")).mapInArrow(_cut, _RESULT)
    cut = cut if keep_key else cut.drop("key")
    return cut.withColumn("id", F.when(F.col("id") > _NO_ID, F.col("id"))).withColumnRenamed("id", id_col)
