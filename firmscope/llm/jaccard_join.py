"""N-gram Jaccard join with adaptive multi-match prefixes.

Every document is the set of its word shingles in one global order: frequent
shingles last, by frequency, the others by hash. If two sets have a similarity
of at least t, then for any l they share l shingles within their first
``n - ceil(t n) + l`` ones. Each document picks its own l: a longer prefix costs
more index entries but demands more shared shingles, so l grows with the
estimated number of candidates that the prefix would bring. A pair must share
the smaller of its two l before it is verified on the texts.

Equal sets are one class from the start. Classes are joined in two passes, so
that a large group of near copies never becomes all its pairs:

1. in each index list everything is paired with one hub; verified pairs are
   joined to components;
2. exactly the pairs of different components that pass all filters are counted,
   verified and joined.

The result is the same as if every pair had been compared: pairs left out lie
in one component already or cannot reach the threshold.

The list of a shingle that very many sets have in their prefixes is never one
task's: its hub is found by a minimum and sent to all its members; in the second
pass it is left out if it lies in one component, and else cut into slices whose
pairs are compared by a task each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmscope.llm import textkernel as tk
from firmscope.llm.components import connected_components
from firmscope.llm.shared import n_parts, need, row_key, saved

SHINGLE = 5
#: Similarity as a fraction: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Frequent shingles that are broadcast at most (12 bytes each), and the least frequency that counts.
MAX_FREQUENT = 1 << 17
MIN_FREQUENT = 16
#: Prefix lengths on offer, as shared shingles demanded.
LEVELS = (1, 2, 4, 8)
#: Cost of verifying a candidate, in index entries read.
VERIFY_COST = 64

#: Entries from which on a list is split, and the most such lists whose hubs are
#: broadcast (64 bytes each); the least length is raised until they fit.
LONG_LIST, MAX_LONG = 1 << 14, 1 << 16

_HASH_BITS = 52
_HASH = np.uint64((1 << _HASH_BITS) - 1)
_BLOCKS = 4

_DOC = T.StructType([T.StructField(c, t) for c, t in (("row", T.LongType()), ("key", T.LongType()), ("n", T.LongType()), ("node", T.LongType()), ("token", T.LongType()), ("seen", T.LongType()))])
_BLOB = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("nodes", T.BinaryType()), T.StructField("entries", T.BinaryType())])
_ENTRY = np.dtype([("token", "<u8"), ("node", "<u4"), ("at", "<u4")])
_NODE = np.dtype([("node", "<i8"), ("end", "<i8"), ("n", "<i4"), ("level", "<i4")])
_SHARED = T.StructType([T.StructField("token", T.LongType()), T.StructField("node", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("level", T.IntegerType()), T.StructField("at", T.IntegerType()), T.StructField("end", T.LongType())])


def needed(n, percent: int):
    """Shingles that a set of n must share with any set similar to it."""
    return -(-percent * n // 100)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of the distinct shingles, by document and hash."""
    w = tk.words(data, offsets, tk.LOWER)
    h, n = w.hashes(), w.n_words
    at = tk.gram_starts(w.first, k)
    g, doc = tk.grams(h, k)[at] if len(at) else np.zeros(0, np.uint64), np.searchsorted(w.first, at, "right") - 1
    for m in range(1, k):
        few = np.flatnonzero(n == m)
        if len(few):
            g, doc = np.concatenate([g, tk.grams(h, m)[w.first[few]]]), np.concatenate([doc, few])
    key = np.sort((doc.astype(np.uint64) << np.uint64(_HASH_BITS)) | (g >> np.uint64(64 - _HASH_BITS)))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return key & _HASH, (key >> np.uint64(_HASH_BITS)).astype(np.int64)


def _chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Chunks of fewer documents than the bits beside the hash can number."""
    most = 1 << (64 - _HASH_BITS)
    for at in range(0, len(column), most):
        for a, b, data, offsets in tk.chunks(column[at : at + most]):
            yield at + a, at + b, data, offsets


def _nodes(token: np.ndarray, doc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One number a document for its set of shingles; 0 for an empty set."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tk.mix(token + np.uint64(1)))])
    edge = np.searchsorted(doc, np.arange(len(n) + 1))
    node = tk.mix(total[edge[1:]] - total[edge[:-1]] + n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.where(n > 0, node, 0).view(np.int64)


def _survey(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(row, key, n, node) of every document, and the shingles that several sets of the batch share."""
    for b in batches:
        seen: set[int] = set()
        tokens, ns, nodes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at, to, data, offsets in _chunks(b.column(2)):
            token, doc = shingle_sets(data, offsets, k)
            n = np.bincount(doc, minlength=to - at)
            node = _nodes(token, doc, n)
            fresh = _fresh(node, seen)
            tokens.append(token[fresh[doc]])
            ns.append(n)
            nodes.append(node)
        t = np.sort(np.concatenate(tokens))
        edge = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, np.int64)
        count = np.diff(np.concatenate([edge, [len(t)]]))
        many = count >= 3
        none = lambda size: pa.nulls(size, pa.int64())
        m, d = int(many.sum()), len(b)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.concatenate(ns)), pa.array(np.concatenate(nodes)), none(d), none(d)], _DOC.names)
        yield pa.RecordBatch.from_arrays([none(m), none(m), none(m), none(m), pa.array(t[edge][many].astype(np.int64)), pa.array(count[many])], _DOC.names)


def _texts(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """(node, text) of the different sets of a batch that aren't empty."""
    for b in batches:
        nodes = [np.zeros(0, np.int64)]
        for at, to, data, offsets in _chunks(b.column(0)):
            token, doc = shingle_sets(data, offsets, k)
            nodes.append(_nodes(token, doc, np.bincount(doc, minlength=to - at)))
        node = np.concatenate(nodes)
        first = np.unique(node, return_index=True)[1]
        first = first[node[first] != 0]
        yield pa.RecordBatch.from_arrays([pa.array(node[first]), b.column(0).take(pa.array(first))], _TEXT.names)


_TEXT = T.StructType([T.StructField("node", T.LongType()), T.StructField("text", T.StringType())])


def _fresh(node: np.ndarray, seen: set[int]) -> np.ndarray:
    """True for the first document of each set in the batch; empty sets never."""
    out = np.zeros(len(node), bool)
    _, first = np.unique(node, return_index=True)
    for i in first:
        x = int(node[i])
        if x and x not in seen:
            seen.add(x)
            out[i] = True
    return out


def frequent_tokens(seen: DataFrame, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, frequency) of at most ``bound`` shingles: the frequency from
    which on they count is raised until they fit. Any choice gives right results."""
    counts = seen.groupBy("token").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= MIN_FREQUENT)
    counts = saved(counts, "frequent")
    sizes = sorted(counts.groupBy(F.floor(4 * F.log2("seen")).alias("step")).count().collect(), key=lambda r: -r["step"])
    least, total = None, 0
    for r in sizes:
        total += r["count"]
        if total > bound:
            break
        least = r["step"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    t = counts.where(F.floor(4 * F.log2("seen")) >= least).toArrow()
    order = np.argsort(t["token"].to_numpy())
    return t["token"].to_numpy()[order].astype(np.uint64), t["seen"].to_numpy()[order]


class Order:
    """The global order of shingles and each document's prefix in it."""

    def __init__(self, token: np.ndarray, frequency: np.ndarray, percent: int):
        self.token, self.frequency, self.percent = token, frequency, percent
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[token >> np.uint64(_HASH_BITS - 20)] = True

    def weights(self, token: np.ndarray) -> np.ndarray:
        out = np.zeros(len(token), np.int64)
        if len(self.token):
            some = np.flatnonzero(self.maybe[token >> np.uint64(_HASH_BITS - 20)])
            i = np.minimum(np.searchsorted(self.token, token[some]), len(self.token) - 1)
            out[some] = np.where(self.token[i] == token[some], self.frequency[i], 0)
        return out

    def prefixes(self, token: np.ndarray, doc: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(token, document, position) of the prefix entries, each document's level, and
        where in the global order its prefix ends (frequency, then the hash's high bits)."""
        weight = self.weights(token)
        order = np.lexsort((weight, doc)) if weight.any() else np.arange(len(token))
        token, weight = token[order], weight[order]
        start = np.cumsum(n) - n
        at = np.arange(len(token)) - np.repeat(start, n)
        least = needed(n, self.percent)
        doc_of = np.repeat(np.arange(len(n)), n)
        some = np.flatnonzero(weight)
        heavy, owner, place = weight[some], doc_of[some], at[some]
        family = owner * 64 + np.log2(heavy).astype(np.int64)
        level, cost = np.ones(len(n), np.int64), np.full(len(n), np.inf)
        for x in LEVELS:
            reach = np.minimum(n - least + x, n)
            inside = place < reach[owner]
            read = np.bincount(owner[inside], heavy[inside], len(n))
            # Lists of about one length are taken for those of one group of copies:
            # whoever is in one is in all, and is a candidate if there are x of them.
            groups, first, times = np.unique(family[inside], return_index=True, return_counts=True)
            met = times >= x
            candidates = np.bincount(groups[met] // 64, heavy[inside][first[met]], len(n))
            now = np.where(x <= np.maximum(least, 1), read + VERIFY_COST * candidates, np.inf)
            level, cost = np.where(now < cost, x, level), np.minimum(now, cost)
        reach = np.minimum(n - least + level, n)
        last = start + reach - 1
        end = np.minimum(weight[last], (1 << 31) - 1) << 32 | (token[last] >> np.uint64(_HASH_BITS - 32)).astype(np.int64)
        keep = at < np.repeat(reach, n)
        return token[keep], doc[keep], at[keep], level, end


def _prefix_blobs(batches: Iterator[pa.RecordBatch], k: int, order: Order, n_blocks: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        seen: set[int] = set()
        entries, nodes, base = [np.zeros(0, _ENTRY)], [np.zeros(0, _NODE)], 0
        for at, to, data, offsets in _chunks(b.column(0)):
            token, doc = shingle_sets(data, offsets, k)
            n = np.bincount(doc, minlength=to - at)
            node = _nodes(token, doc, n)
            fresh = _fresh(node, seen)
            token, doc = token[fresh[doc]], (np.cumsum(fresh) - 1)[doc[fresh[doc]]]
            token, doc, pos, level, end = order.prefixes(token, doc, n[fresh])
            e, v = np.zeros(len(token), _ENTRY), np.zeros(int(fresh.sum()), _NODE)
            e["token"], e["node"], e["at"] = token, doc + base, pos
            v["node"], v["end"], v["n"], v["level"] = node[fresh], end, n[fresh], level
            entries.append(e)
            nodes.append(v)
            base += len(v)
        e, v = np.concatenate(entries), np.concatenate(nodes)
        block = tk.bucket(e["token"] << np.uint64(64 - _HASH_BITS), n_blocks)
        by = np.argsort(block, kind="stable")
        edges = np.searchsorted(block[by], np.arange(n_blocks + 1))
        out = []
        for x in range(n_blocks):
            mine = e[by[edges[x] : edges[x + 1]]]
            if len(mine):
                used, mine["node"] = np.unique(mine["node"], return_inverse=True)
                out.append((x, v[used].tobytes(), mine.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], _BLOB.names)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries whose shingle is in the prefixes of two sets at least. Blobs come sorted by block."""
    block, parts = None, []

    def done() -> pa.RecordBatch:
        token = np.concatenate([e["token"] for _, e in parts])
        at = np.concatenate([e["at"] for _, e in parts]).astype(np.int32)
        v = np.concatenate([v[e["node"]] for v, e in parts])
        order = np.lexsort((v["node"], token))
        token, at, v = token[order], at[order], v[order]
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (v["node"][1:] != v["node"][:-1])])
        token, at, v = token[new], at[new], v[new]
        same = token[1:] == token[:-1]
        keep = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        token, at, v = token[keep], at[keep], v[keep]
        return pa.RecordBatch.from_arrays([pa.array(token.astype(np.int64)), pa.array(v["node"].copy()), pa.array(v["n"].copy()), pa.array(v["level"].copy()), pa.array(at), pa.array(v["end"].copy())], _SHARED.names)

    for batch in batches:
        for x, v, e in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            if x != block and parts:
                yield done()
                parts = []
            block = x
            parts.append((np.frombuffer(v.as_buffer(), _NODE), np.frombuffer(e.as_buffer(), _ENTRY)))
    if parts:
        yield done()


_COLUMNS = ("token", "cell", "node", "n", "level", "at", "end", "live", "root", "slice")


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The index list of one shingle (or the part of it in one cell) after the other,
    from rows sorted by shingle and cell."""
    left = None
    for b in batches:
        if not len(b):
            continue
        t = {c: b.column(i).to_numpy() for i, c in enumerate(_COLUMNS)}
        if left:
            t = {c: np.concatenate([left[c], t[c]]) for c in _COLUMNS}
        new = (t["token"][1:] != t["token"][:-1]) | (t["cell"][1:] != t["cell"][:-1])
        edge = np.concatenate([[0], np.flatnonzero(new) + 1, [len(t["token"])]])
        for x, y in zip(edge[:-2], edge[1:-1], strict=True):
            if y - x > 1:
                yield {c: v[x:y] for c, v in t.items()}
        left = {c: v[edge[-2] :] for c, v in t.items()}
    if left and len(left["token"]) > 1:
        yield left


def _can_link(t: dict[str, np.ndarray], i, j, percent: int, demand):
    """False for pairs that cannot reach the threshold: sizes too far apart, or too few
    shingles that can be shared. Of two sets that whose prefix ends first in the global
    order has all shared shingles of its prefix in the other's prefix too, so it shares
    ``live`` at most: those, and what lies behind its prefix. (The other one may have
    shared shingles in its prefix that the first has behind its own.) Nor does a list
    count towards the ``demand`` shared shingles where it lies behind the prefixes that
    this very pair of sizes needs, which are shorter than those of the sets alone."""
    n, at, live, end = t["n"], t["at"], t["live"], t["end"]
    both = n[i].astype(np.int64) + n[j]
    most = np.where(end[i] < end[j], live[i], np.where(end[j] < end[i], live[j], np.maximum(live[i], live[j])))
    most = np.minimum(most, np.minimum(n[i] - at[i], n[j] - at[j]) + demand - 1)
    return (100 + percent) * most >= percent * both


def _hub_pairs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Each member of a list with the list's hub, the member that keeps most of its
    shingles to others: among copies of one text, the least changed one."""
    found: list[np.ndarray] = []
    size = 0
    for t in _lists(batches):
        hub = np.full(len(t["node"]) - 1, np.lexsort((t["node"], -t["live"] / t["n"]))[0])
        rest = np.delete(np.arange(len(t["node"])), hub[0])
        ok = _can_link(t, hub, rest, percent, 1)
        found.append(np.stack([t["node"][hub[ok]], t["node"][rest[ok]]], 1))
        size += len(found[-1])
        if size > 1 << 18:
            yield _pairs(found)
            found, size = [], 0
    yield _pairs(found)


def _long_hubs(entries: DataFrame, percent: int) -> DataFrame:
    """What ``_hub_pairs`` gives, for long lists: the hub is a minimum over the list,
    and travels to the members, of which no task holds more than its share."""
    best = F.min(F.struct((-F.col("live") / F.col("n")).alias("rank"), "node", "n", "live", "at", "end")).alias("hub")
    met = entries.join(F.broadcast(entries.groupBy("token").agg(best)), "token")
    h = F.col("hub")
    most = F.when(h["end"] < F.col("end"), h["live"]).when(F.col("end") < h["end"], F.col("live")).otherwise(F.greatest(h["live"], F.col("live")))
    most = F.least(most, h["n"] - h["at"], F.col("n") - F.col("at"))
    can = F.lit(100 + percent) * most >= F.lit(percent) * (h["n"] + F.col("n"))
    return met.where((h["node"] != F.col("node")) & can).select(h["node"].alias("a"), F.col("node").alias("b"))


_NEIGHBOURS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.IntegerType())), T.StructField("demand", T.ArrayType(T.IntegerType()))])


def _cross_pairs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Partners in other components, one row for each node and task, with the number of
    lists that the two met in and the number they have to meet in."""
    found = [np.zeros((0, 4), np.int64)]
    size = 0
    for t in _lists(batches):
        root = t["root"]
        if (root == root[0]).all():
            continue
        order = np.lexsort((t["node"], t["n"]))
        t = {c: v[order] for c, v in t.items()}
        n = t["n"]
        # Partners in size order end where they get too large for the smaller set.
        until = np.searchsorted(n, n.astype(np.int64) * 100 // percent, "right")
        count = np.maximum(until - np.arange(len(n)) - 1, 0)
        total = np.concatenate([[0], np.cumsum(count)])
        at = 0
        while at < len(n):
            to = min(max(int(np.searchsorted(total, total[at] + (1 << 20), "right")) - 1, at + 1), len(n))
            i = np.repeat(np.arange(at, to), count[at:to])
            j = tk.ranges(np.arange(at, to) + 1, count[at:to])
            demand = np.minimum(t["level"][i], t["level"][j])
            ok = (t["root"][i] != t["root"][j]) & _can_link(t, i, j, percent, demand)
            if t["slice"][0] >= 0:
                # A cell of two slices of a long list: only pairs between them.
                ok &= t["slice"][i] != t["slice"][j]
            x, y = t["node"][i[ok]], t["node"][j[ok]]
            found.append(np.stack([np.minimum(x, y), np.maximum(x, y), np.ones(len(x), np.int64), demand[ok]], 1))
            size += len(x)
            at = to
            if size > 1 << 20:
                met = _met(found)
                found, size = [met], len(met)
                if size > 1 << 19:
                    yield _neighbours(met)
                    found, size = [np.zeros((0, 4), np.int64)], 0
    yield _neighbours(_met(found))


def _met(parts: list[np.ndarray]) -> np.ndarray:
    """Rows (a, b, times, demand) by pair, with the times added up."""
    p = np.concatenate(parts)
    p = p[np.lexsort((p[:, 1], p[:, 0]))]
    new = np.flatnonzero(np.concatenate([[True], (p[1:, :2] != p[:-1, :2]).any(1)])) if len(p) else np.zeros(0, np.int64)
    out = p[new]
    if len(p):
        out[:, 2] = np.add.reduceat(p[:, 2], new)
    return out


def _neighbours(p: np.ndarray) -> pa.RecordBatch:
    new = np.flatnonzero(np.concatenate([[True], p[1:, 0] != p[:-1, 0]])) if len(p) else np.zeros(0, np.int64)
    offsets = pa.array(np.concatenate([new, [len(p)]]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(p[:, k], kind)) for k, kind in ((1, pa.int64()), (2, pa.int32()), (3, pa.int32()))]
    return pa.RecordBatch.from_arrays([pa.array(p[new, 0]), *lists], _NEIGHBOURS.names)


def _enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) that met in as many lists as they have to, from neighbour rows
    sorted by node."""
    held: list[np.ndarray] = []

    def done(p: np.ndarray) -> pa.RecordBatch:
        p = p[p[:, 2] >= p[:, 3]]
        return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], _LINK.names)

    for b in batches:
        n = np.diff(b.column(1).offsets.to_numpy())
        held.append(np.stack([np.repeat(b.column(0).to_numpy(), n), *[b.column(k).flatten().to_numpy().astype(np.int64) for k in (1, 2, 3)]], 1))
        if sum(map(len, held)) > 1 << 20:
            met = _met(held)
            open_ = met[:, 0] == met[-1, 0]
            yield done(met[~open_])
            held = [met[open_]]
    if held:
        yield done(_met(held))


def _pairs(found: list[np.ndarray]) -> pa.RecordBatch:
    p = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *found]), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], _LINK.names)


_LINK = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _verify(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, text_a, text_b) those that are similar enough, by the whole sets."""
    for b in batches:
        for at in range(0, len(b), 512):
            some = b.slice(at, 512)
            sets = []
            for column in (2, 3):
                parts = [(x, d + a) for a, _, data, offsets in _chunks(some.column(column)) for x, d in [shingle_sets(data, offsets, k)]]
                sets.append((np.concatenate([np.zeros(0, np.uint64), *[p[0] for p in parts]]), np.concatenate([np.zeros(0, np.int64), *[p[1] for p in parts]])))
            (ta, da), (tb, db) = sets
            key = np.sort(np.concatenate([(da.astype(np.uint64) << np.uint64(_HASH_BITS)) | ta, (db.astype(np.uint64) << np.uint64(_HASH_BITS)) | tb]))
            common = np.bincount((key[1:][key[1:] == key[:-1]] >> np.uint64(_HASH_BITS)).astype(np.int64), minlength=len(some))
            union = np.bincount(da, minlength=len(some)) + np.bincount(db, minlength=len(some)) - common
            ok = pa.array((100 * common >= percent * union) & (union > 0))
            yield pa.RecordBatch.from_arrays([some.column(0).filter(ok), some.column(1).filter(ok)], _LINK.names)


def similarity_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = PERCENT, long_list: int = LONG_LIST) -> DataFrame:
    """One row a document: id, n_shingles, node, component_id, size, root, key.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text after lower-casing A-Z;
    the set holds the distinct shingles of k words, or the whole sequence where
    there are fewer. Documents link where 100 * intersection >= percent * union;
    ``component_id`` is the smallest id reachable by links, ``size`` the number of
    rows in the component, ``node`` the class of equal sets, ``root`` the component's
    smallest node (both null if empty), ``key`` the hash of id and text. A document without words or text links with nothing and is its own component.
    Repeated rows are classes like any others; rows without id link by text, and
    a component of such rows alone has no id. Ids are integers. ``long_list`` decides
    which lists are split, not what is found.
    """
    spark = docs.sparkSession
    base = need(docs, id_col, text_col).select(F.col(f"`{id_col}`").cast("long").alias("row"), row_key(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("key"), F.col(f"`{text_col}`").alias("text"))
    survey = saved(base.mapInArrow(lambda it: _survey(it, k), _DOC), "jaccard-survey")
    rows = survey.where(F.col("node").isNotNull()).select("row", "key", "n", "node")
    order = Order(*frequent_tokens(survey.where(F.col("token").isNotNull()), MAX_FREQUENT), percent)
    sent = spark.sparkContext.broadcast(order)
    n_blocks = _BLOCKS * n_parts(spark)
    blobs = base.select("text").mapInArrow(lambda it: _prefix_blobs(it, k, sent.value, n_blocks), _BLOB)
    shared = saved(blobs.repartition(n_parts(spark), "block").sortWithinPartitions("block").mapInArrow(_shared, _SHARED), "jaccard-index")

    # What a set can share with sets whose prefixes end behind its own: the shared part
    # of its prefix, and all that follows.
    reach = F.least(F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + F.col("level"), F.col("n"))
    live = shared.groupBy("node").agg(F.count("*").alias("hits"), F.first("n").alias("n"), F.first("level").alias("level"))
    live = live.select("node", (F.col("n") - reach + F.col("hits")).cast("int").alias("live"))
    index = saved(shared.join(live, "node").select("token", "node", "n", "level", "at", "end", "live"), "jaccard-live")
    # One text for each set that is still in, whoever holds it.
    held = base.select("text").mapInArrow(lambda it: _texts(it, k), _TEXT)
    texts = saved(held.join(live.select("node"), "node", "left_semi").dropDuplicates(["node"]), "jaccard-texts")

    def verified(pairs: DataFrame) -> DataFrame:
        with_a = pairs.select("a", "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        with_b = with_a.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        return with_b.select("a", "b", "text_a", "text_b").mapInArrow(lambda it: _verify(it, k, percent), _LINK)

    def lists(entries: DataFrame) -> DataFrame:
        return entries.select(*_COLUMNS).repartition(n_parts(spark), "token", "cell").sortWithinPartitions("token", "cell")

    lengths = saved(index.groupBy("token").count().where(F.col("count") >= long_list), "jaccard-long")
    least = long_list
    while lengths.where(F.col("count") >= least).count() > MAX_LONG:
        least *= 2
    long = F.broadcast(lengths.where(F.col("count") >= least))
    short = index.join(long, "token", "left_anti")
    one = short.withColumn("root", F.col("node")).withColumn("cell", F.lit(0)).withColumn("slice", F.lit(-1))
    hubs = lists(one).mapInArrow(lambda it: _hub_pairs(it, percent), _LINK)
    links = saved(verified(hubs.unionByName(_long_hubs(index.join(long, "token"), percent)).distinct()), "jaccard-links")
    roots = connected_components(links)
    rooted = saved(index.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "jaccard-rooted")
    open_ = rooted.join(long, "token").groupBy("token").agg(F.max("count").alias("count")).where(F.min("root") != F.max("root")).select("token", "count")
    cells = F.ceil(F.col("count") / F.lit(float(long_list))).cast("int")
    split = rooted.join(F.broadcast(open_), "token").withColumn("_n", cells).withColumn("_s", F.pmod(F.xxhash64("node"), F.col("_n")).cast("int"))
    split = split.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    low, high = F.least("_s", "_o"), F.greatest("_s", "_o")
    split = split.withColumn("cell", low * F.col("_n") + high).withColumn("slice", F.when(low == high, F.lit(-1)).otherwise(F.col("_s")))
    plain = rooted.join(long, "token", "left_anti").withColumn("cell", F.lit(0)).withColumn("slice", F.lit(-1))
    cross = lists(plain.select(*_COLUMNS).unionByName(split.select(*_COLUMNS))).mapInArrow(lambda it: _cross_pairs(it, percent), _NEIGHBOURS)
    cross = cross.repartition(n_parts(spark), "a").sortWithinPartitions("a").mapInArrow(_enough, _LINK)
    roots = connected_components(links.unionByName(verified(cross)))

    classes = rows.where(F.col("node") != 0).groupBy("node").agg(F.min("row").alias("row"), F.count("*").alias("size"))
    classes = classes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    whole = classes.groupBy("root").agg(F.min("row").alias("component_id"), F.sum("size").alias("size"))
    named = classes.select("node", "root").join(whole, "root").select("node", "root", "component_id", "size")
    found = rows.where("node <> 0").join(named, "node")
    none = F.lit(None).cast("long")
    empty = rows.where("node = 0").select(none.alias("node"), "row", "key", "n", none.alias("root"), F.col("row").alias("component_id"), F.lit(1).cast("long").alias("size"))
    out = found.unionByName(empty)
    return out.select(F.col("row").alias(id_col), F.col("n").alias("n_shingles"), "node", "component_id", F.col("size").cast("long").alias("size"), "root", "key")
