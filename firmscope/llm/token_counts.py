"""Exact token counts of a byte-level BPE by a map-side two-tier lookup.

Texts are cut into pre-tokens on their bytes, in array passes, with the character
classes that the library itself has. Tier one is a broadcast hash table of the
lengths of frequent pre-tokens: those of a drawn part of the documents, and the
vocabulary's own entries. Tier two is a table in each worker for everything else:
a pre-token not seen before is encoded by the library, once a worker. Both are
open-addressing tables of 9 bytes a slot. Nothing is shuffled.

Pre-tokens are told apart by 64-bit hashes.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmscope.llm import textkernel as tk
from firmscope.llm.shared import need

#: Documents that frequent pre-tokens are drawn from, on average, and how many are
#: listed. Both decide only which table answers, not what is answered.
SAMPLE_DOCS, FREQUENT = 2000, 1 << 15
#: Pre-tokens that a worker's table may hold before it starts anew.
CACHE_SIZE = 1 << 20
#: Pre-tokens that the library encodes in one call.
_CALL = 4096

# fixed value: the pre-token pattern of byte-level BPE vocabularies
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

LETTER, NUMBER, SPACE, OTHER, SPECIAL = 1, 2, 3, 4, 5
#: Code points beyond this one are neither letters, numbers nor white space.
_PLANES = 0x40000


def character_classes() -> np.ndarray:
    """Class of each code point, as the library's own patterns see it."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    points = [c for c in range(_PLANES) if not 0xD800 <= c < 0xE000]
    text, known = "".join(map(chr, points)), np.array(points)
    out = np.full(_PLANES + 1, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", SPACE)):
        of_kind = np.ones(len(known), bool)
        for _, (start, end) in Split(Regex(pattern), "removed").pre_tokenize_str(text):
            of_kind[start:end] = False
        out[known[of_kind]] = kind
    return out


def byte_classes(data: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Class of the character that each byte of UTF-8 text belongs to."""
    out = classes[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        size = 2 + (data[lead] >= 0xE0).astype(np.int64) + (data[lead] >= 0xF0)
        point = (data[lead] & (0x7F >> size).astype(np.uint8)).astype(np.int64)
        for k in (1, 2, 3):
            more = size > k
            point[more] = point[more] << 6 | (data[lead[more] + k] & 0x3F)
        kind = classes[np.minimum(point, _PLANES)]
        out[lead] = kind
        for k in (1, 2, 3):
            more = size > k
            out[lead[more] + k] = kind[more]
    return out


def pre_tokens(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray, special: re.Pattern | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, True for special strings): what ``PATTERN`` cuts texts into.

    A piece is a run of one class. Of white space before something else the last
    character stands alone, or goes with what follows if it is a blank. An
    apostrophe alone takes a contraction's letters from the run behind it.
    """
    n = len(data)
    kind = byte_classes(data, classes)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    if special is not None:
        for m in special.finditer(data.tobytes()):
            if not cut[m.start() + 1 : m.end()].any():
                kind[m.start() : m.end()] = SPECIAL
                cut[[m.start(), m.end()]] = True
    edge = cut.copy()  # borders of texts and special strings
    cut[1:n] |= kind[1:] != kind[:-1]
    continued = (data & 0xC0) == 0x80
    # White space: its last character is cut off where something else follows.
    follows = np.flatnonzero(cut[1:n] & ~edge[1:n] & (kind[:-1] == SPACE)) + 1
    last = follows - 1
    while (back := continued[last]).any():
        last[back] -= 1
    cut[last] = True
    blank = data[last] == 0x20
    cut[follows[blank]] = False
    # Contractions: an apostrophe that starts its piece, and letters right behind it.
    quote = np.flatnonzero((data == 0x27) & cut[:n] & (kind == OTHER))
    quote = quote[(quote + 1 < n)]
    quote = quote[cut[quote + 1] & ~edge[quote + 1] & (kind[quote + 1] == LETTER)]
    if len(quote):
        padded = np.concatenate([data, np.zeros(2, np.uint8)])
        one, two = padded[quote + 1], padded[quote + 2]
        two = np.where(edge[np.minimum(quote + 2, n)], 0, two)
        single = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        size = np.where(single, 1, np.where(double, 2, 0))
        some = size > 0
        cut[quote[some] + 1] = False
        cut[quote[some] + 1 + size[some]] = True
    at = np.flatnonzero(cut)
    starts, ends = at[:-1], at[1:]
    return starts, ends, kind[starts] == SPECIAL


@dataclass
class Lengths:
    """Hash table from pre-tokens to their numbers of tokens: open addressing, by
    the hash's high bits, at most half full. Lengths over 254 are kept in ``long``."""

    bits: int = 12
    n: int = 0
    key: np.ndarray = field(default=None)
    size: np.ndarray = field(default=None)
    long: dict[int, int] = field(default_factory=dict)

    def __post_init__(self):
        if self.key is None:
            self.key, self.size = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.uint8)

    def get(self, h: np.ndarray) -> np.ndarray:
        """Length of each pre-token; 0 for those that aren't in the table."""
        out = np.zeros(len(h), np.int64)
        open_, slot = np.arange(len(h)), (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(open_):
            held = self.size[slot]
            same = (held > 0) & (self.key[slot] == h[open_])
            out[open_[same]] = held[same]
            on = (held > 0) & ~same
            open_, slot = open_[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        for i in np.flatnonzero(out == 255) if self.long else ():
            out[i] = self.long[int(h[i])]
        return out

    def put(self, h: np.ndarray, size: np.ndarray) -> None:
        """Add distinct pre-tokens that aren't in the table."""
        if 2 * (self.n + len(h)) > 1 << self.bits:
            used = np.flatnonzero(self.size)
            old = self.key[used], self.size[used]
            self.bits = max(self.bits + 1, int(4 * (self.n + len(h))).bit_length())
            self.key, self.size = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.uint8)
            self._place(*old)
        self.long.update((int(x), int(s)) for x, s in zip(h[size > 254], size[size > 254], strict=True))
        self._place(h, np.minimum(size, 255).astype(np.uint8))
        self.n += len(h)

    def _place(self, h: np.ndarray, size: np.ndarray) -> None:
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(h):
            free = self.size[slot] == 0
            self.key[slot[free]] = h[free]
            mine = free & (self.key[slot] == h)
            self.size[slot[mine]] = size[mine]
            h, size, slot = h[~mine], size[~mine], (slot[~mine] + 1) & ((1 << self.bits) - 1)


class Counter:
    """A worker's tokenizer with its own table of lengths, one for each file."""

    _of: dict[str, Counter] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        added = list(self.library.get_added_tokens_decoder().values())
        form = json.loads(self.library.to_str())
        pre = form.get("pre_tokenizer") or {}
        #: Texts are cut up only if that is all the file asks for; others go to the library whole.
        self.cuts = form.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.cuts &= not any(x.lstrip or x.rstrip or x.single_word for x in added) and not self.library.encode_special_tokens
        names = sorted((x.content for x in added if x.content), key=len, reverse=True)
        self.special = re.compile(b"|".join(re.escape(x.encode()) for x in names)) if names else None
        self.names, self.known = set(names), Lengths()

    @staticmethod
    def of(path: str) -> Counter:
        if path not in Counter._of:
            Counter._of[path] = Counter(path)
        return Counter._of[path]

    def encoded(self, texts: list[str]) -> np.ndarray:
        """Lengths of whole texts, by the library."""
        out = np.zeros(len(texts), np.int64)
        for at in range(0, len(texts), _CALL):
            out[at : at + _CALL] = [len(e) for e in self.library.encode_batch_fast(texts[at : at + _CALL], add_special_tokens=False)]
        return out

    def pieces(self, data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[tk.Words, np.ndarray, np.ndarray]:
        """(pre-tokens, their hashes, special strings in each text) of a chunk of texts."""
        starts, ends, special = pre_tokens(data, offsets, classes, self.special)
        text = np.searchsorted(offsets, starts, "right") - 1
        keep = ~special
        w = tk.Words(data, data, offsets, starts[keep], ends[keep], np.searchsorted(starts[keep], offsets))
        return w, w.hashes(), np.bincount(text[special], minlength=len(offsets) - 1)

    def encode_pieces(self, w: tk.Words, at: np.ndarray) -> np.ndarray:
        raw = w.data.tobytes()
        return self.encoded([raw[s:e].decode() for s, e in zip(w.starts[at].tolist(), w.ends[at].tolist(), strict=True)])

    def counts(self, data: np.ndarray, offsets: np.ndarray, classes: np.ndarray, frequent: Lengths) -> np.ndarray:
        """Number of tokens of each text of a chunk."""
        if not self.cuts:
            raw = data.tobytes()
            return self.encoded([raw[s:e].decode() for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
        w, h, out = self.pieces(data, offsets, classes)
        size = frequent.get(h)
        missed = np.flatnonzero(size == 0)
        size[missed] = self.known.get(h[missed])
        new = missed[size[missed] == 0]
        if len(new):
            unique, where, inverse = np.unique(h[new], return_index=True, return_inverse=True)
            found = self.encode_pieces(w, new[where])
            size[new] = found[inverse]
            if self.known.n + len(unique) > CACHE_SIZE:
                self.known = Lengths()
            if len(unique) <= CACHE_SIZE:
                self.known.put(unique, found)
        total = np.concatenate([[0], np.cumsum(size)])
        return out + total[w.first[1:]] - total[w.first[:-1]]


def frequent_lengths(path: str, drawn: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = (), classes: np.ndarray | None = None) -> Lengths:
    """The first tier: the pre-tokens (hash, times, length) that were seen most often,
    and the vocabulary's entries that are one pre-token."""
    c, out = Counter.of(path), Lengths()
    if not c.cuts:
        return out
    if drawn:
        h, inverse = np.unique(np.concatenate([d[0] for d in drawn]), return_inverse=True)
        times, size = np.bincount(inverse, np.concatenate([d[1] for d in drawn])), np.zeros(len(h), np.int64)
        size[inverse] = np.concatenate([d[2] for d in drawn])
        often = np.argsort(-times, kind="stable")[:FREQUENT]
        out.put(h[often], size[often])
    entry = regex.compile(PATTERN)
    texts = [c.library.decode([i], skip_special_tokens=False) for i in range(c.library.get_vocab_size())]
    texts = [x for x in dict.fromkeys(texts) if x and "�" not in x and x not in c.names and entry.fullmatch(x)]
    packed = pa.array(texts, pa.large_string())
    w, h, _ = c.pieces(*tk.buffers(packed), character_classes() if classes is None else classes)
    whole = np.flatnonzero(np.diff(w.first) == 1)
    h, where = np.unique(h[w.first[whole]], return_index=True)
    where, h = where[out.get(h) == 0], h[out.get(h) == 0]
    out.put(h, c.encoded([texts[i] for i in whole[where]]))
    return out


_DRAWN = np.dtype([("hash", "<u8"), ("times", "<u4"), ("size", "<u4")])


def _drawn(docs: DataFrame, path: str, text_col: str, classes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pre-tokens of about ``SAMPLE_DOCS`` documents, counted and encoded where they are."""
    rows = need(docs, text_col)
    n = rows.count()
    sent = docs.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Counter.of(path)
        for b in batches:
            for _, _, data, offsets in tk.chunks(b.column(0)):
                w, h, _ = c.pieces(data, offsets, sent.value)
                h, where, times = np.unique(h, return_index=True, return_counts=True)
                out = np.zeros(len(h), _DRAWN)
                out["hash"], out["times"], out["size"] = h, times, c.encode_pieces(w, where)
                yield pa.RecordBatch.from_arrays([pa.array([out[times > 1].tobytes()], pa.binary())], ["drawn"])

    some = rows.where(F.rand(29) < SAMPLE_DOCS / max(n, 1)).mapInArrow(run, "drawn binary").toArrow()["drawn"]
    parts = [np.frombuffer(x.as_buffer(), _DRAWN) for x in some]
    return [(x["hash"], x["times"], x["size"]) for x in parts]


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Counts are those of the library for the whole text, without begin or end
    tokens, truncation or padding; the file's added tokens inside a text count
    one each, as by default. Null and empty texts: 0 bytes, 0 tokens. Repeated
    rows and rows without id get a row each, an empty table gives none. Files
    that are more than a byte-level BPE (a normalizer, another pre-tokenizer,
    added tokens that take white space along) are counted by the library alone.
    """
    classes = character_classes()
    drawn = _drawn(docs, path, text_col, classes) if Counter.of(path).cuts else []
    sent = docs.sparkSession.sparkContext.broadcast((classes, frequent_lengths(path, drawn, classes)))
    out = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, to, data, offsets in tk.chunks(b.column(1)):
                counts = Counter.of(path).counts(data, offsets, *sent.value)
                yield pa.RecordBatch.from_arrays([b.column(0)[at:to], pa.array(np.diff(offsets)), pa.array(counts.astype(np.int64))], ["id", "n_bytes", "n_tokens"])

    counted = need(docs, id_col, text_col).mapInArrow(run, out)
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def text_counts(texts: list[str | None], path: str, frequent: Lengths | None = None) -> np.ndarray:
    """Number of tokens of each text, in this process."""
    data, offsets = tk.buffers(pa.array(texts, pa.large_string()))
    return Counter.of(path).counts(data, offsets, character_classes(), frequent or Lengths())
