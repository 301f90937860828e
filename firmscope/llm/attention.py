"""A small causal self-attention model over subword ids, in numpy.

The next subword is predicted in two factors: its class given the context, and
the subword given its class. Class logits are the sum of a table of what follows
the last subword (counted over the whole training corpus) and of a causal
attention layer over the window (trained by Adam over the whole training corpus). The
subword's share of its class, given the last subword's class, is counted over
the whole training corpus too. Both factors add up to one, so texts get proper
probabilities.

``forward`` is the plain form. What is trained and scored gives the same in fewer
products: query times key map, and value times output map, are formed once a step,
so scores are ``h M h'`` and what is attended to is ``h N``; positions that no one
scores ask nothing; and windows are worked on in blocks that fit a core's cache.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

WIDTH = 32  # of a context window
STRIDE = 26  # tokens that each window but the first scores
DIM = 32
CLASSES = 128
#: Subwords with an embedding and a follower row of their own; others share their class's.
ROWS = 4096
#: Weight of the shares over all contexts beside those after one class.
BACKOFF = 20.0


@dataclass
class Vocabulary:
    """row_of: embedding row of each id; class_of: class of each id. The id
    ``size`` stands for the text's begin as an input and for its end as a target."""

    size: int
    row_of: np.ndarray
    class_of: np.ndarray

    @property
    def n_rows(self) -> int:
        return ROWS + CLASSES


@dataclass
class Contexts:
    """What classes are made from: how often each subword occurs, and what stands
    before those that are to be clustered. Ids have ``size`` between texts."""

    count: np.ndarray
    order: np.ndarray
    class_of: np.ndarray
    middle: np.ndarray
    alone: int

    @staticmethod
    def of(count: np.ndarray) -> Contexts:
        """The most frequent subwords are classes of their own, what is too rare to
        tell is the last class; the others (``middle``) are to be clustered."""
        size = len(count) - 1
        order = np.argsort(-count, kind="stable")
        alone = min(CLASSES // 2, size + 1)
        class_of = np.full(size + 1, CLASSES - 1)
        class_of[order[:alone]] = np.arange(alone)
        if not len(np.flatnonzero(class_of == class_of[size])) == 1:
            class_of[size] = alone - 1  # the end keeps a class of its own
            class_of[order[alone - 1]] = CLASSES - 1
        middle = order[alone - 1 :]
        middle = middle[(count[middle] >= 8) & (class_of[middle] == CLASSES - 1)]
        return Contexts(count, order, class_of, middle, alone)

    def empty(self) -> np.ndarray:
        return np.zeros(len(self.middle) * 256, np.int32)

    def add(self, table: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
        """Count the subwords y after the subwords x."""
        before = np.full(len(self.count), 255, np.int32)
        before[self.order[:255]] = np.arange(len(self.order[:255]))
        place = np.full(len(self.count), -1, np.int32)
        place[self.middle] = np.arange(len(self.middle)) * 256
        at = place.take(y)
        at += before.take(x) * (at >= 0)
        _count(table, at[at >= 0])

    def vocabulary(self, table: np.ndarray, seed: int = 5) -> Vocabulary:
        size, middle, class_of = len(self.count) - 1, self.middle, self.class_of.copy()
        n = CLASSES - self.alone - 1
        if len(middle) > n:
            x = table.reshape(-1, 256).astype(np.float32)
            x /= np.maximum(x.sum(1, keepdims=True), 1)
            np.sqrt(x, out=x)
            rng = np.random.default_rng(seed)
            centre = x[rng.choice(len(x), n, replace=False)]
            weight = self.count[middle].astype(np.float64)
            for _ in range(12):
                near = np.argmax(x @ centre.T - (centre**2).sum(1) / 2, 1)
                mass = np.bincount(near, weight, n)
                for d in range(256):
                    centre[:, d] = np.where(mass > 0, np.bincount(near, weight * x[:, d], n) / np.maximum(mass, 1e-9), centre[:, d])
            class_of[middle] = self.alone + near
        row_of = ROWS + class_of
        own = self.order[: ROWS - 1]
        own = own[(self.count[own] >= 4) & (own != size)]
        row_of[own] = np.arange(len(own))
        row_of[size] = ROWS - 1
        return Vocabulary(size, row_of, class_of)


def build_vocabulary(ids: np.ndarray, size: int, seed: int = 5) -> Vocabulary:
    """Classes and rows from texts that fit one array (ids with ``size`` between texts)."""
    c = Contexts.of(np.bincount(ids, minlength=size + 1))
    table = c.empty()
    c.add(table, ids[:-1], ids[1:])
    return c.vocabulary(table, seed)


@dataclass
class Counts:
    """What the training corpus says: subwords after each class, and classes after
    each row."""

    pair: np.ndarray
    follow: np.ndarray

    @staticmethod
    def empty(v: Vocabulary) -> Counts:
        return Counts(np.zeros((CLASSES, v.size + 1), np.int32), np.zeros((v.n_rows, CLASSES), np.int32))

    def add(self, v: Vocabulary, ids: np.ndarray, first: np.ndarray) -> None:
        """Texts as ids with ``first`` offsets; each has its end appended here."""
        x, y, _ = sequences(v, ids, first)
        self.add_pairs(v, x, y)

    def add_pairs(self, v: Vocabulary, x: np.ndarray, y: np.ndarray) -> None:
        """Count the subwords y after the subwords x."""
        place = (v.class_of * (v.size + 1)).astype(np.int32).take(x)
        place += y.astype(np.int32)
        _count(self.pair.reshape(-1), place)
        place = (v.row_of * CLASSES).astype(np.int32).take(x)
        place += v.class_of.astype(np.int32).take(y)
        _count(self.follow.reshape(-1), place)


def _count(table: np.ndarray, place: np.ndarray) -> None:
    """Count places in a large table; sorted, each place is looked up once. The order of ``place`` is used up."""
    place.sort()
    first = np.flatnonzero(np.concatenate([np.ones(min(len(place), 1), bool), place[1:] != place[:-1]]))
    table[place[first]] += np.diff(first, append=len(place)).astype(table.dtype)


def sequences(v: Vocabulary, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, targets, offsets): begin + ids predict ids + end, text by text."""
    n = np.diff(first) + 1
    offsets = np.concatenate([[0], np.cumsum(n)])
    x, y = np.full(offsets[-1], v.size), np.full(offsets[-1], v.size)
    inner = np.ones(offsets[-1], bool)
    inner[offsets[:-1]] = False
    x[inner] = ids
    inner[:] = True
    inner[offsets[1:] - 1] = False
    y[inner] = ids
    return x, y, offsets


def windows(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, begin, skip) of the overlapping windows; each position is scored by one."""
    n = np.diff(offsets)
    count = 1 + np.maximum(-(-(n - WIDTH) // STRIDE), 0)
    count[n == 0] = 0
    text = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return text, offsets[text] + k * STRIDE, np.where(k > 0, WIDTH - STRIDE, 0)

#: Windows that are worked on at once: their arrays stay in a core's own cache.
BLOCK = 64


@dataclass
class Adam:
    """Running moments of the gradients."""

    moment: dict[str, tuple[np.ndarray, np.ndarray]]
    step: int = 0

    @staticmethod
    def start(p: dict[str, np.ndarray]) -> Adam:
        return Adam({k: (np.zeros_like(w), np.zeros_like(w)) for k, w in p.items()})

    def update(self, p: dict[str, np.ndarray], grads: dict[str, np.ndarray], rate: float) -> None:
        """One step; the gradients' arrays are used up."""
        self.step += 1
        # Both moments stand undivided here: 10 and 100 times what Adam calls them.
        root = math.sqrt(0.01 / (1 - 0.99**self.step))
        by, least = np.float32(rate * 0.1 / (1 - 0.9**self.step) / root), np.float32(1e-8 / root)
        for k, g in grads.items():
            m, s = self.moment[k]
            m *= np.float32(0.9)
            m += g
            g *= g
            s *= np.float32(0.99)
            s += g
            np.sqrt(s, out=g)
            g += least
            np.divide(m, g, out=g)
            g *= by
            p[k] -= g


@dataclass
class Block:
    """Some windows that score from the same position ``q0`` on. ``kept``: the scored
    positions of [n, WIDTH - q0], with their rows, the classes to be told, and where they stand."""

    q0: int
    rows: np.ndarray
    kept: np.ndarray
    row: np.ndarray
    target: np.ndarray
    at: np.ndarray


@dataclass
class Windows:
    """The windows of texts, with the rows that go in and the classes to be told."""

    rows_of: np.ndarray
    class_of: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    skip: np.ndarray
    text: np.ndarray

    @staticmethod
    def of(v: Vocabulary, x: np.ndarray, y: np.ndarray, offsets: np.ndarray) -> Windows:
        text, begin, skip = windows(offsets)
        rows_of = np.concatenate([v.row_of[x], np.full(WIDTH, v.row_of[v.size])])  # windows may reach beyond the last text
        return Windows(rows_of, v.class_of[y], begin, offsets[text + 1], skip, text)

    def blocks(self, i: np.ndarray, block: int = BLOCK) -> Iterator[tuple[Block, np.ndarray]]:
        """Blocks of the windows i, and which windows are in each."""
        later = self.skip[i] > 0
        for q0, some in ((WIDTH - STRIDE, i[later]), (0, i[~later])):
            for at in range(0, len(some), block):
                j = some[at : at + block]
                where = self.begin[j][:, None] + _REACH
                rows = self.rows_of[where]
                where = where[:, q0:]
                kept = np.flatnonzero(where < self.end[j][:, None])
                at_text = where.reshape(-1)[kept]
                yield Block(q0, rows, kept, rows[:, q0:].reshape(-1)[kept], self.class_of[at_text], at_text), j


@dataclass
class Model:
    vocabulary: Vocabulary
    share: np.ndarray = field(default=None)  # log of a subword's share of its class, after each class
    table: np.ndarray = field(default=None)  # class logits after each row
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def start(v: Vocabulary, counts: Counts, seed: int = 3) -> Model:
        m = Model(v)
        unigram = counts.pair.sum(0, dtype=np.int64)
        total = np.bincount(v.class_of, unigram, CLASSES)
        members = np.bincount(v.class_of, minlength=CLASSES)
        alone = (unigram + 0.1) / (total + 0.1 * members)[v.class_of]
        m.share = np.empty((CLASSES, v.size + 1), np.float32)
        for c in range(CLASSES):
            seen = np.bincount(v.class_of, counts.pair[c], CLASSES)
            m.share[c] = np.log((counts.pair[c] + BACKOFF * alone) / (seen + BACKOFF)[v.class_of])
        all_classes = (total + 1) / (total + 1).sum()
        by_class = np.zeros((CLASSES, CLASSES))
        row_class = np.full(v.n_rows, CLASSES - 1)
        row_class[v.row_of] = v.class_of
        np.add.at(by_class, row_class, counts.follow)
        by_class = (by_class + 20 * all_classes) / (by_class.sum(1, keepdims=True) + 20)
        rows = (counts.follow + 20 * by_class[row_class]) / (counts.follow.sum(1, keepdims=True) + 20)
        m.table = np.log(rows).astype(np.float32)
        m.table[:, members == 0] = -30  # nothing can follow as a class without members
        rng = np.random.default_rng(seed)
        draw = lambda *s, k=1.0: (rng.normal(0, k / np.sqrt(s[0] if len(s) > 1 else 1), s)).astype(np.float32)
        m.p = {
            "embed": (rng.normal(0, 0.3, (v.n_rows, DIM))).astype(np.float32),
            "place": np.zeros((WIDTH, DIM), np.float32),
            "query": draw(DIM, DIM),
            "key": draw(DIM, DIM),
            "value": draw(DIM, DIM),
            "out": draw(DIM, DIM, k=0.3),
            "up": draw(DIM, DIM),
            "up_bias": np.zeros(DIM, np.float32),
            "down": draw(DIM, DIM, k=0.3),
            "head": np.zeros((DIM, CLASSES), np.float32),
            "bias": np.zeros(CLASSES, np.float32),
        }
        return m

    def forward(self, rows: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class logits, what they are made from) at the kept positions of windows
        [n, WIDTH], map by map: the plain form of what is trained and scored."""
        p = self.p
        h = p["embed"][rows] + p["place"]
        q, k, v = h @ (p["query"] * np.float32(DIM**-0.5)), h @ p["key"], h @ p["value"]
        a = np.exp(np.minimum(q @ k.transpose(0, 2, 1), 60)) * _PAST
        a /= a.sum(-1, keepdims=True)
        z = (h + a @ v @ p["out"])[keep]
        f = z + np.maximum(z @ p["up"] + p["up_bias"], 0) @ p["down"]
        return np.minimum(f @ p["head"] + p["bias"] + self.table[rows[keep]], 80), f

    def _step(self) -> dict[str, np.ndarray]:
        """What a step's blocks share."""
        p = self.p
        m = (p["query"] * np.float32(DIM**-0.5)) @ p["key"].T
        n = p["value"] @ p["out"]
        return {"m": m, "n": n, "m_back": np.ascontiguousarray(m.T), "n_back": np.ascontiguousarray(n.T), "head": np.concatenate([p["head"], p["bias"][None]])}

    def _logits(self, b: Block, w: dict[str, np.ndarray]) -> tuple[np.ndarray, tuple]:
        """Class logits and what they are made from, which ends in a one for the bias."""
        p = self.p
        h = p["embed"].take(b.rows.reshape(-1), 0).reshape(*b.rows.shape, DIM)
        h += p["place"]
        g, v = np.matmul(h[:, b.q0 :], w["m"]), np.matmul(h, w["n"])
        a = np.matmul(g, h.transpose(0, 2, 1))
        _bounded(a, 60)
        np.exp(a, out=a)
        a *= _PAST[b.q0 :]
        a /= (a.reshape(-1, WIDTH) @ _ONES).reshape(*a.shape[:2], 1)
        c = np.matmul(a, v)
        z = (h[:, b.q0 :] + c).reshape(-1, DIM).take(b.kept, 0)
        u = z @ p["up"]
        u += p["up_bias"]
        np.maximum(u, 0, out=u)
        f = np.ones((len(z), DIM + 1), np.float32)
        np.add(u @ p["down"], z, out=f[:, :DIM])
        logits = f @ w["head"]
        logits += self.table.take(b.row, 0)
        _bounded(logits, 80)
        return logits, (h, g, v, a, c, z, u, f)

    def scores(self, x: np.ndarray, y: np.ndarray, offsets: np.ndarray, block: int = BLOCK) -> np.ndarray:
        """Natural log probability of each text of ``sequences``, in blocks of windows."""
        out = np.zeros(len(offsets) - 1)
        every, w, v = Windows.of(self.vocabulary, x, y, offsets), self._step(), self.vocabulary
        shares = self.share.reshape(-1).take(v.class_of[x] * (v.size + 1) + y)
        score = np.empty(len(x), np.float32)
        for b, _ in every.blocks(np.arange(len(every.text)), block):
            logits, _ = self._logits(b, w)
            chosen = logits.reshape(-1).take(np.arange(len(b.kept)) * CLASSES + b.target)
            np.exp(logits, out=logits)
            score[b.at] = chosen - np.log(logits @ _ones(CLASSES))
        score += shares
        some = np.flatnonzero(np.diff(offsets))
        out[some] = np.add.reduceat(score.astype(np.float64), offsets[some]) if len(some) else 0
        return out

    def train(self, x: np.ndarray, y: np.ndarray, offsets: np.ndarray, epochs: int = 1, rate: float = 3e-3, batch: int = 64, seed: int = 11, adam: Adam | None = None) -> None:
        """One pass or more of Adam over the windows of texts, in random order. Calls
        that hand on ``adam`` are parts of one run, whose rate does not decay."""
        every = Windows.of(self.vocabulary, x, y, offsets)
        rng, n = np.random.default_rng(seed), len(every.text)
        total, decays = epochs * -(-n // batch), adam is None
        adam = adam or Adam.start(self.p)
        for _ in range(epochs):
            order = rng.permutation(n)
            for at in range(0, n, batch):
                grads = self._gradients([b for b, _ in every.blocks(order[at : at + batch])])
                step = adam.step + 1
                adam.update(self.p, grads, rate * min(1, step / 50) * (1 - step / (total + 1) if decays else 1))

    def _gradients(self, blocks: list[Block]) -> dict[str, np.ndarray]:
        """Gradients of the mean loss of the blocks' kept positions."""
        p, w = self.p, self._step()
        scale = np.float32(1 / max(sum(len(b.kept) for b in blocks), 1))
        names = [k for k in p if k not in ("embed", "query", "key", "value", "out", "head", "bias")]
        out = {k: np.zeros_like(p[k]) for k in names}
        dm, dn, dhead = np.zeros_like(w["m"]), np.zeros_like(w["n"]), np.zeros_like(w["head"])
        rows, moved = [], []
        for b in blocks:
            d, (h, g, v, a, c, z, u, f) = self._logits(b, w)
            np.exp(d, out=d)
            d *= (scale / (d @ _ones(CLASSES)))[:, None]
            d.reshape(-1)[np.arange(len(d)) * CLASSES + b.target] -= scale
            df = d @ p["head"].T
            dhead += _product(f, d, 64)
            out["down"] += _product(u, df)
            du = df @ p["down"].T
            du *= u > 0
            out["up"] += _product(z, du)
            out["up_bias"] += _ones(len(du)) @ du
            df += du @ p["up"].T
            full = np.zeros(c.shape, np.float32)
            full.reshape(-1, DIM)[b.kept] = df
            # Through the attention: its rows' sums of weight times gradient are c times the gradient.
            da = np.matmul(full, v.transpose(0, 2, 1))
            c *= full
            da -= (c.reshape(-1, DIM) @ _ONES[:DIM]).reshape(*c.shape[:2], 1)
            da *= a
            dv = np.matmul(a.transpose(0, 2, 1), full)
            dg = np.matmul(da, h)
            dh = np.matmul(da.transpose(0, 2, 1), g)
            dh += np.matmul(dv, w["n_back"])
            full += np.matmul(dg, w["m_back"])
            dh[:, b.q0 :] += full
            dn += np.matmul(h.transpose(0, 2, 1), dv).sum(0)
            dm += np.matmul(h[:, b.q0 :].transpose(0, 2, 1), dg).sum(0)
            out["place"] += dh.sum(0)
            rows.append(b.rows.reshape(-1))
            moved.append(dh.reshape(-1, DIM))
        root = np.float32(DIM**-0.5)
        return out | {
            "embed": _by_row(np.concatenate(rows), np.concatenate(moved), len(p["embed"])),
            "query": dm @ p["key"] * root,
            "key": dm.T @ p["query"] * root,
            "value": dn @ p["out"].T,
            "out": p["value"].T @ dn,
            "head": dhead[:DIM],
            "bias": dhead[DIM],
        }


def _by_row(rows: np.ndarray, x: np.ndarray, size: int) -> np.ndarray:
    """Sums of x [n, DIM] by row; pairs of columns are added as complex numbers."""
    out = np.zeros((size, x.shape[1]), np.float32)
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    row = rows[order]
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    out[row[first]] = np.add.reduceat(x.take(order, 0).view(np.complex64), first, 0).view(np.float32)
    return out


def _product(x: np.ndarray, y: np.ndarray, rows: int = WIDTH) -> np.ndarray:
    """x' y of long narrow arrays, by stacks of short ones, which is faster."""
    n = len(x) // rows * rows
    some = np.matmul(x[:n].reshape(-1, rows, x.shape[1]).transpose(0, 2, 1), y[:n].reshape(-1, rows, y.shape[1])).sum(0)
    return some + x[n:].T @ y[n:]


def _bounded(x: np.ndarray, most: float) -> None:
    if x.size and x.max() > most:
        np.minimum(x, most, out=x)


def _ones(n: int) -> np.ndarray:
    return np.ones(n, np.float32)


_REACH = np.arange(WIDTH)
_PAST = (_REACH[None, :] <= _REACH[:, None]).astype(np.float32)
_ONES = np.ones((WIDTH, 1), np.float32)
