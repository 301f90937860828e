"""Each operator against brute force on small, awkward tables."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from firmscope.llm import attention, chat, decontaminate, jaccard_join, lm_scoring, mixing, quality_model, quality_rules, substring_dedup, token_counts, warc
from firmscope.llm import textkernel as tk
from firmscope.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, source string, component_id string, id string, key string, n long, node string"


def corpus():
    """Copies, near copies, shared passages, nulls, empties, repeats, odd characters."""
    r = random.Random(4)
    vocab = ["".join(r.choice("abcdeéßñ") for _ in range(r.randint(1, 6))) for _ in range(60)] + ["THE", "x\u0000y", "!!", "#$", "日本"]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    passage = text(30)
    out = [None, "", " \n\t ", "one", "one two three four", "one two three four", text(13), "a " * 60]
    for _ in range(12):
        base = text(r.randint(20, 120)).split(" ")
        out.append(" ".join(base))
        for _ in range(r.randint(0, 4)):
            copy = list(base)
            for _ in range(r.randint(0, 3)):
                copy[r.randrange(len(copy))] = r.choice(vocab)
            out.append(" ".join(copy) if r.random() < 0.8 else "\n".join(copy).upper())
        if r.random() < 0.6:
            out.append(text(10) + "\n" + passage + "\t" + text(r.randint(0, 30)))
    out.append("".join(f"line {k % 3} repeats here\n" for k in range(20)))
    return [(100 - i if i % 7 else 200 + i, t) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    data = [(i, t, None if k % 9 == 0 else f"s{k % 4 if k % 2 else 0}", "c", "i", "k", 1, "n") for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t, lower=False):
    t = t or ""
    return WORD.findall(t.translate(LOWER) if lower else t)


def test_kernel(rows):
    import pyarrow as pa

    col = pa.array([t for _, t in rows] + [None, "\u0000 a"])
    got, seen = [], {}
    for at, to, data, offsets in tk.chunks(col, 100):
        w = tk.words(data, offsets)
        h = w.hashes()
        for d in range(to - at):
            mine = slice(w.first[d], w.first[d + 1])
            ws = [bytes(data[s:e]).decode() for s, e in zip(w.starts[mine], w.ends[mine])]
            got.append(ws)
            for x, y in zip(ws, h[mine].tolist()):
                assert seen.setdefault(x, y) == y
    assert got == [words(t) for t in col.to_pylist()] and len(set(seen.values())) == len(seen)


def brute_components(rows, percent=75):
    sets = []
    for i, t in rows:
        w = words(t, True)
        sets.append((i, {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()))
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(i), find(j)))
                parent[q] = p
    return {i: (len(s), find(i)) for i, s in sets}


def test_op1(spark, docs, rows, empty):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similarity_classes(docs).collect()}
    assert got == brute_components(rows)
    assert jaccard_join.similarity_classes(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (3, "A B c d e f"), (3, "other words"), (None, None)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in jaccard_join.similarity_classes(odd).collect())
    assert got == [("3", 1, "3"), ("3", 2, "3"), ("None", 0, "None"), ("None", 2, "3")]


def test_op1_near_copies_without_id(spark):
    """Rows without id link to near copies, with each other, and as bridges."""
    w = [f"w{k}" for k in range(60)]
    text = lambda n, *more: " ".join([*w[n:], *more])
    alone = " ".join(f"z{k}" for k in range(40))
    rows = [(7, text(0)), (None, text(7)), (5, text(14)), (None, alone), (None, alone + " end"), (9, "nothing like it at all"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r["doc_id"], r["n_shingles"], r["component_id"], r["size"]) for r in jaccard_join.similarity_classes(docs).collect()]
    wanted = [(7, 56, 5, 3), (None, 49, 5, 3), (5, 42, 5, 3), (None, 36, None, 2), (None, 37, None, 2), (9, 1, 9, 1), (None, 0, None, 1)]
    assert sorted(got, key=str) == sorted(wanted, key=str)


def test_op1_levels_change_nothing(spark, docs, rows, monkeypatch):
    """Whatever is counted as frequent and whichever levels are on offer."""
    monkeypatch.setattr(jaccard_join, "MIN_FREQUENT", 3)
    monkeypatch.setattr(jaccard_join, "LEVELS", (4, 8))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similarity_classes(docs).collect()}
    assert got == brute_components(rows)


def test_op1_long_lists(spark, docs, rows):
    """Lists in cells find what whole lists find; near copies in chains of several groups."""
    wanted = brute_components(rows)
    for long_list in (2, 5):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similarity_classes(docs, long_list=long_list).collect()}
        assert got == wanted
    r = random.Random(5)
    common = [f"c{k}" for k in range(70)]
    many = [(k, " ".join(common[r.randint(0, 12) : 70 - r.randint(0, 12)] + [f"u{k}x{j}" for j in range(r.randint(0, 14))])) for k in range(60)]
    wanted = brute_components(many)
    assert 1 < len({c for _, c in wanted.values()}) < 60
    frame = spark.createDataFrame(many, "doc_id long, text string").repartition(3)
    for long_list in (8, 1 << 14):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.similarity_classes(frame, long_list=long_list).collect()}
        assert got == wanted


def test_op1_at_the_threshold(spark):
    """Nested sets of different sizes, at exactly the threshold and beside it: the smaller
    one's shared shingles may all lie behind the larger one's prefix."""
    r = random.Random(21)
    rows = []
    for k in range(0, 240, 2):
        base = [f"t{k}w{j}" for j in range(r.randint(8, 120))]
        n = len(base) - 4
        cut = round(n * 0.25) + r.choice([-1, 0, 0, 1])
        side = r.randint(0, cut)
        rows += [(k, " ".join(base)), (k + 1, " ".join(base[side : len(base) - (cut - side)] + [f"x{k}y{j}" for j in range(r.choice([0, 0, 1, 2]))]))]
    wanted = brute_components(rows)
    assert 20 < sum(c != i for i, (_, c) in wanted.items()) < 110
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard_join.similarity_classes(docs).collect()}
    assert got == wanted


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(k, k + 1) for k in range(200, 240)]
    got = {x["node"]: x["root"] for x in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        p, q = sorted((find(a), find(b)))
        parent[q] = p
    assert got == {x: find(x) for x in {y for a, b in links if a != b for y in (a, b)} if find(x) != x} | {x: x for x in got if got[x] == x}


def test_op2(spark):
    texts = ["", "%3C|", "<|im_end|>\n<|im_start|>assistant\n", "a\n\nb", "%250A<", "日本 <| |>"]
    events = []
    for c in range(3):
        for turn, t in enumerate(texts):
            role = "assistant" if turn % 2 else "us<|er\nx%0A"
            events += [(c, turn, 0, "start", role, None), (c, turn, 1, "delta", None, "old<|"), (c, turn, 2, "regenerate", None, None), (c, turn, 3, "delta", None, t[:2]), (c, turn, 4, "delta", None, t[2:])]
            if c == 2:
                events += [(c, turn, 5, "edit", None, t + "!"), (c, turn, 6, "delta", None, "?"), (c, turn, 7, "other", None, "no")]
    random.Random(0).shuffle(events)
    df = spark.createDataFrame(events, "conv_id long, turn long, seq long, kind string, role string, text string")
    out = chat.format_chats(df)
    back = {r["conv_id"]: r for r in out.select("*", chat.parse(F.col("formatted")).alias("turns")).collect()}
    for c in range(3):
        wanted = [t + ("!?" if c == 2 else "") for t in texts]
        assert [x["text"] for x in back[c]["turns"]] == wanted
        assert [x["role"] for x in back[c]["turns"]] == ["assistant" if k % 2 else "us<|er\nx%0A" for k in range(len(texts))]
        assert "".join(s["text"] for s in back[c]["segments"]) == back[c]["formatted"]
        assert back[c]["formatted"].count("<|im_end|>") == len(texts)
        assert [s["text"] for s in back[c]["segments"] if s["loss"]] == [t.replace("%", "%25").replace("<|", "%3C|") for t in wanted[1::2]]
    assert chat.format_chats(df.limit(0)).count() == 0
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())


def test_op2_odd_rows(spark):
    """Rows without conversation, turn, role or text; repeats and ties; a long text; clashing columns."""
    long = "word <|im_end|> % " * 80_000
    rows = [(None, 1, "user", "a"), (None, None, "assistant", "b"), (5, 1, "user", "same"), (5, 1, "user", "same"), (5, 1, "assistant", None), (5, 2, None, long), (6, 1, "assistant", long)]
    df = spark.createDataFrame([(*r, 9, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, seq long, kind string, segments string")
    out = chat.format_chats(chat.as_events(df))
    got = {r["conv_id"]: r for r in out.select("conv_id", "n_turns", "formatted", "segments", chat.parse(F.col("formatted")).alias("turns")).collect()}
    assert {c: [(t["role"], t["text"]) for t in r["turns"]] for c, r in got.items()} == {
        None: [("assistant", "b"), ("user", "a")],
        5: [("assistant", ""), ("user", "same"), ("user", "same"), ("", long)],
        6: [("assistant", long)],
    }
    assert {c: r["n_turns"] for c, r in got.items()} == {None: 2, 5: 4, 6: 1}
    assert sum(s["loss"] for s in got[6]["segments"]) == 1 and got[6]["formatted"].count("<|im_end|>") == 1


def test_op3(docs, rows, empty):
    from firmscope.llm.queries import tokenizer_path

    path = tokenizer_path("byte_bpe_50k.tiktoken")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10)) == 0
    got = {r["doc_id"]: r for r in lm_scoring.score_texts(docs, path, held).collect()}
    train = lambda i: zlib.crc32(str(i).encode()) % 10 != 0
    count = Counter(x for i, t in rows if train(i) for x in [*words(t, True), ("end",)])
    n, v = sum(count.values()), len(count)
    for i, t in rows:
        ws = [*words(t, True), ("end",)]
        r = got[i]
        base = sum(np.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in ws)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (not train(i), len(ws), sum(count[x] > 0 for x in ws), n)
        assert abs(r["base_score"] - base) < 1e-6 and r["score"] < 0
    assert lm_scoring.score_texts(empty, path, held).count() == 0


def test_op3_learns_from_all_training_texts(spark):
    """Classes, rows and weights take every text in, also one over 64 KB; held-out ones stay out."""
    from firmscope.llm.queries import tokenizer_path

    path = tokenizer_path("byte_bpe_50k.tiktoken")
    e, size = lm_scoring._encoding(path), lm_scoring._encoding(path).n_vocab
    texts = [(k, f"the cat {k} sat", True) for k in range(60)] + [(99, "zebra " * 20_000, True), (100, "violin " * 50, False)]
    base = spark.createDataFrame(texts, "id long, text string, train boolean").withColumn("key", F.xxhash64("text")).repartition(3)
    encoded = lm_scoring._encoded(base, path, size)
    v = lm_scoring._vocabulary(encoded, size)
    own = lambda word: all(v.row_of[i] < attention.ROWS - 1 for i in e.encode_ordinary(" " + word))
    assert own("zebra") and own("cat") and not own("violin")
    m = attention.Model.start(v, attention.Counts.empty(v))
    before = {k: w.copy() for k, w in m.p.items()}
    p, tokens = lm_scoring._trained(encoded, m)
    wanted = sum(len(e.encode_ordinary(" " + w)) for _, t, train in texts if train for w in t.split()) + 61
    assert tokens == wanted
    assert all(np.isfinite(w).all() and (w != before[k]).any() for k, w in p.items())


def test_op3_subwords_without_a_step_a_word(monkeypatch):
    """Subwords of all words as the library gives them, also after generations of the cache
    change and with odd white space; no line of Python runs once a word."""
    import sys

    import pyarrow as pa

    from firmscope.llm import textkernel as tk
    from firmscope.llm.queries import tokenizer_path

    path = tokenizer_path("byte_bpe_50k.tiktoken")
    e = lm_scoring._encoding(path)
    monkeypatch.setattr(lm_scoring, "CACHE_SIZE", 8000)
    monkeypatch.setattr(lm_scoring, "_caches", {})
    steps = 0

    def count(frame, event, _):
        nonlocal steps
        if frame.f_code.co_filename != lm_scoring.__file__:
            return None
        steps += event == "line"
        return count

    def check(texts):
        nonlocal steps
        for _, _, data, offsets in tk.chunks(pa.array(texts)):
            w = tk.words(data, offsets, tk.LOWER)
            h, steps, tracer = w.hashes(), 0, sys.gettrace()
            sys.settrace(count)
            try:
                ids, first = lm_scoring.subwords(w, h, path)
            finally:
                sys.settrace(tracer)
            wanted = [[i for x in words(t, True) for i in e.encode_ordinary(" " + x)] for t in texts]
            assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == wanted

    for part in (0, 3000, 6000, 0):
        check([" ".join(f"Wort{k} caf\u00e9{k % 7}" for k in range(part, part + 6000)), "", None, " \n"])
        assert 0 < steps < 200
    check(["a\x1cb c\u3000d x\0y \x85q", "wort1", "\u00e9 ok\x1fno"])


def test_op3_scores_by_hand(spark):
    """Whole texts token by token over window borders, by the plain forward pass; held-out
    texts of a language with an order score better than under the words' counts alone;
    repeated rows, rows without id and clashing columns."""
    from firmscope.llm.queries import tokenizer_path

    path = tokenizer_path("byte_bpe_50k.tiktoken")
    r = random.Random(12)
    vocab = "the cat sat on a mat and saw one red house near green water under cold stars while old men sang low songs about it".split()

    def walk(n):
        at, out = r.randrange(len(vocab)), []
        for _ in range(n):
            out.append(vocab[at])
            at = (at * 5 + r.choice([1, 1, 1, 2])) % len(vocab)
        return " ".join(out)

    rows = [(k, walk(r.randint(0, 150))) for k in range(240)] + [(None, walk(40)), (7, "again the cat"), (7, "again the cat"), (500, None)]
    docs = spark.createDataFrame([(i, t, 1, "x", 2.0, True) for i, t in rows], "doc_id long, text string, n_tokens int, key string, score double, train boolean").repartition(3)
    held = F.pmod(F.col("doc_id"), F.lit(10)) == 0
    got = lm_scoring.score_texts(docs, path, held).collect()
    assert len(got) == len(rows) and sum(x["doc_id"] is None and not x["held_out"] for x in got) == 1
    assert len({(x["n_known"], x["base_score"], x["score"]) for x in got if x["doc_id"] == 7 and x["n_tokens"] == 4}) == 1
    out = [x for x in got if x["held_out"]]
    assert len(out) == 25 and sum(x["score"] for x in out) > sum(x["base_score"] for x in out) + 100
    # The model once more, over one long text.
    e = lm_scoring._encoding(path)
    ids = np.array([y for w in walk(260).split() for y in e.encode_ordinary(" " + w)])
    v = attention.build_vocabulary(np.append(np.concatenate([ids, ids]), e.n_vocab), e.n_vocab)
    counts = attention.Counts.empty(v)
    counts.add(v, ids, np.array([0, len(ids)]))
    m = attention.Model.start(v, counts)
    m.train(*attention.sequences(v, ids, np.array([0, len(ids)])))
    x, y, o = attention.sequences(v, ids, np.array([0, len(ids)]))
    total = 0.0
    for k in range(len(x)):
        begin = 0 if k < attention.WIDTH else (k - attention.WIDTH) // attention.STRIDE * attention.STRIDE + attention.STRIDE
        part = np.full((1, attention.WIDTH), v.row_of[0])
        part[0, : k - begin + 1] = v.row_of[x[begin : k + 1]]
        keep = np.zeros((1, attention.WIDTH), bool)
        keep[0, k - begin] = True
        logits = m.forward(part, keep)[0][0].astype(np.float64)
        total += logits[v.class_of[y[k]]] - np.log(np.exp(logits).sum()) + m.share[v.class_of[x[k]], y[k]]
    assert len(x) > 4 * attention.WIDTH and abs(m.scores(x, y, o)[0] - total) < 1e-3 * abs(total)


def test_attention_is_a_distribution():
    """Causal, the fast path equals the plain one, and next-token probabilities add up to 1."""
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 40, 3000)
    v = attention.build_vocabulary(np.append(ids, 50), 50)
    counts = attention.Counts.empty(v)
    first = np.arange(0, 3001, 100)
    counts.add(v, ids, first)
    m = attention.Model.start(v, counts)
    m.train(*attention.sequences(v, ids, first))
    head = ids[:7]
    total = 0.0
    base = m.scores(*attention.sequences(v, head, np.array([0, 7])))[0]
    x, y, o = attention.sequences(v, head, np.array([0, 7]))
    keep = np.zeros((1, attention.WIDTH), bool)
    keep[0, : len(x)] = True
    rows = np.full((1, attention.WIDTH), v.row_of[0])
    rows[0, : len(x)] = v.row_of[x]
    logits, _ = m.forward(rows, keep)
    p = logits - np.log(np.exp(logits).sum(1, keepdims=True))
    plain = sum(p[k, v.class_of[y[k]]] + m.share[v.class_of[x[k]], y[k]] for k in range(len(x)))
    assert abs(plain - base) < 1e-3
    for c in range(51):
        y2 = y.copy()
        y2[-1] = c
        total += np.exp(m.scores(x, y2, o)[0])
    y3 = y.copy()
    y3[-1] = 0
    prefix = m.scores(x, y3, o)[0] - (p[-1, v.class_of[0]] + m.share[v.class_of[x[-1]], 0])
    assert abs(total / np.exp(prefix) - 1) < 1e-3


def test_attention_steps_by_hand():
    """Gradients against differences of the plain form's loss, texts of all lengths; a step
    never holds logits of all classes of its positions; large tables are counted as by hand."""
    import tracemalloc

    r = np.random.default_rng(4)
    first = np.cumsum([0, 0, 1, 5, 31, 32, 33, 57, 58, 59, 400])
    ids = r.integers(0, 300, first[-1])
    v = attention.build_vocabulary(np.append(ids, 300), 300)
    counts = attention.Counts.empty(v)
    counts.add(v, ids, first)
    x, y, o = attention.sequences(v, ids, first)
    m = attention.Model.start(v, counts)
    pair, follow = np.zeros_like(counts.pair), np.zeros_like(counts.follow)
    np.add.at(pair, (v.class_of[x], y), 1)
    np.add.at(follow, (v.row_of[x], v.class_of[y]), 1)
    assert (pair == counts.pair).all() and (follow == counts.follow).all() and pair.sum() == len(x)
    m.train(x, y, o, epochs=3)
    m.p = {k: w + r.normal(0, 0.1, w.shape).astype(np.float32) for k, w in m.p.items()}
    every = attention.Windows.of(v, x, y, o)
    grads = m._gradients([b for b, _ in every.blocks(np.arange(len(every.text)), 7)])
    where = every.begin[:, None] + np.arange(attention.WIDTH)
    keep = (where < every.end[:, None]) & (np.arange(attention.WIDTH) >= every.skip[:, None])
    assert keep.sum() == len(x)

    def loss(p):
        logits = attention.Model(v, m.share, m.table, p).forward(every.rows_of[where], keep)[0]
        return (np.log(np.exp(logits).sum(1)) - logits[np.arange(len(logits)), every.class_of[where[keep]]]).mean()

    exact = {k: w.astype(np.float64) for k, w in m.p.items()}
    for k, w in exact.items():
        way = r.normal(size=w.shape)
        change = (loss(exact | {k: w + 1e-5 * way}) - loss(exact | {k: w - 1e-5 * way})) / 2e-5
        assert abs(change - (grads[k] * way).sum()) < 2e-3 * np.sqrt((grads[k] ** 2).sum()) + 1e-6, k
    # Many windows at once: several arrays of logits of all classes would not fit.
    long = r.integers(0, 300, 12_000)
    x, y, o = attention.sequences(v, long, np.array([0, len(long)]))
    tracemalloc.start()
    m.train(x, y, o, batch=500)
    assert tracemalloc.get_traced_memory()[1] < 4 * 4 * attention.CLASSES * len(long)
    tracemalloc.stop()


def test_attention_reaches_back():
    """Every position but a text's first ones sees at least seven subwords, and the feed-forward layer learns."""
    _, begin, skip = attention.windows(np.array([0, 500]))
    assert min(skip[1:]) + 1 >= 7 and attention.WIDTH == 32 and attention.STRIDE == 26
    ids = np.random.default_rng(1).integers(0, 40, 2000)
    v = attention.build_vocabulary(np.append(ids, 50), 50)
    m = attention.Model.start(v, attention.Counts.empty(v))
    before = {k: m.p[k].copy() for k in ("up", "up_bias", "down")}
    m.train(*attention.sequences(v, ids, np.array([0, 2000])))
    assert all((m.p[k] != w).any() for k, w in before.items())


def test_op4(spark, empty, tmp_path):
    html = ["<p>é</p>", "", None, "<p>é</p>", "z\r\n\r\nWARC/1.1", "", "q" * 70000]
    pages = spark.createDataFrame([(10 - i, f"http://x/{i}\r\nX: y" if i else None, h, "clash") for i, h in enumerate(html)], "page_id long, url string, html string, digest string").repartition(2)
    back = {r["page_id"]: r for r in warc.read_archives(warc.write_archives(pages), range_bytes=50).collect()}
    first = {}
    for i, h in sorted((10 - i, h or "") for i, h in enumerate(html)):
        first.setdefault(h, i)
    for i, h in enumerate(html):
        h = h or ""
        r = back[10 - i]
        if first[h] == 10 - i:
            assert (r["record_type"], r["refers_to"], r["payload"]) == ("response", None, bytearray(h.encode()))
        else:
            assert (r["record_type"], r["refers_to"], r["payload"]) == ("revisit", first[h], None)
        assert (r["payload_bytes"], r["payload_digest"]) == (len(h.encode()), warc.payload_digest(h.encode()))
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(none)).count() == 0


def test_op4_odd_rows(spark):
    """Rows without id are kept, as responses; repeated ids, equal rows, hot payloads."""
    rows = [(None, "a", "same"), (None, None, "same"), (5, "b", "same"), (5, "b", "same"), (9, None, "same"), (3, "c", None), (4, "c", ""), (5, "d", "other")]
    wanted = [(None, "response", None)] * 2 + [(3, "response", None), (4, "revisit", 3), (5, "response", None), (5, "response", None), (5, "response", None), (9, "revisit", 5)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, first int")
    back = warc.read_archives(warc.write_archives(pages)).collect()
    assert sorted(((r["page_id"], r["record_type"], r["refers_to"]) for r in back), key=str) == sorted(wanted, key=str)
    assert sorted(bytes(r["payload"]) for r in back if r["page_id"] is None) == [b"same", b"same"]
    many = spark.range(9000).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).alias("html"))
    back = warc.read_archives(warc.write_archives(many), payloads=False)
    assert {(r["record_type"], r["refers_to"], r["count"]) for r in back.groupBy("record_type", "refers_to").count().collect()} == {("response", None, 3001), ("revisit", 1, 5999)}


def test_op4_directory(tmp_path):
    import io
    import zipfile

    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("a", b"PK\x05\x06 not the end")
        z.writestr("packed", b"y" * 100, zipfile.ZIP_DEFLATED)
        with z.open(zipfile.ZipInfo("big"), "w", force_zip64=True) as f:
            f.write(b"z" * 10)
        z.comment = b"hello PK\x05\x06"
    data = b.getvalue()
    members = {m.name: m for m in warc.central_directory(io.BytesIO(data), len(data))}
    assert data[(s := warc.stored_start(io.BytesIO(data), members["a"])) : s + members["a"].size] == b"PK\x05\x06 not the end"
    assert data[(s := warc.stored_start(io.BytesIO(data), members["big"])) : s + 10] == b"z" * 10
    with pytest.raises(warc.BadArchive):
        warc.stored_start(io.BytesIO(data), members["packed"])
    end = data.rindex(b"PK\x05\x06", 0, len(data) - 20)
    at = int.from_bytes(data[end + 16 : end + 20], "little")
    record = b"PK\x06\x06" + (44).to_bytes(8, "little") + bytes(12) + (3).to_bytes(8, "little") * 2 + (end - at).to_bytes(8, "little") + at.to_bytes(8, "little")
    locator = b"PK\x06\x07" + bytes(4) + end.to_bytes(8, "little") + (1).to_bytes(4, "little")
    wide = data[:end] + record + locator + data[end : end + 8] + b"\xff\xff" * 2 + b"\xff" * 8 + data[end + 20 :]
    assert [m.name for m in warc.central_directory(io.BytesIO(wide), len(wide))] == ["a", "packed", "big"]
    for n in range(0, len(data), 7):
        with pytest.raises(warc.BadArchive):
            warc.central_directory(io.BytesIO(data[:n]), n)


def test_op5(spark, docs, rows, empty):
    alnum = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: alnum.findall((t or "").translate(LOWER))
    sample = [t for _, t in rows if t and len(t) > 100]
    items = [(1, sample[0][20:90]), (2, " ".join(split(sample[1])[3:9])), (3, None), (4, " ".join(split(sample[2])[2:22]).upper()), (5, sample[0][20:90]), (6, "unseen words of a test item that nobody has copied anywhere yet"), (7, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for i, t in items:
        w = split(t)
        for k in range(max(len(w) - 9, 1) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    for block in (decontaminate.BLOCK_BYTES, 60):
        got = {r["doc_id"]: r for r in decontaminate.decontaminate(docs, bench, block_bytes=block).collect()}
        for i, t in rows:
            w, hit, found = split(t), set(), set()
            for size in {len(x) for x in windows}:
                for k in range(len(w) - size + 1):
                    if (s := windows.get(tuple(w[k : k + size]))) is not None:
                        hit.update(range(k, k + size))
                        found |= s
            r = got[i]
            assert r["n_words"] == len(w) and set(r["items"]) == found and {p for s in r["spans"] for p in range(s["start"], s["end"])} == hit
        assert any(r["items"] for r in got.values())
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).where(F.size("spans") > 0).count() == 0


def test_op5_repeated_words(spark, monkeypatch):
    """Repeated grams in items and texts, by brute force; then a long text of one word."""
    r = random.Random(3)
    mixed = lambda n: " ".join(r.choice(["no", "no", "yes", "so"]) for _ in range(n))
    items = [(1, "no " * 40), (2, mixed(60)), (2, mixed(14)), (3, "no " * 40), (4, "yes no so " * 9), (5, "no no no"), (None, "no yes " * 8)]
    texts = [(k, t) for k, t in enumerate(["no " * 30, mixed(200), mixed(500), "yes no so " * 5, "x " * 20 + "no yes " * 6, "no no", None, mixed(90), "no " * 9])]
    texts.append((1, mixed(30)))
    windows = {}
    for i, t in items:
        w = t.split()
        for k in range(max(len(w) - 9, 1)):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([(i, t, "a", "b") for i, t in texts], "doc_id long, text string, item_id string, spans string").repartition(2)

    def brute(t):
        w, hit, found = (t or "").split(), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if (s := windows.get(tuple(w[k : k + size]))) is not None:
                    hit.update(range(k, k + size))
                    found |= s
        return len(w), sorted(hit), sorted(map(str, found))

    wanted = sorted(str((i, *brute(t))) for i, t in texts)
    for block in (decontaminate.BLOCK_BYTES, 100):
        got = decontaminate.decontaminate(docs, bench, block_bytes=block).collect()
        assert sorted(str((r["doc_id"], r["n_words"], [p for s in r["spans"] for p in range(s["start"], s["end"])], sorted(map(str, r["items"])))) for r in got) == wanted
    import pyarrow as pa

    index = decontaminate.TestIndex(pa.array(["no " * 2000, "no " * 2000, "other words"]), 10, 5)
    w = tk.words(*tk.buffers(pa.array(["no " * 100_000, "no no"])), tk.ALNUM)
    hits = list(index.hits(w))
    assert sum(len(h[0]) for h in hits) == 100_000 - 9 and max(h[1].max() for h in hits) == 100_000


def test_op6(spark, docs, rows, empty):
    labels = spark.createDataFrame([(i, k % 2) for k, (i, _) in enumerate(rows[::2])] + [(None, 1), (7777, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in quality_rules.apply_rules(docs, labels).collect()}
    for i, t in rows:
        w, r = words(t), got[i]
        seen, dup = set(), 0
        for line in (t or "").split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        grams = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        count = Counter(grams)
        covered = {p for k, g in enumerate(grams) if count[g] > 1 for p in range(k, k + 8)}
        wanted = (len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), dup, len(covered))
        assert tuple(r[c] for c in quality_rules.COUNTS) == wanted
        assert r["base_failed"] == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (r["base_failed"] and r["kept"])
    assert quality_rules.apply_rules(empty, labels).count() == 0
    assert quality_rules.apply_rules(docs, labels.limit(0)).where("kept = base_failed").count() == 0


def test_op6_verdict_by_walking_the_trees(spark, docs, rows):
    labels = spark.createDataFrame([(i, k % 2) for k, (i, _) in enumerate(rows[::2])], "doc_id long, quality int")
    stats = quality_rules.document_statistics(docs)
    x, y = quality_rules.training_sample(stats.select("id", "features"), labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("y")), 1000)
    assert len(y) == len(rows[::2])
    trees = quality_rules.fit_trees(x, y, np.array(list(quality_rules.FEATURES.values())))

    def walk(k, f):
        node = 0
        while node < trees.feature.shape[1]:
            node = 2 * node + (2 if f[trees.feature[k][node]] > trees.threshold[k][node] else 1)
        return trees.leaf[k][node - trees.feature.shape[1]]

    wanted = {}
    for r in stats.collect():
        margin = trees.base + sum(walk(k, r["features"]) for k in range(len(trees.feature)))
        wanted[r["id"]] = 1 / (1 + np.exp(-margin))
    for r in quality_rules.apply_rules(docs, labels).collect():
        assert abs(r["good"] - wanted[r["doc_id"]]) < 1e-9 and r["kept"] == (not r["base_failed"] and r["good"] >= 0.5)
    odd = spark.createDataFrame([(1, "a " * 30, "x"), (1, "b c " * 30, "x"), (None, None, "y"), (None, "a", "y")], "doc_id long, text string, features string")
    got = quality_rules.apply_rules(odd, labels).collect()
    assert sorted((str(r["doc_id"]), r["n_words"]) for r in got) == [("1", 30), ("1", 60), ("None", 0), ("None", 1)]


def test_op6_trees_are_monotone():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] + 0.3 * np.sin(9 * x[:, 1]) + 0.2 * rng.normal(size=3000)) > 0.5).astype(float)
    t = quality_rules.fit_trees(x, y, np.array([1, 0, -1]), n_trees=30)
    assert ((t.probability(x) > 0.5) == y).mean() > 0.8
    grid = np.repeat(rng.random((50, 3)), 40, 0)
    for j, sign in ((0, 1), (2, -1)):
        g = grid.copy()
        g[:, j] = np.tile(np.linspace(0, 1, 40), 50)
        assert (sign * np.diff(t.margin(g).reshape(50, 40), axis=1) >= -1e-12).all()


def test_op7(spark, empty):
    r = random.Random(2)
    good = lambda: " ".join(r.choice(["alpha", "beta", "gamma", "delta", "omega"]) for _ in range(40))
    junk = lambda: " ".join(r.choice(["buy!!", "NOW!!", "$$$", "click"]) for _ in range(40))
    data = [(i, good() if i % 2 else junk()) for i in range(300)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    held = F.col("doc_id") % 3 == 1
    got = {x["doc_id"]: x["score"] for x in quality_model.classify(docs, labels, ~held).collect()}
    assert len(got) == 302 and all(0 <= s <= 1 for s in got.values()) and abs(got[900] - got[901]) < 1e-9
    test = [i for i in range(300) if i % 3 == 1]
    assert sum((got[i] >= 0.5) == bool(i % 2) for i in test) / len(test) > 0.95
    assert quality_model.classify(empty, labels).count() == 0
    assert {x["score"] for x in quality_model.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_op7_by_hand(spark):
    """Vectors, pooling and network once more, word by word."""
    import pyarrow as pa

    r = random.Random(6)
    texts = [" ".join(r.choice(["ab", "cde", "fgh", "ijkl", "mnop", "xyz!"][k % 3 :]) for _ in range(r.randint(0, 30))) for k in range(40)]
    docs = spark.createDataFrame([(k, t, "p", 1) for k, t in enumerate(texts)], "doc_id long, text string, pooled string, y int").repartition(3)
    marks = {k: k % 2 for k in range(0, 40, 3)}
    labels = spark.createDataFrame(list(marks.items()), "doc_id long, quality int")
    dims, signs = quality_model._index_vectors()
    table, of = np.zeros((quality_model.BUCKETS, quality_model.DIM)), []
    for t in texts:
        w = tk.words(*tk.buffers(pa.array([t])))
        of.append(quality_model.units(w))
        for u in of[-1]:
            for i in range(len(u)):
                for j in range(max(i - 2, 0), min(i + 3, len(u))):
                    if i != j:
                        for d, s in zip(dims[u[j]], signs[u[j]]):
                            table[u[i], d] += s
    vectors = quality_model.unit_vectors(table)
    x = np.zeros((40, quality_model.POOLED))
    for k, t in enumerate(texts):
        if len(of[k][0]):
            x[k] = np.concatenate([*[f for u in of[k] for f in (vectors[u].mean(0), vectors[u].std(0))], [np.log1p(len(of[k][0])) / 8]])
    ids = sorted(marks)
    net = quality_model.train(x[ids], np.array([float(marks[i]) for i in ids]))
    got = {q["doc_id"]: q["score"] for q in quality_model.classify(docs, labels).collect()}
    for k in range(40):
        hidden = [max(float(((x[k] - net.centre) / net.scale) @ net.w1[:, j] + net.b1[j]), 0) for j in range(len(net.b1))]
        assert abs(got[k] - 1 / (1 + np.exp(-(np.dot(hidden, net.w2) + net.b2) / net.temperature))) < 1e-2
    twice = spark.createDataFrame([(0, "ab cde", "q"), (0, "ab cde", "q"), (0, "zz", "q"), (None, "ab", "q")], "doc_id long, text string, score string")
    assert sorted(str(q["doc_id"]) for q in quality_model.classify(twice, labels).collect()) == ["0", "0", "0", "None"]


def test_op8(spark, docs, rows, empty, monkeypatch, tmp_path):
    from tokenizers import Tokenizer

    from firmscope.llm.queries import tokenizer_path

    path = tokenizer_path()
    t = Tokenizer.from_file(path)
    got = {r["doc_id"]: r for r in token_counts.count_tokens(docs, path, limit=50).collect()}
    for i, text in rows:
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((text or "").encode()), n, n > 50)
    odd = ["<|endoftext|>", "a <|endoftext|>  <|endoftext|>b  ", "it's  we'll x　y", "\U0001f600\U0001d54f 12ab٣", "x" * 300 + "  \n\n ", "͸ꟓ á́", "tab\t\t\ta\r\n\x0b\x85b"]
    odd += ["<|end", "oftext|>", "a\n's 'll ''re 'LL 's", "'", "ab'", "سلام 👋🏽 สวัสดี नमस्ते " * 30, "'re" * 5, " " * 500, "字" * 40, ("long text'll go on\n " * 70_000)]
    odd += ["".join(random.Random(k).choice("ab's \n\t.1é中😀<|endoftext|>") for _ in range(60)) for k in range(200)]
    wanted = [len(t.encode(x, add_special_tokens=False).ids) for x in odd]
    assert token_counts.text_counts(odd, path).tolist() == wanted
    assert token_counts.text_counts(odd, path, token_counts.frequent_lengths(path)).tolist() == wanted
    monkeypatch.setattr(token_counts, "CACHE_SIZE", 1)
    assert token_counts.text_counts(odd, path).tolist() == wanted
    twice = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "y"), (None, "a b", "z"), (2, None, "z")], "doc_id long, text string, id string")
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in token_counts.count_tokens(twice, path).collect()) == [("1", 2), ("1", 2), ("2", 0), ("None", 2)]
    # Files don't share what they know: bytes only, and one that the library counts alone.
    form = json.loads(open(path, encoding="utf-8").read())
    form["model"]["merges"] = []
    (tmp_path / "bytes.json").write_text(json.dumps(form), encoding="utf-8")
    for other in (str(tmp_path / "bytes.json"), tokenizer_path("word_bpe_49k.json"), path):
        u = Tokenizer.from_file(other)
        assert token_counts.text_counts(odd[:16], other).tolist() == [len(u.encode(x, add_special_tokens=False).ids) for x in odd[:16]]
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, str(tmp_path / "bytes.json")).collect()}
    u = Tokenizer.from_file(str(tmp_path / "bytes.json"))
    assert got == {i: len(u.encode(x or "", add_special_tokens=False).ids) for i, x in rows}
    assert token_counts.count_tokens(empty, path).count() == 0


def test_op9(spark, docs, rows, empty):
    got = {r["doc_id"]: r for r in substring_dedup.dedup_substrings(docs).collect()}
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            first[g] = min(first.get(g, i), i)
    removed = 0
    for i, t in rows:
        w = words(t)
        gone = {p for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for p in range(k, k + 13)}
        r = got[i]
        assert (r["n_words"], r["n_removed"], r["kept"]) == (len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone))
        assert {p for s in r["spans"] for p in range(s["start"], s["end"])} == gone
        removed += len(gone)
    assert removed and substring_dedup.dedup_substrings(empty).count() == 0
    long = " ".join(f"w{k}" for k in range(20))
    odd = spark.createDataFrame([(None, long), (4, long), (4, long + " x"), (5, long)], "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in substring_dedup.dedup_substrings(odd).collect()) == [("4", 0), ("4", 0), ("5", 20), ("None", 0)]


def brute_substrings(rows):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            first[g] = min(first.get(g, i), i)
    return {(i, t): {p for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for p in range(k, k + 13)} for i, t in rows for w in [words(t)]}


def test_op9_hot_grams_and_factors(spark):
    """Many phrases around one k-gram, a passage whose source changes midway, a text over a
    chunk, a text of one word; factors are copies of their sources and end where those do."""
    r = random.Random(8)
    new = lambda n: [f"n{r.randrange(10**9)}" for _ in range(n)]
    common = "if you see this line tell".split(" ")
    a, b = new(60), new(60)
    texts = [a, b, new(5) + a[10:50] + b[5:55] + new(5), new(3) + a[30:43], a[1:13], ["same"] * 400, new(9) + ["same"] * 40]
    texts += [new(r.randint(4, 9)) + common + new(r.randint(4, 9)) for _ in range(60)]
    texts += [texts[-1 - k][:-2] + new(4) for k in range(20)]
    texts += [new(90_000) + a, new(7) + a + new(3)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    gone = brute_substrings(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for hot in (2, 64):
        got = substring_dedup.dedup_substrings(docs, hot=hot).collect()
        assert len(got) == len(rows)
        for x in got:
            w = texts[x["doc_id"]]
            cut = gone[x["doc_id"], " ".join(w)]
            assert {p for s in x["spans"] for p in range(s["start"], s["end"])} == cut
            assert x["kept"] == " ".join(y for p, y in enumerate(w) if p not in cut)
            for f in x["factors"]:
                n = f["end"] - f["start"]
                assert n >= 13 and f["source"] < x["doc_id"]
                assert w[f["start"] : f["end"]] == texts[f["source"]][f["source_start"] : f["source_start"] + n]
    two = next(x for x in got if x["doc_id"] == 2)["factors"]
    assert {f["source"] for f in two} == {0, 1} and max(f["end"] - f["start"] for f in two) >= 30


def test_op10(spark, docs, rows, empty):
    got = mixing.mix(docs).collect()
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    size = {i: len(words(t)) for i, t in rows}
    by = Counter()
    for i in size:
        by[source[i]] += size[i]
    names = sorted((s for s in by if s is not None)) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    left, target, active = float(sum(by.values())), {}, set(names)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in active) for s in active}
        over = {s for s in active if share[s] > 3 * by[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * by[s]
            left -= target[s]
        active -= over
    taken = Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], by[s]) and abs(r["target"] - target[s]) < 1e-6
        assert r["taken"] == r["size"] * r["copies"] and r["copies"] <= 3
        taken[s] += r["taken"]
    assert len(got) == len(rows) and all(abs(taken[s] - target[s]) <= max(size.values()) for s in names)
    assert sorted(map(tuple, mixing.mix(docs.repartition(5)).collect())) == sorted(map(tuple, got))
    assert mixing.mix(empty).count() == 0 and mixing.mix(docs.where("text is null")).first()["taken"] == 0


def test_op10_one_bucket_or_many(docs, monkeypatch):
    whole = sorted(map(tuple, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 4)
    assert sorted(map(tuple, mixing.mix(docs).collect())) == whole


def test_nothing_else_imports_llm():
    from pathlib import Path

    top = Path(mixing.__file__).parent.parent
    for p in top.rglob("*.py"):
        if "llm" not in p.relative_to(top).parts:
            assert "firmscope.llm" not in p.read_text(), p
    assert json.dumps(1) and hashlib.sha256
