"""The pipeline's stages against brute force, each on what the stage before kept."""

import random
import re

import corpus_pipeline
from firmscope.llm import quality_rules
from tests.llm.test_operators import WORD, brute_components, words


def tables(spark, folder):
    r = random.Random(9)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(300)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    passage, item = text(60), text(20)
    rows, good = [], []

    def add(t, ok):
        rows.append((len(rows), t, "en", f"s{len(rows) % 3}", len(t or "")))
        good.append(ok)

    for k in range(40):
        t = text(r.randint(40, 120))
        add(t, 1)
        if k % 5 == 0:
            add(t, 1)
        if k % 5 == 1:
            w = t.split(" ")
            w[3] = "changed"
            add(" ".join(w), 1)
        if k % 7 == 0:
            add(text(80) + " " + passage + " " + text(40), 1)
        if k % 11 == 0:
            add(text(60) + " " + item + " " + text(30), 1)
        add(" ".join(["BUY!!", "NOW$$$"][k % 2] for _ in range(50)), 0)
        add(" ".join(x.upper() + "###" for x in text(40).split(" ")), 0)
    add(None, 0)
    add("", 0)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, g, 0) for i, g in enumerate(good)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, good, item


def test_stages(spark, tmp_path):
    rows, good, item = tables(spark, str(tmp_path))
    folder = str(tmp_path)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    state = {r[0]: r[1] for r in rows}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{folder}/stage{k}"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns[:5] == list(corpus_pipeline.COLUMNS)
        got = {r["doc_id"]: r for r in docs.collect()}
        assert len(got) == docs.count()
        if k == 0:
            verdict = quality_rules.apply_rules(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
            wanted = {r["doc_id"]: state[r["doc_id"]] for r in verdict.where("kept").collect()}
            assert wanted.keys() >= {i for i, g in enumerate(good) if g} and not any(not good[i] for i in wanted)
        elif k == 1:
            groups = brute_components(list(state.items()))
            wanted = {i: t for i, t in state.items() if groups[i][1] == i}
            assert len(wanted) < len(state)
        elif k == 2:
            first, wanted = {}, {}
            for i, t in state.items():
                w = words(t)
                for j in range(len(w) - 12):
                    g = tuple(w[j : j + 13])
                    first[g] = min(first.get(g, i), i)
            for i, t in state.items():
                w = words(t)
                gone = {p for j in range(len(w) - 12) if first[tuple(w[j : j + 13])] < i for p in range(j, j + 13)}
                if len(gone) < len(w):
                    wanted[i] = " ".join(x for p, x in enumerate(w) if p not in gone) if gone else t
            assert wanted != state
        elif k == 3:
            alnum = re.compile(r"[a-z0-9]+")
            grams = lambda t: {tuple(x[j : j + 10]) for x in [alnum.findall((t or "").lower())] for j in range(len(x) - 9)}
            bad = grams(item)
            wanted = {i: t for i, t in state.items() if not grams(t) & bad}
            assert len(wanted) < len(state)
        else:
            size = {i: len(WORD.findall(t)) for i, t in state.items()}
            assert set(got) <= set(state) and all(got[i]["text"] == state[i] and 1 <= got[i]["copies"] <= 3 for i in got)
            assert abs(sum(size[i] * got[i]["copies"] for i in got) - sum(size.values())) <= max(size.values())
            return
        assert {i: r["text"] for i, r in got.items()} == wanted, name
        assert all(r["n_chars"] == len(r["text"]) for r in got.values())
        state = wanted


def test_odd_tables(spark, tmp_path):
    """Empty tables, rows without id, repeated ids and rows, columns with clashing names."""
    folder = str(tmp_path)
    tables(spark, folder)
    r = random.Random(4)
    text = lambda n: " ".join(f"w{r.randrange(400)}" for _ in range(n))
    one, two = text(60), text(70)
    near = " ".join(one.split(" ")[:-2] + ["x", "y"])
    rows = [(None, one), (None, near), (None, one), (7, two), (7, two), (7, text(50)), (9, two + " more"), (None, None), (3, ""), (None, text(45))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", "r") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, key string, _row string")
    kept = corpus_pipeline.near_duplicates(spark, docs, folder).collect()
    texts = sorted((str(x["doc_id"]), (x["text"] or "")[:9]) for x in kept)
    assert len(kept) == 6 and [i for i, _ in texts] == ["3", "7", "7", "None", "None", "None"] and len({t for i, t in texts if i == "None"} & {one[:9]}) == 1
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0, name
        assert stage(spark, docs, folder).columns[:5] == list(corpus_pipeline.COLUMNS), name
        assert {x["doc_id"] for x in stage(spark, docs, folder).collect()} <= {None, 3, 7, 9}, name
