"""Hard negatives, repeated passages and source divergence against brute force."""

import hashlib
import os
import random
import re
import time
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from plenum.functions.graph import scratch_dir
from plenum.llm import divergence, negatives, pii, repeats

# repeated passages


def cut(texts, length):
    """(removed, spans, hash) of each text by comparing all windows."""
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return out


def passages(seed):
    """Texts of a few letters with shared, overlapping, edited and periodic stretches."""
    r = random.Random(seed)
    word = lambda n, letters="abcdé": "".join(r.choice(letters) for _ in range(n))
    shared = [word(r.randint(10, 90)) for _ in range(6)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(r.randint(0, 5)):
            parts.append(word(r.randint(0, 40)))
            s = r.choice(shared)
            a = r.randint(0, len(s) // 2)
            parts.append(s[a : r.randint(a, len(s))])
        texts.append("".join(parts))
    texts += texts[:3] + [None, "", "x", "a" * 70, "a" * 15, "ab" * 40, shared[0], shared[0][:-1] + "z"]
    return texts


@pytest.mark.parametrize(("seed", "hot", "few"), [(1, 10_000, 10), (2, 3, 10_000), (3, 1, 0)])
def test_repeats_against_all_windows(spark, seed, hot, few):
    texts = passages(seed)
    rows = [(i, t, i, "k") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, h long, key string").repartition(3)
    got = {}
    for r in repeats.repeats(docs, length=12, k=5, hot_from=hot, few_hot=few, with_text=True).collect():
        spans = [(s["start"], s["end"]) for s in r["spans"]]
        got[r["doc_id"]] = (r["n_bytes"], sum(b - a for a, b in spans), len(spans), r["kept_sha256"])
        assert hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"]
    assert got == dict(enumerate(cut(texts, 12)))


def test_repeats_of_whole_length_in_pieces(spark):
    """Windows of 200 bytes, repeated rows, a null id, and a text longer than one piece that repeats a passage far behind."""
    r = random.Random(5)
    passage = "".join(r.choice("abcdefgh ") for _ in range(260))
    long = "".join(r.choice("abcdefghijklmnop ") for _ in range(repeats.PIECE + 3000))
    long = long[:1000] + passage + long[1000:-500] + passage[:230] + long[-500:]
    texts = [(1, long), (2, "y" + passage[10:215] + "z"), (2, "q" * 199), (None, passage[:199]), (3, "w" * 201)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {(r["doc_id"], r["n_bytes"]): [tuple(s) for s in r["spans"]] for r in repeats.repeats(docs).collect()}
    n = len(long)
    assert got[1, n] == [(1000, 1230), (n - 730, n - 500)]
    assert got[2, 207] == [(1, 206)]
    assert got[2, 199] == [] and got[None, 199] == []
    assert got[3, 201] == [(0, 201)]


def test_repeats_of_nothing(spark):
    assert repeats.repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# hard negatives


def mined(rows, every=100, least=80):
    """Brute force over (vec_id, vector, label)."""
    whole = []
    for i, (vec_id, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or x != x or x in (float("inf"), float("-inf")) for x in v):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        whole.append((i, vec_id, label, [int(256 * x // 1) for x in v]))
    late = lambda x: (x is None, x or 0)
    out = []
    for i, a, la, q in whole:
        if a is None or a % every:
            continue
        score = [(-sum(x * y for x, y in zip(q, v, strict=False)), late(b), j, lb, b) for j, b, lb, v in whole if j != i]
        near = sorted(s for s in score if s[3] == la)[:5]
        for p in near:
            hard = sorted(s for s in score if s[3] != la and least * -p[0] <= 100 * -s[0] <= 100 * -p[0])[:5]
            out += [(a, p[4], r, n[4], -p[0], -n[0]) for r, n in enumerate(hard, 1)]
    return sorted(out, key=str)


def test_negatives_against_all_pairs(spark, monkeypatch):
    """Clusters, ties, repeated rows and ids, null ids, bad components, short vectors; small leaves, trees and blocks of anchors."""
    r = random.Random(4)
    centres = [[r.uniform(-1, 1) for _ in range(6)] for _ in range(5)]
    rows = []
    for i in range(900):
        c = r.choice(centres)
        rows.append((i if i % 50 else 100 * (i % 4), [round(x + r.gauss(0, 0.2), 1) for x in c], r.randrange(3)))
    rows += [(700, [0.5] * 6, 1), (700, [0.5] * 6, 1), (None, [0.5] * 6, 2), (7, None, 1), (8, [1.0, None], 2), (9, [float("nan")] * 6, 1), (10, [float("inf")] * 6, 0), (11, [0.25], 1), (12, [], 2), (13, [0.1] * 6, None), (800, [-0.5] * 6, 9)]
    rows = [(a, v if v is None else [x if x is None else float(x) for x in v], b) for a, v, b in rows]
    monkeypatch.setattr(negatives, "LEAF", 16)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("row", F.lit("x")).withColumn("v", F.lit(0))
    exact = [(a, v if v is None else [x if x is None else float(__import__("numpy").float32(x)) for x in v], b) for a, v, b in rows]
    want = mined(exact)
    for at_once in (20_000, 4):
        got = sorted((tuple(x) for x in negatives.mine(table, at_once=at_once).collect()), key=str)
        assert got == want
    assert len(want) > 50


def test_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert negatives.mine(empty).count() == 0
    alone = spark.createDataFrame([(100, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert negatives.mine(alone).count() == 0


def test_tree_bounds_hold_every_row():
    import numpy as np

    rng = np.random.default_rng(3)
    v = rng.integers(-200, 200, (3000, 7))
    tree = negatives.Tree(np.arange(3000), np.arange(3000), rng.integers(0, 3, 3000), v)
    assert sorted(tree.rows) == list(range(3000))
    q = rng.integers(-200, 200, (4, 7))
    for (start, end, *_), (low, high) in zip(tree.levels[:1], tree.bounds(q)[:1], strict=True):
        for j, (a, b) in enumerate(zip(start, end, strict=True)):
            s = tree.v[a:b] @ q.T
            assert (s >= low[:, j]).all() and (s <= high[:, j]).all()


# source divergence


def audited(rows, min_docs, top):
    """Brute force over (text, lang, source)."""
    n, docs, groups = Counter(), Counter(), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        told = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        n.update((lang, source, w) for w in told)
        docs.update((lang, w) for w in set(told))
    kept = defaultdict(list)
    for (lang, w), d in docs.items():
        if d >= min_docs:
            kept[lang].append(w)
    sources = defaultdict(list)
    for lang, source in groups:
        sources[lang].append(source)
    out = []
    for lang, source in groups:
        words = kept[lang]
        share = lambda f: {w: 1 + 10**9 * (f(w) + 5) // (sum(map(f, words)) + 5 * len(words)) for w in words}
        p = share(lambda w: n[lang, source, w])  # noqa: B023
        parts = [("pair", other, sum(abs(p[w] - q[w]) for w in words)) for other in sources[lang] if other != source for q in [share(lambda w: n[lang, other, w])]]  # noqa: B023
        q = share(lambda w: sum(n[lang, s, w] for s in sources[lang]))  # noqa: B023
        parts += [("term", w, p[w] - q[w]) for w in words if n[lang, source, w] and p[w] > q[w]]
        for part in ("pair", "term"):
            ranked = sorted((-v, item.encode(), item) for k, item, v in parts if k == part)
            out += [(lang, source, part, item, -v, i) for i, (v, _, item) in enumerate(ranked, 1) if part == "pair" or i <= top]
    return sorted(out)


def test_audit_against_brute_force(spark, monkeypatch):
    """Ties of many words, accents, cases, nulls, repeated rows, a group without words, and clashing columns."""
    r = random.Random(8)
    vocabulary = ["Alpha", "beta", "GAMMA", "été", "ÉTÉ", "straße", "x1y", "ζeta", "don't", "日本", *[f"w{chr(97 + i)}" for i in range(26)]]
    rows = []
    for _ in range(300):
        text = " ".join(r.choices(vocabulary, k=r.randint(0, 12)))
        rows.append((text, r.choice(["en", "fr", None]), r.choice(["s1", "s2", "", None, "ş3"])))
    rows += rows[:5] + [(None, "en", "none"), (None, "xx", "a"), ("one word", "xx", "b"), ("", "yy", None)]
    monkeypatch.setattr(divergence, "HELD", 50)
    monkeypatch.setattr(divergence, "BLOCK", 10)
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"n": F.lit("x"), "term": F.lit(1), "value": F.lit(2)})
    got = sorted(tuple(x) for x in divergence.audit(docs, min_docs=7, top=6).collect())
    want = audited(rows, 7, 6)
    assert got == want and len(want) > 40


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_names_in_linear_time_and_apart():
    found = pii.find("Dr. Smith and Dr. Smith-Jones met Smith")
    assert len({x[3] for x in found}) == 2 and found[0][3] == found[-1][3]
    text = " ".join(f"Dr. {a}{b}son saw Maria {b.upper()}{a.lower()}ez." for a in "BCDFGHKLMN" for b in "aeiou") + " "
    began = time.process_time()
    assert len(pii.find(text * 80)) >= 8_000
    assert time.process_time() - began < 2


def test_surrogates_leave_columns_of_any_name(spark):
    d = spark.createDataFrame([(1, "Dr. Smith wrote", 7, 8, 9), (2, None, 1, 2, 3)], "doc_id long, text string, `Row` int, mentions int, swaps int")
    got = {r.doc_id: r for r in pii.pseudonymise(d).collect()}
    assert (got[1].Row, got[1].mentions, got[1].swaps, got[1].n_entities) == (7, 8, 9, 1) and "Smith" not in got[1].text
    assert (got[2].Row, got[2].mentions, got[2].swaps, got[2].text) == (1, 2, 3, None)


def test_stages_take_columns_of_any_name_and_empty_tables(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    d = spark.createDataFrame([(1, "one two three", 7, 8), (None, None, 1, 2), (1, "one two three", 7, 8)], "doc_id long, text string, ROW int, coded int")
    for held, left in ((d, 2), (d.limit(0), 0)):
        for _, stage in corpus_pipeline.STAGES:
            held = corpus_pipeline.settle(stage(spark, held, sf))
            assert held.columns[:4] == ["doc_id", "text", "ROW", "coded"]
            assert all((r.ROW, r.coded) in ((7, 8), (1, 2)) for r in held.collect())
        assert held.count() == left


def test_pipeline_leaves_settings_and_no_scratch(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    before, folder = spark.conf.get(corpus_pipeline.BYTES), scratch_dir(spark).removeprefix("file://")
    there = set(os.listdir(folder))
    done = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert spark.conf.get(corpus_pipeline.BYTES) == before and done.count() > 0
    assert len({f for f in os.listdir(folder) if f.startswith("plenum-")} - there) == 1
