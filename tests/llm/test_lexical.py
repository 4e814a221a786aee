"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
from oracle_check import compare, duck
from conftest import frame

from fxledger.llm import lexical as X
from fxledger.llm.queries import op11_ball_tree_search, oracle_sql
from fxledger.llm.shipping import ship

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def brute(rows, items, top=10):
    words = [(d, terms(t)) for d, t in rows]
    n, total = sum(bool(w) for _, w in words), sum(len(w) for _, w in words)
    df = Counter(t for _, w in words for t in set(w))
    out = []
    for item, text in items:
        found = []
        for d, w in words:
            tf, m = Counter(w), 25 + (75 * len(w) * n) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                        * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in terms(text) if tf[t])
            if score > 0:
                found.append((-score, d is None, d or 0))
        out += [(item, k + 1, None if null else d, -s) for k, (s, null, d) in enumerate(sorted(found)[:top])]
    return sorted(out, key=repr)


def got(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=repr)


ITEMS = [(1, "a b c d"), (2, "For the MIT License, x y"), (3, ""), (4, None), (5, "日本語 x"), (6, "a b c d"),
         (None, "changed edit1 edit2 edit3"), (8, "no-such-term-anywhere"), (9, "x " * 50 + "nul %%%")]


def item_frame(spark, items):
    return spark.createDataFrame([(i, t, 0, "k") for i, t in items],
                                 "item_id long, text string, score long, key string")


def test_matches_brute_force(spark, rows, docs):
    assert got(X.search(docs, item_frame(spark, ITEMS))) == brute(rows, ITEMS)


def test_blocks_of_queries(spark, rows, docs):
    assert got(X.search(docs, item_frame(spark, ITEMS), block_chars=40, top=3)) == brute(rows, ITEMS, 3)


def test_repeated_rows_and_null_ids(spark, rows, repeated):
    want = brute(rows + rows + [(None, "lost id"), (None, None)], ITEMS + [(10, "lost one")])
    assert got(X.search(repeated, item_frame(spark, ITEMS + [(10, "lost one")]))) == want


def test_empty_tables(spark, docs, nothing):
    assert X.search(nothing, item_frame(spark, ITEMS)).count() == 0
    assert X.search(docs, item_frame(spark, [])).count() == 0
    assert X.search(frame(spark, [(1, None), (2, "..")]), item_frame(spark, ITEMS)).count() == 0


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    size, n = 400, 1500
    rows = [np.unique(rng.zipf(1.5, 30) % size) for _ in range(n)]
    rows[200:700] = [rows[200]] * 500  # copies
    ptr = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    t = np.concatenate(rows)
    v = rng.integers(1, 10**6, len(t))
    v[ptr[200]:ptr[700]] = np.tile(v[ptr[200]:ptr[201]], 500)
    weight = rng.integers(0, 9000, size)
    scale = np.sqrt(np.maximum(weight, 1))
    tree = X.Tree(ptr, t, v, scale)
    queries = np.zeros((size, 20), np.int64)
    for k in range(20):
        some = rng.integers(0, size, 12)
        queries[some, k] = weight[some]
    bound = tree.bounds(queries, scale)
    dense = np.zeros((n, size), np.int64)
    for i, r in enumerate(rows):
        dense[i, r] = v[ptr[i]:ptr[i + 1]]
    score = dense @ queries
    for k, (a, b) in enumerate(tree.ranges):
        assert (bound[k] >= score[tree.order[a:b]].max(0)).all()
    scored = 0
    for k in range(20):
        best = X.Best(10)
        scored += X.search_tree(tree, bound[:, k], queries[:, k].copy(), best, np.zeros(n, np.int64), np.arange(n))
        want = sorted((-int(s), i) for i, s in enumerate(score[:, k]) if s > 0)[:10]
        assert [(-s, i) for s, _, i in best.rows.T.tolist()] == want
    assert scored < 0.6 * 20 * n


def test_long_text_and_many_copies(spark):
    rng = random.Random(2)
    rows = [(i, "same words here and there") for i in range(300)]
    rows += [(1000 + i, " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 40)) for _ in range(60)))
             for i in range(300)] + [(5000, "word there " * 200_000)]
    items = [(1, "same there"), (2, "a1 b2 c3 d4 e5 there word")]
    assert got(X.search(frame(ship(spark), rows), item_frame(spark, items))) == brute(rows, items)


def test_query_matches_sql(spark):
    assert compare(spark, duck(SF), op11_ball_tree_search, oracle_sql()["op11_ball_tree_search"], SF) == 400
