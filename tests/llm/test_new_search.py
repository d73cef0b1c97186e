"""Lexical search and hard negatives against brute force, with small blocks so that all paths run."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tabwise.llm import hard_negatives, lexical, vectors
from pyspark.sql import functions as F

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute_search(docs, items, k=10):
    docs = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item, text in items:
        scored = []
        for i, c in docs:
            m = 25 + 75 * sum(c.values()) * n // total
            s = sum(w[t] * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("options", [{}, {"pass_terms": 5, "block_rows": 2, "first_strata": 1}])
def test_search_matches_brute_force(spark, docs, corpus, options):
    long = "x" * 100
    items = [(1, corpus[0][1]), (2, "BARA bara, " + corpus[5][1][:60]), (2, "lolin"), (3, ""), (4, None), (5, "nowhere"), (None, "këra sáste bara"), (6, long), (7, corpus[70][1][:300])]
    more = docs.select("doc_id", "text", "n").unionByName(spark.createDataFrame([(900, long + " bara", 1), (901, "bara", 1), (902, "bara", 1), (903, "bara", 1)], "doc_id long, text string, n long"))
    got = lexical.search(more, spark.createDataFrame([(*i, "z", 1) for i in items], "item_id long, text string, m string, terms int"), **options)
    rows = [(r.item_id, r["rank"], r.doc_id, r.score) for r in got.collect()]
    want = brute_search([(r.doc_id, r.text) for r in more.collect()], items)
    assert sorted(rows, key=repr) == want and want


def test_search_of_nothing(spark, docs, nothing):
    item = spark.createDataFrame([(1, "bara")], "item_id long, text string")
    assert lexical.search(nothing, item).count() == 0
    assert lexical.search(docs, item.limit(0)).count() == 0
    assert lexical.search(docs, item).columns == ["item_id", "rank", "doc_id", "score"]


def whole(v):
    return [int(math.floor(c * 256)) if abs(c) < 1e200 else int(c) * 256 for c in v]


def brute_negatives(rows, is_anchor, positives=5, negatives=3):
    rows = [(i, w, whole(v)) for i, w, v in rows if i is not None and w is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out, seen = [], set()
    for i, w, v in rows:
        if not is_anchor(i) or (i, w, tuple(v)) in seen:
            continue
        seen.add((i, w, tuple(v)))
        scored = [(-sum(a * b for a, b in zip(v, y)), j, x) for j, x, y in rows if len(y) == len(v)]
        for s, j, _ in sorted(r for r in scored if r[2] == w and r[1] != i)[:positives]:
            fit = sorted((t, n) for t, n, x in scored if x != w and 50 * -s <= 100 * -t <= 95 * -s)[:negatives]
            out += [(i, j, rank, n, -s, -t) for rank, (t, n) in enumerate(fit, 1)]
    return sorted(out)


def vector_rows(seed=3, n=150, dim=6, huge=()):
    rng = random.Random(seed)
    base = [[rng.choice([0.0, rng.gauss(0, 1), 0.5]) for _ in range(dim)] for _ in range(n)]
    rows = [(i, rng.choice([0, 1, 1, 2]), v) for i, v in enumerate(base)]
    rows += [(7, rows[7][1], rows[7][2]), (200, 1, rows[3][2]), (201, 2, rows[3][2]), (202, 1, [0.0] * dim), (203, 1, [1.0] * (dim - 1)), (204, 1, [-1.0] * (dim - 1)), (205, 0, [0.9] * (dim - 1))]
    rows += [(206, None, rows[1][2]), (207, 1, None), (208, 1, [None] + rows[1][2][1:]), (209, 1, [float("nan")] + rows[1][2][1:]), (210, 1, [float("inf")] * dim), (None, 1, rows[1][2]), (211, 1, []), (212, 0, [])]
    rows += [(300 + i, i % 2, [c * scale for c in rows[i][2]]) for scale in huge for i in range(12)]
    return rows


@pytest.mark.parametrize("huge", [(), (2.0**23, 2.0**40), (1e300,)])
def test_negatives_match_brute_force(spark, huge, monkeypatch):
    monkeypatch.setattr(hard_negatives, "FIRST_DEPTH", 2)
    rows = vector_rows(huge=huge)
    df = spark.createDataFrame([(*r, "x", 0.1, 5) for r in rows], "vec_id long, label int, embedding array<double>, key string, score double, at int").repartition(3)
    for size in (7, 16_384):
        got = hard_negatives.mine(df, F.col("vec_id") % 10 == 0, F.col("label"), index_rows=size).collect()
        want = brute_negatives(rows, lambda i: i % 10 == 0)
        assert len(want) > 20
        fits = [(a, b, c, d, s if abs(s) < 2**63 else None, t if abs(t) < 2**63 else None) for a, b, c, d, s, t in want]
        assert sorted([(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got], key=repr) == sorted(fits, key=repr)
    assert hard_negatives.mine(df.limit(0), F.col("vec_id") % 10 == 0, F.col("label")).count() == 0


def test_reading_stops_early():
    """With lists led by few rows the threshold falls before all rows are met."""
    x = np.zeros((4096, 8))
    x[:40] = np.random.default_rng(1).integers(100, 200, (40, 8))
    lists = np.argsort(x, axis=0, kind="stable").T
    met = 0
    for rows, bound in hard_negatives.sorted_access(x, lists, np.ones(8)):
        met += len(rows)
        if bound is not None and bound < 100:
            break
    assert 40 <= met < 2000


def test_windows_and_far_scores():
    for p in (-7, 0, 1, 99, 100, 12345):
        lo, hi = hard_negatives.window_of(p)
        fit = [s for s in range(-20, 12400) if 50 * p <= 100 * s <= 95 * p]
        assert (fit == list(range(lo, hi + 1))) if lo <= hi else fit == []
    far = [2**63, -(2**63) - 1, 2**2000, -(2**2000), 5]
    big, raw, score = [a.to_pylist() for a in vectors.score_arrays(far)]
    assert [vectors.score_value(*r) for r in zip(big, raw, score)] == far
    assert sorted(range(5), key=lambda i: (big[i], raw[i] or b"", score[i] or 0)) == [3, 1, 4, 0, 2]


@pytest.mark.parametrize("huge", [(2.0**23, 2.0**40), (1e300,)])
def test_top_k_with_large_components(spark, huge):
    from tabwise.llm import topk

    rows = vector_rows(huge=huge)
    df = spark.createDataFrame([(*r, "x", 0.1) for r in rows], "vec_id long, label int, embedding array<double>, big string, score double").repartition(3)
    sound = [(i, whole(v)) for i, _, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    want = []
    for q, v in {(i, tuple(v)) for i, v in sound if i % 10 == 0}:
        best = sorted((-sum(a * b for a, b in zip(v, x)), j) for j, x in sound if j != q and len(x) == len(v))[:5]
        want += [(q, rank, j, -s if abs(s) < 2**63 else None) for rank, (s, j) in enumerate(best, 1)]
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 10 == 0).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(want) > 60
