"""Ordered blocks and what is built on them, against sequential versions."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabwise.operators import blocks, forecast, information, stl


def frame(spark, pdf, parts=5):
    return spark.createDataFrame(pdf).repartition(parts)


def test_places_and_running_sums(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.integers(0, 4, 500), "v": rng.permutation(500) * 1.0, "x": rng.normal(size=500)})
    placed = blocks.in_order(frame(spark, pdf), ["g", "v"], 60)
    assert placed.select(blocks.BLOCK).distinct().count() > 4
    run = F.sum("x").over(blocks.within())
    before = blocks.starts(placed, _b=F.sum("x"))
    got = blocks.numbered(placed).withColumn("run", run).join(F.broadcast(before), blocks.BLOCK).withColumn("run", F.col("run") + F.col("_b")).toPandas().sort_values("idx")
    want = pdf.sort_values(["g", "v"]).reset_index(drop=True)
    assert got.v.tolist() == want.v.tolist() and got.idx.tolist() == list(range(500))
    assert np.allclose(got.run, want.x.cumsum())
    near = blocks.with_halo(blocks.numbered(placed), "idx", 7, 50).toPandas()
    assert near.own.sum() == 500
    for b, part in near.groupby("halo"):
        assert sorted(part.idx) == list(range(max(0, 50 * b - 7), min(500, 50 * b + 57)))
    assert blocks.in_order(frame(spark, pdf).limit(0), ["g"]).count() == 0


def series(spark, y, by=None):
    pdf = pd.DataFrame({"ts": pd.date_range("2020-01-01", periods=len(y), freq="h"), "y": y})
    return frame(spark, pdf if by is None else pdf.assign(k=by))


def test_long_series_forecast_equals_the_sequential_fit(spark):
    rng = np.random.default_rng(2)
    y = 20 + 0.01 * np.arange(3000) + np.cumsum(rng.normal(scale=0.3, size=3000)) + rng.normal(size=3000)
    want, margin = forecast.damped_forecast(y, 6)
    got = forecast.forecast(series(spark, y), horizon=6, block_rows=300).toPandas().sort_values("step")
    assert np.allclose(got.yhat, want, rtol=1e-4, atol=1e-3)
    assert np.allclose(got.upper - got.yhat, margin, rtol=1e-3, atol=2e-3)
    one = forecast.forecast(series(spark, y), horizon=6).toPandas().sort_values("step")
    assert np.allclose(one.yhat, want, atol=1e-4) and one.date.tolist() == got.date.tolist()


def test_long_and_short_series_together(spark):
    rng = np.random.default_rng(3)
    parts = {"a": rng.normal(size=700).cumsum(), "b": rng.normal(size=60) + 5, "c": rng.normal(size=30), "d": rng.normal(size=5)}
    df = None
    for k, y in parts.items():
        own = series(spark, y).withColumn("k", F.lit(k))
        df = own if df is None else df.unionByName(own)
    got = forecast.forecast(df, by=("k",), horizon=4, block_rows=100).toPandas()
    assert set(got.k) == {"a", "b", "c"}
    for k in got.k.unique():
        want, _ = forecast.damped_forecast(parts[k], 4)
        assert np.allclose(got[got.k == k].sort_values("step").yhat, want, rtol=1e-3, atol=1e-3), k


def test_smoothing_of_a_long_series(spark):
    y = np.random.default_rng(4).normal(size=2500).cumsum()
    level, trend, sse = y[0], 0.0, 0.0
    for v in y:
        base = level + 0.9 * trend
        sse += (v - base) ** 2
        new = 0.3 * v + 0.7 * base
        level, trend = new, 0.1 * (new - level) + 0.9 * 0.9 * trend
    r = forecast.smooth(series(spark, y), 0.3, 0.1, 0.9, block_rows=20).first()  # over FAN blocks: two levels of composition
    assert (r.n, r.level, r.trend, r.sse) == (2500, pytest.approx(level), pytest.approx(trend), pytest.approx(sse))


# ---------------------------------------------------------------- decomposition


def slow_line(y, width, xs, weights):
    """One local line at place xs (from 1), point by point."""
    n = len(y)
    q = min(width, n)
    left = min(max(xs - (q + 1) // 2 + 1, 1), n - q + 1)
    right = left + q - 1
    h = max(xs - left, right - xs) + ((width - n) // 2 if width > n else 0)
    w = []
    for j in range(left, right + 1):
        r = abs(j - xs)
        v = 1.0 if r <= 0.001 * h else (1 - (r / h) ** 3) ** 3 if r <= 0.999 * h else 0.0
        w.append(v * (1.0 if weights is None else weights[j - 1]))
    s = sum(w)
    if s <= 0:
        return y[min(max(xs, 1), n) - 1]
    w = [v / s for v in w]
    a = sum(v * j for v, j in zip(w, range(left, right + 1)))
    c = sum(v * (j - a) ** 2 for v, j in zip(w, range(left, right + 1)))
    b = (xs - a) / c if math.sqrt(c) > 0.001 * (n - 1) and h > 0 else 0.0
    return sum(v * (1 + b * (j - a)) * y[j - 1] for v, j in zip(w, range(left, right + 1)))


def slow_stl(y, period, outer):
    n, (ns, nt, nl) = len(y), stl.windows(period)
    trend, season, weights = [0.0] * n, [0.0] * n, None
    for turn in range(outer + 1):
        for _ in range(2):
            d = [a - b for a, b in zip(y, trend)]
            c = [0.0] * (n + 2 * period)
            for p in range(period):
                own = d[p::period]
                w = None if weights is None else weights[p::period]
                for i, xs in enumerate(range(0, len(own) + 2)):
                    c[p + i * period] = slow_line(own, ns, xs, w)
            for width in (period, period, 3):
                c2 = [sum(c[i : i + width]) / width for i in range(len(c) - width + 1)]
                c, keep = c2, (c if width == period and len(c) == n + 2 * period else None) or keep
            low = [slow_line(c, nl, i + 1, None) for i in range(n)]
            season = [keep[period + i] - low[i] for i in range(n)]
            rest = [a - b for a, b in zip(y, season)]
            trend = [slow_line(rest, nt, i + 1, weights) for i in range(n)]
        r = [abs(a - b - c_) for a, b, c_ in zip(y, season, trend)]
        h = 6 * float(np.median(r))
        weights = [1.0 if v <= 0.001 * h else (1 - (v / h) ** 2) ** 2 if v <= 0.999 * h else 0.0 for v in r] if h else [1.0] * n
    return np.array(season), np.array(trend)


def seasonal(n, period, seed=0):
    rng = np.random.default_rng(seed)
    y = 0.02 * np.arange(n) + 3 * np.sin(2 * np.pi * np.arange(n) / period) + rng.normal(scale=0.4, size=n)
    y[rng.integers(0, n, n // 50)] += 15
    return y


@pytest.mark.parametrize("n,period", [(25, 12), (60, 4), (97, 12), (31, 2)])
def test_stl_matches_the_slow_version(n, period):
    y = seasonal(n, period)
    for got, want in zip(stl.decompose_array(y, period, 3), slow_stl(y.tolist(), period, 3)):
        assert np.allclose(got, want, atol=1e-9)


def test_stl_in_blocks_equals_the_whole(spark):
    y = seasonal(1500, 6, 1)
    season, trend = stl.decompose_array(y, 6, 3)
    got = stl.stl(series(spark, y), 6, block_rows=350, outer=3).toPandas().sort_values("idx")
    assert np.allclose(got.seasonal, season, atol=1e-8) and np.allclose(got.trend, trend, atol=1e-8)
    one = stl.stl(series(spark, y), 6, outer=3).toPandas().sort_values("idx")
    assert np.allclose(one.seasonal, season) and np.allclose(one.resid, y - season - trend)


# ---------------------------------------------------------------- mutual information


def psi(n):
    return -0.57721566490153286 + sum(1 / i for i in range(1, n))


def brute_information(x, y, k=3):
    x, y = x / x.std(), y / y.std()
    dx, dy = np.abs(x[:, None] - x[None]), np.abs(y[:, None] - y[None])
    d = np.maximum(dx, dy)
    np.fill_diagonal(d, np.inf)
    r = np.sort(d, axis=1)[:, k - 1]
    nx, ny = (dx < r[:, None]).sum(1), (dy < r[:, None]).sum(1)
    return max(0.0, psi(len(x)) + psi(k) - np.mean([psi(a) + psi(b) for a, b in zip(nx, ny)]))


def test_information_matches_all_pairs(spark):
    rng = np.random.default_rng(6)
    n = 500
    x, z = rng.normal(size=n), rng.exponential(size=n)
    y = x**2 + 0.3 * rng.normal(size=n)
    pdf = pd.DataFrame({"x": x, "z": z, "lin": 2 * y + 0.05 * rng.normal(size=n), "y": y})
    got = {r.feature: r.mi for r in information.neighbor_information(frame(spark, pdf), ["x", "z", "lin"], "y", cell_points=20).collect()}
    for c in ("x", "z", "lin"):
        assert got[c] == pytest.approx(brute_information(pdf[c].to_numpy(), y), abs=1e-9)
    assert got["lin"] > got["x"] > 0.3 > 0.1 > got["z"]
    assert information.neighbor_information(frame(spark, pdf).limit(2), ["x"], "y").count() == 0


def test_information_with_tied_values(spark):
    """Whole numbers: close to the plain sum over cells."""
    rng = np.random.default_rng(7)
    a = rng.integers(0, 3, 2000)
    b = np.where(rng.random(2000) < 0.8, a, rng.integers(0, 3, 2000))
    p = pd.crosstab(a, b).to_numpy() / 2000
    plain = (p * np.log(p / p.sum(1, keepdims=True) / p.sum(0, keepdims=True))).sum()
    got = information.neighbor_information(frame(spark, pd.DataFrame({"a": a, "b": b})), ["a"], "b", cell_points=50).first()["mi"]
    assert got == pytest.approx(plain, abs=0.08)


def test_information_about_classes(spark):
    rng = np.random.default_rng(8)
    c = rng.choice(["p", "q", "r"], 400, p=[0.6, 0.3, 0.1])
    x = rng.normal(size=400) + np.where(c == "q", 3.0, 0.0)
    pdf = pd.DataFrame({"x": x, "noise": rng.normal(size=400), "c": c})
    pdf.loc[400] = [0.1, 0.2, "alone"]
    got = {r.feature: r.mi for r in information.class_information(frame(spark, pdf), ["x", "noise"], "c").collect()}
    for col in ("x", "noise"):
        v, cls = pdf[col].to_numpy()[:400], pdf.c.to_numpy()[:400]
        v = v / v.std()
        terms, m = [], []
        for i in range(400):
            own = np.abs(v[cls == cls[i]] - v[i])
            k = min(3, len(own) - 1)
            r = np.sort(own)[k]
            m.append(psi(int((np.abs(v - v[i]) < r).sum())))
            terms.append(psi(len(own)) - psi(k))
        assert got[col] == pytest.approx(max(0.0, psi(400) - np.mean(terms) - np.mean(m)), abs=1e-6)


@pytest.mark.parametrize("side,asked", [(10**6, 10**6), (150, 10**6), (40, 60)])
def test_class_information_in_ranges(spark, monkeypatch, side, asked):
    """Ranges of any size and passes over what reaches beyond them give the brute-force result, and no row is written once per column."""
    rng = np.random.default_rng(12)
    c = rng.choice(list("pqr"), 600, p=[0.6, 0.35, 0.05])
    pdf = pd.DataFrame({"x": rng.normal(size=600) + np.where(c == "q", 3.0, 0.0), "far": np.where(c == "r", rng.choice([-900.0, 900.0], 600), 0) + rng.normal(size=600), "c": c})
    pdf.loc[600], pdf.loc[601], pdf.loc[602] = [0.1, 0.2, "alone"], [5.0, -40.0, "two"], [-2.0, 700.0, "two"]
    monkeypatch.setattr(information, "SIDE_ROWS", side, raising=False)
    monkeypatch.setattr(information, "ASKED_ROWS", asked, raising=False)
    cut, written = information.cut_lineage, []

    def counted(df):
        out = cut(df)
        written.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(information, "cut_lineage", counted)
    got = {r.feature: r.mi for r in information.class_information(frame(spark, pdf).repartition(3), ["x", "far"], "c").collect()}
    pdf = pdf.drop(600)
    cls = pdf.c.to_numpy()
    for col in ("x", "far"):
        v = pdf[col].to_numpy() / pdf[col].std(ddof=0)
        terms, m = [], []
        for i in range(602):
            own = np.abs(v[cls == cls[i]] - v[i])
            k = min(3, len(own) - 1)
            m.append(psi(int((np.abs(v - v[i]) < np.sort(own)[k] * (1 - 1e-12)).sum())))
            terms.append(psi(len(own)) - psi(k))
        assert got[col] == pytest.approx(max(0.0, psi(602) - np.mean(terms) - np.mean(m)), abs=1e-6)
    if side > 603:
        assert not any(n > 603 for _, n in written)


def test_digamma(spark):
    rows = spark.createDataFrame([(n,) for n in (1, 2, 3, 10, 1000)], "n long").select("n", information.digamma(F.col("n")).alias("p")).collect()
    assert all(r.p == pytest.approx(psi(r.n), abs=1e-12) for r in rows)


# ---------------------------------------------------------------- ranks, runs, lines


@pytest.mark.parametrize("most", [0, 10**6])
def test_spearman_of_many_columns(spark, most, monkeypatch):
    from tabwise import config
    from tabwise.operators import relate

    monkeypatch.setattr(config, "BROADCAST_ROWS", most)
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"a": rng.normal(size=300), "b": rng.integers(0, 5, 300), "c": rng.normal(size=300).round(1)})
    pdf["d"] = pdf.a + pdf.b
    got = {(r.a, r.b): r.rho for r in relate.spearman_pairs(frame(spark, pdf), list("abcd"), task_rows=70).collect()}
    want = pdf.corr("spearman")
    assert len(got) == 6 and all(v == pytest.approx(want.loc[k]) for k, v in got.items())


def test_ranks_where_rows_lie(spark):
    """A value held by a third of the rows goes on over several ranges; all its rows share one rank."""
    from tabwise.operators import ordering

    rng = np.random.default_rng(12)
    v = np.concatenate([np.full(200, 1.5), rng.normal(1.5, 1, 350).round(2), [0.0, -0.0, np.inf, -np.inf]])
    pdf = pd.DataFrame({"k": rng.permutation(len(v)), "v": v})
    placed = ordering.with_average_rank(frame(spark, pdf), "v", "r", len(v), task_rows=40)
    got = {r.k: r.r for r in placed.collect()}
    assert placed.columns == ["k", "v", "r"] and got == dict(zip(pdf.k, pdf.v.rank()))
    assert ordering.with_average_rank(frame(spark, pdf).limit(0), "v", "r", 0).count() == 0


def test_runs_over_a_threshold(spark):
    from tabwise.streaming import logs

    rng = np.random.default_rng(10)
    v = np.repeat(rng.integers(0, 2, 60), rng.integers(1, 9, 60)) * 10.0
    pdf = pd.DataFrame({"ts": pd.date_range("2022-01-01", periods=len(v), freq="min"), "v": v})
    got = sorted((r.start.minute + 60 * r.start.hour, r.steps, r.firing) for r in logs.sustained(frame(spark, pdf), "v", 5.0, block_steps=7).collect())
    want, i = [], 0
    while i < len(v):
        j = i
        while j < len(v) and v[j] == v[i]:
            j += 1
        if v[i] > 5:
            want.append((i, j - i, (j if j < len(v) else j - 1) - i >= 5))
        i = j
    assert got == want


def test_trendline_over_blocks(spark):
    from tabwise.operators import charts

    pdf = pd.DataFrame({"t": np.arange(50), "y": 3 + 2.0 * np.arange(50)})
    r = charts.trendline(frame(spark, pdf), "t", "y").first()
    assert (r.slope, r.intercept) == (pytest.approx(2), pytest.approx(3))
