"""Relations between columns: Pearson, Spearman, Cramer's V, correlation ratio, mutual information."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwise import config
from tabwise.functions import dist
from tabwise.functions import text as tx
from tabwise.operators import ordering
from tabwise.session import cut_lineage, spread


def aligned(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows where both columns are present, as numbers (x, y)."""
    return df.select(tx.numeric(df, a).alias("x"), tx.numeric(df, b).alias("y")).filter("x is not null and y is not null")


def pearson_pairs(df: DataFrame, cols: list[str], min_rows: int = 20) -> DataFrame:
    """(a, b, r, n) for every pair in one aggregation; pairs are complete case by case."""
    num = spread(df.select(*[tx.numeric(df, c).alias(c) for c in cols]))
    pairs = list(itertools.combinations(cols, 2))
    cells = F.array(
        *[
            F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r"),
                     F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias("n"))
            for a, b in pairs
        ]
    )
    return num.agg(cells.alias("p")).select(F.inline("p")).filter(F.col("n") >= min_rows)


def insights(df: DataFrame, cols: list[str], min_r: float = config.MIN_CORRELATION, max_p: float = 0.05) -> list[dict]:
    """Strong, significant pairs; one driver-side tail probability per pair (at most 40 x 39 / 2)."""
    if len(cols) < 2:
        return []
    out = []
    for row in pearson_pairs(df, cols).collect():
        p = dist.correlation_p(row["r"], row["n"])
        if p is not None and abs(row["r"]) >= min_r and p <= max_p:
            out.append(
                {"type": "correlation", "a": row["a"], "b": row["b"], "r": row["r"], "p_value": p,
                 "strength": "strong" if abs(row["r"]) >= 0.7 else "moderate", "n": row["n"]}
            )
    return out


def insight_table(pairs: DataFrame, min_r: float = config.MIN_CORRELATION) -> DataFrame:
    """Strength labels over a (a, b, r, n) table, without the p test."""
    strength = F.when(F.abs("r") >= 0.7, "strong").otherwise("moderate")
    return pairs.filter(F.abs("r") >= min_r).withColumn("strength", strength)


def matrix(pairs: DataFrame, names: list[str]) -> DataFrame:
    """Symmetric correlation matrix, diagonal 1, absent pairs 0; one row per name, names sorted."""
    names = sorted(names)
    spark = pairs.sparkSession
    both = pairs.select("a", "b", "r").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "r"))
    full = both.unionByName(spark.createDataFrame([(n, n, 1.0) for n in names], "a string, b string, r double"))
    return full.groupBy(F.col("a").alias("name")).pivot("b", names).agg(F.first("r")).na.fill(0.0)


def top_by_strength(table: DataFrame, measure: str, keys: list[str], n: int = 25) -> DataFrame:
    return table.orderBy(F.desc(F.abs(measure)), *keys).limit(n)


def spearman_pairs(df: DataFrame, cols: list[str], min_rows: int = 8, task_rows: int | None = None) -> DataFrame:
    """(a, b, rho, n): Pearson on average ranks within the rows complete for the pair.

    Columns without gaps are ranked once for all their pairs; a column with gaps is paired with them on its
    own rows; two columns with gaps get their own ranks. Each group costs one sort per column of many values, then
    one aggregation for all its pairs.
    """
    num = spread(df.select(*[tx.numeric(df, c).alias(c) for c in cols]))
    gaps = num.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols], F.count(F.lit(1)).alias("_rows")).first()
    full = [c for c in cols if not gaps[c]]
    holes = [c for c in cols if gaps[c]]
    groups = [(full, [p for p in itertools.combinations(full, 2)])]
    groups += [([h, *full], [tuple(sorted((h, f), key=cols.index)) for f in full]) for h in holes]
    groups += [(list(p), [p]) for p in itertools.combinations(holes, 2)]
    out = None
    for members, pairs in groups:
        if pairs:
            one = _rank_correlations(num.select(*members).na.drop(), members, pairs, gaps["_rows"], task_rows)
            out = one if out is None else out.unionByName(one)
    return out.filter(F.col("n") >= min_rows)


def _rank_correlations(rows: DataFrame, members: list[str], pairs: list[tuple], total: int, task_rows: int | None, broadcast_rows: int | None = None) -> DataFrame:
    """Columns of few distinct values get their ranks by broadcast; rows are put in the order of each other column once
    and ranked where they lie."""
    most = config.BROADCAST_ROWS if broadcast_rows is None else broadcast_rows
    about = rows.agg(*[F.approx_count_distinct(c).alias(c) for c in members]).first()
    small = [c for c in members if about[c] <= most // 2]
    placed = rows
    if small:
        ranks = cut_lineage(ordering.average_ranks(rows, small, task_rows))
        for c in small:
            table = ranks.filter(F.col("name") == c).select(F.col("value").alias(c), F.col("rank").alias(f"r_{c}"))
            placed = placed.join(F.broadcast(table), c).drop(c)
    for c in members:
        if c not in small:
            placed = ordering.with_average_rank(placed, c, f"r_{c}", total, task_rows).drop(c)
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(f"r_{a}", f"r_{b}").alias("rho"), F.count(F.lit(1)).alias("n")) for a, b in pairs]
    return placed.agg(F.array(*cells).alias("p")).select(F.inline("p"))


def with_p(pairs: DataFrame, measure: str) -> list[dict]:
    return [{**r.asDict(), "p_value": dist.correlation_p(r[measure], r["n"])} for r in pairs.collect()]


def cramers_v(df: DataFrame, cats: list[str]) -> DataFrame:
    """(a, b, cramers_v): chi-squared over all cells, zero ones included, Yates-corrected for 2 x 2.

    Rows collapse to their distinct category tuples before any pair is formed.
    """
    tuples = df.select(*[F.col(c).cast("string").alias(c) for c in cats]).groupBy(*cats).agg(F.count(F.lit(1)).alias("w"))
    pairs = list(itertools.combinations(cats, 2))
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs])
    obs = (
        tuples.select("w", F.inline(cells)).filter("u is not null and v is not null")
        .groupBy("a", "b", "u", "v").agg(F.sum("w").alias("o"))
    )
    # from here on: levels x levels rows per pair (at most 50 x 50 by column selection)
    pair = Window.partitionBy("a", "b")
    m = (
        obs.withColumn("ru", F.sum("o").over(Window.partitionBy("a", "b", "u")))
        .withColumn("cv", F.sum("o").over(Window.partitionBy("a", "b", "v")))
        .withColumn("n", F.sum("o").over(pair))
        .withColumn("r", F.size(F.collect_set("u").over(pair)))
        .withColumn("k", F.size(F.collect_set("v").over(pair)))
    )
    e = F.col("ru") * F.col("cv") / F.col("n")
    diff = F.abs(F.col("o") - e)
    two = (F.col("r") == 2) & (F.col("k") == 2)
    yates = F.pow(diff - F.least(F.lit(0.5), diff), F.lit(2)) / e
    # cells never observed add their expected count: sum over observed of o*o/e, minus n, covers them
    g = m.groupBy("a", "b", "n", "r", "k").agg(
        (F.sum(F.col("o") * F.col("o") / e) - F.max("n")).alias("plain"),
        F.sum(F.when(two, yates)).alias("seen"), F.sum(F.when(two, e)).alias("seen_e"), F.count(F.lit(1)).alias("cells"),
        F.max(F.when(two, e)).alias("any_e"),
    )
    # a 2 x 2 table with empty cells: each empty cell's |O-E| equals that of the seen ones (one degree of freedom)
    missing = 4 - F.col("cells")
    per_cell = (F.col("n") - F.col("seen_e")) / F.greatest(missing, F.lit(1))
    empty_part = F.when(missing > 0, missing * F.pow(per_cell - F.least(F.lit(0.5), per_cell), F.lit(2)) / per_cell).otherwise(0.0)
    chi2 = F.when(two, F.col("seen") + empty_part).otherwise(F.col("plain"))
    v = F.sqrt(F.greatest(F.lit(0.0), chi2) / (F.col("n") * F.least(F.col("r") - 1, F.col("k") - 1)))
    return g.filter("r >= 2 and k >= 2").select("a", "b", v.alias("cramers_v"))


def correlation_ratio(df: DataFrame, cats: list[str], nums: list[str], min_rows: int = 8) -> DataFrame:
    """(category, numeric, eta): between-group share of the spread, for all category x measure pairs.

    One shuffle of per-level moments (count, mean, sum of squared deviations).
    """
    num = {c: tx.numeric(df, c) for c in nums}
    base = spread(df.select(*[F.col(c).cast("string").alias(f"cat_{c}") for c in cats], *[num[c].alias(c) for c in nums]))
    levels = [e for c in cats for e in (F.lit(c), F.col(f"cat_{c}"))]
    long = base.select(*nums, F.stack(F.lit(len(cats)), *levels).alias("category", "level")).filter("level is not null")
    per = long.groupBy("category", "level").agg(
        *[f for c in nums for f in (F.count(c).alias(f"n_{c}"), F.avg(c).alias(f"m_{c}"), F.var_pop(c).alias(f"v_{c}"))]
    )
    cells = F.array(
        *[F.struct(F.lit(c).alias("numeric"), F.col(f"n_{c}").alias("n"), F.col(f"m_{c}").alias("m"), F.col(f"v_{c}").alias("v")) for c in nums]
    )
    g = per.select("category", F.inline(cells)).filter("n > 0")
    grand = F.sum(F.col("n") * F.col("m")) / F.sum("n")
    s = g.groupBy("category", "numeric").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"), grand.alias("grand"),
        F.sum(F.col("n") * F.col("v")).alias("within"),
        (F.sum(F.col("n") * F.col("m") * F.col("m")) - F.sum(F.col("n") * F.col("m")) * grand).alias("between"),
    )
    total = F.col("within") + F.col("between")
    return s.filter((F.col("n") >= min_rows) & (F.col("groups") >= 2) & (total > 0)).select(
        "category", "numeric", F.sqrt(F.greatest(F.lit(0.0), F.col("between")) / total).alias("eta")
    )


def mutual_information(df: DataFrame, features: list[str], target: str, bins: int = 10, top: int = 15) -> DataFrame:
    """(feature, mi): binned estimate over quantile buckets (stands in for a neighbour-based one)."""
    cols = [*features, target]
    num = df.select(*[tx.numeric(df, c).alias(c) for c in cols]).na.drop()
    q = ordering.quantile_map(num, cols, tuple(i / bins for i in range(1, bins)))
    cuts = {c: sorted({v for (n, _), v in q.items() if n == c}) for c in cols}
    code = spread(num.select(*[ordering.range_index(F.col(c), cuts[c]).alias(c) for c in cols]))
    levels = [e for c in features for e in (F.lit(c), F.col(c))]
    joint = (
        code.select(F.col(target).alias("y"), F.stack(F.lit(len(features)), *levels).alias("feature", "x"))
        .groupBy("feature", "x", "y").agg(F.count(F.lit(1)).alias("w"))
    )
    # bins x bins rows per feature from here
    m = (
        joint.withColumn("wx", F.sum("w").over(Window.partitionBy("feature", "x")))
        .withColumn("wy", F.sum("w").over(Window.partitionBy("feature", "y")))
        .withColumn("n", F.sum("w").over(Window.partitionBy("feature")))
    )
    term = F.col("w") / F.col("n") * F.log(F.col("w") * F.col("n") / (F.col("wx") * F.col("wy")))
    return m.groupBy("feature").agg(F.sum(term).alias("mi")).orderBy(F.desc("mi"), "feature").limit(top)
