"""Feature matrices as plain double columns: median-filled numbers and one-hot categories, optionally scaled."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwise import config
from tabwise.functions import text as tx
from tabwise.operators import ordering


@dataclass
class Matrix:
    """How to turn a table into features; small enough to store beside a model."""

    numeric: list[str]
    levels: dict[str, list[str]] = field(default_factory=dict)
    medians: dict[str, float] = field(default_factory=dict)
    means: dict[str, float] = field(default_factory=dict)
    stds: dict[str, float] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        return [*self.numeric, *[f"{c}={v}" for c, vs in self.levels.items() for v in vs]]

    @property
    def source(self) -> dict[str, str]:
        return {**{c: c for c in self.numeric}, **{f"{c}={v}": c for c, vs in self.levels.items() for v in vs}}

    @property
    def inputs(self) -> list[str]:
        return [*self.numeric, *self.levels]

    def raw(self, df: DataFrame) -> list[Column]:
        """Input columns in a fixed form: numbers as double (missing -> median), categories as text."""
        nums = [F.coalesce(tx.finite(tx.numeric(df, c)), F.lit(self.medians.get(c, 0.0))).alias(c) for c in self.numeric]
        return nums + [F.col(c).cast("string").alias(c) for c in self.levels]

    def features(self, scaled: bool = False) -> list[Column]:
        """f0, f1, ... over raw columns; a category never seen in fitting is all zeros."""
        cells = [F.col(c) for c in self.numeric]
        cells += [F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0)) for c, vs in self.levels.items() for v in vs]
        out = []
        for i, (name, cell) in enumerate(zip(self.names, cells)):
            if scaled:
                cell = (cell - F.lit(self.means[name])) / F.lit(self.stds[name] or 1.0)
            out.append(cell.alias(f"f{i}"))
        return out

    def assemble(self, df: DataFrame, keep: list[str], scaled: bool = False) -> DataFrame:
        """(keep..., f0.., features) with a vector column for MLlib."""
        wide = df.select(*keep, *self.features(scaled))
        cols = [f"f{i}" for i in range(len(self.names))]
        return VectorAssembler(inputCols=cols, outputCol="features").transform(wide)


def fit_matrix(df: DataFrame, numeric: list[str], categorical: list[str] = (), scale: bool = False) -> Matrix:
    """Medians, category levels (fewest first, within the width limit) and, if asked, mean and spread."""
    num = df.select(*[tx.finite(tx.numeric(df, c)).alias(c) for c in numeric])
    medians = {n: v for (n, _), v in ordering.quantile_map(num, numeric, (0.5,)).items()} if numeric else {}
    levels: dict[str, list[str]] = {}
    if categorical:
        cells = [e for c in categorical for e in (F.lit(c), F.col(c).cast("string"))]
        found = df.select(F.stack(F.lit(len(categorical)), *cells).alias("c", "v")).filter("v is not null").distinct()
        per: dict[str, list[str]] = {}
        # one level more than allowed is enough to tell that a column has too many
        order = Window.partitionBy("c").orderBy("v")
        capped = found.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= config.ML_MAX_CAT_CARDINALITY + 1)
        for r in capped.collect():
            per.setdefault(r["c"], []).append(r["v"])
        width = len(numeric)
        for c in sorted(per, key=lambda c: (len(per[c]), categorical.index(c))):
            if 2 <= len(per[c]) <= config.ML_MAX_CAT_CARDINALITY and width + len(per[c]) <= config.ML_MAX_FEATURES:
                levels[c] = sorted(per[c])
                width += len(per[c])
    m = Matrix(list(numeric), levels, medians)
    if scale:
        wide = df.select(*m.raw(df)).select(*m.features())
        r = wide.agg(*[a for i in range(len(m.names)) for a in (F.avg(f"f{i}").alias(f"m{i}"), F.stddev_pop(f"f{i}").alias(f"s{i}"))]).first()
        m.means = {n: r[f"m{i}"] or 0.0 for i, n in enumerate(m.names)}
        m.stds = {n: r[f"s{i}"] or 0.0 for i, n in enumerate(m.names)}
    return m


def drop_empty_rows(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows with at least one value among ``cols``."""
    return df.filter(F.coalesce(*[F.col(c).cast("string") for c in cols]).isNotNull())
