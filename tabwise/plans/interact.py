"""Guarded interactions: filter, calculate, stamp with a provenance token; questions routed to calculations."""

from __future__ import annotations

import hashlib
from collections import OrderedDict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwise import config
from tabwise.operators import calc, filters
from tabwise.operators.contract import Contract
from tabwise.operators.filters import SpecError


def derived_token(base: str, canonical: str) -> str:
    return f"derived:{base}#{hashlib.sha256(f'{base}|{canonical}'.encode()).hexdigest()[:16]}"


def plan_interaction(df: DataFrame, contract: Contract, spec: dict) -> DataFrame:
    """The calculation's DataFrame over the filtered rows, with the token chained over the filters.

    Raises SpecError before any job when the contract refuses the request.
    """
    name = spec.get("calculation")
    if name not in calc.CALCULATIONS:
        raise SpecError(f"Unknown calculation '{name}'")
    rows = filters.apply_filters(df, spec.get("filters"), set(contract.fields))
    out = calc.CALCULATIONS[name](rows, contract, **(spec.get("params") or {}))
    canonical = calc.canonical_spec(spec)
    digest = F.substring(F.sha2(F.concat(F.col("token"), F.lit("|"), F.lit(canonical)), 256), 1, 16)
    return out.withColumn("derived_token", F.concat(F.lit("derived:"), "token", F.lit("#"), digest))


def run_interaction(df: DataFrame, contract: Contract, spec: dict) -> dict:
    """Answer one request; a bad request or an empty selection is a status, not an exception."""
    try:
        rows = filters.apply_filters(df, spec.get("filters"), set(contract.fields))
        out = plan_interaction(df, contract, spec)
    except (SpecError, TypeError) as e:
        return {"status": "error", "error": str(e)}
    n = rows.count()
    if n == 0:
        return {"status": "empty", "rows_after": 0, "filters": spec.get("filters") or []}
    found = [r.asDict() for r in out.collect()]
    if not found or all(v is None for k, v in found[0].items() if k in ("value", "pearson")) and ({"value", "pearson"} & set(found[0])):
        return {"status": "error", "error": "No numeric values for this calculation."}
    return {"status": "ok", "calculation": spec["calculation"], "rows_after": n, "filtered": bool(spec.get("filters")), "result": found, "derived_token": found[0]["derived_token"]}


class InteractionMemo:
    """Answers of repeated requests, keyed by fingerprint and canonical spec; the oldest entries fall out."""

    def __init__(self, entries: int = config.INTERACT_MEMO_ENTRIES):
        self.entries, self.kept = entries, OrderedDict()

    @staticmethod
    def key(fingerprint: str, spec: dict) -> str:
        return hashlib.sha256(f"{fingerprint}|{calc.canonical_spec(spec)}".encode()).hexdigest()

    def run(self, fingerprint: str, df: DataFrame, contract: Contract, spec: dict) -> dict:
        k = self.key(fingerprint, spec)
        if k in self.kept:
            self.kept.move_to_end(k)
            return {**self.kept[k], "cached": True}
        out = run_interaction(df, contract, spec)
        if out["status"] == "ok":
            self.kept[k] = out
            while len(self.kept) > self.entries:
                self.kept.popitem(last=False)
        return {**out, "cached": False}


# ---------------------------------------------------------------- questions

# Words that name a metric, in the order they are looked for.
METRIC_WORDS = (
    ("average", "mean"), ("mean", "mean"), ("median", "median"), ("std", "std"), ("deviation", "std"), ("maximum", "max"),
    ("highest", "max"), ("max", "max"), ("minimum", "min"), ("lowest", "min"), ("min", "min"), ("total", "sum"), ("sum", "sum"),
)


def _flat(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def _squash(name: str) -> str:
    return "".join(ch for ch in name.lower() if ch.isalnum() and ch.isascii())


def _mentioned(text: Column, names: list[str]) -> Column:
    """Names that occur in the text, longest first."""
    ordered = [n for n in sorted(names, key=len, reverse=True) if _squash(n)]
    hits = [F.when(_flat(text).contains(_squash(n)), F.lit(n)) for n in ordered]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def route_questions(questions: DataFrame, text: str, column_roles: dict[str, str]) -> DataFrame:
    """Adds (tool, arg_a, arg_b, metric): which calculation answers each question, by keyword rules.

    All questions are routed in one projection; equal plans can then be run once.
    """
    pick = lambda *rs: [c for c, r in column_roles.items() if r in rs]
    measures, dims = pick("numeric", "ratio", "year"), pick("categorical", "identifier", "boolean", "datetime")
    all_nums, all_cats = pick("numeric", "ratio"), pick("categorical", "boolean")
    q = F.lower(F.col(text))
    arr = lambda xs: F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<string>")
    at = lambda a, i: F.get(a, F.lit(i))
    base = (
        questions.withColumn("_q", q)
        .withColumn("_hit", _mentioned(F.col(text), list(column_roles)))
        .withColumn("_nums", F.filter("_hit", lambda c: c.isin(*measures) if measures else F.lit(False)))
        .withColumn("_cats", F.filter("_hit", lambda c: c.isin(*dims) if dims else F.lit(False)))
        .withColumn("_by", F.regexp_extract("_q", r"\bby\s+([a-z0-9_ ]+)", 1))
    )
    pool = F.when(F.size("_nums") >= 2, F.col("_nums")).otherwise(arr(all_nums))
    has_corr = F.col("_q").rlike("correlat|relationship|related|associat") & (F.size(pool) >= 2)
    by_dims = pick("categorical", "identifier", "boolean", "year", "datetime")
    named = F.filter(_mentioned(F.col("_by"), list(column_roles)), lambda c: c.isin(*by_dims) if by_dims else F.lit(False))
    group = F.coalesce(F.when(F.col("_by") != "", at(named, 0)), at(F.col("_cats"), 0), at(arr(all_cats), 0))
    value = F.coalesce(at(F.col("_nums"), 0), at(arr(all_nums), 0))
    grouped = ((F.col("_by") != "") | F.col("_q").contains("breakdown") | F.col("_q").contains("per ")) & group.isNotNull() & value.isNotNull()
    metric = F.lit(None).cast("string")
    for word, m in reversed(METRIC_WORDS):
        metric = F.when(F.col("_q").contains(word), m).otherwise(metric)
    counted = F.coalesce(at(F.col("_hit"), 0), at(arr(all_cats), 0))
    how_many = F.col("_q").rlike("how many|count|number of") & counted.isNotNull()
    top_col = F.coalesce(at(F.col("_cats"), 0), at(arr(all_cats), 0))
    top = (F.col("_q").rlike("top|most common|frequent|distribution") | (F.size("_cats") > 0)) & top_col.isNotNull()
    answer = lambda tool, a, b, m: F.struct(F.lit(tool).alias("tool"), a.alias("arg_a"), b.alias("arg_b"), m.alias("metric"))
    none = F.lit(None).cast("string")
    step = (
        F.when(has_corr, answer("correlation", at(pool, 0), at(pool, 1), none))
        .when(grouped, answer("aggregate", group, value, F.when(F.col("_q").rlike("total|sum"), F.lit("sum")).otherwise(F.lit("mean"))))
        .when(metric.isNotNull() & value.isNotNull(), answer("column_stat", value, none, metric))
        .when(how_many, answer("column_stat", counted, none, F.lit("count")))
        .when(top, answer("top_categories", top_col, none, none))
        .when(value.isNotNull(), answer("column_stat", value, none, F.lit("mean")))
    )
    return base.withColumn("_s", step).select(*questions.columns, "_s.tool", "_s.arg_a", "_s.arg_b", "_s.metric")


def answer_questions(df: DataFrame, contract: Contract, questions: DataFrame, text: str) -> DataFrame:
    """Adds (status, answer) to every question: each distinct routed plan runs once, answers are joined back."""
    roles = {n: f.role for n, f in contract.fields.items()}
    routed = route_questions(questions, text, roles)
    keys = ["tool", "arg_a", "arg_b", "metric"]
    plans = routed.select(*keys).distinct().limit(10_000).collect()  # few: tools x columns x metrics
    rows = []
    for p in plans:
        params = {
            "correlation": dict(a=p["arg_a"], b=p["arg_b"]),
            "aggregate": dict(group_by=p["arg_a"], value=p["arg_b"], agg=p["metric"]),
            "column_stat": dict(column=p["arg_a"], metric=p["metric"]),
            "top_categories": dict(column=p["arg_a"], n=5),
        }.get(p["tool"])
        out = run_interaction(df, contract, {"calculation": p["tool"], "params": params}) if params else {"status": "no_answer", "error": ""}
        rows.append((*[p[k] for k in keys], out["status"], _summary(p, out)))
    table = df.sparkSession.createDataFrame(rows, "tool string, arg_a string, arg_b string, metric string, status string, answer string")
    same = [routed[k].eqNullSafe(table[k]) for k in keys]
    return routed.join(F.broadcast(table), same, "left").select(*[routed[c] for c in routed.columns], "status", "answer")  # one row per plan


def _summary(plan, out: dict) -> str:
    if out["status"] != "ok":
        return out.get("error", "")
    r = out["result"]
    if plan["tool"] == "correlation":
        return f"Pearson r({r[0]['a']}, {r[0]['b']}) = {r[0]['pearson']:.4f} (n={r[0]['n']})"
    if plan["tool"] == "aggregate":
        return f"{plan['metric']} by {plan['arg_a']}: " + ", ".join(f"{x['group']}={x['value']:,.4g}" for x in r[:5])
    if plan["tool"] == "top_categories":
        return f"Top {plan['arg_a']}: " + ", ".join(f"{x['value']} ({x['count']})" for x in r)
    return f"{plan['metric']} of {plan['arg_a']} = {r[0]['value']:,.4g}"
