"""The whole analysis of one table: load, clean, profile, classify, contract, relations, charts, ML."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwise import config
from tabwise.functions import text as tx
from tabwise.operators import anomalies, charts, clean, contract, critic, eda, forecast, relate, roles, segments, stats, supervised
from tabwise.sources import readers, stores


@dataclass
class Dashboard:
    errors: list = field(default_factory=list)
    warnings: list = field(default_factory=list)
    df: DataFrame | None = None
    profile: DataFrame | None = None
    contract: contract.Contract | None = None
    quality: dict = field(default_factory=dict)
    grain_kind: str | None = None
    role_counts: dict = field(default_factory=dict)
    insights: list = field(default_factory=list)
    kpis: list = field(default_factory=list)
    charts: list = field(default_factory=list)
    eda: dict = field(default_factory=dict)
    statistics: dict = field(default_factory=dict)
    ml: dict = field(default_factory=dict)

    def release(self) -> None:
        """Let go of the cached frame once nothing more is asked of it."""
        if self.df is not None:
            self.df.unpersist()


def quality_report(spec: contract.Contract, fields: DataFrame, gate: clean.CleanResult, crit: dict, consent: bool = False) -> dict:
    a = contract.acceptance(fields, bool(spec.grain)).first()
    return {
        "status": "ok" if a["accepted"] else "review", "reasons": list(a["reasons"]), "mean_confidence": a["mean_confidence"],
        "grain": list(spec.grain), "fingerprint": spec.schema_fingerprint, "sensitivity": spec.sensitivity,
        "pii_columns": gate.pii_columns, "ai_consent_required": spec.pii_blocked and not consent, "cleaning": gate.manifest,
        "vetoes": crit["vetoes"], "flags": crit["flags"], "auto_accepted": a["accepted"],
    }


def build_dashboard(spark: SparkSession, path: str | None = None, df: DataFrame | None = None, key: list[str] | None = None,
                    with_statistics: bool = False, with_ml: bool = False, review_gate: bool = False,
                    contracts: stores.ContractStore | None = None, suggestions: DataFrame | None = None, now: float = 0.0) -> Dashboard:
    """Everything the analysis shows. The cleaned frame is cached once (``release`` lets go of it), the profile is computed once.

    ``suggestions`` (name, role) are outside opinions on roles, taken where the guard of keys allows it. With a store of
    ``contracts``, a table whose fingerprint has a locked contract is read by that contract, roles included, and no
    review is asked for; other accepted contracts are kept there.
    """
    out = Dashboard()
    if df is None:
        loaded = readers.load_table(spark, path)
        out.warnings += loaded.warnings
        if not loaded.success:
            out.errors.append(f"{loaded.error_code}: {loaded.detail}")
            return out
        df = loaded.df
    gate = clean.run_gate(clean.reshape_wide_years(df))
    out.warnings += gate.warnings
    if not gate.ok:
        out.errors.append(gate.reject_reason)
        return out
    frame = gate.df.persist()
    out.df = frame
    roled = roles.classify(frame)
    crit = critic.critique(frame, roled)
    if crit["vetoes"]:
        vetoes = spark.createDataFrame([(v["column"], v["from_role"], v["to_role"]) for v in crit["vetoes"]], "column string, from_role string, to_role string")
        roled = roles.settle(critic.apply_vetoes(roled, vetoes))
    arbitrated: list[dict] = []
    if suggestions is not None:
        settled = roles.settle(contract.role_overrides_allowed(roled, suggestions, contract.KEY_NAME))
        arbitrated = [r.asDict() for r in settled.filter("changed").select("name", "old_role", "role").collect()]
        roled = settled.drop("changed", "old_role")
    out.contract, fields = contract.compile_contract(frame, roled, gate)
    fields = roles.settle(fields)
    out.quality = quality_report(out.contract, fields, gate, crit) | {"arbitrated": arbitrated, "reused_contract": False}
    known = contracts.locked(out.contract.schema_fingerprint) if contracts else None
    if known:
        out.contract = replace(known, n_rows=out.contract.n_rows, n_cols=out.contract.n_cols, aggregate_row_count=out.contract.aggregate_row_count,
                               pii_blocked=known.pii_blocked or out.contract.pii_blocked, sensitivity=max(known.sensitivity, out.contract.sensitivity, key=("public", "sensitive").index))
        roled = _roles_of(out.contract, roled)
        out.quality |= {"status": "ok", "reused_contract": True, "grain": list(known.grain)}
    out.profile = roled
    if out.quality["status"] == "ok":
        out.contract = out.contract if known else out.contract.with_lock(bump=False)
        if contracts and not known:
            contracts.save(out.contract, now)
    elif review_gate:
        return out
    _analyse(out, frame, roled, key, with_statistics, with_ml)
    return out


def _analyse(out: Dashboard, frame: DataFrame, roled: DataFrame, key, with_statistics: bool, with_ml: bool) -> None:
    spark = frame.sparkSession
    rows = roled.orderBy("position").collect()
    frame = tx.typed_dates(frame, [r["name"] for r in rows if r["role"] == "datetime"])
    measures = [r["name"] for r in rows if r["role"] == "numeric" and (r["std"] or 0) > 0.001]
    stored = [c for c in measures if frame.schema[c].dataType.typeName() != "string"]
    views = {r["name"]: r["v_year"] for r in eda.profile_view(roled).select("name", "v_year").collect()}
    stored = [c for c in stored if not views[c]]
    out.insights = relate.insights(frame, stored)
    found = eda.settle_insights(spark, out.insights)
    out.grain_kind = roles.dataset_kind(roled).first()[0]
    out.role_counts = {r["role"]: r["n"] for r in roles.role_counts(roled).collect()}
    out.eda = eda_summary(frame, roled, stored, len(out.insights), out.contract.n_rows)
    if with_statistics:
        out.statistics = stats.report(frame, roled, key or list(out.contract.grain) or None)
    if with_ml:
        out.ml = ml_summary(frame, roled, key or out.contract.grain or frame.columns)
    out.kpis = [r.asDict() for r in eda.kpis(roled, found).collect()]
    specs = [r.asDict() for r in eda.chart_specs(roled, found).collect()]
    failed: list = []
    keys = frozenset(n for n, f in out.contract.fields.items() if f.is_identifier)
    out.charts = charts.build_charts(frame, specs, failed=failed, identifiers=keys)
    if not out.charts:  # nothing worth a spec: the standard set
        out.charts = charts.default_charts(frame, [r for r in rows if r["name"] not in keys])
    out.warnings += [f"chart {f.get('id')}: {f['error']}" for f in failed]


def eda_summary(frame: DataFrame, roled: DataFrame, measures: list[str], n_corr: int, n_rows: int) -> dict:
    """Blocks are independent: one that fails is reported and left empty."""
    blocks = {
        "key_indicators": lambda: eda.key_indicators(roled, n_rows).orderBy("seq"),
        "outliers": lambda: eda.iqr_outliers(frame, measures) if measures else None,
        "use_cases": lambda: eda.use_cases(roled),
        "recommendations": lambda: eda.recommendations(roled, n_corr),
        "critical_totals": lambda: eda.critical_totals(frame, roled),
    }
    out = {"errors": []}
    for name, job in blocks.items():
        try:
            table = job()
            out[name] = [r.asDict(True) for r in table.collect()] if table is not None else []
        except Exception as e:
            out[name] = []
            out["errors"].append(f"{name}_failed: {e}")
    return out


def ml_summary(frame: DataFrame, roled: DataFrame, key: list[str]) -> dict:
    nums, cats = supervised.feature_columns(roled)
    out = {}
    target = supervised.pick_target(roled).first()
    out["supervised"] = (
        supervised.driver_report(frame, target["name"], target["task"], nums, cats, list(key)) if target else {"available": False, "reason": "no-suitable-target"}
    )
    seg = segments.segment(frame, nums, cats, list(key))
    out["segments"] = {"available": False} if seg is None else {
        "available": True, "k": seg[2], "silhouette": round(seg[3], 4), "sizes": [r.asDict() for r in segments.sizes(seg[0]).orderBy("label").collect()],
    }
    if len(nums) >= 2:
        summary, top, worst = anomalies.row_anomalies(frame, nums, list(key))
        out["anomalies"] = {**summary.first().asDict(), "top_features": [r.asDict() for r in top.collect()], "example_rows": [r.asDict() for r in worst.collect()]}
    out["forecast"] = forecast.forecast_table(frame, roled)
    return out


def rebuild(out: Dashboard, overrides: DataFrame) -> Dashboard:
    """Re-render after human corrections: roles come from the locked contract, nothing is re-classified."""
    spark = overrides.sparkSession
    names = list(out.contract.fields)
    plain = spark.createDataFrame(
        [(i, f.name, f.dtype, f.role, f.domain, float(f.confidence), f.aggregation, f.is_identifier, f.is_year, f.is_ratio, f.sensitivity, list(f.pii_entities), list(f.allowed_aggregations), list(f.allowed_charts))
         for i, f in enumerate(out.contract.fields[n] for n in names)],
        "position int, name string, dtype string, role string, domain string, confidence double, aggregation string, is_identifier boolean, is_year boolean, is_ratio boolean, sensitivity string, pii_entities array<string>, allowed_aggregations array<string>, allowed_charts array<string>",
    )
    locked, fields = contract.apply_overrides(out.contract, plain, overrides)
    roled = _roles_of(locked, out.profile)
    new = Dashboard(df=out.df, profile=roled, contract=locked, quality={**out.quality, "status": "ok", "human_reviewed": True, "auto_accepted": False})
    _analyse(new, out.df, roled, None, False, False)
    return new


def _roles_of(spec: contract.Contract, roled: DataFrame) -> DataFrame:
    """The profile with the roles and tags a contract gives its columns."""
    given = roled.sparkSession.createDataFrame([(n, f.role, f.aggregation, f.domain) for n, f in spec.fields.items()], "name string, given_role string, aggregation string, given_domain string")
    tags = F.array_compact(F.array(F.when(F.col("aggregation") == "additive", "additive").when(F.col("aggregation") == "rate", "rate"), F.when(F.col("given_domain") == "monetary", "monetary")))
    joined = roled.join(F.broadcast(given), "name").withColumn("role", F.col("given_role")).withColumn("semantic_tags", tags)  # one row per column
    return roles.settle(joined.drop("given_role", "aggregation", "given_domain"))
