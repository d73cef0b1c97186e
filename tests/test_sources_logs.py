"""Readers, probes, stores and the log operators on small files."""

import datetime
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tabwise.sources import readers, stores
from tabwise.streaming import logs

ROWS = [(("N", "S", "E", "W")[i % 4], (10.0, 20.5, 30.0, 5.5)[i % 4], i) for i in range(12)]


def workbook(path, rows):
    cell = lambda v: f'<c t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f"<c><v>{v}</v></c>"
    body = "".join("<row>" + "".join(cell(v) for v in r) + "</row>" for r in rows)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>')


def got(df):
    return sorted((r["region"], float(r["revenue"]), int(r["qty"])) for r in df.collect())


def test_formats_agree(spark, tmp_path):
    (tmp_path / "t.csv").write_text("region,revenue,qty\n" + "".join(f"{a},{b},{c}\n" for a, b, c in ROWS))
    recs = [dict(region=a, revenue=b, qty=c) for a, b, c in ROWS]
    (tmp_path / "t.json").write_text(json.dumps(recs))
    (tmp_path / "t.ndjson").write_text("\n".join(map(json.dumps, recs)))
    spark.createDataFrame(ROWS, "region string, revenue double, qty long").write.parquet(str(tmp_path / "t.parquet"))
    workbook(tmp_path / "t.xlsx", [("region", "revenue", "qty"), *ROWS])
    for name in ("t.csv", "t.json", "t.ndjson", "t.parquet", "t.xlsx"):
        res = readers.load_table(spark, str(tmp_path / name))
        assert res.success and got(res.df) == sorted(ROWS), name
    assert readers.load_table(spark, "x.doc").error_code == "UNSUPPORTED_FORMAT"


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_delimiters(spark, tmp_path, sep):
    p = tmp_path / "d.csv"
    p.write_text(sep.join(["region", "units", "product"]) + "\n" + "".join(sep.join(["N", str(i), '"a,b"']) + "\n" for i in range(5)))
    res = readers.load_table(spark, str(p))
    assert res.df.columns == ["region", "units", "product"] and bool(res.warnings) == (sep != ",")


def test_bad_lines_encoding_names(spark, tmp_path):
    p = tmp_path / "b.csv"
    p.write_bytes("My Col,x-y,z\n1,2,3\n4,5\n6,7,8,9\n10,café,12\n".encode("latin-1"))
    res = readers.load_table(spark, str(p))
    assert res.df.columns == ["My_Col", "x_y", "z"] and res.warnings
    assert sorted(r["My_Col"] for r in res.df.collect()) == [1, 4, 10]
    assert "café" in [r["x_y"] for r in res.df.collect()]
    assert readers.load_table(spark, str(p), encoding="utf-8").error_code == "ENCODING_ERROR"
    (tmp_path / "e.csv").write_text("")
    assert readers.load_table(spark, str(tmp_path / "e.csv")).error_code == "EMPTY_FILE"


def test_probe_and_sample(spark, tmp_path):
    p = tmp_path / "p.csv"
    p.write_text("a,b\n1,2\n,\n , \n3,4\n")
    assert readers.probe(spark, str(p))["rows"] == 2
    assert not readers.probe(spark, str(tmp_path / "none.parquet"))["ok"]
    df = spark.range(500).toDF("id")
    a = {r["id"] for r in readers.hash_sample(df, ["id"], 40).collect()}
    assert len(a) == 40 and a == {r["id"] for r in readers.hash_sample(df.repartition(7), ["id"], 40).collect()}


def test_stores(spark, tmp_path):
    store = stores.FrameStore(spark, str(tmp_path / "f"), ttl_seconds=60)
    store.put("abc", spark.range(3), now=100.0)
    assert store.get("abc", 150.0).count() == 3 and store.get("abc", 161.0) is None and store.get("zzz", 100.0) is None
    at = lambda h: datetime.datetime(2024, 1, 1, h)
    d = stores.DashboardStore(spark, str(tmp_path / "d"))
    d.save([("s1", "o", "t1", "a.csv", "old", at(1), at(1), at(9))])
    d.save([("s1", "o", "t2", "a.csv", "new", at(2), at(2), at(9)), ("s2", "o", "t3", "b.csv", "gone", at(1), at(1), at(3))])
    assert d.get("s1", at(4)).first()["payload"] == "new" and d.count(at(4)) == 1
    assert [r["trace_id"] for r in stores.list_history(d.all(), "owner_key", "o", at(4)).collect()] == ["t2", "t1"]
    assert d.purge(at(4), str(tmp_path / "d2")).all().count() == 2
    assert stores.reopen(d.all(), "owner_key", "o", "t1", at(4)).first()["payload"] == "old"


def test_burn_rate_and_cursor(spark):
    base = datetime.datetime(2024, 1, 1)
    rows = [(i, base + datetime.timedelta(minutes=i), "error" if 30 <= i < 50 else "ok") for i in range(120)]
    ev = spark.createDataFrame(rows, "id long, ts timestamp_ntz, kind string")
    fast = logs.burn_rate(ev, F.col("kind") == "error").filter("rule = 'fast'")
    r = fast.filter(F.col("start") == F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).first()
    assert (r["total"], r["errors"], r["firing"]) == (60, 20, True)
    keyed = ev.withColumn("k", F.lit("hot")).withColumn("h", F.date_trunc("hour", "ts"))
    plain = {x["id"] for x in logs.after_cursor(keyed, "k", ["ts"], 100).collect()}
    assert plain == {x["id"] for x in logs.after_cursor(keyed, "k", ["ts"], 100, slices="h").collect()} == set(range(100, 120))
