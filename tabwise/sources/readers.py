"""Table readers: CSV (delimiter, encoding, bad lines), Parquet, JSON, NDJSON, Excel; probes and samples."""

from __future__ import annotations

import io
import re
import zipfile
from dataclasses import dataclass, field
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwise import config
from tabwise.functions import text as tx

# Known file endings and delimiters.
FORMATS = {"csv": "csv", "parquet": "parquet", "pq": "parquet", "xlsx": "xlsx", "json": "json", "ndjson": "ndjson", "jsonl": "jsonl"}
DELIMITERS = {",": "comma", ";": "semicolon", "\t": "tab", "|": "pipe"}
SNIFF_LINES = 5_000


@dataclass
class LoadResult:
    success: bool
    df: DataFrame | None = None
    error_code: str | None = None
    detail: str | None = None
    warnings: list = field(default_factory=list)


def detect_format(path: str) -> str | None:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return FORMATS.get(name.rsplit(".", 1)[1].strip().lower()) if "." in name else None


def clean_names(names: list[str]) -> list[str]:
    """Blanks and hyphens to underscores; unnamed columns numbered."""
    out, unnamed = [], 0
    for raw in names:
        name = str(raw).strip().replace(" ", "_").replace("-", "_")
        if name.startswith("Unnamed:") or re.fullmatch(r"_c[0-9]+", name) or not name:
            name, unnamed = f"unnamed_col_{unnamed}", unnamed + 1
        out.append(name)
    return out


def normalize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*clean_names(df.columns))


def sniff_delimiter(spark: SparkSession, path: str, encoding: str = "utf-8") -> str | None:
    """The candidate that splits the first lines into the same number (two or more) of parts most often."""
    lines = spark.read.option("encoding", encoding).text(path).filter(F.trim("value") != "").limit(SNIFF_LINES)
    # separators inside double quotes do not count
    bare = F.regexp_replace("value", '"[^"]*"', "")
    parts = F.inline(F.array(*[F.struct(F.lit(d).alias("d"), (F.length(bare) - F.length(F.replace(bare, F.lit(d), F.lit("")))).alias("k")) for d in DELIMITERS]))
    counts = lines.select(parts).groupBy("d", "k").agg(F.count(F.lit(1)).alias("n")).collect()
    best = None
    total = sum(r["n"] for r in counts) / len(DELIMITERS) or 1
    for d in DELIMITERS:
        n, k = max(((r["n"], r["k"]) for r in counts if r["d"] == d and r["k"] > 0), default=(0, 0))
        if n and (best is None or (n / total, k) > best[0]):
            best = ((n / total, k), d)
    return best[1] if best else None


def is_utf8(spark: SparkSession, path: str) -> bool:
    """Whether every line of the file is valid UTF-8; the text reader keeps the bytes, so lines are tested as read."""
    return not spark.read.text(path).filter(~F.is_valid_utf8("value")).head(1)


def read_csv(spark: SparkSession, path: str, encoding: str | None = None, sep: str | None = None) -> LoadResult:
    """Header CSV with inferred types; rows with more fields than the header are skipped, short rows are padded."""
    warnings = []
    used = encoding
    if not used:
        used = "utf-8"
        if not is_utf8(spark, path):
            used = "ISO-8859-1"
            warnings.append("Not valid utf-8: read as latin1.")
    elif used.lower() in ("utf-8", "utf8") and not is_utf8(spark, path):
        return LoadResult(False, error_code="ENCODING_ERROR", detail=f"Failed to decode with encoding '{encoding}'.")
    if not spark.read.option("encoding", used).text(path).filter(F.trim("value") != "").head(1):
        return LoadResult(False, error_code="EMPTY_FILE", detail="The file is empty.")
    sep = sep or sniff_delimiter(spark, path, used) or ","
    if sep != ",":
        warnings.append(f"Looks {DELIMITERS.get(sep, sep)}-separated: columns were split on '{sep}'.")
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", used).option("multiLine", False)
    schema = reader.option("inferSchema", True).csv(path).schema
    bad = "_bad_line"
    full = T.StructType([*schema.fields, T.StructField(bad, T.StringType())])
    rows = reader.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", bad).option("enforceSchema", True).csv(path)
    # a corrupt row is too long when it still has more separators than the header outside quotes
    seps = F.length(F.regexp_replace(bad, '"[^"]*"', "")) - F.length(F.replace(F.regexp_replace(bad, '"[^"]*"', ""), F.lit(sep), F.lit("")))
    kept = rows.filter(F.col(bad).isNull() | (seps <= len(schema.fields) - 1)).drop(bad)
    return LoadResult(True, normalize_columns(kept), warnings=warnings)


def read_json(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    return spark.read.option("multiLine", not lines).json(path)


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _sheet_rows(blob: bytes) -> list[list[str | None]]:
    """Cells of the first sheet of one workbook as text."""
    with zipfile.ZipFile(io.BytesIO(blob)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_NS}si"):
                shared.append("".join(t.text or "" for t in si.iter(f"{_NS}t")))
        sheet = sorted(n for n in names if n.startswith("xl/worksheets/sheet"))[0]
        rows = []
        for row in ElementTree.fromstring(z.read(sheet)).iter(f"{_NS}row"):
            cells: dict[int, str | None] = {}
            for at, c in enumerate(row.iter(f"{_NS}c")):
                ref = re.match(r"[A-Z]+", c.get("r") or "")
                col = at
                if ref:
                    col = 0
                    for ch in ref.group():
                        col = col * 26 + ord(ch) - 64
                    col -= 1
                v = c.find(f"{_NS}v")
                if c.get("t") == "s" and v is not None:
                    cells[col] = shared[int(v.text)]
                elif c.get("t") == "inlineStr":
                    cells[col] = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
                elif v is not None:
                    cells[col] = v.text
            rows.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
        return rows


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """First sheet of every workbook under ``path``: one task per workbook, cells as text, then typed.

    All workbooks share the header of the first one.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    head = files.select("path", "content").orderBy("path").limit(1).collect()
    header = [h if h is not None else f"Unnamed: {i}" for i, h in enumerate(_sheet_rows(bytes(head[0]["content"]))[0])]
    names = clean_names(header)

    def cells(batches):
        for p in batches:
            for blob in p["content"]:
                body = _sheet_rows(bytes(blob))[1:]
                yield pd.DataFrame([[*r[: len(names)], *[None] * (len(names) - len(r))] for r in body], columns=names, dtype=object)

    raw = files.select("content").repartition(spark.sparkContext.defaultParallelism).mapInPandas(cells, T.StructType([T.StructField(n, T.StringType()) for n in names]))
    return type_text_columns(raw)


def type_text_columns(df: DataFrame) -> DataFrame:
    """Text columns that hold only plain numbers become bigint or double (one pass)."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    checks = [
        a for i, c in enumerate(texts)
        for a in (F.count(c).alias(f"n{i}"), F.count_if(F.trim(c).rlike(tx.INTEGER)).alias(f"w{i}"), F.count(tx.to_number(F.col(c))).alias(f"d{i}"))
    ]
    r = df.agg(*checks).first()
    change = {}
    for i, c in enumerate(texts):
        if r[f"n{i}"] and r[f"w{i}"] == r[f"n{i}"]:
            change[c] = F.trim(c).try_cast("bigint")
        elif r[f"n{i}"] and r[f"d{i}"] == r[f"n{i}"]:
            change[c] = tx.to_number(F.col(c))
    return df.withColumns(change) if change else df


def load_table(spark: SparkSession, path: str, fmt: str | None = None, encoding: str | None = None,
               max_rows: int | None = None, sample_key: list[str] | None = None) -> LoadResult:
    """Read any supported table; with ``max_rows`` a hash sample caps it (off by default: Spark reads it all)."""
    fmt = fmt or detect_format(path)
    if fmt is None:
        return LoadResult(False, error_code="UNSUPPORTED_FORMAT", detail=f"Unsupported file type: {path!r}")
    try:
        if fmt == "csv":
            res = read_csv(spark, path, encoding)
        elif fmt == "parquet":
            res = LoadResult(True, normalize_columns(spark.read.parquet(path)))
        elif fmt in ("json", "ndjson", "jsonl"):
            res = LoadResult(True, normalize_columns(read_json(spark, path, fmt != "json")))
        else:
            res = LoadResult(True, read_xlsx(spark, path))
    except Exception as e:  # a broken file is a result, not a crash
        return LoadResult(False, error_code="PARSE_ERROR", detail=f"Could not read the file: {e}")
    if res.success and not res.df.columns:
        return LoadResult(False, error_code="UNSUPPORTED_FORMAT", detail="The file contained no columns.")
    if res.success and max_rows is not None and res.df.count() > max_rows:
        res.df = hash_sample(res.df, sample_key or res.df.columns, max_rows)
        res.warnings.append(f"Dataset had more than {max_rows} rows; sampled down for processing.")
    return res


def hash_sample(df: DataFrame, key: list[str], n: int) -> DataFrame:
    """The ``n`` rows with the smallest md5 of their key: same sample for any partitioning.

    Spark keeps the best ``n`` per task, so no full sort happens.
    """
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key]))
    return df.withColumn("_md5", digest).orderBy("_md5", *key).limit(n).drop("_md5")


def hash_fraction(df: DataFrame, key: list[str], one_in: int) -> DataFrame:
    """About one row in ``one_in``, by key hash; no shuffle at all, the form for very large tables."""
    return df.filter(F.pmod(F.xxhash64(*key), F.lit(one_in)) == 0)


def count_data_lines(spark: SparkSession, path: str) -> int:
    """Lines with something besides separators, quotes and blanks, without the header."""
    lines = spark.read.text(path).filter(F.length(F.regexp_replace("value", "[ ,;\t\r\"']", "")) > 0)
    return max(lines.count() - 1, 0)


def probe(spark: SparkSession, path: str, fmt: str | None = None) -> dict:
    """{columns, rows, ok, reason}: size of a table against the caps; unreadable input is refused."""
    fmt = fmt or detect_format(path)
    try:
        if fmt == "csv":
            cols, rows = len(spark.read.option("header", True).csv(path).columns), count_data_lines(spark, path)
        elif fmt == "parquet":
            df = spark.read.parquet(path)
            cols, rows = len(df.columns), df.count()  # answered from the file footers
        elif fmt in ("json", "ndjson", "jsonl"):
            df = read_json(spark, path, fmt != "json")
            cols, rows = len(df.columns), df.count()
        elif fmt == "xlsx":
            cols, rows = len(read_xlsx(spark, path).columns), None
        else:
            return {"ok": False, "reason": "unsupported", "columns": None, "rows": None}
    except Exception:
        return {"ok": False, "reason": "unreadable", "columns": None, "rows": None}
    reason = "too-many-columns" if cols > config.MAX_UPLOAD_COLS else "too-many-rows" if rows and rows > config.MAX_UPLOAD_ROWS else None
    return {"ok": reason is None, "reason": reason, "columns": cols, "rows": rows}


def markup_rows(df: DataFrame, body: str) -> DataFrame:
    """Rows whose body is a web page instead of a table."""
    return df.withColumn("is_markup", tx.looks_like_markup(F.col(body)))
