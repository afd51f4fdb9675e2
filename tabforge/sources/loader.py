"""Sources: CSV, JSON, Parquet, XML scans, load-by-extension, delimiter
detection, post-load clean-up, preview, dataset registry (S1-S9, S15)."""

from __future__ import annotations

import csv
import io
import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.functions.columns import col, normalise_missing

# Candidate delimiters of the reference.
DELIMITER_CANDIDATES = [",", ";", "\t", "|"]
HEAD_BYTES = 1 << 16      # bytes of a file's start that are looked at to find out its form

FORMATS = {".csv": "csv", ".txt": "csv", ".tsv": "csv", ".json": "json", ".jsonl": "json",
           ".parquet": "parquet", ".pq": "parquet", ".xml": "xml"}
BAD_ROWS = {"keep": "PERMISSIVE", "drop": "DROPMALFORMED", "fail": "FAILFAST"}


def _file(spark: SparkSession, path: str):
    """(file system, status) of a path, through Hadoop, so that it may lie in any store Spark reads."""
    hp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, fs.getFileStatus(hp)


def is_folder(spark: SparkSession, path: str) -> bool:
    try:
        return bool(_file(spark, path)[1].isDirectory())
    except Exception:  # noqa: BLE001  globs and lists of paths have no status
        return False


def head(spark: SparkSession, path: str, n: int = HEAD_BYTES, encoding: str = "UTF-8") -> str:
    """The first ``n`` bytes of a file (of a folder's first data file) as text."""
    fs, status = _file(spark, path)
    while status.isDirectory():
        inner = sorted((s for s in fs.listStatus(status.getPath()) if s.getPath().getName()[:1] not in "_."
                        and (s.isDirectory() or s.getLen() > 0)), key=lambda s: s.getPath().getName())
        if not inner:
            return ""
        status = inner[0]
    stream = fs.open(status.getPath())
    try:
        return bytes(stream.readNBytes(n)).decode(encoding, errors="replace").lstrip("\ufeff")
    finally:
        stream.close()


def _records(text: str, sep: str) -> list[list[str]]:
    """Whole records of a file's start, quotes respected."""
    if len(text.encode()) >= HEAD_BYTES and "\n" in text:
        text = text[:text.rindex("\n")]
    try:
        return [r for r in csv.reader(io.StringIO(text), delimiter=sep) if r]
    except csv.Error:
        return []


def detect_delimiter(spark: SparkSession, path: str, encoding: str = "UTF-8") -> str:
    """The candidate that cuts all records at the start of the file into the same
    number of fields, the most of them; else ','.  Delimiters inside quotes don't count."""
    text, best, most = head(spark, path, encoding=encoding), ",", 1
    for d in DELIMITER_CANDIDATES:
        sizes = {len(r) for r in _records(text, d) if any(x.strip() for x in r) or len(r) > 1}
        if len(sizes) == 1 and (n := sizes.pop()) > most:
            best, most = d, n
    return best


def read_csv(spark: SparkSession, path: str, sep: str | None = None, header: bool = True,
             infer_schema: bool = True, encoding: str = "UTF-8", schema=None, bad_rows: str = "keep") -> DataFrame:
    """Header row, inferred types; blank lines are skipped by the reader.

    ``bad_rows``: rows with another number of fields are kept (cut or filled
    with nulls), dropped, or fail the read.  S7: where the header row is
    blank, the first record that is not becomes the header."""
    sep = sep or detect_delimiter(spark, path, encoding)
    r = (spark.read.option("sep", sep).option("encoding", encoding).option("ignoreLeadingWhiteSpace", True)
         .option("ignoreTrailingWhiteSpace", True).option("mode", BAD_ROWS[bad_rows]))
    if schema is not None:
        return r.option("header", header).schema(schema).csv(path)
    top = _records(head(spark, path, encoding=encoding), sep) if header else []
    if top and len(top[0]) > 1 and not any(x.strip() for x in top[0]):
        names = next((x for x in top if any(v.strip() for v in x)), None)
        if names:
            return _promoted(r.csv(path), [v.strip() for v in names], infer_schema)
    return r.option("header", header).option("inferSchema", infer_schema).csv(path)


def _promoted(raw: DataFrame, names: list[str], infer_schema: bool) -> DataFrame:
    """``raw`` (all text, no header) under ``names``, without blank rows and, once for each file that begins with a
    blank row, the row of names.  Data rows that repeat the names stay: they are equal, so it does not matter which
    of them was the header, and as many as are too many to be headers are put back."""
    names = [n or f"_c{i}" for i, n in enumerate(names[:len(raw.columns)])]
    names += raw.columns[len(names):]
    shown = [F.coalesce(F.trim(col(c)), F.lit("")) for c in raw.columns]
    blank = [s == "" for s in shown]
    named = [s == F.lit("" if n.startswith("_c") else n) for s, n in zip(shown, names, strict=True)]
    every = lambda conds: F.forall(F.array(*conds), lambda x: x)
    per_file = raw.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.count_if(every(named)).alias("names"), F.count_if(every(blank)).alias("blank"))
    held = per_file.agg(F.sum("names").alias("all"), F.count_if((F.col("names") > 0) & (F.col("blank") > 0)).alias("headers")).first()
    again = (held["all"] or 0) - max(held["headers"], 1)
    df = raw.where(~every(blank) & ~every(named)).toDF(*names)
    if again > 0:
        df = df.unionByName(raw.sparkSession.range(again).select(
            *[F.lit(None if n.startswith("_c") else n).cast("string").alias(n) for n in names]))
    if not infer_schema:
        return df
    kinds = ("bigint", "double", "boolean", "timestamp")
    row = df.agg(*[F.count_if(col(c).isNotNull() & col(c).try_cast(k).isNull()).alias(f"{k}{i}")
                   for i, c in enumerate(names) for k in kinds]).first()
    return df.select(*[col(c).cast(next((k for k in kinds if row[f"{k}{i}"] == 0), "string")).alias(c)
                       for i, c in enumerate(names)])


def read_json(spark: SparkSession, path: str, multi_line: bool | None = None, bad_rows: str = "drop") -> DataFrame:
    """A list of records -> rows, a single object (on one line or several) -> one row; JSON lines too.

    A file that is not in lines is read in one task: the format can't be split."""
    if multi_line is None:
        text = head(spark, path).lstrip()
        multi_line = text[:1] == "["
        if text[:1] == "{" and "\n" in text:
            try:
                json.loads(text[:text.index("\n")])
            except ValueError:
                multi_line = True  # the object goes on
    df = spark.read.option("multiLine", multi_line).option("mode", "FAILFAST" if bad_rows == "fail" else "PERMISSIVE").json(path)
    if "_corrupt_record" in df.columns:
        if len(df.columns) == 1:
            raise ValueError(f"{path}: JSON is neither a list of records nor an object")
        if bad_rows == "drop":
            df = df.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    return df


def read_xml(spark: SparkSession, path: str, row_tag: str | None = None) -> DataFrame:
    """Each child of the root is a row, grandchild tags are columns, all text."""
    if row_tag is None:
        row_tag = _xml_row_tag(spark, path)
    return (spark.read.format("xml").option("rowTag", row_tag)
            .option("inferSchema", False).load(path))


def _xml_row_tag(spark: SparkSession, path: str) -> str:
    text = re.sub(r"<!--.*?-->", "", head(spark, path), flags=re.S)
    tags = re.findall(r"<([A-Za-z_][\w.\-]*)(?=[\s>/])", text)
    if len(tags) < 2:
        raise ValueError(f"{path}: no row elements found")
    return tags[1]


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """S3."""
    return spark.read.parquet(path)


def load_table(spark: SparkSession, path: str, fmt: str | None = None, clean: bool | None = None,
               **options) -> DataFrame:
    """Dispatch by format or extension; an unknown extension is read as
    delimited text; a missing path raises (never returns None).  ``clean``:
    S7; by default not for Parquet, whose columns are named and typed."""
    if fmt is None:
        ext = os.path.splitext(path.rstrip("/"))[1].lower()
        fmt = FORMATS.get(ext, "csv")
        if ext == "" and is_folder(spark, path):
            fmt = "parquet"
    if fmt == "csv":
        df = read_csv(spark, path, **options)
    elif fmt == "json":
        df = read_json(spark, path, **options)
    elif fmt == "parquet":
        df = read_parquet(spark, path)
    elif fmt == "xml":
        df = read_xml(spark, path, **options)
    else:
        raise ValueError(f"unsupported format {fmt!r}")
    if fmt != "parquet" if clean is None else clean:
        df = clean_table(df)
    return normalise_missing(df)


def strip_headers(df: DataFrame) -> DataFrame:
    """P10."""
    return df.toDF(*[c.strip() for c in df.columns])


def clean_table(df: DataFrame) -> DataFrame:
    """Strip header whitespace; drop all-null columns (unnamed
    ones included).  One aggregate pass decides."""
    df = strip_headers(df)
    row = df.agg(*[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(df.columns)]).first()
    keep = [c for i, c in enumerate(df.columns) if int(row[f"n{i}"]) > 0]
    if len(keep) == len(df.columns):
        return df
    return df.select(*[col(c) for c in keep])


def preview(df: DataFrame, n: int = 5) -> dict:
    """Shape, dtypes, first rows (nulls shown as ''), missing per column."""
    from tabforge.operators.profile import missing_summary, row_count
    rows = [{k: ("" if v is None else v) for k, v in r.asDict().items()} for r in df.limit(n).collect()]
    miss = {r["column_name"]: r["n_missing"] for r in missing_summary(df).collect()}
    return {"rows": row_count(df), "columns": len(df.columns), "dtypes": dict(df.dtypes),
            "preview": rows, "missing": miss}


def column_names(df: DataFrame) -> list[str]:
    """The header only; no job runs."""
    return list(df.columns)


def register(df: DataFrame, key: str) -> DataFrame:
    """Dataset registry = temp views."""
    df.createOrReplaceTempView(key)
    return df


def registered(spark: SparkSession, key: str) -> DataFrame:
    return spark.table(key)
