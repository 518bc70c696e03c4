"""Scans. Schemas are declared, never inferred by a pass over the data."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions.clock import shift


def _raw_csv(spark: SparkSession, path: str, names: dict[str, str]) -> DataFrame:
    """Read by header name: file columns may come in any order and number."""
    text = spark.read.option("header", True).option("inferSchema", False).csv(path)
    present = [F.col(f"`{raw}`").alias(new) for raw, new in names.items() if raw in text.columns]
    return text.select(*present)


def scan_generation(spark: SparkSession, folder: str) -> DataFrame:
    return _raw_csv(spark, f"{folder}/{S.GENERATION_FILE}", S.GENERATION_NAMES)


def scan_weather(spark: SparkSession, folder: str) -> DataFrame:
    return _raw_csv(spark, f"{folder}/{S.WEATHER_FILE}", S.WEATHER_NAMES)


def scan_site_details(spark: SparkSession, folder: str) -> DataFrame:
    raw = _raw_csv(spark, f"{folder}/{S.SITE_DETAILS_FILE}", S.SITE_DETAILS_NAMES)
    numbers = {"site_id": "long", "campus_id": "long", "capacity_kwp": "double", "n_panels": "long",
               "latitude": "double", "longitude": "double"}
    return raw.withColumns({n: F.col(n).try_cast(t) for n, t in numbers.items() if n in raw.columns})


def scan_tabular(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """Every file of one kind (``csv``, ``tsv``, ``parquet``) anywhere under ``root``."""
    patterns = {"csv": "*.csv", "tsv": "*.tsv", "parquet": "*.{parquet,pq}"}
    if kind not in patterns:
        raise ValueError(f"kind must be one of {sorted(patterns)}")
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", patterns[kind])
    if kind == "parquet":
        return reader.parquet(root)
    return reader.option("header", True).option("sep", "\t" if kind == "tsv" else ",").csv(root)


def scan_site(df: DataFrame, site_id: int) -> DataFrame:
    """Rows of one site; on a table partitioned by site this prunes directories."""
    return df.where(F.col("site_id") == site_id)


def time_range(df: DataFrame, start: str | None = None, end: str | None = None,
               ts: str = "timestamp") -> DataFrame:
    """Inclusive range pushed to the scan; an end without a time of day means its whole day.

    On a table that has the months of its rows as columns ``year`` and ``month``, the months follow from the range: where
    they are directories, only those are read.
    """
    out = df
    if {"year", "month"} <= set(df.columns):
        for bound, sign in ((start, 1), (end, -1)):
            if bound is not None:
                year, month = (int(x) for x in bound.strip()[:7].split("-"))
                # the months of a part of the range as one number: a filter on directories alone
                out = out.where((F.col("year") * 12 + F.col("month") - (year * 12 + month)) * sign >= 0)
    if start is not None:
        out = out.where(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        limit = F.lit(end).cast("timestamp_ntz")
        if len(end.strip()) <= 10 or end.strip()[10:].strip("T 0:.") == "":
            limit = shift(limit, hours=23, minutes=59, seconds=59)
        out = out.where(F.col(ts) <= limit)
    return out


def scan_calibration(spark: SparkSession, path: str, metadata_key: str = "calibration",
                     multi_line: bool = True) -> DataFrame:
    """Rows ``model, method, level, regime, radius, n`` from the nested calibration JSON.

    The file maps ``"model|method|level"`` to a global radius, radii per regime and counts.
    """
    entry = "struct<global_radius:double,regime_radii:map<string,double>,n:map<string,bigint>>"
    doc = spark.read.schema(f"{metadata_key} map<string,{entry}>").option("multiLine", multi_line).json(path)
    entries = doc.select(F.explode(metadata_key).alias("key", "cal"))
    parts = F.split("key", r"\|")
    everywhere = F.create_map(F.lit("global"), F.col("cal.global_radius"))
    return entries.select(
        parts[0].alias("model"), parts[1].alias("method"), parts[2].alias("level"),
        F.explode(F.map_concat(everywhere, F.coalesce("cal.regime_radii", F.expr("map()").cast("map<string,double>")))).alias("regime", "radius"),
        F.col("cal.n").alias("_n"),
    ).select("model", "method", "level", "regime", "radius", F.try_element_at("_n", F.col("regime")).alias("n"))


def scan_metric_csvs(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """One metrics table from many CSVs, tagged with the model each belongs to."""
    out = None
    for model, path in paths.items():
        part = spark.read.option("header", True).csv(path)
        if "model" not in part.columns:
            part = part.withColumn("model", F.lit(model))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no metric files given")
    text = {"model", "split", "scope", "site_id", "protocol"}
    return out.withColumns({c: F.col(c).try_cast("double") for c in out.columns if c not in text})


def file_fingerprint(df: DataFrame) -> DataFrame:
    """Hash of the files behind a scan: name, size and modification time."""
    files = df.select(
        F.concat_ws("|", F.col("_metadata.file_name"), F.col("_metadata.file_size").cast("string"),
                    F.col("_metadata.file_modification_time").cast("string")).alias("entry")
    ).distinct()
    # entries are hashed one by one and summed, so no file list is ever gathered in one place
    return files.agg(
        F.count(F.lit(1)).alias("n_files"),
        F.sha2(F.sum(F.xxhash64("entry").cast("decimal(38,0)")).cast("string"), 256).alias("_digest"),
    ).select("n_files", F.substring("_digest", 1, 16).alias("fingerprint"))


def content_fingerprint(df: DataFrame) -> DataFrame:
    """Order-free hash of the rows themselves."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sha2(F.coalesce(F.sum(row), F.lit(0)).cast("string"), 256).alias("_digest"),
    ).select("n_rows", F.substring("_digest", 1, 16).alias("fingerprint"))


def multiset_digest(df: DataFrame) -> DataFrame:
    """Order-free digest of the rows that any engine can state: of each row's MD5 two parts of 60 bits are summed up.

    A row's text is its values parted by ``|``, null as ``-``, numbers with a fraction at six places. Sums tell
    repeated rows apart, need no order, and are combined before the shuffle.
    """
    def text(f: T.StructField) -> Column:
        value = F.col(f"`{f.name}`")
        plain = value.cast("decimal(24,6)") if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS") if isinstance(
            f.dataType, (T.TimestampNTZType, T.TimestampType)) else value
        return F.coalesce(plain.cast("string"), F.lit("-"))

    digest = F.md5(F.concat_ws("|", *[text(f) for f in df.schema.fields]).cast("binary"))
    parts = [F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)")) for at in (1, 16)]
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.md5(F.concat_ws("|", *[F.coalesce(p, F.lit(0)).cast("string") for p in parts])).alias("fingerprint"))


def verify_columns(df: DataFrame, name: str, required: list[str]) -> DataFrame:
    """One row per table: row count, missing header names, verdict and its reason."""
    missing = [c for c in required if c not in df.columns]
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(name).alias("table_name"),
        F.col("n_rows"),
        F.lit(len(required)).cast("long").alias("n_required"),
        F.lit(",".join(missing)).alias("missing_columns"),
        F.lit(not missing).alias("ok"),
        F.lit("missing columns" if missing else "columns ok").alias("detail"),
    )


def verify_files(spark: SparkSession, paths: dict[str, str], required: dict[str, list[str]], kind: str = "parquet", **options: str) -> DataFrame:
    """A verdict for each required file (name to path): absent and unreadable files are reported, not raised."""
    parts = []
    for name, columns in required.items():
        try:
            table = spark.read.format(kind).options(**options).load(paths[name])
            found = verify_columns(table, name, columns)
        except (KeyError, AnalysisException) as problem:
            lost = isinstance(problem, KeyError) or problem.getCondition() == "PATH_NOT_FOUND"
            found = spark.range(1).select(
                F.lit(name).alias("table_name"), F.lit(None).cast("long").alias("n_rows"), F.lit(len(columns)).cast("long").alias("n_required"),
                F.lit(",".join(columns)).alias("missing_columns"), F.lit(False).alias("ok"), F.lit("file not found" if lost else "unreadable").alias("detail"))
        parts.append(found)
    return reduce(DataFrame.unionByName, parts)
