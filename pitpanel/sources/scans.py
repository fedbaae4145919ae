"""File scans: many series files in one read, text cells cleaned by expressions."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitpanel.operators.calendar import Keys
from pitpanel.operators.quality import parse_date


def scan_observations(spark: SparkSession, path: str, columns: str = "date string, value string, series_id string") -> DataFrame:
    """All (date, value) files below ``path`` in one scan; the series is the partition column, so a filter on it prunes folders.

    Cells are read as text: a broken cell becomes NULL, it does not fail the read."""
    d = spark.read.schema(columns).option("header", True).csv(path)
    return d.select("series_id", parse_date(F.col("date")).alias("ref_month"),
                    F.col("value").try_cast("double").alias("value"))


def scan_country_years(spark: SparkSession, path: str) -> DataFrame:
    """Long (country, year, value) files of several indicators, one scan, kept long."""
    return spark.read.schema("country string, year int, value double, indicator string").option("header", True).csv(path)


def scan_wide(spark: SparkSession, path: str, keys: str, measures: Sequence[str]) -> DataFrame:
    """Wide multi-measure files as (keys, series_id, value); empty cells are dropped."""
    schema = keys + ", " + ", ".join(f"{m} double" for m in measures)
    d = spark.read.schema(schema).option("header", True).csv(path)
    key_names = [k.split()[0] for k in keys.split(",")]
    return d.unpivot(key_names, list(measures), "series_id", "value").where("value is not null")


def scan_releases(spark: SparkSession, path: str) -> DataFrame:
    """Bitemporal releases (date, realtime_start, value), partitioned by entity."""
    return spark.read.schema("ref_month date, realtime_start date, value double, entity int").option("header", True).csv(path)


def clean_number(c: Column) -> Column:
    """Text to number: digit grouping of any style removed, a lone dash means zero."""
    t = F.trim(F.regexp_replace(c, ",", ""))
    return F.when(t.isin("-", "–"), F.lit(0.0)).otherwise(t.try_cast("double"))


def mixed_dates(df: DataFrame, file: str, date: str, value: str) -> DataFrame:
    """Dates in either ISO or day-first style and numbers with broken cells: both coerced."""
    return df.select(file, parse_date(F.col(date)).alias("ref_date"), F.col(value).try_cast("double").alias("value"))


def flatten_pages(pages: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Pages {columns: [...], rows: [[...]]} as one table of the named fields (text)."""
    d = pages.select("columns", F.explode("rows").alias("row")).select(F.map_from_arrays("columns", "row").alias("m"))
    return d.select(*[F.col("m").getItem(f).alias(f) for f in fields])


def agreed(value: str, where: Column, rel_tol: float = 1e-9) -> Column:
    """The one value of repeated rows; rows that differ are an error that names the place."""
    spread, size = F.max(value) - F.min(value), F.greatest(F.max(F.abs(F.col(value))), F.lit(1.0))
    refuse = F.raise_error(F.concat(F.lit("conflicting values at "), F.first(where))).cast("double")
    return F.when(spread <= rel_tol * size, F.max(value)).otherwise(refuse)


def dimension_series(rows: DataFrame, filters: dict[str, str], period: str, value: str, scale: float, unit: str = "MM") -> DataFrame:
    """Rows of one dimension combination as (ref_month, value): scaled, stamped, NULLs dropped."""
    d = rows
    for k, v in filters.items():
        d = d.where(F.col(k) == v)
    stamped = d.select(F.trunc(F.to_date(period), unit).alias("ref_month"), (F.col(value).try_cast("double") * scale).alias("value"))
    return stamped.where("value is not null").groupBy("ref_month").agg(agreed("value", F.col("ref_month").cast("string")).alias("value"))


SHAPES = 64      # sets of dimension names that a catalogue may use; a row is looked up once for each


def catalogue_series(rows: DataFrame, catalogue: DataFrame, dims: Sequence[str], period: str, value: str) -> DataFrame:
    """Every catalogued series in one pass: (series_id, ref_month, value).

    ``catalogue`` is (series_id, dims map, scale, unit); a row belongs to a series when it carries all of that
    series' dimension values. Series that name the same dimensions share a shape: a row is looked up once a
    shape, by the values it has there (an equi-join). A NULL value, and a dimension the rows lack, match nothing."""
    named = catalogue.withColumn("_shape", F.array_sort(F.map_keys("dims")))
    shapes = [r._shape for r in named.select("_shape").distinct().limit(SHAPES + 1).collect()]
    if len(shapes) > SHAPES:
        raise ValueError(f"the catalogue uses more than {SHAPES} sets of dimension names")
    none = F.array().cast("array<string>")
    asked = named.select("series_id", "scale", "unit", F.array_join("_shape", ",").alias("_shape"),
                         F.transform("_shape", lambda k: F.col("dims")[k]).alias("_values"))
    offers = [F.struct(F.lit(",".join(s)).alias("_shape"), (F.array(*[F.col(c).cast("string") for c in s]) if s else none).alias("_values"))
              for s in shapes if set(s) <= set(dims)]
    if not offers:
        offers = [F.struct(F.lit(None).cast("string").alias("_shape"), none.alias("_values"))]
    tagged = rows.select(F.col(period).alias("_period"), F.col(value).alias("_value"), F.explode(F.array(*offers)).alias("_o")).select("_period", "_value", "_o.*")
    j = tagged.where(~F.exists("_values", lambda v: v.isNull())).join(asked, ["_shape", "_values"])
    day = F.to_date("_period")
    stamp = F.when(F.col("unit") == "Q", F.trunc(day, "QUARTER")).otherwise(F.trunc(day, "MM"))
    d = j.select("series_id", stamp.alias("ref_month"), (F.col("_value").try_cast("double") * F.col("scale")).alias("value"))
    name = F.concat_ws(" ", "series_id", F.col("ref_month").cast("string"))
    return d.where("value is not null").groupBy("series_id", "ref_month").agg(agreed("value", name).alias("value"))


def crosswalk(df: DataFrame, codes: DataFrame, name: str, scale: float) -> tuple[DataFrame, DataFrame]:
    """Names replaced by member codes and values rescaled; second result: members without rows.

    ``codes`` is (name, code), a settings table that also restricts the members."""
    j = df.join(F.broadcast(codes), name).withColumn("value", F.col("value") * scale).drop(name)
    return j, codes.join(j.select("code").distinct(), "code", "left_anti")


CHUNK = 8 << 20


def open_file(path: str) -> BinaryIO:
    """A file as a stream, from any file system that Arrow knows by its address."""
    system, name = pafs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path))
    return system.open_input_stream(name)


def stream_digest(stream: BinaryIO, text: bool, chunk: int = CHUNK) -> str:
    """SHA-256 of a stream, a chunk in memory at a time; of text with CRLF read as LF, also across two chunks."""
    digest, held = hashlib.sha256(), b""
    while part := stream.read(chunk):
        if text:
            part = held + part
            held = part[-1:] if part.endswith(b"\r") else b""
            part = part[:len(part) - len(held)].replace(b"\r\n", b"\n")
        digest.update(part)
    digest.update(held)
    return digest.hexdigest()


def file_inventory(spark: SparkSession, path: str, text_suffixes: Sequence[str] = (".csv", ".txt", ".json", ".md"), exclude: str | None = None,
                   opener: Callable[[str], BinaryIO] = open_file) -> DataFrame:
    """SHA-256 of every file by its path below the root (the folders before any wildcard); text files are hashed with LF line ends, so a checkout's line-end
    setting does not matter. ``exclude`` is a regular expression on the path.

    The scan lists paths and lengths only and deals them to tasks by size; a task streams each file through
    ``opener``, so a file of any size takes one chunk of memory."""
    root = re.sub(r"^\w+:/*", "/", re.split(r"[*?\[{]", path)[0].rsplit("/", 1)[0] if re.search(r"[*?\[{]", path) else path.rstrip("/"))
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    if exclude:
        d = d.where(~F.col("path").rlike(exclude))
    suffixes = tuple(text_suffixes)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for name in batch.column("path").to_pylist():
                with opener(name) as stream:
                    found.append(stream_digest(stream, name.lower().endswith(suffixes)))
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("length"), pa.array(found, pa.string())], ["path", "length", "sha256"])

    hashed = d.mapInArrow(digests, "path string, length long, sha256 string")
    return hashed.select(F.regexp_replace("path", "^.*?" + re.escape(f"{root}/"), "").alias("file"), "length", "sha256")


def verify_inventory(before: DataFrame, after: DataFrame, key: Keys, digest: str) -> DataFrame:
    """Changed, added and removed members of two inventories."""
    b, a = before.select(*key, F.col(digest).alias("_b")), after.select(*key, F.col(digest).alias("_a"))
    j = b.join(a, list(key), "full")
    state = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return j.select(*key, state.alias("state")).where("state is not null")
