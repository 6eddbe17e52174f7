"""Scans of station files and climate indices, and the sinks for reports.

Files are read as text by Spark and parsed with built-in functions; header rows are found by what they hold, not by line
number, so that a file may be split between tasks and many files be read at once.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions import columns as c

HEADER = "time,"


def station_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of station files as `time` and doubles; whatever comes before a file's header line, which begins with `time,`, is skipped.

    Cells that are not numbers become null; units in parentheses are stripped from the names. Each file is read by its own
    header, so files may order their columns alike or not; columns that a file lacks, and cells that a
    line lacks, are null. Data lines are those that begin with a date, wherever they stand. Files without header give no rows.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    heads = lines.where(F.col("value").startswith(HEADER)).groupBy("file").agg(F.min("value").alias("head"))
    # the driver needs the names that occur, so it gets each distinct header once; which file has which stays in Spark
    layouts = [[strip_unit(x) for x in r["head"].split(",")] for r in heads.select("head").distinct().orderBy("head").collect()]
    if not layouts:
        raise ValueError(f"{path} has no line that begins with {HEADER!r}")
    names = list(dict.fromkeys(n for own in layouts for n in own[1:]))
    stripped = F.transform(F.split("head", ","), lambda x: F.regexp_replace(F.trim(x), r"\s*\(.*?\)\s*$", ""))
    data = lines.where(F.rlike("value", F.lit(r"^\d{4}-\d{2}-\d{2}"))).join(heads.select("file", stripped.alias("own")), "file").withColumn("cells", F.split("value", ","))
    cell = lambda n: F.get("cells", (F.array_position("own", n) - 1).cast("int"))
    numbers = [c.no_nan(F.trim(cell(n)).try_cast("double")).alias(n) for n in names]
    return data.select(F.replace(F.get("cells", F.lit(0)), F.lit("T"), F.lit(" ")).try_cast("timestamp_ntz").alias("time"), *numbers)


def strip_unit(name: str) -> str:
    return re.sub(r"\s*\(.*?\)\s*$", "", name.strip())


def station_metadata(spark: SparkSession, path: str) -> DataFrame:
    """latitude, longitude and elevation from the two lines before the data."""
    lines = spark.read.text(path).where(~F.rlike("value", F.lit(r"^\d{4}-\d{2}-\d{2}")) & F.rlike("value", F.lit(r"^-?\d")))
    at = lambda i: F.expr(f"try_cast(split(value, ',')[{i}] as double)")
    return lines.limit(1).select(at(0).alias("latitude"), at(1).alias("longitude"), at(2).alias("elevation"))


def bind(df: DataFrame, patterns: dict[str, str], exact: tuple[str, ...] = ()) -> DataFrame:
    """`time` and the wanted columns: each is the first whose name holds the pattern, whatever its case (names in `exact` must match whole); null where none does."""
    picked = []
    for name, pattern in patterns.items():
        found = next((x for x in df.columns if (x.lower() == pattern.lower() if name in exact else pattern.lower() in x.lower())), None)
        picked.append((c.no_nan(f"`{found}`") if found else F.lit(None).cast("double")).alias(name))
    return df.select("time", *picked)


def keep_first(frames: list[DataFrame], key: str = "time") -> DataFrame:
    """Append sources; of rows with equal keys that of the first source stays: one aggregate, no sort."""
    tagged = [f.withColumn("_src", F.lit(i)) for i, f in enumerate(frames)]
    union = tagged[0]
    for f in tagged[1:]:
        union = union.unionByName(f, allowMissingColumns=True)
    rest = [x for x in union.columns if x not in (key, "_src")]
    return union.groupBy(key).agg(F.min_by(F.struct(*rest), "_src").alias("_r")).select(key, *[f"_r.{x}" for x in rest])


def first_available(spark: SparkSession, paths: list[str], reader) -> DataFrame:
    """The first of several paths that Spark can read (a finer source before a coarser one)."""
    from pyspark.errors import AnalysisException

    for p in paths:
        try:
            return reader(spark, p)
        except AnalysisException:
            continue
    raise FileNotFoundError(f"none of {paths} can be read")


def epoch_csv(spark: SparkSession, path: str, value: str, epoch: str) -> DataFrame:
    """time (days since `epoch` as a number) and one value; the date is normalised, so sources with other epochs join."""
    raw = spark.read.csv(path, header=True)
    micros = (F.col("time").cast("double") * 86_400_000_000).cast("long") + F.unix_micros(F.lit(epoch).cast("timestamp"))
    return raw.select(F.to_date(F.timestamp_micros(micros)).alias("date"), c.no_nan(f"`{value}`").alias("value"))


def weekly_index(spark: SparkSession, path: str) -> DataFrame:
    """Rows `start,end,value` without a header, keyed by the end date, as monthly means."""
    raw = spark.read.csv(path, schema="start string, stop string, value double")
    date = F.coalesce(*[F.expr(f"to_date(try_to_timestamp(stop, '{f}'))") for f in ("yyyy-MM-dd", "yyyyMMdd", "dd-MM-yyyy", "yyyy/MM/dd")])
    return raw.select(date.alias("date"), c.no_nan("value").alias("value")).where("date is not null").groupBy(F.trunc("date", "month").alias("month")).agg(F.avg("value").alias("value"))


def monthly_matrix(spark: SparkSession, path: str, missing: float = 99.90) -> DataFrame:
    """Lines of a year and twelve values, as one row a month; the sentinel is dropped."""
    parts = F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")
    rows = spark.read.text(path).select(parts.alias("p")).where((F.size("p") == 13) & F.rlike(F.col("p")[0], F.lit(r"^\d{4}$")))
    long = rows.select(F.col("p")[0].cast("int").alias("y"), F.posexplode(F.slice("p", 2, 12)).alias("m", "v"))
    return long.select(F.make_date("y", F.col("m") + 1, F.lit(1)).alias("month"), F.col("v").cast("double").alias("value")).where(F.abs(F.col("value") - missing) >= 1e-4)


def phase_index(spark: SparkSession, path: str) -> DataFrame:
    """Daily two-component index: lines of year, month, day, two components and phase, then the amplitude, or longitude and amplitude; other lines are comments."""
    parts = F.filter(F.split(F.trim("value"), r"[\s,]+"), lambda x: x != "")
    rows = spark.read.text(path).select(parts.alias("p")).where((F.size("p") >= 7) & F.rlike(F.col("p")[0], F.lit(r"^\d{4}$")))
    at = lambda i, t: F.col("p")[i].try_cast(t)
    date = F.make_date(at(0, "int"), at(1, "int"), at(2, "int"))
    return rows.select(date.alias("date"), at(3, "double").alias("rmm1"), at(4, "double").alias("rmm2"), at(5, "double").cast("int").alias("phase"), F.coalesce(F.when(F.size("p") >= 9, at(7, "double")), at(6, "double")).alias("amplitude")).where(F.abs("rmm1") < 1e10)


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text a row."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def write_report(tables: dict[str, DataFrame], folder: str, formats: tuple[str, ...] = ("csv", "json")) -> None:
    """Each table as CSV with a header, JSON lines or Parquet in its own folder, by Spark's writers."""
    for name, df in tables.items():
        for kind in formats:
            writer = df.write.mode("overwrite")
            (writer.option("header", True) if kind == "csv" else writer).format(kind).save(f"{folder}/{kind}/{name}")
