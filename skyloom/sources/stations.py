"""Station files as a Spark data source, and the loads that are composed on it: priority, aggregation, merge, features.

Every file is cut into byte ranges, one partition each. The task that reads a range finds the file's own header, binds its
columns to the canonical fields and parses with Arrow, so the driver lists files and reads none. A load is one plan: rows
of all stations and resolutions, one aggregate a station, source and day, one choice of source, one aggregate a date that
merges the stations by weight. However many stations there are, nothing is joined pair by pair.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv, fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from skyloom.functions import columns as c
from skyloom.operators import wind

#: Canonical fields and the columns of station files that hold them, units stripped. Fixed values.
FIELDS = {
    "temp2m": "temperature_2m", "dew_pt": "dew_point_2m", "temp_app": "apparent_temperature", "rh": "relative_humidity_2m", "vpd": "vapour_pressure_deficit",
    "tcwv": "total_column_integrated_water_vapour", "precip": "precipitation", "rain": "rain", "et0": "et0_fao_evapotranspiration", "pressure": "surface_pressure",
    "cloud": "cloud_cover", "cloud_lo": "cloud_cover_low", "cloud_mid": "cloud_cover_mid", "cloud_hi": "cloud_cover_high", "ws10": "wind_speed_10m", "ws100": "wind_speed_100m",
    "gust10": "wind_gusts_10m", "wd10": "wind_direction_10m", "wd100": "wind_direction_100m", "sw_rad": "shortwave_radiation", "sunshine": "sunshine_duration",
    "sm_0_7": "soil_moisture_0_to_7cm", "sm_7_28": "soil_moisture_7_to_28cm", "sm_28_100": "soil_moisture_28_to_100cm", "sm_100_255": "soil_moisture_100_to_255cm",
    "st_0_7": "soil_temperature_0_to_7cm", "st_7_28": "soil_temperature_7_to_28cm", "st_28_100": "soil_temperature_28_to_100cm", "st_100_255": "soil_temperature_100_to_255cm", "wcode": "weather_code",
}
#: Fields whose names others hold: they must match whole.
EXACT = ("cloud", "rain", "precip")
DIRECTIONS = ("wd10", "wd100")
HOUR, SIX_HOURS = 3600, 21600
#: Hours that count as afternoon, by the seconds between rows. Fixed values.
AFTERNOON = {HOUR: tuple(range(12, 18)), SIX_HOURS: (12, 18)}
SCHEMA = "station string, step int, rank int, time timestamp_ntz, " + ", ".join(f"{f} double" for f in FIELDS)
NUMBER, MOMENT = r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$", r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2})?)?$"
BLOCK = 1 << 22


@dataclass(frozen=True)
class Source:
    """A file or folder of one station whose rows are `step` seconds apart; of several, the first named come first."""

    station: str
    path: str
    step: int = HOUR


class Range(InputPartition):
    def __init__(self, station: str, step: int, rank: int, path: str, start: int, stop: int):
        self.station, self.step, self.rank, self.path, self.start, self.stop = station, step, rank, path, start, stop


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def listed(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the files of a folder; nothing for what does not exist."""
    store, at = opened(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        return []
    files = [info] if info.type == fs.FileType.File else [f for f in store.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File]
    head = path[: len(path) - len(at)] if "://" in path else ""
    return sorted((head + f.path, f.size) for f in files)


def header(file: pa.NativeFile) -> tuple[list[str], int]:
    """Names of the first line that begins with `time,`, and where the lines after it begin; no names without such a line."""
    seen = b""
    while True:
        more = file.read(BLOCK // 64)
        seen += more
        at = 0
        while (end := seen.find(b"\n", at)) >= 0 or (not more and at < len(seen)):
            end = len(seen) if end < 0 else end
            line = seen[at:end].decode("utf-8", "replace").strip()
            if line.lstrip("﻿").startswith("time,"):
                return [re.sub(r"\s*\(.*?\)\s*$", "", x.strip()) for x in line.split(",")], end + 1
            at = end + 1
        if not more:
            return [], len(seen)


def bound(names: list[str]) -> dict[str, int]:
    """Place of each canonical field: the column of its name, else the first whose name holds it."""
    low = [n.lower() for n in names]
    found = {}
    for field, source in FIELDS.items():
        if source in low:
            found[field] = low.index(source)
        elif field not in EXACT and (inside := [i for i, n in enumerate(low) if source in n]):
            found[field] = inside[0]
    return found


def parsed(lines: bytes, names: list[str]) -> pa.Table:
    """Cells as text; lines with too few cells get empty ones, those with too many lose the last."""
    odd: list[str] = []

    def keep(row: csv.InvalidRow) -> str:
        odd.append(row.text)
        return "skip"

    columns = [f"c{i}" for i in range(len(names))]
    options = {"read_options": csv.ReadOptions(column_names=columns, use_threads=False), "convert_options": csv.ConvertOptions(column_types=dict.fromkeys(columns, pa.string()), strings_can_be_null=False)}
    table = csv.read_csv(pa.py_buffer(lines), parse_options=csv.ParseOptions(invalid_row_handler=keep), **options)
    if odd:
        cells = [(x.split(",") + [""] * len(names))[: len(names)] for x in odd]
        table = pa.concat_tables([table, pa.table([pa.array(column, pa.string()) for column in zip(*cells, strict=True)], names=columns)])
    return table


def numbers(column: pa.ChunkedArray) -> pa.ChunkedArray:
    text = pc.utf8_trim_whitespace(column)
    return pc.cast(pc.if_else(pc.match_substring_regex(text, NUMBER), text, pa.scalar(None, pa.string())), pa.float64())


class StationReader(DataSourceReader):
    def __init__(self, options: dict):
        self.sources = [tuple(x) for x in json.loads(options["sources"])]
        self.range = int(options.get("rangebytes", 1 << 26))

    def partitions(self) -> list[Range]:
        out = []
        for rank, (station, path, step) in enumerate(self.sources):
            for file, size in listed(path):
                out += [Range(station, step, rank, file, at, min(size, at + self.range)) for at in range(0, size, self.range)]
        return out

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no file at all
            return
        store, at = opened(part.path)
        with store.open_input_file(at) as file:
            names, first = header(file)
            places = bound(names)
            start = max(part.start, first)
            if not names or start >= part.stop:
                return
            # a line belongs to the range in which it begins
            file.seek(start - 1)
            rest, place = file.read(1), start
            if rest == b"\n":
                rest = b""
            else:
                while (more := file.read(BLOCK)) and (end := more.find(b"\n")) < 0:
                    place += len(more)
                place += end + 1 if more else 0
                file.seek(place)
                rest = b""
            begin = place
            while begin < part.stop:
                more = file.read(min(BLOCK, max(1, part.stop - begin - len(rest))) if begin + len(rest) < part.stop else 1 << 12)
                rest += more
                cut = rest.rfind(b"\n") + 1 if more else len(rest)
                inside = part.stop - begin
                if cut > inside:
                    # the last line of the range is the one that holds its last byte
                    end = rest.find(b"\n", max(0, inside - 1))
                    cut = end + 1 if end >= 0 else len(rest)
                if cut and rest[:cut].strip():
                    yield from self.rows(part, rest[:cut], names, places)
                begin, rest = begin + cut, rest[cut:]
                if not more:
                    return

    def rows(self, part: Range, lines: bytes, names: list[str], places: dict[str, int]) -> Iterator[pa.RecordBatch]:
        cells = parsed(lines, names)
        text = pc.utf8_trim_whitespace(cells.column(0))
        cells, text = (x.filter(pc.match_substring_regex(text, MOMENT)) for x in (cells, text))
        n = len(cells)
        fixed = [pa.array([part.station] * n, pa.string()), pa.array([part.step] * n, pa.int32()), pa.array([part.rank] * n, pa.int32()), pc.cast(pc.replace_substring(text, "T", " "), pa.timestamp("us"))]
        fields = [numbers(cells.column(places[f])) if f in places else pa.nulls(n, pa.float64()) for f in FIELDS]
        names_out = ["station", "step", "rank", "time", *FIELDS]
        yield from pa.table([*fixed, *fields], names=names_out).combine_chunks().to_batches()


class StationSource(DataSource):
    """`spark.read.format("station").option("sources", json)`: rows of many station files in the canonical fields."""

    @classmethod
    def name(cls) -> str:
        return "station"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> StationReader:
        return StationReader(self.options)


def station_rows(spark: SparkSession, sources: list[Source], range_bytes: int = 1 << 26) -> DataFrame:
    """Rows of all sources that exist: station, step, rank (place in `sources`), time and the canonical fields.

    Cells that are not numbers, columns that a file lacks and cells that a line lacks are null; lines that begin with no
    moment are skipped. Paths are those that Arrow's file systems open; `weather.station_csv` reads whatever Spark reads.
    """
    spark.dataSource.register(StationSource)
    listed_sources = json.dumps([(x.station, x.path, x.step) for x in sources])
    return spark.read.format("station").option("sources", listed_sources).option("rangeBytes", str(range_bytes)).load()


#: Daily fields: name, field, kind and class of weights. Fixed values.
DAILY = (
    ("tcwv", "tcwv", "mean", "volatile"), ("dtr", "temp2m", "range", "volatile"), ("cloud_mean", "cloud", "mean", "volatile"), ("cloud_aft", "cloud", "afternoon", "volatile"),
    ("sm28_100", "sm_28_100", "mean", "soil"), ("sm_sh", "sm_0_7", "mean", "soil"), ("sT_sh", "st_0_7", "mean", "soil"), ("sT_dp", "st_100_255", "mean", "soil"),
    ("sunshine_h", "sunshine", "hours", "volatile"), ("sw_rad_MJ", "sw_rad", "megajoule", "volatile"), ("vpd", "vpd", "mean", "volatile"),
)


def daily_fields(rows: DataFrame) -> DataFrame:
    """station, step, rank, date and the daily fields of each source; sums of days without values are 0 if the source has the field at all."""
    in_afternoon = F.lit(False)
    for step, hours in AFTERNOON.items():
        in_afternoon = in_afternoon | ((F.col("step") == step) & F.hour("time").isin(*hours))

    def daily(field: str, kind: str) -> Column:
        x = F.col(field)
        if kind == "range":
            return F.max(x) - F.min(x)
        if kind == "afternoon":
            return F.avg(F.when(in_afternoon, x))
        return {"mean": F.avg(x), "hours": F.sum(x) / 3600.0, "megajoule": F.sum(x) * F.col("step") / 1e6}[kind]

    keys = ["station", "step", "rank", "date"]
    days = rows.withColumn("date", F.to_date("time")).groupBy(*keys).agg(*[daily(f, kind).alias(n) for n, f, kind, _ in DAILY])
    summed = [n for n, _, kind, _ in DAILY if kind in ("hours", "megajoule")]
    known = days.groupBy("station", "step", "rank").agg(*[F.max(F.col(n).isNotNull()).alias(f"_{n}") for n in summed])
    filled = {n: F.coalesce(n, F.when(F.col(f"_{n}"), 0.0)) for n in summed}
    return days.join(known, ["station", "step", "rank"]).withColumns(filled).drop(*known.columns[3:])


def resolved(days: DataFrame, by: str = "station", time: str = "date") -> DataFrame:
    """One row a station and `time`: of the finest resolution that the station has at all (`by` "station") or on that day ("day"), then of the first source.

    A minimum per key that is combined before the shuffle; the finest step per station is one row a station.
    """
    if by == "station":
        days = days.join(days.groupBy("station").agg(F.min("step").alias("step")), ["station", "step"], "left_semi")
    elif by != "day":
        raise ValueError(f"by is 'station' or 'day', not {by!r}")
    rest = [x for x in days.columns if x not in ("station", time)]
    return days.groupBy("station", time).agg(F.min_by(F.struct(*rest), F.struct("step", "rank")).alias("r")).select("station", time, *[f"r.{x}" for x in rest])


def weight_of(weights: dict[str, dict[str, float]], kind: str) -> Column:
    """Weight of a row's station in a class; stations that are not named have none and drop out."""
    return F.element_at(F.create_map(*[F.lit(x) for name, w in weights.items() for x in (name, float(w[kind]))]), F.col("station"))


def weighted(field: str, w: Column) -> Column:
    """Weighted mean of the stations that have a value: all of them, or just what the one has that does."""
    of_several = F.try_divide(F.sum(w * F.col(field)), F.sum(F.when(F.col(field).isNotNull(), w)))
    return F.when(F.count(F.when(w.isNotNull(), F.col(field))) == 1, F.max(F.when(w.isNotNull(), F.col(field)))).otherwise(of_several)


def weighted_direction(field: str, w: Column) -> Column:
    s, k = F.sum(w * F.sin(F.radians(field))), F.sum(w * F.cos(F.radians(field)))
    return F.pmod(F.degrees(F.atan2(s, k)), F.lit(360.0))


#: Weights of the standard pair of stations by class. Fixed values.
PAIR = {"P1": {"volatile": 0.4154, "soil": 0.4996}, "P2": {"volatile": 0.5846, "soil": 0.5004}}


def daily_load(rows: DataFrame, weights: dict[str, dict[str, float]] = PAIR, by: str = "station") -> DataFrame:
    """date and the daily fields at the target: aggregated for each station first, then merged (a range of means is not a mean of ranges).

    A field that one station alone has is taken from it. Soil fields have weights of their own.
    """
    days = resolved(daily_fields(rows), by)
    return days.groupBy("date").agg(*[weighted(n, weight_of(weights, kind)).alias(n) for n, _, _, kind in DAILY])


def hourly_load(rows: DataFrame, weights: dict[str, dict[str, float]] = PAIR, fields: tuple[str, ...] = ("ws10", "gust10", "ws100", "precip", "cloud", "cloud_lo", "cloud_mid", "cloud_hi"), by: str = "station") -> DataFrame:
    """time, the merged fields and directions, and the time features: scan, choice of source, merge and features in one plan."""
    w = weight_of(weights, "volatile")
    merged = resolved(rows.select("station", "step", "rank", "time", *fields, *DIRECTIONS), by, "time").groupBy("time").agg(*[weighted(f, w).alias(f) for f in fields], *[weighted_direction(f, w).alias(f) for f in DIRECTIONS])
    return wind.time_features(merged, "time", "wd10")
