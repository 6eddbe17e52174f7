"""Calendars and rule tables: the twelve mangsa, scenarios, span climatology, markers, the Javanese calendar, day rules.

Rule tables are literals of a dozen rows and are broadcast; dates, years and spans are the scalable side. Years of the
Javanese calendar come from a rule, not from a table of days.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions import columns as c

# Number, name, first month and day, days, first seasonal day of the traditional mangsa.
MANGSA = (
    (1, "Kasa", 6, 22, 41, 0), (2, "Karo", 8, 2, 23, 41), (3, "Katiga", 8, 25, 24, 64), (4, "Kapat", 9, 18, 25, 88), (5, "Kalima", 10, 13, 27, 113), (6, "Kanem", 11, 9, 43, 140),
    (7, "Kapitu", 12, 22, 43, 183), (8, "Kawolu", 2, 3, 26, 226), (9, "Kasanga", 3, 1, 25, 252), (10, "Kasadasa", 3, 26, 24, 277), (11, "Desta", 4, 19, 23, 301), (12, "Sada", 5, 12, 41, 324),
)
# The four seasons and, by scenario, the seasonal days on which they begin; climate phases of the scenario.
MUSIM = ("Katiga", "Labuh", "Rendheng", "Mareng")
SCENARIOS = (
    ("R30", (19, 94, 208, 286), "NETRAL", "NETRAL"), ("ALL", (32, 91, 187, 286), "NETRAL", "NETRAL"), ("R10", (12, 131, 185, 305), "NETRAL", "NETRAL"),
    ("ELNINO", (2, 133, 217, 288), "ELNINO", "pIOD"), ("LANINA", (35, 79, 210, 284), "LANINA", "nIOD"), ("NETRAL", (11, 102, 189, 288), "NETRAL", "NETRAL"),
)
# By mangsa, seasonal days in the present normal.
RANGES = (
    (1, 19.00, 53.94), (2, 53.94, 73.55), (3, 73.55, 94.00), (4, 94.00, 124.00), (5, 124.00, 156.40), (6, 156.40, 208.00),
    (7, 208.00, 243.68), (8, 243.68, 265.26), (9, 265.26, 286.00), (10, 286.00, 312.73), (11, 312.73, 338.34), (12, 338.34, 384.00),
)
# By mangsa, the daily climatology: rain sum, rain a day, wet days, evapotranspiration, balance, soil moisture, humidity, highest and lowest temperature, wind, radiation.
DAILY = (
    (23, 0.6, 5, 4.40, -3.75, 0.180, 67.1, 32.2, 21.5, 10.1, 19.9), (9, 0.5, 2, 4.98, -4.51, 0.150, 63.7, 33.2, 21.7, 10.7, 22.1), (17, 0.8, 3, 5.36, -4.51, 0.147, 62.3, 34.0, 22.3, 11.1, 23.3),
    (85, 2.8, 9, 5.31, -2.49, 0.183, 64.3, 34.3, 23.1, 10.8, 23.0), (244, 7.4, 21, 4.51, 2.88, 0.273, 72.5, 32.9, 23.7, 9.4, 20.4), (628, 12.7, 43, 3.61, 9.12, 0.369, 81.8, 30.6, 23.3, 9.6, 17.3),
    (559, 15.5, 35, 3.41, 12.12, 0.394, 84.4, 29.7, 23.1, 11.4, 16.8), (344, 15.6, 21, 3.55, 12.07, 0.398, 84.6, 29.9, 23.0, 10.0, 17.6), (238, 11.9, 18, 3.72, 8.16, 0.389, 83.5, 30.3, 23.0, 8.8, 18.3),
    (209, 7.8, 20, 3.75, 4.01, 0.364, 81.4, 30.6, 23.0, 8.2, 18.3), (97, 3.7, 12, 3.84, -0.10, 0.309, 77.0, 31.2, 23.0, 8.6, 18.2), (83, 1.9, 14, 3.87, -1.99, 0.249, 72.8, 31.4, 22.2, 9.0, 18.0),
)
DAILY_FIELDS = ("rain", "rain_d", "wet_days", "et0", "balance", "soil", "rh", "t_max", "t_min", "wind", "rad")
# By mangsa, highest and lowest temperature on record.
EXTREMES = ((36.4, 16.3), (36.7, 17.5), (37.2, 17.3), (38.5, 18.5), (39.3, 19.9), (37.7, 20.3), (35.1, 20.1), (33.6, 19.9), (33.8, 18.2), (33.9, 19.4), (34.9, 18.0), (35.3, 17.1))
# By mangsa, what a warm and a cold Pacific phase add to t_max, t_min, rain_d, et0, rad, rh.
ENSO_WARM = (
    (0.19, -0.40, -0.014, 0.084, 0.24, -2.0), (-0.04, -0.62, -0.018, 0.031, 0.22, -1.5), (0.13, -0.58, -0.029, 0.168, 0.66, -1.8), (0.82, -0.57, -0.080, 0.584, 1.94, -5.6),
    (2.14, 0.38, -0.134, 0.835, 2.65, -8.7), (0.42, 0.21, -0.026, 0.173, 0.75, -1.1), (-0.31, -0.12, 0.002, -0.108, -0.51, 0.2), (-0.14, -0.22, -0.008, -0.004, 0.06, -0.1),
    (0.01, -0.12, -0.040, 0.078, 0.42, -0.7), (0.18, -0.13, -0.059, 0.140, 0.59, -1.5), (0.02, -0.24, -0.009, 0.055, 0.16, -0.9), (0.40, -0.27, -0.027, 0.261, 0.88, -3.2),
)
ENSO_COLD = (
    (-0.24, 0.35, 0.004, -0.108, -0.34, 2.0), (-0.06, 0.38, 0.017, 0.010, -0.06, 1.0), (-0.15, 0.38, 0.033, -0.110, -0.45, 1.8), (-0.45, 0.38, 0.037, -0.243, -0.92, 3.0),
    (-1.06, -0.14, 0.058, -0.456, -1.54, 4.7), (-0.03, 0.09, -0.007, -0.003, -0.04, -0.1), (0.46, 0.25, -0.021, 0.144, 0.60, -0.6), (0.20, 0.23, 0.057, -0.022, -0.16, 0.3),
    (0.04, 0.25, 0.060, -0.157, -0.86, 0.7), (-0.14, 0.27, 0.050, -0.176, -0.78, 1.6), (0.00, 0.23, 0.026, -0.072, -0.29, 1.0), (-0.09, 0.24, 0.010, -0.110, -0.31, 1.4),
)
# What the Indian Ocean phases add; only mangsa 3 to 5 take part.
IOD_POSITIVE = {3: (0.534, -0.617, -0.943, 0.476, 1.175, -4.860), 4: (1.278, -0.316, -2.224, 0.730, 1.690, -7.271), 5: (2.345, 0.244, -4.980, 0.879, 2.461, -10.023)}
IOD_NEGATIVE = {3: (-0.841, 0.468, 2.365, -0.423, -1.459, 5.183), 4: (-0.831, 0.217, 2.437, -0.383, -1.149, 4.998), 5: (-0.487, -0.064, 1.359, -0.112, -0.319, 1.964)}
IOD_ALONE, IOD_TOGETHER, IOD_LEAST_DAYS, WET_DAY_EXPONENT = 0.30, 0.50, 15.0, 0.6
# Markers of the sky: key, seasonal day, month and day.
MARKERS = (
    ("solstis_juni", -0.81, 6, 21), ("solstis_des", 182.71, 12, 21), ("equinox_maret", 271.75, 3, 20), ("equinox_sept", 92.85, 9, 23), ("zenith_I_okt", 112.37, 10, 12), ("zenith_II_mar", 252.46, 3, 1),
    ("orion_helrise", 3.11, 6, 25), ("orion_evening_rise", 166.16, 12, 5), ("orion_evening_culm", 252.50, 3, 1), ("orion_midnight_culm", 168.91, 12, 8), ("orion_acron_set", 361.93, 6, 18),
)


def musim_number(mangsa: Column) -> Column:
    return F.floor((mangsa - 1) / 3)


def musim_name(mangsa: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MUSIM]), (musim_number(mangsa) + 1).cast("int"))


def mangsa_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MANGSA, "mangsa int, name string, month int, day int, days int, first int")


def traditional(years: DataFrame) -> DataFrame:
    """mangsa, name, musim, start, stop and days for each `py` of `years`; the eighth has a day more in a leap year."""
    cal = years.select("py").crossJoin(F.broadcast(mangsa_table(years.sparkSession)))
    own = F.col("py") + F.when((F.col("month") > 6) | ((F.col("month") == 6) & (F.col("day") >= 22)), 0).otherwise(1)
    days = F.col("days") + F.when((F.col("mangsa") == 8) & c.leap(own), 1).otherwise(0)
    start = F.make_date(own.cast("int"), F.col("month"), F.col("day"))
    return cal.select("py", "mangsa", "name", musim_name(F.col("mangsa")).alias("musim"), start.alias("start"), F.date_add(start, days - 1).alias("stop"), days.alias("days"))


def calibrated_starts(spark: SparkSession) -> DataFrame:
    """scenario, mangsa and first seasonal day: inner boundaries keep their traditional share of the season."""
    old = (0, 88, 183, 277, 365)
    rows = []
    for key, starts, *_ in SCENARIOS:
        ends = (*starts[1:], 365 + starts[0])
        for no, *_rest, first in MANGSA:
            m = (no - 1) // 3
            share = (first - old[m]) / (old[m + 1] - old[m])
            rows.append((key, no, float(starts[m] + share * (ends[m] - starts[m]))))
    return spark.createDataFrame(rows, "scenario string, mangsa int, first double")


def calibrated(years: DataFrame) -> DataFrame:
    """Spans of every scenario for each `py`: contiguous, the last ends where the next year's first begins."""
    from pyspark.sql import Window

    starts = calibrated_starts(years.sparkSession)
    spans = starts.withColumn("next", F.lead("first").over(Window.partitionBy("scenario").orderBy("mangsa")))
    one = starts.where("mangsa = 1").select("scenario", F.col("first").alias("again"))
    cal = years.select("py").crossJoin(F.broadcast(spans.join(one, "scenario")))
    start = c.season_date("py", "first")
    stop = F.date_sub(F.when(F.col("next").isNotNull(), c.season_date("py", "next")).otherwise(c.season_date(F.col("py") + 1, "again")), 1)
    return cal.select("scenario", "py", "mangsa", start.alias("start"), stop.alias("stop"), (F.datediff(stop, start) + 1).cast("long").alias("days"), c.rounded("first").alias("first"))


def mangsa_of_dates(dates: DataFrame) -> DataFrame:
    """Traditional mangsa of each row's `date`: the calendar of the row's own seasonal year, by a broadcast of twelve rows.

    Spans of one year never overlap, so the last start on or before the day is the answer.
    """
    table = F.array(*[F.struct(F.lit(m[0]).alias("mangsa"), F.lit(m[5]).alias("first")) for m in MANGSA])
    day = c.season_day("date")
    late = F.when(c.leap(c.season_year("date") + 1), 1).otherwise(0)  # from the ninth on, one day later in a leap cycle
    found = F.filter(table, lambda x: x["first"] + F.when(x["mangsa"] > 8, late).otherwise(0) <= day)
    return dates.withColumn("mangsa", F.element_at(found, -1)["mangsa"].cast("long"))


def overlap_weights(spans: DataFrame) -> DataFrame:
    """For spans (id, s, e): mangsa and the normalised overlap with its range."""
    from pyspark.sql import Window

    ranges = spans.sparkSession.createDataFrame(RANGES, "mangsa int, lo double, hi double")
    over = F.greatest(F.lit(0.0), F.least("e", "hi") - F.greatest("s", "lo"))
    met = spans.join(F.broadcast(ranges), (F.col("s") < F.col("hi")) & (F.col("lo") < F.col("e"))).withColumn("over", over).where("over > 0")
    return met.withColumn("w", F.col("over") / F.sum("over").over(Window.partitionBy("id")))


def span_climatology(spans: DataFrame) -> DataFrame:
    """Daily climatology of arbitrary spans (id, s, e, enso, iod): overlap-weighted means, phase corrections, scaled wet days."""
    spark = spans.sparkSession
    zero = (0.0,) * 6
    deltas = [("d_tx", 0), ("d_tn", 1), ("d_rain", 2), ("d_et0", 3), ("d_rad", 4), ("d_rh", 5)]
    climate = spark.createDataFrame(
        [(i + 1, *map(float, DAILY[i]), list(ENSO_WARM[i]), list(ENSO_COLD[i]), list(IOD_POSITIVE.get(i + 1, zero)), list(IOD_NEGATIVE.get(i + 1, zero)), *EXTREMES[i]) for i in range(12)],
        "mangsa int, " + ", ".join(f"{f} double" for f in DAILY_FIELDS) + ", warm array<double>, cold array<double>, pos array<double>, neg array<double>, x_max double, x_min double",
    )
    w = overlap_weights(spans).join(F.broadcast(climate), "mangsa")
    length = F.col("hi") - F.col("lo")
    part = F.col("mangsa").between(3, 5)
    mean = lambda f: F.sum(F.col("w") * F.col(f))
    pacific = lambda i: F.sum(F.col("w") * F.when(F.col("enso") == "ELNINO", F.col("warm")[i]).when(F.col("enso") == "LANINA", F.col("cold")[i]).otherwise(0.0))
    indian = lambda i: F.sum(F.when(part, F.col("w") * F.when(F.col("iod") == "pIOD", F.col("pos")[i]).when(F.col("iod") == "nIOD", F.col("neg")[i]).otherwise(0.0)).otherwise(0.0))
    g = w.groupBy("id", "s", "e", "enso", "iod").agg(
        *[mean(f).alias(f) for f in DAILY_FIELDS if f not in ("rain", "wet_days")], F.sum(F.col("w") * F.col("wet_days") / length).alias("wet"), F.sum(F.when(part, F.col("w")).otherwise(0.0)).alias("part"),
        *[pacific(i).alias(n) for n, i in deltas], *[indian(i).alias(f"i{n}") for n, i in deltas], F.max("x_max").alias("x_max"), F.min("x_min").alias("x_min"),
    )
    dur = F.greatest(F.col("e") - F.col("s"), F.lit(1.0))
    together = ((F.col("enso") == "ELNINO") & (F.col("iod") == "pIOD")) | ((F.col("enso") == "LANINA") & (F.col("iod") == "nIOD"))
    share = F.when((F.col("part") > 0) & (F.col("part") * (F.col("e") - F.col("s")) >= IOD_LEAST_DAYS), F.when(together, IOD_TOGETHER).otherwise(IOD_ALONE) / F.col("part")).otherwise(0.0)
    g = g.withColumns({"dur": dur, "share": share, "wet0": F.bround(F.col("wet") * dur, 0)})
    rain1 = F.col("rain_d") + F.col("d_rain")
    grown = lambda wet, new, old: F.when(old > 0.05, F.greatest(F.lit(0.0), F.bround(wet * F.pow(F.greatest(new, F.lit(0.0)) / old, F.lit(WET_DAY_EXPONENT)), 0))).otherwise(wet)
    g = g.withColumns({"rain1": rain1, "rain2": rain1 + F.col("share") * F.col("id_rain")})
    g = g.withColumn("wet1", F.when(F.col("enso").isin("ELNINO", "LANINA"), grown(F.col("wet0"), F.col("rain1"), F.col("rain_d"))).otherwise(F.col("wet0")))
    g = g.withColumn("wet2", F.when((F.col("share") > 0) & F.col("iod").isin("pIOD", "nIOD"), grown(F.col("wet1"), F.col("rain2"), F.col("rain1"))).otherwise(F.col("wet1")))
    both = lambda f, n: F.col(f) + F.col(n) + F.col("share") * F.col(f"i{n}")
    et0 = both("et0", "d_et0")
    moved = (F.col("enso").isin("ELNINO", "LANINA")) | ((F.col("share") > 0) & F.col("iod").isin("pIOD", "nIOD"))
    r8 = lambda x: c.rounded(x, 10)
    return g.select(
        "id", F.bround(F.col("rain2") * F.col("dur"), 0).alias("rain"), r8("rain2").alias("rain_d"), F.col("wet2").cast("long").alias("wet_days"), r8(et0).alias("et0"),
        r8(F.when(moved, F.col("rain2") - et0).otherwise(F.col("balance"))).alias("balance"), r8("soil").alias("soil"), r8(both("rh", "d_rh")).alias("rh"), r8(both("t_max", "d_tx")).alias("t_max"),
        r8(both("t_min", "d_tn")).alias("t_min"), r8("wind").alias("wind"), r8(both("rad", "d_rad")).alias("rad"), "x_max", "x_min",
    )


def markers_in(spans: DataFrame) -> DataFrame:
    """Markers whose seasonal day lies in a span (id, s, e), also one year on, as one sorted text."""
    m = spans.sparkSession.createDataFrame([(k, d) for k, d, *_ in MARKERS], "key string, at double")
    hit = (F.col("at").between(F.col("s"), F.col("e"))) | ((F.col("at") + 365).between(F.col("s"), F.col("e")))
    return spans.join(F.broadcast(m), hit, "left").groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("key")), ",").alias("markers"), F.count("key").alias("n"))


# the Javanese calendar

# Fixed values.
YEAR_LENGTHS = (354, 355, 354, 354, 355, 354, 354, 355)
SHORTENED = (1674, 1748, 1866, 1986, 2106, 2226, 2346, 2466)
YEAR_NAMES = ("Alip", "Ehé", "Djimawal", "Djé", "Dal", "Bé", "Wawu", "Djimächir")
MONTH_NAMES = ("Sura", "Sapar", "Mulud", "Bakda Mulud", "Jumadilawal", "Jumadilakhir", "Rejeb", "Ruwah", "Pasa", "Sawal", "Sela", "Besar")
DAY_NAMES = ("Ahad", "Senèn", "Selasa", "Rebo", "Kemis", "Jum'at", "Sabtu")
MARKET_DAYS = ("Legi", "Paing", "Pon", "Wagé", "Kliwon")
SIX_DAYS = ("Tunglé", "Arjang", "Wurukung", "Paningron", "Uwas", "Mawulu")
KURUP = ((1555, 1674, 1), (1675, 1748, 2), (1749, 1866, 3), (1867, 1986, 4), (1987, 2106, 5), (2107, 2226, 6), (2227, 2346, 7), (2347, 2466, 8), (2467, 2586, 9))
FIRST_YEAR, LAST_YEAR, EPOCH = 1555, 2586, "1633-07-08"


def javanese_years(spark: SparkSession) -> DataFrame:
    """jyear, first day since the epoch and length, from the eight-year rule: about a thousand rows."""
    lengths = [YEAR_LENGTHS[(y - FIRST_YEAR) % 8] - (y in SHORTENED) for y in range(FIRST_YEAR, LAST_YEAR + 1)]
    firsts = [0, *accumulate(lengths)]
    return spark.createDataFrame(list(zip(range(FIRST_YEAR, LAST_YEAR + 1), firsts, lengths, strict=False)), "jyear int, first int, length int")


def javanese(dates: DataFrame) -> DataFrame:
    """Javanese elements of `date`; null before the epoch. The year is found by its cycle, so the join is by equality."""
    days = F.datediff("date", F.lit(EPOCH).cast("date"))
    # a year has at least 354 - 1 days, so the year is the guess or one before; both are looked up
    guess = F.floor(days * 8 / 2835.0).cast("int") + FIRST_YEAR
    base = dates.withColumns({"days": days, "_g": guess})
    years = F.broadcast(javanese_years(dates.sparkSession))
    both = base.withColumn("jyear", F.explode(F.array(F.col("_g") - 1, F.col("_g"), F.col("_g") + 1))).join(years, "jyear").where((F.col("days") >= F.col("first")) & (F.col("days") < F.col("first") + F.col("length")))
    at = F.col("days") - F.col("first")
    month = F.least(F.floor(at / 59) * 2 + F.when(at % 59 >= 30, 1).otherwise(0), F.lit(11)).cast("int")  # 30 and 29 days alternate; only the last month varies
    d = F.col("days")
    names = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), (i + 1).cast("int"))
    kurup = F.lit(None).cast("int")
    for a, b, n in KURUP:
        kurup = F.when(F.col("jyear").between(a, b), n).otherwise(kurup)
    return both.withColumn("_m", month).select(
        *dates.columns, F.col("jyear").cast("long").alias("jyear"), names(YEAR_NAMES, (F.col("jyear") - FIRST_YEAR) % 8).alias("year_name"), names(MONTH_NAMES, F.col("_m")).alias("month"),
        (at - (F.floor(F.col("_m") / 2) * 59 + (F.col("_m") % 2) * 30) + 1).cast("long").alias("day"), names(DAY_NAMES, (d + 5) % 7).alias("dina"), names(MARKET_DAYS, d % 5).alias("pasaran"), names(SIX_DAYS, (d + 2) % 6).alias("paringkelan"),
        (F.floor((d + 194) / 7) % 30 + 1).cast("long").alias("wuku"), (F.floor((d + 311) / 35) % 12 + 1).cast("long").alias("masa_wuku"), (F.floor((F.col("jyear") - FIRST_YEAR + 7) / 8) % 4 + 1).cast("long").alias("windu"), kurup.cast("long").alias("kurup"),
    )


def from_javanese(df: DataFrame) -> DataFrame:
    """Gregorian `date` of (jyear, month_no from 0, day); null where the day does not exist."""
    joined = df.join(F.broadcast(javanese_years(df.sparkSession)), "jyear", "left")
    m = F.col("month_no")
    length = F.when(m == 11, F.col("length") - 325).otherwise(F.when(m % 2 == 0, 30).otherwise(29))
    offset = F.floor(m / 2) * 59 + (m % 2) * 30 + F.col("day") - 1
    valid = m.between(0, 11) & (F.col("day") >= 1) & (F.col("day") <= length)
    return joined.select(*df.columns, F.when(valid, F.date_add(F.lit(EPOCH).cast("date"), (F.col("first") + offset).cast("int"))).alias("date"))


def months_without(years: DataFrame) -> DataFrame:
    """Months (jyear, month) in which Tuesday and Kliwon never meet: no number d = 4 (mod 35) of the epoch count falls in them."""
    x = years.select("jyear").join(F.broadcast(javanese_years(years.sparkSession)), "jyear")
    m = x.withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(11))))
    first = F.col("first") + F.floor(F.col("m") / 2) * 59 + (F.col("m") % 2) * 30
    length = F.when(F.col("m") == 11, F.col("length") - 325).otherwise(F.when(F.col("m") % 2 == 0, 30).otherwise(29))
    wait = F.pmod(F.lit(4) - first, F.lit(35))
    return m.where(wait >= length).select(F.col("jyear").cast("long").alias("jyear"), F.element_at(F.array(*[F.lit(n) for n in MONTH_NAMES]), F.col("m") + 1).alias("month"))


# day rules

# Numbers of weekdays and market days, and pairs of both that are never proposed.
WEEKDAY_NUMBERS = (("Minggu", 5), ("Senin", 4), ("Selasa", 3), ("Rabu", 7), ("Kamis", 8), ("Jum'at", 6), ("Sabtu", 9))
MARKET_NUMBERS = (("Kliwon", 8), ("Legi", 5), ("Pahing", 9), ("Pon", 7), ("Wage", 4))
NEVER = (("Selasa", "Wage"), ("Rabu", "Legi"), ("Kamis", "Pon"), ("Sabtu", "Kliwon"), ("Minggu", "Pahing"), ("Senin", "Pon"), ("Selasa", "Kliwon"), ("Rabu", "Pahing"), ("Jum'at", "Wage"), ("Sabtu", "Legi"))


def day_pairs(spark: SparkSession) -> DataFrame:
    """All pairs of weekday and market day with their sum and its remainder by three."""
    rows = [(w, m, a + b, (a + b) % 3) for w, a in WEEKDAY_NUMBERS for m, b in MARKET_NUMBERS]
    return spark.createDataFrame(rows, "dina string, pasaran string, neptu int, rest int")


def good_days(couples: DataFrame) -> DataFrame:
    """For couples (id, total of both sums): pairs whose remainder answers that of the total, minus those never proposed."""
    spark = couples.sparkSession
    never = spark.createDataFrame(NEVER, "dina string, pasaran string")
    pairs = day_pairs(spark).join(F.broadcast(never), ["dina", "pasaran"], "left_anti")
    wanted = F.when(F.col("total") % 3 == 0, 2).when(F.col("total") % 3 == 1, 1).otherwise(0)
    return couples.withColumn("rest", wanted).join(F.broadcast(pairs), "rest").select("id", "dina", "pasaran", F.col("neptu").cast("long").alias("neptu"))


# What a month is good for.
MONTH_RULES = (
    ("Sura", "larangan"), ("Sapar", "boleh"), ("Mulud", "larangan"), ("Ba'da Mulud", "boleh"), ("Jumadilawal", "boleh"), ("Jumadilakir", "baik"),
    ("Rejeb", "baik"), ("Ruwah", "baik"), ("Pasa", "larangan"), ("Sawal", "boleh"), ("Sela", "larangan"), ("Besar", "baik"),
)


def good_months(spark: SparkSession, only_good: bool = True) -> DataFrame:
    """Months that are good, or also those that are allowed."""
    return spark.createDataFrame(MONTH_RULES, "month string, rule string").where(F.col("rule").isin("baik", *([] if only_good else ["boleh"])))


def without(pairs: DataFrame, excluded: DataFrame) -> DataFrame:
    """Pairs of weekday and market day that are not in `excluded`."""
    return pairs.join(excluded.select("dina", "pasaran"), ["dina", "pasaran"], "left_anti")


def windu_progress(dates: DataFrame) -> DataFrame:
    """Place of `date` in its cycle of eight years: first year, days so far, 35-day count (of 81) and percent."""
    years = javanese_years(dates.sparkSession).withColumn("w", F.floor((F.col("jyear") - FIRST_YEAR) / 8))
    cycles = years.groupBy("w").agg(F.min("jyear").alias("windu_year"), F.min("first").alias("begin"), F.sum("length").alias("total"))
    days = F.datediff("date", F.lit(EPOCH).cast("date"))
    return dates.withColumn("_d", days).join(F.broadcast(cycles), (F.col("_d") >= F.col("begin")) & (F.col("_d") < F.col("begin") + F.col("total"))).select(
        *dates.columns, F.col("windu_year").cast("long").alias("windu_year"), (F.col("_d") - F.col("begin")).cast("long").alias("days"), (F.floor((F.col("_d") - F.col("begin")) / 35) % 81 + 1).cast("long").alias("lapan"), c.rounded(100.0 * (F.col("_d") - F.col("begin")) / F.col("total")).alias("percent")
    )
