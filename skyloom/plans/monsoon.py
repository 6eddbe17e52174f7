"""Queries of the monsoon detectors and the SQL that gives the same rows, written from the same declarations."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.functions import columns as c
from skyloom.operators import detectors as det
from skyloom.operators import kernels
from skyloom.operators import monsoon as m
from skyloom.plans.kernels import biweight_sql
from skyloom.plans.registry import query
from skyloom.sources import surrogate as s

SLICE = "y AS (SELECT * FROM climate WHERE date - make_date(CAST(py AS INT), 6, 22) < 365)"


def slice_sql(least_days: int) -> str:
    return SLICE[:-1] + f" QUALIFY count(*) OVER (PARTITION BY py) >= {least_days})"


PERSIST = "sum(CASE WHEN {x} {op} {level} {eps} THEN 1 ELSE 0 END)"


def roll_sql(x: str, n: int, part: str = "PARTITION BY py ") -> str:
    """Centred mean of n rows with at least half of them known."""
    frame = f"({part}ORDER BY date ROWS BETWEEN {n - 1 - (n - 1) // 2} PRECEDING AND {(n - 1) // 2} FOLLOWING)"
    return f"CASE WHEN count({x}) OVER {frame} >= {n // 2} THEN avg({x}) OVER {frame} END"


def trail_sql(x: str, n: int, least: int, part: str = "PARTITION BY py ") -> str:
    frame = f"({part}ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) OVER {frame} >= {least} THEN avg({x}) OVER {frame} END"


def limit_sql(x: str, limit: float | m.Percentile, strict: bool = False) -> str:
    if not isinstance(limit, m.Percentile):
        return f"{float(limit)}::DOUBLE"
    dry = f"dopy BETWEEN {limit.days[0]} AND {limit.days[1]}"
    every = "NULL" if strict else f"quantile_cont({x}, {limit.q / 100}) OVER (PARTITION BY py)"
    return f"(CASE WHEN count(CASE WHEN {dry} THEN {x} END) OVER (PARTITION BY py) >= {limit.least} THEN quantile_cont(CASE WHEN {dry} THEN {x} END, {limit.q / 100}) OVER (PARTITION BY py) ELSE {every} END) * {limit.factor}"


def persistent_sql(table: str, x: str, level: str, days, sustain: int, least: int, up: bool, eps: float) -> str:
    """(py, onset) of the first row whose next rows hold the level."""
    op, sign = (">=", "-") if up else ("<=", "+")
    frame = f"(PARTITION BY py ORDER BY date ROWS BETWEEN CURRENT ROW AND {sustain - 1} FOLLOWING)"
    return f"""SELECT py, arg_min(dopy, date) FILTER (now AND rn > 1 AND dopy BETWEEN {days[0]} AND {days[1]} AND k >= {least - 2} AND ok >= {least}) AS onset FROM (
  SELECT py, date, dopy, {x} {op} {level} AS now, row_number() OVER (PARTITION BY py ORDER BY date) AS rn, count({x}) OVER {frame} AS k, sum(CASE WHEN {x} {op} {level} {sign} {eps} THEN 1 ELSE 0 END) OVER {frame} AS ok FROM {table}) GROUP BY py"""


def detector_sql(d: m.Detector, n: int) -> tuple[str, str]:
    """Common table expressions of a detector, and its (py, onset)."""
    first = ", ".join([f"{roll_sql(r.field, r.n)} AS r{i}" for i, r in enumerate(d.rules)] + [f"{roll_sql(f, 7)} AS k{i}" for i, f in enumerate(d.known)])
    second = ", ".join(f"{limit_sql(f'r{i}', r.limit)} AS l{i}" for i, r in enumerate(d.rules))
    ctes = [f"a{n} AS (SELECT py, date, dopy, {first} FROM y)", f"b{n} AS (SELECT *, {second} FROM a{n})"]
    if d.trail is None:
        return ", ".join(ctes), persistent_sql(f"b{n}", "r0", "l0", d.days, d.sustain, d.least, d.rules[0].above, 0.025)
    number = " + ".join(f"(r{i} {'>' if r.above else '<'} l{i})::INT" for i, r in enumerate(d.rules))
    joint = {"all": f"CASE WHEN {number} = {len(d.rules)} THEN 1.0 ELSE 0.0 END", "any": f"CASE WHEN {number} > 0 THEN 1.0 ELSE 0.0 END", "score": f"({number})::DOUBLE"}[d.combine]
    known = " AND ".join([f"r{i} IS NOT NULL" for i in range(len(d.rules))] + [f"k{i} IS NOT NULL" for i in range(len(d.known))])
    ctes += [f"c{n} AS (SELECT *, CASE WHEN {known} THEN ({joint})::DOUBLE END AS j FROM b{n})", f"d{n} AS (SELECT py, date, dopy, {trail_sql('j', *d.trail)} AS x FROM c{n})"]
    return ", ".join(ctes), persistent_sql(f"d{n}", "x", f"{d.level}::DOUBLE", d.days, d.sustain, d.least, True, 0.025)


def table_sql(detectors, least_days: int = 0) -> str:
    parts = [(d, *detector_sql(d, i)) for i, d in enumerate(detectors)]
    return f"WITH {slice_sql(least_days) if least_days else SLICE}, " + ", ".join(ctes for _, ctes, _ in parts) + " " + " UNION ALL ".join(f"SELECT py, '{d.name}' AS method, onset::DOUBLE AS onset FROM ({body})" for d, _, body in parts)


@query("season_detectors", table_sql(m.SEASON_DETECTORS), "climate")
def season_detectors(spark, d):
    return m.season_table(s.climate(spark, d))


@query("advection_detectors", table_sql(m.ADVECTION_DETECTORS, m.ADVECTION_DAYS), "climate")
def advection_detectors(spark, d):
    return m.season_table(s.climate(spark, d), m.ADVECTION_DETECTORS, m.ADVECTION_DAYS)


_TOTAL = sum(w for *_, w in m.INDEX_FIELDS)
_CARRIED = ", ".join(
    f"coalesce(last_value({f} IGNORE NULLS) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), first_value({f} IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS f{i}, count({f}) OVER () AS n{i}" for i, (f, _, _) in enumerate(m.INDEX_FIELDS)
)
_TAKES = [f"(n{i} > 100 AND coalesce(s{i}, 0) >= 1e-9)" for i in range(len(m.INDEX_FIELDS))]
_USED = " + ".join(f"CASE WHEN {t} THEN {w} ELSE 0 END" for t, (*_, w) in zip(_TAKES, m.INDEX_FIELDS, strict=True))
_SUM = " + ".join(f"CASE WHEN {t} THEN {sign * w} * (f{i} - m{i}) / s{i} ELSE 0 END" for i, (t, (_, sign, w)) in enumerate(zip(_TAKES, m.INDEX_FIELDS, strict=True)))
INDEX = f"""v AS (SELECT py, date, dopy, {_CARRIED} FROM climate), z AS (SELECT *, {", ".join(f"avg(f{i}) OVER () AS m{i}, stddev_samp(f{i}) OVER () AS s{i}" for i in range(len(m.INDEX_FIELDS)))} FROM v),
i AS (SELECT py, date, dopy, CASE WHEN {" + ".join(f"(n{i} > 100)::INT" for i in range(len(m.INDEX_FIELDS)))} >= 4 AND {_USED} >= 0.4 * {_TOTAL} THEN ({_SUM}) / ({_USED}) END AS idx FROM z),
r AS (SELECT *, {roll_sql("idx", 21, "")} AS roll, {trail_sql("idx", 21, 10, "")} AS causal FROM i)"""
YEAR = "date - make_date(CAST(py AS INT), 6, 22) < 365"
LEVEL = "CASE WHEN count(CASE WHEN dopy BETWEEN 50 AND 130 THEN roll END) OVER (PARTITION BY py) >= 5 THEN avg(CASE WHEN dopy BETWEEN 50 AND 130 THEN roll END) OVER (PARTITION BY py) + 1.5 * stddev_samp(CASE WHEN dopy BETWEEN 50 AND 130 THEN roll END) OVER (PARTITION BY py) ELSE 0.25 END"


@query("persistence_index", f"WITH {INDEX} SELECT date, round(idx, 8) + 0.0 AS idx, round(roll, 8) + 0.0 AS roll, round(causal, 8) + 0.0 AS causal FROM r", "climate")
def persistence_index(spark, d):
    return m.persistence_index(s.climate(spark, d)).select("date", *[c.rounded(x, 8).alias(x) for x in ("idx", "roll", "causal")])


@query("index_season", f"""WITH {INDEX}, t AS (SELECT *, {LEVEL} AS level FROM r WHERE {YEAR}) SELECT a.py, a.onset, b.onset AS offset_day FROM ({persistent_sql("t", "roll", "level", m.ONSET, 14, 9, True, 0.025)}) a JOIN ({persistent_sql("t", "roll", "level", m.OFFSET, 14, 9, False, 0.025)}) b USING (py)""", "climate")
def index_season(spark, d):
    index = m.persistence_index(s.climate(spark, d))
    return m.index_season(index, True).join(m.index_season(index, False).withColumnRenamed("onset", "offset_day"), "py")


_PRE = m.PRECURSOR_FIELDS
_PT = [f"(coalesce(s{i}, 0) >= 1e-9 AND k{i} > 50)" for i in range(len(_PRE))]
_PSUM = " + ".join(f"CASE WHEN {t} THEN {sign} * (f{i} - m{i}) / s{i} ELSE 0 END" for i, (t, (_, sign)) in enumerate(zip(_PT, _PRE, strict=True)))
PRECURSOR = f"""pv AS (SELECT py, date, dopy, {", ".join(f"last_value({f} IGNORE NULLS) OVER (PARTITION BY py ORDER BY date ROWS UNBOUNDED PRECEDING) AS f{i}, count({f}) OVER (PARTITION BY py) AS k{i}" for i, (f, _) in enumerate(_PRE))} FROM y),
pz AS (SELECT *, {", ".join(f"avg(f{i}) OVER (PARTITION BY py) AS m{i}, stddev_samp(f{i}) OVER (PARTITION BY py) AS s{i}" for i in range(len(_PRE)))} FROM pv),
pi AS (SELECT py, date, dopy, CASE WHEN {" + ".join(f"{t}::INT" for t in _PT)} >= 3 THEN ({_PSUM}) / ({" + ".join(f"{t}::INT" for t in _PT)}) END AS idx FROM pz), pr AS (SELECT *, {roll_sql("idx", 30)} AS roll FROM pi)"""


@query("precursor_index", f"WITH {SLICE}, {PRECURSOR} SELECT date, round(idx, 8) + 0.0 AS idx, round(roll, 8) + 0.0 AS roll FROM pr", "climate")
def precursor_index(spark, d):
    return m.precursor_index(s.climate(spark, d)).select("date", c.rounded("idx", 8).alias("idx"), c.rounded("roll", 8).alias("roll"))


WIN = f"""pw AS (SELECT *, coalesce(roll, avg(roll) OVER (PARTITION BY py)) AS x, count(*) OVER (PARTITION BY py) AS n FROM pr WHERE dopy BETWEEN 60 AND 200),
pb AS (SELECT *, avg(CASE WHEN dopy BETWEEN 60 AND 120 THEN x END) OVER (PARTITION BY py) AS m, stddev_pop(CASE WHEN dopy BETWEEN 60 AND 120 THEN x END) OVER (PARTITION BY py) + 1e-9 AS sd, count(CASE WHEN dopy BETWEEN 60 AND 120 THEN x END) OVER (PARTITION BY py) AS k,
  count(CASE WHEN dopy BETWEEN 150 AND 200 THEN x END) OVER (PARTITION BY py) AS kw, avg(CASE WHEN dopy BETWEEN 150 AND 200 THEN x END) OVER (PARTITION BY py) AS mw, min(CASE WHEN dopy >= 90 THEN date END) OVER (PARTITION BY py) AS first FROM pw)"""
LIKELIHOOD = """la AS (SELECT *, CASE WHEN kw >= 5 THEN mw ELSE m + sd END AS w2 FROM pb), lb AS (SELECT *, (2 * x * (w2 - m) - w2 * w2 + m * m) / (2 * sd * sd) AS l FROM la), lc AS (SELECT *, sum(l) OVER (PARTITION BY py ORDER BY date ROWS UNBOUNDED PRECEDING) AS cl FROM lb),
ld AS (SELECT *, min(cl - l) OVER (PARTITION BY py) AS low FROM lc), le AS (SELECT *, cl - low + ln(sum(exp(greatest(low - (cl - l), -300))) OVER (PARTITION BY py ORDER BY date ROWS UNBOUNDED PRECEDING)) AS lr FROM ld)"""
CUSUM = """ca AS (SELECT *, sum(CASE WHEN date > first THEN x - m - 0.5 * sd ELSE 0 END) OVER (PARTITION BY py ORDER BY date ROWS UNBOUNDED PRECEDING) AS cs FROM pb), cb AS (SELECT *, cs - least(0, min(cs) OVER (PARTITION BY py ORDER BY date ROWS UNBOUNDED PRECEDING)) AS up FROM ca),
cc AS (SELECT *, min(up) OVER (PARTITION BY py ORDER BY date ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS low FROM cb)"""
DRYNESS = f"""va AS (SELECT *, row_number() OVER (PARTITION BY py ORDER BY date)::DOUBLE AS rn FROM y), vb AS (SELECT *, CASE WHEN count(vpd) OVER w >= 4 THEN regr_slope(vpd, rn) OVER w END AS slope FROM va WINDOW w AS (PARTITION BY py ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
vc AS (SELECT *, CASE WHEN count(slope) OVER w >= 3 THEN avg(slope) OVER w END AS sl FROM vb WINDOW w AS (PARTITION BY py ORDER BY date ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
vd AS (SELECT *, CASE WHEN count(CASE WHEN dopy BETWEEN 60 AND 120 THEN sl END) OVER (PARTITION BY py) >= 10 THEN avg(CASE WHEN dopy BETWEEN 60 AND 120 THEN sl END) OVER (PARTITION BY py) - 2 * (stddev_pop(CASE WHEN dopy BETWEEN 60 AND 120 THEN sl END) OVER (PARTITION BY py) + 1e-9) END AS level,
  count(sl) OVER w AS k, avg(sl) OVER w AS ahead FROM vc WINDOW w AS (PARTITION BY py ORDER BY date ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING))"""


def crossing_sql(name: str, rule: m.Rule, n: int) -> tuple[str, str]:
    up = rule.above
    frame = f"(PARTITION BY py ORDER BY date ROWS BETWEEN CURRENT ROW AND {rule.hold[0] - 1} FOLLOWING)"
    ctes = f"x{n} AS (SELECT py, date, dopy, {roll_sql(rule.field, rule.n)} AS r FROM y), w{n} AS (SELECT *, {limit_sql('r', rule.limit, True)} AS l, lag(r) OVER (PARTITION BY py ORDER BY date) AS p, {'min' if up else 'max'}(r) OVER {frame} AS e, count(r) OVER {frame} AS k FROM x{n})"
    hit = "p < l AND r >= l AND e >= l - 0.005" if up else "p > l AND r <= l AND e <= l + 0.005"
    return ctes, f"SELECT py, '{name}' AS method, (arg_min(dopy, date) FILTER ({hit} AND k >= {rule.hold[1]} AND dopy BETWEEN 60 AND 200))::DOUBLE AS onset FROM w{n} GROUP BY py"


_CROSSED = [crossing_sql(n, r, i) for i, (n, r) in enumerate(zip(m.CROSSING_NAMES, m.CROSSING_DETECTORS, strict=True))]
REVERSAL = f"{slice_sql(m.REVERSAL_DAYS)}, {PRECURSOR}, {WIN}, {LIKELIHOOD}, {CUSUM}, {DRYNESS}, " + ", ".join(x for x, _ in _CROSSED)
LONG = f"""SELECT py, 'M2_likelihood' AS method, (arg_min(dopy, date) FILTER (k >= 10 AND n >= 30 AND lr >= ln(0.5 * n)))::DOUBLE AS onset FROM le GROUP BY py
UNION ALL SELECT py, 'M4_falling_dryness', arg_min(dopy, date) FILTER (rn > 1 AND dopy BETWEEN 60 AND 200 AND sl < level AND k >= 5 AND ahead < level) FROM vd GROUP BY py
UNION ALL SELECT py, 'M5_cusum', arg_min(dopy, date) FILTER (date > first AND k >= 10 AND n >= 30 AND up > 3 * sd AND low > 0.7 * 3 * sd) FROM cc GROUP BY py
UNION ALL """ + " UNION ALL ".join(x for _, x in _CROSSED)


@query("reversal_methods", f"WITH {REVERSAL} {LONG}", "climate")
def reversal_methods(spark, d):
    return m.reversal_table(s.climate(spark, d))


METHODS = ["M2_likelihood", "M4_falling_dryness", "M5_cusum", *m.CROSSING_NAMES]


@query("method_comparison", f"WITH {REVERSAL}, long AS ({LONG}) SELECT py, " + ", ".join(f"max(onset) FILTER (method = '{x}') AS {x}" for x in METHODS) + ", count(onset) AS found, round(avg(onset), 9) + 0.0 AS mean, round(stddev_samp(onset), 9) + 0.0 AS spread FROM long GROUP BY py", "climate")
def method_comparison(spark, d):
    t = m.comparison(m.reversal_table(s.climate(spark, d)), METHODS)
    return t.select("py", *METHODS, "found", c.rounded("mean", 9).alias("mean"), c.rounded("spread", 9).alias("spread"))


#: Weights of the methods in both ensembles.
WEIGHTS = {"M2_likelihood": 1.5, "M4_falling_dryness": 0.5, "M5_cusum": 1.5, "M6_vpd": 1.0, "M7_dew_point": 1.0, "M8_shear": 1.0, "M9_soil": 1.0, "M10_wind": 2.0}
_WEIGHT = "CASE method " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items()) + " END"


def weighted(df):
    return df.withColumn("weight", F.element_at(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv]), F.col("method")))


@query("method_ensemble", f"WITH {REVERSAL}, long AS ({LONG}), e AS (SELECT py, onset, unnest(generate_series(1, greatest(CAST(round({_WEIGHT} * 10) AS INT), 1))) FROM long WHERE onset IS NOT NULL) SELECT py, median(onset) AS ensemble, count(*) AS votes FROM e GROUP BY py", "climate")
def method_ensemble(spark, d):
    return det.replicated_median(weighted(m.reversal_table(s.climate(spark, d))))


@query("robust_ensemble", f"WITH RECURSIVE {REVERSAL}, long AS ({LONG}), lw AS (SELECT *, {_WEIGHT} AS weight FROM long), {biweight_sql('lw', 'onset', 'weight')} SELECT py, round(ensemble, 6) + 0.0 AS ensemble, n FROM done", "climate")
def robust_ensemble(spark, d):
    """The biweight of the methods' days, by year."""
    return kernels.biweight(weighted(m.reversal_table(s.climate(spark, d)))).select("py", c.rounded("ensemble").alias("ensemble"), "n")
