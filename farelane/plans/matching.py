"""Beliefs, suppression, support over dates, assignment, smoothing and extension over the candidate views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farelane.operators import matching as M
from farelane.plans.catalog import query

_CAST = """v AS (SELECT * FROM votes WHERE decision <> 'unsure'),
nv AS (SELECT bus_id, date, count(*) AS n_votes, count(*) FILTER (WHERE decision = 'none_of_these') AS nones FROM v GROUP BY bus_id, date),
nf AS (SELECT bus_id, date, device_id, count(*) AS n_for FROM v WHERE decision = 'match' GROUP BY bus_id, date, device_id),
best AS (SELECT bus_id, date, max(score) AS best FROM candidates GROUP BY bus_id, date)"""


def _raw(name: str, support: str = "") -> str:
    """Beliefs before suppression; `support` names a table of (bus_id, device_id, date) confirmed pairs."""
    steady = f"CASE WHEN EXISTS (SELECT 1 FROM {support} k WHERE k.bus_id = c.bus_id AND k.device_id = c.device_id AND k.date <> c.date) THEN 0.5e0 * ln(5e0) ELSE 0e0 END" if support else "0e0"
    return f"""{name}0 AS (SELECT c.bus_id, c.date, c.device_id, CASE WHEN score IS NULL THEN 0e0 ELSE CASE WHEN is_model_score THEN 0.6e0 ELSE 0.15e0 END * ln(least(greatest(score, 0.02e0), 0.98e0) / (1e0 - least(greatest(score, 0.02e0), 0.98e0))) END
 + {steady} + CASE WHEN coalesce(score, 0e0) >= coalesce(best, 0e0) - 0.2e0 THEN 0.6e0 * CASE WHEN dictionary_conflict THEN 0.5e0 ELSE 1e0 END * CASE WHEN n_dictionary >= 2 THEN ln(12e0) WHEN n_dictionary = 1 THEN ln(4e0) ELSE 0e0 END ELSE 0e0 END
 + coalesce(n_for, 0) * ln(9e0) - (coalesce(n_votes, 0) - coalesce(n_for, 0)) * ln(1.3e0) AS log_odds, coalesce(n_votes, 0) AS n_votes
 FROM candidates c JOIN best USING (bus_id, date) LEFT JOIN nf USING (bus_id, date, device_id) LEFT JOIN nv USING (bus_id, date)
 UNION ALL SELECT best.bus_id, best.date, NULL, 0.15e0 * ln(0.3e0) + coalesce(nones, 0) * ln(9e0) - (coalesce(n_votes, 0) - coalesce(nones, 0)) * ln(1.3e0), coalesce(n_votes, 0) FROM best LEFT JOIN nv USING (bus_id, date)),
{name} AS (SELECT *, exp(log_odds) / sum(exp(log_odds)) OVER (PARTITION BY bus_id, date) AS p FROM {name}0)"""


def _suppressed(raw: str, name: str) -> str:
    return f"""{name}1 AS (SELECT *, row_number() OVER (PARTITION BY date, device_id ORDER BY p DESC, bus_id) AS rn FROM {raw} WHERE device_id IS NOT NULL),
{name}2 AS (SELECT date, device_id, max(CASE WHEN rn = 1 THEN p END) AS one, max(CASE WHEN rn = 2 THEN p END) AS two FROM {name}1 GROUP BY date, device_id),
{name}3 AS (SELECT bus_id, date, device_id, n_votes, log_odds - CASE WHEN CASE WHEN rn = 1 THEN coalesce(two, 0) ELSE one END > 0.6e0 THEN 3e0 * CASE WHEN rn = 1 THEN two ELSE one END ELSE 0e0 END AS log_odds FROM {name}1 JOIN {name}2 USING (date, device_id)
 UNION ALL SELECT bus_id, date, device_id, n_votes, log_odds FROM {raw} WHERE device_id IS NULL),
{name} AS (SELECT *, exp(log_odds) / sum(exp(log_odds)) OVER (PARTITION BY bus_id, date) AS p FROM {name}3)"""


def _summary(belief: str, name: str) -> str:
    return f"""{name}1 AS (SELECT *, row_number() OVER w AS rn, lead(p) OVER w AS second FROM {belief} WINDOW w AS (PARTITION BY bus_id, date ORDER BY p DESC, device_id NULLS LAST)),
{name} AS (SELECT bus_id, date, device_id AS top_device, p AS top_p, p - coalesce(second, 0) AS margin, n_votes, p >= 0.85e0 AND p - coalesce(second, 0) >= 0.3e0 AS confident, p >= 0.85e0 AND p - coalesce(second, 0) >= 0.3e0 AND n_votes >= 1 AS resolved,
 CASE WHEN device_id IS NULL THEN 'none_of_these' ELSE 'match' END AS decision FROM {name}1 WHERE rn = 1)"""


_OUT = "bus_id, date, top_device, round(top_p, 9) AS top_p, round(margin, 9) AS margin, n_votes, confident, resolved, decision"
_TWO = f"{_CAST}, {_raw('a')}, {_suppressed('a', 'b')}, {_summary('b', 's')}, k0 AS (SELECT bus_id, top_device AS device_id, date FROM s WHERE resolved AND decision = 'match'), {_raw('c1', 'k0')}, {_suppressed('c1', 'd')}, {_summary('d', 'z')}"


def _both(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.table("candidates"), spark.table("votes")


def _rounded(s: DataFrame) -> DataFrame:
    return s.withColumns({"top_p": F.round("top_p", 9), "margin": F.round("margin", 9)})


@query("m04_beliefs", f"WITH {_CAST}, {_raw('a')} SELECT bus_id, date, device_id, round(p, 9) AS p, n_votes FROM a")
def _(spark: SparkSession) -> DataFrame:
    return M.beliefs(*_both(spark)).withColumn("p", F.round("p", 9)).select("bus_id", "date", "device_id", "p", "n_votes")


@query("m05_suppression", f"WITH {_CAST}, {_raw('a')}, {_suppressed('a', 'b')} SELECT bus_id, date, device_id, round(p, 9) AS p FROM b")
def _(spark: SparkSession) -> DataFrame:
    return M.suppress(M.beliefs(*_both(spark))).withColumn("p", F.round("p", 9)).select("bus_id", "date", "device_id", "p")


@query("m06_bus_date_summary", f"WITH {_CAST}, {_raw('a')}, {_suppressed('a', 'b')}, {_summary('b', 's')} SELECT {_OUT} FROM s")
def _(spark: SparkSession) -> DataFrame:
    return _rounded(M.summary(M.suppress(M.beliefs(*_both(spark)))))


@query("m07_model_trust", "SELECT bus, CASE WHEN n < 15 THEN 0e0 ELSE 0.6e0 * least(1e0, greatest(0e0, (0.3e0 - ece) / 0.25e0)) END AS weight FROM (SELECT s_suppkey AS bus, s_suppkey % 30 AS n, (s_suppkey * 13 % 40) / 100e0 AS ece FROM supplier) x")
def _(spark: SparkSession) -> DataFrame:
    x = spark.table("supplier").select(F.col("s_suppkey").alias("bus"), (F.col("s_suppkey") % 30).alias("n"), (F.col("s_suppkey") * 13 % 40 / F.lit(100.0)).alias("ece"))
    return x.select("bus", M.model_weight_of(F.col("ece"), F.col("n")).alias("weight"))


@query("m08_two_pass_support", f"WITH {_TWO} SELECT {_OUT} FROM z")
def _(spark: SparkSession) -> DataFrame:
    """Pairs resolved without temporal support give it to their other dates in the second pass."""
    return _rounded(M.summary(M.two_pass(*_both(spark))))


@query("m09_global_assignment")
def _(spark: SparkSession) -> DataFrame:
    return M.assign(M.beliefs(*_both(spark)))


_DAYS = "d0 AS (SELECT device_id, date, bus_id FROM assigned)"


def _sql_runs(days: str, name: str) -> str:
    return f"""{name}0 AS (SELECT *, CASE WHEN lag(bus_id) OVER w = bus_id AND date - lag(date) OVER w = 1 THEN 0 ELSE 1 END AS new FROM {days} WINDOW w AS (PARTITION BY device_id ORDER BY date)),
{name}1 AS (SELECT *, sum(new) OVER (PARTITION BY device_id ORDER BY date) AS run FROM {name}0),
{name} AS (SELECT device_id, run, bus_id, min(date) AS f, max(date) AS t, count(*) AS n, sum(corrected) AS c FROM {name}1 GROUP BY device_id, run, bus_id)"""


_SMOOTH = f"""{_DAYS}, e0 AS (SELECT *, 0 AS corrected FROM d0), {_sql_runs('e0', 'r')},
r2 AS (SELECT *, lag(bus_id) OVER w AS before, lead(bus_id) OVER w AS after FROM r WINDOW w AS (PARTITION BY device_id ORDER BY run)),
fix AS (SELECT device_id, f AS date, bus_id AS from_bus, before AS to_bus FROM r2 WHERE n = 1 AND before = after AND before <> bus_id AND NOT EXISTS (SELECT 1 FROM d0 WHERE d0.bus_id = before AND d0.date = f AND d0.device_id <> r2.device_id)),
e1 AS (SELECT d0.device_id, d0.date, coalesce(to_bus, bus_id) AS bus_id, CASE WHEN to_bus IS NULL THEN 0 ELSE 1 END AS corrected FROM d0 LEFT JOIN fix USING (device_id, date)), {_sql_runs('e1', 'q')},
q2 AS (SELECT *, lag(bus_id) OVER w AS before, lag(t) OVER w AS last FROM q WINDOW w AS (PARTITION BY device_id ORDER BY run)),
q3 AS (SELECT *, CASE WHEN before = bus_id AND NOT EXISTS (SELECT 1 FROM d0 WHERE d0.bus_id = q2.bus_id AND d0.date > last AND d0.date < f AND d0.device_id <> q2.device_id) THEN 0 ELSE 1 END AS cut FROM q2),
q4 AS (SELECT *, sum(cut) OVER (PARTITION BY device_id ORDER BY run) AS part FROM q3),
i AS (SELECT device_id, bus_id, min(f) AS from_date, max(t) AS to_date, CAST(sum(n) AS BIGINT) AS n_days, CAST(sum(c) AS BIGINT) AS n_corrected FROM q4 GROUP BY device_id, bus_id, part)"""


@query("m10_smoothing", f"WITH {_SMOOTH} SELECT * FROM i")
def _(spark: SparkSession) -> DataFrame:
    return M.smooth_devices(spark.table("assigned"))[0]


@query("m10_corrections", f"WITH {_SMOOTH} SELECT * FROM fix")
def _(spark: SparkSession) -> DataFrame:
    return M.smooth_devices(spark.table("assigned"))[1]


@query(
    "m11_extension",
    f"""WITH {_SMOOTH}, o AS (SELECT device_id, date, bus_id FROM e1), one AS (SELECT bus_id, min(device_id) AS device_id FROM i GROUP BY bus_id HAVING count(DISTINCT device_id) = 1),
run AS (SELECT DISTINCT bus_id, date FROM candidates),
x AS (SELECT one.bus_id, device_id, date, EXISTS (SELECT 1 FROM i WHERE i.bus_id = one.bus_id AND date BETWEEN from_date AND to_date) AS covered FROM one JOIN run ON run.bus_id = one.bus_id),
y AS (SELECT *, lag(date) OVER (PARTITION BY bus_id ORDER BY date) AS last FROM x WHERE covered OR NOT EXISTS (SELECT 1 FROM o WHERE o.device_id = x.device_id AND o.date = x.date AND o.bus_id <> x.bus_id)),
z AS (SELECT *, CASE WHEN last IS NOT NULL AND NOT EXISTS (SELECT 1 FROM o WHERE o.device_id = y.device_id AND o.date BETWEEN last AND y.date AND o.bus_id <> y.bus_id) THEN 0 ELSE 1 END AS cut FROM y),
g AS (SELECT bus_id, device_id, part, min(date) AS from_date, max(date) AS to_date, count(*) FILTER (WHERE NOT covered) AS n_extended FROM (SELECT *, sum(cut) OVER (PARTITION BY bus_id ORDER BY date) AS part FROM z) z1 GROUP BY bus_id, device_id, part)
SELECT g.device_id, g.bus_id, g.from_date, g.to_date, g.n_extended, CAST(coalesce(sum(i.n_days), 0) AS BIGINT) AS n_days, CAST(coalesce(sum(i.n_corrected), 0) AS BIGINT) AS n_corrected FROM g LEFT JOIN i ON i.bus_id = g.bus_id AND i.from_date >= g.from_date AND i.to_date <= g.to_date GROUP BY ALL
UNION ALL SELECT device_id, bus_id, from_date, to_date, 0, n_days, n_corrected FROM i WHERE bus_id NOT IN (SELECT bus_id FROM one JOIN run USING (bus_id))""",
)
def _(spark: SparkSession) -> DataFrame:
    a = spark.table("assigned")
    intervals, corrections = M.smooth_devices(a)
    return M.extend_single(intervals, spark.table("candidates").select("bus_id", "date").distinct(), M.corrected_owners(a, corrections))


@query("c04_one_bus_a_device", f"WITH {_CAST}, {_raw('a')}, {_summary('a', 's')} SELECT date, top_device AS device_id, count(*) AS buses FROM s WHERE confident AND decision = 'match' GROUP BY date, top_device HAVING count(*) > 1")
def _(spark: SparkSession) -> DataFrame:
    """Devices that independent beliefs give to several buses on a date; assignment leaves none (tested)."""
    s = M.summary(M.beliefs(*_both(spark))).where("confident and decision = 'match'")
    return s.groupBy("date", F.col("top_device").alias("device_id")).agg(F.count(F.lit(1)).alias("buses")).where("buses > 1")
