"""Queries that write files in a raw format or layout and read them back through a source or sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farelane.plans.catalog import query
from farelane.session import scratch
from farelane.sources import avl, sinks
from farelane.streaming import jobs

_LINE = "concat_ws(',', CAST(event_id % 2 AS STRING), CASE WHEN event_id % 11 <> 0 THEN '-3.5' ELSE '' END, '-38.5', CASE WHEN event_id % 13 = 0 THEN 'x' ELSE date_format(CAST(ts AS TIMESTAMP), 'yyyyMMddHHmmss') END, '10', '0', CASE WHEN event_id % 17 = 0 THEN '' ELSE '33' END, CAST(user_id AS STRING), CAST(event_id AS STRING)) AS value"


def _avl(spark: SparkSession) -> DataFrame:
    path = scratch(spark, "avl")
    spark.sql(f"SELECT {_LINE} FROM events").write.text(path)
    return avl.read(spark, path)


@query("s01_avl_csv", "SELECT CAST(event_id AS INT) AS vehicle_id, CASE WHEN event_id % 11 <> 0 THEN -3.5e0 END AS latitude, CAST(ts AS DATE) AS event_date FROM events WHERE event_id % 13 <> 0 AND event_id % 17 <> 0")
def _(spark: SparkSession) -> DataFrame:
    return avl.typed(_avl(spark))[0].select("vehicle_id", "latitude", "event_date")


@query("s16_quarantine", "SELECT CAST(event_id AS VARCHAR) AS vehicle_id, CASE WHEN event_id % 17 = 0 THEN 'missing field' ELSE 'bad time' END AS reason FROM events WHERE event_id % 13 = 0 OR event_id % 17 = 0")
def _(spark: SparkSession) -> DataFrame:
    return avl.typed(_avl(spark))[1].select("vehicle_id", "reason")


@query("s11_hive_partitions", "SELECT CAST(ts AS DATE) AS partition_date, count(*) AS n FROM events GROUP BY 1")
def _(spark: SparkSession) -> DataFrame:
    path = sinks.write_bronze(spark.table("events").withColumn("event_date", F.to_date("ts")), scratch(spark, "bronze"), "events")
    return sinks.read_bronze(spark, path).groupBy("partition_date").agg(F.count(F.lit(1)).alias("n"))


@query("s12_latest_snapshot", "SELECT max(CAST(ts AS DATE)) AS latest FROM events")
def _(spark: SparkSession) -> DataFrame:
    path = sinks.write_bronze(spark.table("events").withColumn("event_date", F.to_date("ts")), scratch(spark, "bronze"), "events")
    return sinks.read_bronze(spark, path).agg(F.max("partition_date").alias("latest"))


@query("k01_write_bronze", "SELECT CAST(ts AS DATE) AS event_date, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY 1")
def _(spark: SparkSession) -> DataFrame:
    rows = spark.table("events").withColumn("event_date", F.to_date("ts")).select("event_id", "event_date")
    root = scratch(spark, "bronze")
    sinks.write_bronze(rows.withColumn("event_id", -F.col("event_id")), root, "events")
    path = sinks.write_bronze(rows, root, "events")
    return spark.read.parquet(path).groupBy("event_date").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("k02_replace_period", "SELECT month(ts) * 100 + day(ts) AS period, count(*) AS n, CAST(sum(CASE WHEN day(ts) <= 3 THEN -event_id ELSE event_id END) AS BIGINT) AS ids FROM events GROUP BY 1")
def _(spark: SparkSession) -> DataFrame:
    rows = spark.table("events").select("event_id", (F.month("ts") * 100 + F.day("ts")).alias("period"), F.day("ts").alias("d"))
    path = scratch(spark, "periods")
    sinks.replace_period(rows, path, "period")
    for _ in range(2):  # twice: the second run changes nothing
        sinks.replace_period(rows.where("d <= 3").withColumn("event_id", -F.col("event_id")), path, "period")
    return spark.read.parquet(path).groupBy(F.col("period").cast("long").alias("period")).agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("k05_backfill", "SELECT trip_id, coalesce(n, 0) AS n FROM trips LEFT JOIN (SELECT trip_id AS id, count(*) AS n FROM taps WHERE kind = 'R' GROUP BY trip_id) x ON id = trip_id")
def _(spark: SparkSession) -> DataFrame:
    n = spark.table("taps").where("kind = 'R'").groupBy("trip_id").agg(F.count(F.lit(1)).alias("n"))
    return sinks.backfill(spark.table("trips").select("trip_id", F.lit(None).cast("long").alias("n")), n, ["trip_id"], "n", 0)


@query("k06_insert_missing", "SELECT c_custkey AS k, c_name AS label FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT k, label FROM (SELECT o_custkey AS k, min(o_orderpriority) AS label FROM orders GROUP BY o_custkey) o WHERE k NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def _(spark: SparkSession) -> DataFrame:
    old = spark.table("customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("label"))
    return sinks.insert_missing(old, spark.table("orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("label")), ["k"])


@query("k09_constraints", "SELECT 'unique l_orderkey,l_linenumber' AS rule, count(*) AS n FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) x UNION ALL SELECT 'check l_quantity < 50', count(*) FROM lineitem WHERE l_quantity >= 50")
def _(spark: SparkSession) -> DataFrame:
    return sinks.violations(spark.table("lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey"], "l_quantity < 50", ("l_orderkey", spark.table("orders"), "o_orderkey"))


@query("k11_release", "SELECT count(*) AS n, min(trip_id) AS least FROM trips")
def _(spark: SparkSession) -> DataFrame:
    root = scratch(spark, "lake")
    sinks.release(spark, root, "monthly", {"trips": spark.table("trips").where("trip_id < 0")})
    sinks.release(spark, root, "monthly", {"trips": spark.table("trips")})
    return sinks.open_release(spark, root, "monthly")["trips"].agg(F.count(F.lit(1)).alias("n"), F.min("trip_id").alias("least"))


@query("k04_create_and_insert", "SELECT route_id, count(*) AS n, CAST(NULL AS INT) AS direction FROM trips GROUP BY route_id UNION ALL SELECT NULL, count(*), direction FROM trips GROUP BY direction")
def _(spark: SparkSession) -> DataFrame:
    path = scratch(spark, "made")
    sinks.create_as(spark.sql("SELECT route_id, count(*) AS n, CAST(NULL AS INT) AS direction FROM trips GROUP BY route_id"), path)
    sinks.append(spark.sql("SELECT direction, count(*) AS n FROM trips GROUP BY direction"), path)
    return spark.read.parquet(path)


@query("k07_replace_all", "SELECT trip_id, status FROM trips WHERE status <> 'F'")
def _(spark: SparkSession) -> DataFrame:
    path = scratch(spark, "whole")
    spark.table("trips").select("trip_id", "status").write.parquet(path)
    sinks.replace_all(spark.read.parquet(path).where("status <> 'F'"), path)
    return spark.read.parquet(path)


@query("k08_generated_columns", "SELECT trip_id, seq, fare_cents / 100e0 AS fare, stop_id * 1000 + seq AS stop_key FROM taps")
def _(spark: SparkSession) -> DataFrame:
    path = scratch(spark, "generated")
    sinks.create_as(sinks.with_generated(spark.table("taps").select("trip_id", "seq", "stop_id", "fare_cents"), fare="fare_cents / 100e0", stop_key="stop_id * 1000 + seq"), path)
    return spark.read.parquet(path).select("trip_id", "seq", "fare", "stop_key")


@query("k10_load_then_index", "SELECT 'route_id' AS col, count(*) AS n, count(*) FILTER (WHERE route_id IS NULL) AS nulls, min(route_id) AS least, max(route_id) AS most FROM trips UNION ALL SELECT 'trip_id', count(*), count(*) FILTER (WHERE trip_id IS NULL), CAST(min(trip_id) AS VARCHAR), CAST(max(trip_id) AS VARCHAR) FROM trips")
def _(spark: SparkSession) -> DataFrame:
    out = sinks.load_then_index(spark.table("trips"), scratch(spark, "indexed"), ["route_id"], ["trip_id"])
    return out.select(F.col("column").alias("col"), "n", "nulls", "least", "most")


@query("k12_comments", "SELECT * FROM (VALUES ('fare', 'taps: fare_cents / 100'), ('trip_id', 'orders: o_orderkey'), (NULL, 'one row for each fare')) AS v(col, comment)")
def _(spark: SparkSession) -> DataFrame:
    path = scratch(spark, "described")
    made = sinks.create_as(spark.sql("SELECT trip_id, fare_cents / 100e0 AS fare FROM taps"), path, "one row for each fare", {"trip_id": "orders: o_orderkey", "fare": "taps: fare_cents / 100"})
    return sinks.comments(made).withColumnRenamed("column", "col")


@query("k13_copy_lines", "SELECT event_id, user_id, event_type FROM events")
def _(spark: SparkSession) -> DataFrame:
    lines = spark.sql("SELECT concat_ws(',', event_id, user_id, event_type) AS value FROM events")
    return sinks.load_csv(spark, lines, "event_id long, user_id long, event_type string")


def _stream(spark: SparkSession) -> DataFrame:
    path = scratch(spark, "stream")
    spark.table("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "user_id").write.parquet(path)
    return spark.readStream.schema("event_id long, ts timestamp, event_type string, user_id long").parquet(path)


def _drained(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    out = scratch(spark, "sink")

    def keep(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    jobs.drain(stream, keep, scratch(spark, "progress"), mode).awaitTermination()
    return spark.read.parquet(out).drop("batch")


@query("t03_replace_batches", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
def _(spark: SparkSession) -> DataFrame:
    out = scratch(spark, "days")
    jobs.drain(_stream(spark).withColumn("day", F.to_date("ts")), jobs.replace_days(out, "day"), scratch(spark, "progress")).awaitTermination()
    return spark.read.parquet(out).groupBy("day").agg(F.count(F.lit(1)).alias("n"))


@query("t04_tumbling_windows", "SELECT event_type, CAST(floor(epoch_us(ts) / 900e6) AS BIGINT) AS bucket, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark: SparkSession) -> DataFrame:
    out = _drained(spark, jobs.tumbling(_stream(spark), "ts", ["event_type"]), "complete")
    return out.select("event_type", F.floor(F.unix_seconds("start") / 900).alias("bucket"), "n")


@query("t05_session_windows", "WITH s AS (SELECT user_id, ts, sum(CASE WHEN ts - lag_ts <= INTERVAL 2 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS lag_ts FROM events) x) SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS started_us, count(*) AS n FROM s GROUP BY user_id, k")
def _(spark: SparkSession) -> DataFrame:
    out = _drained(spark, jobs.sessions(_stream(spark), "ts", ["user_id"], "2 hours", "62 days"), "complete")
    return out.select("user_id", F.unix_micros("started").alias("started_us"), "n")


@query("t07_once_per_event", "SELECT count(*) + count(*) FILTER (WHERE event_id = 0) AS n FROM events")
def _(spark: SparkSession) -> DataFrame:
    doubled = _stream(spark)
    twice = doubled.unionByName(doubled.withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 SECOND")))
    return _drained(spark, jobs.once_per_event(twice, "ts", "event_id"), "append").agg(F.count(F.lit(1)).alias("n"))


@query("t02_late_rows", "SELECT event_id % 100 < 5 AS late, count(*) AS n FROM events GROUP BY 1")
def _(spark: SparkSession) -> DataFrame:
    s = _stream(spark).withColumn("delivered", F.when(F.col("event_id") % 100 < 5, F.add_months(F.to_date("ts"), 4)).otherwise(F.to_date("ts")))
    fine, late = jobs.split_late(s, "ts", "delivered")
    both = fine.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True)))
    return _drained(spark, both.select("late"), "append").groupBy("late").agg(F.count(F.lit(1)).alias("n"))
