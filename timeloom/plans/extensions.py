"""Extensions: standard relational queries beyond the timeline operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timeloom.functions import scalars
from timeloom.plans.inputs import STRIP
from timeloom.session import load
from timeloom.sources import npy, readers
from timeloom.storage import shared_dir, written
from timeloom.streaming import streams

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@_query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def x_pricing_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "lineitem").where(F.col("l_shipdate") <= F.expr("TIMESTAMP_NTZ'1998-09-02 00:00:00'"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"),
    )


@_query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name = 'ASIA' GROUP BY n_name""")
def x_region_revenue(spark: SparkSession, d: str) -> DataFrame:
    li, o, c = load(spark, d, "lineitem"), load(spark, d, "orders"), load(spark, d, "customer")
    # Nations and regions are fixed small dimensions.
    n = load(spark, d, "nation").join(F.broadcast(load(spark, d, "region").where("r_name = 'ASIA'")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name")
    joined = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@_query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def x_anti_join(spark: SparkSession, d: str) -> DataFrame:
    c, o = load(spark, d, "customer"), load(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@_query("SELECT s_suppkey, c_custkey FROM (SELECT * FROM supplier WHERE s_acctbal > 5000) FULL JOIN (SELECT * FROM customer WHERE c_acctbal > 9000) ON s_suppkey = c_custkey")
def x_full_outer(spark: SparkSession, d: str) -> DataFrame:
    s, c = load(spark, d, "supplier").where("s_acctbal > 5000"), load(spark, d, "customer").where("c_acctbal > 9000")
    return s.join(c, s.s_suppkey == c.c_custkey, "full").select("s_suppkey", "c_custkey")


@_query("SELECT l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus) AS gid, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def x_cube(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"))


@_query("SELECT user_id, count(DISTINCT event_type) AS kinds, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY user_id")
def x_distinct(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").groupBy("user_id").agg(F.count_distinct("event_type").alias("kinds"), F.count_distinct(F.to_date("ts")).alias("days"))


@_query("""SELECT o_orderkey, rank() OVER w AS rk, dense_rank() OVER w AS drk, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS quartile, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before_,
 round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""")
def x_windows(spark: SparkSession, d: str) -> DataFrame:
    w, k = Window.partitionBy("o_custkey").orderBy("o_orderpriority"), Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return load(spark, d, "orders").select(
        "o_orderkey", F.rank().over(w).alias("rk"), F.dense_rank().over(w).alias("drk"), F.ntile(4).over(k).alias("quartile"), F.lag("o_orderkey").over(k).alias("before_"),
        F.round(F.sum("o_totalprice").over(k.rowsBetween(-2, 0)), 2).alias("moving"),
    )


@_query("SELECT user_id AS k FROM events WHERE event_type = 'error' INTERSECT SELECT user_id FROM events WHERE event_type = 'view'")
def x_intersect(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events")
    return e.where("event_type = 'error'").select(F.col("user_id").alias("k")).intersect(e.where("event_type = 'view'").select("user_id"))


@_query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT c_nationkey FROM customer WHERE c_nationkey % 3 = 1")
def x_except(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "nation").select(F.col("n_nationkey").alias("k")).exceptAll(load(spark, d, "customer").where("c_nationkey % 3 = 1").select("c_nationkey").distinct())


@_query("SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def x_by_month(spark: SparkSession, d: str) -> DataFrame:
    month = F.make_date(F.year("o_orderdate"), F.month("o_orderdate"), F.lit(1)).cast("timestamp_ntz")
    return load(spark, d, "orders").groupBy(month.alias("month"), "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2000-01-01') AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def x_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


@_query("""SELECT e.event_id, v.event_id AS last_view FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON e.user_id = v.user_id AND e.ts >= v.ts""")
def x_as_of(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    view = F.when(F.col("event_type") == "view", F.col("event_id"))
    return load(spark, d, "events").select("event_id", F.last(view, True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("last_view"))


@_query("SELECT l_orderkey, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey AND l_extendedprice > p_retailprice * 40 * (1 - l_discount)")
def x_theta_residual(spark: SparkSession, d: str) -> DataFrame:
    li, p = load(spark, d, "lineitem"), load(spark, d, "part")
    return li.join(p, (li.l_partkey == p.p_partkey) & (li.l_extendedprice > p.p_retailprice * 40 * (1 - li.l_discount))).select("l_orderkey", "l_linenumber")


@_query()
def x_approximate(spark: SparkSession, d: str) -> DataFrame:
    """Approximate counts and quantiles; sketches differ between engines, so there is no SQL."""
    return load(spark, d, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("users"), F.percentile_approx("value", 0.5).alias("median"))


@_query("SELECT event_type, count(DISTINCT user_id) AS users, TRUE AS within_bound FROM events GROUP BY event_type")
def x_daily_sketches(spark: SparkSession, d: str) -> DataFrame:
    """Distinct users by type from sketches that are stored by day and merged later, held against the exact count.

    A sketch of 2**12 registers is off by more than five times its standard error, 1.04 / 64,
    in fewer than one case in a million.
    """
    events = load(spark, d, "events")
    stored = written(events.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.hll_sketch_agg("user_id", 12).alias("sketch")))
    merged = stored.groupBy("event_type").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
    exact = events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))
    return exact.join(merged, "event_type").select("event_type", "users", (F.abs(F.col("estimate") - F.col("users")) <= 5 * 1.04 / 64 * F.col("users") + 1).alias("within_bound"))


@_query("SELECT embedding AS vector FROM embeddings")
def s9_npy(spark: SparkSession, d: str) -> DataFrame:
    """The vectors written to files by tasks, and read again a thousand rows at a time."""
    out = shared_dir(spark)
    npy.write_npy(load(spark, d, "embeddings"), "embedding", out).collect()
    return npy.read_npy(spark, out, rows=1000).select("vector")


@_query("SELECT conv_id AS run_id, role AS stage, turn AS attempt, text FROM conversations")
def s11_raw_output(spark: SparkSession, d: str) -> DataFrame:
    """Raw replies appended to the audit table, those of even and odd attempts apart, and read back."""
    out = shared_dir(spark)
    replies = load(spark, d, "conversations").select(F.col("conv_id").alias("run_id"), F.col("role").alias("stage"), F.col("turn").alias("attempt"), "text")
    for half in (0, 1):
        readers.dump_raw_output(replies.where(F.col("attempt") % 2 == half), out)
    return spark.read.schema(replies.schema).parquet(out).select(replies.columns)


@_query(f"SELECT conv_id, turn, {STRIP.format("chr(160) || ' ' || text || chr(8195) || chr(10)")} AS stripped FROM conversations")
def t11_strip(spark: SparkSession, d: str) -> DataFrame:
    """White space of all kinds goes from both ends."""
    padded = F.concat(F.lit("\u00a0 "), F.col("text"), F.lit("\u2003\n"))
    return load(spark, d, "conversations").select("conv_id", "turn", scalars.strip(padded).alias("stripped"))


@_query(r"SELECT doc_id, len(lines)::BIGINT AS n_lines, md5(array_to_string(lines, '|')) AS digest FROM (SELECT doc_id, string_split_regex(replace(text, ' ', chr(8232)), '\r\n|[\n\x0b\x0c\r\x{85}\x{2028}\x{2029}]') AS lines FROM documents WHERE text IS NOT NULL)")
def t12_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of each text, in which line separators stand for blanks: their number and a digest."""
    texts = load(spark, d, "documents").where("text IS NOT NULL").select("doc_id", scalars.lines_of(F.translate("text", " ", "\u2028")).alias("lines"))
    return texts.select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.md5(F.array_join("lines", "|").cast("binary")).alias("digest"))


@_query("""SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '6 hours' AS session_end, count(*) AS n_events
FROM (SELECT user_id, ts, sum(CASE WHEN ts - p < INTERVAL '6 hours' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
  FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events))
GROUP BY user_id, s HAVING max(ts) + INTERVAL '6 hours' <= (SELECT max(ts) - INTERVAL '1 day' FROM events)""")
def x_session_stream(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of the events as a stream, written as far as the watermark has closed them."""
    events = load(spark, d, "events")
    s = streams.file_stream(spark, d, events.schema, "events.parquet")
    out = streams.drain(streams.session_stream(s, "user_id", "ts", "6 hours", "1 day"))
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), F.col("session_end").cast("timestamp_ntz").alias("session_end"), "n_events")


@_query("""SELECT w AS window_start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL '2 hours', ts, TIMESTAMP '2000-01-01') - INTERVAL '2 hours' * i FOR i IN range(0, 3)]) AS w FROM events) GROUP BY 1, 2""")
def x_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Counts in windows of six hours, one every two hours."""
    return load(spark, d, "events").groupBy(F.window("ts", "6 hours", "2 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")


@_query("SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linenumber), ())")
def x_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber")
    keys = [F.col(c) for c in rows.columns]
    return rows.groupingSets([keys[:2], keys[2:], []], *keys).agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT r_name, n_name FROM region CROSS JOIN nation WHERE n_regionkey <> r_regionkey")
def x_cross(spark: SparkSession, d: str) -> DataFrame:
    """Two fixed small dimensions."""
    return load(spark, d, "region").crossJoin(load(spark, d, "nation")).where("n_regionkey <> r_regionkey").select("r_name", "n_name")


@_query("SELECT p_partkey, band FROM part JOIN (VALUES ('low', 0.0, 950.0), ('mid', 950.0, 1250.0), ('high', 1250.0, 1e9)) b(band, lo, hi) ON p_retailprice >= lo AND p_retailprice < hi")
def x_price_bands(spark: SparkSession, d: str) -> DataFrame:
    """A join on inequalities alone, against three bands: a nested loop over a broadcast side of three rows."""
    bands = spark.createDataFrame([("low", 0.0, 950.0), ("mid", 950.0, 1250.0), ("high", 1250.0, 1e9)], "band string, lo double, hi double")
    p = load(spark, d, "part")
    return p.join(F.broadcast(bands), (p.p_retailprice >= bands.lo) & (p.p_retailprice < bands.hi)).select("p_partkey", "band")


@_query("SELECT conv_id, turn, CAST(ceil(length(text) / 4.0::DOUBLE) AS BIGINT) AS tokens FROM conversations")
def x_udf(spark: SparkSession, d: str) -> DataFrame:
    """A vectorised scalar function over Arrow batches."""
    @F.pandas_udf("long")
    def tokens(text: pd.Series) -> pd.Series:
        return -(-text.str.len() // 4)

    return load(spark, d, "conversations").select("conv_id", "turn", tokens("text").alias("tokens"))


@_query("SELECT event_type, round(sum(value * value) / sum(value), 6) AS weighted FROM events GROUP BY event_type")
def x_udaf(spark: SparkSession, d: str) -> DataFrame:
    """A vectorised aggregate: each value weighed by itself. It needs a group's values together, so they are summed by part first."""
    @F.pandas_udf("double")
    def ratio(above: pd.Series, below: pd.Series) -> float:
        return above.sum() / below.sum()

    parts = load(spark, d, "events").groupBy("event_type", F.pmod(F.xxhash64("event_id"), F.lit(64)).alias("part")).agg(F.sum(F.col("value") * F.col("value")).alias("above"), F.sum("value").alias("below"))
    return parts.groupBy("event_type").agg(F.round(ratio("above", "below"), 6).alias("weighted"))


@_query("SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, parts[i] AS part FROM (SELECT page_id, string_split(url, '/') AS parts FROM pages), range(1, 100) r(i) WHERE i <= len(parts)")
def x_udtf(spark: SparkSession, d: str) -> DataFrame:
    """A table function: rows of the parts of each address."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="pos int, part string")
    class Parts:
        def eval(self, url: str):
            yield from enumerate(url.split("/"))

    return load(spark, d, "pages").lateralJoin(Parts(F.col("url").outer())).select("page_id", "pos", "part")
