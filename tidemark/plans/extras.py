"""Extensions: what the engine gives beyond the reference's operators, each as a registered query."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import extensions
from tidemark.plans.catalogue import query
from tidemark.plans.facts import cents, table

TEXT = """WITH totals AS (SELECT o_custkey, count(*) AS n, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents FROM orders GROUP BY o_custkey HAVING count(*) >= 8)
SELECT c_custkey, coalesce(n, 0) AS n, CAST(coalesce(cents, 0) AS BIGINT) AS cents FROM customer LEFT JOIN totals ON o_custkey = c_custkey WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey AND n_regionkey < 3)"""


@query(TEXT)
def q_sql_text(spark, d):
    """The same text for both engines: a common table expression, HAVING, an outer join and a correlated subquery."""
    return extensions.run_sql(spark, {t: table(spark, d, t) for t in ("orders", "customer", "nation")}, TEXT.replace("FROM orders", "FROM {orders}").replace("FROM customer", "FROM {customer}").replace("FROM nation", "FROM {nation}"))


@query("""SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) * 2 + grouping(l_linestatus) AS BIGINT) AS level, count(*) AS n, CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS BIGINT) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def q_cube(spark, d):
    rows = table(spark, d, "lineitem").withColumn("q", F.round("l_quantity").cast("long"))
    return rows.cube("l_returnflag", "l_linestatus").agg(F.grouping_id().cast("long").alias("level"), F.count("*").alias("n"), F.sum("q").alias("quantity"))


@query("""SELECT event_type, quantile_disc(cents, 0.5) AS p50, quantile_disc(cents, 0.95) AS p95, quantile_disc(cents, 0.99) AS p99 FROM (SELECT event_type, CAST(round(value * 100) AS BIGINT) AS cents FROM events) GROUP BY event_type""")
def q_percentiles(spark, d):
    return extensions.percentiles(table(spark, d, "events").withColumn("cents", cents("value")), ["event_type"], "cents", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("""SELECT event_id, CAST(sum(cents) OVER w AS BIGINT) AS moving_sum, count(*) OVER w AS moving_count FROM (SELECT *, CAST(round(value * 100) AS BIGINT) AS cents FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""")
def q_moving_sum(spark, d):
    rows = table(spark, d, "events").withColumn("cents", cents("value"))
    return extensions.moving_sums(rows, "user_id", ["ts", "event_id"], "cents", 7).select("event_id", "moving_sum", "moving_count")


@query("""SELECT o_orderkey, rank() OVER p AS r, dense_rank() OVER p AS dr, ntile(4) OVER k AS quarter, first_value(o_orderkey) OVER k AS first_key, coalesce(lead(o_orderkey) OVER k, -1) AS next_key FROM orders
WINDOW p AS (PARTITION BY o_custkey ORDER BY o_orderpriority), k AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")
def q_rankings(spark, d):
    from pyspark.sql import Window

    p, k = Window.partitionBy("o_custkey").orderBy("o_orderpriority"), Window.partitionBy("o_custkey").orderBy("o_orderkey")
    whole = lambda c: c.cast("long")
    return table(spark, d, "orders").select("o_orderkey", whole(F.rank().over(p)).alias("r"), whole(F.dense_rank().over(p)).alias("dr"), whole(F.ntile(4).over(k)).alias("quarter"), F.first("o_orderkey").over(k).alias("first_key"), F.coalesce(F.lead("o_orderkey").over(k), F.lit(-1)).alias("next_key"))


@query("""SELECT 'both' AS side, k FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 0 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) UNION ALL
SELECT 'customers' AS side, k FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 0 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)""")
def q_intersect_except(spark, d):
    customers = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_nationkey").alias("k"))
    suppliers = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))
    side = lambda df, name: df.select(F.lit(name).alias("side"), "k")
    return side(customers.intersect(suppliers), "both").unionAll(side(customers.subtract(suppliers), "customers"))


@query("""WITH marked AS (SELECT user_id, ts, CAST(round(value * 100) AS BIGINT) AS cents, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM marked)
SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total FROM numbered GROUP BY user_id, s""")
def q_session_windows(spark, d):
    return extensions.session_windows(table(spark, d, "events").withColumn("cents", cents("value")), "user_id", "ts", "6 hours", "cents")


@query("""SELECT s AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS s FROM events) GROUP BY ALL""")
def q_sliding_windows(spark, d):
    found = table(spark, d, "events").groupBy(F.window("ts", "12 hours", "6 hours"), "event_type").agg(F.count("*").alias("n"))
    return found.select(F.col("window.start").alias("start"), "event_type", "n")


@query("""SELECT c_custkey, o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderkey DESC LIMIT 2)""")
def q_lateral_top(spark, d):
    customers = table(spark, d, "customer").select("c_custkey")
    each = table(spark, d, "orders").where(F.col("o_custkey") == F.col("c_custkey").outer()).orderBy(F.desc("o_orderkey")).limit(2).select("o_orderkey")
    return customers.lateralJoin(each)


@query("""WITH said AS (SELECT user_id, event_id, ts, event_type IN ('error', 'refund') AS bad FROM events), numbered AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM said)
SELECT event_id, CAST(sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS BIGINT) AS run, sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY ts, event_id) >= 2 AS open FROM numbered""")
def q_breaker(spark, d):
    found = extensions.breaker_states(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type").isin("error", "refund"), 2)
    return found.select("event_id", F.col("run").cast("long").alias("run"), "open")
