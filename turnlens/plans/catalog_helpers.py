"""Catalog entries for the column helpers, small joins and reports
(registered into :data:`turnlens.plans.catalog.QUERIES`)."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnlens.functions import columns as col
from turnlens.operators import aggregate as agg, keyed, rank
from turnlens.plans.catalog import EVENT_TYPES, MONEY, _events, _r, domain, query
from turnlens.plans.oracles import _DAY, _M, ORACLES
from turnlens.sources.tables import register_all, table


# S23 — a SQL text over the registered tables; Catalyst pushes it into the scans
SQL_READ = f"""
SELECT c_mktsegment, o_orderstatus, count(*) AS n_orders,
  CAST(sum(CAST(o_totalprice AS {_M})) AS {_M}) AS total
FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderpriority = '1-URGENT' GROUP BY c_mktsegment, o_orderstatus"""


@query("sql_read", "S23 J02")
def sql_read(spark, sf):
    register_all(spark, sf)
    return spark.sql(SQL_READ)


ORACLES["sql_read"] = SQL_READ


# A07 — first day per (player, type), mean of them per type, difference from it
@query("first_day_delta", "A07")
def first_day_delta(spark, sf):
    first = _events(spark, sf).groupBy("user_id", "event_type").agg(F.min("day").alias("first_day"))
    mean = first.groupBy("event_type").agg(F.avg("first_day").alias("mean_day"))
    return first.join(mean, "event_type").select(
        "user_id", "event_type", "first_day", _r(F.col("mean_day")).alias("mean_day"),
        _r(F.col("first_day") - F.col("mean_day")).alias("delta"))


ORACLES["first_day_delta"] = f"""
WITH f AS (SELECT user_id, event_type, min({_DAY}) AS first_day FROM events GROUP BY 1, 2),
m AS (SELECT event_type, avg(first_day) AS mean_day FROM f GROUP BY 1)
SELECT user_id, event_type, first_day, round(mean_day, 6) AS mean_day,
  round(first_day - mean_day, 6) AS delta FROM f JOIN m USING (event_type)"""


# J04 — three facts joined on the same keys, aggregated to them first
@query("three_way_same_keys", "J04 A13")
def three_way_same_keys(spark, sf):
    ev, keys = _events(spark, sf), ["user_id", "day"]
    spent = ev.filter("event_type = 'purchase'").groupBy(*keys).agg(
        F.sum(F.col("value").cast(MONEY)).cast(MONEY).alias("spent"))
    views = ev.filter("event_type = 'view'").groupBy(*keys).agg(F.count(F.lit(1)).alias("views"))
    clicks = ev.filter("event_type = 'click'").groupBy(*keys).agg(F.count(F.lit(1)).alias("clicks"))
    return spent.join(views, keys).join(clicks, keys)


ORACLES["three_way_same_keys"] = f"""
WITH e AS (SELECT *, {_DAY} AS day FROM events),
s AS (SELECT user_id, day, CAST(sum(CAST(value AS {_M})) AS {_M}) AS spent FROM e
      WHERE event_type = 'purchase' GROUP BY 1, 2),
v AS (SELECT user_id, day, count(*) AS views FROM e WHERE event_type = 'view' GROUP BY 1, 2),
c AS (SELECT user_id, day, count(*) AS clicks FROM e WHERE event_type = 'click' GROUP BY 1, 2)
SELECT user_id, day, spent, views, clicks FROM s JOIN v USING (user_id, day) JOIN c USING (user_id, day)"""


# Q02 — keys that the dictionary lacks, with how often they occur
@query("unknown_key_report", "Q02 J16")
def unknown_key_report(spark, sf):
    ev = table(spark, sf, "events")
    known = table(spark, sf, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    return ev.join(known, "user_id", "left_anti").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rows"))


ORACLES["unknown_key_report"] = """
SELECT user_id, count(*) AS n_rows FROM events
WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY user_id"""


# P04 P05 — flags of all rows and of event rows only, averaged to shares
@query("one_hot_shares", "P04 P05")
def one_hot_shares(spark, sf):
    ev = table(spark, sf, "events")
    types = domain(ev, "event_type", EVENT_TYPES)
    costly = F.col("value") > 25
    flags = ev.withColumns({**col.one_hot("event_type", types, "is_"),
                            **col.one_hot_events_only("event_type", types, costly, "costly_")})
    return flags.groupBy("user_id").agg(
        *[F.sum(f"is_{t}").alias(f"n_{t}") for t in types],
        *[_r(F.avg(f"costly_{t}")).alias(f"costly_{t}") for t in types])


ORACLES["one_hot_shares"] = "SELECT user_id, " + ", ".join(
    f"CAST(count_if(event_type = '{t}') AS BIGINT) AS n_{t}, "
    f"round(avg(CASE WHEN value > 25 THEN CASE WHEN event_type = '{t}' THEN 1.0 ELSE 0.0 END END), 6) "
    f"AS costly_{t}" for t in EVENT_TYPES) + " FROM events GROUP BY user_id"


# P01 P21 P23 P26 P30 F02 F04 — the column helpers on the part table
@query("column_helpers", "P01 P21 P23 P30 F02 F04")
def column_helpers(spark, sf):
    p = table(spark, sf, "part")
    return p.select(
        "p_partkey",
        col.strip_suffix("p_brand", r"#\d+$").alias("brand_kind"),
        col.fixed_point("p_size").alias("size_scaled"),
        F.expr("CAST(p_size DIV 10 AS INT)").alias("grid_row"),
        (F.col("p_size") % 10).cast("int").alias("grid_column"),
        col.present_flag(F.when(F.col("p_size") > 25, F.col("p_size"))).alias("is_large"),
        col.truncating_int(F.col("p_retailprice").cast("string")).alias("whole_price"),
        col.contains_all("p_name", ["r", "g"]).alias("has_r_and_g"),
        col.hms(F.col("p_size") * 977).alias("duration"))


ORACLES["column_helpers"] = r"""
SELECT p_partkey, regexp_replace(p_brand, '#\d+$', '') AS brand_kind, p_size / 100 AS size_scaled,
  CAST(p_size // 10 AS INTEGER) AS grid_row, CAST(p_size % 10 AS INTEGER) AS grid_column,
  CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS is_large, CAST(trunc(p_retailprice) AS INTEGER) AS whole_price,
  contains(p_name, 'r') AND contains(p_name, 'g') AS has_r_and_g,
  printf('%dh %dm %ds', p_size * 977 // 3600, p_size * 977 % 3600 // 60, p_size * 977 % 60) AS duration
FROM part"""


# A55 — total per distinct id
@query("per_distinct_id", "A55")
def per_distinct_id(spark, sf):
    li = table(spark, sf, "lineitem")
    out = agg.distinct_ratio(li, ["l_returnflag"], F.col("l_quantity").cast(MONEY), "l_orderkey")
    return out.select("l_returnflag", _r(F.col("per_distinct").cast("double")).alias("per_distinct"))


ORACLES["per_distinct_id"] = f"""
SELECT l_returnflag, round(CAST(sum(CAST(l_quantity AS {_M})) AS DOUBLE) / count(DISTINCT l_orderkey), 6)
  AS per_distinct FROM lineitem GROUP BY 1"""


# W22 — place after a total sort
@query("display_rank", "W22")
def display_rank(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return rank.display_rank(c, [F.col("c_acctbal").desc(), F.col("c_custkey")])


ORACLES["display_rank"] = """
SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS display_rank FROM customer"""


# T06 — repeated names get the next free number
@query("number_repeats", "T06")
def number_repeats(spark, sf):
    ev = table(spark, sf, "events")
    taken = ev.filter("value > 49").select(
        F.concat_ws("-", "event_type", (F.col("event_id") % 50 + 1).cast("string")).alias("name")).distinct()
    out = keyed.number_repeats(ev.select("event_id", "event_type", "ts"), taken, "event_type", "name",
                               ["ts", "event_id"], F.to_date("ts"), "given_name")
    return out.select("event_id", "given_name")


ORACLES["number_repeats"] = """
WITH used AS (SELECT DISTINCT event_type AS k, event_id % 50 + 1 AS n FROM events WHERE value > 49),
arr AS (SELECT event_id, event_type AS k,
          row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS j FROM events),
every AS (SELECT k, unnest(range(0, m + 60)) AS n FROM (SELECT k, count(*) AS m FROM arr GROUP BY k)),
free AS (SELECT k, n, row_number() OVER (PARTITION BY k ORDER BY n) - 1 AS j
         FROM every ANTI JOIN used USING (k, n))
SELECT event_id, CASE WHEN n = 0 THEN k ELSE k || '-' || n END AS given_name FROM arr JOIN free USING (k, j)"""
