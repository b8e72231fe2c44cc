"""Query catalog over the shared test tables.

Each entry maps one or more inventory IDs onto the driver tables: users are
players, days are turns, orders are games, event types are categories. Every
query reads whole tables; outputs alias every computed column so that the
DuckDB oracle in :mod:`turnlens.plans.oracles` can be compared column by
column. Doubles are rounded (6 dp, densities 8 dp); money-like sums are
DECIMAL so both engines agree exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from turnlens.functions.columns import bucket_label, bucket_start, day_index, epoch_micros
from turnlens.operators import aggregate as agg
from turnlens.operators import fold, keyed, rank, reshape, share, stats
from turnlens.operators.ordered import (as_of_join, explode_day_interval, global_row_number,
                                        ordered_scan, spine_running_total)
from turnlens.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
IDS: dict[str, str] = {}

# Fixed values of the test domain (pivot lists are passed explicitly).
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
ORDER_STATUSES = ["F", "O", "P"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
EVENT_ORIGIN = "2024-01-01"   # day 0 of the events table

MONEY = "decimal(18,2)"
# Rows of one task where grouping rows of a shuffle by fine keys.
TASK_ROWS = 500_000


def query(name: str, ids: str):
    def deco(fn):
        QUERIES[name] = fn
        IDS[name] = ids
        fn.inventory_ids = ids
        return fn
    return deco


def _r(c, d=6):
    return F.round(c, d)


def domain(df, col, known):
    """Pivot values: the known ones and whatever else the column holds, in
    order. More values than a pivot may have is an error, never a cut."""
    most = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    found = [r[0] for r in df.select(col).filter(F.col(col).isNotNull()).distinct()
             .limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{col} has more than {most} values")
    return sorted({*known, *found})


def last_day(ev):
    """Last day index of the events at hand (the spine's end)."""
    return ev.agg(F.coalesce(F.max("day"), F.lit(0))).first()[0]


def _events(spark, sf):
    return table(spark, sf, "events").withColumn("day", day_index("ts", EVENT_ORIGIN))


_EV_ORDER = ["ts", "event_id"]


def _ev_chunk():
    return F.to_date("ts")


# --------------------------------------------------------------------------
# P04 A02 — one-hot then grouped rates and sums
@query("one_hot_status_summary", "P04 A02")
def one_hot_status_summary(spark, sf):
    o = table(spark, sf, "orders")
    statuses = domain(o, "o_orderstatus", ORDER_STATUSES)
    flags = {f"is_{s}": F.when(F.col("o_orderstatus") == s, 1).otherwise(0) for s in statuses}
    o = o.withColumns(flags)
    return o.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n_orders"),
        *[_r(F.avg(f"is_{s}")).alias(f"rate_{s}") for s in statuses],
        *[F.sum(f"is_{s}").alias(f"n_{s}") for s in statuses],
        _r(F.avg("o_totalprice")).alias("avg_price"),
        F.sum(F.col("o_totalprice").cast(MONEY)).cast(MONEY).alias("sum_price"))


# A01 A36 — count / mean / stddev / median per category
@query("category_stats", "A01 A36")
def category_stats(spark, sf):
    return agg.group_stats(table(spark, sf, "events"), ["event_type"], "value", 6, "value_")


# P05 A03 — share over event rows only (null elsewhere, avg skips nulls)
@query("null_aware_share", "P05 A03")
def null_aware_share(spark, sf):
    li = table(spark, sf, "lineitem")
    returned = F.col("l_returnflag") != "N"
    return li.groupBy("l_linestatus").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(returned).alias("n_returned"),
        _r(F.avg(F.when(returned, (F.col("l_returnflag") == "R").cast("double")))).alias("share_R"),
        _r(F.avg(F.when(returned, (F.col("l_returnflag") == "A").cast("double")))).alias("share_A"))


# J01 A17 A40 — winner join, win rate, baseline
@query("winner_join_rate", "J01 A17 A40 J24")
def winner_join_rate(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice",
                                           "o_orderpriority")
    # winner = highest price, smallest key on ties; one partial aggregate
    winners = o.groupBy("o_custkey").agg(
        F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("w_orderkey"))
    j = keyed.winner_join(o, winners, ["o_custkey"], "o_orderkey", "w_orderkey", "is_win")
    baseline = (o.select(F.countDistinct("o_custkey")).scalar()
                / o.select(F.count(F.lit(1))).scalar())
    g = j.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("n_orders"),
        F.count_if("is_win").alias("n_wins"),
        _r(F.avg(F.col("is_win").cast("double"))).alias("win_rate"))
    return g.withColumn("baseline_rate", _r(baseline))


# W05 J07 P08 — dense spine + running total
@query("spine_running_total", "W05 J07 P08 W19")
def spine_running_total_q(spark, sf):
    ev = _events(spark, sf).filter(F.col("event_type") == "purchase")
    facts = ev.select("user_id", "day", F.col("value").cast(MONEY).alias("v"))
    out = spine_running_total(facts, ["user_id"], "day", "v", 0, last_day(ev),
                              "day_value", "running_value")
    return out.select("user_id", "day", F.col("day_value").cast(MONEY).alias("day_value"),
                      F.col("running_value").cast(MONEY).alias("running_value"))


# W19 W24 — interval explode, one row per (key, day) with max
@query("interval_explode", "W19 W24")
def interval_explode(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    o = o.withColumn("end", F.date_add(F.to_date("o_orderdate"), 5))
    x = explode_day_interval(o, "o_orderdate", "end", "day")
    return x.groupBy("o_custkey", "day").agg(F.max("o_totalprice").alias("max_price"),
                                             F.count(F.lit(1)).alias("n_active"))


# W07 — last observation carried forward
@query("locf_state", "W07")
def locf_state(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    s = ordered_scan(ev, ["user_id"], _EV_ORDER, _ev_chunk(),
                     lasts={"last_purchase_id": F.when(F.col("event_type") == "purchase",
                                                       F.col("event_id"))})
    return s.select("event_id", "user_id", "last_purchase_id")


# W16 S14 — CHOSEN sets start, COMPLETED emits an interval
@query("chosen_completed_intervals", "W16")
def chosen_completed_intervals(spark, sf):
    ev = _events(spark, sf)
    out = fold.chosen_completed_intervals(
        ev, ["user_id"], _EV_ORDER, _ev_chunk(),
        is_chosen=F.col("event_type").isin("signup", "click"),
        is_completed=F.col("event_type") == "purchase",
        turn="day", grid=F.floor("value").cast("int"))
    return out.select("user_id", "event_id", "start_turn", "end_turn", "duration",
                      "grid_at_start")


# W17 S17 — buffered rows consumed by the next event row
@query("buffered_event_groups", "W17")
def buffered_event_groups(spark, sf):
    ev = table(spark, sf, "events")
    out = fold.buffered_event_groups(
        ev, ["user_id"], _EV_ORDER, _ev_chunk(),
        is_event=F.col("event_type") == "purchase",
        is_buffered=F.col("event_type") == "view",
        take=F.when(F.col("value") >= 25, 2).otherwise(1),
        event_cols=["event_id"], item_cols=["event_id"])
    return out.select("user_id", "event_no", F.col("event_event_id").alias("purchase_id"),
                      F.col("item_event_id").alias("view_id"), F.col("slot").cast("bigint"))


# W18 — non-associative level state machine
@query("state_machine_levels", "W18")
def state_machine_levels(spark, sf):
    ev = table(spark, sf, "events").withColumn("tier", (F.floor(F.col("value") / 10) + 1).cast("int"))
    ev = ev.withColumn("is_step", F.col("event_type") == "purchase")
    return fold.level_state_machine(ev, "user_id", _EV_ORDER, "tier", "is_step", "event_id",
                                    steps_per_level=3, max_level=10, chunk=_ev_chunk())


# W01 — pick order
@query("pick_order", "W01 O02")
def pick_order(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", "ts")
    s = ordered_scan(ev, ["user_id"], _EV_ORDER, _ev_chunk(), row_number="pick_order")
    return s.select("event_id", "user_id", F.col("pick_order").cast("bigint"))


# W14 — waiting time since the previous row
@query("waiting_time", "W14")
def waiting_time(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", "ts")
    s = ordered_scan(ev, ["user_id"], _EV_ORDER, _ev_chunk(),
                     lags={"prev_us": epoch_micros("ts")})
    return s.select("event_id", "user_id",
                    _r((epoch_micros("ts") - F.col("prev_us")) / 1e6).alias("wait_sec"))


# W09 — next state
@query("next_state", "W09")
def next_state(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    s = ordered_scan(ev, ["user_id"], _EV_ORDER, _ev_chunk(),
                     leads={"next_type": F.col("event_type")})
    return s.select("event_id", "user_id", "event_type", "next_type")


# W04 W08 W12 — first row per group
@query("first_per_group", "W04 W08 W12 J10")
def first_per_group(spark, sf):
    o = table(spark, sf, "orders")
    return rank.first_per_group(o, ["o_custkey"], ["o_orderdate", "o_orderkey"],
                                ["o_orderkey", "o_orderdate", "o_totalprice"], "first_")


# J09 — join to own aggregate (latest date), ties kept
@query("last_per_group", "J09")
def last_per_group(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return rank.rows_at_group_extreme(o, ["o_custkey"], "o_orderdate", "max")


# W13 — top k per group
@query("top_k_per_group", "W13 O04")
def top_k_per_group(spark, sf):
    li = table(spark, sf, "lineitem")
    rev = (F.col("l_extendedprice").cast(MONEY) * (F.lit(1) - F.col("l_discount").cast(MONEY)))
    g = li.groupBy("l_suppkey", "l_partkey").agg(F.sum(rev).cast("decimal(18,4)").alias("revenue"))
    t = rank.top_k_per_group(g, ["l_suppkey"], [F.col("revenue").desc(), F.col("l_partkey")], 3)
    return t.select("l_suppkey", F.col("rank").cast("bigint"), "l_partkey", "revenue")


# W03 — tie-averaged finishing places, dead fill the bottom
@query("tie_averaged_rank", "W03")
def tie_averaged_rank(spark, sf):
    n = table(spark, sf, "nation")
    s = table(spark, sf, "supplier")
    per = s.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n_suppliers"),
                                       F.sum(F.col("s_acctbal").cast(MONEY)).alias("acct"))
    j = n.join(per, n.n_nationkey == per.s_nationkey, "left").select(
        "n_regionkey", "n_nationkey",
        F.coalesce("n_suppliers", F.lit(0)).alias("n_suppliers"),
        F.coalesce("acct", F.lit(0).cast(MONEY)).alias("acct"))
    j = j.withColumn("is_dead", (F.col("n_suppliers") == 0) | (F.col("acct") < 0))
    out = rank.finishing_place(j, "n_regionkey", "n_nationkey", "n_suppliers", "is_dead",
                               "acct", "place")
    return out.select("n_regionkey", "n_nationkey", "n_suppliers", "is_dead",
                      _r(F.col("place")).alias("place"))


# W15 J17 — rank of two versions, full outer, delta
@query("rank_delta", "W15 J17 W22")
def rank_delta(spark, sf):
    ev = table(spark, sf, "events")
    half = F.dayofmonth("ts") <= 15
    v = F.col("value").cast(MONEY)
    a = ev.filter(half).groupBy("user_id").agg(F.sum(v).alias("v"))
    b = ev.filter(~half).groupBy("user_id").agg(F.sum(v).alias("v"))
    out = rank.rank_two_versions(a, b, "user_id", "v", ("rank_first", "rank_second"))
    return out.select("user_id", F.col("rank_first").cast("bigint"),
                      F.col("rank_second").cast("bigint"), F.col("rank_delta").cast("bigint"))


# W20 — flag the argmax row per group
@query("group_argmax_flag", "W20")
def group_argmax_flag(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", "value")
    out = rank.flag_group_argmax(ev, ["user_id"], "value", "event_id", "is_top")
    return out.select("event_id", "user_id", "is_top")


# W11 J11 — share within group
@query("share_within_group", "W11 J11 P32")
def share_within_group(spark, sf):
    o = table(spark, sf, "orders")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    g = (o.join(c, o.o_custkey == c.c_custkey)
         .groupBy("c_nationkey", "c_mktsegment")
         .agg(F.sum(F.col("o_totalprice").cast(MONEY)).alias("revenue"))
         .withColumn("rev_d", F.col("revenue").cast("double")))
    s = share.share_within(g, ["c_nationkey"], "rev_d", "share")
    return s.select("c_nationkey", "c_mktsegment", F.col("revenue").cast(MONEY),
                    _r(F.col("share").cast("double")).alias("share"))


# W06 A41 — category share, cumulative share and lagged start
@query("cumulative_share", "W06 A41")
def cumulative_share(spark, sf):
    o = table(spark, sf, "orders")
    g = o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    g = share.category_share(g, "n", "share")
    out = share.cumulative_share(g, ["o_orderpriority"], "share", "cum_share", "start")
    return out.select("o_orderpriority", "n", _r(F.col("share")).alias("share"),
                      _r(F.col("cum_share")).alias("cum_share"), _r(F.col("start")).alias("start"))


# W21 — IQR outliers and nearest-to-median ranks
@query("iqr_outliers_topn", "W21")
def iqr_outliers_topn(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "event_type", "value")
    out = stats.iqr_outliers(ev, "event_type", "value", "event_id", 8)
    return out.select("event_id", "event_type", "value", "is_outlier",
                      F.col("near_rank").cast("bigint"), "show")


# A04 — pivot count
@query("pivot_count", "A04 P06")
def pivot_count(spark, sf):
    ev = table(spark, sf, "events")
    return reshape.pivot_count(ev, ["user_id"], "event_type",
                               domain(ev, "event_type", EVENT_TYPES), "n_")


# A10 — pivot sum with fill
@query("pivot_sum_fill", "A10 A08 A26 P08")
def pivot_sum_fill(spark, sf):
    ev = table(spark, sf, "events")
    types = domain(ev, "event_type", EVENT_TYPES)
    return reshape.pivot_agg(ev, ["user_id"], "event_type", types,
                             F.sum(F.col("value").cast(MONEY)), "v_",
                             fill=0).select("user_id", *[F.col(f"v_{t}").cast(MONEY) for t in types])


# A42 — unpivot back to long
@query("unpivot_long", "A42")
def unpivot_long(spark, sf):
    wide = pivot_sum_fill(spark, sf)
    return reshape.unpivot(wide, ["user_id"], {c: c.removeprefix("v_") for c in wide.columns[1:]},
                           "event_type", "total")


# J18 J19 A47 — completed grid with zeros and marginals
@query("complete_grid", "J18 J19 A47 J22")
def complete_grid(spark, sf):
    c = table(spark, sf, "customer")
    n = table(spark, sf, "nation")
    r = table(spark, sf, "region")
    cr = (c.join(keyed.broadcast_if_small(n), c.c_nationkey == n.n_nationkey)
          .join(keyed.broadcast_if_small(r), F.col("n_regionkey") == r.r_regionkey))
    grid = reshape.complete_grid(cr, "r_name", "c_mktsegment",
                                 domain(c, "c_mktsegment", SEGMENTS),
                                 F.count(F.lit(1)), "n_customers", 0)
    row_tot = cr.groupBy("r_name").agg(F.count(F.lit(1)).alias("region_total"))
    col_tot = cr.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("segment_total"))
    out = grid.join(row_tot, "r_name", "left").join(col_tot, "c_mktsegment", "left")
    return out.select("r_name", "c_mktsegment", F.col("n_customers").cast("bigint"),
                      "region_total", F.coalesce("segment_total", F.lit(0)).cast("bigint")
                      .alias("segment_total"),
                      _r(F.col("n_customers") / F.col("region_total")).alias("share_of_region"))


# J06 P31 A20 — as-of join: latest earlier purchase per view
@query("range_join_effective_owner", "J06 P31 A20")
def range_join_effective_owner(spark, sf):
    ev = table(spark, sf, "events")
    views = ev.filter(F.col("event_type") == "view").select("event_id", "user_id", "ts")
    buys = ev.filter(F.col("event_type") == "purchase").select(
        "user_id", "ts", F.col("event_id").alias("purchase_id"),
        F.col("value").alias("purchase_value"))
    j = as_of_join(views, buys, ["user_id"], "ts", "ts", "event_id", "purchase_id",
                   ["purchase_id", "purchase_value"])
    return j.select("event_id", "user_id", "purchase_id", "purchase_value",
                    F.coalesce("purchase_id", "user_id").alias("effective_owner"))


# A21 — first turn where two cumulative shares pass a threshold
@query("threshold_first_crossing", "A21 J10")
def threshold_first_crossing(spark, sf):
    ev = _events(spark, sf)
    daily = ev.groupBy("user_id", "day").agg(F.sum(F.col("value").cast(MONEY)).alias("v"),
                                             F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("user_id").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    tot = daily.groupBy("user_id").agg(F.sum("v").alias("tv"), F.sum("n").alias("tn"))
    d = (daily.join(tot, "user_id")
         .withColumn("cum_value_share", F.sum("v").over(w).cast("double") / F.col("tv").cast("double"))
         .withColumn("cum_count_share", F.sum("n").over(w).cast("double") / F.col("tn").cast("double")))
    hit = d.filter((F.col("cum_value_share") > 0.66666) & (F.col("cum_count_share") > 0.66666))
    first = rank.first_per_group(hit, ["user_id"], ["day"],
                                 ["day", "cum_value_share", "cum_count_share"], "")
    return first.select("user_id", "day", _r(F.col("cum_value_share")).alias("cum_value_share"),
                        _r(F.col("cum_count_share")).alias("cum_count_share"))


# A23 A30 J13 — true-denominator means
@query("true_denominator_mean", "A23 A30 J13 A32")
def true_denominator_mean(spark, sf):
    ev = _events(spark, sf)
    per = ev.groupBy("user_id", "event_type").agg(F.sum(F.col("value").cast(MONEY)).alias("total"))
    active = ev.groupBy("user_id").agg(F.countDistinct("day").alias("active_days"))
    j = per.join(active, "user_id")
    j = j.withColumn("per_active_day", F.col("total").cast("double") / F.col("active_days"))
    j = j.withColumn("per_spine_day", F.col("total").cast("double") / F.lit(last_day(ev) + 1))
    return j.groupBy("event_type").agg(
        _r(F.avg("per_active_day")).alias("mean_per_active_day"),
        _r(F.avg("per_spine_day")).alias("mean_per_spine_day"),
        F.count(F.lit(1)).alias("n_users"))


# A29 J12 — copy-normalised rates + full outer of two fact sums
@query("copy_normalised_rate", "A29 J12")
def copy_normalised_rate(spark, sf):
    li = table(spark, sf, "lineitem")
    o = table(spark, sf, "orders")
    # distinct orders and order-days by counting rows of nested groups: one
    # shuffle of the lines, on the outer group's key, serves both levels; its
    # tasks are counted by rows, as each holds the groups of its rows
    per_day = li.select(F.year("l_shipdate").alias("yr"), "l_orderkey", F.to_date("l_shipdate").alias("day"),
                        "l_quantity", "l_extendedprice").repartition(-(-li.count() // TASK_ROWS) or 1, "yr", "l_orderkey") \
        .groupBy("yr", "l_orderkey", "day").agg(F.sum(F.col("l_quantity").cast(MONEY)).alias("qty"),
                                                F.sum(F.col("l_extendedprice").cast(MONEY)).alias("yield_sum"))
    per_order = per_day.groupBy("yr", "l_orderkey").agg(
        F.sum("qty").alias("qty"), F.sum("yield_sum").alias("yield_sum"),
        F.count("day").alias("days"))
    a = per_order.groupBy("yr").agg(F.sum("qty").alias("qty"), F.sum("yield_sum").alias("yield_sum"),
                                    F.count("l_orderkey").alias("n_orders"), F.sum("days").alias("n_order_days"))
    b = o.groupBy(F.year("o_orderdate").alias("yr")).agg(
        F.sum(F.col("o_totalprice").cast(MONEY)).alias("order_total"),
        F.count(F.lit(1)).alias("n_placed"))
    j = a.join(b, "yr", "full")
    per_copy = F.when(F.col("qty") > 0, F.col("yield_sum").cast("double") / F.col("qty").cast("double"))
    j = j.withColumn("per_copy", F.coalesce(per_copy, F.lit(0.0)))
    era_total = F.when(F.col("n_orders") > 0,
                       F.col("per_copy") * F.col("n_order_days") / F.col("n_orders"))
    return j.select("yr", F.coalesce("qty", F.lit(0).cast(MONEY)).cast(MONEY).alias("qty"),
                    _r(F.col("per_copy")).alias("per_copy"),
                    _r(F.coalesce(era_total, F.lit(0.0))).alias("era_total"),
                    F.coalesce("n_orders", F.lit(0)).cast("bigint").alias("n_orders"),
                    F.coalesce("order_total", F.lit(0).cast(MONEY)).cast(MONEY).alias("order_total"),
                    F.coalesce("n_placed", F.lit(0)).cast("bigint").alias("n_placed"))


# A11 A33 J24 — two-level trigger stats, amortised by all players
@query("trigger_two_level_stats", "A11 A33 A52 J24 A28")
def trigger_two_level_stats(spark, sf):
    ev = table(spark, sf, "events")
    n_users = ev.select(F.countDistinct("user_id")).scalar()
    fired = ev.filter(F.col("value") > 10)
    lvl1 = fired.groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("cnt"),
                                                      F.avg("value").alias("mean_v"))
    lvl2 = lvl1.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n_players"),
        _r(F.avg("cnt")).alias("mean_count"),
        _r(F.stddev_samp("cnt")).alias("sd_count"),
        _r(F.avg("mean_v")).alias("mean_of_means"))
    tot = fired.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_rows"),
                                          F.sum(F.col("value").cast(MONEY)).alias("vsum"))
    j = lvl2.join(tot, "event_type")
    return j.select("event_type", "n_players", "mean_count", "sd_count", "mean_of_means",
                    "n_rows",
                    _r(F.col("vsum").cast("double") / n_users).alias("avg_yield"),
                    _r(F.col("vsum").cast("double") / F.col("n_rows")).alias("avg_trigger"),
                    _r(F.col("n_rows") / n_users).alias("avg_times"),
                    # Mean amount per firing × mean firings = mean amount
                    _r((F.col("vsum").cast("double") / F.col("n_rows"))
                       * (F.col("n_rows") / n_users)).alias("amount_x_times"))


# P13 P14 A31 — buckets, labels, flag pivot with defaults
@query("bucketed_totals", "P13 P14 A31")
def bucketed_totals(spark, sf):
    ev = _events(spark, sf)
    ev = ev.withColumn("bucket_start", bucket_start("day", 10)).withColumn(
        "flag", (F.col("event_type") == "purchase").cast("int"))
    g = ev.groupBy("bucket_start", "flag").agg(F.sum(F.col("value").cast(MONEY)).alias("v"),
                                               F.count(F.lit(1)).alias("n"))
    p = reshape.owner_flag_pivot(g, ["bucket_start"], "flag", "v", "n",
                                 value_default=0, count_default=0)
    return p.select("bucket_start", bucket_label("bucket_start", 10).alias("bucket_label"),
                    F.col("v_0").cast(MONEY), F.col("v_1").cast(MONEY),
                    F.col("n_0").cast("bigint"), F.col("n_1").cast("bigint"))


# A25 — group + having
@query("having_positive", "A25")
def having_positive(spark, sf):
    ev = table(spark, sf, "events")
    g = ev.groupBy("user_id", "event_type").agg(
        F.sum(F.col("value").cast(MONEY) - F.lit(25)).cast(MONEY).alias("net"))
    return g.filter(F.col("net") > 0)


# J12 O06 — full outer of two fact sums on a key
@query("full_outer_two_facts", "J12 O06")
def full_outer_two_facts(spark, sf):
    li = table(spark, sf, "lineitem")
    o = table(spark, sf, "orders")
    a = li.groupBy(F.col("l_orderkey").alias("k")).agg(
        F.sum(F.col("l_extendedprice").cast(MONEY)).alias("line_total"))
    b = o.groupBy(F.col("o_orderkey").alias("k")).agg(
        F.sum(F.col("o_totalprice").cast(MONEY)).alias("order_total"))
    j = a.join(b, "k", "full")
    return j.select(F.col("k").alias("orderkey"), F.col("line_total").cast(MONEY),
                    F.col("order_total").cast(MONEY),
                    (F.coalesce("order_total", F.lit(0)) - F.coalesce("line_total", F.lit(0)))
                    .cast(MONEY).alias("diff"))


# J15 J16 P11 Q05 — semi / anti filters
@query("semi_anti_filters", "J15 J16 P11 Q05 Q03")
def semi_anti_filters(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey")
    o = table(spark, sf, "orders")
    per = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max("o_orderdate").alias("last_date"),
        F.countDistinct("o_orderstatus").alias("n_status"))
    valid = per.filter(F.col("last_date") >= F.lit("1998-01-01").cast("timestamp"))
    degenerate = per.filter(F.col("n_status") == 1)
    no_orders = keyed.anti(c, per, ["c_custkey"]).withColumn("category", F.lit("no_orders"))
    kept = keyed.anti(keyed.semi(c, valid, ["c_custkey"]), degenerate, ["c_custkey"])
    stale = keyed.anti(keyed.semi(c, per, ["c_custkey"]), valid, ["c_custkey"])
    return (no_orders.unionByName(kept.withColumn("category", F.lit("valid")))
            .unionByName(stale.withColumn("category", F.lit("stale")))
            .unionByName(keyed.semi(keyed.semi(c, valid, ["c_custkey"]), degenerate, ["c_custkey"])
                         .withColumn("category", F.lit("degenerate"))))


# O06–O09 — union / intersect / except of key sets
@query("set_ops", "O06 O07 O08 O09")
def set_ops(spark, sf):
    o = table(spark, sf, "orders")
    a = o.filter(F.year("o_orderdate") == 1996).select("o_custkey")
    b = o.filter(F.year("o_orderdate") == 1997).select("o_custkey")
    return keyed.key_set_ops(a, b, "op")


# J22 J23 — snowflake dims and equi + inequality self join
@query("snowflake_dims", "J22 J23")
def snowflake_dims(spark, sf):
    c = table(spark, sf, "customer")
    s = table(spark, sf, "supplier")
    n = keyed.broadcast_if_small(table(spark, sf, "nation"))
    r = keyed.broadcast_if_small(table(spark, sf, "region"))
    nr = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")
    per_nation = c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n_customers"))
    default = s.groupBy(F.col("s_nationkey").alias("d_nationkey")).agg(
        F.min("s_suppkey").alias("default_suppkey"))
    variants = keyed.equi_with_residual(
        s, default, [], (s.s_nationkey == default.d_nationkey)
        & (s.s_suppkey != default.default_suppkey))
    nv = variants.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n_variants"))
    out = (nr.join(per_nation, nr.n_nationkey == per_nation.c_nationkey, "left")
           .join(nv, nr.n_nationkey == nv.s_nationkey, "left"))
    return out.select("r_name", "n_name",
                      F.coalesce("n_customers", F.lit(0)).cast("bigint").alias("n_customers"),
                      F.coalesce("n_variants", F.lit(0)).cast("bigint").alias("n_variants"))


# J21 K09 — mint ids for unseen keys, rewrite facts
@query("id_translation", "J21 K09 J25")
def id_translation(spark, sf):
    o = table(spark, sf, "orders")
    cutoff = F.lit("1998-01-01").cast("timestamp")
    seen = o.filter(F.col("o_orderdate") < cutoff).select(F.col("o_custkey").alias("key")).distinct()
    dictionary = global_row_number(seen, [F.col("key")], "id")
    new_facts = o.filter(F.col("o_orderdate") >= cutoff)
    full = keyed.mint_ids(dictionary, new_facts.select(F.col("o_custkey").alias("key")), "key", "id")
    out = keyed.translate_ids(new_facts.withColumnRenamed("o_custkey", "key"), full, "key", "id",
                              "global_id")
    return out.select("o_orderkey", F.col("key").alias("o_custkey"), "global_id")


# A39 — ordered string aggregation
@query("ordered_string_agg", "A39")
def ordered_string_agg(spark, sf):
    ev = table(spark, sf, "events")
    return agg.ordered_string_agg(ev, ["user_id"], "event_type", _EV_ORDER, "|", "type_path")


# A43 — set signature → category
@query("set_signature", "A43")
def set_signature(spark, sf):
    ev = _events(spark, sf)
    s = agg.set_signature(ev, ["user_id", "day"], "event_type", "|", "signature")
    cat = (F.when(~F.col("signature").contains("|"), F.concat(F.lit("single:"), F.col("signature")))
           .when(F.col("signature").contains("purchase"), F.lit("buyer"))
           .otherwise(F.lit("browser")))
    return s.withColumn("category", cat)


# A27 — stripes map exported as JSON
@query("stripes_map", "A27 K10 F05 F06")
def stripes_map(spark, sf):
    c = table(spark, sf, "customer")
    n = table(spark, sf, "nation")
    r = table(spark, sf, "region")
    j = (c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey))
    per = j.groupBy("r_name", "n_name").agg(F.sort_array(F.collect_set("c_mktsegment")).alias("segs"))
    m = per.groupBy("r_name").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("n_name", "segs")))).alias("m"))
    return m.select("r_name", F.to_json("m").alias("stripes_json"))


# A44 A56 — count_if crosstab + remainder
@query("crosstab_residual", "A44 A56")
def crosstab_residual(spark, sf):
    o = table(spark, sf, "orders")
    return agg.count_if_crosstab(o, ["o_orderpriority"], "o_orderstatus", ["F", "O"], "n_", "n_rest")


# A48 W10 — flow links between the first three steps, with wins and losses
@query("flow_links", "A48 W10 W08")
def flow_links(spark, sf):
    ev = table(spark, sf, "events")
    t = rank.top_k_per_group(ev, ["user_id"], [F.col("ts"), F.col("event_id")], 3, "pos")
    wide = t.groupBy("user_id").agg(*[F.max(F.when(F.col("pos") == i, F.col("event_type")))
                                      .alias(f"s{i}") for i in (1, 2, 3)])
    v = F.col("value").cast(MONEY)
    won = ev.groupBy("user_id").agg(
        (F.sum(F.when(F.col("event_type") == "purchase", v).otherwise(0))
         > F.sum(F.when(F.col("event_type") == "error", v).otherwise(0))).cast("int").alias("won"))
    wide = wide.join(won, "user_id")
    links = (wide.select(F.lit(1).alias("stage"), F.col("s1").alias("source"),
                         F.col("s2").alias("target"), "won")
             .unionByName(wide.select(F.lit(2).alias("stage"), F.col("s2").alias("source"),
                                      F.col("s3").alias("target"), "won"))
             .filter(F.col("target").isNotNull()))
    return links.groupBy("stage", "source", "target").agg(
        F.count(F.lit(1)).alias("n"), F.sum("won").cast("bigint").alias("wins"),
        (F.count(F.lit(1)) - F.sum("won")).cast("bigint").alias("losses"))


# A49 A66 — reclassify wins by a crossing rule
@query("reclassify_delta", "A49 A66")
def reclassify_delta(spark, sf):
    o = table(spark, sf, "orders")
    last = rank.last_per_group(o, ["o_custkey"], ["o_orderdate", "o_orderkey"],
                               ["o_orderstatus", "o_orderdate"], "end_")
    cross = rank.first_per_group(o.filter(F.col("o_totalprice") > 400000), ["o_custkey"],
                                 ["o_orderdate", "o_orderkey"], ["o_orderdate"], "cross_")
    j = last.join(cross, "o_custkey", "left")
    moved = F.col("cross_o_orderdate").isNotNull() & (F.col("cross_o_orderdate") <= F.col("end_o_orderdate"))
    base = j.select(F.col("end_o_orderstatus").alias("category"), F.lit(1).alias("d"))
    minus = j.filter(moved).select(F.col("end_o_orderstatus").alias("category"), F.lit(-1).alias("d"))
    plus = j.filter(moved).select(F.lit("AUTHORITY").alias("category"), F.lit(1).alias("d"))
    u = base.unionByName(minus).unionByName(plus)
    g = u.groupBy("category").agg(F.sum("d").alias("net"))
    return g.select("category", F.greatest(F.col("net"), F.lit(0)).cast("bigint").alias("wins"))


# A46 — p99 clip (exact quantile by distributed sort)
@query("quantile_clip", "A46")
def quantile_clip(spark, sf):
    li = table(spark, sf, "lineitem")
    p99 = agg.exact_quantile(li, "l_extendedprice", 0.99).scalar()
    li = li.withColumns({"__clipped": F.least(F.col("l_extendedprice"), p99),
                         "__over": F.col("l_extendedprice") > p99})
    g = li.groupBy("l_returnflag").agg(
        _r(F.sum("__clipped"), 2).alias("sum_clipped"),
        F.count_if("__over").alias("n_clipped"))
    return g.withColumn("p99", _r(p99))


# A62 — histogram
@query("histogram_bins", "A62")
def histogram_bins(spark, sf):
    ev = table(spark, sf, "events")
    return agg.histogram(ev, "event_type", "value", 30)


# A51 A65 — row-normalised pivot, columns ordered by total
@query("normalised_pivot_ordered", "A51 A65")
def normalised_pivot_ordered(spark, sf):
    ev = _events(spark, sf).withColumn("week", F.floor(F.col("day") / 7).cast("int"))
    v = F.col("value").cast(MONEY)
    g = ev.groupBy("week", "event_type").agg(F.sum(v).cast("double").alias("v"))
    s = share.share_within(g, ["week"], "v", "share")
    totals = ev.groupBy("event_type").agg(F.sum(v).alias("tv"))
    order = global_row_number(totals, [F.col("tv").desc(), F.col("event_type")], "col_order")
    out = s.join(order.select("event_type", "col_order"), "event_type")
    return out.select("week", "event_type", _r(F.col("share").cast("double")).alias("share"),
                      F.col("col_order").cast("bigint"))


# F06 A58 S28 — JSON fields rolled up
@query("json_props_rollup", "F06 A58 F04")
def json_props_rollup(spark, sf):
    ev = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    g = ev.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(k).alias("sum_k"),
        F.count_if(k > 50).alias("n_k_gt_50"),
        F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    return g.select("event_type", "n", "sum_k", "n_k_gt_50",
                    F.date_format("t0", "yyyy-MM-dd HH:mm:ss").alias("first_ts"),
                    F.date_format("t1", "yyyy-MM-dd HH:mm:ss").alias("last_ts"),
                    _r((epoch_micros("t1") - epoch_micros("t0")) / 1e6).alias("span_sec"))


# A58 W10 — conversation roll-up
@query("conversation_rollup", "A58")
def conversation_rollup(spark, sf):
    cv = table(spark, sf, "conversations")
    return cv.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.count_if(F.col("role") == "user").alias("n_user"),
        F.count_if(F.col("role") == "assistant").alias("n_assistant"),
        F.sum(F.length("text")).cast("bigint").alias("total_chars"),
        F.min_by("role", "turn").alias("first_role"),
        F.max_by("role", "turn").alias("last_role"))


# A60 O10 — exact content dedup
@query("exact_content_dedup", "A60 O10")
def exact_content_dedup(spark, sf):
    d = table(spark, sf, "documents")
    return keyed.exact_content_dedup(d, "text", "doc_id", "content_hash")


# P01–P03 Q01 — regex fields from raw pages
@query("html_link_or_title_parse", "P01 P02 P03 Q01 F01")
def html_link_or_title_parse(spark, sf):
    p = table(spark, sf, "pages")
    title = F.regexp_extract("html", r"<title>(.*?)</title>", 1)
    return p.select(
        "page_id",
        F.regexp_extract("url", r"^https?://([^/:?#]+)", 1).alias("host"),
        F.regexp_extract("html", r'<html lang="([A-Za-z-]+)"', 1).alias("lang"),
        title.alias("title"),
        F.regexp_count("html", F.lit(r"<a\s")).cast("bigint").alias("n_links"),
        (title != "").alias("is_ok"))


# P29 A54 — cohort by any-of set, rate over the cohort roster
@query("cohort_filter_rates", "P29 A54 A55")
def cohort_filter_rates(spark, sf):
    o = table(spark, sf, "orders")
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    st = o.groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("sts"))
    cohort = st.filter(F.arrays_overlap("sts", F.array(F.lit("P")))).select(
        F.col("o_custkey").alias("c_custkey"))
    roster = c.join(cohort, "c_custkey", "left_semi")
    n_roster = roster.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n_cohort"))
    facts = (o.join(roster, o.o_custkey == roster.c_custkey)
             .groupBy("c_mktsegment", F.year("o_orderdate").alias("yr"))
             .agg(F.count(F.lit(1)).alias("n_orders")))
    j = facts.join(n_roster, "c_mktsegment")
    return j.select("c_mktsegment", "yr", "n_orders", "n_cohort",
                    _r(F.col("n_orders") / F.col("n_cohort")).alias("rate"))


# M01 M02 — Gaussian KDE on a shared grid
@query("gaussian_kde_grid", "M01 M02")
def gaussian_kde_grid(spark, sf):
    ev = table(spark, sf, "events")
    return stats.kde_grid(ev, "event_type", "value", n_grid=300, lo=0.0)


# M03 — density support window
@query("kde_support_window", "M03 M04")
def kde_support_window(spark, sf):
    return stats.kde_support_window(gaussian_kde_grid(spark, sf), "event_type")


# A67 — play-count-weighted totals
@query("weighted_totals", "A67")
def weighted_totals(spark, sf):
    o = table(spark, sf, "orders")
    plays = o.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("plays"))
    mean_plays = plays.select(F.avg("plays")).scalar()
    wins = (o.filter(F.col("o_orderstatus") == "F")
            .groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("wins")))
    j = wins.join(plays, "o_custkey")
    return j.groupBy("o_orderpriority").agg(
        _r(F.sum(F.col("plays") / mean_plays * F.col("wins"))).alias("weighted_wins"))


# A68 — milestone impact
@query("milestone_impact", "A68 A50 P30")
def milestone_impact(spark, sf):
    ev = _events(spark, sf)
    first = ev.groupBy("user_id", "event_type").agg(F.min("day").alias("first_day"))
    v = F.col("value").cast(MONEY)
    win = ev.groupBy("user_id").agg(
        (F.sum(F.when(F.col("event_type") == "purchase", v).otherwise(0))
         > F.sum(F.when(F.col("event_type") == "error", v).otherwise(0))).cast("int").alias("win"))
    j = first.join(win, "user_id")
    g = j.groupBy("event_type").agg(_r(F.avg("win")).alias("win_rate"),
                                    F.count(F.lit(1)).alias("n_users"))
    med = agg.grouped_exact_quantiles(j, ["event_type"], "first_day", [0.5], "m")
    return g.join(med, "event_type").select(
        "event_type", _r(F.col("m_0")).alias("median_first_day"), "win_rate", "n_users")


# A69 — five-number summary
@query("five_number_summary", "A69 A45")
def five_number_summary(spark, sf):
    return agg.five_number(table(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice")


# A70 — row percentages of a crosstab
@query("row_percentages", "A70")
def row_percentages(spark, sf):
    o = table(spark, sf, "orders")
    statuses = domain(o, "o_orderstatus", ORDER_STATUSES)
    ct = agg.count_if_crosstab(o, ["o_orderpriority"], "o_orderstatus", statuses)
    return ct.select("o_orderpriority", "n",
                     *[_r(F.col(f"n_{s}") * 100.0 / F.col("n")).alias(f"pct_{s}")
                       for s in statuses])


# M13 — correlations
@query("correlation_columns", "M13")
def correlation_columns(spark, sf):
    li = table(spark, sf, "lineitem")
    return stats.correlations(li, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], 6)


# M14 — composite score
@query("composite_score", "M14")
def composite_score(spark, sf):
    p = table(spark, sf, "part")
    s = stats.composite_score(p, "p_partkey", {"p_retailprice": 0.6, "p_size": 0.4})
    return s.select("p_partkey", _r(F.col("score")).alias("score"))


# M12 — bootstrap CI of win share per group (rows-only check)
@query("bootstrap_ci", "M12")
def bootstrap_ci(spark, sf):
    o = table(spark, sf, "orders").withColumn("is_f", F.col("o_orderstatus") == "F")
    return stats.binomial_bootstrap_ci(o, "o_orderpriority", "is_f", 200, 7)


# M05 — Goodman simultaneous intervals
@query("goodman_ci", "M05")
def goodman_ci(spark, sf):
    ev = table(spark, sf, "events")
    counts = ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    g = stats.goodman_intervals(counts, "event_type", "n", 0.05)
    return g.select("event_type", "n", _r(F.col("share")).alias("share"),
                    _r(F.col("ci_lo")).alias("ci_lo"), _r(F.col("ci_hi")).alias("ci_hi"), "star")


# M06 — chi-squared goodness of fit
@query("chisq_gof", "M06")
def chisq_gof(spark, sf):
    ev = table(spark, sf, "events")
    counts = ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    r = stats.chisq_gof_uniform(counts, "n")
    return r.select(_r(F.col("statistic")).alias("statistic"), F.col("dof").cast("bigint"),
                    _r(F.col("p_value")).alias("p_value"))


# M09 — split by group id (rows-only: hash differs across engines)
@query("group_split", "M09")
def group_split(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id")
    from turnlens.operators import ml
    return ml.group_split(ev, "user_id", 75, 42)


# M11 — class-reweighted probabilities, balanced log loss, accuracy
@query("balanced_log_loss", "M11")
def balanced_log_loss(spark, sf):
    from turnlens.operators.ml import class_reweighted_probability
    lab = table(spark, sf, "labels")
    doc = table(spark, sf, "documents").select("doc_id", "n_chars")
    mx = doc.select(F.max("n_chars")).scalar()
    j = lab.join(doc, "doc_id").withColumn("p_raw", F.col("n_chars") / mx)
    j = class_reweighted_probability(j, "p_raw", "p_w")
    p = F.least(F.greatest(F.col("p_w"), F.lit(1e-15)), F.lit(1 - 1e-15))
    j = j.withColumn("p", p).withColumn("y", F.col("quality"))
    g = j.agg(F.count(F.lit(1)).alias("n"),
              F.count_if(F.col("y") == 0).alias("n0"),
              F.count_if(F.col("y") != 0).alias("n1"),
              F.sum(F.when(F.col("y") == 0, F.log(F.lit(1.0) - F.col("p"))).otherwise(0.0)).alias("s0"),
              F.sum(F.when(F.col("y") != 0, F.log(F.col("p"))).otherwise(0.0)).alias("s1"),
              F.avg(((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("double")).alias("acc"))
    w0 = F.col("n") / F.col("n0")
    w1 = F.col("n") / F.col("n1")
    loss = (-w0 / F.col("n0") * F.col("s0") - w1 / F.col("n1") * F.col("s1")) / (w0 + w1)
    return g.select("n", "n0", "n1", _r(loss).alias("log_loss"), _r(F.col("acc")).alias("accuracy"))


# T01 A59 — latest state and previous snapshot per key (batch twin)
@query("latest_state", "T01 A59")
def latest_state(spark, sf):
    ev = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    # the two newest rows of a user leave each task, then meet in one window
    newest = W.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    top = ev.withColumn("__r", F.row_number().over(newest)).filter(F.col("__r") <= 2)
    at = lambda r, c, out: F.max(F.when(F.col("__r") == r, F.col(c))).alias(out)
    return top.groupBy("user_id").agg(
        at(1, "event_id", "latest_event_id"), at(1, "event_type", "latest_event_type"),
        at(2, "event_id", "prev_event_id"), at(2, "event_type", "prev_event_type"))


# T03 A59 — monotone max per (runner, game)
@query("monotone_max", "T03 A59 A57")
def monotone_max(spark, sf):
    ev = _events(spark, sf)
    return ev.groupBy("user_id", "day").agg(
        F.max("value").alias("max_value"),
        F.count(F.lit(1)).alias("n"),
        F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"),
        F.max(F.col("event_type") == "purchase").alias("finished"))


# --------------------------------------------------------------------------
# Data quality (Q01–Q06)

# Q01 — parse audit over every line of every document
@query("parse_audit", "Q01 P02")
def parse_audit(spark, sf):
    from turnlens.operators import quality
    d = table(spark, sf, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return quality.parse_audit(d, ["doc_id"], "line_no", "line", ~F.col("line").rlike(r"\p{L}"))


# Q03 — drop left-censored entities
@query("left_censored_drop", "Q03")
def left_censored_drop(spark, sf):
    from turnlens.operators import quality
    ev = _events(spark, sf)
    kept = quality.drop_left_censored(ev, ["user_id"], "day", 2)
    return kept.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_events"))


# Q04 — roster check: customers whose orders miss some status
@query("roster_check", "Q04")
def roster_check(spark, sf):
    from turnlens.operators import quality
    o = table(spark, sf, "orders")
    statuses = domain(o, "o_orderstatus", ORDER_STATUSES)
    r = quality.roster_check(o, "o_custkey", "o_orderstatus", len(statuses), statuses)
    return r.select("o_custkey", "n_members", F.array_join("members", "|").alias("members"),
                    F.array_join("missing", "|").alias("missing"))


# Q06 — discrepancy between two counts of the same thing
@query("discrepancy_report", "Q06 J17")
def discrepancy_report(spark, sf):
    from turnlens.operators import quality
    o = table(spark, sf, "orders")
    li = table(spark, sf, "lineitem").select("l_orderkey").distinct()
    a = o.groupBy(F.col("o_custkey").alias("custkey")).agg(F.count(F.lit(1)).alias("n_orders"))
    b = (li.join(o.select("o_orderkey", "o_custkey"), li.l_orderkey == o.o_orderkey)
         .groupBy(F.col("o_custkey").alias("custkey")).agg(F.count(F.lit(1)).alias("n_with_lines")))
    return quality.discrepancy_report(a, b, ["custkey"], "n_orders", "n_with_lines")
