"""More catalog entries: roll-ups, routing, predicates, joins and reshapes
(registered into :data:`turnlens.plans.catalog.QUERIES`)."""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import functions as F

from turnlens.functions.columns import (bitmask_of, bit_is_set, decision_class, first_non_empty,
                                        hash_number, recode, rename)
from turnlens.operators import keyed, rank, reshape
from turnlens.operators.keyed import eligible
from turnlens.operators.ordered import ordered_scan
from turnlens.plans.catalog import (EVENT_TYPES, MONEY, ORDER_STATUSES, SEGMENTS, _events, _r, domain,
                                    last_day, query)
from turnlens.plans.oracles import ORACLES
from turnlens.sources.tables import table


# A05 — distinct projection
@query("distinct_projection", "A05 O10")
def distinct_projection(spark, sf):
    return _events(spark, sf).select("user_id", "day", "event_type").distinct()


# A34 P17 — game roll-up: max turn, distinct players, winner = first non-empty
@query("game_rollup", "A34 P17 F03")
def game_rollup(spark, sf):
    ev = _events(spark, sf)
    victory = F.when((F.col("event_type") == "purchase") & (F.col("value") > 45),
                     F.col("event_type")).otherwise(F.lit(""))
    ev = ev.withColumn("victory", first_non_empty(victory))
    return ev.groupBy("user_id").agg(
        F.max("day").alias("max_day"),
        F.countDistinct("event_type").alias("n_types"),
        F.min("victory").alias("winner_type"),
        F.min(F.when(F.col("victory").isNotNull(), F.col("event_id"))).alias("winner_event_id"))


# A35 — end-state share via the entity's last turn (semi join)
@query("end_state_share", "A35 J11")
def end_state_share(spark, sf):
    ev = _events(spark, sf)
    last = ev.groupBy("user_id").agg(F.max("day").alias("day"))
    at_end = ev.join(last, ["user_id", "day"], "left_semi")
    per = at_end.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    tot = per.groupBy("user_id").agg(F.sum("n").alias("tot"))
    j = per.join(tot, "user_id")
    return j.select("user_id", "event_type", "n", _r(F.col("n") / F.col("tot")).alias("share"))


# A37 P18 J01 — pick performance by routed section
@query("pick_performance", "A37 P18 J01")
def pick_performance(spark, sf):
    o = table(spark, sf, "orders")
    winners = o.groupBy("o_custkey").agg(
        F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("w"))
    j = keyed.winner_join(o, winners, ["o_custkey"], "o_orderkey", "w", "won")
    early = F.month("o_orderdate") <= 6
    # category leads; the follower category splits by moment; others drop
    section = (F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("urgent"))
               .when(F.col("o_orderpriority") == "2-HIGH", F.lit("high"))
               .when(F.col("o_orderpriority") == "5-LOW",
                     F.when(early, F.lit("low_early")).otherwise(F.lit("low_late"))))
    j = j.withColumn("section", section).filter(F.col("section").isNotNull())
    return j.groupBy("section", "o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("won").alias("wins"),
        F.count_if(~F.col("won")).alias("losses"),
        _r(F.avg(F.dayofyear("o_orderdate"))).alias("avg_day"))


# A38 — openings per (entity, branch) and wins per (branch, type)
@query("opens_and_wins", "A38 A56")
def opens_and_wins(spark, sf):
    o = table(spark, sf, "orders")
    opens = o.groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("opens"))
    wins = (o.filter(F.col("o_totalprice") > 300000)
            .groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("wins")))
    j = opens.join(wins, ["o_orderpriority", "o_orderstatus"], "left")
    return j.select("o_orderpriority", "o_orderstatus", "opens",
                    F.coalesce("wins", F.lit(0)).cast("bigint").alias("wins"))


# A53 — first value per duplicate key, then pivot
@query("first_then_pivot", "A53 P07")
def first_then_pivot(spark, sf):
    c = rename(table(spark, sf, "customer"), {"c_acctbal": "balance", "c_mktsegment": "segment"})
    first = c.groupBy("c_nationkey", "segment").agg(
        F.min_by("balance", "c_custkey").alias("balance"))
    return reshape.pivot_agg(first, ["c_nationkey"], "segment",
                             domain(c, "segment", SEGMENTS), F.first("balance"),
                             "bal_", fill=None)


# F08 — bitmask of opened branches, tested with bit-and
@query("branch_bitmask", "F08 P29")
def branch_bitmask(spark, sf):
    o = table(spark, sf, "orders")
    # known branches keep their bits, others follow
    bits = [*ORDER_STATUSES, *[s for s in domain(o, "o_orderstatus", []) if s not in ORDER_STATUSES]]
    idx = F.array_position(F.array(*[F.lit(s) for s in bits]), F.col("o_orderstatus")) - 1
    m = o.groupBy("o_custkey").agg(bitmask_of(idx).alias("mask"))
    return m.select("o_custkey", "mask",
                    bit_is_set("mask", 0).alias("has_F"), bit_is_set("mask", 2).alias("has_P"))


# J05 J14 J20 — roster with chained left joins of per-entity facts
@query("roster_left_joins", "J05 J14 J20 P08")
def roster_left_joins(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    o = table(spark, sf, "orders")
    li = table(spark, sf, "lineitem")
    n_orders = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count(F.lit(1)).alias("n_orders"))
    spend = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.sum(F.col("o_totalprice").cast(MONEY)).cast(MONEY).alias("spend"))
    first = rank.first_per_group(o.withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"],
                                 ["o_orderdate", "o_orderkey"], ["o_orderkey"], "first_")
    lines = (li.join(o, li.l_orderkey == o.o_orderkey)
             .groupBy(F.col("o_custkey").alias("c_custkey"))
             .agg(F.count(F.lit(1)).alias("n_lines")))
    nat_rank = (c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("nation_size")))
    out = c
    for right in (n_orders, spend, first, lines):
        out = keyed.join_on_common(out, right, "left")
    out = keyed.join_on_common(out, nat_rank, "left")
    return out.na.fill(0, ["n_orders", "n_lines"])


# J26 — era-wide features as one pivot with prefixed names
@query("era_feature_pivot", "J26")
def era_feature_pivot(spark, sf):
    ev = _events(spark, sf).withColumn("week", F.floor(F.col("day") / 7).cast("int"))
    weeks = list(range(last_day(ev) // 7 + 1))
    p = ev.groupBy("user_id").pivot("week", weeks).agg(
        F.sum(F.col("value").cast(MONEY)).alias("value"), F.count(F.lit(1)).alias("n"))
    cols = []
    for w in weeks:
        cols += [F.coalesce(F.col(f"{w}_value"), F.lit(0)).cast(MONEY).alias(f"w{w}_value"),
                 F.coalesce(F.col(f"{w}_n"), F.lit(0)).cast("bigint").alias(f"w{w}_n")]
    return p.select("user_id", *cols)


# O01 — multi-key mixed-direction sort with pinned null order
@query("ordered_report", "O01 O02 O04")
def ordered_report(spark, sf):
    o = table(spark, sf, "orders")
    g = o.groupBy("o_orderpriority", "o_orderstatus").agg(
        F.sum(F.col("o_totalprice").cast(MONEY)).cast(MONEY).alias("total"))
    return g.orderBy(F.col("o_orderpriority").asc_nulls_first(), F.col("total").desc_nulls_last(),
                     F.col("o_orderstatus").asc())


# P19 P20 P28 P12 P16 — decision-tree class, derived flags, eligibility
@query("part_class", "P19 P20 P28 P12 P16")
def part_class(spark, sf):
    p = table(spark, sf, "part")
    flags = {"is_large": F.col("p_size") >= 40,
             "is_promo": F.col("p_type") == "PROMO",
             "is_small_kind": F.col("p_type").isin("SMALL", "ECONOMY")}
    p = p.withColumns(flags)
    cls = decision_class([(F.col("is_promo") & F.col("is_large"), "promo_large"),
                          (F.col("is_promo"), "promo"),
                          (F.col("is_small_kind") & (F.col("p_size") < 10), "small_cheap")],
                         "other")
    tier = recode("p_type", {"ECONOMY": "budget", "SMALL": "budget", "MEDIUM": "standard",
                             "LARGE": "standard", "PROMO": "promo"})
    out = p.select("p_partkey", cls.alias("part_class"), "is_large", "is_promo",
                   "is_small_kind", tier.alias("tier"))
    # facets of the parts against a rule table; a part without size fits any
    rules = spark.createDataFrame(
        [("shelf", ["promo", "Brand#11", "Brand#22"], [str(s) for s in (1, *range(5, 51, 5))])],
        "rule string, kind array<string>, size array<string>")
    kinds = F.array(F.when(F.col("is_promo"), F.lit("promo")).otherwise(F.lit("")), "p_brand")
    chosen = eligible(p.withColumn("kinds", kinds), "p_partkey",
                      {"kind": F.when(F.col("p_size").isNotNull(), F.col("kinds")), "size": F.col("p_size")},
                      rules, null_always=["kind", "size"]).select("p_partkey", F.lit(True).alias("eligible"))
    return out.join(chosen, "p_partkey", "left").fillna(False, ["eligible"]).filter(F.col("tier").isNotNull())


# S28 A58 F04 — nested usage logs: one JSON document per conversation
@query("usage_log_rollup", "S28 A58 F04")
def usage_log_rollup(spark, sf):
    from turnlens.sources import usage_log
    cv = table(spark, sf, "conversations")
    iso = lambda sec: F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + sec),
                                    "yyyy-MM-dd'T'HH:mm:ss'Z'")
    at = F.col("conv_id") % 1000 * 60 + F.col("turn") * 95
    n = F.length("text").cast("long")
    entry = F.struct(
        F.when(F.col("role") == "user", "request").otherwise("toolCall").alias("kind"), iso(at).alias("time"),
        F.struct(iso(at - 5).alias("startTime"), iso(at + n % 50).alias("endTime"), F.struct(
            n.alias("prompt_tokens"), F.col("turn").cast("long").alias("completion_tokens"),
            F.struct(F.floor(n / 3).cast("long").alias("cached_tokens")).alias("prompt_tokens_details"))
            .alias("usage")).alias("metadata"))
    files = cv.groupBy("conv_id").agg(F.to_json(F.struct(   # one conversation's entries
        F.array_sort(F.collect_list(entry)).alias("logs"))).alias("text"))
    out = usage_log.usage(usage_log.entries(files, "conv_id", "text"))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return out.select(F.col("file").alias("conv_id"), "n_requests", "n_tool_calls", "input_tokens",
                      "cached_input_tokens", "total_input_tokens", "output_tokens", stamp("first_time"),
                      stamp("last_time"), "span")


# P24 P27 — positive-value filter on one measure and one reason, low-signal cut
@query("low_signal_cut", "P24 P27")
def low_signal_cut(spark, sf):
    ev = _events(spark, sf).filter((F.col("value") > 0) & (F.col("event_type") == "purchase"))
    per = ev.groupBy("user_id", F.floor(F.col("day") / 7).cast("int").alias("week")).agg(
        F.count(F.lit(1)).alias("n"))
    tot = per.groupBy("week").agg(F.sum("n").alias("tot"))
    s = per.join(tot, "week").withColumn("share", F.col("n") / F.col("tot"))
    mean = s.groupBy("user_id").agg(_r(F.avg("share")).alias("mean_share"))
    return mean.filter(F.col("mean_share") > 0.0066)


# P25 — impossible-row cut through a dimension join
@query("impossible_row_cut", "P25 J03")
def impossible_row_cut(spark, sf):
    li = table(spark, sf, "lineitem")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    ok = j.filter(F.to_date("l_shipdate") >= F.to_date("o_orderdate"))
    return ok.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n_kept"))


# W23 — which of two events came first per entity
@query("first_of_two", "W23 P30")
def first_of_two(spark, sf):
    ev = table(spark, sf, "events")
    g = ev.groupBy("user_id").agg(
        F.min(F.when(F.col("event_type") == "signup", F.struct("ts", "event_id"))).alias("a"),
        F.min(F.when(F.col("event_type") == "purchase", F.struct("ts", "event_id"))).alias("b"))
    first = (F.when(F.col("a").isNull() & F.col("b").isNull(), F.lit("neither"))
             .when(F.col("b").isNull(), F.lit("signup"))
             .when(F.col("a").isNull(), F.lit("purchase"))
             .when(F.col("a") < F.col("b"), F.lit("signup")).otherwise(F.lit("purchase")))
    return g.select("user_id", first.alias("first_event"),
                    F.col("a").isNotNull().cast("int").alias("did_signup"),
                    F.col("b").isNotNull().cast("int").alias("did_purchase"))


# A63 — bootstrap resample of whole entities, cloned through a dependent table
@query("bootstrap_resample", "A63")
def bootstrap_resample(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey").distinct()
    li = table(spark, sf, "lineitem")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    # Poisson(1) copies per (replicate, customer) from a seeded hash: an
    # exact inverse-CDF table, so no sample is collected to the driver
    reps = o.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(19))))
    # 52-bit uniform; terms of the law until none is left in a double
    u = hash_number(F.lit(11), F.col("rep"), F.col("o_custkey")) / float(1 << 52)
    cdf = POISSON_CDF
    k = F.lit(len(cdf))
    for i in reversed(range(len(cdf))):
        k = F.when(u < cdf[i], F.lit(i)).otherwise(k)
    reps = reps.withColumn("copies", k).filter(F.col("copies") > 0)
    cloned = reps.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    facts = li.join(orders, li.l_orderkey == orders.o_orderkey).select("o_custkey", "l_quantity")
    per_cust = facts.groupBy("o_custkey").agg(F.sum("l_quantity").alias("qty"),
                                              F.count(F.lit(1)).alias("n"))
    j = cloned.join(per_cust, "o_custkey", "left").na.fill(0, ["qty", "n"])
    return j.groupBy("rep").agg(F.count(F.lit(1)).alias("n_customers"),
                                _r(F.sum("qty") / F.sum("n")).alias("mean_qty"))


# Chances of at most 0, 1, 2, ... copies under Poisson(1).
POISSON_CDF = list(accumulate(math.exp(-1) / math.factorial(i) for i in range(20)))
ORACLES["bootstrap_resample"] = f"""
WITH r AS (SELECT o_custkey, unnest(range(0, 20)) AS rep FROM (SELECT DISTINCT o_custkey FROM orders)),
u AS (SELECT *, CAST(('0x' || left(md5('11|' || rep || '|' || o_custkey), 13)) AS BIGINT) / 4503599627370496.0 AS u FROM r),
c AS (SELECT *, len([x FOR x IN [{', '.join(repr(x) for x in POISSON_CDF)}]::DOUBLE[] IF x <= u]) AS copies FROM u),
p AS (SELECT o_custkey, sum(l_quantity) AS qty, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)
SELECT CAST(rep AS INTEGER) AS rep, CAST(sum(copies) AS BIGINT) AS n_customers,
  round(sum(copies * coalesce(qty, 0)) / sum(copies * coalesce(n, 0)), 6) AS mean_qty
FROM c LEFT JOIN p USING (o_custkey) GROUP BY 1"""


# K10 — nested group → list JSON export
@query("nested_list_export", "K10")
def nested_list_export(spark, sf):
    from turnlens.sinks.store import nested_list_json
    # lists hold distinct brands (a bounded domain), never raw rows
    p = table(spark, sf, "part").withColumn("size_band", (F.col("p_size") / 10).cast("int"))
    return nested_list_json(p, "p_type", "size_band", "p_brand")


# W01 on a different key: split ordered scan by supplier over ship dates
@query("supplier_running_quantity", "W05 W01")
def supplier_running_quantity(spark, sf):
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey",
                                              "l_linenumber", "l_partkey", "l_quantity")
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]
    out = ordered_scan(li, ["l_suppkey"], order,
                       F.year("l_shipdate") * 12 + F.month("l_shipdate"),
                       row_number="n_so_far",
                       sums={"qty_so_far": F.col("l_quantity").cast(MONEY)})
    return out.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey",
                      F.col("n_so_far").cast("bigint"), F.col("qty_so_far").cast("decimal(18,2)"))


# M04 — ridge facets: n, mean, median per category, ordered by median
@query("ridge_facets", "M04")
def ridge_facets(spark, sf):
    from turnlens.operators.aggregate import grouped_exact_quantiles
    ev = table(spark, sf, "events")
    g = ev.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), _r(F.avg("value")).alias("mean"))
    med = grouped_exact_quantiles(ev, ["event_type"], "value", [0.5], "m")
    j = g.join(med, "event_type").select("event_type", "n", "mean", _r(F.col("m_0")).alias("median"))
    return j.orderBy(F.col("median").desc(), F.col("event_type"))


# A65 — contribution score: share per era (absent = 0), averaged, top-N by score then name
@query("contribution_score", "A65 J19")
def contribution_score(spark, sf):
    from turnlens.operators import share as sh
    ev = _events(spark, sf).withColumn("week", F.floor(F.col("day") / 7).cast("int"))
    g = ev.groupBy("week", "event_type").agg(F.sum(F.col("value").cast(MONEY)).cast("double")
                                             .alias("v"))
    s = sh.share_within(g, ["week"], "v", "share")
    grid = reshape.complete_grid(s, "week", "event_type", domain(ev, "event_type", EVENT_TYPES), F.first("share"), "share",
                                 fill=0.0)
    n_weeks = s.select(F.countDistinct("week")).scalar()
    score = grid.groupBy("event_type").agg((F.sum("share") / n_weeks).alias("score"))
    top = rank.top_k_per_group(score.withColumn("__all", F.lit(1)), ["__all"],
                               [F.col("score").desc(), F.col("event_type")], 3, "rank")
    return top.select("event_type", _r(F.col("score")).alias("score"),
                      F.col("rank").cast("bigint"))


# A57 — per-runner summary: mean of ratios over games with turns > 0
@query("runner_summary", "A57 A59")
def runner_summary(spark, sf):
    ev = _events(spark, sf)
    per_game = ev.groupBy("user_id", "day").agg(
        F.count(F.lit(1)).alias("turns"),
        ((F.unix_micros(F.max("ts").cast("timestamp"))
          - F.unix_micros(F.min("ts").cast("timestamp"))) / 1e6).alias("time_sec"))
    per_game = per_game.withColumn("turns", F.col("turns") - 1)
    return per_game.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("games"),
        F.sum("turns").alias("total_turns"),
        # seconds to the millisecond: a mean of many ratios is only stable to ~1e-11
        _r(F.avg(F.when(F.col("turns") > 0, F.col("time_sec") / F.col("turns"))), 3)
        .alias("mean_sec_per_turn"))


# W10 — first missing tier, last state before it, balanced side split
@query("first_missing_tier", "W10 J19")
def first_missing_tier(spark, sf):
    from turnlens.operators.ordered import dense_spine, global_row_number
    ev = _events(spark, sf)
    days = last_day(ev) + 1
    present = ev.select("user_id", "day").distinct()
    spine = dense_spine(ev.select("user_id"), 0, days - 1, "day")
    missing = (spine.join(present, ["user_id", "day"], "left_anti")
               .groupBy("user_id").agg(F.min("day").alias("first_missing")))
    users = ev.select("user_id").distinct().join(missing, "user_id", "left")
    users = users.withColumn("first_missing", F.coalesce("first_missing", F.lit(days)))
    before = ev.join(users, "user_id").filter(F.col("day") < F.col("first_missing"))
    last = before.groupBy("user_id").agg(
        F.max_by("event_type", F.struct("ts", "event_id")).alias("last_state"))
    j = users.join(last, "user_id", "left")
    n = j.select(F.count(F.lit(1))).scalar()
    ranked = global_row_number(j, [F.col("first_missing"), F.col("user_id")], "pos")
    return ranked.select("user_id", "first_missing", "last_state",
                         F.when(F.col("pos") <= F.floor(n / 2), "left").otherwise("right")
                         .alias("side"))


# T06 — repeated ids in an arrival stream (drop form)
@query("stream_drop_repeats", "T06")
def stream_drop_repeats(spark, sf):
    from turnlens.plans.extra import events_stream
    from turnlens.streaming import live
    s = events_stream(spark, sf)
    d = live.drop_repeats(s.select("user_id", "event_type"), ["user_id", "event_type"])
    res = live.run_to_table(d, "repeats", mode="append")
    return res.select("user_id", "event_type")


# T04 — one-shot pulses counted, stored state normalised
@query("stream_pulse_counts", "T04")
def stream_pulse_counts(spark, sf):
    from turnlens.plans.extra import events_stream
    from turnlens.streaming import live
    s = live.with_event_time(events_stream(spark, sf), "ts")
    agg = live.pulse_counts(s, "user_id", "event_type", pulse="signup", normal="view", watermark="1 hour")
    periods = live.run_to_table(agg, "pulses", mode="update", keys=["period", "user_id"])
    return live.merge_pulses(periods, "user_id")


# T02 — keys silent longer than a timeout expire (event-time timers)
@query("stream_expired_keys", "T02")
def stream_expired_keys(spark, sf):
    from turnlens.plans.extra import events_stream
    from turnlens.streaming import live
    s = events_stream(spark, sf)
    res = live.expired_keys(s, "user_id", "ts", 6 * 3600, "1 hour")
    return res.select(F.col("key").alias("user_id"),
                      F.date_format(F.timestamp_micros("last_seen_us"),
                                    "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last_seen"))


# A45 — min / median / max of the first turn an era is reached, and the share reached
@query("era_reach", "A45 A06")
def era_reach(spark, sf):
    from turnlens.operators.aggregate import grouped_exact_quantiles
    ev = _events(spark, sf)
    first = ev.groupBy("user_id", "event_type").agg(F.min("day").alias("first_day"))
    n_users = ev.select(F.countDistinct("user_id")).scalar()
    g = first.groupBy("event_type").agg(F.min("first_day").alias("min_day"),
                                        F.max("first_day").alias("max_day"),
                                        F.count(F.lit(1)).alias("n"))
    med = grouped_exact_quantiles(first, ["event_type"], "first_day", [0.5], "m")
    return g.join(med, "event_type").select(
        "event_type", "min_day", _r(F.col("m_0")).alias("median_day"), "max_day", "n",
        _r(F.col("n") / n_users).alias("reach_share"))
