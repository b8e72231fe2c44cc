"""Domain marts over parsed game logs (the reference's own tables).

Each function takes parsed DataFrames (see :mod:`turnlens.sources.logs`)
and returns a mart; nothing is registered as a temp view and no name is
rebound. Spines are de-duplicated (B3), the era join uses all three keys
(B5), vassal ownership is an as-of join to the latest deal (B6), and the
number of players is counted instead of assumed (B8).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from turnlens.operators import fold, keyed, rank, reshape
from turnlens.operators.ordered import (as_of_join, explode_interval, ordered_scan,
                                        spine_running_total)
from turnlens.sources.dims import ERA_END_COLUMNS
from turnlens.sources.logs import VICTORY_FLAGS

LINE_CHUNK = 4096     # rows of one log file scanned per chunk in split folds


def civ_game_result(results: DataFrame, scores: DataFrame) -> DataFrame:
    """J01 + J02: every civ of a game with the game's end turn; victory type
    and flags only on the winner's row (left join on civ = victory_civ)."""
    win = results.select("game_id", F.col("victory_civ").alias("civ"), "victory_type",
                         *VICTORY_FLAGS)
    end = results.select("game_id", F.col("turn").alias("game_end_turn"))
    return (scores.join(win, ["game_id", "civ"], "left").join(end, "game_id", "inner")
            .select("game_id", "civ", "game_end_turn", "score", "victory_type", *VICTORY_FLAGS))


def victory_stats(results: DataFrame) -> DataFrame:
    """Count, mean and sample stddev of the end turn per victory type."""
    return results.groupBy("victory_type").agg(F.count(F.lit(1)).alias("count"),
                                               F.avg("turn").alias("avg_turn"),
                                               F.stddev_samp("turn").alias("stddev_turn"))


def augment_with_map_metrics(cgr: DataFrame, own: DataFrame) -> DataFrame:
    """Civ results plus the tile and city shares each civ held (as effective
    owner) at the game's end turn (left join on game, civ, end turn)."""
    o = own.select("game_id", F.col("effective_owner").alias("civ"),
                   F.col("turn").alias("game_end_turn"), "tiles_owned_percentage",
                   "cities_owned_percentage")
    return cgr.join(o, ["game_id", "civ", "game_end_turn"], "left")


VICTORY_NAMES = ["culture", "diplomatic", "domination", "science", "time"]


def civ_performance(cgr: DataFrame) -> DataFrame:
    """Per civ: games, win rate (share of games won), wins per type
    (sum of flags), mean of each flag (flags are null on rows the civ did not
    win, so this mean runs over its wins), mean map shares at game end (when
    present) and mean score."""
    won = F.col("victory_type").isNotNull()
    shares = []
    for c in ("tiles_owned_percentage", "cities_owned_percentage"):
        if c in cgr.columns:
            shares.append(F.avg(c).alias(f"avg_{c}"))
    return cgr.groupBy("civ").agg(
        F.count(F.lit(1)).alias("count_games"),
        F.avg(F.when(won, 1.0).otherwise(0.0)).alias("winrate"),
        *[F.sum(f).alias(f"{n}_victories") for f, n in zip(VICTORY_FLAGS, VICTORY_NAMES)],
        *[F.avg(f).alias(f"pct_{n}_victories") for f, n in zip(VICTORY_FLAGS, VICTORY_NAMES)],
        *shares,
        F.avg("score").alias("avg_score"))


# Policy branch numbers → output column names, in branch order (fixed values).
BRANCH_COLUMNS = ["e1_policy_tradition", "e1_policy_progress", "e1_policy_authority",
                  "e3_policy_fealty", "e3_policy_statecraft", "e3_policy_artistry",
                  "e5_policy_industry", "e5_policy_imperialism", "e5_policy_rationalism",
                  "e7_ideology_freedom", "e7_ideology_order", "e7_ideology_autocracy"]


def civ_choices(cgr: DataFrame, branches: DataFrame, choices: DataFrame) -> DataFrame:
    """J05 + A04 + P07: every civ-game with its religion milestone turns
    (pantheon, founded, enhanced, reformed; distinct turns) and branch
    opening counts, as a chain of left joins onto the roster."""
    pivot = reshape.pivot_count(branches, ["game_id", "civ"], "branch",
                                list(range(len(BRANCH_COLUMNS))), "__b")
    pivot = pivot.withColumnsRenamed({f"__b{i}": n for i, n in enumerate(BRANCH_COLUMNS)})
    out = cgr.select("game_id", "civ")
    for kind, name in (("pantheon", "pantheon_founded"), ("religion_founded", "religion_founded"),
                       ("religion_enhanced", "religion_enhanced"),
                       ("religion_reformed", "religion_reformed")):
        t = (choices.filter(F.col("type") == kind).select("game_id", "civ", F.col("turn").alias(name))
             .distinct())
        out = out.join(t, ["game_id", "civ"], "left")
    return out.join(pivot, ["game_id", "civ"], "left")


def civ_performance_wins_only(cgr: DataFrame) -> DataFrame:
    """Type shares over won games only (null on other rows)."""
    won = F.col("victory_type").isNotNull()
    return cgr.groupBy("civ").agg(
        F.count(F.lit(1)).alias("games"),
        F.avg(won.cast("double")).alias("winrate"),
        *[F.avg(F.when(won, F.col(f).cast("double"))).alias(f"{f}_share_of_wins")
          for f in VICTORY_FLAGS])


def research_intervals(tech: DataFrame, tech_dim: DataFrame) -> DataFrame:
    """Per tech-log file, CHOSEN sets the start turn; COMPLETED
    emits (nation, tech, duration, gridx_at_start = running max grid column
    including this tech, start_turn, end_turn). ``tech_dim``: (tech, gridx)."""
    dim = keyed.broadcast_if_small(tech_dim.select("tech", "gridx"))
    t = tech.join(dim, "tech", "left")
    out = fold.chosen_completed_intervals(
        t, ["game_id", "file"], ["line_no"], F.floor(F.col("line_no") / LINE_CHUNK),
        is_chosen=F.col("action") == "CHOSEN", is_completed=F.col("action") == "COMPLETED",
        turn="turn", grid=F.col("gridx"))
    return out.select("game_id", "nation", "tech", "duration", "grid_at_start",
                      "start_turn", "end_turn", "line_no").withColumnRenamed(
        "grid_at_start", "gridx_at_start")


def unknown_techs(tech: DataFrame, tech_dim: DataFrame) -> DataFrame:
    """Q02: techs in the logs that the dimension does not know."""
    return keyed.anti(tech.select("game_id", "tech").distinct(), tech_dim, ["tech"])


_ERA_OUT = T.StructType([T.StructField("game_id", T.StringType()),
                         T.StructField("civ", T.StringType()),
                         T.StructField("start_turn", T.IntegerType()),
                         T.StructField("end_turn", T.IntegerType()),
                         T.StructField("era", T.IntegerType())])


def civ_turn_era(research: DataFrame, tech_dim: DataFrame, num_partitions: int | None = None,
                 dedupe: bool = True) -> DataFrame:
    """W18 + W19 + W24: era per (game, civ, turn). Research rows are folded
    in (end_turn, line_no) order (B4); each row's turns get the era before
    the row is applied; the era rises by one when the tech's era is above it
    or when the tech completes an era-closing grid column. The fold is one
    streaming pass over key-sorted partitions (no group in memory). Shared
    endpoints can give a turn twice (B3); ``dedupe`` keeps the max era."""
    dim = keyed.broadcast_if_small(tech_dim.select("tech", "gridx", "era"))
    col_size = tech_dim.groupBy("gridx").agg(F.count(F.lit(1)).alias("col_size"))
    r = (research.join(dim, "tech", "left")
         .join(keyed.broadcast_if_small(col_size), "gridx", "left")
         .select("game_id", F.col("nation").alias("civ"), "start_turn", "end_turn", "line_no",
                 F.col("gridx").cast("int"), F.col("era").cast("int").alias("tech_era"),
                 F.col("col_size").cast("int")))
    spark = research.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = r.repartition(n, "game_id", "civ").sortWithinPartitions("game_id", "civ", "end_turn",
                                                                  "line_no")
    closing = set(ERA_END_COLUMNS)

    def run(batches):
        import pandas as pd
        key, era, done = None, 1, {}
        for pdf in batches:
            out_era = []
            for g, c, gx, te, cs in zip(pdf["game_id"], pdf["civ"], pdf["gridx"],
                                        pdf["tech_era"], pdf["col_size"]):
                if (g, c) != key:
                    key, era, done = (g, c), 1, {}
                out_era.append(era)
                if pd.isna(gx):
                    continue
                gx = int(gx)
                done[gx] = done.get(gx, 0) + 1
                if (not pd.isna(te) and int(te) > era) or (
                        gx in closing and not pd.isna(cs) and done[gx] == int(cs)):
                    era += 1
            yield pd.DataFrame({"game_id": pdf["game_id"], "civ": pdf["civ"],
                                "start_turn": pdf["start_turn"].astype("int32"),
                                "end_turn": pdf["end_turn"].astype("int32"),
                                "era": pd.Series(out_era, dtype="int32")})

    eras = src.mapInPandas(run, _ERA_OUT)
    turns = explode_interval(eras, "start_turn", "end_turn", "turn").select(
        "game_id", "civ", "turn", "era")
    if dedupe:
        turns = turns.groupBy("game_id", "civ", "turn").agg(F.max("era").alias("era"))
    return turns


def era_transition_deltas(cte: DataFrame) -> DataFrame:
    """A06 + A07: first turn per (game, civ, era) and its delta from the
    game's average first turn of that era."""
    first = cte.groupBy("game_id", "civ", "era").agg(F.min("turn").alias("transition_turn"))
    avg = first.groupBy("game_id", "era").agg(F.avg("transition_turn").alias("avg_turn"))
    return (first.join(avg, ["game_id", "era"], "left")
            .select("game_id", "civ", "era", "transition_turn",
                    (F.col("transition_turn") - F.col("avg_turn")).alias("delta_turns")))


def religion_choices(rel: DataFrame, events: dict) -> DataFrame:
    """Beliefs chosen (buffered CHOSEN rows) are consumed by the
    next founding event of the same log: 1 or 2 per event kind. Output civ
    and turn come from the event row. ``events``: event text → (type, n)."""
    kind = F.create_map(*[x for k, (t, _) in events.items() for x in (F.lit(k), F.lit(t))])
    take = F.create_map(*[x for k, (_, n) in events.items() for x in (F.lit(k), F.lit(n))])
    r = rel.withColumn("type", F.element_at(kind, F.col("event")))
    out = fold.buffered_event_groups(
        r, ["game_id", "file"], ["line_no"], F.floor(F.col("line_no") / LINE_CHUNK),
        is_event=F.col("type").isNotNull(), is_buffered=F.col("event") == "CHOSEN",
        take=F.element_at(take, F.col("event")), event_cols=["civ", "type", "turn"],
        item_cols=["details"], max_take=max(n for _, n in events.values()))
    return out.select("game_id", F.col("event_civ").alias("civ"), F.col("event_type").alias("type"),
                      F.col("event_turn").alias("turn"), F.col("item_details").alias("belief"))


def religion_rejects(rel: DataFrame, events: dict) -> DataFrame:
    """Founding events with fewer buffered beliefs than their kind takes:
    (game_id, file, line_no, event, expected, found)."""
    kinds = F.create_map(*[x for k, (_, n) in events.items() for x in (F.lit(k), F.lit(n))])
    r = rel.withColumn("__take", F.element_at(kinds, F.col("event")))
    r = r.filter(F.col("__take").isNotNull() | (F.col("event") == "CHOSEN"))
    waiting = (F.col("event") == "CHOSEN").cast("int")
    # beliefs buffered before a row, and before the event ahead of it
    scanned = ordered_scan(r, ["game_id", "file"], ["line_no"], F.floor(F.col("line_no") / LINE_CHUNK),
                           sums={"__seen": waiting})
    events_only = ordered_scan(scanned.filter("__take is not null"), ["game_id", "file"], ["line_no"],
                               F.floor(F.col("line_no") / LINE_CHUNK), lags={"__before": F.col("__seen")})
    found = F.col("__seen") - F.coalesce("__before", F.lit(0))
    return events_only.filter(found < F.col("__take")).select(
        "game_id", "file", "line_no", "event", F.col("__take").alias("expected"), found.cast("int").alias("found"))


def belief_stats(choices: DataFrame, cgr: DataFrame) -> DataFrame:
    """Per (type, belief): mean turn, picks, and picks by the winner."""
    winners = cgr.filter(F.col("victory_type").isNotNull()).select("game_id", "civ")
    j = choices.join(winners.withColumn("won", F.lit(1)), ["game_id", "civ"], "left")
    return j.groupBy("type", "belief").agg(F.avg("turn").alias("avg_turn"),
                                           F.count(F.lit(1)).alias("chosen_count"),
                                           F.sum(F.coalesce("won", F.lit(0))).alias("wins"))


def policy_pick_order(choices: DataFrame) -> DataFrame:
    """Pick order per (game, civ) by turn; on equal turns the
    branch row comes before policy rows, then file order (a stable total
    order). Split scan, chunked by turn."""
    c = choices.withColumn("__is_policy", ~F.col("item").startswith("Branch"))
    return ordered_scan(c, ["game_id", "civ"], ["turn", "__is_policy", "file", "line_no"],
                        F.col("turn"), row_number="pick_order").drop("file", "line_no",
                                                                      "__is_policy")


def branch_counts(branches: DataFrame, n_branches: int = 12) -> DataFrame:
    """A04 + P08: openings per (game, civ) × branch 0..n−1 and up to the last
    branch there is, zero filled."""
    last = branches.agg(F.max("branch")).first()[0]
    n = max(n_branches, 0 if last is None else last + 1)
    return reshape.pivot_count(branches, ["game_id", "civ"], "branch", list(range(n)), "branch_")


def latest_vassalage(deals: DataFrame) -> DataFrame:
    """Each vassal's latest deal per game (ties kept)."""
    return rank.rows_at_group_extreme(deals, ["game_id", "vassal"], "turn", "max")


def vassal_stripes(latest: DataFrame) -> DataFrame:
    """Per game, master → sorted list of vassals (bounded by players)."""
    per = latest.groupBy("game_id", "master").agg(F.sort_array(F.collect_set("vassal")).alias("v"))
    return per.groupBy("game_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("master", "v")))).alias("stripes"))


def ownership(map_state: DataFrame, deals: DataFrame) -> DataFrame:
    """A18 + A19 + A20 + J11 + P31: tiles and cities per (game, owner, turn),
    effective owner = master of the latest deal at or before the turn (B6),
    shares of the game-turn totals."""
    owned = map_state.filter(F.col("owner_civ") != "")
    per = owned.groupBy("game_id", "owner_civ", "turn").agg(
        F.count(F.lit(1)).alias("tiles_owned"),
        F.sum(F.when(F.col("city_id") >= 0, 1).otherwise(0)).alias("cities_owned"))
    d = deals.select("game_id", F.col("vassal").alias("owner_civ"), F.col("turn").alias("deal_turn"),
                     "master")
    # deterministic tiebreaks (a recomputed task must order rows the same
    # way): one aggregate row per (game, owner, turn) on the left; deals of the
    # same turn are ordered by master name on the right
    eff = as_of_join(per, d, ["game_id", "owner_civ"], "turn", "deal_turn", "turn", "master",
                     ["master"], chunk_of=lambda c: F.floor(c / 50))
    eff = eff.withColumn("effective_owner", F.coalesce("master", "owner_civ"))
    e = eff.groupBy("game_id", "effective_owner", "turn").agg(
        F.sum("tiles_owned").alias("tiles_owned"), F.sum("cities_owned").alias("cities_owned"))
    tot = per.groupBy("game_id", "turn").agg(F.sum("tiles_owned").alias("t_tiles"),
                                             F.sum("cities_owned").alias("t_cities"))
    return (e.join(tot, ["game_id", "turn"], "left")
            .withColumn("tiles_owned_percentage", F.col("tiles_owned") / F.col("t_tiles"))
            .withColumn("cities_owned_percentage",
                        F.try_divide(F.col("cities_owned"), F.nullif("t_cities", F.lit(0))))
            .drop("t_tiles", "t_cities"))


def authority_victories(own: DataFrame, threshold: float = 0.66666) -> DataFrame:
    """A21 + J10: the first turn each (game, owner) holds more than the
    threshold of both tiles and cities. ``tiles_owned`` and ``cities_owned``
    are the shares at that turn, under the names that hold them downstream."""
    hit = own.filter((F.col("tiles_owned_percentage") > threshold)
                     & (F.col("cities_owned_percentage") > threshold))
    first = hit.groupBy("game_id", "effective_owner").agg(F.min("turn").alias("turn"))
    out = hit.join(first, ["game_id", "effective_owner", "turn"], "inner")
    return out.select("game_id", "effective_owner", F.col("effective_owner").alias("owner_nation"), "turn",
                      F.col("tiles_owned_percentage").alias("tiles_owned"),
                      F.col("cities_owned_percentage").alias("cities_owned"),
                      F.lit(1).alias("pseudo_victory"))


def instant_yield_pivot(iy: DataFrame, yields: dict | None = None) -> DataFrame:
    """A10: one BIGINT column per instant-yield type (explicit values; the
    sum is cast back to BIGINT), per (game, turn, civ, reason), zero filled."""
    from turnlens.sources.logs import INSTANT_YIELD_TYPES
    yields = yields or INSTANT_YIELD_TYPES
    wide = reshape.pivot_agg(iy, ["game_id", "turn", "civ", "reason"], "yield", list(yields),
                             F.sum("value"), "__y_", fill=0)
    return wide.select("game_id", "turn", "civ", "reason",
                       *[F.col(f"__y_{y}").cast("bigint").alias(c) for y, c in yields.items()])


def instant_yield_running_totals(iy: DataFrame, yields: list[str],
                                 max_turn: int | None = None) -> DataFrame:
    """Dense turns 1..max_turn per (game, civ) with any instant yield;
    running total per yield (turn 0 never enters). Without ``max_turn`` the
    turns run to the last one of any game."""
    if max_turn is None:
        max_turn = max(1, iy.agg(F.coalesce(F.max("turn"), F.lit(1))).first()[0])
    out = None
    for y in yields:
        facts = iy.filter(F.lower("yield") == y.lower()).select("game_id", "civ", "turn", "value")
        rt = spine_running_total(facts, ["game_id", "civ"], "turn", "value", 1, max_turn,
                                 "v", f"rt_{y.lower().replace(' ', '_')}").drop("v")
        out = rt if out is None else out.join(rt, ["game_id", "civ", "turn"], "full")
    return out.na.fill(0)


def with_era(rows: DataFrame, cte: DataFrame) -> DataFrame:
    """Rows per (game, turn, civ, …) with the civ's era after the turn; rows
    of turns outside the era spine drop out."""
    first = ["game_id", "turn", "era", "civ"]
    return rows.join(cte.select("game_id", "civ", "turn", "era"), ["game_id", "civ", "turn"]).select(
        *first, *[c for c in rows.columns if c not in first])


def trigger_stats(iy: DataFrame, cte: DataFrame) -> DataFrame:
    """A11 (+ B8): per (era, reason, yield) over triggers with a sum > 0,
    where a trigger is all lines of one (game, turn, civ, reason): mean and
    stddev of per-civ trigger counts, the mean over triggers (``avg_iy``) and
    over per-civ means (``mean_value``), and the average times triggered per
    civ-game (players counted, not assumed)."""
    once = iy.groupBy("game_id", "turn", "civ", "reason", "yield").agg(F.sum("value").alias("value"))
    j = once.filter(F.col("value") > 0).join(cte, ["game_id", "civ", "turn"], "inner")
    lvl1 = j.groupBy("game_id", "era", "reason", "yield", "civ").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"), F.sum("value").alias("total"))
    lvl2 = lvl1.groupBy("era", "reason", "yield").agg(
        F.avg("n").alias("mean_times"), F.stddev_samp("n").alias("sd_times"),
        F.avg("mean_value").alias("mean_value"), F.sum("n").alias("rows"),
        (F.sum("total") / F.sum("n")).alias("avg_iy"))
    n_pairs = cte.select(F.count_distinct("game_id", "civ")).scalar()
    return lvl2.withColumn("avg_times_triggered", F.col("rows") / n_pairs)


def purchases_by_era(cte: DataFrame, purchases: DataFrame) -> DataFrame:
    """A08 + J07 + B12: per (game, civ, turn) spine, purchase cost pivoted
    into building/unit (explicit values, zero filled), then era averages
    including turns without purchases."""
    p = reshape.pivot_agg(purchases, ["game_id", "civ", "turn"], "type", ["building", "unit"],
                          F.sum("cost"), "", fill=0)
    spine = cte.join(p, ["game_id", "civ", "turn"], "left").na.fill(0, ["building", "unit"])
    return spine.groupBy("era").agg(F.avg("building").alias("avg_building_invest"),
                                    F.avg("unit").alias("avg_unit_purchase"))


# Plot yields that get a name of their own (fixed values).
PLOT_YIELDS = {f"YIELD_{y}": f"p_{y.lower()}" for y in
               ("CULTURE", "FAITH", "FOOD", "GOLD", "PRODUCTION", "SCIENCE")}


def plot_yield_totals(py: DataFrame) -> DataFrame:
    """A25 + A26: positive sums per (game, civ, turn, yield), pivoted: the six
    known yields as ``p_...``, any other under its own name; a yield without a
    positive sum is null."""
    s = py.groupBy("game_id", "civ", "turn", "yield").agg(F.sum("amount").alias("amount"))
    pos = s.filter(F.col("amount") > 0)
    # the yields of the game, a handful
    more = [r[0] for r in py.select("yield").filter("yield is not null").distinct().collect()]
    ys = [*PLOT_YIELDS, *sorted(set(more) - set(PLOT_YIELDS))]
    wide = reshape.pivot_agg(pos, ["game_id", "civ", "turn"], "yield", ys, F.sum("amount"), "",
                             fill=None)
    return wide.withColumnsRenamed(PLOT_YIELDS)


def unit_compositions_turns(map_state: DataFrame) -> DataFrame:
    """Unit counts per (game, civ, turn, unit), non-empty unit and owner
    only."""
    return (map_state.filter((F.col("unit") != "") & (F.col("unit_owner_civ") != ""))
            .groupBy("game_id", F.col("unit_owner_civ").alias("civ"), "turn", "unit")
            .agg(F.count(F.lit(1)).alias("count")))


def units_per_turn(map_state: DataFrame, cte: DataFrame) -> DataFrame:
    """Per (game, civ, era, unit) the unit count summed over the era's
    snapshot turns divided by the distinct spine turns of (game, civ, era),
    so turns without the unit count as zero; the spine join uses all three
    keys (B5)."""
    u = unit_compositions_turns(map_state)
    num = (u.join(cte, ["game_id", "civ", "turn"], "inner")
           .groupBy("game_id", "civ", "era", "unit").agg(F.sum("count").alias("total_count")))
    den = cte.groupBy("game_id", "civ", "era").agg(F.countDistinct("turn").alias("turn_count"))
    return (num.join(den, ["game_id", "civ", "era"])
            .withColumn("avg_count", F.col("total_count").cast("double") / F.col("turn_count")))


def finishing_places(results: DataFrame, cte: DataFrame) -> DataFrame:
    """W03 on the stats store: ``results`` has one row per (GameId, Civ) with
    Turn and Score, ``cte`` (GameId, civ, Turn) a row for every turn a civ was
    alive. A civ is dead if its score is 0 or its last turn lies before the
    game's end - 1; the dead fill the bottom places in the order of their last
    turn, the living rank by score, and ties share the mean place."""
    end = results.groupBy("GameId").agg(F.max("Turn").alias("end_turn"))
    seen = cte.groupBy("GameId", F.col("civ").alias("Civ")).agg(F.max("Turn").alias("last_seen"))
    j = results.select("GameId", "Civ", F.col("Score").alias("score")).join(end, "GameId") \
        .join(seen, ["GameId", "Civ"], "left").withColumn("death_turn", F.coalesce("last_seen", F.lit(-1)))
    j = j.withColumn("is_dead", (F.col("score") == 0) | (F.col("death_turn") < F.col("end_turn") - 1))
    return rank.finishing_place(j, "GameId", "Civ", "score", "is_dead", "death_turn", "place") \
        .select("GameId", "Civ", "score", "death_turn", "is_dead", "place")


def winrate_by_window(picks: DataFrame, cgr: DataFrame, window: int = 10) -> DataFrame:
    """P13 + J01: pick counts and win counts per turn bucket."""
    winners = cgr.filter(F.col("victory_type").isNotNull()).select("game_id", "civ")
    j = picks.join(winners.withColumn("won", F.lit(1)), ["game_id", "civ"], "left")
    j = j.withColumn("bucket", F.col("turn") - F.col("turn") % window)
    return j.groupBy("bucket").agg(F.count(F.lit(1)).alias("picks"),
                                   F.sum(F.coalesce("won", F.lit(0))).alias("wins"))


def wonder_first_builder(buildings: DataFrame) -> DataFrame:
    """First owner of each world wonder per game = builder (earliest
    turn, then civ name)."""
    return rank.first_per_group(buildings, ["GameId", "Building"], ["Turn", "Civ"],
                                ["Civ", "Turn"], "")


def keep_valid_games(df: DataFrame, results: DataFrame, min_turn: int = 100) -> DataFrame:
    """Keep games whose max turn reaches ``min_turn``."""
    ok = results.groupBy("GameId").agg(F.max("Turn").alias("t")).filter(F.col("t") >= min_turn)
    return keyed.semi(df, ok, ["GameId"])


def drop_left_censored(df: DataFrame, key: list[str], turn: str = "Turn", max_first: int = 2):
    """Q03: drop entities whose first logged turn is after ``max_first``."""
    first = df.groupBy(*key).agg(F.min(turn).alias("__t0")).filter(F.col("__t0") <= max_first)
    return keyed.semi(df, first, key)


# --- economy (S09–S11, J03, J04, J08, A09, A12–A16, A24) ----------------------

CORRECTED_YIELDS = ["food", "production", "gold", "science", "culture"]


def city_economy_with_era(city: DataFrame, cte: DataFrame) -> DataFrame:
    """Inner join on all three keys (game, civ, turn)."""
    return city.join(cte, ["game_id", "civ", "turn"], "inner")


def civ_economy_corrected(civ: DataFrame, running: DataFrame, cte: DataFrame) -> DataFrame:
    """J04 + W05 correction: economy ⋈ instant-yield running totals ⋈ era
    on (game, civ, turn); each logged yield minus rt / (turn + 1)."""
    j = civ.join(running, ["game_id", "civ", "turn"], "inner").join(
        cte, ["game_id", "civ", "turn"], "inner")
    fixes = {y: F.col(y) - F.col(f"rt_{y}") / (F.col("turn") + 1) for y in CORRECTED_YIELDS}
    return j.withColumns(fixes).drop(*[f"rt_{y}" for y in CORRECTED_YIELDS])


def era_averages(civ_corr: DataFrame, measures: list[str]) -> DataFrame:
    """Averages of a generated list of measures per era."""
    return civ_corr.groupBy("era").agg(*[F.avg(m).alias(f"avg_{m}") for m in measures])


def city_to_civ_turn(city: DataFrame) -> DataFrame:
    """A13 (cities): sum the city rows to (game, civ, turn)."""
    return city.groupBy("game_id", "civ", "turn").agg(
        *[F.sum(y).alias(f"cities_{y}") for y in CORRECTED_YIELDS], F.count(F.lit(1)).alias("cities"))


def reasons_to_civ_turn(yields: DataFrame, prefix: str) -> DataFrame:
    """A13 (reasons) + B9: sum yield rows over reasons to (game, civ, turn)
    before any join, so several reasons per turn cannot multiply sums.
    Yield names match case-insensitively ("Food" in one log, "FOOD" in
    another)."""
    y = yields.withColumn("__yl", F.lower("yield"))
    wide = reshape.pivot_agg(y, ["game_id", "civ", "turn"], "__yl", CORRECTED_YIELDS,
                             F.sum("value"), "__r_", fill=0)
    return wide.select("game_id", "civ", "turn",
                       *[F.col(f"__r_{c}").alias(f"{prefix}{c}") for c in CORRECTED_YIELDS])


def _handicap_turns(hy: DataFrame) -> DataFrame:
    """Handicap rows (several reasons per turn) summed per (game, civ,
    turn) before any join; only the yields the log carries (others 0)."""
    keys = ["game_id", "civ", "turn"]
    have = {"gold", "food", "culture", "science"}
    return hy.groupBy(*keys).agg(*[(F.sum(f"hy_{y}") if y in have else F.lit(0.0)).alias(f"hy_{y}")
                                   for y in CORRECTED_YIELDS])


def _city_sources(j: DataFrame) -> DataFrame:
    """City gold is what the civ row logs for its cities; the other yields
    are the sums of the city rows."""
    return j.withColumn("cities_gold", F.col("city_gold")) if "city_gold" in j.columns else j


def economy_sources(civ_corr: DataFrame, city: DataFrame, instant: DataFrame,
                    handicap: DataFrame) -> DataFrame:
    """J08 + A15: three left joins of pre-aggregated sources onto the civ
    economy per (game, civ, turn); per era and yield: city_, misc_ (= civ −
    city), iy_, hy_ (0 for production, which has no handicap) and total_
    averages."""
    keys = ["game_id", "civ", "turn"]
    j = (civ_corr.join(city_to_civ_turn(city), keys, "left")
         .join(reasons_to_civ_turn(instant, "iy_"), keys, "left")
         .join(_handicap_turns(handicap), keys, "left"))
    j = _city_sources(j.na.fill(0))
    aggs = []
    for y in CORRECTED_YIELDS:
        aggs += [F.avg(f"cities_{y}").alias(f"city_{y}"),
                 F.avg(F.col(y) - F.col(f"cities_{y}")).alias(f"misc_{y}"),
                 F.avg(f"iy_{y}").alias(f"iy_{y}"),
                 F.avg(f"hy_{y}").alias(f"hy_{y}"),
                 F.avg(F.col(y) + F.col(f"iy_{y}") + F.col(f"hy_{y}")).alias(f"total_{y}")]
    return j.groupBy("era").agg(*aggs)


def civ_economy_by_era(civ_corr: DataFrame, instant: DataFrame, handicap: DataFrame) -> DataFrame:
    """A16 + J08: per (game, civ, era): turns in the era, averages of the
    counts (cities, population, policies, workers, happiness, trade units),
    maintenance totals, and yield totals = logged (corrected) + instant +
    handicap. Instant and handicap rows are summed per (game, civ, turn)
    before the left joins (B9), so several reasons per turn never multiply."""
    keys = ["game_id", "civ", "turn"]
    iy = instant_yield_pivot(instant).groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in ("iy_food", "iy_production", "iy_gold", "iy_science",
                                      "iy_culture", "iy_faith", "iy_tourism",
                                      "iy_golden_age_points", "iy_great_general_points",
                                      "iy_great_admiral_points")])
    hy = handicap.groupBy(*keys).agg(*[F.sum(f"hy_{y}").alias(f"hy_{y}")
                                       for y in ("food", "gold", "science", "culture")])
    j = civ_corr.join(iy, keys, "left").join(hy, keys, "left").na.fill(0)
    avg = ["city_count", "population", "policies_acquired", "workers", "happiness",
           "trade_units_active"]
    tot = {"food_total": F.col("food") + F.col("iy_food") + F.col("hy_food"),
           "production_total": F.col("production") + F.col("iy_production"),
           "gold_total": F.col("gold") + F.col("iy_gold") + F.col("hy_gold"),
           "science_total": F.col("science") + F.col("iy_science") + F.col("hy_science"),
           "culture_total": F.col("culture") + F.col("iy_culture") + F.col("hy_culture"),
           "faith_total": F.col("faith") + F.col("iy_faith"),
           "tourism_total": F.col("tourism") + F.col("iy_tourism"),
           "golden_age_points_total": F.col("golden_age_points") + F.col("iy_golden_age_points"),
           "great_general_points_total": F.col("iy_great_general_points"),
           "great_admiral_points_total": F.col("iy_great_admiral_points")}
    return j.groupBy("game_id", "civ", "era").agg(
        F.count(F.lit(1)).alias("turns_in_era"),
        *[F.avg(c).alias(f"{c}_avg") for c in avg],
        *[F.sum(c).alias(f"{c}_total") for c in ("unit_maintenance", "building_maintenance",
                                                 "improvement_maintenance")],
        *[F.sum(e).alias(n) for n, e in tot.items()])


def handicap_trigger_stats(hy: DataFrame, cte: DataFrame) -> DataFrame:
    """Per (yield, era, trigger) over rows where that yield is > 0: the
    mean bonus and times triggered per civ-game (players counted, B8).
    ``hy``: the wide handicap table."""
    from turnlens.sources.logs import handicap_long
    long = handicap_long(hy).filter(F.col("value") > 0)
    j = long.join(cte, ["game_id", "civ", "turn"], "inner")
    n_pairs = cte.select(F.count_distinct("game_id", "civ")).scalar()
    return j.groupBy("yield", "era", F.col("reason").alias("trigger")).agg(
        F.avg("value").alias("avg_hy"),
        (F.count(F.lit(1)) / n_pairs).alias("avg_times_triggered"))


def units_and_map_by_era(map_state: DataFrame, own: DataFrame, cte: DataFrame) -> DataFrame:
    """A24 (+ B5): per (game, civ, era) the mean over the era's turns of the
    civ's share of all units on the map, and of its tile and city shares as
    effective owner (``own``: see :func:`ownership`); civs with both only. The
    joins to the era spine use (game, civ, turn)."""
    keys = ["game_id", "civ", "turn"]
    units = map_state.filter(F.col("unit_owner_civ") != "").groupBy(
        "game_id", F.col("unit_owner_civ").alias("civ"), "turn").agg(
        F.count_if(F.col("unit") != "").alias("units"))
    whole = units.groupBy("game_id", "turn").agg(F.sum("units").alias("all_units"))
    share = F.col("units") / F.nullif(F.col("all_units"), F.lit(0))
    by_units = (units.join(whole, ["game_id", "turn"]).join(cte, keys, "inner")
                .groupBy("game_id", "civ", "era").agg(F.avg(share).alias("units_owned_percentage_avg")))
    plots = own.withColumnRenamed("effective_owner", "civ").join(cte, keys, "inner")
    by_plots = plots.groupBy("game_id", "civ", "era").agg(
        F.avg("tiles_owned_percentage").alias("tiles_owned_percentage_avg"),
        F.avg("cities_owned_percentage").alias("cities_owned_percentage_avg"))
    return by_plots.join(by_units, ["game_id", "civ", "era"], "inner")


def gold_breakdown_by_era(gold: DataFrame, running: DataFrame, cte: DataFrame) -> DataFrame:
    """Era averages of the gold income/expense columns; city gold is
    corrected by the instant-gold running total (rt / (turn + 1))."""
    keys = ["game_id", "civ", "turn"]
    j = gold.join(running.select(*keys, "rt_gold"), keys, "inner").join(cte, keys, "inner")
    cols = [c for c in gold.columns if c not in ("game_id", "civ", "turn", "cities")]
    return j.groupBy("era").agg(
        F.avg(F.col("cities") - F.col("rt_gold") / (F.col("turn") + 1)).alias("cities"),
        *[F.avg(c).alias(c) for c in cols])


def branch_stats(branches: DataFrame, results: DataFrame) -> DataFrame:
    """Branch openings with the game's victory type when the opener
    won (null otherwise)."""
    win = results.select("game_id", F.col("victory_civ").alias("civ"), "victory_type")
    return branches.join(win, ["game_id", "civ"], "left").select(
        "game_id", "branch", "civ", "turn", "victory_type")


def yield_sources_by_turn(civ_corr: DataFrame, city: DataFrame, instant: DataFrame,
                          handicap: DataFrame) -> DataFrame:
    """A13 + A14 + J08: per (game, civ, turn) one column per yield × source
    (civ_, city_, iy_, hy_), sources pre-aggregated (B9)."""
    keys = ["game_id", "civ", "turn"]
    j = (civ_corr.join(city_to_civ_turn(city), keys, "left")
         .join(reasons_to_civ_turn(instant, "iy_"), keys, "left")
         .join(_handicap_turns(handicap), keys, "left")).na.fill(0)
    j = _city_sources(j)
    cols = []
    for y in CORRECTED_YIELDS:
        cols += [F.col(y).alias(f"civ_{y}"), F.col(f"cities_{y}").alias(f"city_{y}"),
                 F.col(f"iy_{y}").alias(f"iy_{y}"), F.col(f"hy_{y}").alias(f"hy_{y}")]
    return j.select(*keys, "era", *cols)


def authority_results(results: DataFrame, authority: DataFrame) -> DataFrame:
    """One row per game (and authority crossing): with a crossing, the
    game ends at the crossing's turn, every victory flag loses that win (never
    below zero) and the authority flag gains it; conquest counts as authority,
    so the domination flag is merged into it and dropped."""
    a = authority.select("game_id", F.col("owner_nation").alias("authority_victor"),
                         F.col("turn").alias("__turn"), F.col("pseudo_victory").alias("__av"))
    j = results.join(a, "game_id", "left").withColumn("__av", F.coalesce("__av", F.lit(0)))
    left = {f: F.greatest(F.coalesce(f, F.lit(0)) - F.col("__av"), F.lit(0)) for f in VICTORY_FLAGS}
    conquest = "domination_victory" if "domination_victory" in VICTORY_FLAGS else VICTORY_FLAGS[2]
    return j.withColumns({**left, "turn": F.coalesce("__turn", "turn")}).withColumn(
        "authority_victory", F.col("__av") + F.col(conquest)).drop("__turn", "__av", conquest)


def reclassify_authority(results: DataFrame, authority: DataFrame,
                         label: str = "Authority") -> DataFrame:
    """A game's first authority crossing (earliest turn, then
    owner name) counts only if it happens by the recorded end turn; then the
    recorded winner loses one win of its victory type (never below zero) and
    the crossing civ gains one ``label`` win. Output: wins per (civ, type)."""
    first = authority.groupBy("game_id").agg(
        F.min(F.struct("turn", "effective_owner")).alias("__c"))
    j = results.join(first, "game_id", "left")
    moved = F.col("__c").isNotNull() & (F.col("__c.turn") <= F.col("turn"))
    base = results.filter(F.col("victory_civ").isNotNull()).select(
        F.col("victory_civ").alias("civ"), "victory_type", F.lit(1).alias("d"))
    minus = j.filter(moved & F.col("victory_civ").isNotNull()).select(
        F.col("victory_civ").alias("civ"), "victory_type", F.lit(-1).alias("d"))
    plus = j.filter(moved).select(F.col("__c.effective_owner").alias("civ"),
                                  F.lit(label).alias("victory_type"), F.lit(1).alias("d"))
    u = base.unionByName(minus).unionByName(plus)
    return (u.groupBy("civ", "victory_type").agg(F.sum("d").alias("__n"))
            .select("civ", "victory_type", F.greatest("__n", F.lit(0)).alias("wins")))
