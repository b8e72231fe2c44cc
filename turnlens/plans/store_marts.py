"""Summary marts over the long-term stats store (FIXTURES §3 tables).

Fact tables here reach hundreds of millions of rows; every mart reduces them
with partial aggregates before any join, and joins only aggregated sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from turnlens.functions.columns import bucket_start, fixed_point, loose_bool
from turnlens.operators import keyed, reshape
from turnlens.sources.dims import ERA_NAMES

YIELD_VALUE_COLS = ["BaseYields", "BonusYields", "InstantYields"]


def building_yield_inputs(overview: DataFrame, yields: DataFrame, instant: DataFrame) -> DataFrame:
    """A29 + J12: one row per (Era, Building, Yield) with the three yield
    sums (×100 fixed point scaled once after the sum) and the three
    denominators: copy-turns (Σ Count), civ-games and civ-turns present.
    The key union of the two yield facts is a native full outer join."""
    keys = ["Era", "Building"]
    turns = overview.groupBy(*keys).agg(F.sum("Count").cast("bigint").alias("BuildingTurns"),
                                        F.countDistinct("GameId", "Civ").alias("CivGames"),
                                        F.countDistinct("GameId", "Civ", "Turn")
                                        .alias("CivTurnsPresent"))
    bb = yields.groupBy("Era", "Building", "Yield").agg(
        (F.sum("BaseYieldTimes100") / 100.0).alias("BaseYields"),
        (F.sum("BonusYieldTimes100") / 100.0).alias("BonusYields"))
    iy = instant.groupBy("Era", "Building", "Yield").agg(
        (F.sum("YieldTimes100") / 100.0).alias("InstantYields"))
    k = ["Era", "Building", "Yield"]
    merged = bb.join(iy, k, "full").na.fill(0.0, YIELD_VALUE_COLS)
    return merged.join(turns, keys, "left")


def building_yield_summaries(overview: DataFrame, yields: DataFrame,
                             instant: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(era_totals, turn_average). Turn average = Σyield / ΣCount (per
    copy per turn), N = ΣCount. Era total = per-copy-per-turn × civ-turns
    present / civ-games, N = civ-games. Missing or zero denominators → 0."""
    m = building_yield_inputs(overview, yields, instant)
    per = {c: F.col(c) / F.nullif(F.col("BuildingTurns"), F.lit(0)) for c in YIELD_VALUE_COLS}
    avg_present = F.col("CivTurnsPresent") / F.nullif(F.col("CivGames"), F.lit(0))
    base = ["Era", "Building", "Yield"]
    turn_avg = m.select(*base, *[F.coalesce(e, F.lit(0.0)).alias(c) for c, e in per.items()],
                        F.coalesce("BuildingTurns", F.lit(0)).cast("bigint").alias("N"))
    era_tot = m.select(*base, *[F.coalesce(e * avg_present, F.lit(0.0)).alias(c)
                                for c, e in per.items()],
                       F.coalesce("CivGames", F.lit(0)).cast("bigint").alias("N"))
    return era_tot, turn_avg


def belief_yield_summary(rby: DataFrame, cte: DataFrame, by: str = "era", width: int = 10,
                         start: int = 0, end: int | None = None) -> DataFrame:
    """A30 + J13 + P13 + P15 + P23: three-stage mean of belief yields.
    Slice = era, or turn bucket ``t − t % width`` for start ≤ t < end (no end: all turns from start).
    Stage 1+2 (one GROUP BY): player slice total = Σ YieldTimes100 / 100 per
    (game, civ, slice, belief, type, owner, yield). Per turn = total / the
    player's distinct turns in the slice (inner join to the era spine).
    Stage 3: mean over the players present, and N."""
    if by == "era":
        r_slice, e_slice = F.col("Era"), F.col("era")
        r, e = rby, cte
    else:
        inside = F.col("Turn") >= start
        if end is not None:
            inside = inside & (F.col("Turn") < end)
        r, e = rby.filter(inside), cte.filter(inside)
        r_slice, e_slice = bucket_start("Turn", width), bucket_start("Turn", width)
    slice_turns = e.groupBy(F.col("GameId"), F.col("civ").alias("Civ"), e_slice.alias("Slice")) \
        .agg(F.countDistinct("Turn").alias("SliceTurns"))
    player = (r.select("GameId", "Civ", r_slice.alias("Slice"), "Belief", "BeliefType",
                       loose_bool("IsReligionOwner").alias("IsReligionOwner"), "Yield",
                       fixed_point("YieldTimes100").alias("v"))
              .groupBy("GameId", "Civ", "Slice", "Belief", "BeliefType", "IsReligionOwner", "Yield")
              .agg(F.sum("v").alias("PlayerSliceTotal")))
    per = (player.join(slice_turns, ["GameId", "Civ", "Slice"], "inner")
           .filter(F.col("SliceTurns") > 0)
           .withColumn("PlayerPerTurn", F.col("PlayerSliceTotal") / F.col("SliceTurns")))
    out_slice = "Era" if by == "era" else "Bucket"
    return per.groupBy(F.col("Slice").alias(out_slice), "BeliefType", "Belief", "Yield",
                       "IsReligionOwner").agg(
        F.avg("PlayerSliceTotal").alias("SliceTotalAvg"),
        F.avg("PlayerPerTurn").alias("PerTurnAvg"),
        F.count(F.lit(1)).alias("N"))


def belief_owner_pivot(summary: DataFrame, index: list[str], value: str = "PerTurnAvg") -> DataFrame:
    """Owner flag 0/1 pivoted into value and N columns with defaults."""
    return reshape.owner_flag_pivot(summary, index, "IsReligionOwner", value, "N",
                                    value_default=0.0, count_default=0)


def era_label(df: DataFrame, era_col: str = "Era") -> DataFrame:
    """P10 + B14: 0-based store era code → name; unmapped codes dropped."""
    spark = df.sparkSession
    dim = spark.createDataFrame([(i, n) for i, n in enumerate(ERA_NAMES)],
                                f"{era_col} int, EraName string")
    return keyed.lookup_label(df, dim, era_col, era_col, "EraName")


def instant_yield_summary(iy: DataFrame, cte: DataFrame) -> DataFrame:
    """Per (era, type, yield): AvgYieldAmount = Σ/N_era,
    AvgTriggerAmount = Σ/firings, AvgTimesTriggered = firings/N_era, with
    N_era the distinct (game, civ) present in the era (era from the spine)."""
    j = iy.join(cte.select("GameId", F.col("civ").alias("Civ"), "Turn", F.col("era").alias("Era")),
                ["GameId", "Civ", "Turn"], "inner")
    agg = j.groupBy("Era", "Type", "Yield").agg((F.sum("YieldTimes100") / 100.0).alias("TotalYield"),
                                                F.count(F.lit(1)).alias("TriggerCount"))
    den = cte.groupBy(F.col("era").alias("Era")).agg(F.countDistinct("GameId", "civ").alias("NEra"))
    out = agg.join(den, "Era", "left").filter(F.coalesce("NEra", F.lit(0)) > 0)
    out = out.select("Era", "Type", "Yield",
                     (F.col("TotalYield") / F.col("NEra")).alias("AvgYieldAmount"),
                     (F.col("TotalYield") / F.col("TriggerCount")).alias("AvgTriggerAmount"),
                     (F.col("TriggerCount") / F.col("NEra")).alias("AvgTimesTriggered"))
    return era_label(out)


def unit_averages(units: DataFrame, cte: DataFrame) -> DataFrame:
    """Average count per snapshot turn of each (civ, era, unit); the
    denominator counts only turns where the civ has a unit row (unlike A23)."""
    j = units.select("GameId", "Turn", F.col("owner").alias("Civ"), F.col("unitName").alias("Unit")) \
        .join(cte.select("GameId", "Turn", F.col("civ").alias("Civ"), F.col("era").alias("Era")),
              ["GameId", "Turn", "Civ"], "inner")
    counts = j.groupBy("Civ", "Era", "Unit").agg(F.count(F.lit(1)).alias("TotalCount"))
    turns = j.groupBy("Civ", "Era").agg(F.countDistinct("GameId", "Turn").alias("CivTurns"))
    m = counts.join(turns, ["Civ", "Era"], "left")
    return m.withColumn("AvgCount", F.col("TotalCount") / F.col("CivTurns")).withColumn(
        "N", F.coalesce("CivTurns", F.lit(0)).cast("bigint"))


def game_rollup(results: DataFrame, min_turn: int = 100) -> DataFrame:
    """A34 + P11 + P17: per game: max turn, distinct civs, winner (the row
    with a non-empty victory type; smallest civ name when several, to be
    deterministic), valid = max turn ≥ ``min_turn``."""
    vt = F.when(F.trim(F.coalesce(F.col("VictoryType").cast("string"), F.lit(""))).isin("", "nan"),
                F.lit(None)).otherwise(F.trim("VictoryType"))
    r = results.withColumn("__vt", vt)
    winner = F.min_by(F.struct("Civ", "__vt"), F.when(F.col("__vt").isNotNull(), F.col("Civ")))
    g = r.groupBy("GameId").agg(F.max("Turn").alias("MaxTurn"),
                                F.countDistinct("Civ").alias("Civs"), winner.alias("__w"))
    return g.select("GameId", "MaxTurn", "Civs", F.col("__w.Civ").alias("WinnerCiv"),
                    F.col("__w.__vt").alias("VictoryType"),
                    (F.col("MaxTurn") >= min_turn).alias("Valid"))


def end_state_ownership(plots: DataFrame, rollup: DataFrame) -> DataFrame:
    """Share of owned plots and cities per (game, civ) at the game's
    end turn (semi join to the end-turn rows first, then totals)."""
    ends = rollup.select("GameId", F.col("MaxTurn").alias("Turn"))
    at_end = plots.join(ends, ["GameId", "Turn"], "left_semi").filter(F.col("owner").isNotNull())
    per = at_end.groupBy("GameId", F.col("owner").alias("Civ")).agg(
        F.count(F.lit(1)).alias("Plots"),
        F.count(F.when(F.coalesce(F.col("cityName"), F.lit("")) != "", 1)).alias("Cities"))
    tot = per.groupBy("GameId").agg(F.sum("Plots").alias("__tp"), F.sum("Cities").alias("__tc"))
    return (per.join(tot, "GameId")
            .withColumn("PlotShare", F.col("Plots") / F.col("__tp"))
            .withColumn("CityShare", F.try_divide(F.col("Cities"), F.nullif("__tc", F.lit(0))))
            .drop("__tp", "__tc"))


def build_store_marts(spark, store: str, out_root: str, source_version: str,
                      force: bool = False, bucket_width: int = 10) -> dict[str, DataFrame]:
    """Entry point of the summary marts: each mart is rebuilt only when the
    freshness manifest says it is stale (K06 / K07: source version, parameter
    fingerprint, required columns) and is written as Parquet."""
    from turnlens.sinks.store import ensure_output

    def t(name):
        return spark.read.parquet(f"{store.rstrip('/')}/{name}")

    manifest = f"{out_root.rstrip('/')}/_manifest"
    cte = t("civ_turn_era")
    builders = {
        "building_yields_turn_average": (lambda: building_yield_summaries(
            t("BuildingsOverview"), t("BuildingYields"), t("BuildingInstantYields"))[1], ""),
        "building_yields_era_totals": (lambda: building_yield_summaries(
            t("BuildingsOverview"), t("BuildingYields"), t("BuildingInstantYields"))[0], ""),
        "religion_by_era": (lambda: belief_yield_summary(t("ReligionBeliefYields"), cte), ""),
        "religion_by_bucket": (lambda: belief_yield_summary(
            t("ReligionBeliefYields"), cte, by="bucket", width=bucket_width),
            f"width={bucket_width}"),
        "instant_yields": (lambda: instant_yield_summary(t("InstantYields"), cte), ""),
        "units": (lambda: unit_averages(t("MapUnitsState"), cte), ""),
        "games": (lambda: game_rollup(t("GameResult")), ""),
    }
    out = {}
    for name, (builder, fingerprint) in builders.items():
        out[name] = ensure_output(spark, manifest, f"{out_root.rstrip('/')}/{name}", name,
                                  source_version, builder, force=force, fingerprint=fingerprint)
    return out


# --- wonders (W04, Q03, P11, A39, O05, P29, A54) -------------------------------

def wonder_builds(overview: DataFrame, wonders: DataFrame, valid_games: DataFrame,
                  max_log_start: int = 2) -> DataFrame:
    """W04 + Q03 + P11: the builder of each world wonder per game is its first
    owner (earliest turn, then civ name); games whose building log starts
    after ``max_log_start`` (left-censored) or that are not valid are dropped
    whole. ``wonders``: one column ``Building``; ``valid_games``: ``GameId``."""
    start = overview.groupBy("GameId").agg(F.min("Turn").alias("FirstLoggedTurn"))
    w = overview.join(keyed.broadcast_if_small(wonders.select("Building").distinct()),
                      "Building", "left_semi")
    first = w.groupBy("GameId", "Civ", "Building").agg(F.min("Turn").alias("Turn"))
    builder = first.groupBy("GameId", "Building").agg(
        F.min(F.struct("Turn", "Civ")).alias("__b"))
    out = builder.select("GameId", F.col("__b.Civ").alias("Civ"), "Building",
                         F.col("__b.Turn").alias("Turn")).join(start, "GameId")
    out = out.filter(F.col("FirstLoggedTurn") <= max_log_start)
    return out.join(valid_games.select("GameId").distinct(), "GameId", "left_semi")


def game_civ_branches(results: DataFrame, choices: DataFrame, branch_order: list[str],
                      games: DataFrame, sep: str = "|") -> DataFrame:
    """A39 + O05: every (game, civ) of the kept games with the branches it
    opened, packed in the fixed branch order (not pick order); '' if none."""
    pairs = (results.select("GameId", "Civ").distinct()
             .join(games.select("GameId").distinct(), "GameId", "left_semi"))
    order = F.array(*[F.lit(b) for b in branch_order])
    opens = (choices.filter(F.col("item").isin(*branch_order))
             .select(F.col("game_id").alias("GameId"), F.col("civ").alias("Civ"), "item")
             .distinct().withColumn("__pos", F.array_position(order, F.col("item"))))
    packed = opens.groupBy("GameId", "Civ").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__pos", "item"))),
                                 lambda s: s["item"]), sep).alias("branches"))
    return pairs.join(packed, ["GameId", "Civ"], "left").na.fill("", ["branches"])


def wonder_rates(builds: DataFrame, game_civs: DataFrame, wonder_era: DataFrame,
                 cohort: list[str] | None = None, sep: str = "|") -> DataFrame:
    """P29 + A54: wonders per game played, per (civ, era), over the civ-games
    of a cohort (civ-games that opened any of ``cohort`` branches; empty or
    None = all). The denominator is every cohort game the civ played, built
    or not."""
    gc = game_civs
    if cohort:
        import re
        gc = gc.filter(F.arrays_overlap(F.split("branches", re.escape(sep)),
                                        F.array(*[F.lit(b) for b in cohort])))
    played = gc.groupBy("Civ").agg(F.count(F.lit(1)).alias("games"))
    b = (builds.join(gc.select("GameId", "Civ"), ["GameId", "Civ"], "left_semi")
         .join(keyed.broadcast_if_small(wonder_era.select("Building", "Era")), "Building", "inner"))
    per = b.groupBy("Civ", "Era").agg(F.count(F.lit(1)).alias("built"))
    return per.join(played, "Civ").withColumn("per_game", F.col("built") / F.col("games"))


# --- religion and policy performance (A36, A37, P18, M01, A38) -----------------

# Milestone types and their labels; report section per belief category;
# follower picks split by the moment they were offered; victory types shown
# in the policy report (fixed values).
ATTAINMENT_EVENTS = [("pantheon", "Pantheon"), ("religion_founded", "Religion Founded"),
                     ("religion_enhanced", "Religion Enhanced"),
                     ("religion_reformed", "Religion Reformed")]
SECTION_BY_CATEGORY = {"PANTHEON": "pantheon", "REFORMATION": "reformation",
                       "FOUNDER": "founder", "ENHANCER": "enhancer"}
FOLLOWER_SECTION_BY_TYPE = {"religion_founded": "follower_found",
                            "religion_enhanced": "follower_enhance"}
SHOWN_VICTORY_TYPES = ["Cultural", "Science", "Domination", "Diplomatic"]


def attainment_samples(choices: DataFrame) -> DataFrame:
    """One turn per (game, civ, milestone): a founding's two belief rows
    collapse to one attainment."""
    return choices.select("game_id", "civ", "type", "turn").distinct().select("type", "turn")


def _event_label(c):
    from turnlens.functions.columns import recode
    return recode(c, dict(ATTAINMENT_EVENTS))


def attainment_kde(choices: DataFrame, n_grid: int = 300) -> DataFrame:
    """Gaussian KDE of attainment turns per milestone on a shared grid
    0..max turn (Scott bandwidth; milestones with n < 2 or no spread skipped)."""
    from turnlens.operators.stats import kde_grid
    s = attainment_samples(choices).withColumn("turn", F.col("turn").cast("double"))
    k = kde_grid(s, "type", "turn", n_grid=n_grid, lo=0.0)
    return k.select(_event_label("type").alias("event_type"), "x", "density").filter(
        F.col("event_type").isNotNull())


def attainment_moments(choices: DataFrame) -> DataFrame:
    """Mean, median and n of attainment turns per milestone (4 dp)."""
    from turnlens.operators.aggregate import grouped_exact_quantiles
    s = attainment_samples(choices)
    m = s.groupBy("type").agg(F.round(F.avg("turn"), 4).alias("mean"),
                              F.count(F.lit(1)).alias("n"))
    med = grouped_exact_quantiles(s, ["type"], "turn", [0.5], "__m")
    out = m.join(med, "type").select(_event_label("type").alias("event_type"), "mean",
                                     F.round("__m_0", 4).alias("median"), "n")
    return out.filter(F.col("event_type").isNotNull())


def religion_pick_performance(choices: DataFrame, results: DataFrame) -> DataFrame:
    """A37 + P18 + J01: per (section, belief): picks, wins, losses, mean pick
    turn. The belief's category leads the section; follower picks split by
    pick type; unknown categories drop."""
    from turnlens.functions.columns import recode
    winners = (results.filter(F.col("victory_civ").isNotNull())
               .select("game_id", F.col("victory_civ").alias("civ")).distinct()
               .withColumn("won", F.lit(1)))
    j = choices.join(winners, ["game_id", "civ"], "left").na.fill(0, ["won"])
    cat = F.upper(F.trim(F.coalesce(F.col("belief_type").cast("string"), F.lit(""))))
    section = F.when(cat == "FOLLOWER", recode("type", FOLLOWER_SECTION_BY_TYPE)).otherwise(
        recode(cat, SECTION_BY_CATEGORY))
    j = j.withColumn("section", section).filter(F.col("section").isNotNull())
    out = j.groupBy("section", "belief").agg(F.count(F.lit(1)).alias("chosen_count"),
                                            F.sum("won").alias("wins"),
                                            F.round(F.avg("turn"), 4).alias("avg_turn"))
    return out.withColumn("losses", F.col("chosen_count") - F.col("wins")).select(
        "section", "belief", "chosen_count", "wins", "losses", "avg_turn")


def policy_opens_and_wins(choices: DataFrame, results: DataFrame,
                          branch_order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Per (civ, branch) openings, and per (branch, victory type) the
    openings whose civ won that game (shown victory types only), over valid
    games only."""
    valid = results.select("game_id").distinct()
    opens = (choices.filter(F.col("item").isin(*branch_order))
             .select("game_id", "civ", F.col("item").alias("branch"))
             .join(valid, "game_id", "left_semi"))
    by_civ = opens.groupBy("civ", "branch").agg(F.count(F.lit(1)).alias("opens"))
    winners = (results.filter(F.col("victory_civ").isNotNull())
               .groupBy("game_id").agg(F.min(F.struct("victory_civ", "victory_type")).alias("w"))
               .select("game_id", F.col("w.victory_civ").alias("civ"),
                       F.col("w.victory_type").alias("victory_type")))
    won = opens.join(winners, ["game_id", "civ"], "inner").filter(
        F.col("victory_type").isin(*SHOWN_VICTORY_TYPES))
    wins = won.groupBy("branch", "victory_type").agg(F.count(F.lit(1)).alias("wins"))
    return by_civ, wins
