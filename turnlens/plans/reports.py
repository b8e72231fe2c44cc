"""Report tables over the stats store: the summary marts with era names, the
report's columns and row order (P10, A29–A34, A03, W03, W04, A36–A39, A54).

:func:`build_reports` is the entry point: every report is rebuilt only when its
manifest row is stale, must have one row per its key, and is also written as
CSV. Row counts are taken while writing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from turnlens.plans import marts, store_marts as sm
from turnlens.session import path_exists
from turnlens.sinks.store import ensure_output, write_csv_sized
from turnlens.sources.dims import ERA_NAMES

# Victory names in the store and in column names, in report order (fixed values).
VICTORIES = [("culture", "Cultural"), ("diplomatic", "Diplomatic"), ("domination", "Domination"),
             ("science", "Science"), ("time", "Time")]


def with_era_names(df: DataFrame, columns: Sequence[str], order: Sequence[str], era: str = "Era") -> DataFrame:
    """P10: 0-based era codes replaced by their names, rows of other codes
    dropped; the report's columns, in the report's row order (small results)."""
    names = F.array(*[F.lit(n) for n in ERA_NAMES])
    code = F.col(era).cast("int")
    named = df.filter(code.between(0, len(ERA_NAMES) - 1)).withColumn(era, F.element_at(names, code + 1))
    return named.select(*columns).orderBy(*order)


def ownership_shares(plots: DataFrame, rollup: DataFrame) -> DataFrame:
    return sm.end_state_ownership(plots, rollup).select(
        "GameId", "Civ", F.col("PlotShare").alias("tiles_owned_percentage"),
        F.col("CityShare").alias("cities_owned_percentage"))


def power_ranking(results: DataFrame, cte: DataFrame, plots: DataFrame | None, min_turn: int = 100) -> DataFrame:
    """A03 + W03 + A35: per civ over the valid games: games, win rate, wins per
    type, each type's share of the civ's wins, mean map shares at the end,
    mean score and mean finishing place (over all games' places)."""
    rollup = sm.game_rollup(results, min_turn)
    r = results.join(rollup.filter("Valid").select("GameId"), "GameId", "left_semi")
    won = F.trim(F.coalesce(F.col("VictoryType").cast("string"), F.lit("")))
    r = r.withColumn("__type", F.when(~won.isin("", "nan"), won)).withColumn(
        "__won", F.col("__type").isNotNull().cast("int"))
    places = marts.finishing_places(results, cte).select("GameId", "Civ", "place")
    j = r.join(places, ["GameId", "Civ"], "left")
    if plots is not None:
        j = j.join(ownership_shares(plots, rollup), ["GameId", "Civ"], "left")
    else:
        j = j.withColumns({c: F.lit(None).cast("double")
                           for c in ("tiles_owned_percentage", "cities_owned_percentage")})
    flag = lambda label: F.when(F.col("__won") == 1, (F.col("__type") == label).cast("int"))
    return j.groupBy(F.col("Civ").alias("civ")).agg(
        F.count(F.lit(1)).alias("count_games"), F.avg("__won").alias("winrate"),
        *[F.coalesce(F.sum(flag(label)), F.lit(0)).alias(f"{stem}_victories") for stem, label in VICTORIES],
        *[F.avg(flag(label)).alias(f"pct_{stem}_victories") for stem, label in VICTORIES],
        F.avg("tiles_owned_percentage").alias("avg_tiles_owned_percentage"),
        F.avg("cities_owned_percentage").alias("avg_cities_owned_percentage"),
        F.avg("Score").alias("avg_score"), F.avg("place").alias("avg_rank_at_game_end")).orderBy("civ")


def religion_yields(summary: DataFrame, slice_col: str) -> DataFrame:
    """A30 + A31 as reported: owner and follower values and counts."""
    wide = sm.belief_owner_pivot(summary, [slice_col, "BeliefType", "Belief", "Yield"]).withColumnsRenamed(
        {"PerTurnAvg_1": "YieldTotalForOwner", "PerTurnAvg_0": "YieldTotalForFollower",
         "N_1": "NOwner", "N_0": "NFollower"})
    columns = [slice_col, "BeliefType", "Belief", "Yield", "YieldTotalForOwner", "YieldTotalForFollower",
               "NOwner", "NFollower"]
    order = ["BeliefType", "Belief", "Yield", slice_col]
    return with_era_names(wide, columns, order) if slice_col == "Era" else wide.select(*columns).orderBy(*order)


def build_reports(spark: SparkSession, store: str, out_root: str, source_version: str, force: bool = False,
                  bucket_width: int = 10, wonder_eras: DataFrame | None = None,
                  religion_choices: DataFrame | None = None, policy_choices: DataFrame | None = None,
                  log_results: DataFrame | None = None, branch_order: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Every report whose inputs are there: the store's tables, the wonder
    dimension (Building, Era), and the choices and results of the log ETL."""
    store, out_root = store.rstrip("/"), out_root.rstrip("/")

    def has(*names: str) -> bool:
        return all(path_exists(spark, f"{store}/{n}") for n in names)

    def t(name: str) -> DataFrame:
        return spark.read.parquet(f"{store}/{name}")

    cte = (lambda: t("civ_turn_era"))
    builders: dict[str, tuple[Callable[[], DataFrame], str, list[str]]] = {}
    if has("BuildingsOverview", "BuildingYields", "BuildingInstantYields"):
        cols = ["Era", "Building", "Yield", *sm.YIELD_VALUE_COLS, "N"]
        order = ["Yield", "Era", "Building"]
        for name, k in (("building_era_totals", 0), ("building_turn_average", 1)):
            builders[name] = (lambda k=k: with_era_names(sm.building_yield_summaries(
                t("BuildingsOverview"), t("BuildingYields"), t("BuildingInstantYields"))[k], cols, order),
                "", ["Era", "Building", "Yield"])
    if has("ReligionBeliefYields", "civ_turn_era"):
        builders["religion_era"] = (lambda: religion_yields(
            sm.belief_yield_summary(t("ReligionBeliefYields"), cte()), "Era"), "",
            ["Era", "BeliefType", "Belief", "Yield"])
        builders["religion_bucket"] = (lambda: religion_yields(sm.belief_yield_summary(
            t("ReligionBeliefYields"), cte(), by="bucket", width=bucket_width), "Bucket"),
            f"width={bucket_width}", ["Bucket", "BeliefType", "Belief", "Yield"])
    if has("InstantYields", "civ_turn_era"):
        builders["instant_yields"] = (lambda: sm.instant_yield_summary(t("InstantYields"), cte()).select(
            F.col("EraName").alias("Era"), "Type", "Yield", "AvgYieldAmount", "AvgTriggerAmount",
            "AvgTimesTriggered").orderBy("Yield", "Era", "Type"), "", ["Era", "Type", "Yield"])
    if has("MapUnitsState", "civ_turn_era"):
        builders["units"] = (lambda: with_era_names(sm.unit_averages(t("MapUnitsState"), cte()),
                                                    ["Era", "Civ", "Unit", "AvgCount", "N"], ["Civ", "Era", "Unit"]),
                             "", ["Era", "Civ", "Unit"])
    if has("GameResult", "civ_turn_era"):
        plots = (lambda: t("MapPlotsState") if has("MapPlotsState") else None)
        builders["power_ranking"] = (lambda: power_ranking(t("GameResult"), cte(), plots()), "", ["civ"])
    if has("BuildingsOverview", "GameResult") and wonder_eras is not None:
        valid = (lambda: sm.game_rollup(t("GameResult")).filter("Valid").select("GameId"))
        builds = (lambda: sm.wonder_builds(t("BuildingsOverview"), wonder_eras.select("Building"), valid()))
        builders["wonder_builds"] = (lambda: builds().select("GameId", "Civ", "Building", "Turn"), "",
                                     ["GameId", "Building"])
        if policy_choices is not None and branch_order:
            builders["wonder_rates"] = (lambda: sm.wonder_rates(builds(), sm.game_civ_branches(
                t("GameResult"), policy_choices, list(branch_order), valid()), wonder_eras).orderBy("Civ", "Era"),
                "|".join(branch_order), ["Civ", "Era"])
    if religion_choices is not None:
        builders["religion_attainment"] = (lambda: sm.attainment_moments(religion_choices), "", ["event_type"])
        builders["religion_attainment_kde"] = (lambda: sm.attainment_kde(religion_choices), "", ["event_type", "x"])
        if log_results is not None and "belief_type" in religion_choices.columns:
            builders["religion_performance"] = (lambda: sm.religion_pick_performance(
                religion_choices, log_results).orderBy("section", "belief"), "", ["section", "belief"])
    if policy_choices is not None and log_results is not None and branch_order:
        for name, k, key in (("policy_opens", 0, ["civ", "branch"]), ("policy_wins", 1, ["branch", "victory_type"])):
            builders[name] = (lambda k=k: sm.policy_opens_and_wins(
                policy_choices, log_results, list(branch_order))[k], "|".join(branch_order), key)
    out = {}
    for name, (builder, fingerprint, key) in builders.items():
        path = f"{out_root}/{name}"
        out[name] = ensure_output(spark, f"{out_root}/_manifest", path, name, source_version, builder,
                                  force=force, fingerprint=fingerprint, unique=key)
        write_csv_sized(out[name], f"{path}_csv", approx_rows=out[name].count(), expect=out[name].count())
    return out
