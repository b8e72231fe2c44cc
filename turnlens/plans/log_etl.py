"""The log ETL as one job: parse each log family once per game id (cached,
K02), build the marts, write each output sized by rows (K01).

Parsed tables go through :class:`turnlens.sinks.store.IdScopedCache`, so a
rerun over a grown log root parses only new games; everything else is
DataFrame lineage from those cached tables (each cache read cuts the
lineage, so a lost executor recomputes from the stored Parquet, not from
the raw logs).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from turnlens.plans import marts
from turnlens.session import staged
from turnlens.sinks.store import IdScopedCache, null_keys, write_csv_sized
from turnlens.sources import logs

# log family → file pattern inside a game folder (fixed values of the log layout)
PATTERNS = {
    "game_result": "*GameResult_Log.csv*",
    "wonders": "CitySpecializationLog_*.csv*",
    "city_purchases": "PlayerHomelandAILog_*.csv*",
    "research": "*TechAILog_*.csv*",
    "religion": "ReligionLog.csv*",
    "policies": "PolicyAILog_*.csv*",
    "vassalage": "DiplomacyAI_TradeAgreements_Log_.csv*",
    "instant_yields": "InstantYieldSummary.csv*",
    "handicap": "DifficultyHandicapLog.csv*",
    "city_economy": "EconomicCityMonitorLog_*.csv*",
    "civ_economy": "EconomicMonitorLog_*.csv*",
}

REJECT_COLUMNS = ["game_id", "file", "line_no", "line"]
YIELDS = [y.capitalize() for y in marts.CORRECTED_YIELDS]   # as written in the log


def run_log_etl(spark: SparkSession, log_root: str, out_root: str, cache_root: str,
                tech_dim: DataFrame, civ_names: DataFrame | None = None) -> dict[str, DataFrame]:
    ids = logs.list_game_ids(spark, log_root)

    def cached(name: str, parse) -> DataFrame:
        cache = IdScopedCache(spark, cache_root, name, "game_id")

        def compute(todo: DataFrame) -> DataFrame:
            if cache.first_run:           # nothing stored yet: one glob over all games
                return parse(None)
            # later runs: only the new games' folders are listed (ids, not rows)
            return parse([r["game_id"] for r in todo.collect()])
        return cache.get(ids, compute)

    def lines(family, wanted):
        return logs.scan_lines(spark, log_root, PATTERNS[family], wanted)

    results = cached("game_result", lambda w: logs.game_results(lines("game_result", w)))
    scores = cached("civ_scores", lambda w: logs.civ_scores(lines("game_result", w)))
    wonders = cached("wonders", lambda w: logs.wonders(lines("wonders", w)))
    purchases = cached("city_purchases", lambda w: logs.city_purchases(lines("city_purchases", w)))
    tech = cached("tech_events", lambda w: logs.tech_events(lines("research", w)))
    rel = cached("religion_lines", lambda w: logs.religion_lines(lines("religion", w)))
    branches = cached("branch_choices", lambda w: logs.policy_branches(lines("policies", w)))
    choices = cached("policy_choices", lambda w: logs.policy_choices(lines("policies", w)))
    deals = cached("vassalage", lambda w: logs.vassalage_deals(lines("vassalage", w)))
    iy = cached("instant_yields", lambda w: logs.instant_yields(lines("instant_yields", w)))
    rejects = []

    def cached_with_rejects(name: str, family: str, parser) -> DataFrame:
        """Parsed rows; lines the parser refuses go to the rejects table."""
        bad = cached(f"{name}_rejects", lambda w: parser(lines(family, w))[1].select(*REJECT_COLUMNS))
        rejects.append(bad.select(F.lit(name).alias("family"), *REJECT_COLUMNS))
        return cached(name, lambda w: parser(lines(family, w))[0])

    hy = cached_with_rejects("handicap_yields", "handicap", logs.handicap_yields)
    city = cached_with_rejects("city_economy", "city_economy", logs.city_economy)
    civ = cached_with_rejects("civ_economy", "civ_economy", logs.civ_economy)
    gold = cached_with_rejects("gold_breakdown", "civ_economy", logs.gold_breakdown)
    mstate = cached("map_state", lambda w: logs.map_state(spark, log_root, civ_names, w))

    cgr = marts.civ_game_result(results, scores)
    research = marts.research_intervals(tech, tech_dim)
    # read by many outputs: computed once
    cte = staged(marts.civ_turn_era(research, tech_dim), "civ-turn-era")
    rc = marts.religion_choices(rel, logs.RELIGION_EVENTS)
    # totals run on through the economy's last turn
    last = iy.select("turn").union(civ.select("turn")).agg(F.max("turn")).first()[0]
    running = marts.instant_yield_running_totals(iy, YIELDS, max(1, last or 1))
    running = staged(running.select("game_id", "civ", "turn",
                                    *[running[f"rt_{y.lower()}"] for y in YIELDS]), "running-totals")
    civ_corr = staged(marts.civ_economy_corrected(civ, running, cte), "civ-economy")
    own = staged(marts.ownership(mstate, deals), "ownership")
    out = {
        "wonders": wonders, "city_purchases": purchases, "game_result": results,
        "technology_completion_records": research,
        "era_transitions": cte,
        "city_purchases_by_era": marts.purchases_by_era(cte, purchases),
        "instant_yields": marts.with_era(marts.instant_yield_pivot(iy), cte),
        "gold_breakdown_by_era": marts.gold_breakdown_by_era(gold, running, cte),
        "era_transition_deltas": marts.era_transition_deltas(cte),
        "religion_choices": rc,
        "religion_stats": marts.belief_stats(rc, cgr),
        "branch_choices": branches,
        "policy_choices": marts.policy_pick_order(choices),
        "branch_stats": marts.branch_stats(branches, results),
        "civ_choices": marts.civ_choices(cgr, branches, rc),
        "vassalage": deals,
        "vassalage_map": marts.latest_vassalage(deals),
        "unit_compositions_turns": marts.unit_compositions_turns(mstate),
        "unit_compositions_eras": marts.units_per_turn(mstate, cte),
        "map_state_by_era": marts.units_and_map_by_era(mstate, own, cte),
        "handicap_yields": marts.with_era(hy, cte),
        "city_economy": marts.city_economy_with_era(city, cte),
        "instant_yield_sources": marts.trigger_stats(iy, cte),
        "handicap_yield_sources": marts.handicap_trigger_stats(hy, cte),
        "yield_sources_by_turn": marts.yield_sources_by_turn(civ_corr, city, iy, hy),
        "civ_economy_by_era": marts.civ_economy_by_era(civ_corr, iy, hy),
        "yield_sources_by_era": marts.economy_sources(civ_corr, city, iy, hy),
        "vic_frequency": marts.victory_stats(results),
        "power_ranking": marts.civ_performance(marts.augment_with_map_metrics(cgr, own)),
        "authority_victories": marts.authority_victories(own),
    }
    short = marts.religion_rejects(rel, logs.RELIGION_EVENTS)
    rejects.append(short.select(F.lit("religion_choices").alias("family"), "game_id", "file", "line_no",
                                F.col("event").alias("line")))
    out["rejects"] = reduce(DataFrame.unionByName, rejects)
    audit = []
    for name, df in out.items():
        counts = write_csv_sized(df, f"{out_root.rstrip('/')}/{name}",
                                 metrics=null_keys(["game_id"]) if "game_id" in df.columns else None)
        audit.append((name, counts["rows"], counts.get("null_keys")))
    out["audit"] = spark.createDataFrame(audit, "output string, n_rows long, null_games long")
    write_csv_sized(out["audit"], f"{out_root.rstrip('/')}/audit", approx_rows=len(audit), expect=len(audit))
    return out
