"""Stats-store summary marts on hand-computed fixtures."""

import pytest

from pyspark.sql import functions as F

from turnlens.plans import store_marts as sm


@pytest.fixture(scope="module")
def cte(spark):
    rows = [(1, "Rome", t, 0) for t in range(0, 10)] + [(1, "Rome", t, 1) for t in range(10, 20)]
    rows += [(1, "Egypt", t, 0) for t in range(0, 20)]
    return spark.createDataFrame(rows, "GameId int, civ string, Turn int, era int")


def test_building_yield_summaries(spark):
    ov = spark.createDataFrame([(0, "Granary", 1, "Rome", 1, 2), (0, "Granary", 1, "Rome", 2, 2),
                                (0, "Granary", 1, "Egypt", 1, 1)],
                               "Era int, Building string, GameId int, Civ string, Turn int, Count int")
    y = spark.createDataFrame([(0, "Granary", "FOOD", 1000, 500)],
                              "Era int, Building string, Yield string, BaseYieldTimes100 long, "
                              "BonusYieldTimes100 long")
    iy = spark.createDataFrame([(0, "Granary", "GOLD", 300), (0, "Shrine", "FAITH", 100)],
                               "Era int, Building string, Yield string, YieldTimes100 long")
    era, turn = sm.building_yield_summaries(ov, y, iy)
    t = {(r["Building"], r["Yield"]): r for r in turn.collect()}
    # 5 copy-turns: base 10 / 5 = 2 per copy per turn
    assert t[("Granary", "FOOD")]["BaseYields"] == 2.0 and t[("Granary", "FOOD")]["N"] == 5
    assert t[("Granary", "GOLD")]["InstantYields"] == 0.6
    assert t[("Shrine", "FAITH")]["InstantYields"] == 0.0 and t[("Shrine", "FAITH")]["N"] == 0
    e = {(r["Building"], r["Yield"]): r for r in era.collect()}
    # 3 civ-turns present over 2 civ-games: 2.0 × 1.5
    assert e[("Granary", "FOOD")]["BaseYields"] == 3.0 and e[("Granary", "FOOD")]["N"] == 2


def test_belief_yield_summary_true_denominator(spark, cte):
    rby = spark.createDataFrame(
        [(1, 3, 0, "Rome", "God", "Pantheon", "1.0", "s", "FAITH", 200),
         (1, 4, 0, "Rome", "God", "Pantheon", "true", "t", "FAITH", 300),
         (1, 5, 0, "Egypt", "God", "Pantheon", "0", "s", "FAITH", 400),
         (1, 12, 1, "Rome", "God", "Pantheon", "1", "s", "FAITH", None)],
        "GameId int, Turn int, Era int, Civ string, Belief string, BeliefType string, "
        "IsReligionOwner string, Source string, Yield string, YieldTimes100 long")
    s = {(r["Era"], r["IsReligionOwner"]): r for r in sm.belief_yield_summary(rby, cte).collect()}
    assert s[(0, 1)]["SliceTotalAvg"] == 5.0 and s[(0, 1)]["PerTurnAvg"] == 0.5   # 10 turns
    assert s[(0, 0)]["PerTurnAvg"] == 0.2 and s[(0, 0)]["N"] == 1                 # 20 turns
    assert s[(1, 1)]["SliceTotalAvg"] == 0.0                                      # null → 0
    b = {(r["Bucket"], r["IsReligionOwner"]): r
         for r in sm.belief_yield_summary(rby, cte, by="bucket", width=10).collect()}
    assert b[(0, 1)]["PerTurnAvg"] == 0.5 and (10, 1) in b
    piv = sm.belief_owner_pivot(sm.belief_yield_summary(rby, cte), ["Era", "Belief", "Yield"])
    row = {r["Era"]: r for r in piv.collect()}[0]
    assert row["PerTurnAvg_1"] == 0.5 and row["PerTurnAvg_0"] == 0.2 and row["N_1"] == 1


def test_instant_yield_summary_identity(spark, cte):
    iy = spark.createDataFrame([(1, 2, "Rome", "Border", "FOOD", 1000),
                                (1, 3, "Egypt", "Border", "FOOD", 500),
                                (1, 4, "Egypt", "Border", "FOOD", 300)],
                               "GameId int, Turn int, Civ string, Type string, Yield string, "
                               "YieldTimes100 long")
    r = sm.instant_yield_summary(iy, cte).collect()[0]
    assert r["EraName"] == "Ancient"
    assert r["AvgYieldAmount"] == 9.0              # 18 over 2 players
    assert abs(r["AvgTriggerAmount"] * r["AvgTimesTriggered"] - r["AvgYieldAmount"]) < 1e-12


def test_unit_averages_and_game_rollups(spark, cte):
    units = spark.createDataFrame([(1, 1, "Rome", "Warrior"), (1, 1, "Rome", "Warrior"),
                                   (1, 2, "Rome", "Scout")],
                                  "GameId int, Turn int, owner string, unitName string")
    u = {r["Unit"]: (r["AvgCount"], r["N"]) for r in sm.unit_averages(units, cte).collect()}
    assert u == {"Warrior": (1.0, 2), "Scout": (0.5, 2)}
    res = spark.createDataFrame([(1, 120, "Rome", 500, ""), (1, 120, "Egypt", 900, "Science"),
                                 (2, 80, "Rome", 10, None)],
                                "GameId int, Turn int, Civ string, Score int, VictoryType string")
    g = {r["GameId"]: r for r in sm.game_rollup(res).collect()}
    assert (g[1]["WinnerCiv"], g[1]["VictoryType"], g[1]["Valid"]) == ("Egypt", "Science", True)
    assert g[2]["WinnerCiv"] is None and g[2]["Valid"] is False
    plots = spark.createDataFrame([(1, 120, "Rome", "Roma"), (1, 120, "Rome", ""),
                                   (1, 120, "Egypt", "Thebes"), (1, 119, "Egypt", "")],
                                  "GameId int, Turn int, owner string, cityName string")
    es = {r["Civ"]: (r["PlotShare"], r["CityShare"])
          for r in sm.end_state_ownership(plots, sm.game_rollup(res)).collect()}
    assert es == {"Rome": (2 / 3, 0.5), "Egypt": (1 / 3, 0.5)}


def test_build_store_marts_rebuilds_only_when_stale(spark, cte):
    from turnlens.session import scratch_dir
    base = scratch_dir(spark, "marts")
    store = f"{base}/store"
    cte.write.parquet(f"{store}/civ_turn_era")
    spark.createDataFrame([(0, "Granary", 1, "Rome", 1, 2)], "Era int, Building string, GameId int, "
                          "Civ string, Turn int, Count int").write.parquet(f"{store}/BuildingsOverview")
    spark.createDataFrame([(0, "Granary", "FOOD", 100, 0)], "Era int, Building string, Yield string, "
                          "BaseYieldTimes100 long, BonusYieldTimes100 long") \
        .write.parquet(f"{store}/BuildingYields")
    spark.createDataFrame([(0, "Granary", "GOLD", 100)], "Era int, Building string, Yield string, "
                          "YieldTimes100 long").write.parquet(f"{store}/BuildingInstantYields")
    spark.createDataFrame([(1, 3, 0, "Rome", "God", "Pantheon", "1", "s", "FAITH", 200)],
                          "GameId int, Turn int, Era int, Civ string, Belief string, "
                          "BeliefType string, IsReligionOwner string, Source string, Yield string, "
                          "YieldTimes100 long").write.parquet(f"{store}/ReligionBeliefYields")
    spark.createDataFrame([(1, 2, "Rome", "Border", "FOOD", 100)], "GameId int, Turn int, Civ string, "
                          "Type string, Yield string, YieldTimes100 long") \
        .write.parquet(f"{store}/InstantYields")
    spark.createDataFrame([(1, 1, "Rome", "Warrior")], "GameId int, Turn int, owner string, "
                          "unitName string").write.parquet(f"{store}/MapUnitsState")
    spark.createDataFrame([(1, 120, "Rome", 1, "Science")], "GameId int, Turn int, Civ string, "
                          "Score int, VictoryType string").write.parquet(f"{store}/GameResult")
    out = sm.build_store_marts(spark, store, f"{base}/out", "v1")
    assert out["games"].first()["WinnerCiv"] == "Rome"
    assert out["religion_by_era"].first()["PerTurnAvg"] == 0.2
    man = spark.read.parquet(f"{base}/out/_manifest")
    assert man.count() == 7
    sm.build_store_marts(spark, store, f"{base}/out", "v1")
    assert spark.read.parquet(f"{base}/out/_manifest").count() == 7     # all fresh
    sm.build_store_marts(spark, store, f"{base}/out", "v2")
    assert spark.read.parquet(f"{base}/out/_manifest").count() == 14


def test_wonder_builds_branches_and_rates(spark):
    ov = spark.createDataFrame(
        [(1, "Rome", 1, 0, "Palace", 1), (1, "Rome", 30, 1, "Petra", 1),
         (1, "Egypt", 30, 1, "Petra", 1), (1, "Egypt", 50, 2, "Colosseum", 1),
         (2, "Rome", 310, 3, "Petra", 1)],                      # game 2 starts logging late
        "GameId int, Civ string, Turn int, Era int, Building string, Count int")
    wonders = spark.createDataFrame([("Petra",), ("Colosseum",)], "Building string")
    valid = spark.createDataFrame([(1,), (2,)], "GameId int")
    b = sorted((r["GameId"], r["Civ"], r["Building"], r["Turn"])
               for r in sm.wonder_builds(ov, wonders, valid).collect())
    assert b == [(1, "Egypt", "Colosseum", 50), (1, "Egypt", "Petra", 30)]   # tie → civ name
    res = spark.createDataFrame([(1, 100, "Rome", 1, ""), (1, 100, "Egypt", 1, "Science")],
                                "GameId int, Turn int, Civ string, Score int, VictoryType string")
    choices = spark.createDataFrame([("1", "Egypt", "LIBERTY"), ("1", "Egypt", "TRADITION"),
                                     ("1", "Egypt", "POLICY_X")],
                                    "game_id string, civ string, item string")
    choices = choices.withColumn("game_id", F.col("game_id").cast("int"))
    gcb = {r["Civ"]: r["branches"] for r in sm.game_civ_branches(
        res, choices, ["TRADITION", "LIBERTY", "HONOR"], valid).collect()}
    assert gcb == {"Egypt": "TRADITION|LIBERTY", "Rome": ""}
    era = spark.createDataFrame([("Petra", "Classical"), ("Colosseum", "Classical")],
                                "Building string, Era string")
    gc = sm.game_civ_branches(res, choices, ["TRADITION", "LIBERTY", "HONOR"], valid)
    builds = sm.wonder_builds(ov, wonders, valid)
    r = {(x["Civ"], x["Era"]): x["per_game"] for x in sm.wonder_rates(builds, gc, era).collect()}
    assert r == {("Egypt", "Classical"): 2.0}
    assert sm.wonder_rates(builds, gc, era, cohort=["HONOR"]).count() == 0


def test_religion_and_policy_performance(spark):
    choices = spark.createDataFrame(
        [("g1", "Rome", "pantheon", 10, "God", "Pantheon"),
         ("g1", "Egypt", "religion_founded", 30, "Tithe", "Founder"),
         ("g1", "Egypt", "religion_founded", 30, "Pagodas", "Follower"),
         ("g1", "Rome", "religion_enhanced", 60, "Pagodas", "FOLLOWER"),
         ("g2", "Rome", "pantheon", 20, "God", "Pantheon"),
         ("g2", "Rome", "religion_founded", 40, "Odd", "Mystery")],
        "game_id string, civ string, type string, turn int, belief string, belief_type string")
    results = spark.createDataFrame([("g1", "Science", "Egypt"), ("g2", None, None)],
                                    "game_id string, victory_type string, victory_civ string")
    pp = {(r["section"], r["belief"]): (r["chosen_count"], r["wins"], r["losses"], r["avg_turn"])
          for r in sm.religion_pick_performance(choices, results).collect()}
    assert pp == {("pantheon", "God"): (2, 0, 2, 15.0), ("founder", "Tithe"): (1, 1, 0, 30.0),
                  ("follower_found", "Pagodas"): (1, 1, 0, 30.0),
                  ("follower_enhance", "Pagodas"): (1, 0, 1, 60.0)}
    mom = {r["event_type"]: (r["mean"], r["median"], r["n"])
           for r in sm.attainment_moments(choices).collect()}
    assert mom["Pantheon"] == (15.0, 15.0, 2) and mom["Religion Founded"] == (35.0, 35.0, 2)
    kde = sm.attainment_kde(choices, n_grid=61)
    assert {r["event_type"] for r in kde.select("event_type").distinct().collect()} == \
        {"Pantheon", "Religion Founded"}                # enhanced has one sample: skipped
    pol = spark.createDataFrame([("g1", "Egypt", "TRADITION"), ("g1", "Rome", "HONOR"),
                                 ("g3", "Rome", "HONOR"), ("g1", "Egypt", "POLICY_X")],
                                "game_id string, civ string, item string")
    opens, wins = sm.policy_opens_and_wins(pol, results, ["TRADITION", "HONOR"])
    assert sorted(tuple(r) for r in opens.collect()) == [("Egypt", "TRADITION", 1),
                                                        ("Rome", "HONOR", 1)]
    assert [tuple(r) for r in wins.collect()] == [("TRADITION", "Science", 1)]
