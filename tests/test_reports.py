"""Reports over a hand-made store: era names, columns, order, places."""

import pytest
from pyspark.sql import functions as F

from turnlens.operators.quality import RowCountMismatch
from turnlens.plans import marts, reports
from turnlens.session import scratch_dir
from turnlens.sinks import store as sinks


@pytest.fixture()
def store(spark):
    base = scratch_dir(spark, "reports") + "/store"
    rows = [(1, "Rome", 300, 900, "Science"), (1, "Egypt", 300, 0, ""), (1, "Greece", 300, 0, None),
            (1, "Persia", 300, 500, ""), (2, "Rome", 80, 10, "Time"), (3, "Egypt", 200, 50, "Cultural"),
            (3, "Rome", 200, 50, "")]
    write = lambda data, schema, name: spark.createDataFrame(data, schema).write.parquet(f"{base}/{name}")
    write(rows, "GameId int, Civ string, Turn int, Score int, VictoryType string", "GameResult")
    last = {(1, "Rome"): 300, (1, "Egypt"): 150, (1, "Greece"): 150, (1, "Persia"): 300, (3, "Egypt"): 200,
            (3, "Rome"): 200}
    write([(g, c, t, 0 if t < 100 else 1) for (g, c), m in last.items() for t in (1, m)],
          "GameId int, civ string, Turn int, era int", "civ_turn_era")
    write([(1, 300, "Rome", "Roma"), (1, 300, "Rome", ""), (1, 300, "Persia", "Susa"), (1, 299, "Egypt", "")],
          "GameId int, Turn int, owner string, cityName string", "MapPlotsState")
    write([(12, "Granary", 1, "Rome", 1, 2), (0, "Granary", 1, "Rome", 1, 2)],
          "Era int, Building string, GameId int, Civ string, Turn int, Count int", "BuildingsOverview")
    write([(0, "Granary", "FOOD", 100, 0), (12, "Granary", "FOOD", 100, 0)],
          "Era int, Building string, Yield string, BaseYieldTimes100 long, BonusYieldTimes100 long", "BuildingYields")
    write([(1, "Granary", "GOLD", 100)], "Era int, Building string, Yield string, YieldTimes100 long",
          "BuildingInstantYields")
    write([(1, 1, 0, "Rome", "God", "Pantheon", "1", "s", "FAITH", 200),
           (1, 1, 0, "Persia", "God", "Pantheon", "0", "s", "FAITH", 400)],
          "GameId int, Turn int, Era int, Civ string, Belief string, BeliefType string, IsReligionOwner string, "
          "Source string, Yield string, YieldTimes100 long", "ReligionBeliefYields")
    return base


def test_finishing_places_by_death_turn(spark, store):
    places = marts.finishing_places(spark.read.parquet(f"{store}/GameResult"),
                                    spark.read.parquet(f"{store}/civ_turn_era"))
    got = {(r.GameId, r.Civ): r.place for r in places.collect()}
    # Egypt and Greece died on the same turn: places 4 and 3 are shared
    assert got == {(1, "Rome"): 1.0, (1, "Persia"): 2.0, (1, "Egypt"): 3.5, (1, "Greece"): 3.5, (2, "Rome"): 1.0,
                   (3, "Egypt"): 1.5, (3, "Rome"): 1.5}


def test_reports(spark, store):
    out_root = scratch_dir(spark, "reports-out")
    wonders = spark.createDataFrame([("Granary", "Ancient")], "Building string, Era string")
    out = reports.build_reports(spark, store, out_root, "v1", wonder_eras=wonders)
    assert {"building_era_totals", "building_turn_average", "religion_era", "religion_bucket", "power_ranking",
            "wonder_builds"} <= set(out)
    b = out["building_turn_average"]
    assert b.columns == ["Era", "Building", "Yield", "BaseYields", "BonusYields", "InstantYields", "N"]
    assert [(r.Era, r.Yield, r.BaseYields, r.InstantYields, r.N) for r in b.collect()] == [
        ("Ancient", "FOOD", 0.5, 0.0, 2), ("Classical", "GOLD", 0.0, 0.0, 0)]    # era 12 has no name
    r = out["religion_era"].first()
    assert (r.Era, r.YieldTotalForOwner, r.YieldTotalForFollower, r.NOwner, r.NFollower) == ("Ancient", 2.0, 4.0, 1, 1)
    p = {x.civ: x for x in out["power_ranking"].collect()}
    # game 2 ends before turn 100
    assert (p["Rome"].count_games, p["Rome"].winrate, p["Rome"].science_victories) == (2, 0.5, 1)
    assert p["Rome"].pct_science_victories == 1.0 and p["Rome"].time_victories == 0
    assert p["Rome"].avg_tiles_owned_percentage == 2 / 3 and p["Rome"].avg_rank_at_game_end == 1.25
    assert p["Egypt"].pct_culture_victories == 1.0 and p["Greece"].pct_culture_victories is None
    back = spark.read.option("header", True).csv(f"{out_root}/power_ranking_csv")
    assert back.columns == out["power_ranking"].columns and back.count() == 4
    built = spark.read.parquet(f"{out_root}/_manifest").count()
    reports.build_reports(spark, store, out_root, "v1", wonder_eras=wonders)
    assert spark.read.parquet(f"{out_root}/_manifest").count() == built == len(out)


def test_an_output_with_repeated_keys_fails(spark):
    base = scratch_dir(spark, "keys")
    bad = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(RowCountMismatch):
        sinks.ensure_output(spark, f"{base}/_manifest", f"{base}/x", "x", "v", lambda: bad, unique=["k"])
    from turnlens.session import path_exists
    assert not path_exists(spark, f"{base}/_manifest")


def test_csv_counts_while_writing(spark):
    base = scratch_dir(spark, "counted")
    seen = []
    df = spark.range(10).select(F.when(F.col("id") > 2, F.col("id")).alias("k"))
    counts = sinks.write_csv_sized(df, f"{base}/a", metrics=sinks.null_keys(["k"]))
    assert counts == {"rows": 10, "null_keys": 3} and not seen
    with pytest.raises(RowCountMismatch):
        sinks.write_csv_sized(df, f"{base}/b", expect=11)
    none = sinks.write_csv_sized(df.filter("k < 0"), f"{base}/c", metrics=sinks.null_keys(["k"]))
    assert none["rows"] == 0


def test_csv_input_is_computed_once(spark):
    """A count of the rows that pass through shows that no second pass runs."""
    seen = spark.sparkContext.accumulator(0)

    def tick(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(1000).mapInArrow(tick, "id long")
    sinks.write_csv_sized(df, scratch_dir(spark, "once"))
    assert seen.value == 1000


def test_map_state_by_era(spark):
    ms = spark.createDataFrame(
        [("g", 1, "A", 1, "U", "A"), ("g", 1, "A", -1, "U", "B"), ("g", 1, "B", 2, "", "B"), ("g", 2, "A", 1, "U", "A")],
        "game_id string, turn int, owner_civ string, city_id int, unit string, unit_owner_civ string")
    deals = spark.createDataFrame([("g", "B", 2, "A")], "game_id string, vassal string, turn int, master string")
    cte = spark.createDataFrame([("g", "A", 1, 1), ("g", "A", 2, 1), ("g", "B", 1, 1)],
                                "game_id string, civ string, turn int, era int")
    out = {r.civ: r for r in marts.units_and_map_by_era(ms, marts.ownership(ms, deals), cte).collect()}
    a = out["A"]
    assert a.units_owned_percentage_avg == 0.75 and a.tiles_owned_percentage_avg == pytest.approx((2 / 3 + 1) / 2)
    assert a.cities_owned_percentage_avg == 0.75 and out["B"].units_owned_percentage_avg == 0.5


def test_authority_merges_conquest(spark):
    flags = {"culture_victory": 0, "diplomatic_victory": 0, "domination_victory": 0, "science_victory": 0,
             "time_victory": 0}
    rows = [("g1", 300, {**flags, "science_victory": 1}), ("g2", 250, {**flags, "domination_victory": 1})]
    res = spark.createDataFrame([(g, t, *f.values()) for g, t, f in rows],
                                "game_id string, turn int, " + ", ".join(f"{f} int" for f in flags))
    auth = spark.createDataFrame([("g1", "Rome", 140, 1)], "game_id string, owner_nation string, turn int, pseudo_victory int")
    got = {r.game_id: r for r in marts.authority_results(res, auth).collect()}
    assert (got["g1"].turn, got["g1"].science_victory, got["g1"].authority_victory) == (140, 0, 1)
    assert (got["g2"].turn, got["g2"].authority_victory, got["g2"].authority_victor) == (250, 1, None)
    assert "domination_victory" not in got["g2"].asDict()


def test_short_belief_buffers_are_rejected(spark):
    from turnlens.sources.logs import RELIGION_EVENTS
    rel = spark.createDataFrame(
        [("g", "f", 1, 5, "A", "CHOSEN", "x"), ("g", "f", 2, 5, "A", "RELIGION FOUNDED", ""),
         ("g", "f", 3, 6, "A", "CHOSEN", "y"), ("g", "f", 4, 6, "A", "PANTHEON FOUNDED", ""),
         ("g", "f", 5, 7, "A", "REFORMATION BELIEF ADDED", "")],
        "game_id string, file string, line_no int, turn int, civ string, event string, details string")
    got = sorted((r.line_no, r.expected, r.found) for r in marts.religion_rejects(rel, RELIGION_EVENTS).collect())
    assert got == [(2, 2, 1), (5, 1, 0)]


def test_plot_yields_of_other_kinds_stay(spark):
    py = spark.createDataFrame([("g", "A", 1, "YIELD_GOLD", 3), ("g", "A", 1, "YIELD_TOURISM", 2),
                                ("g", "A", 1, "YIELD_FOOD", -1)], "game_id string, civ string, turn int, yield string, amount int")
    r = marts.plot_yield_totals(py).first()
    assert (r.p_gold, r.YIELD_TOURISM, r.p_food) == (3, 2, None)
    many = spark.createDataFrame([("g", "A", 14)], "game_id string, civ string, branch int")
    assert marts.branch_counts(many).first()["branch_14"] == 1
