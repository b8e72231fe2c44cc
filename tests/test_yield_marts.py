"""Yield sources and trigger counts on hand-made turns."""

from turnlens.plans import marts


def test_city_gold_comes_from_the_civ_row(spark):
    y = "food double, production double, gold double, science double, culture double"
    civ = spark.createDataFrame([("g", "c", 1, "Ancient", 5.0, 9.0, 5.0, 30.0, 7.0, 3.0)],
                                f"game_id string, civ string, turn int, era string, city_gold double, {y}")
    city = spark.createDataFrame([("g", "c", 1, 4.0, 2.0, 8.0, 3.0, 1.0), ("g", "c", 1, 2.0, 1.0, 9.0, 1.0, 1.0)],
                                 f"game_id string, civ string, turn int, {y}")
    none = spark.createDataFrame([], "game_id string, civ string, turn int, reason string, yield string, value double")
    hy = spark.createDataFrame([], "game_id string, civ string, turn int, reason string, hy_gold double, "
                                   "hy_food double, hy_culture double, hy_science double")
    r = marts.economy_sources(civ, city, none, hy).first()
    assert (r.city_gold, r.misc_gold, r.total_gold) == (5.0, 25.0, 30.0)
    assert (r.city_food, r.misc_food) == (6.0, 3.0)
    t = marts.yield_sources_by_turn(civ, city, none, hy).first()
    assert (t.city_gold, t.civ_gold, t.city_food) == (5.0, 30.0, 6.0)


def test_two_lines_of_one_reason_are_one_trigger(spark):
    iy = spark.createDataFrame([("g", "c", 1, "r", "Food", 2.0), ("g", "c", 1, "r", "Food", 4.0),
                                ("g", "c", 2, "r", "Food", 10.0), ("g", "d", 2, "r", "Food", 1.0),
                                ("g", "d", 3, "r", "Food", 0.0)],
                               "game_id string, civ string, turn int, reason string, yield string, value double")
    cte = spark.createDataFrame([("g", c, t, "Ancient") for c in "cd" for t in (1, 2, 3)],
                                "game_id string, civ string, turn int, era string")
    r = marts.trigger_stats(iy, cte).first()
    assert (r.rows, r.mean_times) == (3, 1.5)
    assert r.avg_iy == 17.0 / 3 and r.mean_value == (8.0 + 1.0) / 2
