"""No literal limit drops rows; numbers are dense; sinks can be run again."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from turnlens.operators.ordered import global_row_number
from turnlens.operators.rank import flag_group_argmax
from turnlens.plans import catalog
from turnlens.plans import extra  # noqa: F401
from turnlens.session import scratch_dir
from turnlens.sinks import store


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_row_numbers_are_dense_on_millions_of_rows(spark, reuse):
    n = 3_000_000
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        df = spark.range(n).select(F.xxhash64("id").alias("x"), "id", F.concat(F.lit("p"), "id").alias("payload"))
        out = global_row_number(df, [F.col("x").desc(), F.col("id")], "rn", num_partitions=8)
        r = out.agg(F.countDistinct("rn").alias("d"), F.min("rn").alias("a"), F.max("rn").alias("b"),
                    F.count(F.lit(1)).alias("n")).first()
        assert (r.d, r.a, r.b, r.n) == (n, 1, n, n)
        top = out.filter("rn <= 3").orderBy("rn").select("id").collect()
        assert top == df.orderBy(F.col("x").desc(), "id").limit(3).select("id").collect()
        assert out.filter("payload <> concat('p', id)").count() == 0
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


@pytest.fixture(scope="module")
def late_events(spark, sf_small):
    """The events table with a late day and an event type nobody listed."""
    ev = spark.read.parquet(f"{sf_small}/events.parquet")
    row = ev.filter("event_type = 'purchase'").first().asDict()
    more = [row | {"event_id": 10**9, "ts": row["ts"].replace(month=1, day=1) + dt.timedelta(days=65)},
            row | {"event_id": 10**9 + 1, "event_type": "refund"}]
    folder = scratch_dir(spark, "late")
    ev.union(spark.createDataFrame(more, ev.schema)).write.parquet(f"{folder}/events.parquet")
    return folder, row["user_id"]


def test_late_days_and_unlisted_values_are_seen(spark, late_events):
    folder, user = late_events
    q = catalog.QUERIES
    spine = q["spine_running_total"](spark, folder).filter(F.col("user_id") == user)
    assert spine.agg(F.max("day")).first()[0] == 65 and spine.filter("day = 65 and day_value > 0").count() == 1
    weeks = q["era_feature_pivot"](spark, folder)
    assert weeks.filter((F.col("user_id") == user) & (F.col("w9_n") == 1)).count() == 1
    counts = q["pivot_count"](spark, folder).filter(F.col("user_id") == user).first()
    assert counts.n_refund == 1
    assert q["pivot_sum_fill"](spark, folder).columns[-3:] == ["v_refund", "v_signup", "v_view"]
    assert q["unpivot_long"](spark, folder).filter("event_type = 'refund' and total <> 0").count() == 1
    assert q["first_missing_tier"](spark, folder).filter("first_missing > 65").count() == 0


def test_repeats_do_not_depend_on_batches(spark, sf_small):
    from turnlens.plans.extra import EVENTS_SCHEMA
    from turnlens.streaming import live
    ev = spark.read.parquet(f"{sf_small}/events.parquet")
    folder = scratch_dir(spark, "arrivals")
    ev.repartition(5).write.parquet(folder)
    key = ["user_id", "event_type"]
    got = [sorted(map(tuple, live.run_to_table(live.drop_repeats(
        live.file_stream(spark, folder, "*.parquet", EVENTS_SCHEMA, n).select(*key), key), "repeats").collect()))
        for n in (None, 1)]
    assert got[0] == got[1] == sorted(map(tuple, ev.select(*key).distinct().collect()))


def test_repeated_names_skip_used_numbers(spark):
    from turnlens.operators.keyed import number_repeats
    arrivals = spark.createDataFrame([("g", 1), ("g", 2), ("g", 3), ("h", 1), ("h", 2)], "id string, at int")
    taken = spark.createDataFrame([("g",), ("g-1",), ("g-3",), ("x-y",)], "name string")
    out = number_repeats(arrivals, taken, "id", "name", ["at"], F.lit(0))
    assert {(r.id, r["at"]): r["name"] for r in out.collect()} == {
        ("g", 1): "g-2", ("g", 2): "g-4", ("g", 3): "g-5", ("h", 1): "h", ("h", 2): "h-1"}


def test_running_totals_have_no_last_turn(spark):
    from turnlens.plans import marts
    iy = spark.createDataFrame([("g", "c", 620, "r", "Food", 5.0)],
                               "game_id string, civ string, turn int, reason string, yield string, value double")
    out = marts.instant_yield_running_totals(iy, ["Food"])
    assert out.filter("turn = 620 and rt_food = 5").count() == 1


def test_argmax_takes_text_ids_and_null_scores(spark):
    df = spark.createDataFrame([("k", "b", 2.0), ("k", "a", 2.0), ("k", "c", None), ("m", "x", None)],
                               "k string, id string, score double")
    out = {(r.k, r.id): r.is_top for r in flag_group_argmax(df, ["k"], "score", "id").collect()}
    assert out == {("k", "a"): 1, ("k", "b"): 0, ("k", "c"): 0, ("m", "x"): 1}


def test_cache_recovers_from_a_break_between_rows_and_manifest(spark, monkeypatch):
    root = scratch_dir(spark, "cache")
    ids = spark.createDataFrame([(1,), (2,)], "id long")
    rows = lambda todo: todo.withColumn("v", F.col("id") * 10)
    cache = store.IdScopedCache(spark, root, "t", "id")
    with monkeypatch.context() as m:
        m.setattr(store.IdScopedCache, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("broken off")))
        with pytest.raises(RuntimeError):
            cache.get(ids, rows)
    for _ in range(2):
        assert sorted(map(tuple, cache.get(ids, rows).collect())) == [(1, 10), (2, 20)]


def test_second_file_must_fit_the_stored_tables(spark):
    base = scratch_dir(spark, "ingest")
    one = {"uuid_dictionary": spark.createDataFrame([(1, "aa")], "id long, uuid_hex string"),
           "facts": spark.createDataFrame([(1, 5), (7, 6)], "GameId long, v int")}
    report = store.ingest_stats_file(spark, f"{base}/s", f"{base}/q", "f1", one, {}).collect()
    assert sorted((r.status, r.rows) for r in report) == [("accepted", 1), ("unmatched", 1)]
    two = {"uuid_dictionary": spark.createDataFrame([(1, "bb")], "id long, uuid_hex string"),
           "facts": spark.createDataFrame([(1, 5, "x")], "GameId long, v int, extra string")}
    report = store.ingest_stats_file(spark, f"{base}/s", f"{base}/q", "f2", two, {}).collect()
    assert [r.status for r in report] == ["quarantined"]
    assert spark.read.parquet(f"{base}/s/facts").count() == 1
    assert spark.read.parquet(f"{base}/s/uuid_dictionary").count() == 1
