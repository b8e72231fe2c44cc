"""Store and stream behaviours modelled on the reference's ingest, per-runner
stats and segment-splice tests."""

import pytest
from pyspark.sql import functions as F, types as T

from turnlens.session import scratch_dir
from turnlens.sinks import store
from turnlens.streaming import live


@pytest.fixture()
def root(spark):
    return scratch_dir(spark, "test-store")


def _game_result(spark, rows, extra=False):
    schema = "GameId int, Turn int, Civ string, Score int, VictoryType string"
    if extra:
        schema += ", ExtraCol string"
    return spark.createDataFrame(rows, schema)


def test_contract_ingest_basic_and_mismatch_rejects_whole_file(spark, root):
    ok = _game_result(spark, [(1, 200, "Rome", 999, "Domination")])
    gold = spark.createDataFrame([(1, 10, 5.0)], "GameId int, Turn int, Gold double")
    bad = _game_result(spark, [(1, 210, "Egypt", 5, None, "x")], extra=True)
    contract = {}
    rep = store.ingest_with_contract(
        spark, {"f1": {"GameResult": ok, "WorldStateLog": gold}}, contract,
        f"{root}/store", f"{root}/q")
    assert {r["status"] for r in rep.collect()} == {"accepted"}
    contract = {"GameResult": ok.schema, "WorldStateLog": gold.schema}
    rep2 = store.ingest_with_contract(
        spark, {"f2": {"WorldStateLog": gold, "GameResult": bad}}, contract,
        f"{root}/store", f"{root}/q")
    assert {r["status"] for r in rep2.collect()} == {"quarantined"}
    # nothing of the mismatching file reached the store
    assert spark.read.parquet(f"{root}/store/WorldStateLog").count() == 1
    assert spark.read.parquet(f"{root}/q/f2/GameResult").count() == 1


def test_id_scoped_cache_parses_each_id_once(spark, root):
    facts = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "gid long, v string")
    calls = []

    def parse(ids):
        calls.append(sorted(r["gid"] for r in ids.collect()))
        return facts.join(ids, "gid", "left_semi").select("v", "gid")

    cache = store.IdScopedCache(spark, root, "t", "gid")
    ids = spark.createDataFrame([(1,), (3,)], "gid long")
    got = cache.get(ids, parse)
    assert got.columns == ["v", "gid"]
    assert sorted(r["v"] for r in got.collect()) == ["a", "b"]
    # id 3 produced no rows but is in the manifest: not parsed again
    got2 = cache.get(spark.createDataFrame([(1,), (2,), (3,)], "gid long"), parse)
    assert sorted(r["v"] for r in got2.collect()) == ["a", "b", "c"]
    assert calls == [[1, 3], [2]]


def test_splice_three_segments_one_header(spark):
    rows = []
    for seg in (1, 2, 3):
        rows += [("WorldState_Log.csv", seg, 0, "Turn,Player,Score"),
                 ("WorldState_Log.csv", seg, 1, f"{seg},Rome,{seg * 10}"),
                 ("RawLog.csv", seg, 0, f"raw {seg}")]
    rows.append(("Score_Log.csv", 3, 0, "Turn,Player"))      # appears late
    lines = spark.createDataFrame(rows, "name string, seg int, line int, text string")
    out = store.splice_segments(lines, "name", "seg", "line",
                                ["WorldState_Log.csv", "Score_Log.csv"], "pos")
    ws = [r["text"] for r in out.filter(F.col("name") == "WorldState_Log.csv")
          .orderBy("pos").collect()]
    assert ws == ["Turn,Player,Score", "1,Rome,10", "2,Rome,20", "3,Rome,30"]
    assert out.filter(F.col("name") == "RawLog.csv").count() == 3
    assert [r["text"] for r in out.filter(F.col("name") == "Score_Log.csv").collect()] == \
        ["Turn,Player"]
    empty = spark.createDataFrame([], lines.schema)
    assert store.splice_segments(empty, "name", "seg", "line", ["x"], "pos").count() == 0


def test_csv_sink_sized_by_rows(spark, root):
    df = spark.range(0, 10).withColumnRenamed("id", "x")
    store.write_csv_sized(df, f"{root}/csv")
    back = spark.read.option("header", True).csv(f"{root}/csv")
    assert back.count() == 10 and back.columns == ["x"]


def test_monotone_max_stream_and_mean_of_ratios(spark, root):
    src = f"{root}/src"
    rows = [("r1", "g1", "base", 10, 100.0, "2024-01-01 00:00:00"),
            ("r1", "g1", "base", 20, 400.0, "2024-01-01 00:10:00"),
            ("r1", "g1", "base", 15, 300.0, "2024-01-01 00:05:00"),
            ("r1", "g2", "base", 0, 0.0, "2024-01-01 00:20:00")]
    df = spark.createDataFrame(rows, "runner string, game string, modpack string, turns int, "
                                     "time_sec double, ts string")
    df = df.withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(f"{src}/updates.parquet")
    schema = df.schema
    s = live.file_stream(spark, f"{src}/updates.parquet", "*.parquet", schema)
    agg = live.monotone_max_stream(s, ["runner", "game"], ["turns", "time_sec"], "modpack", "ts")
    out = live.run_to_table(agg, "mm", mode="update", keys=["runner", "game"])
    got = {r["game"]: (r["max_turns"], r["max_time_sec"]) for r in out.collect()}
    assert got == {"g1": (20, 400.0), "g2": (0, 0.0)}     # max is monotone, not last
    ratio = out.agg(F.avg(F.when(F.col("max_turns") > 0,
                                 F.col("max_time_sec") / F.col("max_turns"))).alias("m"))
    assert ratio.first()["m"] == 20.0                      # zero-turn games excluded


def test_register_or_reject(spark):
    reg = spark.createDataFrame([("u1",)], "uuid string")
    beats = spark.createDataFrame([("u1", None), ("u2", "http://x"), ("u3", None)],
                                  "uuid string, url string")
    ok, rejected = live.register_or_reject(beats, reg, "uuid", "url")
    assert sorted(r["uuid"] for r in ok.collect()) == ["u1", "u2"]
    assert [r["uuid"] for r in rejected.collect()] == ["u3"]


def test_audit_append_sorted_metadata(spark, root):
    store.append_audit(spark, f"{root}/audit", {"bundle_name": "b1", "game_id": "g"},
                       {"z": 1, "a": 2})
    store.append_audit(spark, f"{root}/audit", {"bundle_name": "b2", "game_id": "g"}, {})
    rows = spark.read.parquet(f"{root}/audit").orderBy("bundle_name").collect()
    assert [r["metadata_json"] for r in rows] == ['{"a": 2, "z": 1}', "{}"]


def test_freshness_manifest_rebuilds_only_when_stale(spark, root):
    built = []

    def builder():
        built.append(1)
        return spark.range(3)

    args = (spark, f"{root}/manifest", f"{root}/out", "mart")
    store.ensure_output(*args, "v1", builder, required_columns=["id"])
    store.ensure_output(*args, "v1", builder, required_columns=["id"])
    assert len(built) == 1
    store.ensure_output(*args, "v2", builder)
    store.ensure_output(*args, "v2", builder, required_columns=["missing"])
    assert len(built) == 3


def test_schema_types_are_explicit():
    t = T.StructType([T.StructField("a", T.LongType())])
    assert store.schema_matches(t, t)
    assert not store.schema_matches(t, T.StructType([T.StructField("a", T.IntegerType())]))


def test_streams_latest_state_and_closed_sessions(spark, root):
    src = f"{root}/events"
    rows = [(1, "2024-01-01 00:00:00", 7, "view", 1.0, "{}"),
            (2, "2024-01-01 00:10:00", 7, "click", 2.0, "{}"),
            (3, "2024-01-01 02:00:00", 7, "purchase", 3.0, "{}"),
            (4, "2024-01-01 00:05:00", 8, "view", 4.0, "{}"),
            (5, "2024-01-01 05:00:00", 9, "view", 5.0, "{}")]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, "
                                     "value double, props string")
    df = df.withColumn("ts", F.to_timestamp_ntz("ts")).select(
        "event_id", "ts", "user_id", "event_type", "value", "props")
    df.write.parquet(src)
    from turnlens.plans.extra import EVENTS_SCHEMA
    s = live.file_stream(spark, src, "*.parquet", EVENTS_SCHEMA)
    latest = live.run_to_table(live.latest_state_stream(s), "t01", "update", ["user_id"])
    got = {r["user_id"]: (r["latest_event_id"], r["prev_event_id"]) for r in latest.collect()}
    assert got == {7: (3, 2), 8: (4, None), 9: (5, None)}
    s2 = live.file_stream(spark, src, "*.parquet", EVENTS_SCHEMA)
    sess = live.run_to_table(live.session_counts(s2, "user_id", "ts", "value", "30 minutes",
                                                 "1 hour"), "t02", "append")
    closed = sorted((r["user_id"], r["n_events"]) for r in sess.collect())
    # watermark = 05:00 − 1h: sessions ending by 04:00 are closed; user 9's is live
    assert closed == [(7, 1), (7, 2), (8, 1)]


def _stats_file(spark, uuids, results, extra=False):
    d = spark.createDataFrame([(i + 1, u) for i, u in enumerate(uuids)], "id int, uuid_hex string")
    gr = _game_result(spark, results, extra)
    ws = spark.createDataFrame([(i + 1, (i + 1) * 10, 1.5) for i in range(len(uuids))],
                               "GameId int, Turn int, Gold double")
    return {"uuid_dictionary": d, "GameResult": gr, "WorldStateLog": ws}


def test_stats_ingest_translates_ids_and_quarantines(spark, root):
    q = f"{root}/q"
    contract = {}
    r1 = store.ingest_stats_file(spark, f"{root}/s", q, "a",
                                 _stats_file(spark, ["AAAA"], [(1, 200, "Rome", 999, "Domination")]),
                                 contract)
    assert {x["status"] for x in r1.collect()} == {"accepted"}
    gr = spark.read.parquet(f"{root}/s/GameResult").collect()
    assert [(x["GameId"], x["Civ"]) for x in gr] == [(1, "Rome")]
    # a second file: one known uuid and one new one → ids 1 and 2, dictionary idempotent
    store.ingest_stats_file(spark, f"{root}/s", q, "b",
                            _stats_file(spark, ["BBBB", "AAAA"],
                                        [(1, 150, "Egypt", 5, None), (2, 210, "Rome", 7, None)]),
                            contract)
    d = {x["uuid_hex"]: x["id"] for x in spark.read.parquet(f"{root}/s/uuid_dictionary").collect()}
    assert d == {"AAAA": 1, "BBBB": 2}
    games = sorted((x["GameId"], x["Civ"]) for x in spark.read.parquet(f"{root}/s/GameResult").collect())
    assert games == [(1, "Rome"), (1, "Rome"), (2, "Egypt")]
    # mismatching schema: nothing of the file is stored
    contract = {"GameResult": _game_result(spark, []).schema}
    r3 = store.ingest_stats_file(spark, f"{root}/s", q, "c",
                                 _stats_file(spark, ["CCCC"], [(1, 1, "X", 1, None, "e")], True),
                                 contract)
    assert {x["status"] for x in r3.collect()} == {"quarantined"}
    assert spark.read.parquet(f"{root}/s/uuid_dictionary").count() == 2
    assert spark.read.parquet(f"{root}/s/WorldStateLog").count() == 3


def test_stream_batches_fill_id_scoped_cache(spark, root):
    src = f"{root}/games"
    spark.createDataFrame([("g1", 1, 5.0), ("g1", 2, 6.0), ("g2", 1, 7.0)],
                          "game_id string, turn int, v double").write.parquet(src)
    cache = store.IdScopedCache(spark, f"{root}/cache", "per_game", "game_id")
    schema = spark.read.parquet(src).schema

    def on_batch(batch, batch_id):
        ids = batch.select("game_id").distinct()
        cache.get(ids, lambda todo: batch.join(todo, "game_id", "left_semi")
                  .groupBy("game_id").agg(F.sum("v").alias("total")))

    live.append_new_ids(live.file_stream(spark, src, "*.parquet", schema), on_batch, "t07")
    got = cache.get(spark.createDataFrame([("g1",), ("g2",)], "game_id string"),
                    lambda todo: None)
    assert sorted((r["game_id"], r["total"]) for r in got.collect()) == [("g1", 11.0), ("g2", 7.0)]
