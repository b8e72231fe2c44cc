"""Streams over several batches: the same rows for any slicing, state that
goes, a registry that grows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from turnlens.operators.keyed import number_repeats
from turnlens.session import scratch_dir
from turnlens.streaming import live

SCHEMA = "user_id long, event_id long, ts timestamp_ntz, event_type string, value double"


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(8)
    rows, start = [], dt.datetime(2024, 1, 1)
    for i in range(400):
        day = rng.randrange(12)
        user = 1 if day in (0, 11) and i % 3 == 0 else rng.randrange(2, 12) + (20 if day > 6 else 0)
        rows.append((user, i, start + dt.timedelta(days=day, seconds=rng.randrange(86_400)),
                     rng.choice(["view", "click", "signup", "purchase"]), round(rng.random() * 50, 2)))
    return spark.createDataFrame(rows, SCHEMA).cache()


def replay(events, slices):
    return live.Replay(events, F.unix_date(F.to_date("ts")), slices)


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


RUNS = {
    "latest": lambda s, p: live.run_to_table(live.latest_state_stream(s), "a", "update", ["user_id"], p),
    "latest-ttl": lambda s, p: live.run_to_table(live.latest_state_stream(
        s, ttl_sec=86_400, watermark="10 minutes"), "b", "update", ["user_id"], p),
    "monotone": lambda s, p: live.merge_monotone(live.run_to_table(live.monotone_max_stream(
        s, ["user_id"], ["value"], "event_type", "event_id", watermark="10 minutes", period="1 day"),
        "c", "update", ["period", "user_id"], p), ["user_id"], ["value"], "event_type"),
    "pulses": lambda s, p: live.merge_pulses(live.run_to_table(live.pulse_counts(
        live.with_event_time(s, "ts"), "user_id", "event_type", "signup", "view", watermark="10 minutes"),
        "d", "update", ["period", "user_id"], p), "user_id"),
    "sessions": lambda s, p: live.run_to_table(live.session_counts(
        s, "user_id", "ts", "value", "2 hours", "10 minutes"), "e", "append", None, p),
    "expired": lambda s, p: live.expired_keys(s, "user_id", "ts", 6 * 3600, "10 minutes", p),
    "repeats": lambda s, p: live.run_to_table(live.drop_repeats(
        s.select("user_id", "event_type"), ["user_id", "event_type"]), "g", "append", None, p),
}


@pytest.mark.parametrize("name", RUNS)
def test_one_batch_or_many(events, name):
    got, progress = [], []
    for slices in (1, 4):
        p = []
        got.append(rows(RUNS[name](replay(events, slices).stream(), p)))
        progress.append(p)
    assert got[0] == got[1] and got[0]
    assert len([x for x in progress[1] if x["rows"]]) == 4


@pytest.mark.parametrize("name", ["latest-ttl", "monotone", "pulses", "sessions"])
def test_state_falls_after_silence(events, name):
    progress = []
    RUNS[name](replay(events, 4).stream(), progress)
    held = [p["state"] for p in progress]
    assert held[-1] < max(held) or max(held) <= 12      # players of the first week are gone
    whole = []
    RUNS["latest"](replay(events, 4).stream(), whole)
    if name == "latest-ttl":
        assert held[-1] < whole[-1]["state"]


def test_every_session_is_reported(spark, events):
    last = events.agg(F.max("ts").alias("t")).first().t
    marker = spark.createDataFrame([(None, None, last + dt.timedelta(days=2), None, None)], SCHEMA)
    done = live.all_sessions(replay(events, 3), "user_id", "ts", "value", "2 hours", "10 minutes", marker)
    want = {}
    for r in events.orderBy("ts").collect():
        held = want.setdefault(r.user_id, [])
        if held and r.ts - held[-1][-1] < dt.timedelta(hours=2):
            held[-1].append(r.ts)
        else:
            held.append([r.ts])
    got = sorted((r.user_id, r.n_events) for r in done.collect())
    assert got == sorted((u, len(s)) for u, held in want.items() for s in held)


def test_other_column_names_and_ttl(spark):
    start = dt.datetime(2024, 1, 1)
    data = [("a", 1, start, "x"), ("a", 2, start + dt.timedelta(hours=5), "y"), ("b", 3, start, "x"),
            ("b", 4, start + dt.timedelta(hours=1), "z"), ("a", 5, start + dt.timedelta(days=2), "w")]
    df = spark.createDataFrame(data, "who string, no long, at timestamp_ntz, state string")
    out = live.run_to_table(live.latest_state_stream(
        live.Replay(df, F.unix_date(F.to_date("at")), 2).stream(), "who", "no", "state", "at",
        ttl_sec=7200, watermark="1 minute"), "names", "update", ["who"])
    assert {r.who: (r.latest_no, r.prev_no, r.prev_state) for r in out.collect()} == {"a": (5, None, None), "b": (4, 3, "x")}


def test_registry_grows_in_the_stream(spark, events):
    s = events.withColumn("address", F.when(F.col("event_type") == "signup", F.col("event_id").cast("string"))) \
        .select("user_id", "event_id", "ts", "address")
    first = {}
    for r in s.orderBy("ts").collect():
        if r.address and r.user_id not in first:
            first[r.user_id] = r
    for slices in (1, 5):
        src = live.Replay(s, F.unix_date(F.to_date("ts")), slices)
        reg = live.Registry(spark, scratch_dir(spark, "reg"), s.schema, "user_id", "address", ["ts", "event_id"])
        live.append_new_ids(src.stream(), reg.on_batch, "register")
        assert {r.user_id: r.address for r in reg.keys().collect()} == {u: r.address for u, r in first.items()}
        ok = {r.event_id for r in reg.accepted().collect()}
        assert ok == {r.event_id for r in s.collect() if r.user_id in first and r.ts >= first[r.user_id].ts}
        assert reg.rejected().count() + len(ok) == s.count()


def test_a_key_of_batch_one_is_known_in_batch_two_and_replays_change_nothing(spark):
    kind = "k string, address string, at int"
    reg = live.Registry(spark, scratch_dir(spark, "reg"), spark.createDataFrame([], kind).schema, "k", "address", ["at"])
    one = spark.createDataFrame([("a", "x", 2), ("b", None, 1), ("a", None, 1), (None, "z", 1)], kind)
    two = spark.createDataFrame([("a", None, 3), ("b", "y", 4), ("b", None, 5)], kind)
    for batches in ([(one, 0), (two, 1)], [(one, 0)], [(two, 1)], [(one, 0), (two, 1)]):
        for df, i in batches:
            reg.on_batch(df, i)
        assert sorted((r.k, r["at"]) for r in reg.accepted().collect()) == [("a", 2), ("a", 3), ("b", 4), ("b", 5)]
        assert sorted((r.k or "", r["at"]) for r in reg.rejected().collect()) == [("", 1), ("a", 1), ("b", 1)]
        assert sorted((r.k, r.address) for r in reg.keys().collect()) == [("a", "x"), ("b", "y")]


def test_first_arrivals_are_kept_in_a_table(spark, events):
    want = {}
    for r in events.orderBy("ts", "event_id").collect():
        want.setdefault((r.user_id, r.event_type), r.event_id)
    s = events.select("user_id", "event_type", "ts", "event_id")
    for slices in (1, 4):
        src = live.Replay(s, F.unix_date(F.to_date("ts")), slices)
        first = live.FirstArrivals(spark, scratch_dir(spark, "first"), s.schema, ["user_id", "event_type"], ["ts", "event_id"])
        live.append_new_ids(src.stream(), first.on_batch, "first")
        assert {(r.user_id, r.event_type): r.event_id for r in first.rows().collect()} == want
    again = first.rows().count()
    first.on_batch(s.limit(0), 99)
    assert first.rows().count() == again


def test_a_million_taken_names_of_one_key(spark):
    """Every second number up to two millions is taken; ten thousand arrivals
    take the free ones in order. No list of a key's numbers is built."""
    taken = spark.range(0, 2_000_000, 2).select(F.when(F.col("id") == 0, "k").otherwise(
        F.concat(F.lit("k-"), F.col("id").cast("string"))).alias("name"))
    arrivals = spark.range(10_000).select(F.lit("k").alias("key"), F.col("id").alias("at"))
    out = number_repeats(arrivals, taken, "key", "name", ["at"], F.floor(F.col("at") / 1000), "given")
    assert "collect_list" not in out._jdf.queryExecution().toString()
    bad = out.filter(F.col("given") != F.concat(F.lit("k-"), (F.col("at") * 2 + 1).cast("string")))
    assert out.count() == 10_000 and bad.count() == 0


def test_numbers_of_several_keys(spark):
    rng = random.Random(1)
    taken = {(k, n) for k in "abc" for n in rng.sample(range(30), 12)}
    names = spark.createDataFrame([(k if n == 0 else f"{k}-{n}",) for k, n in taken], "name string")
    data = [(rng.choice(["a", "b", "c", "d", None]), i) for i in range(90)]
    want, used = [], {k: {n for x, n in taken if x == k} for k in "abcd"}
    for k, i in data:
        if k is not None:
            n = next(n for n in range(1000) if n not in used[k])
            used[k].add(n)
            want.append((k, i, k if n == 0 else f"{k}-{n}"))
    out = number_repeats(spark.createDataFrame(data, "k string, i int"), names, "k", "name", ["i"], F.lit(0), "given")
    assert sorted(tuple(r) for r in out.filter("k is not null").collect()) == sorted(want)
    assert out.count() == 90


def _users(spark, n=60):
    """Rows of many keys over four days; some come twice, have no key or are
    beyond what a float holds."""
    rng, start = random.Random(5), dt.datetime(2024, 1, 1)
    made = [(None if u == 3 else u, (1 << 60) + 1000 * u + i,
             start + dt.timedelta(days=rng.randrange(1 if u % 3 else 4), seconds=rng.randrange(86_400)),
             rng.choice(["view", None, "click"]), 1.0) for u in range(n) for i in range(5)]
    return spark.createDataFrame(made + made[::7], SCHEMA), made + made[::7]


@pytest.mark.parametrize("ttl", [None, 3600])
def test_state_rows_and_calls_do_not_grow_with_the_keys(spark, monkeypatch, ttl):
    monkeypatch.setattr(live, "STATE_GROUPS", 7, raising=False)
    df, made = _users(spark)
    progress = []
    # a key is in the result by its last batch; null keys leave it there
    out = live.run_to_table(live.latest_state_stream(replay(df, 3).stream(), ttl_sec=ttl, watermark=ttl and "1 minute"),
                            "groups", "update", ["user_id"], progress)
    want = {}
    for r in sorted((r for r in made if r[0] is not None), key=lambda r: (r[2], r[1])):
        want.setdefault(r[0], []).append(r)
    for u, rs in want.items():
        prev = rs[-2]
        near = ttl is None or rs[-1][2] - prev[2] <= dt.timedelta(seconds=ttl)
        want[u] = (*rs[-1][1::2][:2], *(prev[1::2][:2] if near else (None, None)))
    assert {r.user_id: tuple(r)[1:] for r in out.collect()} == want
    assert 0 < max(p["state"] for p in progress) <= 7


def test_expired_keys_of_one_group_keep_their_own_timers(spark, monkeypatch):
    monkeypatch.setattr(live, "STATE_GROUPS", 7, raising=False)
    df, made = _users(spark)
    progress = []
    out = live.expired_keys(replay(df.filter("user_id is not null"), 3).stream(), "user_id", "ts", 6 * 3600,
                            "10 minutes", progress)
    last = {}
    for u, _, ts, *_ in made:
        if u is not None:
            last[u] = max(ts, last.get(u, ts))
    end = max(last.values()) - dt.timedelta(minutes=10)
    gone = {u for u, ts in last.items() if ts + dt.timedelta(hours=6) < end}
    assert {r.key for r in out.collect()} == gone and 0 < len(gone) < len(last)
    assert 0 < max(p["state"] for p in progress) <= 7
