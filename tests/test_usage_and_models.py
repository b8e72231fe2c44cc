"""Nested usage logs and one model per period."""

import json

import pytest
from pyspark.sql import functions as F

from turnlens.operators import ml
from turnlens.sources import usage_log


def test_usage_of_nested_logs(spark):
    logs = {"logs": [
        {"kind": "request", "time": "2024-05-01T10:00:05Z", "metadata": {
            "startTime": "2024-05-01T10:00:00Z", "endTime": "2024-05-01T11:02:03.500Z",
            "usage": {"prompt_tokens": 100, "completion_tokens": 7, "prompt_tokens_details": {"cached_tokens": 40}}}},
        {"kind": "toolCall", "time": "2024-05-01T09:59:00+00:00",
         "metadata": {"startTime": "2020-01-01T00:00:00Z", "usage": {"prompt_tokens": 5}}},
        {"kind": "request", "time": "not a time", "metadata": {"usage": {"prompt_tokens": None}}},
        {"kind": "request"}, {"kind": "note", "time": None}]}
    files = spark.createDataFrame([("a", json.dumps(logs)), ("b", '{"logs": []}'), ("c", "no json"), ("d", None),
                                   ("e", '{"logs": [{"kind": "toolCall"}]}')], "file string, text string")
    rows = usage_log.entries(files, "file", "text")
    assert rows.filter("file = 'a'").count() == 5 and rows.filter("file in ('b', 'c', 'd')").count() == 0
    got = {r.file: r for r in usage_log.usage(rows).collect()}
    a = got["a"]
    assert (a.n_requests, a.n_tool_calls, a.total_input_tokens, a.cached_input_tokens, a.input_tokens,
            a.output_tokens) == (3, 1, 100, 40, 60, 7)
    assert a.span == "1h 3m 3s" and a.span_sec == 3783.5 and got["e"].span == "n/a"


@pytest.mark.parametrize(("seconds", "text"), [(0, "0s"), (59, "59s"), (60, "1m 0s"), (3600, "1h 0m 0s"), (-5, "0s")])
def test_duration(spark, seconds, text):
    assert spark.range(1).select(usage_log.duration(F.lit(float(seconds)))).first()[0] == text


def test_period_features_run_on_and_join_attributes(spark):
    facts = spark.createDataFrame([("a", 1, 2.0), ("a", 3, 5.0), ("b", 2, 1.0)], "who string, era int, v double")
    attrs = spark.createDataFrame([("a", 7.0)], "who string, strength double")
    out = ml.period_features(facts, ["who"], "era", {"v": F.col("v")}, attrs, ["who"])
    assert sorted(tuple(r) for r in out.select("who", "era", "f_v", "strength").collect()) == [
        ("a", 1, 2.0, 7.0), ("a", 2, 2.0, 7.0), ("a", 3, 7.0, 7.0), ("b", 2, 1.0, 0.0), ("b", 3, 1.0, 0.0)]


def test_one_model_per_period(spark):
    """The label follows another feature in each period; period 3 has one
    class only. Games never straddle the split; winners come from its test side."""
    rows = []
    for game in range(60):
        for civ in range(4):
            x, y = (game * 7 + civ * 3) % 4, (game * 5 + civ) % 4
            rows += [(1, game, game * 4 + civ, float(x), float(y), float(x == 3)),
                     (2, game, game * 4 + civ, float(x), float(y), float(y == 3)),
                     (3, game, game * 4 + civ, float(x), float(y), 0.0)]
    df = spark.createDataFrame(rows, "period int, game long, id long, x double, y double, label double")
    split = ml.group_split(df, "game", 75, 42)
    assert split.groupBy("game").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    scores, importance = ml.gbt_per_period(split, "period", "label", ["x", "y"], "game", "id", max_iter=3, max_depth=2)
    weight = {(r.period, r.feature): r.weight for r in importance.collect()}
    assert set(weight) == {(p, f) for p in (1, 2) for f in "xy"}
    assert weight[1, "x"] > 0.9 and weight[2, "y"] > 0.9
    test = split.filter("split = 'test'").select("game").distinct()
    assert scores.join(test, "game", "left_anti").count() == 0
    assert scores.count() == 2 * 4 * test.count()
    top = scores.filter("is_group_top = 1")
    assert top.count() == 2 * test.count()
    right = scores.filter("(p_win >= 0.5) = (label = 1)").count()
    assert right >= 0.95 * scores.count()
