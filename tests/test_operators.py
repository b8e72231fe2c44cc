"""Per-operator unit tests on hand-made frames."""

import pytest
from pyspark.sql import functions as F

from turnlens.operators import aggregate as agg
from turnlens.operators import keyed, quality, rank, reshape, share


@pytest.fixture(scope="module")
def picks(spark):
    rows = [(1, "Rome", 10, 5.0, 1), (1, "Rome", 12, 9.0, 2), (1, "Egypt", 10, 9.0, 3),
            (2, "Rome", 3, 1.0, 4), (2, "Greece", 3, 1.0, 5), (2, "Greece", 8, 7.0, 6)]
    return spark.createDataFrame(rows, "game int, civ string, turn int, score double, id int")


def test_first_last_and_extremes(spark, picks):
    f = {r["game"]: (r["first_civ"], r["first_turn"])
         for r in rank.first_per_group(picks, ["game"], ["turn", "id"], ["civ", "turn"]).collect()}
    assert f == {1: ("Rome", 10), 2: ("Rome", 3)}
    last = {r["game"]: r["last_id"]
            for r in rank.last_per_group(picks, ["game"], ["turn", "id"], ["id"]).collect()}
    assert last == {1: 2, 2: 6}
    ties = rank.rows_at_group_extreme(picks, ["game"], "turn", "min")
    assert sorted(r["id"] for r in ties.collect()) == [1, 3, 4, 5]     # ties kept


def test_top_k_and_argmax(spark, picks):
    top = rank.top_k_per_group(picks, ["game"], [F.col("score").desc(), F.col("id")], 1)
    assert sorted(r["id"] for r in top.collect()) == [2, 6]
    flag = {r["id"]: r["is_top"] for r in rank.flag_group_argmax(picks, ["game"], "score", "id")
            .collect()}
    assert flag == {1: 0, 2: 1, 3: 0, 4: 0, 5: 0, 6: 1}               # 2 beats 3 on id


def test_finishing_place_dead_fill_bottom_and_ties_average(spark):
    rows = [(1, "A", 900, False, 0), (1, "B", 900, False, 0), (1, "C", 500, False, 0),
            (1, "D", 0, True, 40), (1, "E", 0, True, 20)]
    df = spark.createDataFrame(rows, "g int, civ string, score int, dead boolean, death int")
    p = {r["civ"]: r["place"] for r in rank.finishing_place(df, "g", "civ", "score", "dead",
                                                            "death").collect()}
    # living by score (A, B tie → 1.5), the dead at the bottom, earliest death last
    assert p == {"A": 1.5, "B": 1.5, "C": 3.0, "D": 4.0, "E": 5.0}


def test_rank_two_versions_full_outer(spark):
    a = spark.createDataFrame([("Rome", 0.6), ("Egypt", 0.5)], "civ string, v double")
    b = spark.createDataFrame([("Egypt", 0.7), ("Greece", 0.1)], "civ string, v double")
    r = {x["civ"]: (x["rank_a"], x["rank_b"], x["rank_delta"])
         for x in rank.rank_two_versions(a, b, "civ", "v").collect()}
    assert r == {"Rome": (1, None, None), "Egypt": (2, 1, 1), "Greece": (None, 2, None)}


def test_shares(spark):
    df = spark.createDataFrame([("a", "x", 1.0), ("a", "y", 3.0), ("b", "x", 2.0)],
                               "g string, c string, v double")
    s = {(r["g"], r["c"]): r["share"] for r in share.share_within(df, ["g"], "v").collect()}
    assert s == {("a", "x"): 0.25, ("a", "y"): 0.75, ("b", "x"): 1.0}
    cat = share.category_share(df.groupBy("c").agg(F.sum("v").alias("v")), "v")
    cum = {r["c"]: (r["share"], r["cum_share"], r["start"])
           for r in share.cumulative_share(cat, ["c"], "share").collect()}
    assert cum == {"x": (0.5, 0.5, 0.0), "y": (0.5, 1.0, 0.5)}


def test_reshapes(spark):
    df = spark.createDataFrame([("r1", "a", 1), ("r1", "b", 2), ("r2", "a", 5)],
                               "row string, col string, v int")
    pc = {r["row"]: (r["n_a"], r["n_b"], r["n_c"])
          for r in reshape.pivot_count(df, ["row"], "col", ["a", "b", "c"]).collect()}
    assert pc == {"r1": (1, 1, 0), "r2": (1, 0, 0)}
    wide = reshape.pivot_agg(df, ["row"], "col", ["a", "b"], F.sum("v"), "s_", fill=0)
    long = reshape.unpivot(wide, ["row"], {"s_a": "a", "s_b": "b"}, "col", "v")
    assert sorted(tuple(r) for r in long.collect()) == [("r1", "a", 1), ("r1", "b", 2),
                                                         ("r2", "a", 5), ("r2", "b", 0)]
    grid = reshape.complete_grid(df, "row", "col", ["a", "b", "c"], F.sum("v"), "v")
    assert grid.count() == 6 and grid.filter("v = 0").count() == 3
    flags = spark.createDataFrame([("k", 1, 2.5, 3)], "k string, flag int, val double, n long")
    op = reshape.owner_flag_pivot(flags, ["k"], "flag", "val", "n").first()
    assert (op["val_0"], op["val_1"], op["n_0"], op["n_1"]) == (0.0, 2.5, 0, 3)


def test_keyed_ops(spark):
    picks = spark.createDataFrame([(1, "Rome"), (1, "Egypt"), (2, "Rome")], "g int, civ string")
    winners = spark.createDataFrame([(1, "Egypt")], "g int, winner string")
    w = {(r["g"], r["civ"]): r["is_winner"]
         for r in keyed.winner_join(picks, winners, ["g"], "civ", "winner").collect()}
    assert w == {(1, "Rome"): False, (1, "Egypt"): True, (2, "Rome"): False}
    a = spark.createDataFrame([(1,), (2,)], "k int")
    b = spark.createDataFrame([(2,), (3,)], "k int")
    ops = sorted((r["op"], r["k"]) for r in keyed.key_set_ops(a, b).collect())
    assert ops == [("except", 1), ("intersect", 2), ("union", 1), ("union", 2), ("union", 3)]
    d = spark.createDataFrame([("aa", 1)], "key string, id long")
    full = keyed.mint_ids(d, spark.createDataFrame([("cc",), ("bb",), ("aa",)], "key string"),
                          "key", "id")
    assert sorted(tuple(r) for r in full.collect()) == [("aa", 1), ("bb", 2), ("cc", 3)]
    docs = spark.createDataFrame([(3, "x"), (1, "x"), (2, "y")], "doc_id long, text string")
    dd = sorted((r["kept_doc_id"], r["n_copies"])
                for r in keyed.exact_content_dedup(docs, "text", "doc_id").collect())
    assert dd == [(1, 2), (2, 1)]
    j = keyed.join_on_common(spark.createDataFrame([(1, "a", 5)], "g int, c string, x int"),
                             spark.createDataFrame([(1, "a", 7)], "g int, c string, y int"))
    assert tuple(j.first()) == (1, "a", 5, 7)


def test_grouped_measures(spark):
    ev = spark.createDataFrame([(1, "view", 1), (1, "buy", 2), (1, "view", 3), (2, "buy", 1)],
                               "u int, t string, ts int")
    path = {r["u"]: r["path"] for r in agg.ordered_string_agg(ev, ["u"], "t", ["ts"]).collect()}
    assert path == {1: "view|buy", 2: "buy"}
    sig = {r["u"]: r["signature"] for r in agg.set_signature(ev, ["u"], "t").collect()}
    assert sig == {1: "buy|view", 2: "buy"}
    ct = agg.count_if_crosstab(ev, ["u"], "t", ["view"]).orderBy("u").collect()
    assert [(r["n"], r["n_view"], r["n_rest"]) for r in ct] == [(3, 2, 1), (1, 0, 1)]
    vals = spark.createDataFrame([("g", float(v)) for v in range(11)], "g string, v double")
    h = {r["bin"]: r["n"] for r in agg.histogram(vals, "g", "v", 5).collect()}
    assert h == {1: 2, 2: 2, 3: 2, 4: 2, 5: 3}                   # max lands in the last bin
    q = agg.grouped_exact_quantiles(vals, ["g"], "v", [0.0, 0.25, 0.5, 1.0]).first()
    assert (q["q_0"], q["q_1"], q["q_2"], q["q_3"]) == (0.0, 2.5, 5.0, 10.0)
    spine = spark.createDataFrame([(1, 0, t) for t in range(4)], "u int, era int, turn int")
    facts = spark.createDataFrame([(1, 0, 8.0)], "u int, era int, v double")
    td = agg.true_denominator_mean(facts, spine, ["u"], ["era"], "turn", "v").first()
    assert (td["mean_per_turn"], td["n_entities"]) == (2.0, 1)
    pres = agg.presence_list(spark.createDataFrame([("y", "b1", 0.0), ("y", "b2", 1.0)],
                                                   "y string, b string, m double"),
                             ["y"], "b", ["m"]).first()
    assert list(pres["items"]) == ["b2"]


def test_quality_ops(spark):
    lines = spark.createDataFrame([("f", 0, "ok"), ("f", 1, "###"), ("f", 2, "$$")],
                                  "file string, n int, line string")
    a = quality.parse_audit(lines, ["file"], "n", "line", ~F.col("line").rlike(r"\p{L}")).first()
    assert (a["n_lines"], a["n_bad"], a["first_bad_line_no"], a["first_bad_line"]) == \
        (3, 2, 1, "###")
    dim = spark.createDataFrame([("a",)], "k string")
    facts = spark.createDataFrame([("a",), ("b",), ("b",)], "k string")
    assert [r["k"] for r in quality.unknown_keys(facts, dim, "k").collect()] == ["b"]
    ev = spark.createDataFrame([(1, 1), (1, 5), (2, 3)], "e int, t int")
    assert sorted(r["e"] for r in quality.drop_left_censored(ev, ["e"], "t", 2).collect()) == [1, 1]
    assert [r["e"] for r in quality.degenerate_entities(
        spark.createDataFrame([(1, 0), (1, 0), (2, 0), (2, 1)], "e int, era int"), ["e"], "era")
        .collect()] == [1]
    with pytest.raises(quality.RowCountMismatch):
        quality.assert_row_count(ev, 2, "events")
