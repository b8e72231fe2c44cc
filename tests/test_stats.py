"""Statistics operators against direct numpy / closed-form computations."""

import math

import numpy as np
from pyspark.sql import functions as F

from turnlens.operators import fold, stats
from turnlens.operators.aggregate import exact_quantile


def test_kde_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    a = np.round(rng.normal(50, 10, 300), 1)
    b = np.round(rng.normal(20, 3, 200), 1)
    rows = [("a", float(x)) for x in a] + [("b", float(x)) for x in b] + [("c", 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    out = {(r["g"], r["grid_i"]): r["density"] for r in stats.kde_grid(df, "g", "v", 50).collect()}
    hi = max(a.max(), b.max())
    xs = np.arange(50) * (hi / 49)
    for name, s in (("a", a), ("b", b)):
        h = s.std(ddof=1) * len(s) ** (-0.2)
        dens = np.exp(-((xs[:, None] - s[None, :]) ** 2) / (2 * h * h)).sum(1) / (
            len(s) * h * math.sqrt(2 * math.pi))
        for i in range(50):
            assert abs(out[(name, i)] - round(dens[i], 8)) < 2e-8
    assert not any(k[0] == "c" for k in out)      # n < 2 is skipped


def test_chi2_sf_closed_forms():
    for x in (0.5, 3.0, 9.2):
        assert abs(stats._chi2_sf(x, 2) - math.exp(-x / 2)) < 1e-12
        assert abs(stats._chi2_sf(x, 4) - math.exp(-x / 2) * (1 + x / 2)) < 1e-12
        assert abs(stats._chi2_sf(x, 1) - math.erfc(math.sqrt(x / 2))) < 1e-12


def test_goodman_critical_value():
    # chi-square(1) quantile at 1 - 0.05/5 is 6.634897 (z at 0.995 squared)
    assert abs(stats.goodman_critical(5, 0.05) - 6.634896601) < 1e-6


def test_exact_quantile_matches_numpy(spark):
    rng = np.random.default_rng(1)
    vals = rng.normal(size=1001)
    df = spark.createDataFrame([(float(v), i) for i, v in enumerate(vals)], "v double, i long")
    for p in (0.0, 0.25, 0.5, 0.99, 1.0):
        q = exact_quantile(df, "v", p, ["i"]).first()["q"]
        assert abs(q - np.quantile(vals, p)) < 1e-12


def test_state_machine_levels_match_python_model(spark):
    rows = [(1, t, tier, step, 100 + t) for t, tier, step in
            [(1, 1, False), (2, 3, False), (3, 1, True), (4, 1, True), (5, 1, True),
             (6, 2, True), (7, 9, False)]]
    rows += [(2, 1, 1, True, 200)]
    df = spark.createDataFrame(rows, "k long, t long, tier int, step boolean, id long")
    out = {r["id"]: r["level"] for r in fold.level_state_machine(
        df, "k", ["t", "id"], "tier", "step", "id", steps_per_level=3).collect()}
    # level before each row: 1; tier 3 > 1 → 2; three steps at level 2 → 3 after t=5;
    # t=6 tier 2 ≤ 3, one step; t=7 tier 9 > 3 → 4 after
    assert [out[100 + t] for t in range(1, 8)] == [1, 1, 2, 2, 2, 3, 3]
    assert out[200] == 1


def test_bootstrap_interval_brackets_rate(spark):
    df = spark.range(0, 2000).select((F.col("id") % 2).alias("g"),
                                     ((F.col("id") % 10) < 3).alias("flag"))
    r = {x["g"]: x for x in stats.binomial_bootstrap_ci(df, "g", "flag", 300, 5).collect()}
    for g in (0, 1):
        assert r[g]["ci_lo"] < r[g]["rate"] < r[g]["ci_hi"]
        assert r[g]["ci_hi"] - r[g]["ci_lo"] < 0.1


def test_override_and_lookup(spark):
    from turnlens.operators import keyed
    dim = spark.createDataFrame([("Petra", 2), ("Pyramids", 1)], "name string, era int")
    ov = spark.createDataFrame([("Petra", 3), ("Statue", 4)], "name string, era int")
    got = {r["name"]: r["era"] for r in keyed.override_dimension(dim, ov, "name", "era").collect()}
    assert got == {"Petra": 3, "Pyramids": 1, "Statue": 4}
    facts = spark.createDataFrame([(0,), (1,), (9,)], "store_era int")
    from turnlens.sources.dims import era_dimension
    lab = keyed.lookup_label(facts, era_dimension(spark), "store_era", "store_era", "era_name")
    assert sorted(r["era_name"] for r in lab.collect()) == ["Ancient", "Classical"]


def test_grid_era_tier_labels(spark):
    from turnlens.functions.columns import grid_era_tier
    df = spark.createDataFrame([(g,) for g in (1, 2, 3, 14, 15, 16, 17, 18, 19)], "g int")
    era, tier, label = grid_era_tier("g")
    got = [tuple(r) for r in df.select("g", era, tier, label).orderBy("g").collect()]
    assert got[0] == (1, 1, 1, "Ancient T1") and got[1] == (2, 1, 2, "Ancient T2")
    assert got[2] == (3, 2, 1, "Classical T1") and got[3] == (14, 7, 2, "Atomic T2")
    assert [g[3] for g in got[4:8]] == ["Information T1", "Information T2", "Information T3",
                                        "Future"]
    assert got[8][1:] == (None, None, None)


def test_classification_metrics_and_auc(spark):
    from turnlens.operators import ml
    rows = [(1, 0.9), (1, 0.8), (0, 0.3), (0, 0.6), (1, 0.4), (0, 0.1)]
    df = spark.createDataFrame(rows, "y int, p double")
    m = ml.classification_metrics(df, "y", "p").first()
    assert m["n"] == 6 and abs(m["accuracy"] - 4 / 6) < 1e-12 and abs(m["recall"] - 2 / 3) < 1e-12
    w0 = w1 = 2.0
    s0 = sum(math.log(1 - p) for y, p in rows if y == 0)
    s1 = sum(math.log(p) for y, p in rows if y == 1)
    assert abs(m["log_loss"] - (-w0 / 3 * s0 - w1 / 3 * s1) / (w0 + w1)) < 1e-12
    assert abs(ml.area_under_roc(df, "y", "p") - 8 / 9) < 1e-9


def test_class_reweighted_probability(spark):
    from turnlens.operators import ml
    rows = [(0.9,), (0.2,), (0.5,)]
    df = spark.createDataFrame(rows, "p double")
    got = [r["p_weighted"] for r in ml.class_reweighted_probability(df, "p").collect()]
    s0, s1 = sum(1 - p for (p,) in rows), sum(p for (p,) in rows)
    exp = [(p / s1) / ((1 - p) / s0 + p / s1) for (p,) in rows]
    assert all(abs(g - e) < 1e-12 for g, e in zip(got, exp))


def test_pca_loadings_match_numpy(spark, sf_small):
    from turnlens.operators import ml
    emb = spark.read.parquet(f"{sf_small}/embeddings.parquet")
    got = ml.pca_loadings(emb, "embedding", 3).collect()
    x = np.array([list(r["embedding"]) for r in emb.select("embedding").collect()], dtype=float)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    ratio = s ** 2 / (s ** 2).sum()
    for c in range(3):
        ev = [r["explained_variance"] for r in got if r["component"] == c][0]
        assert abs(ev - ratio[c]) < 1e-6
        load = np.array([r["loading"] for r in sorted((r for r in got if r["component"] == c),
                                                      key=lambda r: r["dim"])])
        assert min(np.abs(load - vt[c]).max(), np.abs(load + vt[c]).max()) < 1e-6


def test_rules_database_dimensions(spark):
    from turnlens.sources import dims
    tech = spark.createDataFrame([("TECH_A", 1, "ERA_ANCIENT"), ("TECH_B", 3, "ERA_CLASSICAL"),
                                  ("TECH_Z", 40, "ERA_FUTURE")], "Type string, GridX int, Era string")
    td = {r["tech"]: (r["gridx"], r["era"]) for r in dims.tech_dimension(tech).collect()}
    assert td == {"TECH_A": (1, 1), "TECH_B": (3, 2), "TECH_Z": (40, None)}
    eras = spark.createDataFrame([("ERA_ANCIENT", "TXT_ANC"), ("ERA_CLASSICAL", "TXT_CLA")],
                                 "Type string, Description string")
    text = spark.createDataFrame([("TXT_ANC", "Ancient Era"), ("TXT_CLA", "Classical Era"),
                                  ("TXT_PETRA", "Petra"), ("TXT_WARRIOR", "Warrior")],
                                 "Tag string, Text string")
    bc = spark.createDataFrame([("BUILDING_PETRA", 1), ("BUILDING_GRANARY", -1)],
                               "DefaultBuilding string, MaxGlobalInstances int")
    b = spark.createDataFrame([("BUILDING_PETRA", "TXT_PETRA", "TECH_B"),
                               ("BUILDING_GRANARY", "TXT_G", "TECH_A")],
                              "Type string, Description string, PrereqTech string")
    w = [tuple(r) for r in dims.wonder_eras(bc, b, tech, eras, text).collect()]
    assert w == [("Petra", "Classical")]
    units = spark.createDataFrame(
        [("UNIT_WARRIOR", "TXT_WARRIOR", "UNITCOMBAT_MELEE", "DOMAIN_LAND", 8, 0, 0, None),
         ("UNIT_CHARIOT", "TXT_CH", "UNITCOMBAT_ARCHER", "DOMAIN_LAND", 6, 10, 1, "TECH_B"),
         ("UNIT_SETTLER", "TXT_S", None, "DOMAIN_LAND", 0, 0, 0, None)],
        "Type string, Description string, CombatClass string, Domain string, Combat int, "
        "RangedCombat int, IsMounted int, PrereqTech string")
    uq = spark.createDataFrame([("UNIT_CHARIOT",)], "Type string")
    u = {r["unit"]: r for r in dims.unit_info(units, tech, eras, text, uq).collect()}
    assert u["Warrior"]["era"] == "Ancient" and u["Warrior"]["is_combat"] == 1
    ch = u["TXT_CH"]
    assert (ch["era"], ch["is_unique"], ch["is_ranged"], ch["is_mounted"]) == ("Classical", 1, 1, 1)
    assert u["TXT_S"]["is_combat"] == 0
