"""Dimensions from hand-made rule tables, and facet eligibility."""

from pyspark.sql import functions as F

from turnlens.operators import keyed
from turnlens.sources import rules


def _text(spark):
    return spark.createDataFrame([("T_ROME", "Rome"), ("T_FORGE", "Forge"), ("T_TATARA", "Tatara"),
                                  ("T_PETRA", "Petra"), ("T_CIRCUS", "Circus"), ("T_HQ", "Trading HQ"),
                                  ("T_OFFICE", "Office"), ("T_PAGODA", "Pagoda"), ("T_CLASSICAL", "Classical Era"),
                                  ("T_LEGION", "Legion"), ("T_SWORD", "Swordsman")], "Tag string, Text string")


def test_civ_flavors_and_list(spark):
    civs = rules.civ_list(spark.createDataFrame(
        [("CIVILIZATION_ROME", "T_ROME"), ("CIVILIZATION_MINOR", "x"), ("CIVILIZATION_BARBARIAN", "y")],
        "Type string, ShortDescription string"), _text(spark))
    assert [tuple(r) for r in civs.collect()] == [("CIVILIZATION_ROME", "Rome")]
    flavors = spark.createDataFrame([("L1", "FLAVOR_GOLD", 5), ("L2", "FLAVOR_GOLD", 3), ("L3", "FLAVOR_GOLD", 1)],
                                    "LeaderType string, FlavorType string, Flavor int")
    biases = spark.createDataFrame([("L1", "WAR", 7)], "LeaderType string, MajorCivApproachType string, Bias int")
    leaders = spark.createDataFrame([("CIVILIZATION_ROME", "L1"), ("CIVILIZATION_ROME", "L2"),
                                     ("CIVILIZATION_MINOR", "L3")], "CivilizationType string, LeaderheadType string")
    got = sorted(map(tuple, rules.civ_flavors(flavors, biases, leaders, civs).collect()))
    assert got == [("Rome", "FLAVOR_GOLD", 3), ("Rome", "WAR", 7)]


def test_unique_units(spark):
    over = spark.createDataFrame([("CIVILIZATION_ROME", "C_SWORD", "U_LEGION"), ("CIVILIZATION_ROME", "C_NONE", "U_ODD"),
                                  ("CIVILIZATION_MINOR", "C_SWORD", "U_ODD"), ("CIVILIZATION_ROME", "C_SWORD", None)],
                                 "CivilizationType string, UnitClassType string, UnitType string")
    classes = spark.createDataFrame([("C_SWORD", "U_SWORD"), ("C_NONE", None)], "Type string, DefaultUnit string")
    units = spark.createDataFrame([("U_LEGION", "T_LEGION"), ("U_SWORD", "T_SWORD"), ("U_ODD", "T_ODD")],
                                  "Type string, Description string")
    pairs = rules.unique_units(over, classes, units, _text(spark))
    assert sorted(map(tuple, pairs.collect())) == [("None", "T_ODD"), ("Swordsman", "Legion")]
    assert {r.base: r.uniques for r in rules.replacements(pairs).collect()} == {
        "None": ["T_ODD"], "Swordsman": ["Legion"]}


def _buildings(spark):
    classes = spark.createDataFrame(
        [("C_FORGE", "B_FORGE", -1, -1), ("C_PETRA", "B_PETRA", 1, -1), ("C_CIRCUS", "B_CIRCUS", -1, 1),
         ("C_HQ", "B_HQ", 1, -1), ("C_OFFICE", "B_OFFICE", -1, -1), ("C_PAGODA", "B_PAGODA", -1, -1)],
        "Type string, DefaultBuilding string, MaxGlobalInstances int, MaxPlayerInstances int")
    b = spark.createDataFrame(
        [("B_FORGE", "C_FORGE", "T_FORGE", "TECH_IRON", 0, None), ("B_TATARA", "C_FORGE", "T_TATARA", "TECH_IRON", 0, None),
         ("B_PETRA", "C_PETRA", "T_PETRA", "TECH_IRON", 0, 0), ("B_PETRA2", "C_PETRA", "T_PETRA2", None, 0, 0),
         ("B_CIRCUS", "C_CIRCUS", "T_CIRCUS", None, 0, 0), ("B_HQ", "C_HQ", "T_HQ", None, 0, 0),
         ("B_OFFICE", "C_OFFICE", "T_OFFICE", None, 0, 0), ("B_PAGODA", "C_PAGODA", "T_PAGODA", None, 1, 200)],
        "Type string, BuildingClass string, Description string, PrereqTech string, UnlockedByBelief int, FaithCost int")
    return classes, b


def test_building_flags_kinds_and_eligibility(spark):
    classes, b = _buildings(spark)
    tech = spark.createDataFrame([("TECH_IRON", "ERA_CLASSICAL")], "Type string, Era string")
    eras = spark.createDataFrame([("ERA_CLASSICAL", "T_CLASSICAL")], "Type string, Description string")
    corp = spark.createDataFrame([("C_HQ", "C_OFFICE")], "HeadquartersBuildingClass string, OfficeBuildingClass string")
    info = rules.building_info(b, classes, tech, eras, corp, _text(spark))
    got = {r.building: (r.era, r.is_world_wonder, r.is_national_wonder, r.is_religious, r.is_corp_hq,
                        r.is_corp_office) for r in info.collect()}
    f = False
    assert got == {"Forge": ("Classical", f, f, f, f, f), "Tatara": ("Classical", f, f, f, f, f),
                   "Petra": ("Classical", True, f, f, f, f), "T_PETRA2": ("Ancient", True, f, f, f, f),
                   "Circus": ("Ancient", f, True, f, f, f), "Trading HQ": (None, f, f, f, True, f),
                   "Office": (None, f, f, f, f, True), "Pagoda": (None, f, f, True, f, f)}
    pairs = rules.unique_buildings(classes, b, _text(spark))
    assert [tuple(r) for r in pairs.collect()] == [("Forge", "Tatara")]
    kinds = rules.building_kind(info, pairs)
    chosen = spark.createDataFrame(
        [("regular classical", ["regular"], ["Classical"]), ("religious", ["rel"], []), ("none", [], ["Classical"]),
         ("wonders", ["ww", "unique"], ["Ancient", "Classical"])], "rule string, kind array<string>, era array<string>")
    found = keyed.facet_matches(kinds, "building", {"kind": F.col("kinds"), "era": F.col("era")}, chosen,
                                null_always=["era"])
    assert sorted(map(tuple, found.select("rule", "building").collect())) == [
        ("regular classical", "Forge"), ("religious", "Pagoda"), ("wonders", "Petra"), ("wonders", "T_PETRA2"),
        ("wonders", "Tatara")]
    assert keyed.eligible(kinds, "building", {"kind": F.col("kinds"), "era": F.col("era")}, chosen, ["era"]).count() == 5


def test_beliefs_wonders_and_unit_categories(spark):
    bel = spark.createDataFrame([(1, "T_FORGE", 1, 0, 0, 0, 0), (2, "x", 0, 0, 1, 0, 0), (3, "y", 0, 0, 0, 0, 0)],
                                "ID int, ShortDescription string, Pantheon int, Founder int, Follower int, "
                                "Enhancer int, Reformation int")
    assert sorted(map(tuple, rules.beliefs(bel, _text(spark)).collect())) == [
        (1, "Forge", "Pantheon"), (2, "x", "Follower"), (3, "y", None)]
    w = spark.createDataFrame([(" Petra ", "Classical"), ("Grand Canal", "Modern"), ("", "Ancient"), ("Odd", " ")],
                              "Name string, Era string")
    got = {r.Name: r.Era for r in rules.wonder_eras(w).collect()}
    assert got["Petra"] == "Classical" and got["Grand Canal"] == "Renaissance" and "Odd" not in got
    assert len(got) == 1 + len(rules.WONDER_ERA_OVERRIDES)
    u = spark.createDataFrame(
        [("Archer", "DOMAIN_LAND", 1, 0, 1), ("Knight", "DOMAIN_LAND", 0, 1, 1), ("Frigate", "DOMAIN_SEA", 1, 0, 1),
         ("Bomber", "DOMAIN_AIR", 1, 0, 1), ("Worker", "DOMAIN_LAND", 0, 0, 0), ("Spear", "Land", 0, 0, 1)],
        "unit string, domain string, is_ranged int, is_mounted int, is_combat int")
    assert {r.unit: r.category for r in rules.unit_categories(u).collect()} == {
        "Archer": "ranged_infantry", "Knight": "melee_cavalry", "Frigate": "ranged_naval", "Bomber": "air",
        "Worker": "non_combat", "Spear": "melee_infantry"}
