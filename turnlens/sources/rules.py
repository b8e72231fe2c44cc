"""Dimensions built from the exported rule tables.

Inputs are frames of the game's rules database under its own column names and
a (Tag, Text) localisation table; a tag without text keeps its code. Each
function returns one tidy dimension."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from turnlens.operators import keyed
from turnlens.sources.dims import _text

# --- fixed values -------------------------------------------------------------
# Civilizations that are no players.
NO_PLAYERS = ("CIVILIZATION_MINOR", "CIVILIZATION_BARBARIAN")
# World wonders whose era differs from that of their prerequisite tech.
WONDER_ERA_OVERRIDES = {
    "Grand Canal": "Renaissance", "Crystal Palace": "Modern", "Menin Gate": "Modern",
    "Olympic Village": "Atomic", "United Nations": "Atomic", "International Space Station": "Information",
}
# Faith cost up to which a building unlocked by a belief counts as religious.
RELIGIOUS_FAITH_COST = 250
# Unit domains and combat classes by name.
DOMAINS = {"DOMAIN_LAND": "Land", "DOMAIN_SEA": "Sea", "DOMAIN_AIR": "Air", "DOMAIN_HOVER": "Hover"}
# --- end of fixed values --------------------------------------------------------


def civ_list(civilizations: DataFrame, text: DataFrame) -> DataFrame:
    """(tag, civ) of the civilizations that can be played."""
    players = civilizations.filter(~F.col("Type").isin(*NO_PLAYERS))
    return _text(players, "ShortDescription", text, "civ").select(F.col("Type").alias("tag"), "civ")


def civ_flavors(leader_flavors: DataFrame, approach_biases: DataFrame, civ_leaders: DataFrame,
                civs: DataFrame) -> DataFrame:
    """(civ, flavor_type, flavor): leader flavors and approach biases of
    every playable civ; a civ with several leaders takes the smallest value."""
    both = leader_flavors.select("LeaderType", F.col("FlavorType").alias("flavor_type"),
                                 F.col("Flavor").alias("flavor")).unionByName(
        approach_biases.select("LeaderType", F.col("MajorCivApproachType").alias("flavor_type"),
                               F.col("Bias").alias("flavor")))
    leaders = civ_leaders.filter(~F.col("CivilizationType").isin(*NO_PLAYERS))
    j = both.join(leaders, both.LeaderType == leaders.LeaderheadType).join(
        civs.select(F.col("tag").alias("CivilizationType"), "civ"), "CivilizationType", "left")
    return j.groupBy("civ", "flavor_type").agg(F.min("flavor").alias("flavor"))


def unique_units(overrides: DataFrame, unit_classes: DataFrame, units: DataFrame, text: DataFrame) -> DataFrame:
    """(base, unique): the unit of a civ and the unit it replaces; base
    "None" where the class has no default unit."""
    o = overrides.filter(F.col("UnitType").isNotNull() & ~F.col("CivilizationType").isin(*NO_PLAYERS))
    named = lambda out: _text(units.select(F.col("Type").alias(f"{out}_type"), "Description"),
                              "Description", text, out).select(f"{out}_type", out)
    cls = unit_classes.select(F.col("Type").alias("UnitClassType"), "DefaultUnit")
    j = o.join(cls, "UnitClassType").join(named("unique"), F.col("UnitType") == F.col("unique_type")) \
        .join(named("base"), F.col("DefaultUnit") == F.col("base_type"), "left")
    return j.select(F.coalesce("base", F.lit("None")).alias("base"), "unique").distinct()


def unique_buildings(building_classes: DataFrame, buildings: DataFrame, text: DataFrame) -> DataFrame:
    """(base, unique) of the buildings of a class that are not its
    default, an equi self join with an inequality; world wonders have none."""
    named = _text(buildings.select("Type", "BuildingClass", "Description"), "Description", text, "name")
    cls = building_classes.filter(F.coalesce("MaxGlobalInstances", F.lit(-1)) != 1).select(
        F.col("Type").alias("BuildingClass"), "DefaultBuilding")
    base = cls.join(named.select(F.col("Type").alias("DefaultBuilding"), F.col("name").alias("base")),
                    "DefaultBuilding")
    other = named.select(F.col("BuildingClass").alias("__class"), F.col("Type").alias("__type"),
                         F.col("name").alias("unique"))
    return keyed.equi_with_residual(base, other.withColumnRenamed("__class", "BuildingClass"), ["BuildingClass"],
                                    F.col("__type") != F.col("DefaultBuilding")).select("base", "unique")


def replacements(pairs: DataFrame) -> DataFrame:
    """(base, sorted names of what replaces it): the shape of the exports."""
    return pairs.groupBy("base").agg(F.sort_array(F.collect_set("unique")).alias("uniques"))


def beliefs(belief_rules: DataFrame, text: DataFrame) -> DataFrame:
    """(id, belief, category): the category is the first flag set."""
    kinds = ("Pantheon", "Founder", "Follower", "Enhancer", "Reformation")
    category = F.coalesce(*[F.when(F.col(k) == 1, F.lit(k)) for k in kinds])
    return _text(belief_rules, "ShortDescription", text, "belief").select(
        F.col("ID").alias("id"), "belief", category.alias("category"))


def _corporate(corporations: DataFrame, building_classes: DataFrame, column: str) -> DataFrame:
    cls = building_classes.select(F.col("Type").alias(column), F.col("DefaultBuilding").alias("Type"))
    return corporations.select(column).join(cls, column).select("Type").filter("Type is not null").distinct()


def building_info(buildings: DataFrame, building_classes: DataFrame, technologies: DataFrame, eras: DataFrame,
                  corporations: DataFrame, text: DataFrame) -> DataFrame:
    """P20 + P21: (building, era, is_world_wonder, is_national_wonder,
    is_religious, is_corp_hq, is_corp_office). The era is that of the
    prerequisite tech; without one, buildings of a belief or a corporation
    have no era and all others are Ancient. A headquarters exists once in a
    game but is no world wonder."""
    t = technologies.select(F.col("Type").alias("PrereqTech"), F.col("Era").alias("__era"))
    e = eras.select(F.col("Type").alias("__era"), F.col("Description").alias("EraDescription"))
    c = building_classes.select(F.col("Type").alias("BuildingClass"), "MaxGlobalInstances", "MaxPlayerInstances")
    flag = lambda col, out: _corporate(corporations, building_classes, col).withColumn(out, F.lit(True))
    j = (buildings.join(c, "BuildingClass", "left").join(t, "PrereqTech", "left").join(e, "__era", "left")
         .join(flag("HeadquartersBuildingClass", "is_corp_hq"), "Type", "left")
         .join(flag("OfficeBuildingClass", "is_corp_office"), "Type", "left")
         .fillna(False, ["is_corp_hq", "is_corp_office"]))
    j = _text(_text(j, "Description", text, "building"), "EraDescription", text, "__era_text")
    once, each = F.coalesce("MaxGlobalInstances", F.lit(-1)) == 1, F.coalesce("MaxPlayerInstances", F.lit(-1)) == 1
    belief = F.coalesce("UnlockedByBelief", F.lit(0)) == 1
    era = F.when(F.col("EraDescription").isNotNull(), F.regexp_replace("__era_text", r"\s+Era$", "")) \
        .when(belief | F.col("is_corp_hq") | F.col("is_corp_office"), F.lit(None)).otherwise(F.lit("Ancient"))
    return j.select("building", era.alias("era"), (once & ~F.col("is_corp_hq")).alias("is_world_wonder"),
                    (each & ~once).alias("is_national_wonder"),
                    (belief & (F.coalesce("FaithCost", F.lit(0)) <= RELIGIOUS_FAITH_COST)).alias("is_religious"),
                    "is_corp_hq", "is_corp_office")


def building_kind(info: DataFrame, uniques: DataFrame) -> DataFrame:
    """The facet values of P28 per building: world wonder, national wonder,
    religious, unique and regular (none of the others); corporation buildings
    have none. ``uniques``: one column ``unique``."""
    u = uniques.select(F.col("unique").alias("building")).distinct().withColumn("__u", F.lit(True))
    j = info.join(u, "building", "left").withColumn("__u", F.coalesce("__u", F.lit(False)))
    corp = F.col("is_corp_hq") | F.col("is_corp_office")
    marks: list[tuple[str, Column]] = [
        ("ww", F.col("is_world_wonder")), ("nw", F.col("is_national_wonder")), ("rel", F.col("is_religious")),
        ("unique", F.col("__u"))]
    none = ~(F.col("is_world_wonder") | F.col("is_national_wonder") | F.col("is_religious") | F.col("__u"))
    kinds = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in [*marks, ("regular", none)]]), lambda x: x.isNotNull())
    return j.withColumn("kinds", F.when(corp, F.array().cast("array<string>")).otherwise(kinds)).drop("__u")


def wonder_eras(wonders: DataFrame, overrides: Mapping[str, str] = WONDER_ERA_OVERRIDES) -> DataFrame:
    """S24 + P22: (Name, Era) of the world wonders, trimmed, blanks dropped,
    with the overrides applied on top."""
    d = wonders.select(F.trim("Name").alias("Name"), F.trim("Era").alias("Era")).filter("Name <> '' and Era <> ''")
    o = wonders.sparkSession.createDataFrame(list(overrides.items()), "Name string, Era string")
    return keyed.override_dimension(d.dropDuplicates(["Name"]), o, "Name", "Era")


def unit_categories(units: DataFrame) -> DataFrame:
    """The colour category of each unit of :func:`dims.unit_info`."""
    ranged, mounted = F.col("is_ranged") == 1, F.col("is_mounted") == 1
    domain = F.coalesce(*[F.when(F.col("domain").isin(code, name), F.lit(name)) for code, name in DOMAINS.items()],
                        F.col("domain"))
    side = lambda kind: F.when(ranged, F.lit(f"ranged_{kind}")).otherwise(F.lit(f"melee_{kind}"))
    category = (F.when(F.col("is_combat") != 1, F.lit("non_combat")).when(domain == "Air", F.lit("air"))
                .when(domain == "Sea", side("naval")).when(mounted, side("cavalry")).otherwise(side("infantry")))
    return units.withColumn("domain", domain).withColumn("category", category)
