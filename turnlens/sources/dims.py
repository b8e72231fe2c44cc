"""Small reference dimensions.

Dimensions are read from CSV/JSON exports of the game's rules database
(``load_dimension``); the few values the parsers need to agree with the
logs are fixed values listed below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

# --- fixed values -------------------------------------------------------------
# Tech-grid column -> log era (1-based; 10 = Future).
GRIDX_TO_ERA = {1: 1, 2: 1, 3: 2, 4: 2, 5: 3, 6: 3, 7: 4, 8: 4, 9: 5, 10: 5,
                11: 6, 12: 6, 13: 7, 14: 7, 15: 8, 16: 8, 17: 9, 18: 10}
# Grid columns that close an era: completing such a column advances the era.
ERA_END_COLUMNS = (2, 4, 6, 8, 10, 12, 14, 16, 17)
# Era names in order; the stats store codes them 0-based, the logs 1-based.
ERA_NAMES = ("Ancient", "Classical", "Medieval", "Renaissance", "Industrial", "Modern",
             "Atomic", "Information", "Future")
# --- end of fixed values --------------------------------------------------------


def era_dimension(spark: SparkSession) -> DataFrame:
    """One row per era with both codes (store 0-based, log 1-based)."""
    rows = [(i, i + 1, n) for i, n in enumerate(ERA_NAMES)]
    return spark.createDataFrame(rows, "store_era int, log_era int, era_name string")


def gridx_era_dimension(spark: SparkSession) -> DataFrame:
    rows = [(g, e, g in ERA_END_COLUMNS) for g, e in sorted(GRIDX_TO_ERA.items())]
    return spark.createDataFrame(rows, "gridx int, era int, closes_era boolean")


def load_dimension(spark: SparkSession, path: str, schema: T.StructType | str,
                   fmt: str = "csv") -> DataFrame:
    """A dimension export with an explicit schema (no inference)."""
    r = spark.read.schema(schema)
    if fmt == "csv":
        return r.option("header", True).csv(path)
    return r.option("multiLine", True).json(path)


# --- rules-database dimensions (S27, J22, P20, P21) ------------------------------
# Inputs are the rule tables exported as Parquet/CSV (Technologies, Eras,
# Buildings, BuildingClasses, Units) and a (Tag, Text) localisation table.

def tech_dimension(technologies: DataFrame) -> DataFrame:
    """(tech, gridx, era) from the Technologies rule table: the grid column
    comes from the table, the log era from the fixed grid→era map (columns
    outside the map get a null era, reported by an anti join if needed)."""
    from pyspark.sql import functions as F
    spark = technologies.sparkSession
    g = F.broadcast(gridx_era_dimension(spark).select("gridx", "era"))
    t = technologies.select(F.col("Type").alias("tech"), F.col("GridX").cast("int").alias("gridx"))
    return t.join(g, "gridx", "left").select("tech", "gridx", "era")


def _text(df: DataFrame, key: str, text: DataFrame, out: str, keep_key: bool = True) -> DataFrame:
    from pyspark.sql import functions as F
    # the localisation table has no size bound: the optimizer picks the join
    t = text.select(F.col("Tag").alias("__tag"), F.col("Text").alias("__txt"))
    j = df.join(t, df[key] == t["__tag"], "left")
    val = F.coalesce("__txt", F.col(key)) if keep_key else F.col("__txt")
    return j.withColumn(out, val).drop("__tag", "__txt")


def wonder_eras(building_classes: DataFrame, buildings: DataFrame, technologies: DataFrame,
                eras: DataFrame, text: DataFrame) -> DataFrame:
    """J22 + P21: world wonders (classes allowing one global instance) with
    the era of their prerequisite tech, names localised, " Era" stripped."""
    from pyspark.sql import functions as F
    bc = building_classes.filter(F.col("MaxGlobalInstances") == 1).select("DefaultBuilding")
    b = buildings.select(F.col("Type").alias("b_type"), "Description", "PrereqTech")
    t = technologies.select(F.col("Type").alias("t_type"), F.col("Era").alias("t_era"))
    e = eras.select(F.col("Type").alias("e_type"), F.col("Description").alias("EraDescription"))
    j = (bc.join(b, bc.DefaultBuilding == b.b_type).join(t, b.PrereqTech == t.t_type)
         .join(e, F.col("t_era") == e.e_type))
    j = _text(j, "Description", text, "Name", keep_key=False)
    j = _text(j, "EraDescription", text, "EraText", keep_key=False)
    return j.select("Name", F.regexp_replace("EraText", r"\s+Era$", "").alias("Era"))


def unit_info(units: DataFrame, technologies: DataFrame, eras: DataFrame, text: DataFrame,
              unique_units: DataFrame | None = None) -> DataFrame:
    """P20 + P21: per unit: localised name, era of its prerequisite tech
    (Ancient when it has none), combat class, domain, and the derived flags
    is_unique, is_ranged (ranged strength > 0), is_mounted (mounted flag or
    mounted combat class) and is_combat (melee or ranged strength)."""
    from pyspark.sql import functions as F
    t = technologies.select(F.col("Type").alias("t_type"), F.col("Era").alias("t_era"))
    e = eras.select(F.col("Type").alias("e_type"), F.col("Description").alias("EraDescription"))
    j = (units.join(t, units.PrereqTech == t.t_type, "left")
         .join(e, F.col("t_era") == e.e_type, "left"))
    j = _text(j, "Description", text, "unit")
    j = _text(j, "EraDescription", text, "era_text")
    era = F.when(F.col("EraDescription").isNull(), F.lit("Ancient")).otherwise(
        F.regexp_replace("era_text", r"\s+Era$", ""))
    j = j.withColumn("era", era)
    if unique_units is not None:
        j = j.join(unique_units.select(F.col("Type").alias("__u")).distinct(),
                   F.col("Type") == F.col("__u"), "left").withColumn(
            "is_unique", F.col("__u").isNotNull().cast("int")).drop("__u")
    else:
        j = j.withColumn("is_unique", F.lit(0))
    return j.select(
        "unit", "era", F.col("CombatClass").alias("combat_class"), F.col("Domain").alias("domain"),
        "is_unique",
        (F.coalesce("RangedCombat", F.lit(0)) > 0).cast("int").alias("is_ranged"),
        ((F.col("IsMounted") == 1) | (F.col("CombatClass") == "UNITCOMBAT_MOUNTED"))
        .cast("int").alias("is_mounted"),
        ((F.coalesce("Combat", F.lit(0)) > 0) | (F.coalesce("RangedCombat", F.lit(0)) > 0))
        .cast("int").alias("is_combat"))
