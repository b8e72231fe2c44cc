"""Game-log scans and parsers (S01–S20), all as DataFrame expressions.

Logs live under ``<root>/<game_id>/<file>`` (gz or plain CSV/JSON). Line
order inside a file matters only for the ordered folds, so files are read
whole (``wholetext``: gz files are never split anyway) and exploded with
their line position; every parser is then a filter + split + cast over
lines and can be pushed into the same stage. Parsers that can meet bad rows
return ``(rows, rejects)`` instead of failing the job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from turnlens.functions.columns import contains_any, split_trim

LINES_SCHEMA = T.StructType([
    T.StructField("game_id", T.StringType()), T.StructField("file", T.StringType()),
    T.StructField("line_no", T.IntegerType()), T.StructField("line", T.StringType())])

_GAME_FROM_PATH = r".*/([^/]+)/[^/]+$"
_FILE_FROM_PATH = r".*/([^/]+)$"


IDS_PER_GLOB = 256   # brace alternatives per glob when a scan is restricted to ids


def _paths(root: str, pattern: str, game_ids: Sequence[str] | None) -> list[str]:
    """Globs; a set of ids becomes brace alternatives (in groups, so no
    single glob grows with the number of games)."""
    root = root.rstrip("/")
    if game_ids is None:
        return [f"{root}/*/{pattern}"]
    ids = sorted(set(game_ids))
    return [f"{root}/{{{','.join(ids[i:i + IDS_PER_GLOB])}}}/{pattern}"
            for i in range(0, len(ids), IDS_PER_GLOB)]


def _matching(spark: SparkSession, globs: list[str]) -> list[str]:
    """Keep only globs that match at least one file (the reader fails on a
    glob with no match); the check lists through Hadoop's file system, as
    the reader itself would."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    keep = []
    for g in globs:
        path = jvm.org.apache.hadoop.fs.Path(g)
        found = path.getFileSystem(conf).globStatus(path)
        if found is not None and len(found) > 0:
            keep.append(g)
    return keep


def scan_lines(spark: SparkSession, root: str, pattern: str,
               game_ids: Sequence[str] | None = None) -> DataFrame:
    """(game_id, file, line_no, line) for every file
    matching ``pattern`` in each game folder (F07: game id and file name come
    from ``_metadata.file_path``). ``game_ids`` restricts the listing to
    those folders. No matching file → empty typed frame (O03)."""
    paths = _matching(spark, _paths(root, pattern, game_ids))
    if not paths:
        return spark.createDataFrame([], LINES_SCHEMA)
    raw = spark.read.text(paths, wholetext=True)
    path = F.regexp_replace(F.col("_metadata.file_path"), r"\\", "/")
    files = raw.select(F.regexp_extract(path, _GAME_FROM_PATH, 1).alias("game_id"),
                       F.regexp_extract(path, _FILE_FROM_PATH, 1).alias("file"),
                       F.col("value"))
    lines = files.select("game_id", "file",
                         F.posexplode(F.split(F.regexp_replace("value", "\r", ""), "\n"))
                         .alias("line_no", "line"))
    # a trailing newline leaves one empty element; blank lines are no data
    return lines.filter(F.length(F.trim("line")) > 0)


def list_game_ids(spark: SparkSession, root: str) -> DataFrame:
    """Distinct game folders under ``root`` (only file paths are read)."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
             .load(root).select(F.regexp_replace("path", r"\\", "/").alias("p")))
    return files.select(F.regexp_extract("p", _GAME_FROM_PATH, 1).alias("game_id")).distinct()


def _fields(line: str | Column = "line") -> Column:
    return split_trim(line, ",")


# Victory types as written in the result log and their one-hot column names
# (fixed values).
VICTORY_TYPES = ["Cultural", "Diplomatic", "Domination", "Science", "Time"]
VICTORY_FLAGS = ["culture_victory", "diplomatic_victory", "domination_victory",
                 "science_victory", "time_victory"]


def game_results(lines: DataFrame) -> DataFrame:
    """S05 + P04: line 1 of the result log → (game_id, turn, victory_type,
    victory_civ) plus one-hot victory flags."""
    v = lines.filter(F.col("line_no") == 1).select("game_id", _fields().alias("f"))
    out = v.select("game_id", F.get(F.col("f"), 0).try_cast("int").alias("turn"),
                   F.get(F.col("f"), 1).alias("victory_type"), F.get(F.col("f"), 2).alias("victory_civ"))
    return out.withColumns({flag: F.when(F.col("victory_type") == t, 1).otherwise(0)
                            for t, flag in zip(VICTORY_TYPES, VICTORY_FLAGS)})


def civ_scores(lines: DataFrame) -> DataFrame:
    """Per-civ scores live in the header names; zip header and value
    lines, drop the first three columns, explode. One row per (game, civ)."""
    hv = (lines.filter(F.col("line_no") <= 1)
          .groupBy("game_id", "file")
          .agg(F.max(F.when(F.col("line_no") == 0, F.col("line"))).alias("h"),
               F.max(F.when(F.col("line_no") == 1, F.col("line"))).alias("v")))
    z = F.arrays_zip(_fields("h").alias("civ"), _fields("v").alias("score"))
    pairs = hv.select("game_id", F.posexplode(z).alias("pos", "p")).filter(F.col("pos") >= 3)
    return pairs.select("game_id", F.col("p.civ").alias("civ"),
                        F.col("p.score").try_cast("int").alias("score"))


def slot_of_winner(lines: DataFrame) -> DataFrame:
    """The winner's slot position among the civ columns (1-based)."""
    res = game_results(lines).select("game_id", "victory_civ")
    hv = lines.filter(F.col("line_no") == 0).select("game_id", _fields().alias("h"))
    civs = hv.select("game_id", F.posexplode("h").alias("pos", "civ")).filter(F.col("pos") >= 3)
    j = civs.join(res, "game_id").filter(F.col("civ") == F.col("victory_civ"))
    return j.select("game_id", "civ", (F.col("pos") - 2).alias("slot"))


def wonders(lines: DataFrame) -> DataFrame:
    """Wonder completions."""
    w = lines.filter(F.col("line").contains(", WONDER - Finished")).select(
        "game_id", _fields().alias("f"))
    return w.select("game_id", F.get(F.col("f"), 1).alias("civ"),
                    F.get(F.col("f"), 0).try_cast("int").alias("turn"),
                    F.replace(F.get(F.col("f"), 5), F.lit("WONDER - Finished "), F.lit("")).alias("wonder"))


def city_purchases(lines: DataFrame) -> DataFrame:
    """Unit purchases and building investments with their cost (text
    between ``Cost:`` and ``, Balance``)."""
    p = lines.filter(contains_any("line", ["MOD - Buying unit", "MOD - Investing in building"]))
    f = _fields()
    return p.select("game_id", F.get(f, 0).try_cast("int").alias("turn"), F.get(f, 1).alias("civ"),
                    F.when(F.col("line").contains("building"), "building").otherwise("unit")
                    .alias("type"),
                    F.regexp_extract("line", r"Cost:\s*(-?\d+)\s*, Balance", 1).try_cast("int")
                    .alias("cost"))


# Fields 3.. of the per-city economy log, in file order (fixed values).
CITY_ECONOMY_FIELDS = ["population", "food", "production", "science", "gold", "culture", "faith",
                       "tourism", "golden_age_points"]


def _data_lines(lines: DataFrame) -> DataFrame:
    """Drop header and blank lines."""
    return lines.filter(~F.col("line").contains("Turn,") & (F.trim("line") != ""))


def city_economy(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S09 (B1: fields 6/7 are science then gold, labelled as such).
    Returns (rows, rejects) — rejects are lines with a non-numeric field."""
    d = _data_lines(lines).select("game_id", "file", "line_no", "line", _fields().alias("f"))
    cols = {"civ": F.get(F.col("f"), 0), "turn": F.get(F.col("f"), 1).try_cast("int"),
            "city_name": F.get(F.col("f"), 2)}
    for i, name in enumerate(CITY_ECONOMY_FIELDS):
        cols[name] = F.get(F.col("f"), 3 + i).try_cast("double")
    parsed = d.select("game_id", "file", "line_no", "line", *[c.alias(n) for n, c in cols.items()])
    bad = F.col("turn").isNull()
    for name in CITY_ECONOMY_FIELDS:
        bad = bad | F.col(name).isNull()
    good = parsed.filter(~bad).drop("file", "line_no", "line")
    rejects = parsed.filter(bad).select("game_id", "file", "line_no", "line")
    return good, rejects


# Instant-yield types as written in the log, and their pivot column names
# (fixed values).
INSTANT_YIELD_TYPES = {
    "Food": "iy_food", "Production": "iy_production", "Science": "iy_science",
    "Gold": "iy_gold", "Culture": "iy_culture", "Faith": "iy_faith", "Tourism": "iy_tourism",
    "Golden Age Points": "iy_golden_age_points",
    "Border Growth Points": "iy_border_growth_points",
    "Great General Points": "iy_great_general_points",
    "Great Admiral Points": "iy_great_admiral_points",
}


def instant_yields(lines: DataFrame) -> DataFrame:
    """``turn, civ, _, Instant Yield Type: R, Yield Type: Y, Value: n``.
    The fixed prefixes are stripped; retroactive reasons merge with their
    plain reason (" Retro" dropped) and "Instant" reads as "Building
    Completion Effect"; the yield keeps its logged name; value is numeric."""
    d = _data_lines(lines).filter(F.col("line").contains("Instant Yield Type:")).select(
        "game_id", _fields().alias("f"))
    reason = F.trim(F.regexp_replace(F.get(F.col("f"), 3), r"^Instant Yield Type:\s*", ""))
    reason = F.replace(F.replace(reason, F.lit(" Retro"), F.lit("")), F.lit("Instant"),
                       F.lit("Building Completion Effect"))
    yld = F.trim(F.regexp_replace(F.get(F.col("f"), 4), r"^Yield Type:\s*", ""))
    val = F.trim(F.regexp_replace(F.get(F.col("f"), 5), r"^Value:\s*", "")).try_cast("double")
    return d.select("game_id", F.get(F.col("f"), 0).try_cast("int").alias("turn"),
                    F.get(F.col("f"), 1).alias("civ"), reason.alias("reason"), yld.alias("yield"),
                    val.alias("value"))


HANDICAP_YIELDS = ["gold", "food", "culture", "science"]


def handicap_yields(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Difficulty-bonus lines → (game_id, civ, turn, reason, hy_gold,
    hy_food, hy_culture, hy_science). Everything after the civ and turn
    fields is one text (the commas inside it are not field separators).
    The log writes bonuses in several layouts; one rule reads them all: the
    reason is the text between "BONUS FROM " and " - Received", each yield
    takes the number after "<YIELD> (" (so "FOOD (5; …)" reads 5), and the
    "Received Handicap Bonus (N in Yields)" layout gives N to every yield
    it names. Lines without a handicap bonus go to the reject table."""
    d = _data_lines(lines).select("game_id", "file", "line_no", "line", _fields().alias("f"))
    text = F.array_join(F.slice(F.col("f"), 3, F.greatest(F.size("f") - 2, F.lit(0))), "")
    d = d.withColumn("__t", text)
    known = F.col("__t").contains("Received Handicap Bonus")
    lump = F.regexp_extract("__t", r"Received Handicap Bonus \((\d+(?:\.\d+)?) in Yields\)", 1)
    cols = {}
    for y in HANDICAP_YIELDS:
        tag = y.upper()
        each = F.regexp_extract("__t", tag + r" \((\d+(?:\.\d+)?)", 1)
        v = F.when(lump != "", F.when(F.col("__t").contains(tag), lump.cast("double")))
        v = v.otherwise(F.when(each != "", each.cast("double")))
        cols[f"hy_{y}"] = F.coalesce(v, F.lit(0.0))
    good = d.filter(known).select(
        "game_id", F.get(F.col("f"), 0).alias("civ"),
        F.get(F.col("f"), 1).try_cast("int").alias("turn"),
        F.regexp_extract("__t", r"BONUS FROM (.*) - Received", 1).alias("reason"),
        *[c.alias(n) for n, c in cols.items()])
    rejects = d.filter(~known).select("game_id", "file", "line_no", "line")
    return good, rejects


def handicap_long(wide: DataFrame) -> DataFrame:
    """Long form (…, yield, value) of the handicap table, one row per yield."""
    return wide.unpivot(["game_id", "civ", "turn", "reason"],
                        [f"hy_{y}" for y in HANDICAP_YIELDS], "yield", "value").withColumn(
        "yield", F.regexp_replace("yield", "^hy_", ""))


def tech_events(lines: DataFrame) -> DataFrame:
    """S14 input: CHOSEN / COMPLETED rows of the tech log with file order."""
    d = lines.filter(contains_any("line", ["CHOSEN", "COMPLETED"])).select(
        "game_id", "file", "line_no", _fields().alias("f"))
    return d.select("game_id", "file", "line_no", F.get(F.col("f"), 0).try_cast("int").alias("turn"),
                    F.get(F.col("f"), 1).alias("nation"), F.get(F.col("f"), 2).alias("action"),
                    F.get(F.col("f"), 3).alias("tech"))


def policy_branches(lines: DataFrame) -> DataFrame:
    """Branch openings (``Branch n``)."""
    d = lines.filter(F.col("line").contains("CHOSEN") & F.col("line").contains("Branch"))
    f = _fields(F.trim("line"))
    return d.select("game_id", F.get(f, 0).try_cast("int").alias("turn"), F.get(f, 1).alias("civ"),
                    F.regexp_extract(F.get(f, 3), r"Branch (\d+)", 1).try_cast("int").alias("branch"))


def policy_choices(lines: DataFrame) -> DataFrame:
    """Every pick (branch or policy), with file order for W01."""
    d = lines.filter(F.col("line").contains("CHOSEN"))
    f = _fields(F.trim("line"))
    return d.select("game_id", "file", "line_no", F.get(f, 0).try_cast("int").alias("turn"),
                    F.get(f, 1).alias("civ"), F.get(f, 3).alias("item"))


RELIGION_EVENTS = {
    # event text: (output type, beliefs taken from the buffer) — fixed values
    "PANTHEON FOUNDED": ("pantheon", 1),
    "RELIGION FOUNDED": ("religion_founded", 2),
    "RELIGION ENHANCED": ("religion_enhanced", 2),
    "REFORMATION BELIEF ADDED": ("religion_reformed", 1),
}


def religion_lines(lines: DataFrame) -> DataFrame:
    """S17 input: CHOSEN and event rows of the religion log, with order."""
    d = lines.filter(contains_any("line", ["CHOSEN", *RELIGION_EVENTS])).select(
        "game_id", "file", "line_no", _fields(F.trim("line")).alias("f"))
    return d.select("game_id", "file", "line_no", F.get(F.col("f"), 0).try_cast("int").alias("turn"),
                    F.get(F.col("f"), 2).alias("civ"), F.get(F.col("f"), 3).alias("event"),
                    F.coalesce(F.get(F.col("f"), 4), F.lit("")).alias("details"))


def vassalage_deals(lines: DataFrame) -> DataFrame:
    """S18."""
    d = lines.filter(F.col("line").contains("***** Vassalage Trade *****")).select(
        "game_id", _fields().alias("f"))
    return d.select("game_id", F.get(F.col("f"), 0).try_cast("int").alias("turn"),
                    F.get(F.col("f"), 1).alias("vassal"), F.get(F.col("f"), 2).alias("master"))


def plot_yields(lines: DataFrame) -> DataFrame:
    """``civ, turn, Plot Yield Update, yield, amount``; short rows dropped."""
    d = lines.select("game_id", _fields().alias("f")).filter(F.size("f") >= 5)
    d = d.filter(F.get(F.col("f"), 2) == "Plot Yield Update")
    return d.select("game_id", F.get(F.col("f"), 0).alias("civ"), F.get(F.col("f"), 1).try_cast("int").alias("turn"),
                    F.get(F.col("f"), 3).alias("yield"), F.get(F.col("f"), 4).try_cast("long").alias("amount"))


# Field names of the JSON snapshot format (fixed values).
MAP_STATE_SCHEMA = T.StructType([T.StructField("MapData", T.StructType([
    T.StructField("Civ5PlayerData", T.ArrayType(T.StructType([
        T.StructField("Index", T.LongType()), T.StructField("CivType", T.StringType())]))),
    T.StructField("MapTileImprovements", T.ArrayType(T.StructType([
        T.StructField("Owner", T.LongType()), T.StructField("CityId", T.LongType()),
        T.StructField("RouteType", T.LongType()), T.StructField("Unit", T.StringType()),
        T.StructField("UnitOwner", T.LongType()), T.StructField("X", T.LongType()),
        T.StructField("Y", T.LongType())])))]))])

MAX_PLAYERS = 8   # player slots 0..7 are civilisations; higher ids mean "no player"


def map_state(spark: SparkSession, root: str, civ_names: DataFrame | None = None,
              game_ids: Sequence[str] | None = None) -> DataFrame:
    """One row per tile of every ``mapStateLog_Turn<N>.json`` snapshot;
    turn = N + 1; owner / unit owner resolved through the player table of the
    same snapshot (ids ≥ 8 → ''), then optionally tag → display name."""
    paths = _matching(spark, _paths(root, "mapStateLog_Turn*.json*", game_ids))
    empty = spark.createDataFrame([], "game_id string, owner_civ string, turn int, city_id int, "
                                      "route_type int, unit string, unit_owner_civ string, "
                                      "x int, y int")
    if not paths:
        return empty
    raw = spark.read.schema(MAP_STATE_SCHEMA).option("multiLine", True).json(paths)
    path = F.regexp_replace(F.col("_metadata.file_path"), r"\\", "/")
    snap = raw.select(F.regexp_extract(path, _GAME_FROM_PATH, 1).alias("game_id"),
                      (F.regexp_extract(path, r"mapStateLog_Turn(\d+)", 1).cast("int") + 1)
                      .alias("turn"), "MapData")
    players = F.map_from_entries(F.transform(
        F.filter("MapData.Civ5PlayerData", lambda p: p["Index"] < MAX_PLAYERS),
        lambda p: F.struct(p["Index"], p["CivType"])))
    tiles = snap.select("game_id", "turn", players.alias("players"),
                        F.explode("MapData.MapTileImprovements").alias("t"))

    def owner(idx: Column) -> Column:
        return F.when(idx >= MAX_PLAYERS, F.lit("")).otherwise(F.element_at("players", idx))

    out = tiles.select("game_id", owner(F.col("t.Owner")).alias("owner_civ"), "turn",
                       F.col("t.CityId").cast("int").alias("city_id"),
                       F.col("t.RouteType").cast("int").alias("route_type"),
                       F.col("t.Unit").alias("unit"),
                       owner(F.col("t.UnitOwner")).alias("unit_owner_civ"),
                       F.col("t.X").cast("int").alias("x"), F.col("t.Y").cast("int").alias("y"))
    if civ_names is not None:
        from turnlens.operators.keyed import broadcast_if_small
        names = broadcast_if_small(civ_names)   # a list of civilisations, size-checked
        for c in ("owner_civ", "unit_owner_civ"):
            out = (out.join(names.withColumnRenamed("tag", c), c, "left")
                   .withColumn(c, F.coalesce("name", F.col(c))).drop("name"))
    return out


# Positions in the per-civ economy log (fixed values of the log format).
CIV_ECONOMY_FIELDS = {
    "city_count": 2, "population": 3, "food": 4, "production": 5, "science": 7, "culture": 8,
    "faith": 9, "tourism": 10, "golden_age_points": 11, "policies_acquired": 13,
    "culture_cumsum": 14, "workers": 16, "happiness": 19, "trade_units_active": 23,
    "city_gold": 25, "gold": 32, "unit_maintenance": 33, "building_maintenance": 34,
    "improvement_maintenance": 35,
}
GOLD_BREAKDOWN_FIELDS = {
    "cities": 25, "trade_routes": 26, "city_connections": 28, "diplomacy": 29,
    "religion": 30, "traits": 31, "total_income": 32, "unit_maintenance": 33,
    "building_maintenance": 34, "improvement_maintenance": 35, "total_expenses": 36,
}


def _positional_ints(lines: DataFrame, fields: dict, as_int: bool = True
                     ) -> tuple[DataFrame, DataFrame]:
    d = _data_lines(lines).select("game_id", "file", "line_no", "line", _fields().alias("f"))
    cols = [F.get(F.col("f"), 0).alias("civ"), F.get(F.col("f"), 1).try_cast("int").alias("turn")]
    # text → double (→ int truncating toward zero for the economy counters)
    num = (lambda c: c.cast("int")) if as_int else (lambda c: c)
    cols += [num(F.get(F.col("f"), i).try_cast("double")).alias(n) for n, i in fields.items()]
    parsed = d.select("game_id", "file", "line_no", "line", *cols)
    bad = F.col("turn").isNull()
    for n in fields:
        bad = bad | F.col(n).isNull()
    return (parsed.filter(~bad).drop("file", "line_no", "line"),
            parsed.filter(bad).select("game_id", "file", "line_no", "line"))


def civ_economy(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per-civ economy rows (positional, truncating casts); rejects
    are lines with a missing or non-numeric field."""
    return _positional_ints(lines, CIV_ECONOMY_FIELDS)


def gold_breakdown(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Income and expense columns of the same log, as doubles (scan it
    once and project both from it when both are needed)."""
    return _positional_ints(lines, GOLD_BREAKDOWN_FIELDS, as_int=False)
