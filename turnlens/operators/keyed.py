"""Keyed joins, set operations, id translation and content dedup
(J01, J15, J16, J21, J22, J23, J25, K09, O06–O10, A60)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from turnlens.operators.ordered import global_row_number, ordered_scan

# Dimension tables are broadcast only below this many rows; the count is
# checked at runtime (a LIMIT n+1 count) before the hint is applied.
DIM_BROADCAST_MAX_ROWS = 2_000_000


def broadcast_if_small(df: DataFrame, max_rows: int = DIM_BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast hint only for a side whose row count is proven small;
    otherwise leave the choice to Catalyst/AQE (sort-merge or shuffled hash)."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def winner_join(picks: DataFrame, winners: DataFrame, keys: Sequence[str],
                pick_entity: str, winner_entity: str, flag: str = "is_winner") -> DataFrame:
    """Left join of picks to the winner of their game; flag = picked by
    the winner. ``winners`` has one row per game key."""
    w = winners.select(*keys, F.col(winner_entity).alias("__winner"))
    j = picks.join(w, list(keys), "left")
    return j.withColumn(flag, F.coalesce(F.col(pick_entity) == F.col("__winner"),
                                         F.lit(False))).drop("__winner")


def semi(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """J16 / O08."""
    return df.join(other.select(*on), list(on), "left_semi")


def anti(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """J15 / J25 / O09 (null-safe: null keys never match)."""
    return df.join(other.select(*on), list(on), "left_anti")


def key_set_ops(a: DataFrame, b: DataFrame, op_col: str = "op") -> DataFrame:
    """O06–O09 on two single-schema key sets, labelled."""
    return (a.union(b).distinct().withColumn(op_col, F.lit("union"))
            .unionByName(a.intersect(b).withColumn(op_col, F.lit("intersect")))
            .unionByName(a.subtract(b).withColumn(op_col, F.lit("except"))))


def mint_ids(dictionary: DataFrame, incoming_keys: DataFrame, key: str,
             id_col: str = "id") -> DataFrame:
    """New dense ids for keys not yet in the dictionary, numbered after
    the current maximum in key order; returns the extended dictionary."""
    new = anti(incoming_keys.select(key).distinct(), dictionary, [key])
    base = dictionary.select(F.coalesce(F.max(id_col), F.lit(0))).scalar()
    minted = global_row_number(new, [F.col(key)], "__rn").select(
        key, (base + F.col("__rn")).cast("long").alias(id_col))
    return dictionary.select(key, F.col(id_col).cast("long")).unionByName(minted)


def number_repeats(arrivals: DataFrame, taken: DataFrame, key: str, name: str,
                   order: Sequence[Column | str], chunk: Column, out: str = "name") -> DataFrame:
    """T06 (numbered form): every arrival keeps its key if nobody has it yet,
    else takes ``key-1``, ``key-2`` …, skipping numbers that are in ``taken``
    (a frame with the names given earlier, column ``name``). Arrivals of one
    key are numbered in ``order``; ``chunk`` splits a key with many arrivals
    (see :func:`ordered_scan`).

    The j-th arrival takes the j-th free number: with the used numbers u in
    order, u_i - i numbers below u_i are free, so it is j plus the number of
    i with u_i - i <= j. That number is a running count over the key's taken
    numbers and arrivals in one order (u_i - i before the equal j). Taken
    numbers stay rows, counted per value of u_i - i, and both scans are split
    by number, so a key spreads over tasks whichever side is long.
    """
    own = taken.select(F.col(name).alias("__k"), F.lit(0).cast("long").alias("__u"))
    suffixed = taken.select(
        F.regexp_extract(name, r"^(.*)-([1-9]\d*)$", 1).alias("__k"),
        F.regexp_extract(name, r"^(.*)-([1-9]\d*)$", 2).try_cast("long").alias("__u")) \
        .filter("__u is not null")
    used = own.union(suffixed).distinct()
    ranked = ordered_scan(used, ["__k"], ["__u"], _number_chunk("__u"), row_number="__i")
    free = ranked.groupBy("__k", (F.col("__u") - F.col("__i") + 1).alias("__pos")).agg(
        F.count(F.lit(1)).alias("__n"))
    placed = ordered_scan(arrivals, [key], order, chunk, row_number="__j")
    row = F.struct(*arrivals.columns)
    row_type = arrivals.select(row.alias("r")).schema["r"].dataType
    both = free.select("__k", "__pos", F.lit(0).alias("__side"), "__n",
                       F.lit(None).cast(row_type).alias("__row")).unionByName(
        placed.select(F.col(key).alias("__k"), (F.col("__j") - 1).alias("__pos"), F.lit(1).alias("__side"),
                      F.lit(0).cast("long").alias("__n"), row.alias("__row")))
    counted = ordered_scan(both, ["__k"], ["__pos", "__side"], _number_chunk("__pos"),
                           sums={"__skipped": F.col("__n")}).filter("__side = 1")
    n = F.col("__pos") + F.col("__skipped")
    return counted.withColumn(out, F.when(n == 0, F.col("__k")).otherwise(
        F.concat_ws("-", F.col("__k"), n.cast("string")))).select("__row.*", out)


# Numbers of a key that one task scans together.
NUMBER_CHUNK = 1 << 16


def _number_chunk(number: str) -> Column:
    return F.floor(F.col(number) / NUMBER_CHUNK)


def translate_ids(facts: DataFrame, dictionary: DataFrame, key: str, id_col: str,
                  out: str) -> DataFrame:
    """Rewrite a local key to its global id (inner join)."""
    d = dictionary.select(F.col(key), F.col(id_col).alias(out))
    return facts.join(d, key, "inner")


def exact_content_dedup(df: DataFrame, content: str, id_col: str,
                        hash_out: str = "content_hash") -> DataFrame:
    """Group exact copies by SHA-256 of the whole content, keep the
    smallest id and the copy count. A partial aggregate, so one content with
    millions of copies is folded map-side."""
    return (df.groupBy(F.sha2(F.col(content), 256).alias(hash_out))
            .agg(F.min(id_col).alias("kept_" + id_col),
                 F.count(F.lit(1)).alias("n_copies")))


def equi_with_residual(left: DataFrame, right: DataFrame, on: Sequence[str],
                       residual) -> DataFrame:
    """Equi join plus an inequality residual condition."""
    cond = [left[c] == right[c] for c in on] + [residual]
    return left.join(right, cond, "inner")


def join_on_common(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on every column name the two frames share."""
    on = [c for c in left.columns if c in right.columns]
    return left.join(right, on, how)


def override_dimension(dim: DataFrame, overrides: DataFrame, key: str, value: str) -> DataFrame:
    """Apply an override map on top of a dimension: overridden keys take
    the override value, keys only in the overrides are added."""
    o = overrides.select(key, F.col(value).alias("__ov"))
    j = dim.select(key, value).join(o, key, "full")
    return j.select(key, F.coalesce("__ov", value).alias(value))


def lookup_label(df: DataFrame, dim: DataFrame, code: str, dim_code: str, label: str,
                 drop_unmapped: bool = True) -> DataFrame:
    """Code → label through a small dimension; unmapped rows are
    dropped (inner) or kept with a null label (left). Use
    :func:`turnlens.operators.quality.unknown_keys` to report them (Q02)."""
    d = broadcast_if_small(dim.select(F.col(dim_code).alias(code), label))
    return df.join(d, code, "inner" if drop_unmapped else "left")


def facet_matches(items: DataFrame, id_col: str, facets: dict[str, Column], rules: DataFrame,
                  null_always: Sequence[str] = ()) -> DataFrame:
    """(id, rule) for every rule of a table that an item is eligible
    under. ``facets`` gives the item's values per facet, one or an array;
    ``rules`` has one row per rule with an array column per facet. An item
    matches a facet if it has one of the rule's values (an empty array matches
    nothing); a null value of a facet in ``null_always`` matches every rule.

    Values are joined by equality, not item by rule: per (item, rule) the
    facets that met are counted against those the item must meet."""
    def as_array(facet: str, c: Column) -> Column:
        kind = items.select(c.alias("c")).schema["c"].dataType.typeName()
        values = c if kind == "array" else F.when(c.isNotNull(), F.array(c))
        return values.cast("array<string>").alias(facet)

    own = items.select(F.col(id_col).alias("__id"), *[as_array(f, c) for f, c in facets.items()])
    free = [F.col(f).isNull().cast("int") for f in null_always]
    own = own.withColumn("__need", F.lit(len(facets)) - sum(free, F.lit(0)))
    long_form = lambda d, key: d.select(*key, F.explode(F.array(*[
        F.struct(F.lit(f).alias("facet"), F.col(f).cast("array<string>").alias("values")) for f in facets])).alias("f")) \
        .select(*key, "f.facet", F.explode("f.values").alias("value")).distinct()
    met = long_form(own, ["__id", "__need"]).join(long_form(rules, ["rule"]), ["facet", "value"]) \
        .groupBy("__id", "__need", "rule").agg(F.count_distinct("facet").alias("n")).filter("n = __need")
    every = own.filter("__need = 0").select("__id", F.explode(
        rules.select(F.collect_set("rule")).scalar()).alias("rule"))    # the rules, a small table
    return met.select("__id", "rule").unionByName(every).withColumnRenamed("__id", id_col)


def eligible(items: DataFrame, id_col: str, facets: dict[str, Column], rules: DataFrame,
             null_always: Sequence[str] = ()) -> DataFrame:
    """The items that some rule of the table makes eligible (semi join)."""
    return items.join(facet_matches(items, id_col, facets, rules, null_always).select(id_col).distinct(),
                      id_col, "left_semi")
