"""Ordered event folds per entity.

W16 and W17 are rewritten as associative scans (last-non-null, running max,
running count) on top of :func:`ordered_scan`, so they split across tasks
even for a hot entity. The W18-style level state machine is not an
associative scan over values, but its state space is finite, so with a
chunk column it runs as a parallel prefix over state→state tables, composed
in vectors; without one it is a single streaming pass over key-sorted
partitions (rows arrive in Arrow batches, only the current key's state is
held, no group is materialised in memory).
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from turnlens.operators.ordered import ordered_scan
from turnlens.session import staged


def chosen_completed_intervals(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                               chunk: Column, is_chosen: Column, is_completed: Column,
                               turn: str, grid: Column, default_start: int = 0) -> DataFrame:
    """CHOSEN rows set the current start turn; each COMPLETED row emits
    (start_turn, end_turn, duration = end − start + 1, grid_at_start = max
    grid over completed rows so far, this one included). Start is the turn
    of the last CHOSEN row so far (``default_start`` if none)."""
    rows = df.filter(is_chosen | is_completed).withColumn("__done", is_completed)
    scanned = ordered_scan(
        rows, keys, order, chunk,
        lasts={"__start": F.when(is_chosen, F.col(turn))},
        maxes={"__grid": F.when(is_completed, grid)})
    out = scanned.filter(F.col("__done"))
    start = F.coalesce(F.col("__start"), F.lit(default_start))
    return (out.withColumn("start_turn", start)
            .withColumn("end_turn", F.col(turn))
            .withColumn("duration", F.col(turn) - start + 1)
            .withColumnRenamed("__grid", "grid_at_start")
            .drop("__done", "__start"))


def buffered_event_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                          chunk: Column, is_event: Column, is_buffered: Column,
                          take: Column | int, event_cols: Sequence[str],
                          item_cols: Sequence[str], max_take: int = 2) -> DataFrame:
    """Buffered rows wait for the next event row of the same key; the
    event consumes the first ``take`` of them (1 or 2 per event kind) and the
    buffer empties, so leftovers are dropped. Output civ/turn fields come
    from the event row.

    event_no = number of event rows strictly before a row (a running count),
    so buffered rows and the event that consumes them share (key, event_no):
    an equi-join, with at most ``max_take`` buffered rows kept per group
    (the row_number filter is applied before the shuffle).
    """
    keys = list(keys)
    rows = (df.filter(is_event | is_buffered)
            .withColumn("__is_ev", is_event.cast("int"))
            .withColumn("__take", take if isinstance(take, Column) else F.lit(take)))
    scanned = ordered_scan(rows, keys, order, chunk, sums={"__ev_incl": F.col("__is_ev")})
    scanned = scanned.withColumn("event_no", F.col("__ev_incl") - F.col("__is_ev"))
    events = scanned.filter(F.col("__is_ev") == 1).select(
        *keys, "event_no", "__take", *[F.col(c).alias("event_" + c) for c in event_cols])
    w = W.partitionBy(*keys, "event_no").orderBy(*order)
    items = (scanned.filter(F.col("__is_ev") == 0)
             .withColumn("slot", F.row_number().over(w))
             .filter(F.col("slot") <= max_take)
             .select(*keys, "event_no", "slot", *[F.col(c).alias("item_" + c) for c in item_cols]))
    j = events.join(items, keys + ["event_no"], "inner").filter(F.col("slot") <= F.col("__take"))
    return j.drop("__take")


def _level_step(levels, steps, tier, is_step, k: int, max_level: int | None):
    """One row applied to arrays of states (vectorised over all states)."""
    import numpy as np
    adv = tier > levels
    steps = steps + (1 if is_step else 0)
    adv = adv | (steps >= k)
    if max_level is not None:
        adv = adv & (levels < max_level)
    levels = np.where(adv, levels + 1, levels)
    steps = np.where(adv, 0, steps)
    if max_level is not None:
        steps = np.where(levels >= max_level, 0, steps)   # steps are moot at the top
    return levels, steps


def level_state_machine(df: DataFrame, key: str, order: Sequence[str], tier: str,
                        is_step: str, id_col: str, steps_per_level: int = 3,
                        start_level: int = 1, max_level: int | None = None,
                        chunk: Column | None = None,
                        num_partitions: int | None = None) -> DataFrame:
    """A per-key level that starts at ``start_level``; every row is
    labelled with the level *before* it is applied; then the level rises by
    one (never more, never above ``max_level``) if the row's tier is above
    the level, or if it is a step row that completes ``steps_per_level``
    steps at the current level. Output: key, id, level.

    Without ``chunk``: one streaming pass over key-sorted partitions.
    With ``chunk`` (and ``max_level``) the state space is finite (level ×
    steps), so the fold runs as a parallel prefix: each (key, chunk) turns its
    rows into state→state tables and composes them in vectors, a per-key scan
    over the chunk tables (one row per chunk) gives each chunk's entry state,
    and a join looks every row's table up at that state — a hot key spreads
    over its chunks.
    """
    if chunk is not None and max_level is not None:
        return _level_machine_chunked(df, key, order, tier, is_step, id_col, steps_per_level,
                                      start_level, max_level, chunk, num_partitions)
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kt = df.schema[key].dataType
    it = df.schema[id_col].dataType
    schema = T.StructType([T.StructField(key, kt), T.StructField(id_col, it),
                           T.StructField("level", T.IntegerType())])
    cols = list(dict.fromkeys([key, *order, tier, is_step, id_col]))
    src = (df.select(*cols)
           .repartition(n, key).sortWithinPartitions(key, *order))

    def run(batches):
        cur_key, level, steps = None, start_level, 0
        for pdf in batches:
            out = []
            for k, t, b in zip(pdf[key].tolist(), pdf[tier].tolist(), pdf[is_step].tolist(), strict=True):
                if k != cur_key:
                    cur_key, level, steps = k, start_level, 0
                out.append(level)
                steps += b is True or b == 1
                if (max_level is None or level < max_level) and (
                        steps >= steps_per_level or (t is not None and t > level)):
                    level, steps = level + 1, 0
            yield pd.DataFrame({key: pdf[key], id_col: pdf[id_col],
                                "level": pd.Series(out, dtype="int32")})

    return src.mapInPandas(run, schema)


def row_tables(start_level: int, max_level: int, k: int):
    """The state→state table of every kind of row: kind 2 (t − start) + step
    for a row of tier t (tiers below the start count as the start, above the
    top as the top). State (level − start) · k + steps."""
    import numpy as np
    n_levels = max_level - start_level + 1
    levels = np.repeat(np.arange(start_level, max_level + 1), k)
    steps = np.tile(np.arange(k), n_levels)
    out = []
    for t in range(start_level, max_level + 1):
        for is_step in (False, True):
            lv, st = _level_step(levels, steps, t, is_step, k, max_level)
            out.append((lv - start_level) * k + st)
    return np.array(out)


def composed(tables, begins):
    """Inclusive prefix compositions of ``tables`` (rows × states) within the
    segments that begin where ``begins`` is true, by doubling: after a round
    with distance d every row holds the composition of its last 2d rows."""
    import numpy as np
    place = np.arange(len(tables))
    place = place - np.maximum.accumulate(np.where(begins, place, 0))    # from the segment's first row
    out, d = tables.copy(), 1
    while (rows := np.flatnonzero(place >= d)).size:
        out[rows] = np.take_along_axis(out[rows], out[rows - d].astype(np.intp), 1)
        d *= 2
    return out


def _level_machine_chunked(df, key, order, tier, is_step, id_col, k, start_level, max_level,
                           chunk, num_partitions):
    import numpy as np
    import pyarrow as pa
    spark = df.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    tables = row_tables(start_level, max_level, k)
    n_states = tables.shape[1]
    small = n_states <= 128
    tables = tables.astype(np.int8 if small else np.int16)
    state_t, arrow_t = (T.ByteType(), pa.int8()) if small else (T.ShortType(), pa.int16())
    rows = df.select(F.col(key).alias("k"), F.col(id_col).alias("id"),
                     F.ceil(tier).cast("long").alias("tier"),
                     F.coalesce(F.col(is_step).cast("boolean"), F.lit(False)).alias("step"),
                     *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)],
                     _chunk_number(df, chunk).alias("chunk"))
    kind = F.greatest(F.least(F.coalesce("tier", F.lit(start_level)), F.lit(max_level)), F.lit(start_level))
    rows = rows.withColumn("kind", ((kind - start_level) * 2 + F.col("step").cast("int")).cast("int"))
    marks = [f"o{i}" for i in range(len(order))]
    sorted_rows = (rows.repartition(n, "k", "chunk").sortWithinPartitions("k", "chunk", *marks)
                   .select("k", "chunk", "id", "kind"))
    schema = T.StructType([sorted_rows.schema["k"], T.StructField("chunk", T.LongType()),
                           sorted_rows.schema["id"], T.StructField("whole", T.BooleanType()),
                           T.StructField("f", T.ArrayType(state_t))])
    same_state = np.arange(n_states, dtype=tables.dtype)

    # pass 1, the only sort: per row the table from its chunk's entry state to
    # the state before the row; per (key, chunk) one more row, the whole table
    def prefixes(batches):
        held = None             # key, chunk and table of the segment that is open

        def record(ks, cs, ids, whole, f):
            flat = pa.array(np.ascontiguousarray(f).ravel(), arrow_t)
            ends = pa.array(np.arange(len(f) + 1, dtype=np.int32) * n_states)
            return pa.RecordBatch.from_arrays(
                [ks, cs, ids, pa.array(np.full(len(f), whole)), pa.ListArray.from_arrays(ends, flat)],
                names=["k", "chunk", "id", "whole", "f"])

        def closed(k_, c_, ids, f):
            return record(k_, c_, pa.nulls(len(f), ids.type), True, f)

        for batch in batches:
            if not batch.num_rows:
                continue
            ks, cs, ids, kinds = batch.columns
            chunks = cs.to_numpy(zero_copy_only=False)
            codes = ks.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            begins = np.ones(len(codes), bool)
            begins[1:] = (codes[1:] != codes[:-1]) | (chunks[1:] != chunks[:-1])
            f = composed(tables[kinds.to_numpy(zero_copy_only=False)], begins)
            first = np.flatnonzero(begins)
            size = np.diff(np.append(first, len(codes)))
            if held is not None and held[0].equals(ks.slice(0, 1)) and held[1].equals(cs.slice(0, 1)):
                entry, size0 = held[2], size[0]
                f[:size0] = f[:size0][:, entry.astype(np.intp)]
            else:
                if held is not None:
                    yield closed(held[0], held[1], ids, held[2][None])
                entry = same_state
            before = np.empty_like(f)
            before[1:] = f[:-1]
            before[first] = same_state
            before[0] = entry
            yield record(ks, cs, ids, False, before)
            last = first + size - 1
            if len(first) > 1:
                done = pa.array(last[:-1])
                yield closed(ks.take(done), cs.take(done), ids, f[last[:-1]])
            held = ks.slice(len(codes) - 1), cs.slice(len(codes) - 1), f[last[-1]].copy()
        if held is not None:
            yield closed(held[0], held[1], ids, held[2][None])

    found = staged(sorted_rows.mapInArrow(prefixes, schema), "level-tables")

    # pass 2: per key, the chunk tables in chunk order → entry states
    entry_schema = T.StructType([schema["k"], T.StructField("chunk", T.LongType()),
                                 T.StructField("entry", T.IntegerType())])

    def entries(batches):
        cur, state = object(), 0
        for batch in batches:
            ent = []
            for kk, f in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if kk != cur:
                    cur, state = kk, 0
                ent.append(state)
                state = f[state]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(ent, pa.int32())],
                                             names=["k", "chunk", "entry"])

    entry = (found.filter("whole").select("k", "chunk", "f").repartition(n, "k")
             .sortWithinPartitions("k", "chunk").mapInArrow(entries, entry_schema))

    # pass 3: every row's table at its chunk's entry state
    e = entry.select(F.col("k").alias("ek"), F.col("chunk").alias("ec"), "entry")
    state = F.get("f", F.col("entry")).cast("int")
    return found.filter("not whole").join(e, F.col("k").eqNullSafe(F.col("ek")) & (F.col("chunk") == F.col("ec"))) \
        .select(F.col("k").alias(key), F.col("id").alias(id_col),
                (F.lit(start_level) + F.floor(state / k)).cast("int").alias("level"))


def _chunk_number(df: DataFrame, chunk: Column) -> Column:
    """A chunk as a whole number; null chunks come first."""
    kind = df.select(chunk.alias("c")).schema["c"].dataType
    number = F.unix_date(chunk) if isinstance(kind, T.DateType) else chunk
    return F.coalesce(number.cast("long"), F.lit(-(1 << 62)))
