"""Structured Streaming twins of the live-state operators.

Every query runs on a file source with an ``availableNow`` trigger and a
checkpoint under the shared ``spark.checkpoint.dir``, so a lost executor or
a restarted driver resumes from the last committed micro-batch. Sinks are
Parquet tables written from ``foreachBatch`` (idempotent per batch id).

State does not grow for ever: aggregates are kept per event-time period and
leave the state once the watermark has passed it (their rows merge to the
same totals however the input falls into batches), arbitrary state has
event-time timers, and what must be remembered for good - registered keys -
lives in a table, not in the state store.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from turnlens.session import path_exists, scratch_dir

# Rows of one replayed file.
REPLAY_FILE_ROWS = 1_000_000
# Groups that the keys of arbitrary state are dealt to. A group is one row of
# state and one call of Python a batch for all its keys, so the calls do not
# grow with the keys; each key of a group has its own snapshot and timer.
STATE_GROUPS = 4096


def file_stream(spark: SparkSession, folder: str, file_glob: str, schema: T.StructType,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet file source restricted to files matching ``file_glob``."""
    r = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(folder)


class Replay:
    """A table written again as files that arrive in order: ``slices`` runs
    over ascending ranges of the whole-numbered column ``by``, none of them
    cutting a value apart. A stream over it takes one slice a batch."""

    def __init__(self, df: DataFrame, by: Column, slices: int = 3):
        self.spark, self.schema = df.sparkSession, df.schema
        self.folder = scratch_dir(self.spark, "replay")
        marked = df.withColumn("__by", by.cast("long"))
        at = [F.lit(i / slices) for i in range(1, slices)]
        r = marked.agg(F.count(F.lit(1)).alias("n"), *[
            F.percentile_approx("__by", p, 1000).alias(f"b{i}") for i, p in enumerate(at)]).first()
        bounds = [r[f"b{i}"] for i in range(slices - 1)]
        # empty slices write nothing; each other one as many files
        self.files = max(1, r["n"] // slices // REPLAY_FILE_ROWS)
        for low, high in zip([None, *bounds], [*bounds, None], strict=True):
            part = marked
            if low is not None:
                part = part.filter(F.col("__by") > low)
            if high is not None:
                part = part.filter(F.col("__by") <= high)
            self.append(part.drop("__by"))

    def append(self, df: DataFrame) -> None:
        """One more slice, later than all others."""
        df.repartition(self.files).write.mode("append").parquet(self.folder)

    def stream(self) -> DataFrame:
        return file_stream(self.spark, self.folder, "*.parquet", self.schema, self.files)


def with_event_time(df: DataFrame, ts: str, out: str = "event_time") -> DataFrame:
    """Watermarks need TIMESTAMP (not TIMESTAMP_NTZ): cast in the session zone."""
    return df.withColumn(out, F.col(ts).cast("timestamp"))


def run_to_table(stream: DataFrame, name: str, mode: str = "append",
                 keys: Sequence[str] | None = None, progress: list | None = None) -> DataFrame:
    """Run a streaming frame to completion (availableNow) into a Parquet
    table under the shared checkpoint root and return the table as a batch
    DataFrame. With ``mode='update'`` each batch appends its updated rows
    tagged with the batch id; the returned frame keeps, per ``keys``, the row
    of the latest batch (the final state). ``progress`` receives one dict per
    batch (rows read, rows held in state)."""
    spark = stream.sparkSession
    base = scratch_dir(spark, name)
    out, ckpt = f"{base}/table", f"{base}/checkpoint"

    def write(batch: DataFrame, batch_id: int) -> None:
        # a replayed batch replaces its own folder
        (batch.withColumn("__batch", F.lit(batch_id)).write.mode("overwrite")
         .parquet(f"{out}/batch={batch_id}"))

    q = (stream.writeStream.outputMode(mode).foreachBatch(write)
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    if progress is not None:
        progress += [{"batch": p["batchId"], "rows": p["numInputRows"],
                      "state": sum(s["numRowsTotal"] for s in p["stateOperators"])}
                     for p in q.recentProgress]
    schema = T.StructType(stream.schema.fields + [T.StructField("__batch", T.LongType())])
    if not path_exists(spark, out):   # no batch at all
        return spark.createDataFrame([], stream.schema)
    res = spark.read.schema(schema).parquet(f"{out}/batch=*")
    if keys:
        latest = res.groupBy(*keys).agg(F.max("__batch").alias("__last"))
        res = res.join(latest, list(keys)).filter(F.col("__batch") == F.col("__last")).drop("__last")
    return res.drop("__batch")


# --- T02 / T04: sessions and timeouts ---------------------------------------

def session_counts(stream: DataFrame, key: str, ts: str, value: str, gap: str,
                   watermark: str) -> DataFrame:
    """Event-time sessions per key; a key silent for ``gap`` closes
    its session (the watermark bounds state)."""
    s = with_event_time(stream, ts).withWatermark("event_time", watermark)
    return (s.groupBy(key, F.session_window("event_time", gap).alias("session"))
            .agg(F.count(F.lit(1)).alias("n_events"),
                 F.sum(F.col(value).cast("decimal(18,2)")).alias("total_value")))


def all_sessions(replay: Replay, key: str, ts: str, value: str, gap: str, watermark: str,
                 marker: DataFrame) -> DataFrame:
    """T02 with late final emission: every session of ``replay``, also those
    still open at its end. ``marker`` is one row without key, later than the
    last event by more than gap and watermark together; it arrives as the last
    slice, moves the watermark past all sessions and leaves the result."""
    replay.append(marker)
    done = run_to_table(session_counts(replay.stream(), key, ts, value, gap, watermark), "all-sessions")
    return done.filter(F.col(key).isNotNull())


def pulse_counts(stream: DataFrame, key: str, state: str, pulse: str = "recovered",
                 normal: str = "running", watermark: str | None = None, period: str = "1 day") -> DataFrame:
    """Count one-shot pulses per key while normalising the stored state
    (``event_time`` orders the states). With ``watermark`` the counts are kept
    per ``period`` and leave the state behind the watermark;
    :func:`merge_pulses` adds them up."""
    norm = F.when(F.col(state) == pulse, F.lit(normal)).otherwise(F.col(state))
    aggs = [F.sum(F.when(F.col(state) == pulse, 1).otherwise(0)).alias("n_pulses"),
            F.max_by(norm, F.col("event_time")).alias("state")]
    if watermark is None:
        return stream.groupBy(key).agg(*aggs)
    return (stream.withWatermark("event_time", watermark)
            .groupBy(F.window("event_time", period).alias("period"), key).agg(*aggs))


def merge_pulses(periods: DataFrame, key: str) -> DataFrame:
    """Totals of the last row of every (period, key)."""
    return periods.groupBy(key).agg(F.sum("n_pulses").alias("n_pulses"),
                                    F.max_by("state", "period.start").alias("state"))


# --- arbitrary state: keys dealt to groups -----------------------------------

def _grouped(df: DataFrame, key: str) -> DataFrame:
    """``df`` with the group of each key (see :data:`STATE_GROUPS`)."""
    return df.withColumn("__group", F.pmod(F.xxhash64(key), F.lit(STATE_GROUPS)).cast("int"))


def _exact(df: DataFrame, column: str) -> Column:
    """``column`` as Python gets it: pandas would make whole numbers with a
    null among them floats, so they travel as text."""
    whole = isinstance(df.schema[column].dataType, T.IntegralType)
    return F.col(column).cast("string").alias(column) if whole else F.col(column)


def _state_helpers() -> tuple[Callable, Callable]:
    """``values`` and ``frame``, made here so that they travel with the function
    that uses them and workers need not have this package."""
    def values(column: pd.Series, kind: T.DataType) -> list:
        """The column's values, whole numbers made from text again."""
        found = column.tolist()
        return [None if v is None else int(v) for v in found] if isinstance(kind, T.IntegralType) else found

    def frame(rows: list[tuple], names: Sequence[str]) -> pd.DataFrame:
        """Rows as objects: whole numbers stay whole beside nulls."""
        return pd.DataFrame({n: pd.Series(c, dtype=object) for n, c in zip(names, zip(*rows, strict=True), strict=True)})

    return values, frame


# --- T01: latest + previous snapshot per key ---------------------------------

def latest_state_stream(stream: DataFrame, key: str = "user_id", id_col: str = "event_id",
                        state_col: str = "event_type", ts: str = "ts",
                        ttl_sec: int | None = None, watermark: str | None = None) -> DataFrame:
    """Per key the newest row (by time, then id) and the previous
    snapshot, as arbitrary state (update mode). Nulls sort before all else.

    With ``ttl_sec`` a snapshot counts as previous only if it is at most that
    much older than the newest, and an event-time timer drops the state of a
    key that has been silent for longer. Whatever arrives after that is newer
    by more, so the result does not depend on when the timer fires.
    """
    kinds = [stream.schema[c].dataType for c in (key, id_col, state_col)]
    names = [key, f"latest_{id_col}", f"latest_{state_col}", f"prev_{id_col}", f"prev_{state_col}"]
    out_schema = T.StructType([T.StructField(n, t) for n, t in
                               zip(names, [*kinds, *kinds[1:]], strict=True)])
    state_schema = T.StructType([T.StructField("key", T.ArrayType(kinds[0]))] + [
        T.StructField(f"{c}{i}", T.ArrayType(t)) for i in (1, 0) for c, t in
        zip("tks", [T.LongType(), *kinds[1:]], strict=True)])
    ttl_us = None if ttl_sec is None else ttl_sec * 1_000_000
    none = (None, None, None)
    values, frame = _state_helpers()

    def snapshot(us, *rest):
        """A row that sorts by time, id and state."""
        return us, *((v is not None, v) for v in rest)

    def plain(row):
        return none if row is None else (row[0], row[1][1], row[2][1])

    def top2(_, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Keep the two newest rows seen for each key of a group; chunks
        stream through."""
        held, seen = {}, set()
        for k, *r in zip(*state.get, strict=True) if state.exists else ():
            held[k] = snapshot(*r[:3]), None if r[3] is None else snapshot(*r[3:])
        for pdf in () if state.hasTimedOut else pdfs:
            keys, ids, kept = (values(pdf[c], t) for c, t in zip(("__key", "__id", "__state"), kinds, strict=True))
            seen.update(keys)
            for k, *r in zip(keys, pdf["__us"].tolist(), ids, kept, strict=True):
                row = snapshot(*r)
                if k not in held:
                    held[k] = row, None
                    continue
                newest, prev = held[k]
                if row >= newest:
                    held[k] = row, newest
                elif prev is None or row > prev:
                    held[k] = newest, row
        if ttl_us is not None:
            now = state.getCurrentWatermarkMs()
            for k in seen:
                newest, prev = held[k]
                if prev is not None and newest[0] - prev[0] > ttl_us:
                    held[k] = newest, None
            due = {k: (newest[0] + ttl_us) // 1000 + 1 for k, (newest, _) in held.items()}
            for k in [k for k, at in due.items() if at < now and k not in seen]:
                del held[k], due[k]
        if not held:
            state.remove()
            return
        state.update(tuple(map(list, zip(*((k, *plain(newest), *plain(prev)) for k, (newest, prev) in held.items()),
                                         strict=True))))
        if ttl_us is not None:
            state.setTimeoutTimestamp(max(min(due.values()), now + 1))
        if seen:
            yield frame([(k, *plain(held[k][0])[1:], *plain(held[k][1])[1:]) for k in seen], names)

    s = with_event_time(stream, ts)
    if ttl_sec is not None:
        s = s.withWatermark("event_time", watermark or "0 seconds")
    at = F.coalesce(F.unix_micros("event_time"), F.lit(-(1 << 62)))     # no time sorts first
    s = _grouped(s, key).select("__group", *[_exact(s, c).alias(n) for c, n in (
        (key, "__key"), (id_col, "__id"), (state_col, "__state"))], "event_time", at.alias("__us"))
    return s.groupBy("__group").applyInPandasWithState(
        top2, out_schema, state_schema, "update",
        GroupStateTimeout.NoTimeout if ttl_sec is None else GroupStateTimeout.EventTimeTimeout)


# --- T03: monotone max ------------------------------------------------------

def monotone_max_stream(stream: DataFrame, keys: Sequence[str], measures: Sequence[str],
                        last_of: str, order: str, watermark: str | None = None,
                        ts: str = "ts", period: str = "1 day") -> DataFrame:
    """Per key, running max of each measure and the value of
    ``last_of`` at the latest ``order`` (update mode). With ``watermark`` the
    maxima are kept per ``period`` and leave the state behind the watermark;
    :func:`merge_monotone` takes the max over periods, which is the same
    whichever rows a key had before its state expired."""
    aggs = [*[F.max(m).alias(f"max_{m}") for m in measures], F.max_by(last_of, order).alias(f"last_{last_of}")]
    if watermark is None:
        return stream.groupBy(*keys).agg(*aggs)
    s = with_event_time(stream, ts).withWatermark("event_time", watermark)
    return s.groupBy(F.window("event_time", period).alias("period"), *keys).agg(*aggs)


def merge_monotone(periods: DataFrame, keys: Sequence[str], measures: Sequence[str], last_of: str) -> DataFrame:
    """Maxima and last value over the last row of every (period, key)."""
    return periods.groupBy(*keys).agg(*[F.max(f"max_{m}").alias(f"max_{m}") for m in measures],
                                      F.max_by(f"last_{last_of}", "period.start").alias(f"last_{last_of}"))


# --- T05: register-or-reject -------------------------------------------------

def register_or_reject(stream: DataFrame, registry: DataFrame, key: str,
                       address: str) -> tuple[DataFrame, DataFrame]:
    """Known keys pass; unknown keys carrying an address are accepted
    (and can be appended to the registry); the rest go to a reject table.
    Stream-static left join against the registry."""
    reg = registry.select(F.col(key), F.lit(True).alias("__known"))
    j = stream.join(reg, key, "left")
    ok = j.filter(F.col("__known") | F.col(address).isNotNull()).drop("__known")
    rejected = j.filter(F.col("__known").isNull() & F.col(address).isNull()).drop("__known")
    return ok, rejected


class Registry:
    """T05 in a stream: a registry of keys that grows while the stream runs.

    Each batch reads what earlier batches have published, accepts unknown keys
    from their first row with an address on, and publishes the new keys under
    its own batch id. A batch that runs again sees the same earlier batches
    and replaces its own three folders, so nothing is registered, accepted or
    rejected twice. Rows count in ``order`` within a batch, so the result is
    the same however the input falls into batches.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: str, address: str,
                 order: Sequence[str]):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.key, self.address, self.order = key, address, list(order)

    def _table(self, name: str, fields: list[T.StructField], before: int | None = None) -> DataFrame:
        kind = T.StructType([*fields, T.StructField("batch", T.LongType())])
        if not path_exists(self.spark, f"{self.root}/{name}"):
            return self.spark.createDataFrame([], kind)
        df = self.spark.read.schema(kind).parquet(f"{self.root}/{name}")
        return df if before is None else df.filter(F.col("batch") < before)

    def keys(self, before: int | None = None) -> DataFrame:
        """Registered keys with their address (of batches before one)."""
        return self._table("registry", [self.schema[self.key], self.schema[self.address]], before)

    def accepted(self) -> DataFrame:
        return self._table("accepted", self.schema.fields).drop("batch")

    def rejected(self) -> DataFrame:
        return self._table("rejected", self.schema.fields).drop("batch")

    def on_batch(self, batch: DataFrame, batch_id: int) -> None:
        known = self.keys(before=batch_id).select(self.key, F.lit(True).alias("__known"))
        at = F.struct(*self.order)
        has = F.col(self.address).isNotNull()
        first = batch.groupBy(self.key).agg(F.min(F.when(has, at)).alias("__first"),
                                            F.min_by(self.address, F.when(has, at)).alias("__address"))
        # written once: accepted, rejected and new keys come from the same rows
        judged = f"{self.root}/judged/batch={batch_id}"
        (batch.join(first, self.key, "left").join(known, self.key, "left")
         .withColumn("__ok", F.coalesce(F.col("__known") | (at >= F.col("__first")), F.lit(False)))
         .write.mode("overwrite").parquet(judged))
        rows = self.spark.read.parquet(judged)
        new = rows.filter("__known is null and __first is not null").groupBy(self.key).agg(
            F.min("__address").alias(self.address))
        for name, df in (("accepted", rows.filter("__ok").select(*self.schema.names)),
                         ("rejected", rows.filter("not __ok").select(*self.schema.names)),
                         ("registry", new)):
            df.write.mode("overwrite").parquet(f"{self.root}/{name}/batch={batch_id}")


# --- T06: repeated ids -------------------------------------------------------

def drop_repeats(stream: DataFrame, key: Sequence[str], watermark: str | None = None) -> DataFrame:
    """T06 (drop form): the first arrival of each key over all time (state:
    one row per key), however arrivals fall into batches. With ``watermark``,
    repeats within that delay only, and state that expires; which repeats
    then count depends on how far the watermark has moved when they arrive.
    :class:`FirstArrivals` keeps the keys in a table instead of state."""
    if watermark is None:
        return stream.dropDuplicates(list(key))
    s = with_event_time(stream, "ts").withWatermark("event_time", watermark)
    return s.dropDuplicatesWithinWatermark(list(key))


class FirstArrivals:
    """T06 (drop form) without stream state: each batch drops the keys that
    earlier batches have published and publishes its own first arrivals (the
    least in ``order``) under its batch id; a batch that runs again replaces
    them."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: Sequence[str],
                 order: Sequence[str]):
        self.spark, self.folder, self.schema = spark, f"{root.rstrip('/')}/first", schema
        self.key, self.order = list(key), list(order)

    def rows(self, before: int | None = None) -> DataFrame:
        kind = T.StructType([*self.schema.fields, T.StructField("batch", T.LongType())])
        if not path_exists(self.spark, self.folder):
            return self.spark.createDataFrame([], kind)
        df = self.spark.read.schema(kind).parquet(self.folder)
        return df if before is None else df.filter(F.col("batch") < before)

    def on_batch(self, batch: DataFrame, batch_id: int) -> None:
        rest = [c for c in self.schema.names if c not in self.key]
        key = [F.struct(c).alias(f"__{i}") for i, c in enumerate(self.key)]    # null keys are keys too
        names = [f"__{i}" for i in range(len(key))]
        first = batch.groupBy(*key).agg(
            F.min_by(F.struct(*self.key, *rest), F.struct(*self.order)).alias("__row"))
        seen = self.rows(before=batch_id).select(*key).distinct()
        new = first.join(seen, names, "left_anti").select("__row.*").select(*self.schema.names)
        new.write.mode("overwrite").parquet(f"{self.folder}/batch={batch_id}")


# --- T07: micro-batch append into the id-scoped cache -------------------------

def append_new_ids(stream: DataFrame, on_batch: Callable[[DataFrame, int], None],
                   name: str) -> None:
    """Hand every micro-batch to ``on_batch`` (e.g. an IdScopedCache
    fill), exactly once per batch id thanks to the checkpoint."""
    spark = stream.sparkSession
    ckpt = scratch_dir(spark, name) + "/checkpoint"
    q = (stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", ckpt)
         .trigger(availableNow=True).start())
    q.awaitTermination()


# --- T02: expire keys silent for longer than a timeout ------------------------

EXPIRED_SCHEMA = T.StructType([T.StructField("key", T.LongType()),
                               T.StructField("last_seen_us", T.LongType()),
                               T.StructField("expired", T.BooleanType())])
_SEEN_STATE = T.StructType([T.StructField(n, T.ArrayType(T.LongType())) for n in ("key", "last_us", "due_ms")])


def expire_silent_keys(stream: DataFrame, key: str, ts: str, timeout_sec: int,
                       watermark: str) -> DataFrame:
    """Arbitrary state per key holding the last event time; an
    event-time timer at last + timeout fires once the watermark passes it,
    emitting (key, last_seen, expired) and dropping the key's state. A key
    that is new, or comes back after it expired, emits a row that is not
    expired, so the latest row of a key tells its state
    (:func:`expired_keys`). Rows without a time count for nothing. Append
    mode."""
    timeout_ms = int(timeout_sec) * 1000
    values, frame = _state_helpers()

    def on_group(_, pdfs, state: GroupState):
        held = {k: (last, due) for k, last, due in zip(*state.get, strict=True)} if state.exists else {}
        now, seen = state.getCurrentWatermarkMs(), {}
        for pdf in () if state.hasTimedOut else pdfs:
            for k, us in zip(values(pdf["__key"], T.LongType()), pdf["__us"].tolist(), strict=True):
                if k not in seen or us > seen[k]:
                    seen[k] = us
        rows = [(k, us, False) for k, us in seen.items() if k not in held]
        for k, us in seen.items():
            last = max(us, held[k][0]) if k in held else us
            held[k] = last, max(last // 1000 + timeout_ms, now + 1)
        for k in [k for k, (_, due) in held.items() if due < now and k not in seen]:
            rows.append((k, held.pop(k)[0], True))
        if held:
            state.update(tuple(map(list, zip(*((k, *r) for k, r in held.items()), strict=True))))
            state.setTimeoutTimestamp(max(min(due for _, due in held.values()), now + 1))
        else:
            state.remove()
        if rows:
            yield frame(rows, EXPIRED_SCHEMA.names)

    s = (with_event_time(stream, ts).withWatermark("event_time", watermark).filter("event_time is not null")
         .select(F.col(key).cast("long").alias(key), "event_time",
                 F.unix_micros("event_time").alias("__us")))
    s = _grouped(s, key).select("__group", _exact(s, key).alias("__key"), "event_time", "__us")
    return s.groupBy("__group").applyInPandasWithState(
        on_group, EXPIRED_SCHEMA, _SEEN_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def expired_keys(stream: DataFrame, key: str, ts: str, timeout_sec: int, watermark: str,
                 progress: list | None = None) -> DataFrame:
    """(key, last_seen_us) of the keys that are expired when the stream ends,
    the same however it falls into batches."""
    rows = run_to_table(expire_silent_keys(stream, key, ts, timeout_sec, watermark), "expired", "append",
                        ["key"], progress)
    return rows.filter("expired").drop("expired")
