"""Sinks and table maintenance.

All state lives in tables on the shared file system (Parquet written by
Spark), never in driver memory or machine-local folders, so a job that
loses executors or restarts re-reads what was committed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from turnlens.operators.ordered import ordered_scan
from turnlens.operators.quality import require_rows
from turnlens.session import path_exists, scratch_dir
from turnlens.sinks.ingest import StatsStore

ROWS_PER_FILE = 200_000      # K01 sizing rule: ceil(rows / 200000) files
IDS_PER_FILE = 1_000         # ids whose rows one writer of the id-scoped cache takes


def write_counted(df: DataFrame, path: str, metrics: Mapping[str, Column] | None = None,
                  write: Callable[[DataFrame, str], None] | None = None) -> dict[str, int]:
    """Write ``df`` (Parquet unless ``write`` says how) and
    return its row count ``rows`` and the aggregates ``metrics`` (rejects, null
    keys, ...), all taken while the rows are written: the input is computed
    once."""
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"),
                         *[c.alias(name) for name, c in (metrics or {}).items()])
    if write:
        write(counted, path)
    else:
        counted.write.mode("overwrite").parquet(path)
    return {"rows": 0, **dict.fromkeys(metrics or {}, 0), **seen.get}


def null_keys(keys: Sequence[str]) -> dict[str, Column]:
    """Metrics for :func:`write_counted`: rows whose key has a null."""
    return {"null_keys": F.count_if(reduce(Column.__or__, [F.col(k).isNull() for k in keys]))}


def write_csv_sized(df: DataFrame, path: str, approx_rows: int | None = None,
                    metrics: Mapping[str, Column] | None = None, expect: int | None = None) -> dict[str, int]:
    """CSV with a header, one file per ``ROWS_PER_FILE`` rows, and
    ``maxRecordsPerFile`` as a hard cap per file. The input is computed once:
    it goes to a scratch table while its rows are counted, and the files are
    cut from there. Returns the counts; with ``expect`` another number of rows
    is an error, as is a CSV that got other rows than the scratch table."""
    def csv(out: DataFrame, to: str) -> None:
        out.write.mode("overwrite").option("header", True).option("maxRecordsPerFile", ROWS_PER_FILE).csv(to)

    if approx_rows is None:
        scratch = scratch_dir(df.sparkSession, "csv")
        counts = write_counted(df, scratch, metrics)
        require_rows(counts["rows"], expect, path)
        files = max(1, -(-counts["rows"] // ROWS_PER_FILE))
        stored = df.sparkSession.read.schema(df.schema).parquet(scratch)
        require_rows(write_counted(stored.repartition(files), path, None, csv)["rows"], counts["rows"], path)
        return counts
    files = max(1, -(-approx_rows // ROWS_PER_FILE))
    counts = write_counted(df.repartition(files), path, metrics, csv)
    require_rows(counts["rows"], expect, path)
    return counts


def write_partitioned(df: DataFrame, path: str, by: str, fmt: str = "parquet") -> None:
    """One output folder per value (e.g. per era)."""
    df.write.mode("overwrite").partitionBy(by).format(fmt).save(path)


class IdScopedCache:
    """Parse only ids not stored yet, append them, and read back
    exactly the requested ids in the original column order. A manifest
    table records every processed id, including ids whose parse produced no
    rows, so those are not parsed again.

    Rows are stored partitioned by a hash bucket of the id (not by the id
    itself: millions of ids would mean millions of folders and tiny files);
    reads prune buckets through a semi join on the bucket column (dynamic
    partition pruning).

    Each run writes its rows to a folder of its own and then publishes the
    folder by appending its manifest rows; reads take published folders only.
    A run that breaks off between the two leaves rows that nobody reads, and
    the next run computes those ids again."""

    def __init__(self, spark: SparkSession, root: str, name: str, id_col: str,
                 n_buckets: int = 64):
        self.spark, self.id_col, self.n_buckets = spark, id_col, n_buckets
        self.table = f"{root.rstrip('/')}/{name}"
        self.manifest = f"{root.rstrip('/')}/_manifest/{name}"

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.id_col)), F.lit(self.n_buckets)).cast("int")

    def _read_manifest(self, id_type: T.DataType) -> DataFrame | None:
        schema = T.StructType([T.StructField(self.id_col, id_type),
                               T.StructField("n_rows", T.LongType()),
                               T.StructField("schema_json", T.StringType()),
                               T.StructField("run", T.StringType())])
        if not path_exists(self.spark, self.manifest):
            return None
        return self.spark.read.schema(schema).parquet(self.manifest)

    def get(self, ids: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``ids``: a frame with the id column. ``compute`` maps a frame of
        ids to parsed rows that contain the id column."""
        id_type = ids.schema[self.id_col].dataType
        ids = ids.select(self.id_col).distinct()
        done = self._read_manifest(id_type)
        self.first_run = done is None      # callers may then scan everything at once
        todo = ids if done is None else ids.join(done.select(self.id_col), self.id_col,
                                                 "left_anti")
        if todo.limit(1).count() > 0:
            parsed, run = compute(todo), uuid.uuid4().hex
            # as many writers a bucket as its ids ask for
            salts = max(1, todo.count() // (self.n_buckets * IDS_PER_FILE))
            (parsed.withColumn("_bucket", self._bucket())
             .repartition(self.n_buckets * salts, "_bucket", F.pmod(F.hash(self.id_col), F.lit(salts)))
             .write.partitionBy("_bucket").parquet(f"{self.table}/run={run}"))
            self._publish(todo, parsed.schema, run)
        man = self._read_manifest(id_type)
        schema = T.StructType.fromJson(json.loads(man.select(F.max("schema_json")).first()[0]))
        cols = schema.fieldNames()
        runs = [r.run for r in man.select("run").distinct().collect()]   # one per append
        stored = self._read_rows(schema, runs)
        wanted = ids.withColumn("_bucket", self._bucket())
        stored = stored.join(wanted.select("_bucket").distinct(), "_bucket", "left_semi")
        return stored.join(wanted.select(self.id_col), self.id_col, "left_semi").select(*cols)


    def _read_rows(self, schema: T.StructType, runs: Sequence[str]) -> DataFrame:
        fields = T.StructType(schema.fields + [T.StructField("run", T.StringType()),
                                               T.StructField("_bucket", T.IntegerType())])
        return (self.spark.read.schema(fields).option("basePath", self.table)
                .parquet(*[f"{self.table}/run={r}" for r in runs]).drop("run"))

    def _publish(self, todo: DataFrame, schema: T.StructType, run: str) -> None:
        """Mark the run's ids as done, with row counts from the written files."""
        counts = self._read_rows(schema, [run]).groupBy(self.id_col).agg(
            F.count(F.lit(1)).alias("n_rows"))
        marks = (todo.join(counts, self.id_col, "left")
                 .select(self.id_col, F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"),
                         F.lit(schema.json()).alias("schema_json"), F.lit(run).alias("run")))
        marks.write.mode("append").parquet(self.manifest)


def manifest_is_fresh(spark: SparkSession, manifest_path: str, output: str,
                      source_version: str, required_columns: Sequence[str] = (),
                      fingerprint: str = "") -> bool:
    """An output is fresh when its manifest row has the current
    source version and parameter fingerprint and lists all required columns."""
    if not path_exists(spark, manifest_path):
        return False
    m = spark.read.parquet(manifest_path).filter(F.col("output") == output)
    row = m.orderBy(F.col("written_at").desc()).first()
    if row is None or row["source_version"] != source_version or row["fingerprint"] != fingerprint:
        return False
    have = set(json.loads(row["columns"]))
    return set(required_columns) <= have


def ensure_output(spark: SparkSession, manifest_path: str, output_path: str, output: str,
                  source_version: str, builder: Callable[[], DataFrame], force: bool = False,
                  required_columns: Sequence[str] = (), fingerprint: str = "",
                  unique: Sequence[str] = ()) -> DataFrame:
    """Rebuild ``output`` only when stale, forced, or missing
    required columns; record the build in the manifest table. With ``unique``
    the output must have one row per these columns, else the build fails and
    the manifest does not name it."""
    if force or not manifest_is_fresh(spark, manifest_path, output, source_version,
                                      required_columns, fingerprint):
        df = builder()
        rows = write_counted(df, output_path)["rows"]
        if unique:
            stored = spark.read.parquet(output_path)
            require_rows(rows, stored.select(*unique).distinct().count(), output)
        row = spark.createDataFrame(
            [(output, source_version, fingerprint, json.dumps(df.columns))],
            "output string, source_version string, fingerprint string, columns string")
        row.withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(manifest_path)
    return spark.read.parquet(output_path)


def schema_matches(actual: T.StructType, expected: T.StructType) -> bool:
    """K08 match rule: same names, types and order."""
    return [(f.name, f.dataType) for f in actual.fields] == \
        [(f.name, f.dataType) for f in expected.fields]


def ingest_with_contract(spark: SparkSession, files: Mapping[str, Mapping[str, DataFrame]],
                         contract: Mapping[str, T.StructType], store: str,
                         quarantine: str) -> DataFrame:
    """Every table of a file is validated first; tables without a
    contract create one (new table); any mismatch quarantines the whole
    file. Accepted tables are appended to ``store/<table>``, quarantined ones
    to ``quarantine/<file>/<table>``. Returns the ingest report."""
    report = []
    contract = dict(contract)
    for fname, tables in files.items():
        bad = [t for t, df in tables.items()
               if t in contract and not schema_matches(df.schema, contract[t])]
        status = "quarantined" if bad else "accepted"
        for t, df in tables.items():
            if bad:
                df.write.mode("append").parquet(f"{quarantine}/{fname}/{t}")
            else:
                contract.setdefault(t, df.schema)
                df.withColumn("_source_file", F.lit(fname)).write.mode("append").parquet(
                    f"{store}/{t}")
            report.append((fname, t, status, ",".join(bad)))
    return spark.createDataFrame(report, "file string, table_name string, status string, "
                                         "mismatched string")


def nested_list_json(df: DataFrame, group: str, key: str, item: str,
                     out: str = "json") -> DataFrame:
    """Group → {key: sorted distinct items} as JSON text."""
    per = df.groupBy(group, key).agg(F.sort_array(F.collect_set(item)).alias("__items"))
    m = per.groupBy(group).agg(F.map_from_entries(
        F.sort_array(F.collect_list(F.struct(key, "__items")))).alias("__m"))
    return m.select(group, F.to_json("__m").alias(out))


def append_audit(spark: SparkSession, path: str, fields: Mapping[str, object],
                 metadata: Mapping[str, object]) -> None:
    """Append one audit row with JSON metadata (sorted keys)."""
    row = dict(fields)
    row["metadata_json"] = json.dumps(dict(metadata), sort_keys=True)
    df = spark.createDataFrame([row]).withColumn("ingested_at", F.current_timestamp())
    df.write.mode("append").parquet(path)


def splice_segments(lines: DataFrame, name: str, seg: str, line_no: str,
                    headered: Sequence[str], out: str = "out_line") -> DataFrame:
    """Concatenate ordered segments of each log; for headered logs the
    first line of every segment after the log's first segment is dropped.
    ``out`` is the line's position in the spliced log (a split ordered scan,
    chunked by segment, so one long log does not sit in one task)."""
    first_seg = lines.groupBy(name).agg(F.min(seg).alias("__first"))
    j = lines.join(first_seg, name)
    drop = F.col(name).isin(*headered) & (F.col(line_no) == 0) & (F.col(seg) > F.col("__first"))
    kept = j.filter(~drop).drop("__first")
    return ordered_scan(kept, [name], [seg, line_no], F.col(seg), row_number=out)


def contract_of(df: DataFrame, extra: Sequence[tuple[str, T.DataType]] = ()) -> T.StructType:
    """Helper for contracts: a table's schema, optionally with extra fields."""
    return T.StructType(df.schema.fields + [T.StructField(n, t) for n, t in extra])


def ingest_stats_file(spark: SparkSession, store: str, quarantine: str, file_name: str,
                      tables: Mapping[str, DataFrame], contract: Mapping[str, T.StructType]) -> DataFrame:
    """K08 + K09 + J21 + J25: ingest one per-game stats file into the store as
    one commit; see :class:`turnlens.sinks.ingest.StatsStore`."""
    return StatsStore(spark, store, quarantine).ingest(file_name, tables, contract)
