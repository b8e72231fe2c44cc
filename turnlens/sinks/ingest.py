"""Ingest of per-game stats files as single commits.

A file's tables are staged under a run folder of their own and become part of
the store by one commit record, created exclusively under the next sequence
number. Readers take the runs that records name, so a run that breaks off
anywhere leaves rows that nobody reads; running the file again stages it anew
and publishes it once, and a file that is already published is not taken
twice. Ids for unseen uuids are minted after the largest published id and
published by the same record: a second writer that minted from the same base
finds the sequence number taken and starts over from the new state.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from turnlens.session import path_exists

GAME_FK = "GameId"
UUID_DICTIONARY = "uuid_dictionary"
COMMIT_SCHEMA = ("seq long, file string, status string, run string, "
                 "tables array<struct<name: string, schema: string, rows: long, unmatched: long>>")
REPORT_SCHEMA = "file string, table_name string, status string, rows long"
DICTIONARY = T.StructType([T.StructField("uuid_hex", T.StringType()), T.StructField("id", T.LongType())])


class StatsStore:
    def __init__(self, spark: SparkSession, root: str, quarantine: str):
        self.spark, self.root, self.quarantine = spark, root.rstrip("/"), quarantine.rstrip("/")

    # --- published state -------------------------------------------------------

    def commits(self) -> DataFrame:
        """One row per commit record; a record that was cut off while it was
        written is none."""
        if not path_exists(self.spark, f"{self.root}/_commits"):
            return self.spark.createDataFrame([], COMMIT_SCHEMA)
        return self.spark.read.schema(COMMIT_SCHEMA).json(f"{self.root}/_commits").filter("seq is not null")

    def runs(self, table: str) -> DataFrame:
        """Published runs that hold rows of a table."""
        return self.commits().filter("status = 'accepted'").select(
            "seq", "run", F.explode("tables").alias("t")).filter(F.col("t.name") == table)

    def schema(self, table: str) -> T.StructType | None:
        """The schema that the table's first commit gave it."""
        first = self.runs(table).agg(F.min_by("t.schema", "seq").alias("s")).first()
        return T.StructType.fromJson(json.loads(first.s)) if first.s else None

    def table(self, table: str) -> DataFrame:
        """The published rows of a table."""
        schema = self.schema(table)
        if schema is None:
            raise ValueError(f"the store has no table {table}")
        return self._read(table, schema).join(self.runs(table).select("run"), "run", "left_semi") \
            .select(*schema.fieldNames())

    def dictionary(self) -> DataFrame:
        if self.schema(UUID_DICTIONARY) is None:
            return self.spark.createDataFrame([], DICTIONARY)
        return self.table(UUID_DICTIONARY)

    def _read(self, table: str, schema: T.StructType) -> DataFrame:
        fields = T.StructType([*schema.fields, T.StructField("run", T.StringType())])
        return self.spark.read.schema(fields).option("basePath", f"{self.root}/{table}") \
            .parquet(f"{self.root}/{table}")

    # --- writing ---------------------------------------------------------------

    def write(self, df: DataFrame, path: str) -> None:
        df.write.mode("overwrite").parquet(path)

    def publish(self, record: Mapping) -> bool:
        """Create the record's file unless its number is taken."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(
            f"{self.root}/_commits/{record['seq']:012d}.json")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            out = fs.create(path, False)
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        out.write(bytearray(json.dumps(record, sort_keys=True).encode() + b"\n"))
        out.close()
        return True

    def _next(self) -> int:
        """A number above all records, whole or cut off."""
        if not path_exists(self.spark, f"{self.root}/_commits"):
            return 1
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/_commits")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return 1 + max([int(n.split(".")[0]) for n in names if n.endswith(".json") and not n.startswith(".")],
                       default=0)

    def ingest(self, file: str, tables: Mapping[str, DataFrame],
               contract: Mapping[str, T.StructType]) -> DataFrame:
        """Ingest one stats file: its ``uuid_dictionary`` (id, uuid_hex) and
        fact tables keyed by a file-local ``GameId``.

        Every fact schema is checked first, against the store where it has the
        table, else against ``contract``; a table that neither knows is new.
        Any mismatch sends the whole file to quarantine. Otherwise local ids
        become global ones in every fact table, and all tables are published
        at once. Returns one report row per table, one more for rows whose id
        the file's dictionary does not name. A published file is not ingested
        again; its report is returned."""
        while True:
            known = self.commits().filter(F.col("file") == file).orderBy("seq").limit(1).collect()
            if known:
                return self._report(known[0].asDict(recursive=True))
            seq, run = self._next(), f"r{uuid.uuid4().hex}"
            from turnlens.sinks.store import schema_matches
            facts = {t: df for t, df in tables.items() if t != UUID_DICTIONARY}
            expected = {t: self.schema(t) or contract.get(t) for t in facts}
            bad = [t for t, df in facts.items()
                   if expected[t] is not None and not schema_matches(df.schema, expected[t])]
            if bad:
                for t, df in tables.items():
                    self.write(df, f"{self.quarantine}/{file}/{t}")
                held = [(t, facts[t].schema, 0, 0) for t in facts]
            else:
                held = self._stage(run, tables[UUID_DICTIONARY], facts)
            record = {"seq": seq, "file": file, "status": "quarantined" if bad else "accepted", "run": run,
                      "tables": [{"name": t, "schema": s.json(), "rows": n, "unmatched": lost}
                                 for t, s, n, lost in held]}
            if self.publish(record):
                return self._report(record)

    def _stage(self, run: str, local: DataFrame, facts: Mapping[str, DataFrame]) -> list[tuple]:
        from turnlens.operators.keyed import mint_ids
        local = local.filter("uuid_hex is not null").select(F.col("id").alias("__local"), "uuid_hex")
        current = self.dictionary()
        minted = mint_ids(current, local.select("uuid_hex"), "uuid_hex", "id") \
            .join(current.select("uuid_hex"), "uuid_hex", "left_anti").select(*DICTIONARY.names)
        path = f"{self.root}/{UUID_DICTIONARY}/run={run}"
        seen = Observation()
        self.write(minted.observe(seen, F.count(F.lit(1)).alias("n")), path)
        new = self.spark.read.schema(DICTIONARY).parquet(path)
        translate = local.join(current.unionByName(new), "uuid_hex").select("__local", F.col("id").alias("__global"))
        held = [(UUID_DICTIONARY, DICTIONARY, seen.get["n"], 0)]
        for t, df in facts.items():
            joined = df.join(translate, df[GAME_FK] == F.col("__local"), "left")
            counts = Observation()      # taken while the rows are written
            counted = joined.observe(counts, F.count("__global").alias("n"),
                                     F.count_if(F.col("__global").isNull()).alias("lost"))
            rows = counted.filter("__global is not null").select(*[
                F.col("__global").cast(df.schema[GAME_FK].dataType).alias(GAME_FK) if c == GAME_FK else df[c]
                for c in df.columns])
            self.write(rows, f"{self.root}/{t}/run={run}")
            held.append((t, df.schema, counts.get["n"], counts.get["lost"]))
        return held

    def _report(self, record: Mapping) -> DataFrame:
        out = []
        for t in record["tables"]:
            if t["name"] != UUID_DICTIONARY:
                out.append((record["file"], t["name"], record["status"], t["rows"]))
                if t["unmatched"]:
                    out.append((record["file"], t["name"], "unmatched", t["unmatched"]))
        return self.spark.createDataFrame(out, REPORT_SCHEMA)
