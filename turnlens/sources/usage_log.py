"""Nested usage logs (S28, A58, F04): one JSON document per file with an
array of entries, each a request (token usage, start and end time) or a tool
call. Parsed with a schema, exploded with position, rolled up per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from turnlens.functions.columns import epoch_micros

ENTRY = ("struct<kind: string, time: string, metadata: struct<startTime: string, endTime: string, "
         "usage: struct<prompt_tokens: long, completion_tokens: long, "
         "prompt_tokens_details: struct<cached_tokens: long>>>>")
LOG = f"struct<logs: array<{ENTRY}>>"


def entries(files: DataFrame, file: str, text: str) -> DataFrame:
    """(file, entry_no, kind, time, started, ended, prompt_tokens,
    completion_tokens, cached_tokens) per entry of every file. A file that is
    no such document, or has no entries, gives no row. Times that cannot be
    read are null; only requests have usage and start and end times."""
    log = files.select(F.col(file).alias("file"), F.from_json(text, LOG).alias("log"))
    e = log.select("file", F.posexplode("log.logs").alias("entry_no", "e"))
    request = F.col("e.kind") == "request"

    def time(name: str) -> Column:
        return F.try_to_timestamp(f"e.{name}")

    def tokens(name: str) -> Column:
        return F.when(request, F.coalesce(F.col(f"e.metadata.usage.{name}"), F.lit(0))).otherwise(F.lit(0))

    return e.select(
        "file", "entry_no", F.col("e.kind").alias("kind"), time("time").alias("time"),
        F.when(request, time("metadata.startTime")).alias("started"),
        F.when(request, time("metadata.endTime")).alias("ended"),
        tokens("prompt_tokens").alias("prompt_tokens"),
        tokens("completion_tokens").alias("completion_tokens"),
        tokens("prompt_tokens_details.cached_tokens").alias("cached_tokens"))


def duration(seconds: Column) -> Column:
    """``1h 2m 3s``, without leading zero parts."""
    s = F.when(seconds.isNotNull(), F.greatest(F.floor(seconds), F.lit(0)))
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%dh %dm %ds", h, m, r)).when(
        m > 0, F.format_string("%dm %ds", m, r)).when(s.isNotNull(), F.format_string("%ds", r))


def usage(rows: DataFrame) -> DataFrame:
    """Roll-up per file of :func:`entries`: requests, tool calls, three token
    sums, first and last of all times, and the span between them."""
    first, last = F.least("time", "started", "ended"), F.greatest("time", "started", "ended")
    g = rows.groupBy("file").agg(
        F.count_if(F.col("kind") == "request").alias("n_requests"),
        F.count_if(F.col("kind") == "toolCall").alias("n_tool_calls"),
        F.sum("prompt_tokens").alias("total_input_tokens"), F.sum("cached_tokens").alias("cached_input_tokens"),
        F.sum("completion_tokens").alias("output_tokens"),
        F.min(first).alias("first_time"), F.max(last).alias("last_time"))
    span = (epoch_micros("last_time") - epoch_micros("first_time")) / 1e6
    return g.withColumn("input_tokens", F.col("total_input_tokens") - F.col("cached_input_tokens")) \
        .withColumn("span_sec", span).withColumn("span", F.coalesce(duration(span), F.lit("n/a")))
