"""Value-free audit columns and rollups over detected entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmask.functions import fixed
from quillmask.sources.sse import until_done


def summary(entities: Column) -> Column:
    """map of type to count; null for none."""
    kinds = F.transform(entities, lambda e: e["type"])
    counts = F.transform(F.array_distinct(kinds), lambda t: F.struct(t.alias("k"), F.size(F.filter(kinds, lambda x: x == t)).alias("v")))
    return F.when(F.size(entities) > 0, F.map_from_entries(counts))


def label(entities: Column, status: Column) -> Column:
    """Label of a scanned text; one that was not scanned is "unscanned", never clean."""
    return F.when(F.size(entities) > 0, "pii_found").when(status.isin("ok", "empty"), "clean").otherwise("unscanned")


def records(df: DataFrame, text_col: str = "text", pii_logging: bool = True, **constants: str) -> DataFrame:
    """df (scanned by detect) with result, bytes_analyzed, entity_count and entity_summary; values never appear."""
    out = df.withColumn("result", label(F.col("entities"), F.col("status"))).withColumn("bytes_analyzed", F.coalesce(F.octet_length(f"`{text_col}`"), F.lit(0))).withColumn("entity_count", F.size("entities"))
    out = out.withColumn("entity_summary", summary(F.col("entities")) if pii_logging else F.lit(None).cast("map<string,int>"))
    for name, value in constants.items():
        out = out.withColumn(name, F.lit(value))
    return out.drop("entities", "raw_entities")


def sink(records_: DataFrame, path: str, kind: str = "json") -> None:
    """Appends audit records as JSON lines (or another file format), by day where they have a ts."""
    out = records_.write.mode("append")
    if "ts" in records_.columns:
        out = records_.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day")
    out.format(kind).save(path)


def changed_segments(before: Column, after: Column) -> Column:
    """How many of two arrays' texts differ at their place."""
    return F.size(F.filter(F.arrays_zip(before.alias("a"), after.alias("b")), lambda p: ~p["a"].eqNullSafe(p["b"]))).cast("long")


def rollup(entities: DataFrame, *by: str) -> DataFrame:
    """Counts by every level of the given columns and in total."""
    return entities.rollup(*by).agg(F.count(F.lit(1)).alias("n"))


def stream_totals(frames: DataFrame, key: str = "stream_id") -> DataFrame:
    """One aggregate per stream of scanned frames (frame_no, entities, data) before its end marker: frames, entity_count, bytes."""
    if "frame_no" in frames.columns:
        frames = until_done(frames, key)
    return frames.groupBy(key).agg(F.count(F.lit(1)).alias("frames"), F.sum(F.size("entities")).cast("long").alias("entity_count"), F.sum(F.octet_length("data")).cast("long").alias("bytes"))


def ring(flows: DataFrame, order: list[str], bodies: tuple[str, ...] = (), size: int = fixed.RING) -> DataFrame:
    """The last `size` flows, numbered from 1 in order, bodies cut to a limit.  A top-k, not a global sort."""
    last = flows.orderBy(*[F.col(c).desc() for c in order]).limit(size)
    cut = lambda c: F.when(F.octet_length(c) > fixed.RING_BODY, F.concat(F.substring(F.col(c).cast("binary"), 1, fixed.RING_BODY).cast("string"), F.lit("...[truncated]"))).otherwise(F.col(c))
    for c in bodies:
        last = last.withColumn(c, cut(c))
    return last.withColumn("ring_id", F.row_number().over(Window.orderBy(*order)).cast("long"))  # of `size` rows at most


def rehydration_counts(before: Column, after: Column) -> tuple[Column, Column]:
    """(tokens present, tokens replaced)."""
    from quillmask.operators.tokens import count_tokens

    return count_tokens(before), count_tokens(before) - count_tokens(after)
