"""Queries that run as streams: tables are fed in several micro-batches, out of order, and each run starts again from the checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmask.functions import fixed
from quillmask.plans.flows import KEY, _token_chunks
from quillmask.plans.queries import _SAID, NOW, SQL_OF_TOKENS
from quillmask.plans.registry import query, scratch, table
from quillmask.sources import vault
from quillmask.sources.store import Store
from quillmask.streaming import streams

NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"


def _fed(spark: SparkSession, rows: DataFrame, part: str, parts: int, at: str, run: Callable[[DataFrame, str], object]) -> None:
    """Feeds the rows part by part to a stream that run(live, checkpoint) starts, each time to its end.

    Streams with timers would go on making micro-batches without data, and never end.
    """
    rows.write.parquet(f"{at}/rows")
    rows, before = spark.read.schema(rows.schema).parquet(f"{at}/rows"), spark.conf.get(NO_DATA)
    spark.conf.set(NO_DATA, "false")
    try:
        for k in range(parts):
            rows.where(f"{part} = {k}").write.mode("append").parquet(f"{at}/in")
            run(spark.readStream.schema(rows.schema).parquet(f"{at}/in"), f"{at}/checkpoint").awaitTermination()
    finally:
        spark.conf.set(NO_DATA, before)


def _replayed(spark: SparkSession, rows: DataFrame, part: str, parts: int, name: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream gives for the rows, written to files."""
    at, made = scratch(spark, name), []

    def run(live, checkpoint):
        out = build(live)
        made.append(out.schema)
        return out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    _fed(spark, rows, part, parts, at, run)
    return spark.read.schema(made[0]).parquet(f"{at}/out")


@query("stream_tokenize", SQL_OF_TOKENS)
def stream_tokenize(spark, sf_dir):
    """Turns 0, 3, 6, ... come first, then 1, 4, ..., then the others: tokens are those of the batch, numbered by turns."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_SAID).alias("text"), (F.col("turn") % 3).alias("part"))
    out = _replayed(spark, rows, "part", 3, "tokens", lambda live: streams.token_stream(live, "conv_id", "turn"))
    return out.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.md5("text").alias("tokenized"))


@query("stream_rewrite", """
WITH s AS (SELECT conv_id, string_agg('event: t' || chr(10) || 'data: hi user' || (turn % 2 + 1) || '@example.org and <<EMAIL_9>>' || chr(10) || chr(10), '' ORDER BY turn) AS body, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT conv_id AS stream_id, body || 'data: tail <<EMAIL_1>>' AS body, n AS restored FROM s""")
def stream_rewrite(spark, sf_dir):
    """The streams of sse_rewrite as they come, every third chunk first: the same bytes."""
    chunks, mapping = _token_chunks(spark, sf_dir)
    chunks = chunks.select(F.col("stream_id").cast("string").alias("stream_id"), F.col("seq").cast("long").alias("seq"), "chunk")
    ends = chunks.groupBy("stream_id").agg((F.max("seq") + 1).alias("seq")).withColumn("chunk", F.lit(None).cast("string"))
    mapping = mapping.withColumn("stream_id", F.col("stream_id").cast("string"))
    rows = chunks.unionByName(ends).withColumn("part", F.col("seq") % 3)
    out = _replayed(spark, rows, "part", 3, "rewritten", lambda live: streams.rewrite_stream(live, mapping))
    whole = out.groupBy("stream_id").agg(F.sort_array(F.collect_list(F.struct("frame_no", "body"))).alias("f"), F.sum("restored").alias("restored"))
    return whole.select(F.col("stream_id").cast("long").alias("stream_id"), F.array_join(F.transform("f", lambda f: f["body"].cast("string")), "").alias("body"), "restored")


_FRAME = "'event: ' || role || chr(10) || 'data: ' || replace(replace(coalesce(text, ''), chr(13), ''), chr(10), chr(10) || 'data: ')"


@query("stream_frames", f"""
WITH f AS (SELECT conv_id, turn, {_FRAME} AS frame FROM conversations)
SELECT conv_id AS stream_id, count(*) AS frames, md5(string_agg(CASE WHEN strlen(frame) > {fixed.FRAME} THEN 'oversize' ELSE frame END, '|' ORDER BY turn)) AS md5 FROM f GROUP BY conv_id""")
def stream_frames(spark, sf_dir):
    """Conversations with their whole texts as event streams, cut into chunks of 997 characters, odd chunks after even ones."""
    said = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit("\r\ndata: "))
    frame = F.concat(F.lit("event: "), "role", F.lit("\r\ndata: "), said, F.lit("\r\n\r\n"))
    whole = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("stream_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", frame.alias("f")))), lambda x: x["f"]), "").alias("t"))
    cut = F.transform(F.sequence(F.lit(0), ((F.length("t") - 1) / 997).cast("int")), lambda k: F.substring(F.col("t"), k * 997 + 1, F.lit(997)))
    chunks = whole.select("stream_id", F.posexplode(cut).alias("seq", "chunk")).select("stream_id", F.col("seq").cast("long").alias("seq"), "chunk", (F.col("seq") % 2).alias("part"))
    out = _replayed(spark, chunks, "part", 2, "frames", streams.frame_stream)
    every = F.transform(F.sort_array(F.collect_list(F.struct("frame_no", F.coalesce("frame", "problem").alias("f")))), lambda x: x["f"])
    return out.groupBy(F.col("stream_id").cast("long").alias("stream_id")).agg(F.count(F.lit(1)).alias("frames"), F.md5(F.array_join(every, "|")).alias("md5"))


_STORED = "'<<' || upper(event_type) || '_' || (event_id // 4 % 5) || '>>'"


@query("vault_sweep_stream", f"""
WITH w AS (SELECT event_id % 4 AS part, user_id, upper(event_type) AS type, {_STORED} AS token, ts FROM events),
gone AS (SELECT user_id FROM w WHERE part < 3 GROUP BY user_id HAVING min(ts) + INTERVAL 168 HOURS < {NOW}),
kept AS (SELECT * FROM w WHERE part = 3 OR user_id NOT IN (FROM gone)),
meta AS (SELECT user_id, count(*) AS pii_count, array_to_string(list_sort(list(DISTINCT type)), ',') AS pii_types, min(ts) AS created_at, max(ts) AS updated_at FROM kept GROUP BY user_id)
SELECT user_id::VARCHAR AS conversation_id, token, 'v' || epoch_us(max(ts)) AS value, pii_count, pii_types, created_at, updated_at FROM kept JOIN meta USING (user_id) GROUP BY ALL""")
def vault_sweep_stream(spark, sf_dir):
    """Three runs of micro-batches, a sweep, and one more run: tokens that were rewritten, expired conversations, and those that come again."""
    token = F.concat(F.lit("<<"), F.upper("event_type"), F.lit("_"), F.floor(F.col("event_id") / 4) % 5, F.lit(">>"))
    rows = table(spark, sf_dir, "events").select(
        F.lit("alpha").alias("provider"), F.col("user_id").cast("string").alias("conversation_id"), token.alias("token"), F.upper("event_type").alias("type"),
        F.concat(F.lit("v"), F.unix_micros(F.col("ts").cast("timestamp"))).alias("value"), F.col("ts").cast("timestamp").alias("created_at"), (F.col("event_id") % 4).alias("part"),
    )
    at, runs = scratch(spark, "vault"), []
    store = Store(spark, f"{at}/store")

    def run(live, checkpoint):
        if len(runs) == 3:
            store.sweep(F.expr(NOW), 168)
        runs.append(streams.persist_stream(vault.entries(live, KEY, F.col("created_at")), store.path, checkpoint, availableNow=True))
        return runs[-1]

    _fed(spark, rows, "part", 4, at, run)
    meta = store.metadata().select("conversation_id", "pii_count", F.array_join("pii_types", ",").alias("pii_types"), *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("created_at", "updated_at")))
    return store.read().select("conversation_id", "token", vault.unseal(F.col("value"), KEY).alias("value")).join(meta, "conversation_id")
