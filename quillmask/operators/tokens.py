"""Reversible tokens for entities: numbering within a scope, substitution, and restoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmask.functions import fixed
from quillmask.functions.spans import clear_spans, free_name, hold, let, match, substitute

SHAPE = "^<<[A-Z_]+_[0-9]+>>$"


def looks_like_token(text: Column) -> Column:
    """Whether a whole string has a token's shape, of any type name."""
    return text.rlike(SHAPE)


def valid(entities: Column, text: Column) -> Column:
    """Entities with proper bounds and a known type."""
    ok = lambda e: (e["start"] >= 0) & (e["end"] > e["start"]) & (e["end"] <= F.octet_length(text)) & e["type"].isin(*fixed.TYPES)
    return F.filter(entities, ok)


def format_token(kind: Column, number: Column) -> Column:
    return F.concat(F.lit("<<"), kind, F.lit("_"), number.cast("string"), F.lit(">>"))


def token_type(token: Column) -> Column:
    """Type of a token with a numeric suffix, else null."""
    kind = F.regexp_extract(token, "^<<([A-Z_]+)_[0-9]+>>$", 1)
    return F.when(kind != "", kind)


def assign(found: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """MAPPING: scope, value, type, n, token for rows of entities.

    A value is one token in its scope, of its first occurrence's type; numbers count the types' values by first
    occurrence.  Values are first reduced to their first occurrence, so a large scope numbers distinct values only.
    """
    place = F.struct(*order, "start", "ord") if order else F.struct("start", "ord")
    first = found.groupBy(*scope, "value").agg(F.min_by("type", place).alias("type"), F.min(place).alias("_first"))
    n = F.row_number().over(Window.partitionBy(*scope, "type").orderBy("_first", "value")).cast("long")
    return first.withColumn("n", n).withColumn("token", format_token(F.col("type"), F.col("n"))).drop("_first")


def tokenize(df: DataFrame, scope: list[str], order: list[str], text_col: str = "text", known: DataFrame | None = None, on_oversize: str = "null") -> tuple[DataFrame, DataFrame]:
    """(df with the column tokenized, MAPPING) for a frame that detect() has scanned.

    known: a mapping from before (scope, value, type, n, token) whose tokens stay; new values count on from there.
    on_oversize: what a text beyond detect()'s limit becomes, "null" or itself ("passthrough").
    Each row is found again by scope and order, which must tell rows apart; nulls in them equal nulls.
    """
    if on_oversize not in ("null", "passthrough"):
        raise ValueError(f"on_oversize: {on_oversize}")
    keys = list(dict.fromkeys([*scope, *order]))
    text = F.col(f"`{text_col}`")
    spans = df.select(*keys, F.explode(valid(F.col("entities"), text)).alias("_e")).select(*keys, "_e.*")
    if known is None:
        mapping = assign(spans, scope, order)
    else:
        fresh = match(spans, known.select(*scope, "value"), [*scope, "value"], "left_anti")
        most = known.groupBy(*scope, "type").agg(F.max("n").alias("_most"))
        added = match(assign(fresh, scope, order), most, [*scope, "type"], "left").withColumn("n", F.col("n") + F.coalesce("_most", F.lit(0)))
        mapping = known.select(*scope, "value", "type", "n", "token").unionByName(added.withColumn("token", format_token(F.col("type"), F.col("n"))).drop("_most"))
    tokens = match(spans, mapping.select(*scope, "value", "token"), [*scope, "value"], "inner").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start", "end", "token"))).alias("_tokens"))
    joined = match(df, tokens, keys, "left")
    held = free_name(joined, "_spans")
    joined = hold(joined, held, all=F.coalesce(F.col("_tokens"), F.array().cast("array<struct<start:int,end:int,token:string>>")))
    masked = substitute(text, F.col(held)["all"], lambda s: s["token"])
    if on_oversize == "null":
        masked = F.when(F.col("status") != "oversize", masked)
    return joined.withColumn("tokenized", masked).drop("_tokens", held), mapping


def restore(text: Column, values: Column) -> Column:
    """Text with the tokens that are keys of a map replaced by their values; values are not searched again."""
    gaps, hits = F.split(text, fixed.TOKEN, -1), F.regexp_extract_all(text, F.lit(fixed.TOKEN), F.lit(0))
    filled = lambda cut: F.transform(cut["hits"], lambda t, i: F.concat(F.get(cut["gaps"], i), F.coalesce(F.try_element_at(cut["values"], t), t)))
    whole = lambda cut: F.concat(F.array_join(filled(cut), ""), F.try_element_at(cut["gaps"], F.lit(-1)))
    return F.when(text.rlike(fixed.TOKEN), let(F.struct(gaps.alias("gaps"), hits.alias("hits"), F.coalesce(values, F.expr("cast(map() as map<string,string>)")).alias("values")), whole)).otherwise(text)


def rehydrate(df: DataFrame, mapping: DataFrame, scope: list[str], order: list[str], text_col: str = "tokenized", out: str = "rehydrated") -> DataFrame:
    """df with tokens replaced by their values; unknown ones stay, and values are not searched again.

    Tokens are joined with the mapping as rows, so a mapping of any size will do.  As in tokenize, scope and order tell
    rows apart, so a task that runs again finds the same rows.
    """
    keys = list(dict.fromkeys([*scope, *order]))
    used = df.select(*keys, F.explode(F.array_distinct(F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(fixed.TOKEN), F.lit(0)))).alias("token")).distinct()
    held = free_name(df, "_values")
    first = mapping.groupBy(*scope, "token").agg(F.min("value").alias("value"))
    values = match(used, first, [*scope, "token"], "inner").groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("token", "value"))).alias(held))
    joined = match(df, values, keys, "left")
    return joined.withColumn(out, restore(F.col(f"`{text_col}`"), F.col(held))).drop(held)


def count_tokens(text: Column) -> Column:
    """Tokens of any type name in a text."""
    return F.regexp_count(text, F.lit("<<[A-Z_]+_[0-9]+>>"))


def max_counters(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """keys, type, top: the largest counter of each known type; counters beyond 64 bits are skipped."""
    hits = df.select(*keys, F.explode(F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(fixed.TOKEN), F.lit(0))).alias("_t"))
    parts = hits.select(*keys, F.regexp_extract("_t", fixed.TOKEN, 1).alias("type"), F.regexp_extract("_t", fixed.TOKEN, 2).try_cast("long").alias("n"))
    return parts.where("n IS NOT NULL").groupBy(*keys, "type").agg(F.max("n").alias("top"))


def replace_segments(body: Column, segments: Column) -> Column:
    """body with array<struct<start,end,text>> (bytes) put in place, out-of-bounds, overlapping and empty-range ones left out."""
    ok = F.filter(segments, lambda s: (s["start"] >= 0) & (s["end"] > s["start"]) & (s["end"] <= F.octet_length(body)))
    return let(clear_spans(F.sort_array(ok)), lambda clear: substitute(body, clear, lambda s: s["text"]))
