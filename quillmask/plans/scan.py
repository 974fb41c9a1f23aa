"""A scan as one call: guard, extract, validate, detect, tokenize, rewrite and audit requests; restore and audit responses."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmask.functions import fixed
from quillmask.functions.spans import ENTITY, match
from quillmask.operators import audit, tokens
from quillmask.operators import detect as det
from quillmask.plans import policy
from quillmask.sources import extract


@dataclass(frozen=True)
class Plugin:
    """What is known of a provider's bodies: whose paths they are, and where their texts stand."""

    name: str
    owns: Callable[[Column], Column]
    request_texts: Callable[[Column], Column]
    response_texts: Callable[[Column], Column]


PLUGINS: dict[str, Plugin] = {}


def register(plugin: Plugin) -> None:
    """Adds a provider's plug-in, or replaces that of its name."""
    if not plugin.name or "/" in plugin.name:
        raise ValueError(f"bad provider name {plugin.name!r}")
    PLUGINS[plugin.name] = plugin


register(Plugin("parts", policy.provider_path, extract.request_parts, extract.response_parts))


class Scan(NamedTuple):
    """rows: the requests with rewritten and what was found; mapping: tokens (None unless enforcing); audit: value-free records."""

    rows: DataFrame
    mapping: DataFrame | None
    audit: DataFrame


def texts(df: DataFrame, plugin: Plugin | None, limit: int, paths: tuple[str, ...], response: bool = False) -> DataFrame:
    """df with scan_status and scan_texts: the valid texts of bodies that are to be scanned.

    Without a plug-in, or on paths that are not its own, a body is one text.
    """
    body, size = F.col("body"), F.octet_length("body")
    status = F.when(body.isNull(), "empty").when(~policy.scan_path(F.col("path"), paths) | (policy.content_action(F.col("content_type")) != "analyze"), "skipped").when(size > limit, "oversize").otherwise("ok")
    own = F.lit(False) if plugin is None else F.coalesce(plugin.owns(F.col("path")), F.lit(False))
    found = F.array(body) if plugin is None else F.when(own, (plugin.response_texts if response else plugin.request_texts)(body)).otherwise(F.array(body))
    return df.withColumn("scan_status", status).withColumn("scan_own", own).withColumn("scan_texts", F.when(F.col("scan_status") == "ok", extract.valid_segments(found)).otherwise(F.expr(extract.NO_TEXTS)))


def scan(requests: DataFrame, scope: list[str], order: list[str], mode: str = "enforce", plugin: str | None = "parts", limit: int = fixed.LARGEST_TEXT, paths: tuple[str, ...] = fixed.SCAN_PATHS, pii_logging: bool = False, known: DataFrame | None = None) -> Scan:
    """requests (path, content_type, body; scope and order tell rows apart) scanned, and rewritten when enforcing.

    Bodies that are not scanned (other paths or types, beyond the limit) go on as they are, as in monitor mode.
    Detection runs once a text: what is audited and what is replaced are the same entities.
    """
    keys = list(dict.fromkeys([*scope, *order]))
    marked = texts(requests, PLUGINS[plugin] if plugin else None, limit, paths)
    each = marked.select(*keys, F.posexplode("scan_texts").alias("scan_seg", "text"))
    found, mapping = det.detect(each, limit=det.WHOLE), None
    found = found.withColumn("new", F.col("text"))
    if mode == "enforce":
        done, mapping = tokens.tokenize(found.drop("new"), scope, [*order, "scan_seg"], known=known)
        found = done.withColumnRenamed("tokenized", "new")
    by_row = found.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("scan_seg", "text", "new", "entities"))).alias("scan_all"))
    joined = match(marked, by_row, keys, "left")
    every = F.coalesce("scan_all", F.array().cast(f"array<struct<scan_seg:int,text:string,new:string,entities:array<{ENTITY}>>>"))
    field = lambda name: F.transform(F.col("scan_all"), lambda s: s[name])
    joined = joined.withColumn("scan_all", every).withColumn("scan_new", field("new")).withColumn("tokenized_count", audit.changed_segments(field("text"), field("new"))).withColumn("entities", F.flatten(field("entities")))
    joined = joined.withColumn("scan_change", F.when(F.col("scan_own") & (F.col("tokenized_count") > 0), F.col("scan_new")))
    rewritten = extract.rewrite_parts(joined, "body", "scan_change", "rewritten")
    whole = F.when(F.col("scan_own") | (F.size("scan_new") == 0), F.col("rewritten")).otherwise(F.get("scan_new", F.lit(0)))
    rows = rewritten.withColumn("rewritten", whole).withColumnRenamed("scan_status", "status")
    rows = rows.drop("scan_own", "scan_texts", "scan_all", "scan_new", "scan_change")
    records = audit.records(rows.withColumn("raw_entities", F.col("entities")), "body", pii_logging, direction="request").drop("body", "rewritten")
    return Scan(rows, mapping, records)


def restore(responses: DataFrame, mapping: DataFrame, scope: list[str], order: list[str], plugin: str | None = "parts", limit: int = fixed.LARGEST_TEXT, paths: tuple[str, ...] = fixed.SCAN_PATHS, pii_logging: bool = False) -> Scan:
    """responses with rewritten (all tokens of their scope put back, anywhere in the body) and rehydrated_count; audited as they came."""
    keys = list(dict.fromkeys([*scope, *order]))
    marked = texts(responses, PLUGINS[plugin] if plugin else None, limit, paths, response=True)
    each = marked.select(*keys, F.posexplode("scan_texts").alias("scan_seg", "text"))
    by_row = det.detect(each, limit=det.WHOLE).groupBy(*keys).agg(F.flatten(F.collect_list("entities")).alias("entities"))
    joined = match(marked, by_row, keys, "left").withColumn("entities", F.coalesce("entities", F.array().cast(f"array<{ENTITY}>")))
    back = tokens.rehydrate(joined, mapping, scope, order, "body", "restored")
    ok = F.col("scan_status") == "ok"
    rows = back.withColumn("rewritten", F.when(ok, F.col("restored")).otherwise(F.col("body")))
    rows = rows.withColumn("rehydrated_count", F.coalesce(audit.rehydration_counts(F.col("body"), F.col("rewritten"))[1], F.lit(0)).cast("long"))
    rows = rows.drop("scan_own", "scan_texts", "restored").withColumnRenamed("scan_status", "status")
    records = audit.records(rows.withColumn("raw_entities", F.col("entities")), "body", pii_logging, direction="response").drop("body", "rewritten")
    return Scan(rows, mapping, records)
