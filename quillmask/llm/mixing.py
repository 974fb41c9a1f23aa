"""Mixing sources to target weights by iterative proportional fitting, in DataFrame and SQL functions only.

Documents fall into cells of source, language and topic.  Token weights of the cells are raked in turn to the target
marginals of each dimension; a document is then kept with the probability that gives its cell its raked share of
`keep` times all tokens.  Targets are observed shares to a power (below 1 lifts rare values) or given weights by value.
No cell can give more tokens than it has: such cells stay at all they have, and the rest goes to the others in proportion.
Where a value has too few tokens for its target, or after `rounds` rounds, a residual is left; `marginals` reports it.

Rows are reduced to cells before anything is shuffled.  Cells are as many as combinations of values occur; if they are
at most `small` (checked), they are raked in one task and broadcast, else both stay distributed.  Documents are
sampled by a hash of their id, so a run gives the same sample again.

A token is a run of characters other than ASCII white space; a null or empty text counts as one token, so every row has
a weight.  Null languages and sources are values of their own.  Repeated rows share their decision.  A value without a
given target keeps nothing.  Columns of the input pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmask.llm.common import fresh, tidy, written
from quillmask.llm.common import mark as made

#: topics by the first pattern that a text matches, in this order; else by length
TOPICS = (("license", "Licensed under|Copyright|All rights reserved"), ("markup", "</[a-z]+>|\\{\\{|\\|\\|"), ("table", " \\| .* \\| "), ("noise", "[#$%&*]{3}"), ("contact", "[A-Za-z0-9._-]+@[A-Za-z0-9-]+\\.[a-z]{2,}"))
LONG = 4000
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.7}
ROUNDS, SPREAD, KEEP, SEED = 10, 3, 0.5, "mix"


def topic(text: Column) -> Column:
    out = F.when(F.coalesce(F.octet_length(text), F.lit(0)) == 0, "empty")
    for name, pattern in TOPICS:
        out = out.when(text.rlike(pattern), name)
    return out.when(F.octet_length(text) >= LONG, "long").otherwise("short")


def tokens(text: Column) -> Column:
    return F.greatest(F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)), F.lit(1)).cast("long")


def _goal(name: str, want, mass: Column) -> Column:
    """What a value of a dimension should weigh, up to a factor: a power of its mass, or its given weight (0 where none is given)."""
    if not isinstance(want, dict):
        return F.pow(mass.cast("double"), F.lit(float(want)))
    given = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(v)).alias("v")) for k, v in want.items()))
    return F.coalesce(F.get(F.transform(F.filter(given, lambda e: e["k"].eqNullSafe(F.col(name))), lambda e: e["v"]), F.lit(0)), F.lit(0.0))


def rake(cells: DataFrame, targets: dict, weight: str = "mass", rounds: int = ROUNDS, most: float | None = None) -> DataFrame:
    """Adds raked, the fitted weight of each cell; all together weigh what the cells do, as far as `most` allows.

    targets: by dimension, a power of the observed share, or a map of weights by value (values that do not occur are left out).
    most: how many times its own weight a cell may get; what it cannot take is raked on over the others.
    """
    whole = cells.agg(F.sum(weight)).first()[0] or 0
    for name, want in targets.items():
        total = cells.groupBy(name).agg(_goal(name, want, F.sum(weight)).alias("g")).agg(F.sum("g")).first()[0]
        goal = _goal(name, want, F.sum(weight).over(Window.partitionBy(name)))
        cells = cells.withColumn(f"goal_{name}", goal * F.lit(float(whole)) / F.lit(float(total or 1)))
    cells = cells.withColumn("raked", F.col(weight).cast("double"))
    for _ in range(rounds):
        for name in targets:
            have = F.sum("raked").over(Window.partitionBy(name))
            scaled = F.when(have > 0, F.col("raked") * F.col(f"goal_{name}") / have).otherwise(F.lit(0.0))
            cells = cells.withColumn("raked", scaled if most is None else F.least(scaled, F.col(weight) * F.lit(float(most))))
    return cells.drop(*(f"goal_{n}" for n in targets))


def spread(cells: DataFrame, most: float, weight: str = "mass", rounds: int = SPREAD) -> DataFrame:
    """What cells at their limit could not take, over the others in proportion, so that all together weigh what they did."""
    top, raked = F.col(weight) * F.lit(float(most)), F.col("raked")
    for _ in range(rounds):
        s = cells.agg(F.sum(weight).alias("whole"), F.sum(F.when(raked < top, raked)).alias("free"), F.sum(F.when(raked >= top, raked)).alias("full")).first()
        if s.free:
            cells = cells.withColumn("raked", F.when(raked < top, F.least(raked * F.lit((s.whole - (s.full or 0.0)) / s.free), top)).otherwise(raked))
    return cells


def calibrate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic_col: str | None = None, targets: dict | None = None, keep: float = KEEP, seed: str = SEED, rounds: int = ROUNDS, small: int = 100_000, only: list[str] | None = None) -> DataFrame:
    """docs, or the columns `only` of it, with a last struct column: source, lang, topic, n_tokens, weight, probability, sampled.

    Texts are read once: what is kept and the cell of each row are written, and read again for the cells and for the sample.
    """
    targets, since = targets or POWERS, made()
    mark, text = fresh(docs, "_mix"), F.col(f"`{text_col}`")
    names = fresh(docs, "_cell"), fresh(docs, "_cal")
    kind = topic(text) if topic_col is None else F.col(f"`{topic_col}`")
    cell_of = F.struct(F.col(f"`{source_col}`").alias("source"), F.col(f"`{lang_col}`").alias("lang"), kind.alias("topic"), tokens(text).alias("n_tokens"))
    columns = docs.columns if only is None else only
    marked = written(docs.select(*(F.col(f"`{c}`") for c in columns), cell_of.alias(mark)), "marked")
    cells = written(marked.select(f"{mark}.*").groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("mass")), "cells")
    size = cells.count()
    if size <= small:
        cells = cells.coalesce(1)
    raked = written(rake(cells, targets, rounds=rounds, most=1 / keep), "fitted")
    raked = written(spread(raked, 1 / keep), "raked")
    tidy(docs.sparkSession, since, "marked", "raked")
    weight = F.col("raked") / F.col("mass")
    cell = raked.select(F.struct("source", "lang", "topic").alias(names[0]), F.struct(F.round(weight, 6).alias("weight"), F.round(F.least(F.lit(1.0), weight * F.lit(keep)), 6).alias("probability")).alias(names[1]))
    if size <= small:
        cell = F.broadcast(cell)
    key = F.struct(*(F.col(mark)[c].alias(c) for c in ("source", "lang", "topic")))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    joined = marked.join(cell, key.eqNullSafe(F.col(names[0])), "left")
    full = F.struct(*(F.col(mark)[c].alias(c) for c in ("source", "lang", "topic", "n_tokens")), F.col(names[1])["weight"].alias("weight"), F.col(names[1])["probability"].alias("probability"), (draw < F.col(names[1])["probability"]).alias("sampled"))
    return joined.select(*(F.col(f"`{c}`") for c in columns), full.alias(mark))


def marginals(reported: DataFrame, targets: dict | None = None) -> DataFrame:
    """How well a report meets its targets: dimension, value, target (share), expected (share of the kept tokens)."""
    targets = targets or POWERS
    parts = []
    for name, want in targets.items():
        by = reported.groupBy(name).agg(F.sum("n_tokens").alias("mass"), F.sum(F.col("n_tokens") * F.col("probability")).alias("kept"))
        by = by.select(F.lit(name).alias("dimension"), F.col(name).cast("string").alias("value"), _goal(name, want, F.col("mass")).alias("goal"), "kept")
        whole = by.agg(F.sum("goal").alias("goals"), F.sum("kept").alias("all")).first()
        parts.append(by.select("dimension", "value", (F.col("goal") / F.lit(float(whole.goals or 1))).alias("target"), (F.col("kept") / F.lit(float(whole["all"] or 1))).alias("expected")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def mix(docs: DataFrame, **options) -> DataFrame:
    """The sampled documents, columns as they were."""
    out = calibrate(docs, **options)
    mark = out.columns[-1]
    return out.where(F.col(mark)["sampled"]).drop(mark)


def report(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row per document: id, source, lang, topic, n_tokens, weight, probability, sampled."""
    out = calibrate(docs, id_col=id_col, only=[id_col], **options)
    return out.select(F.col(f"`{id_col}`"), F.col(out.columns[-1])["source"].alias("source"), F.col(out.columns[-1])["lang"].alias("lang"), *(F.col(out.columns[-1])[c].alias(c) for c in ("topic", "n_tokens", "weight", "probability", "sampled")))


def sql() -> str:
    """The default mix in DuckDB's SQL."""
    rules = " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in TOPICS)
    parts = [
        f"""d AS (SELECT doc_id, source, lang, CASE WHEN coalesce(strlen(text), 0) = 0 THEN 'empty' {rules} WHEN strlen(text) >= {LONG} THEN 'long' ELSE 'short' END AS topic,
    greatest(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0), 1)::BIGINT AS n_tokens FROM documents)""",
        "c AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS mass FROM d GROUP BY ALL)",
        "k0 AS (SELECT *, mass AS raked, " + ", ".join(f"pow(sum(mass) OVER (PARTITION BY {n}), {p}) * (SELECT sum(mass) FROM c) / (SELECT sum(pow(s, {p})) FROM (SELECT sum(mass) AS s FROM c GROUP BY {n})) AS goal_{n}" for n, p in POWERS.items()) + " FROM c)",
    ]
    at = 0
    for _ in range(ROUNDS):
        for n in POWERS:
            parts.append(f"k{at + 1} AS MATERIALIZED (SELECT * REPLACE (least(raked * goal_{n} / sum(raked) OVER (PARTITION BY {n}), mass * {1 / KEEP}) AS raked) FROM k{at})")
            at += 1
    for _ in range(SPREAD):
        top = f"mass * {1 / KEEP}"
        factor = f"(SELECT (sum(mass) - coalesce(sum(CASE WHEN raked >= {top} THEN raked END), 0)) / sum(CASE WHEN raked < {top} THEN raked END) FROM k{at})"
        parts.append(f"k{at + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN raked < {top} THEN least(raked * {factor}, {top}) ELSE raked END AS raked) FROM k{at})")
        at += 1
    parts.append(f"f AS (SELECT source, lang, topic, raked / mass AS w FROM k{at})")
    draw = f"('0x' || substr(md5('{SEED}:' || doc_id), 1, 8))::UBIGINT::DOUBLE / 4294967296.0"
    return f"WITH {', '.join(parts)} SELECT doc_id, d.source, d.lang, d.topic, n_tokens, round(w, 6) AS weight, round(least(1.0, w * {KEEP}), 6) AS probability, {draw} < round(least(1.0, w * {KEEP}), 6) AS sampled FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source AND d.lang IS NOT DISTINCT FROM f.lang AND d.topic = f.topic"
