"""Secret scans with multipart credential linking, in DataFrame functions only.

Strong findings (the base): assignments to secret-like names, access key ids and long hex runs.  Weak candidates are
identifiers, random-looking strings and endpoints.  They are reported only where complementary parts stand in one
scope, that is in the same text with at most `scope` code points between them:

* a weak secret, if an identifier or an access key stands in its scope;
* an identifier, if a secret (assignment, hex run or weak secret) stands in its scope;
* an endpoint, if both an identifier and a secret do.

Parts that overlap are one part and no partners of each other: the value of `client_id=...` is not its own secret, nor is
a token inside a URL that URL's.  What is left out: texts without an identifier or access key have no linked parts at all;
partners stand at most `scope` code points apart; a weak secret has 20 characters or more, with capital and small letters
and digits among them.

The parts of a text are lists of disjoint intervals in order, so their interval join is two binary searches for each
candidate: n log n in the number of parts, without a shuffle and without pairs.

Positions are code points, ends exclusive.  Null and empty texts have no findings; repeated rows are scanned row by
row; null ids stay; other columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmask.llm.common import fresh

#: kinds in the order of ties
KINDS = ("assign", "access", "hex", "linked_id", "linked_secret", "linked_endpoint")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"  # the runs of [0-9a-f]+ that are long enough
IDENTIFIER = r"""(?i:client_?id|access_?key_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
WEAK = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
ENDPOINT = r"""(?:https?|jdbc:[a-z]+|amqps?|mongodb|redis|postgres(?:ql)?|mysql|sftp)://[^\x00-\x20"'<>]+"""
SCOPE = 200
_STEP = 128


def _cut(text: Column, pattern: str, gate: Column | None = None) -> Column:
    """What stands before each match, and the matches; a text without a match is read once."""
    none = F.array().cast("array<string>")
    cut = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    return F.when(text.rlike(pattern) if gate is None else gate, cut).otherwise(F.struct(none.alias("gaps"), none.alias("hits")))


#: a part in code points, and in bytes
_PART = "struct<start:int,end:int,value:string,first:int,last:int>"


def _places(cut: Column) -> Column:
    """Lengths of each match and of the gap before it, in code points and in bytes."""
    parts = F.arrays_zip(F.slice(cut["gaps"], 1, F.size(cut["hits"])).alias("gap"), cut["hits"].alias("hit"))
    return F.transform(parts, lambda p: F.struct(F.length(p["gap"]).alias("gap"), F.length(p["hit"]).alias("size"), F.octet_length(p["gap"]).alias("skip"), F.octet_length(p["hit"]).alias("wide"), p["hit"].alias("value")))


def _steps(parts: Column) -> Column:
    return F.when(F.size(parts) > 0, F.sequence(F.lit(0), ((F.size(parts) - 1) / _STEP).cast("int"))).otherwise(F.array().cast("array<int>"))


def _offsets(parts: Column, sums: Column, wide: Column) -> Column:
    """array<_PART>.  Sums are carried in steps, so time stays near linear in the matches."""

    def block(k):
        base, first = (F.aggregate(F.slice(s, F.lit(1), k), F.lit(0).cast("int"), lambda a, v: a + v) for s in (sums, wide))
        start = F.struct(base.alias("at"), first.alias("byte"), F.array().cast(f"array<{_PART}>").alias("out"))

        def add(a, p):
            at, byte = a["at"] + p["gap"], a["byte"] + p["skip"]
            own = F.struct(at.alias("start"), (at + p["size"]).alias("end"), p["value"].alias("value"), byte.alias("first"), (byte + p["wide"]).alias("last"))
            return F.struct((at + p["size"]).alias("at"), (byte + p["wide"]).alias("byte"), F.concat(a["out"], F.array(own)).alias("out"))

        return F.aggregate(F.slice(parts, k * _STEP + 1, F.lit(_STEP)), start, add, lambda a: a["out"])

    return F.flatten(F.transform(_steps(parts), block))


def _sums(parts: Column, gap: str, size: str) -> Column:
    return F.transform(_steps(parts), lambda k: F.aggregate(F.slice(parts, k * _STEP + 1, F.lit(_STEP)), F.lit(0).cast("int"), lambda a, p: a + p[gap] + p[size]))


def _held(df: DataFrame, name: str, **columns: Column) -> DataFrame:
    """Adds a struct that is computed once a row: a generator keeps the optimiser from copying it into lambdas."""
    return df.withColumn(name, F.explode(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))))


def _first(others: Column, late) -> Column:
    """Place of the first of the others (disjoint, in order) for which late holds, by binary search."""
    n = F.size(others)
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(n + F.lit(1))).cast("int"))

    def halve(a, _):
        mid = ((a["lo"] + a["hi"]) / 2).cast("int")
        return F.when(a["lo"] >= a["hi"], a).when(late(F.get(others, mid)), F.struct(a["lo"].alias("lo"), mid.alias("hi"))).otherwise(F.struct((mid + 1).alias("lo"), a["hi"].alias("hi")))

    return F.aggregate(rounds, F.struct(F.lit(0).alias("lo"), n.alias("hi")), halve, lambda a: a["lo"])


def _in_scope(part: Column, others: Column, scope: int) -> Column:
    """Whether one of the others that does not overlap the part stands within scope of it: the last before it or the first after it."""
    before = F.get(others, _first(others, lambda o: o["end"] > part["start"]) - 1)
    after = F.get(others, _first(others, lambda o: o["start"] >= part["end"]))
    return F.coalesce(before["end"] >= part["start"] - scope, F.lit(False)) | F.coalesce(after["start"] <= part["end"] + scope, F.lit(False))


def find(docs: DataFrame, text_col: str = "text", out: str = "spans", scope: int = SCOPE) -> DataFrame:
    """docs and a column: array<struct<start, rank, end, kind, first, last>>, in order of start, then kind as in KINDS; first and last in bytes."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    work = [fresh(docs, f"_secrets{k}") for k in range(6)]
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "ids": IDENTIFIER, "weak": WEAK, "ends": ENDPOINT}
    key, named = text.contains("AKIA"), F.col(work[5])["named"]
    df = _held(docs, work[5], named=key | text.rlike(IDENTIFIER))
    gates = {"access": key, "ids": named, "weak": named, "ends": named & text.contains("://")}  # no identifier, nothing to link
    df = _held(df, work[0], **{k: _cut(text, p, gates.get(k)) for k, p in patterns.items()})
    df = _held(df, work[1], **{k: _places(F.col(work[0])[k]) for k in patterns})
    df = _held(df, work[2], **{k: F.struct(F.col(work[1])[k].alias("parts"), _sums(F.col(work[1])[k], "gap", "size").alias("sums"), _sums(F.col(work[1])[k], "skip", "wide").alias("wide")) for k in patterns})
    df = _held(df, work[3], **{k: _offsets(*(F.col(work[2])[k][f] for f in ("parts", "sums", "wide"))) for k in patterns})
    at = F.col(work[3])
    assign = F.filter(at["assign"], lambda p: F.length(F.regexp_extract(p["value"], ASSIGN, 2)) >= 8)
    access = F.filter(at["access"], lambda p: p["end"] - p["start"] >= 16)
    weak = F.filter(at["weak"], lambda p: p["value"].rlike("[0-9]") & p["value"].rlike("[A-Z]") & p["value"].rlike("[a-z]") & ~p["value"].startswith("AKIA"))
    df = _held(df, work[4], assign=assign, access=access, hex=at["hex"], ids=at["ids"], weak=weak, ends=at["ends"])
    got = F.col(work[4])
    near = lambda p, *kinds: _any(*(_in_scope(p, got[k], scope) for k in kinds))
    base = F.exists(got["assign"], lambda _: F.lit(True)) | (F.size(got["access"]) + F.size(got["hex"]) > 0)
    some_id, some_secret = F.size(got["ids"]) + F.size(got["access"]) > 0, base | (F.size(got["weak"]) > 0)
    none = F.array().cast(f"array<{_PART}>")
    linked_secret = F.when(some_id, F.filter(got["weak"], lambda p: near(p, "ids", "access"))).otherwise(none)
    linked_id = F.when(some_secret, F.filter(got["ids"], lambda p: near(p, "assign", "hex", "weak"))).otherwise(none)
    linked_end = F.when(some_id & some_secret, F.filter(got["ends"], lambda p: near(p, "ids", "access") & near(p, "assign", "hex", "weak"))).otherwise(none)
    lists = (got["assign"], got["access"], got["hex"], linked_id, linked_secret, linked_end)
    spans = [F.transform(a, _as_span(r)) for r, a in enumerate(lists)]
    return df.withColumn(out, F.sort_array(F.concat(*spans))).drop(*work)


def _as_span(rank: int):
    return lambda p: F.struct(p["start"].alias("start"), F.lit(rank).alias("rank"), p["end"].alias("end"), F.lit(KINDS[rank]).alias("kind"), p["first"].alias("first"), p["last"].alias("last"))


def _any(*tests: Column) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end, comma-joined)."""
    df = find(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), "text", "found")
    df = _held(df.select("id", "found"), "_f", found=F.col("found"))
    found = F.col("_f")["found"]
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    n = lambda r: F.size(F.filter(found, lambda s: s["rank"] == r)).cast("long")
    base = line(F.filter(found, lambda s: s["rank"] < 3))
    return df.select(F.col("id").alias(id_col), n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(base, 256).alias("base_sha256"), line(found).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs with every found span but endpoints replaced by the mask; overlapping spans become one.  Null texts stay null."""
    spans = fresh(docs, "_spans")
    df = find(docs, text_col, spans)
    hold = fresh(df, "_ranges")
    df = _held(df, hold, all=F.filter(F.col(spans), lambda s: s["rank"] < 5))
    ranges, kind = F.col(hold)["all"], "struct<first:int,last:int>"

    def step(a, s):
        last = a["last"]
        own = F.struct(s["first"].alias("first"), s["last"].alias("last"))
        grown = F.struct(last["first"].alias("first"), F.greatest(last["last"], s["last"]).alias("last"))
        joins = last.isNotNull() & (last["last"] >= s["first"])
        out = F.when(last.isNull() | joins, a["out"]).otherwise(F.concat(a["out"], F.array(last)))
        return F.struct(F.when(joins, grown).otherwise(own).alias("last"), out.alias("out"))

    none = F.array().cast(f"array<{kind}>")

    def block(a, k):  # a list of those merged is copied once a block
        start = F.struct(a["last"].alias("last"), none.alias("out"))
        return F.aggregate(F.slice(ranges, k * _STEP + 1, F.lit(_STEP)), start, step, lambda b: F.struct(b["last"].alias("last"), F.concat(a["out"], b["out"]).alias("out")))

    start = F.struct(F.lit(None).cast(kind).alias("last"), none.alias("out"))
    merged = F.aggregate(_steps(ranges), start, block, lambda a: F.when(a["last"].isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(a["last"]))))
    held = fresh(df, "_merged")
    df = _held(df, held, all=merged)
    merged, text = F.col(held)["all"], F.col(f"`{text_col}`")
    raw = text.cast("binary")
    piece = lambda lo, hi: F.substring(raw, lo + 1, hi - lo).cast("string")
    gaps = F.transform(merged, lambda s, i: F.concat(piece(F.when(i == 0, 0).otherwise(F.get(merged, i - 1)["last"]), s["first"]), F.lit(mask)))
    rest = piece(F.try_element_at(merged, F.lit(-1))["last"], F.octet_length(text))
    clean = F.when(F.size(merged) > 0, F.concat(F.array_join(gaps, ""), rest)).otherwise(text)
    return df.withColumn(text_col, clean).drop(spans, hold, held)
