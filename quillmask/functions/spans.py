"""Columns of positioned matches: finding, resolving overlaps, substituting.  Positions are bytes, ends exclusive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCH = "struct<start:int,end:int,value:string,next:string>"
ENTITY = "struct<type:string,source:string,confidence:double,start:int,end:int,value:string,ord:int>"
_STEP = 128


def free_name(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def match(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A join on keys in which nulls equal nulls; the keys of the left side stay."""
    names = []
    for k in keys:
        names.append(free_name(left, f"_right_{k}"))
        right = right.withColumnRenamed(k, names[-1])
    on = F.lit(True)
    for k, n in zip(keys, names):
        on = on & F.col(f"`{k}`").eqNullSafe(F.col(f"`{n}`"))
    return left.join(right, on, how).drop(*names)


def hold(df: DataFrame, name: str, **columns: Column) -> DataFrame:
    """Adds a struct that is computed once a row: behind a generator the optimiser cannot copy it into lambdas."""
    return df.withColumn(name, held(**columns))


def held(**columns: Column) -> Column:
    """The generator of hold."""
    return F.explode(F.array(F.struct(*(c.alias(k) for k, c in columns.items()))))


def let(value: Column, use) -> Column:
    """use(value), with the value computed once: it is a lambda's variable there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def search(others: Column, late) -> Column:
    """Place of the first of the others for which late holds, where those for which it does come last: binary search."""
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(F.size(others) + F.lit(1))).cast("int"))

    def halve(a, _):
        mid = ((a["lo"] + a["hi"]) / 2).cast("int")
        return F.when(a["lo"] >= a["hi"], a).when(late(F.get(others, mid)), F.struct(a["lo"].alias("lo"), mid.alias("hi"))).otherwise(F.struct((mid + 1).alias("lo"), a["hi"].alias("hi")))

    return F.aggregate(rounds, F.struct(F.lit(0).alias("lo"), F.size(others).alias("hi")), halve, lambda a: a["lo"])


def unique_spans(matches: Column) -> Column:
    """Of matches with one span the first, in order of start and end."""

    def unique(every):
        keyed = F.array_sort(F.transform(every, lambda m, i: F.struct(m["start"].alias("start"), m["end"].alias("end"), i.alias("at"))))
        new = lambda keys: F.filter(keys, lambda k, i: (i == 0) | (F.get(keys, i - 1)["start"] != k["start"]) | (F.get(keys, i - 1)["end"] != k["end"]))
        return F.when(F.size(every) > 1, F.transform(let(keyed, new), lambda k: F.get(every, k["at"]))).otherwise(every)

    return let(matches, unique)


def clear_spans(ordered: Column) -> Column:
    """Spans, in order of start, that begin where no earlier one goes on; earlier ends are looked up by blocks."""

    def clear(every, tops):
        def free(s, i):
            k = (i / _STEP).cast("int")
            return ~F.coalesce(F.array_max(F.slice(tops, F.lit(1), k)) > s["start"], F.lit(False)) & ~F.exists(F.slice(every, k * _STEP + 1, i - k * _STEP), lambda o: o["end"] > s["start"])

        return F.filter(every, free)

    tops = lambda every: F.transform(_steps(every), lambda k: F.array_max(F.transform(F.slice(every, k * _STEP + 1, F.lit(_STEP)), lambda o: o["end"])))
    return let(ordered, lambda every: let(tops(every), lambda t: clear(every, t)))


def empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _cut(text: Column, pattern, gate: Column) -> Column:
    """array of (gap before, match, first character after)."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    none = empty("string")
    cut = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("hits"))
    return F.when(gate, cut).otherwise(F.struct(none.alias("gaps"), none.alias("hits")))


def _parts(cut: Column) -> Column:
    def part(hit, i):
        follows = F.concat(F.coalesce(F.get(cut["gaps"], i + 1), F.lit("")), F.coalesce(F.get(cut["hits"], i + 1), F.lit("")))
        return F.struct(F.octet_length(F.get(cut["gaps"], i)).alias("gap"), F.octet_length(hit).alias("size"), hit.alias("value"), F.left(follows, F.lit(1)).alias("next"))

    return F.transform(cut["hits"], part)


def _steps(parts: Column) -> Column:
    return F.when(F.size(parts) > 0, F.sequence(F.lit(0), ((F.size(parts) - 1) / _STEP).cast("int"))).otherwise(empty("int"))


def _sums(parts: Column) -> Column:
    return F.transform(_steps(parts), lambda k: F.aggregate(F.slice(parts, k * _STEP + 1, F.lit(_STEP)), F.lit(0).cast("int"), lambda a, p: a + p["gap"] + p["size"]))


def _placed(parts: Column, sums: Column) -> Column:
    def block(k):
        base = F.aggregate(F.slice(sums, F.lit(1), k), F.lit(0).cast("int"), lambda a, s: a + s)

        def add(a, p):
            at = a["at"] + p["gap"]
            own = F.struct(at.alias("start"), (at + p["size"]).alias("end"), p["value"].alias("value"), p["next"].alias("next"))
            return F.struct((at + p["size"]).alias("at"), F.concat(a["out"], F.array(own)).alias("out"))

        return F.aggregate(F.slice(parts, k * _STEP + 1, F.lit(_STEP)), F.struct(base.alias("at"), empty(MATCH).alias("out")), add, lambda a: a["out"])

    return F.flatten(F.transform(_steps(parts), block))


def locate(df: DataFrame, text: Column, patterns: dict[str, str | tuple[str, ...]], out: str, gates: dict[str, Column] | None = None) -> DataFrame:
    """Adds a struct of array<MATCH>, one per pattern: its leftmost matches that do not overlap, in order."""
    names = [free_name(df, f"_{out}{n}") for n in range(3)]
    for name, column in locating(text, patterns, out, names, gates):
        df = df.withColumn(name, column)
    return df.drop(*names)


def locating(text: Column, patterns: dict[str, str | tuple[str, ...]], out: str, names: list[str], gates: dict[str, Column] | None = None) -> list[tuple[str, Column]]:
    """The columns that locate adds one after the other, with three free names for those on the way.

    Of several patterns under one name each is located by itself, one after the other; those that begin with two letters
    only in texts that hold these letters.  They are one expression, however many they are.
    """
    gates = gates or {}
    several = {k for k, p in patterns.items() if not isinstance(p, str)}
    each = lambda k, value, f: F.transform(value, f) if k in several else f(value)

    def cut(k, p):
        if k not in several:
            return _cut(text, p, gates.get(k, text.rlike(p)))
        some = F.filter(F.array(*map(F.lit, p)), lambda x: ~F.left(x, F.lit(2)).rlike("^[A-Z]{2}$") | F.contains(text, F.left(x, F.lit(2))))
        some = F.when(gates.get(k, F.lit(True)), some).otherwise(empty("string"))
        return F.transform(some, lambda x: F.struct(F.split(text, x, -1).alias("gaps"), F.regexp_extract_all(text, x, F.lit(0)).alias("hits")))

    def placed(k):
        parts, sums = F.col(names[1])[k], F.col(names[2])[k]
        if k not in several:
            return _placed(parts, sums)
        return F.flatten(F.transform(parts, lambda x, i: _placed(x, F.get(sums, i))))

    return [
        (names[0], held(**{k: cut(k, p) for k, p in patterns.items()})),
        (names[1], held(**{k: each(k, F.col(names[0])[k], _parts) for k in patterns})),
        (names[2], held(**{k: each(k, F.col(names[1])[k], _sums) for k in patterns})),
        (out, held(**{k: placed(k) for k in patterns})),
    ]


def entity(kind: str, source: str, confidence: Column, match: Column, order: int, value: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("type"), F.lit(source).alias("source"), confidence.cast("double").alias("confidence"), match["start"].alias("start"), match["end"].alias("end"), (match["value"] if value is None else value).alias("value"), F.lit(order).alias("ord"))


def _wins(a: Column, b: Column, rank) -> Column:
    """Whether a stays rather than b: score, then type, then length, then order."""
    length = lambda e: e["end"] - e["start"]
    return F.when(a["confidence"] != b["confidence"], a["confidence"] > b["confidence"]).when(rank(a) != rank(b), rank(a) < rank(b)).otherwise(length(a) >= length(b))


def resolve_overlaps(entities: Column, types: tuple[str, ...]) -> Column:
    """A greedy fold in order of start (longer first): an entity that overlaps the last kept one replaces it or goes."""
    rank = lambda e: F.array_position(F.array(*map(F.lit, types)), e["type"])
    def step(a, e):
        last = a["last"]
        clear = last.isNull() | (last["end"] <= e["start"])
        out = F.when(clear & last.isNotNull(), F.concat(a["out"], F.array(last))).otherwise(a["out"])
        return F.struct(F.when(clear, e).when(_wins(last, e, rank), last).otherwise(e).alias("last"), out.alias("out"))

    def fold(every):  # block by block, so that a long list of those kept is copied once a block
        def block(a, k):
            start = F.struct(a["last"].alias("last"), empty(ENTITY).alias("out"))
            return F.aggregate(F.slice(every, k * _STEP + 1, F.lit(_STEP)), start, step, lambda b: F.struct(b["last"].alias("last"), F.concat(a["out"], b["out"]).alias("out")))

        start = F.struct(F.lit(None).cast(ENTITY).alias("last"), empty(ENTITY).alias("out"))
        return F.aggregate(_steps(every), start, block, lambda a: F.when(a["last"].isNull(), a["out"]).otherwise(F.concat(a["out"], F.array(a["last"]))))

    def in_order(every):  # by keys of numbers, as a comparison in a lambda costs more than all else
        keys = F.array_sort(F.transform(every, lambda e, i: F.struct(e["start"].alias("start"), (-e["end"]).alias("end"), e["ord"].alias("ord"), i.alias("at"))))
        return F.transform(keys, lambda k: F.get(every, k["at"]))

    return let(let(entities, in_order), fold)


def substitute(text: Column, spans: Column, new) -> Column:
    """Text with each span (disjoint, in order, in bytes) replaced by new(span)."""
    def put(raw):  # held, as a text is copied whole for each cast in a lambda
        piece = lambda lo, hi: F.substring(raw, lo + 1, hi - lo).cast("string")
        parts = F.transform(spans, lambda s, i: F.concat(piece(F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["end"]), s["start"]), new(s)))
        tail = piece(F.coalesce(F.try_element_at(spans, F.lit(-1))["end"], F.lit(0)), F.octet_length(text))
        return F.concat(F.array_join(parts, ""), tail)

    return F.when(F.size(spans) > 0, let(text.cast("binary"), put)).otherwise(text)
