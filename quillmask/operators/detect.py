"""Detection of personal data and credentials: recognizers, and the engine that runs them over a text column.

All recognizers are column expressions over positioned matches, so a scan is one narrow pass without UDFs.  Texts
beyond the size limit are not scanned (status "oversize"), nor those that a gate holds back ("skipped"); null texts have no entities.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmask.functions import checks, fixed
from quillmask.functions.spans import ENTITY, empty, entity, free_name, held, let, locating, resolve_overlaps, search, unique_spans


WHOLE = (1 << 31) - 1  # a limit that no text exceeds


@dataclass(frozen=True)
class Recognizer:
    """patterns: what to locate (several under one name are located one after the other); build(found, text, order): array<ENTITY> from the located matches; gates: cheap tests first.

    need: a test that is made once a text, without which none of the patterns is looked for.
    follows: another recognizer, whose entities (overlaps and all) build gets in place of matches; such ones run last.
    """

    name: str
    patterns: dict[str, str | tuple[str, ...]]
    build: Callable[[Column, Column, int], Column]
    gates: Callable[[Column], dict[str, Column]] = field(default=lambda text: {})
    follows: str | None = None
    need: Callable[[Column], Column] | None = None


def _email(found: Column, text: Column, order: int) -> Column:
    def ok(m):
        v = m["value"]
        local, domain = F.substring_index(v, "@", 1), F.lower(F.substring_index(v, "@", -1))
        return (
            ~m["next"].rlike("[A-Za-z0-9.@-]") & (F.octet_length(v) <= 254) & F.length(local).between(1, 64) & ~domain.rlike("^-|-$|--") & ~v.contains("..")
            & (domain != "localhost") & ~F.lower(F.substring_index(local, "+", 1)).isin(fixed.NO_ADDRESS)
        )

    score = lambda m: F.when(F.lower(F.substring_index(m["value"], ".", -1)).isin(fixed.TLDS), 0.95).otherwise(0.90)
    return F.transform(F.filter(found["email"], ok), lambda m: entity("EMAIL", "regex", score(m), m, order))


def _phone(found: Column, text: Column, order: int) -> Column:
    every = F.concat(*(found[f"phone{k}"] for k in range(len(fixed.PHONES))))
    kept = unique_spans(every)  # the first pattern that gives a span keeps it
    return F.filter(F.transform(kept, lambda m: entity("PHONE", "regex", checks.phone_score(m["value"]), m, order)), lambda e: e["confidence"] >= 0.55)


def _iban(found: Column, text: Column, order: int) -> Column:
    return F.transform(F.filter(found["iban"], lambda m: checks.mod97_ok(m["value"])), lambda m: entity("IBAN", "mod97", F.lit(0.95), m, order))


def _card(found: Column, text: Column, order: int) -> Column:
    known = F.filter(found["card"], lambda m: checks.issuer_ok(checks.digits(m["value"])))
    return F.transform(known, lambda m: entity("CREDIT_CARD", "luhn", F.when(checks.luhn_ok(checks.digits(m["value"])), 0.95).otherwise(0.85), m, order))


def _jwt(found: Column, text: Column, order: int) -> Column:
    ok = lambda m: (F.octet_length(m["value"]) <= fixed.JWT_LONGEST) & ~m["next"].rlike("[A-Za-z0-9_.-]")
    scored = F.transform(F.filter(found["jwt"], ok), lambda m: entity("JWT", "structural", checks.jwt_score(F.substring_index(m["value"], ".", 1)), m, order))
    return F.filter(scored, lambda e: e["confidence"] >= 0.60)


_SECRET = "|".join(p.replace(".", "\\.").replace("+", "\\+") + form for p, form in sorted(fixed.SECRETS.items(), key=lambda x: -len(x[0])))


def _before(raw: Column, at: Column) -> Column:
    """The 2000 bytes before a place.  raw: the text's bytes, held by let, as a text is copied whole for each cast in a lambda."""
    return F.substring(raw, F.greatest(at - 2000, F.lit(0)) + 1, F.least(at, F.lit(2000))).cast("string")


def _secret_prefix(found: Column, text: Column, order: int) -> Column:
    def own(raw):  # not in a URL that began within the bytes before
        return F.filter(found["prefix"], lambda m: let(_before(raw, m["start"]), lambda b: ~(b.contains("http://") | b.contains("https://"))))

    score = lambda m: F.when(m["value"].rlike("^sk-[A-Za-z0-9]+$"), 0.70).otherwise(0.85)
    kept = F.when(F.size(found["prefix"]) > 0, let(text.cast("binary"), own)).otherwise(found["prefix"])
    return F.transform(kept, lambda m: entity("SECRET", "prefix", score(m), m, order))


_NEVER = "^(?:" + "|".join(fixed.NEVER) + ")$"


def _secret_entropy(found: Column, text: Column, order: int) -> Column:
    def every(raw):
        def scored(name: str, value, score) -> Column:
            def build(m):
                v = value(m["value"])
                at = m["end"] - F.octet_length(v)
                own = F.struct(at.alias("start"), m["end"].alias("end"), v.alias("value"))
                return let(own, lambda o: entity("SECRET", "entropy", F.when(o["value"].rlike(_NEVER) | in_query(o["start"]), 0.0).otherwise(score(o["value"])), o, order))

            return F.transform(found[name], build)

        def in_query(at):  # of a URL that began within the bytes before, without a gap
            return let(_before(raw, at), lambda b: b.contains("?") & F.substring_index(F.translate(b, "\t\n\f\r", "    "), " ", -1).rlike(fixed.IN_URL))

        same = lambda v: v
        entropy = lambda f: lambda v: let(checks.entropy(v), f)
        all_ = F.concat(
            scored("base64", same, entropy(lambda h: F.when(h >= 4.5, 0.80).when(h >= 3.5, 0.70).otherwise(0.0))),
            scored("hex", same, entropy(lambda h: F.when(h >= 3.0, 0.65).otherwise(0.0))),
            scored("bearer", lambda v: F.regexp_extract(v, fixed.BEARER, 1), lambda v: F.lit(0.50)),
            scored("pair", lambda v: F.regexp_extract(v, fixed.PAIR, 1), entropy(lambda h: F.when(h >= 3.5, 0.60).otherwise(0.0))),
        )
        return unique_spans(F.filter(all_, lambda e: e["confidence"] > 0))

    some = F.size(found["base64"]) + F.size(found["hex"]) + F.size(found["bearer"]) + F.size(found["pair"]) > 0
    return F.when(some, let(text.cast("binary"), every)).otherwise(empty(ENTITY))


_ARMOUR = "|".join(sorted(fixed.ARMOUR, key=len, reverse=True))
_BEGIN, _END = f"-----BEGIN ({_ARMOUR})-----", f"-----END ({_ARMOUR})-----"


def _private_key(found: Column, text: Column, order: int) -> Column:
    """Each header with the first footer of its label after it, by binary search.  Blocks of one label share footers as they stand."""
    label = lambda m: F.regexp_extract(m["value"], _BEGIN, 1)

    def build(raw, p):
        m, end = p["m"], p["end"]
        body = F.regexp_replace(F.substring(raw, m["end"] + 1, end["start"] - m["end"]).cast("string"), "[ \\t\\r\\n]", "")
        sure = F.when(p["label"].isin([k for k, v in fixed.ARMOUR.items() if v == 0.95]), 0.95).otherwise(0.90)
        score = F.when((F.length(body) < 40) | ~body.rlike("^[A-Za-z0-9+/]+={0,2}$"), 0.70).otherwise(sure)
        whole = F.struct(m["start"].alias("start"), end["end"].alias("end"), F.substring(raw, m["start"] + 1, end["end"] - m["start"]).cast("string").alias("value"))
        return entity("PRIVATE_KEY", "pem_armor", score, whole, order)

    def paired(ends):
        def pair(m):
            end = F.get(ends, search(ends, lambda e: (e["label"] > label(m)) | ((e["label"] == label(m)) & (e["start"] >= m["end"]))))
            return F.struct(m.alias("m"), label(m).alias("label"), F.when(end["label"] == label(m), end).alias("end"))

        return F.filter(F.transform(found["pem_begin"], pair), lambda p: p["end"].isNotNull())

    ends = F.transform(found["pem_end"], lambda e: F.struct(F.regexp_extract(e["value"], _END, 1).alias("label"), e["start"].alias("start"), e["end"].alias("end")))
    every = lambda raw: F.transform(let(F.array_sort(ends), paired), lambda p: build(raw, p))
    return F.when(F.size(found["pem_begin"]) > 0, let(text.cast("binary"), every)).otherwise(empty(ENTITY))


def infer_name(email: Column) -> Column:
    """struct(name, confidence) from an address, or null."""
    local = F.substring_index(F.substring_index(email, "@", 1), "+", 1)
    parts = F.when(local.contains("."), F.split(local, "\\.")).when(local.contains("_"), F.split(local, "_"))
    bad = lambda p: (p == "") | ((F.length(p) > 1) & (~p.rlike("^[A-Za-z]") | F.lower(p).isin(fixed.ROLES))) | ((F.length(p) == 1) & ~p.rlike("[A-Za-z]"))
    name = F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.lower(p.substr(F.lit(2), F.length(p))))), " ")
    score = F.when(F.exists(parts, lambda p: F.length(p) == 1), 0.55).otherwise(0.70)
    return F.when(parts.isNotNull() & ~F.lower(local).isin(fixed.ROLES) & ~F.exists(parts, bad), F.struct(name.alias("name"), score.alias("confidence")))


def names(emails: Column, text: Column, order: int) -> Column:
    """NAME entities of EMAIL entities; their spans are the addresses'."""
    known = F.filter(emails, lambda e: infer_name(e["value"]).isNotNull())
    return F.transform(known, lambda e: entity("NAME", "email_inference", infer_name(e["value"])["confidence"], e, order, infer_name(e["value"])["name"]))


def _named(text: Column) -> Column:
    """Whether a text holds a keyword; all of them hold one of a few words, which most texts do not hold."""
    roots = [w for w in fixed.KEYWORDS if not any(o != w and o in w for o in fixed.KEYWORDS)]  # whatever holds a longer one holds these
    cores = [c for c in ("key", "credential", "passw", "secret", "token") if any(c in w for w in roots)]
    assert all(any(c in w for c in cores) for w in roots)
    return text.rlike("(?i:" + "|".join(cores) + ")") & text.rlike("(?i:" + "|".join(roots) + ")")


RECOGNIZERS: dict[str, Recognizer] = {
    r.name: r
    for r in (
        Recognizer("email", {"email": fixed.EMAIL}, _email, lambda t: {"email": t.contains("@")}),
        Recognizer("phone", {f"phone{k}": p for k, p in enumerate(fixed.PHONES)}, _phone, lambda t: {f"phone{k}": t.rlike("[0-9]{2}") & t.rlike(p) for k, p in enumerate(fixed.PHONES)}),
        Recognizer("iban", {"iban": fixed.IBANS}, _iban, lambda t: {"iban": t.rlike("[A-Z]{2}[0-9]{2}")}),
        Recognizer("card", {"card": fixed.CARD}, _card, lambda t: {"card": t.rlike("[0-9][0-9 .-]{11}") & t.rlike(fixed.CARD)}),
        Recognizer("jwt", {"jwt": fixed.JWT}, _jwt, lambda t: {"jwt": t.rlike("[A-Za-z0-9_-]\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]")}),
        Recognizer("secret_prefix", {"prefix": _SECRET}, _secret_prefix, lambda t: {"prefix": t.rlike("[A-Za-z0-9_-]{20}|://|T[0-9]{8}") & t.rlike(_SECRET)}),
        Recognizer("secret_entropy", {"base64": fixed.BASE64, "hex": fixed.HEX, "bearer": fixed.BEARER, "pair": fixed.PAIR}, _secret_entropy, lambda t: {"base64": t.rlike(fixed.BASE64), "hex": t.rlike(fixed.HEX), "bearer": t.rlike(fixed.BEARER), "pair": t.rlike(fixed.PAIR)}, need=_named),
        Recognizer("private_key", {"pem_begin": _BEGIN, "pem_end": _END}, _private_key, lambda t: {k: t.contains("-----END ") for k in ("pem_begin", "pem_end")}),
        Recognizer("name", {}, names, follows="email"),
    )
}


def register(recognizer: Recognizer) -> None:
    """Adds a recognizer to those that run by default; it comes last in order."""
    RECOGNIZERS[recognizer.name] = recognizer


_BUILT: dict = {}


def _kept(key, make: Callable[[], list], named: list) -> list:
    """Columns are built from thousands of calls to the JVM, so those of a scan are kept for the next one that has the same."""
    if key not in _BUILT:
        if len(_BUILT) >= 64:
            _BUILT.clear()
        _BUILT[key] = make(), named  # kept alive, so that nothing else has their identity
    return _BUILT[key][0]


def detect(df: DataFrame, text_col: str = "text", only: tuple[str, ...] | None = None, limit: int = fixed.LARGEST_TEXT, min_confidence: float = 0.0, with_names: bool = True, gate: Column | None = None) -> DataFrame:
    """df with raw_entities (all, names included), entities (overlaps resolved), status and received_bytes.

    only: recognizers to run; with_names: also those that follow one of them.
    """
    limit = limit if limit > 0 else fixed.LARGEST_TEXT
    chosen = [RECOGNIZERS[n] for n in (only or tuple(RECOGNIZERS))]
    later = [r for r in RECOGNIZERS.values() if with_names and r.follows in {c.name for c in chosen}]
    chosen = [r for r in chosen if r.follows is None]
    text, size = F.col(f"`{text_col}`"), F.octet_length(F.col(f"`{text_col}`"))
    names_ = [free_name(df, f"_scan{k}") for k in range(4)]
    names_ += [free_name(df, f"_{names_[1]}{k}") for k in range(3)]

    def steps() -> list[tuple[str, Column]]:
        skip = (size > limit) if gate is None else (size > limit) | ~F.coalesce(gate, F.lit(False))
        needs = {r.name: F.coalesce(~skip & r.need(text), F.lit(False)) for r in chosen if r.need}
        first = held(text=F.when(~skip, text).otherwise(F.lit("")), **needs)
        scanned = F.coalesce(F.col(names_[0])["text"], F.lit(""))
        patterns = {k: p for r in chosen for k, p in r.patterns.items()}
        gates = {k: F.col(names_[0])[r.name] & g if r.need else g for r in chosen for k, g in r.gates(scanned).items()}
        found = locating(scanned, patterns, names_[1], names_[4:], gates)
        built = held(**{r.name: r.build(F.col(names_[1]), scanned, k) for k, r in enumerate(chosen)})
        every = F.concat(*(F.col(names_[2])[r.name] for r in chosen)) if chosen else empty(ENTITY)
        derived = [r.build(F.col(names_[2])[r.follows], scanned, len(chosen) + k) for k, r in enumerate(later)]
        raw = held(raw=F.filter(F.concat(every, *derived), lambda e: e["confidence"] >= min_confidence))
        own = F.col(names_[3])["raw"]
        resolved = F.when(F.size(own) > 0, resolve_overlaps(own, fixed.TYPES)).otherwise(empty(ENTITY))
        return [(names_[0], first), *found, (names_[2], built), (names_[3], raw), ("entities", resolved)]

    key = (id(df.sparkSession._jvm), text_col, tuple(names_), tuple(id(r) for r in chosen + later), limit, min_confidence)
    *every, (_, resolved) = steps() if gate is not None else _kept(key, steps, [*chosen, *later, df.sparkSession._jvm])
    for name, column in every:
        df = df.withColumn(name, column)
    raw = F.col(names_[3])["raw"]
    status = F.when(text.isNull(), "empty").when(size > limit, "oversize")
    if gate is not None:
        status = status.when(~F.coalesce(gate, F.lit(False)), "skipped")
    status = status.otherwise("ok")
    return df.withColumn("raw_entities", raw).withColumn("entities", resolved).withColumn("status", status).withColumn("received_bytes", size).drop(*names_)


def rows(df: DataFrame, keys: list[str], column: str = "entities") -> DataFrame:
    """One row per entity: keys, type, source, confidence, start, end, value, ord; of two columns of one name the key stays."""
    taken = {k.lower() for k in keys}
    fields = [n for n in ("type", "source", "confidence", "start", "end", "value", "ord") if n not in taken]
    held = free_name(df, "_e")
    return df.select(*keys, F.explode(column).alias(held)).select(*keys, *(F.col(held)[n].alias(n) for n in fields))


def safe_string(e: Column) -> Column:
    """An entity without its value."""
    return F.format_string("%s(src=%s, conf=%.2f, pos=%d-%d)", e["type"], e["source"], e["confidence"], e["start"], e["end"])
