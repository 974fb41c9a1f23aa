"""Checksums and scores of candidate strings, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmask.functions import fixed
from quillmask.functions.spans import let


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_ok(number: Column) -> Column:
    """Luhn's check of a string of two digits or more."""
    each = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(i % 2 == 1, (c.cast("int") * 2 / 10).cast("int") + c.cast("int") * 2 % 10).otherwise(c.cast("int")))
    return (F.length(number) >= 2) & (F.aggregate(each, F.lit(0), lambda a, v: a + v) % 10 == 0)


def mod97_ok(iban: Column) -> Column:
    """ISO 7064 MOD 97-10 after moving four characters to the end; letters of either case count 10 to 35."""
    text = F.upper(iban)
    turned = F.concat(text.substr(F.lit(5), F.length(text)), F.left(text, F.lit(4)))

    def step(r, c):
        v = F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return F.when(v < 10, (r * 10 + v) % 97).otherwise((r * 100 + v) % 97)

    rest = F.aggregate(F.split(turned, ""), F.lit(0), step)
    return (F.length(iban) >= 5) & text.rlike("^[A-Z0-9]+$") & (rest == 1)


def issuer_ok(number: Column) -> Column:
    out = F.lit(False)
    for prefix, low, high in fixed.ISSUERS:
        out = out | (F.length(number).between(low, high) & number.rlike(f"^(?:{prefix})"))
    return F.length(number).between(13, 19) & out


def phone_score(text: Column) -> Column:
    number = digits(text)
    runs = "|".join(f"{a}{a + 1}{a + 2}|{a + 2}{a + 1}{a}" for a in range(8))
    return F.when(~F.length(number).between(7, 15), 0.50).when(number.rlike("^(.)\\1*$"), 0.55).when(number.rlike(runs), 0.60).otherwise(0.85)


def entropy(text: Column, alphabet: str | None = None) -> Column:
    """Shannon entropy in bits of an ASCII string; shares are taken in whole 256ths, rounded down.

    alphabet: a character class whose members alone count; one symbol then counts as 255/256 of the string.
    """
    def whole(kept):
        n = F.length(kept)

        def term(count):
            share = F.floor(count * 256 / n)
            share = F.least(share, F.lit(255)) if alphabet is not None else share
            return F.when(share <= 0, 0.0).otherwise(-(count / n) * F.log2(share / 256))

        counts = F.transform(F.array_distinct(F.split(kept, "")), lambda c: n - F.length(F.replace(kept, c, F.lit(""))))
        total = F.aggregate(F.transform(counts, term), F.lit(0.0), lambda a, v: a + v)
        return F.when(n == 0, 0.0).when((F.size(counts) == 1) & F.lit(alphabet is None), 0.0).otherwise(total)

    return let(text if alphabet is None else F.regexp_replace(text, f"[^{alphabet}]", ""), whole)


def jwt_score(header: Column) -> Column:
    """0.90 for a JSON object with alg, 0.80 for one without or null, 0.55 for anything else."""
    padded = F.concat(F.translate(header, "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.length(header), F.lit(4))))
    text = F.when(F.length(header) % 4 != 1, F.try_to_binary(padded, F.lit("base64")).cast("string"))
    keys = F.json_object_keys(text)
    return F.when(F.trim(text) == "null", 0.80).when(F.array_contains(keys, "alg"), 0.90).when(keys.isNotNull(), 0.80).otherwise(0.55)
