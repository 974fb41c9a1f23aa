"""Text segments of JSON bodies, and putting new text back."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmask.functions.spans import let

NO_TEXTS = "cast(array() as array<string>)"


def _kind(value: Column) -> Column:
    """The JSON type of a variant: STRING, ARRAY..., OBJECT..., a number's; VOID for null and for nothing."""
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def _get(value: Column, path: str) -> Column:
    return F.try_variant_get(value, path, "variant")


def _list(value: Column) -> Column:
    """Members of a JSON array; none for anything else."""
    return F.when(_kind(value).startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>")).otherwise(F.expr("cast(array() as array<variant>)"))


def _one_of(value: Column, *kinds: str) -> Column:
    return F.regexp_extract(_kind(value), "^[A-Z]+", 0).isin(*kinds)


def _parts(message: Column) -> Column:
    """struct(ok, texts) of a message: its content.parts, if all types are as they should be; null counts as not there."""
    content, parts = _get(message, "$.content"), _get(message, "$.content.parts")
    members = _list(parts)
    ok = _one_of(message, "OBJECT", "VOID") & _one_of(content, "OBJECT", "VOID") & _one_of(parts, "ARRAY", "VOID") & ~F.exists(members, lambda p: ~_one_of(p, "STRING", "VOID"))
    return F.struct(ok.alias("ok"), F.transform(members, lambda p: F.coalesce(F.try_variant_get(p, "$", "string"), F.lit(""))).alias("texts"))


def request_parts(body: Column) -> Column:
    """messages[].content.parts[] of a request; nothing at all if any of these has another type, or for invalid JSON."""

    def texts(root):
        messages = _get(root, "$.messages")
        found = let(F.transform(_list(messages), _parts), lambda every: F.when(~F.exists(every, lambda m: ~m["ok"]), F.flatten(F.transform(every, lambda m: m["texts"]))))
        return F.when(_one_of(root, "OBJECT") & _one_of(messages, "ARRAY"), found)

    return F.coalesce(let(F.try_parse_json(body), texts), F.expr(NO_TEXTS))


def response_parts(body: Column) -> Column:
    """message.content.parts[] of a response; nothing if a type differs."""

    def texts(root):
        found = let(_parts(_get(root, "$.message")), lambda m: F.when(m["ok"], m["texts"]))
        return F.when(_one_of(root, "OBJECT"), found)

    return F.coalesce(let(F.try_parse_json(body), texts), F.expr(NO_TEXTS))


def valid_text(text: Column) -> Column:
    """Text if it is valid UTF-8, else empty."""
    return F.coalesce(F.try_validate_utf8(text), F.lit(""))


def valid_bounds(segments: Column, body: Column) -> Column:
    """array<struct<start, end, text>> within a body's bytes, with valid texts."""
    ok = lambda s: (s["start"] >= 0) & (s["end"] > s["start"]) & (s["end"] <= F.octet_length(body)) & s["text"].isNotNull() & (s["text"] != "") & ~s["text"].contains("\0")
    return F.filter(segments, ok)


def valid_segments(segments: Column) -> Column:
    """Non-empty texts without NUL."""
    return F.filter(segments, lambda s: s.isNotNull() & (s != "") & ~s.contains("\0"))


def _walk(value, change=None):
    if isinstance(value, str):
        return change(value) if change else value
    if isinstance(value, list):
        return [_walk(v, change) for v in value]
    if isinstance(value, dict):
        return {k: _walk(v, change) for k, v in value.items()}
    return value


def _added(df: DataFrame, columns: list[str], out: str, kind: str, one) -> DataFrame:
    """df and a column: one(values of the columns) of each row, in Arrow batches."""
    at = [df.columns.index(c) for c in columns]
    arrow_kind = {"string": "string", "array<string>": "list"}[kind]

    def run(batches):
        import pyarrow as pa

        own = pa.string() if arrow_kind == "string" else pa.list_(pa.string())
        for batch in batches:
            found = [one(*values) for values in zip(*(batch.column(k).to_pylist() for k in at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, own)], [f"c{k}" for k in range(batch.num_columns + 1)])

    plain = df.toDF(*(f"c{k}" for k in range(len(df.columns))))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema) + f", c{len(df.columns)} {kind}"
    return plain.mapInArrow(run, schema).toDF(*df.columns, out)


def all_strings(df: DataFrame, body_col: str, out: str = "strings") -> DataFrame:
    """Adds every string value of a JSON body, in document order; none for invalid bodies."""

    def one(body):
        got: list[str] = []
        try:
            _walk(json.loads(body or "null"), lambda s: got.append(s) or s)
        except (ValueError, RecursionError):
            return []
        return got

    return _added(df, [body_col], out, "array<string>", one)


def rewrite(df: DataFrame, body_col: str, mapping_col: str, out: str = "rewritten") -> DataFrame:
    """Adds the body with string values replaced whole by a map of values; unknown fields and order of keys stay.

    The body is parsed and written again, so values may hold anything.  Invalid bodies stay as they are.
    """

    def one(body, mapping):
        try:
            table = dict(mapping or [])
            return body if body is None else _written(_walk(json.loads(body), lambda s: table.get(s, s)))
        except (ValueError, RecursionError):
            return body

    return _added(df, [body_col, mapping_col], out, "string", one)


def _written(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def rewrite_parts(df: DataFrame, body_col: str, texts_col: str, out: str = "rewritten") -> DataFrame:
    """Adds the body with the texts put in place of the valid segments that request_parts or response_parts gives, in order.

    Only these places change; equal strings elsewhere stay.  Bodies without such places stay byte for byte.
    """

    def one(body, texts):
        if not texts:
            return body
        root, new = json.loads(body), iter(texts)
        messages = root["messages"] if isinstance(root.get("messages"), list) else [root.get("message")]
        for message in messages:
            parts = ((message or {}).get("content") or {}).get("parts") or []
            for k, part in enumerate(parts):
                if part and "\0" not in part:
                    parts[k] = next(new)
        return _written(root)

    return _added(df, [body_col, texts_col], out, "string", one)
