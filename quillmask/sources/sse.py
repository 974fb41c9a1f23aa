"""Server-sent events: frames of chunked streams, their fields, and text from JSON-Patch events."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmask.functions import fixed
from quillmask.functions.fixed import DONE, MOST_DEPTH, MOST_NODES, MOST_PATH, MOST_SEGMENT, MOST_TEXT, SILENT


def frames(chunks: DataFrame, key: str = "stream_id", seq: str = "seq", chunk: str = "chunk") -> DataFrame:
    """One row per complete frame: key, frame_no from 1, event, data.  What follows the last blank line is no frame.

    A stream is one value here; its chunks meet in one task.
    """
    whole = chunks.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(seq, chunk))).alias("_c"))
    text = F.regexp_replace(F.array_join(F.transform("_c", lambda c: F.coalesce(c[chunk], F.lit(""))), ""), "\r\n", "\n")
    parts = whole.select(key, F.split(text, "\n\n", -1).alias("_p"))
    each = parts.select(key, F.posexplode(F.slice("_p", F.lit(1), F.size("_p") - 1)).alias("_k", "_f"))
    return each.select(key, (F.col("_k") + 1).cast("long").alias("frame_no"), event(F.col("_f")).alias("event"), data(F.col("_f")).alias("data"))


def _lines(frame: Column, field: str) -> Column:
    own = F.filter(F.split(frame, "\n", -1), lambda x: x.startswith(field + ":"))
    return F.transform(own, lambda x: F.trim(x.substr(F.lit(len(field) + 2), F.length(x))))


def data(frame: Column) -> Column:
    return F.array_join(_lines(frame, "data"), "\n")


def event(frame: Column) -> Column:
    return F.coalesce(F.try_element_at(_lines(frame, "event"), F.lit(-1)), F.lit(""))


def fields(frame: Column) -> Column:
    """struct(event, data, id, retry, comments) of a frame; retry is null unless it is a number."""
    last = lambda name: F.try_element_at(_lines(frame, name), F.lit(-1))
    notes = F.transform(F.filter(F.split(frame, "\n", -1), lambda x: x.startswith(":")), lambda x: F.trim(x.substr(F.lit(2), F.length(x))))
    return F.struct(event(frame).alias("event"), data(frame).alias("data"), last("id").alias("id"), last("retry").try_cast("long").alias("retry"), notes.alias("comments"))


def is_done(text: Column) -> Column:
    return F.trim(text) == DONE


def until_done(events: DataFrame, key: str = "stream_id", seq: str = "frame_no") -> DataFrame:
    """Events before their stream's end marker; all where it has none."""
    ends = events.where(is_done(F.col("data"))).groupBy(key).agg(F.min(seq).alias("_end"))
    return events.join(ends, key, "left").where(F.col("_end").isNull() | (F.col(seq) < F.col("_end"))).drop("_end")


def open_token(data: str) -> int:
    """Where a token that may go on after this text begins; the text's length if there is none."""
    at = data.rfind("<<")
    if at >= 0 and ">>" not in data[at:]:
        return at if len(data) - at <= fixed.SLIDING else len(data)
    return len(data) - data.endswith("<")


def frame_lines(raw: str) -> list[tuple[bool, str]]:
    """(whether it is data, the data or the whole line) of a frame's lines that are not blank."""
    out = []
    for line in raw.replace("\r\n", "\n").split("\n"):
        bare = line.strip()
        if bare.startswith("data:"):
            out.append((True, bare[5:].strip()))
        elif bare:
            out.append((False, line))
    return out


class Rewriter:
    """Puts values in place of tokens in a stream's data lines.  A token split over frames goes out with the later one."""

    def __init__(self, values: dict[str, str], held: str = ""):
        self.values, self.held, self.count = values, held, 0

    def data(self, text: str) -> str:
        text = self.held + text
        at = open_token(text)
        text, self.held = text[:at], text[at:]

        def put(m):
            self.count += m[0] in self.values
            return self.values.get(m[0], m[0])

        return re.sub(fixed.TOKEN, put, text)

    def close(self) -> str:
        """What is still held back at the end, as a frame of its own."""
        held, self.held = self.held, ""
        return f"data: {held}\n\n" if held else ""

    def frame(self, raw: str) -> str:
        """A frame with its data lines rewritten, line ends as LF, blank lines dropped and its separator put back; what is held goes out before an end marker."""
        out, held = [], ""
        for is_data, line in frame_lines(raw):
            if is_data and line == DONE:
                held += self.close()
            out.append("data: " + self.data(line) if is_data else line)
        return held + ("\n".join([*out, "", ""]) if out else "\n")


def rewrite_streams(chunks: DataFrame, mapping: DataFrame, key: str = "stream_id", seq: str = "seq", chunk: str = "chunk") -> DataFrame:
    """One row per stream: key, body (frames rewritten, what follows the last one as it is), restored (tokens put back).

    mapping: key, token, value.  A stream's chunks and tokens meet in one task, no others do.
    """
    kind = dict(chunks.dtypes)[key]

    def run(left, right):
        import pandas as pd

        text = "".join(c or "" for c in left.sort_values(seq)[chunk])
        rewriter = Rewriter(dict(zip(right["token"], right["value"])))
        *whole, rest = re.split("\r?\n\r?\n", text)
        body = "".join(rewriter.frame(f) for f in whole) + rewriter.close() + rest
        return pd.DataFrame([(left[key].iloc[0], body, rewriter.count)], columns=[key, "body", "restored"]) if len(left) else pd.DataFrame(columns=[key, "body", "restored"])

    own = mapping.select(key, "token", "value")
    return chunks.select(key, seq, chunk).groupBy(key).cogroup(own.groupBy(key)).applyInPandas(run, f"`{key}` {kind}, body string, restored long")


def cut_frames(text: str) -> tuple[list[str], str]:
    """(complete frames without their separators, what is left)."""
    *whole, rest = text.replace("\r\n", "\n").split("\n\n")
    return whole, rest


class Refused(ValueError):
    """An operation that a document does not take; the document is degraded from then on."""


def parse_path(path: str) -> list[str]:
    """Segments of a JSON pointer within limits; that of the root is empty."""
    if not path:
        return []
    if len(path.encode("utf-8", "replace")) > MOST_PATH or not path.startswith("/"):
        raise Refused("path")
    parts = [p.replace("~1", "/").replace("~0", "~") for p in path[1:].split("/")]
    if len(parts) + 1 > MOST_DEPTH or any(p[:1] in ("$", "@") and p or p == ".." or len(p.encode("utf-8", "replace")) > MOST_SEGMENT for p in parts):
        raise Refused("path")
    return parts


def _key(parts: list[str]) -> str:
    """A path's name in a document: its segments, escaped."""
    return "".join("/" + p.replace("~", "~0").replace("/", "~1") for p in parts)


def _is_text(path: str) -> bool:
    """Whether a path leads to a part of the content, or deeper."""
    _, found, below = path.rpartition("/content/parts/")
    return found != "" and below != ""


class Document:
    """A stream's document, to which patch operations are applied.  What it refuses, and its limits, leave it degraded.

    nodes: a mapping from paths to (kind, text, size, names of children), so that an operation touches the nodes on its
    way only: a dict, or state that is kept by path.  Nulls are no nodes.
    """

    def __init__(self, nodes=None, count: int = 0, size: int = 0, degraded: bool = False):
        self.nodes = {} if nodes is None else nodes
        self.count, self.size, self.degraded = count, size, degraded

    def _node(self, key: str):
        node = self.nodes.get(key)
        return ("map", "", 0, []) if node is None and key == "" else node

    def _drop(self, key: str) -> None:
        node = self.nodes.get(key)
        if node is not None:
            for name in node[3] if node[0] == "map" else map(str, range(node[2])):
                self._drop(f"{key}{_key([name])}")
            del self.nodes[key]

    def _put(self, key: str, value) -> None:
        """A value with all that is in it in the place of what was there."""
        self._drop(key)
        if isinstance(value, dict):
            self.nodes[key] = ("map", "", 0, list(value))
        elif isinstance(value, list):
            self.nodes[key] = ("list", "", len(value), [])
        elif value is not None:
            self.nodes[key] = ("text", value, 0, []) if isinstance(value, str) else ("other", "", 0, [])
        for name, v in value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ():
            self._put(key + _key([str(name)]), v)

    def _child(self, key: str, part: str) -> str | None:
        """The path of a child that is there."""
        node = self._node(key)
        if node is None or node[0] not in ("map", "list") or (node[0] == "list" and not re.fullmatch("[+-]?[0-9]+", part)):
            return None
        child = key + _key([part if node[0] == "map" else str(int(part))])
        return child if self._node(child) is not None else None

    def _count(self, more: int) -> None:
        self.count += more
        if self.count > MOST_NODES:
            raise Refused("nodes")

    def _set(self, key: str, part: str, value) -> str:
        """Sets a child; lists grow to its place."""
        node = self._node(key)
        if node is None or node[0] not in ("map", "list"):
            raise Refused("no container")
        kind, text, size, names = node
        if kind == "list":
            if not re.fullmatch("[+]?[0-9]+", part):
                raise Refused("index")
            part = str(int(part))
            self._count(max(0, int(part) + 1 - size))
            size = max(size, int(part) + 1)
        elif self._node(key + _key([part])) is None:
            self._count(1)
            names = names if part in names else [*names, part]
        child = key + _key([part])
        self.nodes[key] = (kind, text, size, names)
        self._put(child, value)
        return child

    def _holder(self, parts: list[str]) -> str:
        """The path of what holds the last segment, made on the way where it is not there."""
        at = ""
        for part in filter(None, parts[:-1]):
            at = self._child(at, part) or self._set(at, part, {})
        return at

    def _found(self, parts: list[str]) -> str:
        """The path of what holds the last segment, which must be there, in a map."""
        at = ""
        if not parts or not parts[:-1]:
            raise Refused("no holder")
        for part in filter(None, parts[:-2]):
            at = self._child(at, part)
            if at is None:
                raise Refused("no such path")
        if self._node(at)[0] != "map" or (held := self._child(at, parts[-2])) is None:
            raise Refused("no such path")
        return held

    def _one(self, kind: str, path: str, value) -> str:
        if kind not in ("add", "append", "replace"):
            return ""
        parts, new = parse_path(path), value if isinstance(value, str) else ""
        before = 0
        if kind == "add":
            holder = self._holder(parts)
            if parts and parts[-1]:
                self._set(holder, parts[-1], value)
        else:
            holder = self._found(parts)
            old = self._child(holder, parts[-1])
            text = self._node(old)[1] if old is not None else ""
            self._set(holder, parts[-1], text + new if kind == "append" else value)
            before = len(text.encode("utf-8", "replace")) if kind == "replace" else 0
        if not _is_text(path):
            return ""
        self.size += len(new.encode("utf-8", "replace")) - before
        if self.size > MOST_TEXT:
            raise Refused("text")
        return new

    def apply(self, op: dict) -> str:
        """Applies an operation, or those of a batch in order; returns the text that they bring to parts of the content."""
        kind = op.get("o")
        every = [op]
        if kind == "patch":
            every = [x for x in op["ops"] if isinstance(x, dict)] if isinstance(op.get("ops"), list) else []
        if self.degraded:
            return ""
        named = lambda x, k: x[k] if isinstance(x.get(k), str) else ""
        try:
            return "".join(self._one(named(x, "o"), named(x, "p"), x.get("v")) for x in every)
        except Refused:
            self.degraded = True
            return ""

    def begin(self, content: dict) -> bool:
        """A message with this content in the place of the one before."""
        if not self.degraded:
            try:
                self._set("", "message", {"content": content})
            except Refused:
                self.degraded = True
                return False
        return True


def strings(value) -> list[str]:
    if isinstance(value, str):
        return [value]
    if isinstance(value, dict):
        return [s for v in value.values() for s in strings(v)]
    return [s for v in value for s in strings(v)] if isinstance(value, list) else []


def event_text(document: Document, kind: str, text: str) -> str:
    """Text that an event brings: operations first, then input messages, then nothing for silent types and all strings for others.

    A frame's own type goes before the one in its data.  Data that is no JSON object brings nothing.
    """
    try:
        body = json.loads(text)
    except ValueError:
        return ""
    if not isinstance(body, dict):
        return ""
    if isinstance(body.get("o"), str):
        return document.apply(body)
    kind = kind or (body["type"] if isinstance(body.get("type"), str) else "")
    if kind == "input_message":
        message = body.get("input_message")
        content = message.get("content") if isinstance(message, dict) else None
        parts = content.get("parts") if isinstance(content, dict) else None
        return " ".join(p for p in parts if isinstance(p, str)) if isinstance(parts, list) and document.begin(content) else ""
    return "" if kind in SILENT else " ".join(strings(body))


class Session:
    """A stream's reader: text by event_text; if that fails, the raw data of this event and all later ones."""

    def __init__(self, document: Document | None = None, failed: bool = False):
        self.document, self.failed = Document() if document is None else document, failed

    def text(self, kind: str, data: str) -> str:
        if not self.failed:
            try:
                return event_text(self.document, kind, data)
            except Exception:
                self.failed = True
        return data

    @property
    def degraded(self) -> bool:
        return self.failed or self.document.degraded


def patch_text(events: DataFrame, key: str = "stream_id", seq: str = "frame_no") -> DataFrame:
    """One row per event (key, seq, event, data): key, seq, text, degraded.  Events of a stream are folded in order."""
    kinds = dict(events.dtypes)

    def run(pdf):
        import pandas as pd

        session, out = Session(), []
        for r in pdf.sort_values(seq).to_dict("records"):
            if (r["data"] or "").strip() == DONE:
                break
            out.append((r[key], r[seq], session.text(r["event"] or "", r["data"] or ""), session.degraded))
        return pd.DataFrame(out, columns=[key, seq, "text", "degraded"])

    return events.groupBy(key).applyInPandas(run, f"`{key}` {kinds[key]}, `{seq}` {kinds[seq]}, text string, degraded boolean")
