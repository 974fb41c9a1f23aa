"""Structured Streaming forms: frames from chunks, sessions, tokens assigned and restored as streams go on, rewriting, detection and vault sinks.

State is kept per stream, and streams are read in order (see ordered): what is missing, stalls or comes too late costs a
stream that part alone.  A stream that has ended, or from which nothing has come for `idle` minutes, gives up its state.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmask.functions import fixed
from quillmask.operators import audit, tokens
from quillmask.operators.detect import detect
from quillmask.sources.sse import DONE, Document, Session, cut_frames, data, event, frame_lines, open_token
from quillmask.sources.store import Store
from quillmask.streaming.ordered import Ordered, ordered

#: why a frame is null
OVERSIZE, STALLED, GAP = "oversize", "stalled", "gap"


def _size(text: str) -> int:
    return len(text.encode("utf-8", "replace"))


def take_frames(buffer: str, skipping: bool, chunk: str, limit: int) -> tuple[list[str | None], str, bool]:
    """(complete frames, what is left, whether that belongs to a frame being skipped).  A frame beyond the limit (bytes) is None, however it is cut into chunks."""
    whole, rest = cut_frames(buffer + chunk)
    out = [f if _size(f) <= limit else None for f in whole]
    if skipping and whole:
        out[0], skipping = None, False
    skipping = skipping or _size(rest.rstrip("\r\n")) > limit  # a line's end may belong to the blank line
    return out, rest[-2:] if skipping else rest, skipping  # two characters may begin the blank line


def hold_back(text: str) -> tuple[str, str]:
    """(what can go out, the start of a token that may go on); a start beyond the limit goes out."""
    at = open_token(text)
    return text[:at], text[at:]


class Frames(Ordered):
    """Frames of numbered chunks."""

    payload = "chunk string"

    def __init__(self, limit: int, stall: float, idle: float):
        super().__init__(stall, idle)
        self.limit = limit

    def open(self, handle) -> None:
        # skipping: 1 a frame beyond the limit, 2 one that was given out as null before its end
        self.state = handle.getValueState("frames", "buffer string, count long, skipping int, ended boolean")

    def _now(self) -> tuple:
        return self.state.get() if self.state.exists() else ("", 0, 0, False)

    def take(self, key, number, chunk):
        buffer, count, skipping, ended = self._now()
        if ended:
            return
        frames, buffer, skips = take_frames(buffer, skipping > 0, chunk or "", self.limit)
        for frame in frames:
            self.renewed = True
            if frame is None and skipping == 2:
                skipping = 0
                continue
            skipping, count = 0, count + 1
            yield key[0], count, frame, OVERSIZE if frame is None else None
            if frame is not None and any(is_data and line == DONE for is_data, line in frame_lines(frame)):
                buffer, skips, ended = "", False, True
                break
        self.state.update((buffer, count, (skipping or 1) if skips else 0, ended))

    def unfinished(self) -> bool:
        buffer, _, skipping, ended = self._now()
        return not ended and (skipping == 1 or (skipping == 0 and buffer != ""))

    def _lost(self, key, why: str):
        buffer, count, skipping, ended = self._now()
        if not ended:
            self.state.update((buffer[-2:] if why == STALLED else "", count + 1, 2, False))
            yield key[0], count + 1, None, why

    def stalled(self, key):
        return self._lost(key, STALLED)

    def gap(self, key, number):
        return self._lost(key, GAP)

    def end(self, key):
        self.state.clear()
        return iter(())


def frame_stream(chunks: DataFrame, limit: int = fixed.FRAME, idle: float = fixed.IDLE_MINUTES, stall: float = fixed.STALL_SECONDS) -> DataFrame:
    """(stream_id, frame_no, frame, problem) of a stream of (stream_id, seq, chunk).

    A null frame stands for one that is lost: beyond the limit (bytes; at its end), unfinished for `stall` seconds, or with a chunk
    that did not come in that time (at once; what follows up to the next blank line goes with it).  What comes after the end
    marker is left out, until the idle state goes.
    """
    return ordered(chunks, "stream_id", "seq", Frames(limit, stall, idle), "stream_id string, frame_no long, frame string, problem string")


class _Nodes:
    """A document's nodes in map state."""

    def __init__(self, state):
        self.state = state

    def get(self, key):
        if not self.state.containsKey((key,)):
            return None
        kind, text, size, names = self.state.getValue((key,))
        return kind, text, size, list(names)

    def __setitem__(self, key, node):
        self.state.updateValue((key,), node)

    def __delitem__(self, key):
        self.state.removeKey((key,))


class Sessions(Ordered):
    """Texts of events, with the document's nodes by path in state: an event reads and writes those on its way."""

    payload, first = "event string, data string", 1

    def open(self, handle) -> None:
        self.nodes = handle.getMapState("nodes", "path string", "kind string, text string, size int, names array<string>")
        self.state = handle.getValueState("session", "count long, size long, degraded boolean, failed boolean")

    def take(self, key, number, kind, text):
        count, size, degraded, failed = self.state.get() if self.state.exists() else (0, 0, False, False)
        if (text or "").strip() == DONE:
            self.end(key)
        elif text:
            session = Session(Document(_Nodes(self.nodes), count, size, degraded), failed)
            said, document = session.text(kind or "", text), session.document
            self.state.update((document.count, document.size, document.degraded, session.failed))
            yield key[0], number, said, session.degraded

    def end(self, key):
        self.nodes.clear()
        self.state.clear()
        return iter(())


def session_stream(frames: DataFrame, idle: float = fixed.IDLE_MINUTES, stall: float = fixed.STALL_SECONDS) -> DataFrame:
    """(stream_id, frame_no, text, degraded) of a stream of (stream_id, frame_no, frame): what each event brings to its stream's document.

    A session that fails goes on with the raw data of its later frames.
    """
    frame = F.coalesce("frame", F.lit(""))
    events = frames.select("stream_id", "frame_no", event(frame).alias("event"), data(frame).alias("data"))
    return ordered(events, "stream_id", "frame_no", Sessions(stall, idle), "stream_id string, frame_no long, text string, degraded boolean")


class WholeTokens(Ordered):
    """Texts cut anew."""

    payload = "text string"

    def open(self, handle) -> None:
        self.state = handle.getValueState("held", "held string, last long")

    def take(self, key, number, text):
        held = self.state.get()[0] if self.state.exists() else ""
        go, held = (held, "") if text is None else hold_back(held + text)
        self.state.update((held, number))
        yield key[0], number, go

    def gap(self, key, number):
        """What was held can't go on behind a gap."""
        return self.end(key)

    def end(self, key):
        held, last = self.state.get() if self.state.exists() else ("", 0)
        self.state.clear()
        return iter([(key[0], last, held)] if held else [])


def whole_tokens(pieces: DataFrame, idle: float = fixed.IDLE_MINUTES, stall: float = fixed.STALL_SECONDS) -> DataFrame:
    """(stream_id, seq, text) cut anew so that no token is split over two rows; a null text ends a stream and flushes, as does the time-out."""
    return ordered(pieces, "stream_id", "seq", WholeTokens(stall, idle), "stream_id string, seq long, text string")


def _own_values(mapping: DataFrame) -> DataFrame:
    """_of, _values: each stream's tokens as a map."""
    first = mapping.groupBy("stream_id", "token").agg(F.min("value").alias("value"))
    return first.groupBy(F.col("stream_id").alias("_of")).agg(F.map_from_entries(F.collect_list(F.struct("token", "value"))).alias("_values"))


def rehydrate_stream(pieces: DataFrame, mapping: DataFrame, idle: float = fixed.IDLE_MINUTES, stall: float = fixed.STALL_SECONDS) -> DataFrame:
    """(stream_id, seq, text) with each stream's own tokens restored, also those split over pieces.

    mapping: a table (stream_id, token, value).  It is joined to the stream by stream_id, so a number that two streams
    share stands for each one's own value, and no task holds the tokens of other streams.
    """
    cut = whole_tokens(pieces, idle, stall).withColumn("text", F.coalesce("text", F.lit("")))  # a projection: rows straight from Python can't be shuffled
    joined = cut.join(_own_values(mapping), F.col("stream_id") == F.col("_of"), "left")
    return joined.select("stream_id", "seq", tokens.restore(F.col("text"), F.col("_values")).alias("text"))


class Lines(Ordered):
    """Frames as parts, (whether it is data, bytes), with tokens that are split over data lines whole in the later one."""

    payload = "chunk binary"

    def open(self, handle) -> None:
        self.state = handle.getValueState("lines", "buffer binary, held string, count long")

    def _data(self, held: str, text: str) -> tuple[str, str]:
        text = held + text
        at = open_token(text)
        return text[:at], text[at:]

    def take(self, key, number, chunk):
        buffer, held, count = self.state.get() if self.state.exists() else (b"", "", 0)
        buffer = bytes(buffer) + bytes(chunk or b"")
        while found := re.search(rb"\r?\n\r?\n", buffer):
            raw, buffer = buffer[: found.end()], buffer[found.end() :]
            out = []
            try:
                lines = frame_lines(raw[: found.start()].decode())
            except UnicodeDecodeError:
                out, lines = [(False, raw)], None
            for is_data, line in lines or ():
                if is_data:
                    if line == DONE and held:
                        out += [(False, b"data: "), (True, held.encode()), (False, b"\n\n")]
                        held = ""
                    line, held = self._data(held, line)
                    out += [(False, b"data: "), (True, line.encode()), (False, b"\n")]
                else:
                    out.append((False, line.encode() + b"\n"))
            if lines is not None:
                out.append((False, b"\n"))
            count += 1
            yield key[0], count, [{"is_data": d, "bytes": t} for d, t in out]
        if chunk is None:  # the stream's end
            count += 1
            yield key[0], count, self._rest(buffer, held)
            buffer, held = b"", ""
        self.state.update((buffer, held, count))

    def _rest(self, buffer: bytes, held: str) -> list[dict]:
        parts = [(False, b"data: "), (True, held.encode()), (False, b"\n\n")] if held else []
        return [{"is_data": d, "bytes": t} for d, t in [*parts, (False, buffer)]]

    def end(self, key):
        buffer, held, count = self.state.get() if self.state.exists() else (b"", "", 0)
        self.state.clear()
        return iter([(key[0], count + 1, self._rest(bytes(buffer), held))] if buffer or held else [])


def rewrite_stream(chunks: DataFrame, mapping: DataFrame, idle: float = fixed.IDLE_MINUTES, stall: float = fixed.STALL_SECONDS) -> DataFrame:
    """(stream_id, frame_no, body, restored) of a stream of (stream_id, seq, chunk): each frame with the tokens of its data lines put back.

    However a stream is cut into chunks, the bodies of its frames in order are the body that sse.rewrite_streams gives it.  A token that
    is split over frames goes out with the later one.  What is held goes out before an end marker, where a null chunk says
    that the stream is over, or with the time-out.  chunk: text or bytes; a frame that is no valid UTF-8 stays as it is.
    """
    parts = ordered(chunks.withColumn("chunk", F.col("chunk").cast("binary")), "stream_id", "seq", Lines(stall, idle), "stream_id string, frame_no long, parts array<struct<is_data:boolean,bytes:binary>>")
    joined = parts.withColumn("parts", F.coalesce("parts", F.array())).join(_own_values(mapping), F.col("stream_id") == F.col("_of"), "left")
    put = F.transform("parts", lambda p: F.when(p["is_data"], tokens.restore(p["bytes"].cast("string"), F.col("_values")).cast("binary")).otherwise(p["bytes"]))
    known = lambda t: F.coalesce(F.map_contains_key(F.col("_values"), t), F.lit(False))
    hits = F.transform("parts", lambda p: F.when(p["is_data"], F.size(F.filter(F.regexp_extract_all(p["bytes"].cast("string"), F.lit(fixed.TOKEN), F.lit(0)), known))).otherwise(0))
    body = F.aggregate(put, F.lit(b""), lambda a, x: F.concat(a, x))
    return joined.select("stream_id", "frame_no", body.alias("body"), F.aggregate(hits, F.lit(0), lambda a, n: a + n).cast("long").alias("restored"))


class Tokens(Ordered):
    """Values and tokens of a scope, kept as its requests come: the first write of a value wins; responses get their values back."""

    payload, first = "response boolean, text string, found string", 0

    def open(self, handle) -> None:
        self.tokens = handle.getMapState("tokens", "value string", "token string")
        self.values = handle.getMapState("values", "token string", "value string")
        self.counts = handle.getMapState("counts", "type string", "n long")

    def _token(self, kind: str, value: str, fresh: list) -> str:
        if self.tokens.containsKey((value,)):
            return self.tokens.getValue((value,))[0]
        n = 1 + (self.counts.getValue((kind,))[0] if self.counts.containsKey((kind,)) else 0)
        token = f"<<{kind}_{n}>>"
        self.counts.updateValue((kind,), (n,))
        self.tokens.updateValue((value,), (token,))
        self.values.updateValue((token,), (value,))
        fresh.append({"value": value, "type": kind, "n": n, "token": token})
        return token

    def take(self, key, number, response, text, found):
        fresh: list = []
        if response:
            back = lambda m: self.values.getValue((m[0],))[0] if self.values.containsKey((m[0],)) else m[0]
            out = None if text is None else re.sub(fixed.TOKEN, back, text)
        elif text is None:
            out = None
        else:
            raw, at, parts = text.encode(), 0, []
            for e in sorted(json.loads(found or "[]"), key=lambda e: (e["start"], e["ord"])):
                parts += [raw[at : e["start"]], self._token(e["type"], e["value"], fresh).encode()]
                at = e["end"]
            out = b"".join([*parts, raw[at:]]).decode()
        yield key[0], number, bool(response), out, fresh

    def end(self, key):
        for state in (self.tokens, self.values, self.counts):
            state.clear()
        return iter(())


def token_stream(rows: DataFrame, scope: str, order: str, text_col: str = "text", response: Column | None = None, only: tuple[str, ...] | None = None, gapless: bool = True, first: int = 0, idle: float = fixed.IDLE_MINUTES, stall: float = fixed.STALL_SECONDS) -> DataFrame:
    """scope, order, response, text, fresh (array<struct<value,type,n,token>>, the tokens that a row is first to have) of a stream.

    Requests get tokens for what detect() finds in them, by value and scope as in tokens.tokenize, and go on from what earlier
    requests of the scope were given.  Rows for which `response` holds get the values of the scope's tokens back.  gapless: whether a
    scope's rows are numbered one by one from `first`, so that they can be put in order; else they are read as they come.
    """
    found = detect(rows.withColumn("_r", F.coalesce(response, F.lit(False)) if response is not None else F.lit(False)), text_col, only, gate=None)
    spans = F.when(F.col("_r"), F.lit("[]")).otherwise(F.to_json(F.transform(tokens.valid(F.col("entities"), F.col(text_col)), lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["ord"].alias("ord"), e["type"].alias("type"), e["value"].alias("value")))))
    text = F.when(F.col("status") != "oversize", F.col(text_col))
    reader = Tokens(stall, idle)
    reader.gapless = gapless
    ready = found.select(F.col(scope).cast("string").alias(scope), F.col(order).cast("long").alias(order), F.col("_r").alias("response"), F.when(F.col("_r"), F.col(text_col)).otherwise(text).alias("text"), spans.alias("found"))
    return ordered(ready, scope, order, reader, f"{scope} string, {order} long, response boolean, text string, fresh array<struct<value:string,type:string,n:long,token:string>>", first)


def scan_stream(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """Audit records of a stream of texts: the batch scan as it is, since it is narrow."""
    return audit.records(detect(rows, text_col), text_col)


def scan_frames(chunks: DataFrame, limit: int = fixed.FRAME) -> DataFrame:
    """Audit records of the data of each complete frame; skipped frames, end markers and frames without data have none."""
    frames = frame_stream(chunks, limit).where("frame IS NOT NULL").select("stream_id", "frame_no", data(F.col("frame")).alias("text"))
    return scan_stream(frames.where((F.col("text") != "") & (F.trim("text") != DONE)))


def persist_stream(entries: DataFrame, path: str, checkpoint: str, name: str = "stream", **trigger):
    """Writes a stream of vault entries to a store (see store.Store), where it can be swept meanwhile.

    name: tells this stream's batches from those of others; a batch that comes again is not written again.
    """

    def write(batch: DataFrame, number: int) -> None:
        Store(batch.sparkSession, path).add(batch, name, number)

    return entries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "0 seconds"})).start()


def windowed_counts(events: DataFrame, ts: str = "ts", kind: str = "event_type", size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by tumbling window and kind, with late rows dropped beyond the watermark when streaming."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), kind, "n")
