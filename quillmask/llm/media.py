"""ISO base media containers: writing a payload as a track of 8-bit samples, and reading a container's columns.

`walk` goes through nested boxes by their headers alone; `tracks` decodes the sample tables (stts, stsc, stsz, stco
or co64, stss) and derives codec, duration and the byte ranges of keyframes without decoding any payload.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from itertools import islice, repeat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: boxes that hold boxes
NESTING = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"moof", b"traf", b"mvex"}
#: levels that a path keeps
DEEP = 16
UNIT, RATE = 192, 8000
#: samples a chunk has at most, and after how many chunks a keyframe is listed
CHUNK, KEY_EVERY = 4096, 4
_UNITY = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def pad(text: str | None) -> tuple[int, bytes]:
    """UTF-8 length and payload: spaces appended up to a positive multiple of UNIT."""
    data = (text or "").encode("utf-8")
    return len(data), data + b" " * (max(1, -(-len(data) // UNIT)) * UNIT - len(data))


def write(payload: bytes) -> bytes:
    """A container with one sound track of 8-bit samples; equal payloads give equal bytes.

    Frames of UNIT bytes are its samples, in chunks of CHUNK bytes at most; each KEY_EVERY-th chunk starts with a
    sync sample.
    """
    n, per = len(payload) // UNIT, max(1, CHUNK // UNIT)
    chunks = -(-n // per)
    wide = len(payload) > 0xF0000000
    brand = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp41")
    entry = _box(b"raw ", b"\0" * 6, struct.pack(">HHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, RATE << 16))
    full, rest = divmod(n, per)
    runs = [(1, per)] * bool(full) + [(full + 1, rest)] * bool(rest)
    keys = [k * per + 1 for k in range(0, chunks, KEY_EVERY)]

    def movie(first: int) -> bytes:
        places = [first + k * per * UNIT for k in range(chunks)]
        table = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, UNIT)),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", c, s, 1) for c, s in runs)),
            _full(b"stsz", struct.pack(">II", UNIT, n)),
            _full(b"co64" if wide else b"stco", struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *places)),
            _full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
        )
        length = n * UNIT
        media = _box(
            b"mdia",
            _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, length & 0xFFFFFFFF, 0x55C4, 0)),
            _full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"\0"),
            _box(b"minf", _full(b"smhd", b"\0" * 4), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), table),
        )
        track = _box(b"trak", _full(b"tkhd", struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, length & 0xFFFFFFFF, 0, 0, 256, 0), _UNITY, b"\0" * 8, flags=3), media)
        header = _full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, RATE, length & 0xFFFFFFFF, 0x10000, 256), _UNITY, b"\0" * 24, struct.pack(">I", 2))
        return _box(b"moov", header, track)

    head = 16 if wide else 8
    moov = movie(len(brand) + len(movie(0)) + head)
    size = len(payload) + head
    return brand + moov + (struct.pack(">I4sQ", 1, b"mdat", size) if wide else struct.pack(">I4s", size, b"mdat")) + payload


def walk(data: bytes, lo: int = 0, hi: int | None = None):
    """Yields (path, first byte of the body, end) of every box, depth first.  A box that does not fit ends its level.

    Levels are kept on a list, so boxes may nest to any depth; a path names the DEEP innermost kinds at most.
    """
    open_levels: list[tuple[int, int, tuple[bytes, ...]]] = [(lo, len(data) if hi is None else hi, ())]
    while open_levels:
        lo, hi, path = open_levels.pop()
        if lo + 8 > hi:
            continue
        size, kind = struct.unpack_from(">I4s", data, lo)
        body = lo + 8
        if size == 1:
            if lo + 16 > hi:
                continue
            size, body = struct.unpack_from(">Q", data, body)[0], lo + 16
        end = hi if size == 0 else lo + size
        if end > hi or end < body:
            continue
        here = (*path[-DEEP + 1 :], kind)
        yield here, body, end
        open_levels.append((end, hi, path))
        if kind in NESTING:
            open_levels.append((body, end, here))


def tracks(data: bytes) -> list[dict]:
    """codec, timescale, duration, seconds, samples, keyframes [(first byte, end)], chunks [(first byte, end)] by track."""
    found: list[dict] = []
    for path, lo, hi in walk(data):
        kind = path[-1]
        if kind == b"trak":
            found.append({})
        elif found and path[0] == b"moov" and b"trak" in path:
            found[-1].setdefault(kind, (lo, hi))
    return [t for t in (_track(data, boxes) for boxes in found) if t]


def _numbers(data: bytes, lo: int, hi: int, width: int, code: str = "I") -> list[tuple[int, ...]]:
    """A counted table of width numbers a row, as far as its box goes."""
    step = struct.calcsize(f">{width}{code}")
    rows = min(struct.unpack_from(">I", data, lo)[0], max(0, (hi - lo - 4) // step))
    return list(struct.iter_unpack(f">{width}{code}", data[lo + 4 : lo + 4 + rows * step]))


def _track(data: bytes, box: dict) -> dict | None:
    if not {b"mdhd", b"stsd", b"stsz", b"stsc"} <= box.keys() or not box.keys() & {b"stco", b"co64"}:
        return None
    lo, hi = box[b"mdhd"]
    scale, length = struct.unpack_from(">IQ", data, lo + 20) if data[lo] == 1 else struct.unpack_from(">II", data, lo + 12)
    lo, hi = box[b"stsd"]
    codec = data[lo + 12 : lo + 16].decode("latin-1")
    lo, hi = box[b"stsz"]
    fixed, count = struct.unpack_from(">II", data, lo + 4)
    sizes = repeat(fixed, min(count, len(data) // fixed)) if fixed else iter([s for (s,) in _numbers(data, lo + 8, hi, 1)])  # a file holds no more
    wide = b"co64" in box
    lo, hi = box[b"co64" if wide else b"stco"]
    places = [p for (p,) in _numbers(data, lo + 4, hi, 1, "Q" if wide else "I")]
    lo, hi = box[b"stsc"]
    runs = _numbers(data, lo + 4, hi, 3)
    ranges, chunks = [], []
    for k, (first, per, _) in enumerate(runs):
        stop = runs[k + 1][0] if k + 1 < len(runs) else len(places) + 1
        for c in range(first, min(stop, len(places) + 1)):
            at = began = places[c - 1]
            for size in islice(sizes, per):
                ranges.append((at, at + size))
                at += size
            chunks.append((began, at))
    if b"stss" in box:
        lo, hi = box[b"stss"]
        keys = [ranges[s - 1] for (s,) in _numbers(data, lo + 4, hi, 1) if 0 < s <= len(ranges)]
    else:
        keys = ranges
    ticks = sum(n * d for n, d in _numbers(data, box[b"stts"][0] + 4, box[b"stts"][1], 2)) if b"stts" in box else length
    return {"codec": codec, "timescale": scale, "duration": length, "ticks": ticks, "samples": len(ranges), "keyframes": keys, "chunks": chunks}


def describe(data: bytes) -> str:
    """The stored columns as text: codec, duration in seconds, samples and keyframe byte ranges of each track."""
    return json.dumps([{"codec": t["codec"], "seconds": round(t["ticks"] / t["timescale"], 6) if t["timescale"] else None, "samples": t["samples"], "keyframes": t["keyframes"]} for t in tracks(data)], separators=(",", ":"))


def read_payload(data: bytes) -> bytes:
    """The first track's samples, by its own tables."""
    return b"".join(data[a:b] for t in tracks(data)[:1] for a, b in t["chunks"])


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Stores each text in a container, reads it back and describes it: one row per input row, in one narrow pass.

    Null and empty texts are one unit of spaces.  Repeated rows give equal rows; null ids stay; other columns are not
    looked at; an empty table gives an empty result.  Texts are handled one at a time, so a long one needs memory for
    its own container only.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for value in batch.column(1):
                n, payload = pad(value.as_py())
                media = write(payload)
                back = read_payload(media)
                rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), describe(media), *([media] if keep_media else [])))
            cols = list(zip(*rows)) or [()] * (7 + keep_media)
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media"]
            arrays = [batch.column(0), *(pa.array(list(c), t) for c, t in zip(cols, types))]
            yield pa.RecordBatch.from_arrays(arrays, names[: len(arrays)])

    read = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return read.mapInArrow(run, schema + (", media binary" if keep_media else "")).withColumnRenamed("id", id_col)


def container_columns(files: DataFrame, id_col: str, data_col: str) -> DataFrame:
    """Columns of stored containers (binary): id, description.  Null or broken data gives an empty list.

    Tables are read as far as their boxes go, whatever counts they claim, and sample sizes as far as the file could hold them.
    """
    id_type = files.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for value in batch.column(1):
                try:
                    out.append(describe(value.as_py() or b""))
                except (struct.error, IndexError):
                    out.append("[]")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["id", "description"])

    return files.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{data_col}`").alias("data")).mapInArrow(run, f"id {id_type}, description string").withColumnRenamed("id", id_col)
