"""Streaming forms against their batch forms and plain Python, over several micro-batches."""

import datetime
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from quillmask.functions import fixed
from quillmask.operators import detect, tokens
from quillmask.sources import sse, store, vault
from quillmask.streaming import streams

CHUNKS = "stream_id string, seq long, chunk string"


class Live:
    """A stream fed batch by batch, and what came out of it."""

    def __init__(self, spark, tmp_path, schema=CHUNKS):
        self.spark, self.schema, self.at = spark, schema, str(tmp_path)
        (tmp_path / "in").mkdir()
        self.rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{self.at}/in")
        self.query = self.name = None

    def put(self, *rows):
        self.spark.createDataFrame(list(rows), self.schema).coalesce(1).write.mode("append").json(f"{self.at}/in")
        if self.query:
            self.query.processAllAvailable()

    def start(self, out, name, kept=False):
        """kept: to files, so that the stream can start again from its checkpoint."""
        self.name, self.kept = name, kept
        if kept:
            self.query = out.writeStream.format("parquet").option("path", f"{self.at}/{name}-out").option("checkpointLocation", f"{self.at}/{name}").start()
            self.query.processAllAvailable()
            return
        self.query = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{self.at}/{name}").start()
        self.query.processAllAvailable()

    def stop(self):
        self.query.stop()
        out = self.spark.read.parquet(f"{self.at}/{self.name}-out") if self.kept else self.spark.table(self.name)
        return [tuple(r) for r in out.collect()]


def test_frames_do_not_depend_on_chunks():
    rng, limit = random.Random(1), 40
    for _ in range(400):
        text = "".join(rng.choices(["a", "é", "\n", "\r\n", "\n\n", "\r\n\r\n", "data: x", "word " * 6], k=rng.randrange(0, 25)))
        want = [f if len(f.encode()) <= limit else None for f in sse.cut_frames(text)[0]]
        buffer, skipping, got, at = "", False, [], 0
        while at < len(text):
            n = rng.choice([1, 2, 3, 7, 50])
            frames, buffer, skipping = streams.take_frames(buffer, skipping, text[at : at + n], limit)
            got, at = got + frames, at + n
            assert len(buffer.encode()) <= limit + 4
        assert got == want, repr(text)


def test_frames_in_any_order_with_gaps_and_stalls(spark, tmp_path):
    live = Live(spark, tmp_path)
    live.put(("a", 0, "data: 1\n\ndata: [DONE]\n\ndata: 2\n\n"), ("b", 0, "data: b1\n\nrest"), ("late", 2, "data: 3\n\n"), ("late", 1, "2\n\n"), ("gap", 0, "data: 0\n\nda"), ("gap", 2, "x\n\ndata: 2\n\n"), ("stall", 0, "data: 0\n\ndata: never"))
    live.start(streams.frame_stream(live.rows, limit=100, idle=0.2, stall=2), "frames")
    live.put(("a", 1, "data: 3\n\n"), ("late", 0, "data: 1\n\ndata: "), ("late", 0, "data: twice\n\n"), ("big", 0, "data: " + "x" * 200), ("b", 1, "\n\n"))
    live.put(("big", 1, "\n\ndata: small\n\n"))
    time.sleep(3)
    live.put(("tick", 0, ""))  # time-outs are looked at when something comes
    live.put(("gap", 1, "too late\n\n"), ("gap", 3, "data: 3\n\n"), ("stall", 1, " ends\n\ndata: 2\n\n"))
    time.sleep(13)
    live.put(("tick", 1, ""))
    live.put(("b", 7, "half\n\ndata: b7\n\n"), ("c", 0, "data: c\n\n"))  # b has given up its state
    time.sleep(3)
    live.put(("tick", 2, ""))
    live.put(("tick", 3, ""))
    got: dict = {}
    for key, _, frame, problem in live.stop():
        got.setdefault(key, []).append(frame or problem)
    assert got == {
        "a": ["data: 1", "data: [DONE]"], "b": ["data: b1", "rest", "gap", "data: b7"], "late": ["data: 1", "data: 2", "data: 3"], "gap": ["data: 0", "gap", "data: 2", "data: 3"],
        "stall": ["data: 0", "stalled", "data: 2"], "big": ["oversize", "data: small"], "c": ["data: c"],
    }


def test_sessions_and_frame_scans(spark, tmp_path):
    op = lambda kind, v: json.dumps({"o": kind, "p": "/message/content/parts/0", "v": v})
    text = f'data: {op("add", "hi")}\n\nevent: x\ndata: {op("append", " a@example.com")}\n\ndata: [DONE]\n\n'
    src, schema = str(tmp_path / "in"), "stream_id string, seq long, chunk string"
    spark.createDataFrame([("s", 0, text[:40]), ("s", 1, text[40:])], schema).coalesce(1).write.json(src)
    live = spark.readStream.schema(schema).json(src)
    chunks = spark.createDataFrame([("s", 1, "hi", False), ("s", 2, " a@example.com", False)], "stream_id string, frame_no long, text string, degraded boolean")
    q = streams.scan_frames(live).writeStream.format("memory").queryName("scanned").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert [(r.frame_no, r.result) for r in spark.table("scanned").orderBy("frame_no").collect()] == [(1, "clean"), (2, "pii_found")]
    frames = spark.createDataFrame([("s", k + 1, f) for k, f in enumerate(sse.cut_frames(text)[0])], "stream_id string, frame_no long, frame string")
    frames.coalesce(1).write.parquet(str(tmp_path / "frames"))
    live = spark.readStream.schema(frames.schema).parquet(str(tmp_path / "frames"))
    q = streams.session_stream(live).writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted(spark.table("sessions").collect()) == sorted(chunks.collect())


def test_documents_in_state_equal_the_batch(spark, tmp_path):
    part = "/message/content/parts/"
    ops = [("", {"o": "add", "p": part + "0", "v": "a"}), ("input_message", {"input_message": {"content": {"parts": ["x", {"k": "y"}]}}}), ("", {"o": "append", "p": part + "0", "v": "b"}), ("", {"o": "add", "p": part + "1/k", "v": "c"}),
           ("", {"o": "replace", "p": part + "0", "v": "d" * 1000}), ("title_generation", {"title": "t"}), ("", {"o": "add", "p": part + "4", "v": ["z"]}), ("", {"o": "append", "p": "/no/where", "v": "e"}), ("", {"o": "add", "p": part + "0", "v": "f"})]
    rng = random.Random(2)
    rows = [(s, n + 1, f"event: {kind}\ndata: {json.dumps(op)}") for s in "abc" for n, (kind, op) in enumerate([ops[0], *rng.choices(ops[:-2] if s < "c" else ops, k=9)])]
    live = Live(spark, tmp_path, "stream_id string, frame_no long, frame string")
    for k in range(3):
        live.put(*(r for n, r in enumerate(rows) if n % 3 == k), (f"only{k}", 1, "data: [DONE]"))  # out of order, put right
    live.start(streams.session_stream(live.rows), "documents")
    events = spark.createDataFrame(rows, "stream_id string, frame_no long, frame string").select("stream_id", "frame_no", sse.event(F.col("frame")).alias("event"), sse.data(F.col("frame")).alias("data"))
    assert sorted(live.stop()) == sorted(map(tuple, sse.patch_text(events).collect()))


def test_restoring_streams(spark, tmp_path):
    mapping = spark.createDataFrame([("s", "<<EMAIL_1>>", "a@example.com"), ("t", "<<EMAIL_1>>", "other@example.com"), ("t", "<<EMAIL_2>>", "no@example.com")], "stream_id string, token string, value string")
    live = Live(spark, tmp_path, "stream_id string, seq long, text string")
    live.put(("s", 1, "IL_1>> and <<EMAIL_2>>\n\n"), ("s", 2, "data: x\n\n"), ("idle", 0, "<<EMAI"))
    live.put(("s", 0, "data: hi <<EMA"), ("s", 3, None))
    live.start(streams.rehydrate_stream(live.rows, mapping, idle=0.05), "restored")
    time.sleep(4)
    live.put(("tick", 0, "-"))
    live.put(("tick", 1, "-"))
    got = live.stop()
    assert "".join(r[2] for r in sorted(got) if r[0] == "s") == "data: hi a@example.com and <<EMAIL_2>>\n\ndata: x\n\n"
    assert "".join(r[2] for r in sorted(got) if r[0] == "idle") == "<<EMAI"  # flushed with the time-out


def test_rewriting_streams_equal_the_batch(spark, tmp_path):
    rng = random.Random(3)
    bits = ["data: hi <<EMAIL_1>> and <<EMAIL_9>>", "data:  <<EMA", "data: IL_1>> end", "event: t <<EMAIL_1>>", "id: é", "\n", "\r\n", "\n\n", "\r\n\r\n", "\n\n", "data: [DONE]", "data: <<NAME_2>>"]
    texts = {f"s{k}": "".join(rng.choices(bits, k=rng.randrange(1, 25))) for k in range(12)}
    rows = []
    for key, text in texts.items():
        cuts = sorted({0, len(text), *rng.sample(range(len(text)), min(len(text), 9))})
        rows += [(key, n, text[lo:hi]) for n, (lo, hi) in enumerate(zip(cuts, cuts[1:]))]
        rows.append((key, len(cuts) - 1, None))
    mapping = spark.createDataFrame([(s, t, v) for s in texts for t, v in (("<<EMAIL_1>>", "a@example.com"), ("<<NAME_2>>", f"Name {s}"))], "stream_id string, token string, value string")
    live = Live(spark, tmp_path)
    for k in range(3):
        live.put(*(r for n, r in enumerate(rows) if n % 3 == k))
    live.start(streams.rewrite_stream(live.rows, mapping), "rewritten")
    got: dict = {}
    for key, _, body, n in sorted(live.stop()):
        old = got.get(key, (b"", 0))
        got[key] = old[0] + bytes(body), old[1] + n
    batch = sse.rewrite_streams(spark.createDataFrame([r for r in rows if r[2] is not None], CHUNKS), mapping)
    assert {k: (b.decode(), n) for k, (b, n) in got.items()} == {r.stream_id: (r.body, r.restored) for r in batch.collect()}


def test_bytes_that_are_no_text_stay(spark, tmp_path):
    live = Live(spark, tmp_path, "stream_id string, seq long, hex string")
    live.put(("s", 0, (b"data: \xff <<EMAIL_1>>\n\ndata: <<EMAIL_1>> \xc3").hex()), ("s", 1, (b"\xa9\n\n").hex()))
    mapping = spark.createDataFrame([("s", "<<EMAIL_1>>", "v")], "stream_id string, token string, value string")
    live.start(streams.rewrite_stream(live.rows.select("stream_id", "seq", F.unhex("hex").alias("chunk")), mapping), "bytes")
    assert [bytes(r[2]) for r in sorted(live.stop())] == [b"data: \xff <<EMAIL_1>>\n\n", "data: v é\n\n".encode()]


def test_tokens_as_requests_come_equal_the_batch(spark, tmp_path):
    """Several micro-batches out of order and a restart from the checkpoint; responses are restored by what requests were given."""
    schema = "conv string, turn long, text string, response boolean"
    said = ["mail b@example.com é", "from a@example.com to b@example.com", None, "", "c@example.com, a@example.com; 4111 1111 1111 1111", "x" * 100]
    rows = [(c, n, said[(n + ord(c)) % 6], False) for c in "abc" for n in range(9)]
    live = Live(spark, tmp_path, schema)
    stream = lambda: streams.token_stream(live.rows, "conv", "turn", response=F.col("response"), only=("email", "card"))
    live.put(*(r for r in rows if r[1] in (0, 2, 4)))
    live.start(stream(), "tokens", kept=True)
    live.put(*(r for r in rows if r[1] in (1, 5)))
    before = live.stop()
    assert {r[1] for r in before} == {0, 1, 2}  # 4 and 5 wait for 3
    live.query = None
    live.put(*(r for r in rows if r[1] in (3, 6, 7, 8)), *((c, 9, "to <<EMAIL_1>> and <<EMAIL_7>>", True) for c in "abc"), ("d", 0, "<<EMAIL_1>>", True))
    live.start(stream(), "tokens", kept=True)
    got = [r for r in live.stop() if r[1] > 2 or r[0] == "d"]
    found = detect.detect(spark.createDataFrame(rows, schema), only=("email", "card"))
    masked, mapping = tokens.tokenize(found, ["conv"], ["turn"])
    assert sorted(r[:2] + (r[3],) for r in before + got if not r[2]) == sorted((r.conv, r.turn, r.tokenized) for r in masked.collect())
    known = {(r.conv, r.token): r.value for r in mapping.collect()}
    assert {(r[0], f.token): f.value for r in before + got for f in r[4]} == known
    assert sorted((r[0], r[3]) for r in got if r[2]) == [*((c, f"to {known[c, '<<EMAIL_1>>']} and <<EMAIL_7>>") for c in "abc"), ("d", "<<EMAIL_1>>")]


def test_a_store_is_swept_while_a_stream_writes(spark, tmp_path):
    key, schema = bytes(range(32)), "provider string, conversation_id string, token string, type string, value string, at timestamp"
    src, out, at = str(tmp_path / "in"), str(tmp_path / "vault"), datetime.datetime
    values = lambda: sorted((r.conversation_id, r.v) for r in store.Store(spark, out).read().select("conversation_id", vault.unseal(F.col("value"), key).alias("v")).collect())

    def batch(*rows):
        spark.createDataFrame([("p", c, "<<EMAIL_1>>", "EMAIL", v, at(2024, 1, day)) for c, v, day in rows], schema).coalesce(1).write.mode("append").parquet(src)
        live = vault.entries(spark.readStream.schema(schema).parquet(src), key, F.col("at"))
        assert streams.persist_stream(live, out, str(tmp_path / "c"), availableNow=True).awaitTermination(120)

    batch(("a", "one", 2), ("a", "older", 1), ("gone", "x", 1))
    batch(("b", "two", 9), ("a", "newer", 9))
    assert values() == [("a", "newer"), ("b", "two"), ("gone", "x")]
    assert store.Store(spark, out).sweep(F.expr("TIMESTAMP '2024-01-09 00:00:00'"), 168, grace=0) == 2  # a began on the 1st, whatever was rewritten later
    batch(("c", "three", 9))
    assert values() == [("b", "two"), ("c", "three")]
    batch(("b", "four", 10))
    assert values() == [("b", "four"), ("c", "three")]
