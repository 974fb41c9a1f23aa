import hashlib
import math
import re

from pyspark.sql import functions as F

from quillmask.functions import fixed
from quillmask.operators import audit, tokens
from quillmask.operators import detect as det
from quillmask.plans.queries import QUERIES
from quillmask.streaming.streams import frame_stream, take_frames


def tables(spark, path, **rows):
    """Small tables of (columns, rows) in a directory that queries can read."""
    for name, (columns, values) in rows.items():
        spark.createDataFrame(values, columns).coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)


def documents(texts):
    return "doc_id long, source string, lang string, text string", [(i, "web", "en", t) for i, t in enumerate(texts)]


def phone_model(text):
    spans = {}
    for pattern in fixed.PHONES:
        for m in re.finditer(pattern, text):
            spans.setdefault(m.span(), m[0])
    out = []
    for (a, b), value in spans.items():
        d = re.sub("[^0-9]", "", value)
        runs = any(d[i : i + 3] in (f"{x}{x + 1}{x + 2}", f"{x + 2}{x + 1}{x}") for i in range(len(d) - 2) for x in range(8))
        score = 0.50 if not 7 <= len(d) <= 15 else 0.55 if len(set(d)) == 1 else 0.60 if runs else 0.85
        if score >= 0.55:
            out.append((score, b - a))
    return len(out), round(sum(s for s, _ in out), 4), sum(n for _, n in out)


def test_phone_query_runs_every_pattern(spark, tmp_path):
    texts = ["+33 6 39 98 04 17", "01 99 00 46 82", "+44 20 7946 0958", "+1 (212) 555-0187", "212 555 0187", "(212) 555-0187 and +33639980417", "000-000-0000 or 123-456-7890", "+12 34", "none", "", None]
    got = {r.doc_id: (r.n, r.score, r.n_bytes) for r in QUERIES["detect_phone"](spark, tables(spark, tmp_path, documents=documents(texts))).collect()}
    want = {i: phone_model(t or "") for i, t in enumerate(texts)}
    assert got == want
    assert all(want[i][0] for i in range(7))


def entropy_model(text):
    if not re.search("|".join(fixed.KEYWORDS), text.lower()):
        return 0, 0.0, 0

    def bits(v):
        counts = [v.count(c) for c in sorted(set(v))]
        return 0.0 if len(counts) == 1 else sum(-k / len(v) * math.log2(k * 256 // len(v) / 256) for k in counts if k * 256 // len(v))

    layers = (
        (fixed.BASE64, 0, lambda h: 0.80 if h >= 4.5 else 0.70 if h >= 3.5 else 0),
        (fixed.HEX, 0, lambda h: 0.65 if h >= 3.0 else 0),
        (fixed.BEARER.replace("(?i:bearer)", "[bB][eE][aA][rR][eE][rR]"), 1, lambda h: 0.50),
        (fixed.PAIR, 1, lambda h: 0.60 if h >= 3.5 else 0),
    )
    spans = {}
    for pattern, group, score in layers:
        for m in re.finditer(pattern, text):
            if (s := 0 if re.search("^(?:" + "|".join(fixed.NEVER) + ")$", m[group]) else score(bits(m[group]))) > 0:
                spans.setdefault(m.span(group), s)
    return len(spans), round(sum(spans.values()), 4), sum(b - a for a, b in spans)


def test_secret_query_returns_what_the_texts_hold(spark, tmp_path):
    texts = [
        "secret: q7Rt2LmZ9xKc4VbN8pWsD1fG6hJ0", "token " + "0a1b2c3d4e5f6789" * 3, "token; Bearer ab.cd-ef_gh.ij-kl_mn.op9", "password = Tr0ub4dor-3xyz", 'token = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"',
        "api_key=Zx8qLm3vT9sKe2RwY7uBa1 and secret=Zx8qLm3vT9sKe2RwY7uBa1", "q7Rt2LmZ9xKc4VbN8pWsD1fG6hJ0 alone", "secret nothing here", "", None,
    ]
    got = {r.doc_id: (r.n, r.score, r.n_bytes) for r in QUERIES["detect_secret_entropy"](spark, tables(spark, tmp_path, documents=documents(texts))).collect()}
    want = {i: entropy_model(t or "") for i, t in enumerate(texts)}
    assert got == want
    assert [want[i][0] > 0 for i in range(10)] == [True, True, True, True, False, True, False, False, False, False]


KINDS = ["a@example.com", "+1 (212) 555-0187", "4111 1111 1111 1111", "DE89370400440532013000", "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxIn0.abcDEF", "ghp_" + "aB3x" * 9, "nothing here"]


def test_labels_and_rollup_go_by_all_kinds(spark, tmp_path):
    path = tables(spark, tmp_path, documents=documents(KINDS))
    assert {r.result: (r.docs, r.entities) for r in QUERIES["doc_result_label"](spark, path).collect()} == {"pii_found": (6, 6), "clean": (1, 0)}
    assert {(r.lang, r.source): r.n for r in QUERIES["entity_grouping_sets"](spark, path).collect()} == {("en", "web"): 6, ("en", None): 6, (None, None): 6}


def test_token_queries_mask_all_kinds(spark, tmp_path):
    path = tables(spark, tmp_path, conversations=("conv_id long, turn long, role string, text string", [(1, i, "user", f"said {t}") for i, t in enumerate(KINDS)]))
    mapping = {r.value: r.token for r in QUERIES["token_assign"](spark, path).collect()}
    assert set(KINDS[:6]) < set(mapping)
    want = {i: f"said {mapping.get(t, t)} mail {mapping[f'user{i % 3}@example.org']} or {mapping['user1@example.org']}" for i, t in enumerate(KINDS)}
    assert {r.turn: r.tokenized for r in QUERIES["tokenize_conversations"](spark, path).collect()} == {i: hashlib.md5(t.encode()).hexdigest() for i, t in want.items()}
    said = {i: f"said {t} mail user{i % 3}@example.org or user1@example.org" for i, t in enumerate(KINDS)}
    assert {r.turn: r.text for r in QUERIES["rehydrate_roundtrip"](spark, path).collect()} == {i: hashlib.md5(t.encode()).hexdigest() for i, t in said.items()}
    assert QUERIES["stream_totals"](spark, path).first().entity_count == 6 + 2 * len(KINDS)


def test_queries_scan_long_texts(spark, tmp_path):
    path = tables(spark, tmp_path, documents=documents(["lorem ipsum " * 100_000 + "a@example.com", "short"]))
    assert {r.doc_id: r.n for r in QUERIES["detect_email"](spark, path).collect()} == {0: 1, 1: 0}
    assert {r.result: r.docs for r in QUERIES["doc_result_label"](spark, path).collect()} == {"pii_found": 1, "clean": 1}
    assert {r.doc_id: (r.status, r.result, r.entity_count) for r in QUERIES["audit_records"](spark, path).collect()} == {0: ("ok", "pii_found", 1), 1: ("ok", "clean", 0)}


def test_unscanned_texts_are_not_clean_and_not_passed_on(spark):
    df = spark.createDataFrame([(1, 0, "a@example.com"), (1, 1, "b@example.com " * 50), (1, 2, None)], "conv int, turn int, text string")
    scanned = det.detect(df, only=("email",), limit=100)
    assert [r.result for r in audit.records(scanned).orderBy("turn").collect()] == ["pii_found", "unscanned", "clean"]
    assert [r.tokenized for r in tokens.tokenize(scanned, ["conv"], ["turn"])[0].orderBy("turn").collect()] == ["<<EMAIL_1>>", None, None]
    assert [r.tokenized for r in tokens.tokenize(scanned, ["conv"], ["turn"], on_oversize="passthrough")[0].orderBy("turn").collect()] == ["<<EMAIL_1>>", "b@example.com " * 50, None]
    gated = det.detect(df, only=("email",), gate=F.col("turn") > 5)
    assert [r.result for r in audit.records(gated).orderBy("turn").collect()] == ["unscanned", "unscanned", "clean"]


def test_skipped_frames_end_at_their_blank_line():
    out, buffer, skipping = [], "", False
    for chunk in ["data: 1\n\ndata: " + "x" * 20, "yyy", "y\r\n\r", "\ndata: 2\n\nda", "ta: 3\n\n"]:
        frames, buffer, skipping = take_frames(buffer, skipping, chunk, 16)
        out += frames
    assert (out, buffer, skipping) == (["data: 1", None, "data: 2", "data: 3"], "", False)


def test_frame_stream_counts_skipped_frames(spark, tmp_path):
    schema = "stream_id string, seq long, chunk string"
    for k, chunk in enumerate(["data: 1\n\ndata: " + "x" * 20, "yy\n\ndata: 2\n\n"]):
        spark.createDataFrame([("a", k, chunk)], schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    chunks = spark.readStream.schema(schema).json(f"{tmp_path}/in")
    run = frame_stream(chunks, limit=16).writeStream.format("memory").queryName("skipped").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    assert run.awaitTermination(60)
    assert [(r.frame_no, r.frame) for r in spark.table("skipped").orderBy("frame_no").collect()] == [(1, "data: 1"), (2, None), (3, "data: 2")]
