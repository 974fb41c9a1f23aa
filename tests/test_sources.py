import datetime
import json
import re

import pytest
from pyspark.sql import functions as F

from quillmask.plans import policy
from quillmask.sources import extract, sse, store, vault
from quillmask.streaming.streams import hold_back


def test_parts_and_rewrite(spark):
    bodies = ['{"model":"m","messages":[{"content":{"parts":["a","b"]}},{"content":{"parts":["c"]}}]}', '{"messages":[{"content":{"parts":[1]}}]}', "nonsense", None]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "id int, body string")
    got = {r.id: r.p for r in df.select("id", extract.request_parts(F.col("body")).alias("p")).collect()}
    assert got[0] == ["a", "b", "c"] and got[1] == got[2] == got[3] == []
    odd = ['{"messages":[{"content":{"parts":[1,"a",{"x":2}]}}]}', '{"messages":[{"content":{"parts":["a"]}},{"content":{"parts":7}}]}', '{"messages":null}', "[]", '{"messages":[null,{"content":{"parts":["b",null]}}]}']
    rows = spark.createDataFrame([(b,) for b in odd], "body string").select(extract.request_parts(F.col("body")).alias("p"), extract.response_parts(F.lit('{"message":{"content":{"parts":["r"]}}}')).alias("r")).collect()
    assert [r.p for r in rows] == [[], [], [], [], ["b", ""]] and rows[0].r == ["r"]
    mapped = df.withColumn("m", F.create_map(F.lit("a"), F.lit('x"\n')))
    out = {r.id: r.rewritten for r in extract.rewrite(mapped, "body", "m").collect()}
    assert out[0] == '{"model":"m","messages":[{"content":{"parts":["x\\"\\n","b"]}},{"content":{"parts":["c"]}}]}' and out[2] == "nonsense" and out[3] is None


def test_frames(spark):
    chunks = [("s", 0, "event: x\r\nda"), ("s", 1, "ta: one\n\ndata: two\ndata: three\n\nda"), ("t", 0, None)]
    got = sse.frames(spark.createDataFrame(chunks, "stream_id string, seq int, chunk string")).orderBy("frame_no").collect()
    assert [(r.frame_no, r.event, r.data) for r in got] == [(1, "x", "one"), (2, "", "two\nthree")]


PART = "/message/content/parts/0"


def test_document_limits():
    d = sse.Document()
    assert d.apply({"o": "add", "p": PART, "v": "ab"}) == "ab"
    assert d.apply({"o": "append", "p": PART, "v": "c"}) == "c"
    assert d.nodes[PART][:2] == ("text", "abc")
    assert d.apply({"o": "patch", "ops": [{"o": "replace", "p": PART, "v": "z"}, {"o": "add", "p": "/message/status", "v": "q"}, {"o": "patch", "ops": [{"o": "add", "p": PART, "v": "no"}]}]}) == "z"
    d.apply({"o": "append", "p": PART, "v": "x" * (sse.MOST_TEXT + 1)})
    assert d.degraded and d.apply({"o": "add", "p": "/message/content/parts/1", "v": "n"}) == ""
    assert sse.parse_path("/a~1b/~0") == ["a/b", "~"] and sse.parse_path("") == []
    for bad in ("/../x", "/$ref", "/a/@b", "x", "/" + "a" * 300, "/a" * 32, "/" + "é" * 200, "/a" * 300):
        d = sse.Document()
        assert d.apply({"o": "add", "p": bad, "v": "y"}) == "" and d.degraded, bad


def test_replaced_text_counts_by_its_difference():
    d = sse.Document()
    d.apply({"o": "add", "p": PART, "v": "x"})
    assert all(d.apply({"o": "replace", "p": PART, "v": c * 100_000}) == c * 100_000 for c in "abcdefghijklmnopqrst")
    assert d.size == 100_000 and not d.degraded
    assert d.apply({"o": "replace", "p": PART, "v": "é" * 600_000}) == "" and d.degraded  # limits are bytes


def test_paths_lead_through_lists_and_below_parts():
    d = sse.Document()
    assert sse.event_text(d, "input_message", '{"input_message":{"content":{"parts":["a",{"text":"b"},"c"]}}}') == "a c"
    assert d.apply({"o": "append", "p": "/message/content/parts/2", "v": "d"}) == "d" and d.nodes["/message/content/parts/2"][1] == "cd"
    assert d.apply({"o": "add", "p": "/message/content/parts/1/text", "v": "e"}) == "e"
    assert d.apply({"o": "add", "p": "/message/content/parts/5", "v": "far"}) == "far" and d.nodes["/message/content/parts"][2] == 6 and d.count == 4
    assert d.apply({"o": "add", "p": "/message/content/parts/", "v": "no"}) == "" and not d.degraded
    assert d.apply({"o": "add", "p": "/message/content", "v": {"parts": {"x": ["deep"]}}}) == "" and "/message/content/parts/2" not in d.nodes
    assert d.apply({"o": "append", "p": "/message/content/parts/x/0", "v": "er"}) == "er" and d.nodes["/message/content/parts/x/0"][1] == "deeper"
    for bad in ({"o": "append", "p": "/nowhere/0", "v": "x"}, {"o": "append", "p": "/message", "v": "x"}, {"o": "replace", "p": "", "v": "x"}, {"o": "add", "p": "/message/content/parts/x/-1", "v": "x"}, {"o": "add", "p": "/message/content/parts/x/0/y", "v": "x"}):
        other = sse.Document(dict(d.nodes))
        assert other.apply(bad) == "" and other.degraded, bad
    many = sse.Document()
    many.apply({"o": "add", "p": "/l", "v": []})
    many.apply({"o": "add", "p": "/l/10001", "v": "x"})
    assert many.degraded and sse.event_text(many, "input_message", '{"input_message":{"content":{"parts":["still"]}}}') == "still"


def test_types_of_events():
    said = lambda kind, body: sse.event_text(sse.Document(), kind, json.dumps(body))
    assert [said(k, {"v": "a@example.com"}) for k in ("delta_encoding", "resume_conversation_token", "message_marker", "title_generation", "")] == ["", "", "", "a@example.com", "a@example.com"]
    assert said("", {"p": PART, "v": "a@example.com"}) == f"{PART} a@example.com" and said("", {"o": 1, "v": "x"}) == "x"
    assert said("", {"type": "message_marker", "v": "x"}) == "" and said("other", {"type": "message_marker", "v": "x"}) == "message_marker x"
    assert said("input_message", {"type": "x", "input_message": {"content": {"parts": ["a", "b"]}}}) == "a b" and said("input_message", {"x": "y"}) == ""
    assert said("", ["x"]) == said("", "x") == said("", None) == sse.event_text(sse.Document(), "", "{") == ""


def test_stream_helpers():
    assert sse.cut_frames("a\r\n\r\nb\n\nc") == (["a", "b"], "c")
    assert hold_back("x <<EMA") == ("x ", "<<EMA") and hold_back("x <<EMAIL_1>> y") == ("x <<EMAIL_1>> y", "") and hold_back("x <") == ("x ", "<")
    assert hold_back("<<" + "a" * 5000)[1] == ""


def test_vault(spark):
    key, now = bytes(range(32)), F.expr("TIMESTAMP '2024-02-01 00:00:00'")
    day = datetime.datetime(2024, 1, 31)
    rows = [("p", "c1", "<<EMAIL_1>>", "EMAIL", "a@example.com", day), ("p", "c2", "<<EMAIL_1>>", "EMAIL", "b@example.com", datetime.datetime(2024, 1, 1)), ("p/q", "c3", "<<EMAIL_1>>", "EMAIL", "c", day)]
    mapping = spark.createDataFrame(rows, "provider string, conversation_id string, token string, type string, value string, at timestamp")
    store = vault.entries(mapping, key, F.col("at"))
    meta = vault.metadata(store)
    read = lambda c, hours, k=key, m=meta: [r.value for r in vault.conversation(store, m, k, "p", c, now, hours).collect()]
    assert store.count() == 2 and read("c1", 168) == ["a@example.com"] and read("c2", 168) == [] and read("c2", 0) == ["b@example.com"]
    assert read("c1", 0, bytes(32)) == [] and read("nobody", 0) == []
    # an entry that is young does not keep a conversation that is old
    young = vault.entries(spark.createDataFrame([("p", "c2", "<<EMAIL_2>>", "EMAIL", "new@example.com", day)], mapping.schema), key, F.col("at"))
    later = vault.upsert(store, young)
    assert vault.conversation(later, vault.merge_metadata(meta, young), key, "p", "c2", now, 168).count() == 0
    assert {r.conversation_id for r in vault.purge(later, vault.merge_metadata(meta, young), now, 168).collect()} == {"c1"}
    grown = {r.conversation_id: r for r in vault.merge_metadata(vault.with_labels(meta).withColumn("label", F.lit("x")), young).collect()}
    assert grown["c2"].pii_count == 2 and grown["c2"].created_at == datetime.datetime(2024, 1, 1) and grown["c2"].updated_at == day and grown["c2"].label == "x"
    assert vault.purge_all(store).count() == 0 and vault.delete(store, "p", "c1").count() == 1


def test_vault_files(spark, tmp_path):
    key, path = bytes(range(32)), str(tmp_path / "vault")
    row = lambda c, value, day: [("p", c, "<<EMAIL_1>>", "EMAIL", value, datetime.datetime(2024, 1, day))]
    sealed = lambda rows: vault.entries(spark.createDataFrame(rows, "provider string, conversation_id string, token string, type string, value string, at timestamp"), key, F.col("at"))
    files = store.Store(spark, path)
    assert files.read().count() == 0 and files.sweep(F.current_timestamp(), 168) == 0
    assert files.add(sealed(row("a", "old", 1) + row("b", "b", 1)), "s", 0)
    assert files.add(sealed(row("a", "new", 20)), "s", 1)
    assert not files.add(sealed(row("a", "other", 21)), "s", 1)  # the same batch again
    values = lambda: {r.conversation_id: r.v for r in files.read().select("conversation_id", vault.unseal(F.col("value"), key).alias("v")).collect()}
    assert values() == {"a": "new", "b": "b"}
    meta = {r.conversation_id: r for r in files.metadata().collect()}
    assert meta["a"].pii_count == 2 and meta["a"].created_at == datetime.datetime(2024, 1, 1) and meta["a"].updated_at == datetime.datetime(2024, 1, 20)
    files.compact()
    assert {r.conversation_id: r for r in files.metadata().collect()} == meta
    # a rewritten token does not make a conversation younger
    late = F.expr("TIMESTAMP '2024-01-21 00:00:00'")
    assert files.conversation(key, "p", "a", late, 720).collect() == [("<<EMAIL_1>>", "EMAIL", "new")] and files.conversation(key, "p", "a", late, 168).count() == 0
    assert files.sweep(late, 0) == 0 and files.sweep(late, 168, grace=0) == 2 and values() == {} and files.vacuum(0) == 0
    assert files.add(sealed(row("c", "c", 20)), "s", 2) and files.add(sealed(row("d", "d", 20))) and values() == {"c": "c", "d": "d"}
    files.remove("p", "c")
    assert values() == {"d": "d"}
    made = vault.load_key(str(tmp_path / "key"))
    assert len(made) == 32 and vault.load_key(str(tmp_path / "key")) == made
    (tmp_path / "open").write_bytes(made)
    with pytest.raises(ValueError):
        vault.load_key(str(tmp_path / "open"))
    vault.write(sealed(row("a", "x", 1)), str(tmp_path / "whole"))
    assert spark.read.parquet(str(tmp_path / "whole")).count() == 1


def test_policy(spark):
    hosts = spark.createDataFrame([("A.Example.com:443",), ("example.com.evil.org",), ("m.example.net",), ("bad host",), (None,)], "host string")
    table = spark.createDataFrame([("example.com", "a"), ("example.net", "b"), ("m.example.net", "c")], "domain string, provider string")
    got = {r.host: (r.provider, r.action) for r in policy.route(hosts, table).collect()}
    assert got == {"A.Example.com:443": ("a", "MITM"), "example.com.evil.org": ("unknown", "TUNNEL"), "m.example.net": ("c", "MITM"), "bad host": ("unknown", "TUNNEL"), None: ("unknown", "TUNNEL")}
    config = policy.Config(providers={"a": policy.Provider(("x.org",)), "b": policy.Provider(("x.org", "*.y")), " ": policy.Provider(("z.org",)), "off": policy.Provider((), False)}, ttl="5h")
    assert len(config.validate()) == 4 and policy.Config().merged(mode="enforce").mode == "enforce" and policy.Config().validate() == []
    script = policy.pac_script(["x.org", "y.net"], "127.0.0.1:1")
    assert all(f'host === "{d}" || host.endsWith(".{d}")' in script for d in ("x.org", "y.net")) and 'return "PROXY 127.0.0.1:1"' in script and 'return "DIRECT"' in script
    row = spark.range(1).select(policy.conversation_scope(F.lit("/c/0F0E0D0C-0000-0000-0000-000000000001"), F.lit("f")).alias("a"), F.sha2(F.lit("0f0e0d0c-0000-0000-0000-000000000001"), 256).alias("b"), policy.log_path(F.lit("é" * 300)).alias("c")).first()
    assert row.a == row.b and row.c == "é" * 256


def test_a_session_that_fails_goes_on_raw(monkeypatch):
    session = sse.Session()
    assert session.text("", '{"o":"add","p":"/message/content/parts/0","v":"a"}') == "a" and not session.degraded
    monkeypatch.setattr(sse, "event_text", lambda *_: 1 / 0)
    assert session.text("", "{}") == "{}" and session.degraded
    monkeypatch.undo()
    assert session.text("", '{"x":"y"}') == '{"x":"y"}'


def test_rewriter_flushes_what_it_holds():
    rewriter = sse.Rewriter({"<<EMAIL_1>>": "a@example.com"})
    assert rewriter.frame("id: 7\r\n\r\ndata:  x <<EMAIL_1>> <<EMA") == "id: 7\ndata: x a@example.com \n\n"
    assert rewriter.frame("data: IL_1>> <<PHONE_1>>") == "data: a@example.com <<PHONE_1>>\n\n" and rewriter.count == 2
    rewriter.frame("data: <<EM")
    assert rewriter.close() == "data: <<EM\n\n" and rewriter.close() == ""


SEALED = "provider string, conversation_id string, token string, type string, value string, at timestamp"


def test_what_comes_during_a_sweep_stays(spark, tmp_path):
    """Batches that are added, and sweeps that finish, while another sweep has read but not yet committed."""
    key, files = bytes(range(32)), store.Store(spark, str(tmp_path / "vault"))
    sealed = lambda c, day: vault.entries(spark.createDataFrame([("p", c, "<<EMAIL_1>>", "EMAIL", c, datetime.datetime(2024, 1, day))], SEALED), key, F.col("at"))
    files.add(sealed("old", 1), "s", 0)
    files.add(sealed("young", 20), "s", 1)
    snapshot = files.read()
    events = [lambda: (files.add(sealed("during", 20), "s", 2), files.compact()), lambda: files.add(sealed("later", 20), "s", 3)]  # the first makes the sweep start again

    def keep(entries):
        events.pop(0)()
        return entries.where("conversation_id <> 'old'")

    files._rewrite(keep)
    assert {r.conversation_id for r in files.read().collect()} == {"young", "during", "later"} and not events
    assert {r.conversation_id for r in snapshot.collect()} == {"old", "young"}  # readers keep what they began with
    assert not files.add(sealed("during", 21), "s", 2) and len(files.commits()[1]["folders"]) <= 2


def test_two_writers_never_take_one_number(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    key, path = bytes(range(32)), str(tmp_path / "vault")
    sealed = lambda c: vault.entries(spark.createDataFrame([("p", c, "<<EMAIL_1>>", "EMAIL", c, datetime.datetime(2024, 1, 1))], SEALED), key, F.col("at"))
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: store.Store(spark, path).add(sealed(f"c{k}"), f"s{k % 2}", k), range(8)))
    kept = {r.conversation_id for r in store.Store(spark, path).read().collect()}
    assert store.Store(spark, path).commits()[0] == len(kept)
    one, two = store.Store(spark, path)._at("commits", "x"), store.Store(spark, path)._at("commits", f"{1:012d}")
    store.Store(spark, path)._files().create(one, False).close()
    assert not store.Store(spark, path)._renamed(one, two)


def test_a_conversation_reads_one_bucket(spark, tmp_path):
    files = store.Store(spark, str(tmp_path / "vault"))
    rows = spark.range(200).selectExpr("'p' AS provider", "concat('c', id) AS conversation_id", "'<<EMAIL_1>>' AS token", "'EMAIL' AS type", "'v' AS value", "TIMESTAMP '2024-01-01' AS at")
    files.add(vault.entries(rows, bytes(32), F.col("at")))
    own = files.conversation(bytes(32), "p", "c7", F.expr("TIMESTAMP '2024-01-02'"), 168)
    assert [r.value for r in own.collect()] == ["v"]
    plan = own._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert scans and all(re.search(r"PartitionFilters: \[.*bucket.* = [0-9]+", line) for line in scans)


def test_configuration_files(tmp_path):
    from quillmask.plans.flows import CONFIG

    config = policy.parse_config(CONFIG)
    assert config.ttl_hours() == 24 and config.domains() == ["example.com"] and config.fails() == "fail_open" and config.scan_paths == policy.fixed.SCAN_PATHS and config.pii_logging is None
    (tmp_path / "base").write_text(CONFIG)
    (tmp_path / "over").write_text("agent: {mode: enforce, listen_port: 0, monitor: {scan_paths: [/x]}}\nlogging: {pii_logging: false}\nproviders: {beta: {enabled: true, domains: [B.example.net]}}")
    merged = policy.load_config(str(tmp_path / "base"), str(tmp_path / "over"))
    assert merged.mode == "enforce" and merged.listen_port == 8787 and merged.scan_paths == ("/x",) and merged.pii_logging is False and merged.ttl == "24h" and merged.domains() == ["b.example.net", "example.com"] and merged.fails() == "fail_closed"
    assert [round(policy.Config(ttl=t).sweep_every().total_seconds() / 3600, 3) for t in ("0", "24h", "168h", "720h")] == [1, 3.429, 24, 24]
    for bad in ("", "agent: {mode: no}", CONFIG.replace("24h", "25h"), CONFIG.replace("127.0.0.1", "8.8.8.8"), CONFIG.replace("monitor", "enforce, fail_mode: fail_open"), CONFIG.replace("[example.com]", "[example.com, EXAMPLE.com]"), CONFIG.replace("[example.com]", "[]"), CONFIG.replace("8787", "99999")):
        with pytest.raises(ValueError):
            policy.parse_config(bad)


def test_audit_sink(spark, tmp_path):
    from quillmask.operators import audit, detect

    rows = spark.createDataFrame([(1, "a@example.com", datetime.datetime(2024, 1, 2))], "id int, text string, ts timestamp")
    for _ in range(2):
        audit.sink(audit.records(detect.detect(rows), host="h.example").drop("text"), str(tmp_path / "audit"))
    got = spark.read.json(str(tmp_path / "audit")).collect()
    assert len(got) == 2 and got[0].result == "pii_found" and got[0].host == "h.example" and "a@example.com" not in str(got)
