"""Queries over whole flows: bodies scanned and restored, event streams rewritten, and the vault over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmask.functions import fixed
from quillmask.operators import audit, tokens
from quillmask.operators import detect as det
from quillmask.plans import policy
from quillmask.plans import scan as whole
from quillmask.plans.planted import _pick, _values
from quillmask.plans.queries import NOW, _writes
from quillmask.plans.registry import query, table
from quillmask.sources import extract, sse, vault

KEY = bytes(range(32))


def _chats(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")


# ---- bodies ------------------------------------------------------------------------------------------------------------
@query("json_typed_parts", """
SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN 2 WHEN 5 THEN 1 ELSE 0 END::BIGINT AS n, CASE turn % 6 WHEN 0 THEN 'a|' || role WHEN 5 THEN role ELSE '' END AS parts FROM conversations""")
def json_typed_parts(spark, sf_dir):
    """Requests with parts of the right type, and with numbers, objects or something else in their place."""
    bodies = F.array(
        F.concat(F.lit('{"messages":[{"content":{"parts":["a"]}},{"content":{"parts":["'), "role", F.lit('"]}}]}')),
        F.lit('{"messages":[{"content":{"parts":[1,"a",{"x":2}]}}]}'),
        F.lit('{"messages":[{"content":{"parts":["a"]}},{"content":{"parts":7}}]}'),
        F.lit('{"messages":{"content":{"parts":["a"]}}}'),
        F.lit('["a"]'),
        F.concat(F.lit('{"messages":[{"content":null},{"content":{"parts":["", null, "'), "role", F.lit('", "a\\u0000b"]}}, null]}')),
    )
    found = extract.valid_segments(extract.request_parts(F.get(bodies, F.col("turn").cast("int") % 6)))
    return _chats(spark, sf_dir).select("conv_id", "turn", F.size(found).cast("long").alias("n"), F.array_join(found, "|").alias("parts"))


@query("response_parts", "SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN role || '|x' WHEN 3 THEN '' ELSE '' END AS parts FROM conversations")
def response_parts(spark, sf_dir):
    bodies = F.array(
        F.concat(F.lit('{"id":1,"message":{"content":{"parts":["'), "role", F.lit('","x"],"type":"t"}}}')),
        F.lit('{"message":{"content":{"parts":[true]}}}'),
        F.lit('{"message":null}'),
        F.lit("{broken"),
    )
    return _chats(spark, sf_dir).select("conv_id", "turn", F.array_join(extract.response_parts(F.get(bodies, F.col("turn").cast("int") % 4)), "|").alias("parts"))


def _requests(spark, sf_dir) -> DataFrame:
    """Four kinds of requests: a provider's, another JSON body, a path and a type that are not scanned."""
    k, mail = F.col("turn") % 4, F.concat(F.lit("user"), (F.col("turn") % 3).cast("string"), F.lit("@example.org"))
    path = F.when(k == 0, "/backend-api/f/conversation").when(k == 2, "/static/app.js").otherwise("/v1/messages")
    body = F.when(k == 0, F.concat(F.lit('{"model":"m","messages":[{"content":{"parts":["mail '), mail, F.lit('","plain"]}}],"note":"mail '), mail, F.lit('"}'))).otherwise(F.concat(F.lit('{"q":"mail '), mail, F.lit('"}')))
    return _chats(spark, sf_dir).select("conv_id", "turn", path.alias("path"), F.when(k == 3, "image/png").otherwise("application/json").alias("content_type"), body.alias("body"))


_MAIL = "'user' || (turn % 3) || '@example.org'"
_TOKENS = f"n AS (SELECT conv_id, {_MAIL} AS value, '<<EMAIL_' || row_number() OVER (PARTITION BY conv_id ORDER BY min(turn)) || '>>' AS token FROM conversations WHERE turn % 4 < 2 GROUP BY conv_id, value)"


@query("scan_bodies", f"""
WITH {_TOKENS}
SELECT c.conv_id, turn, CASE turn % 4 WHEN 0 THEN '{{"model":"m","messages":[{{"content":{{"parts":["mail ' || token || '","plain"]}}}}],"note":"mail ' || {_MAIL} || '"}}' WHEN 1 THEN '{{"q":"mail ' || token || '"}}' ELSE '{{"q":"mail ' || {_MAIL} || '"}}' END AS rewritten
FROM conversations c LEFT JOIN n ON n.conv_id = c.conv_id AND n.value = {_MAIL}""")
def scan_bodies(spark, sf_dir):
    return whole.scan(_requests(spark, sf_dir), ["conv_id"], ["turn"]).rows.select("conv_id", "turn", "rewritten")


@query("scan_audit", f"""
SELECT conv_id, turn, CASE WHEN turn % 4 < 2 THEN 'pii_found' ELSE 'unscanned' END AS result, CASE WHEN turn % 4 < 2 THEN 1 ELSE 0 END AS entity_count, CASE WHEN turn % 4 < 2 THEN 1 ELSE 0 END::BIGINT AS tokenized_count,
CASE WHEN turn % 4 = 0 THEN 81 + 2 * strlen({_MAIL}) ELSE 13 + strlen({_MAIL}) END::INT AS bytes_analyzed FROM conversations""")
def scan_audit(spark, sf_dir):
    return whole.scan(_requests(spark, sf_dir), ["conv_id"], ["turn"]).audit.select("conv_id", "turn", "result", "entity_count", "tokenized_count", "bytes_analyzed")


@query("scan_monitor", "SELECT conv_id, turn, 0::BIGINT AS tokenized_count, true AS same, CASE WHEN turn % 4 < 2 THEN '{\"EMAIL\":1}' END AS entity_summary FROM conversations")
def scan_monitor(spark, sf_dir):
    """Monitoring leaves bodies as they are."""
    found = whole.scan(_requests(spark, sf_dir), ["conv_id"], ["turn"], mode="monitor", pii_logging=True)
    same = found.rows.select("conv_id", "turn", (F.col("rewritten") == F.col("body")).alias("same"))
    return found.audit.select("conv_id", "turn", "tokenized_count", F.to_json("entity_summary").alias("entity_summary")).join(same, ["conv_id", "turn"])


@query("restore_bodies", f"""
WITH {_TOKENS}, r AS (SELECT c.conv_id, turn, a.value AS first, b.value AS second FROM conversations c LEFT JOIN n a ON a.conv_id = c.conv_id AND a.token = '<<EMAIL_1>>' LEFT JOIN n b ON b.conv_id = c.conv_id AND b.token = '<<EMAIL_2>>')
SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '{{"message":{{"content":{{"parts":["to ' || coalesce(first, '<<EMAIL_1>>') || '"]}}}},"x":"' || coalesce(second, '<<EMAIL_2>>') || ' <<EMAIL_99>>"}}' ELSE 'see <<EMAIL_1>>' END AS rewritten,
CASE WHEN turn % 2 = 0 THEN (first IS NOT NULL)::INT + (second IS NOT NULL)::INT ELSE 0 END::BIGINT AS rehydrated_count FROM r""")
def restore_bodies(spark, sf_dir):
    """Responses with a conversation's tokens, known and unknown ones; every second has a type that is not touched."""
    mapping = whole.scan(_requests(spark, sf_dir), ["conv_id"], ["turn"]).mapping
    even = F.col("turn") % 2 == 0
    body = F.when(even, '{"message":{"content":{"parts":["to <<EMAIL_1>>"]}},"x":"<<EMAIL_2>> <<EMAIL_99>>"}').otherwise("see <<EMAIL_1>>")
    responses = _chats(spark, sf_dir).select("conv_id", "turn", F.lit("/backend-api/f/conversation").alias("path"), F.when(even, "application/json").otherwise("image/png").alias("content_type"), body.alias("body"))
    return whole.restore(responses, mapping, ["conv_id"], ["turn"]).rows.select("conv_id", "turn", "rewritten", "rehydrated_count")


@query("token_reuse", f"""
WITH v AS (SELECT conv_id, turn, 'user' || (turn * 7 % 5) || '@example.org' AS value FROM conversations),
k AS (SELECT conv_id, value, row_number() OVER (PARTITION BY conv_id ORDER BY min(turn)) AS n FROM v WHERE turn < 2 GROUP BY conv_id, value),
w AS (SELECT v.conv_id, v.value, row_number() OVER (PARTITION BY v.conv_id ORDER BY min(turn)) AS n FROM v ANTI JOIN k ON k.conv_id = v.conv_id AND k.value = v.value GROUP BY v.conv_id, v.value)
SELECT conv_id, value, n, '<<EMAIL_' || n || '>>' AS token FROM (SELECT * FROM k UNION ALL SELECT w.conv_id, w.value, w.n + coalesce(m, 0) FROM w LEFT JOIN (SELECT conv_id, max(n) AS m FROM k GROUP BY conv_id) t USING (conv_id))""")
def token_reuse(spark, sf_dir):
    """The first two turns' tokens are known; later values count on from them."""
    text = F.concat(F.lit("mail user"), (F.col("turn") * 7 % 5).cast("string"), F.lit("@example.org"))
    found = det.detect(_chats(spark, sf_dir).select("conv_id", "turn", text.alias("text")), only=("email",))
    known = tokens.tokenize(found.where("turn < 2"), ["conv_id"], ["turn"])[1]
    return tokens.tokenize(found.where("turn >= 2"), ["conv_id"], ["turn"], known=known)[1].select("conv_id", "value", "n", "token")


# ---- event streams -----------------------------------------------------------------------------------------------------
@query("sse_fields", """
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END AS event, 'v ' || event_id || CASE WHEN event_id % 3 = 0 THEN chr(10) || 'more' ELSE '' END AS data, event_id::VARCHAR AS id,
CASE WHEN event_id % 4 = 0 THEN event_id ELSE -1 END AS retry, CASE WHEN event_id % 5 = 0 THEN 'note' ELSE '' END AS comments FROM events""")
def sse_fields(spark, sf_dir):
    k, key = F.col("event_id"), F.col("event_id").cast("string")
    frame = F.concat(
        F.when(k % 2 == 0, F.concat(F.lit("event: old\nevent:  "), "event_type", F.lit("\n"))).otherwise(""), F.lit("data: v "), key, F.lit("\n"), F.when(k % 3 == 0, "data:more \n").otherwise(""),
        F.lit("id: "), key, F.lit("\nretry: "), F.when(k % 4 == 0, key).otherwise("soon"), F.when(k % 5 == 0, "\n: note").otherwise(""),
    )
    f = sse.fields(frame)
    return table(spark, sf_dir, "events").select("event_id", f["event"].alias("event"), f["data"].alias("data"), f["id"].alias("id"), F.coalesce(f["retry"], F.lit(-1)).alias("retry"), F.array_join(f["comments"], "|").alias("comments"))


def _token_chunks(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(stream_id, seq, chunk) of eleven characters each, so that tokens are split; (stream_id, token, value)."""
    frame = F.concat(F.lit("event: t\r\ndata:   hi <<EMAIL_"), (F.col("turn") % 2 + 1).cast("string"), F.lit(">> and <<EMAIL_9>>\r\n\r\n"))
    text = _chats(spark, sf_dir).groupBy(F.col("conv_id").alias("stream_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", frame.alias("f")))), lambda x: x["f"]), "").alias("t"))
    text = text.withColumn("t", F.concat("t", F.lit("data: tail <<EMAIL_1>>")))
    cut = F.transform(F.sequence(F.lit(0), F.ceil(F.length("t") / 11).cast("int") - 1), lambda k: F.substring(F.col("t"), k * 11 + 1, F.lit(11)))
    chunks = text.select("stream_id", F.posexplode(cut).alias("seq", "chunk"))
    known = F.explode(F.array(*(F.struct(F.lit(f"<<EMAIL_{k}>>").alias("token"), F.lit(f"user{k}@example.org").alias("value")) for k in (1, 2)))).alias("e")
    mapping = text.select("stream_id", known).select("stream_id", "e.*")
    return chunks, mapping


@query("sse_rewrite", """
WITH s AS (SELECT conv_id, string_agg('event: t' || chr(10) || 'data: hi user' || (turn % 2 + 1) || '@example.org and <<EMAIL_9>>' || chr(10) || chr(10), '' ORDER BY turn) AS body, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT conv_id AS stream_id, body || 'data: tail <<EMAIL_1>>' AS body, n AS restored FROM s""")
def sse_rewrite(spark, sf_dir):
    """Streams in chunks of eleven characters; what follows the last frame is not touched."""
    return sse.rewrite_streams(*_token_chunks(spark, sf_dir))


@query("stream_until_done", "SELECT conv_id AS stream_id, count(*) AS frames, count(*)::BIGINT AS entity_count, sum(strlen('mail user' || turn || '@example.org'))::BIGINT AS bytes FROM conversations WHERE turn < 3 GROUP BY conv_id")
def stream_until_done(spark, sf_dir):
    """The fourth event ends a stream; what comes after it does not count."""
    text = F.when(F.col("turn") == 3, " [DONE] ").otherwise(F.concat(F.lit("mail user"), F.col("turn").cast("string"), F.lit("@example.org")))
    found = det.detect(_chats(spark, sf_dir).select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("frame_no"), text.alias("data")), "data", only=("email",))
    return audit.stream_totals(found)


@query("patch_events", """
WITH e AS (SELECT conv_id, turn, CASE CASE WHEN turn = 0 THEN 0 ELSE 1 + (conv_id + turn) % 12 END WHEN 0 THEN 'a' || turn WHEN 1 THEN 'p' || turn WHEN 2 THEN 'r' || turn WHEN 3 THEN 'x' || turn || 'y' WHEN 4 THEN 'in' || turn || ' ok' WHEN 6 THEN 'raw ' || turn || ' more'
  WHEN 7 THEN 'of ' || turn WHEN 8 THEN '/message/content/parts/0 v' || turn WHEN 9 THEN 'd' || turn ELSE '' END AS t FROM conversations)
SELECT conv_id AS stream_id, string_agg(t, '/' ORDER BY turn) AS text FROM e GROUP BY conv_id""")
def patch_events(spark, sf_dir):
    """Operations, batches, deeper paths, input messages whose frame says so, silent types, plain events, and what brings nothing."""
    t, at = F.col("turn").cast("string"), '"p":"/message/content/parts/'
    cases = (
        ("delta", '{"o":"add",' + at + '0","v":"a@"}'),
        ("delta", '{"o":"append",' + at + '0","v":"p@"}'),
        ("", '{"o":"replace",' + at + '0","v":"r@"}'),
        ("delta", '{"o":"patch","ops":[{"o":"append",' + at + '0","v":"x@"},{"o":"add","p":"/message/status","v":"no"},{"o":"append",' + at + '0","v":"y"},{"o":"move",' + at + '0","v":"no"}]}'),
        ("input_message", '{"type":"message_marker","input_message":{"content":{"parts":["in@",3,"ok"]}}}'),
        ("", '{"type":"message_marker","marker":"no"}'),
        ("", '{"kind":{"z":["raw @"]},"n":1,"y":"more"}'),
        ("title_generation", '{"title":"of @"}'),
        ("", '{' + at + '0","v":"v@"}'),
        ("delta", '{"o":"patch","ops":[{"o":"add",' + at + '1","v":{"text":"m"}},{"o":"add",' + at + '1/text","v":"d@"}]}'),
        ("delta_encoding", '{"v":"no"}'),
        ("", '["no"]'),
        ("delta", '{"o":"move",' + at + '0","v":"no"}'),
    )
    case = F.when(F.col("turn") == 0, 0).otherwise(1 + (F.col("conv_id") + F.col("turn")) % 12).cast("int")
    pick = lambda k: F.get(F.array(*(F.lit(c[k]) for c in cases)), case)
    events = _chats(spark, sf_dir).select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("frame_no"), pick(0).alias("event"), F.replace(pick(1), F.lit("@"), t).alias("data"))
    folded = sse.patch_text(events).groupBy("stream_id").agg(F.sort_array(F.collect_list(F.struct("frame_no", "text"))).alias("l"))
    return folded.select("stream_id", F.array_join(F.transform("l", lambda x: x["text"]), "/").alias("text"))


# ---- vault -------------------------------------------------------------------------------------------------------------
@query("vault_conversation", f"""
WITH f AS (SELECT user_id FROM events GROUP BY user_id HAVING NOT min(ts) + INTERVAL 168 HOURS < {NOW})
SELECT '<<' || upper(event_type) || '_' || event_id || '>>' AS token, props AS value FROM events WHERE user_id = (SELECT min(user_id) FROM f)""")
def vault_conversation(spark, sf_dir):
    """All entries of the smallest user that has not expired, and of the smallest user of all: nothing if that one has expired, however young an entry is."""
    writes = _writes(spark, sf_dir)
    store, meta, now = vault.entries(writes, KEY, F.col("created_at")), vault.metadata(writes), F.expr(NOW)
    alive = vault.active(meta, now, 168).agg(F.min(F.col("conversation_id").cast("long"))).first()[0]
    first = meta.agg(F.min(F.col("conversation_id").cast("long"))).first()[0]
    read = [vault.conversation(store, meta, KEY, "alpha", str(c), now, 168) for c in {alive, first}]
    out = read[0] if len(read) == 1 else read[0].union(read[1])
    return out.select("token", "value")


@query("vault_put", "SELECT user_id::VARCHAR AS conversation_id, count(*) AS pii_count, array_to_string(list_sort(list(DISTINCT upper(event_type))), ',') AS pii_types, min(ts) AS created_at, max(ts) AS updated_at, count(DISTINCT event_id) AS entries FROM events GROUP BY user_id")
def vault_put(spark, sf_dir):
    """Two batches written one after the other: entries and metadata follow from the same writes."""
    writes = _writes(spark, sf_dir).withColumn("odd", F.regexp_extract("token", "_([0-9]+)>>$", 1).cast("long") % 2)
    empty = vault.entries(writes.limit(0), KEY, F.col("created_at"))
    store, meta = empty, vault.metadata(empty)
    for odd in (0, 1):
        store, meta = vault.put(store, meta, writes.where(f"odd = {odd}").drop("odd"), KEY, F.col("created_at"))
    n = store.groupBy("provider", "conversation_id").agg(F.count(F.lit(1)).alias("entries"))
    return meta.join(n, ["provider", "conversation_id"]).select("conversation_id", "pii_count", F.array_join("pii_types", ",").alias("pii_types"), "created_at", "updated_at", "entries")


@query("vault_labels", "SELECT user_id::VARCHAR AS conversation_id, CASE WHEN user_id % 2 = 0 THEN 'kept' END AS label, CASE WHEN user_id % 2 = 0 THEN 0 ELSE count(*) END AS pii_count FROM events GROUP BY user_id")
def vault_labels(spark, sf_dir):
    """Metadata of every second conversation replaced as a whole."""
    meta = vault.with_labels(vault.metadata(_writes(spark, sf_dir)))
    changes = meta.where("conversation_id % 2 = 0").withColumn("label", F.lit("kept")).withColumn("pii_count", F.lit(0).cast("long"))
    return vault.update_metadata(meta, changes).select("conversation_id", "label", "pii_count")


@query("vault_delete", "SELECT user_id::VARCHAR AS conversation_id, count(*) AS n, 0::BIGINT AS after_purge FROM events WHERE user_id <> (SELECT min(user_id) FROM events) GROUP BY user_id")
def vault_delete(spark, sf_dir):
    """One conversation deleted; and how many entries are left after a purge of all."""
    writes = _writes(spark, sf_dir)
    first = writes.agg(F.min(F.col("conversation_id").cast("long"))).first()[0]
    left = vault.delete(writes, "alpha", str(first)).groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n"))
    return left.withColumn("after_purge", F.lit(vault.purge_all(writes).count()).cast("long"))


@query("vault_refuses_slashes", "SELECT count(*) AS n FROM events WHERE event_id % 3 > 0")
def vault_refuses_slashes(spark, sf_dir):
    writes = _writes(spark, sf_dir).withColumn("provider", F.when(F.regexp_extract("token", "_([0-9]+)>>$", 1).cast("long") % 3 == 0, "al/pha").otherwise("alpha"))
    return vault.entries(writes, KEY, F.col("created_at")).agg(F.count(F.lit(1)).alias("n"))


# ---- guards ------------------------------------------------------------------------------------------------------------
HOSTS = (("A.Example.COM:443", "a.example.com"), ("example.com", "example.com"), ("[::1]:8080", "::1"), ("[FE80::1]", "fe80::1"), ("bad host", ""), ("tab\there", ""), ("hé.example", ""), ("x.org:", "x.org"), ("", ""))


@query("clean_hosts", f"SELECT page_id, clean FROM pages JOIN {_values([(k, c) for k, (_, c) in enumerate(HOSTS)], 'k, clean')} ON k = page_id % {len(HOSTS)}")
def clean_hosts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", policy.clean_host(_pick([h for h, _ in HOSTS], F.col("page_id") % len(HOSTS))).alias("clean"))


@query("domain_anti_join", "SELECT page_id FROM pages WHERE NOT regexp_matches(lower(url), '^[a-z]+://([^/:?#]+[.])?example[.]com([/:?#]|$)')")
def domain_anti_join(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-zA-Z]+://([^/?#]+)", 1).alias("host"))
    return policy.is_ai_domain(pages, spark.createDataFrame([("Example.com",)], "domain string"), keep=False).select("page_id")


@query("log_fields", """
SELECT event_id, left(repeat('/' || event_type, 1 + event_id % 90), 512) AS path, regexp_replace(left(event_type || chr(7) || repeat('e', event_id % 200), 128), '[^ -~]', '', 'g') AS event, CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END AS text FROM events""")
def log_fields(spark, sf_dir):
    k = F.col("event_id")
    path = policy.log_path(F.repeat(F.concat(F.lit("/"), "event_type"), (k % 90 + 1).cast("int")))
    event = policy.event_type(F.concat("event_type", F.lit("\x07"), F.repeat(F.lit("e"), (k % 200).cast("int"))))
    text = extract.valid_text(F.when(k % 2 == 0, F.col("event_type")).otherwise(F.lit(bytearray(b"a\xff")).cast("string")))
    return table(spark, sf_dir, "events").select("event_id", path.alias("path"), event.alias("event"), text.alias("text"))


CONFIG = """
agent: {listen_addr: 127.0.0.1, listen_port: 8787, mode: monitor, vault: {ttl: 24h}}
tls: {ca_validity_years: 10, ca_key_algorithm: ECDSA_P256, upstream_validation: system}
providers:
  alpha: {enabled: true, domains: [example.com]}
  beta: {enabled: false, domains: [example.net]}
"""


@query("config_domains", "SELECT page_id, regexp_matches(lower(url), '^[a-z]+://([^/:?#]+[.])?example[.](com|org)([/:?#]|$)') AS known FROM pages")
def config_domains(spark, sf_dir):
    """Domains of a configuration with an override on top; disabled providers do not count."""
    import tempfile

    with tempfile.TemporaryDirectory() as folder:  # driver only
        for name, text in (("base", CONFIG), ("more", "providers: {gamma: {enabled: true, domains: [Example.org]}}")):
            with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
                f.write(text)
        config = policy.load_config(f"{folder}/base", f"{folder}/more")
    domains = spark.createDataFrame([(d,) for d in config.domains()], "domain string")
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-zA-Z]+://([^/?#]+)", 1).alias("host"))
    known = policy.is_ai_domain(pages, domains).select("page_id", F.lit(True).alias("known"))
    return pages.join(known, "page_id", "left").select("page_id", F.coalesce("known", F.lit(False)).alias("known"))


@query("flow_bodies", f"""
WITH l AS (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 50)
SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS ring_id, md5(CASE WHEN event_id % 2 = 0 THEN repeat('x', {fixed.RING_BODY}) || '...[truncated]' ELSE event_type END) AS body FROM l""")
def flow_bodies(spark, sf_dir):
    body = F.when(F.col("event_id") % 2 == 0, F.repeat(F.lit("x"), fixed.RING_BODY + 1)).otherwise(F.col("event_type"))
    ring = audit.ring(table(spark, sf_dir, "events").select("event_id", "ts", body.alias("body")), ["ts", "event_id"], bodies=("body",))
    return ring.select("event_id", "ring_id", F.md5("body").alias("body"))
