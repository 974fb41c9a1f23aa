"""Registered queries over the tables, each with the same result said in SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmask.functions import checks, fixed
from quillmask.functions.spans import ENTITY, hold, locate, resolve_overlaps
from quillmask.operators import audit, detect as det, tokens
from quillmask.plans import policy
from quillmask.plans.registry import QUERIES, SQL, query, table as _t
from quillmask.sources import extract, sse, vault
from quillmask.streaming.streams import windowed_counts

NOW = "TIMESTAMP '2024-01-08 06:48:00'"
PROVIDERS = (("example.com", "alpha"), ("example.net", "beta"), ("m.example.net", "gamma"), ("ththre.example.com", "delta"))


def _docs(spark, sf_dir, suffix: str | None = None) -> DataFrame:
    docs = _t(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    return docs if suffix is None else docs.withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.expr(suffix)))


def _scan(df: DataFrame, only: tuple[str, ...] | None = None) -> DataFrame:
    """Registered queries scan texts of any size."""
    return det.detect(df, only=only, limit=det.WHOLE)


def _count(scanned: DataFrame, kind: str) -> DataFrame:
    own = F.filter("raw_entities", lambda e: e["type"] == kind)
    score = F.round(F.aggregate(own, F.lit(0.0), lambda a, e: a + e["confidence"]), 4)
    size = F.aggregate(own, F.lit(0), lambda a, e: a + e["end"] - e["start"])
    return scanned.select("doc_id", F.size(own).cast("long").alias("n"), score.alias("score"), size.cast("long").alias("n_bytes"))


# ---- detection ---------------------------------------------------------------------------------------------------
_TLD = ", ".join(f"'{t}'" for t in fixed.TLDS)
_LEFT = "[" + fixed.LOCAL.replace("'", "''") + "]"
_MAIL = f"@?{_LEFT}+@[a-zA-Z0-9](?:[a-zA-Z0-9-]{{0,61}}[a-zA-Z0-9])?(?:\\.[a-zA-Z0-9](?:[a-zA-Z0-9-]{{0,61}}[a-zA-Z0-9])?)*\\.[a-zA-Z]{{2,}}[A-Za-z0-9.@-]?"
_GOOD = "NOT starts_with(m, '@') AND NOT regexp_matches(m, '[0-9.@-]$') AND lower(split_part(split_part(m, '@', 1), '+', 1)) NOT IN ('noreply', 'no-reply', 'mailer-daemon', 'root') AND NOT contains(m, '..') AND strlen(split_part(m, '@', 1)) <= 64"


@query("detect_email", f"""
WITH d AS (SELECT doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '{_MAIL}'), lambda m: {_GOOD}) AS l FROM documents)
SELECT doc_id, len(l)::BIGINT AS n, round(coalesce(list_sum(list_transform(l, lambda m: CASE WHEN lower(regexp_extract(m, '[a-zA-Z]+$')) IN ({_TLD}) THEN 0.95 ELSE 0.9 END)), 0)::DOUBLE, 4) AS score,
coalesce(list_sum(list_transform(l, lambda m: strlen(m))), 0)::BIGINT AS n_bytes FROM d""")
def detect_email(spark, sf_dir):
    return _count(_scan(_docs(spark, sf_dir), only=("email",)), "EMAIL")


def _spans(pattern: str) -> str:
    """Matches of a pattern in each text with the byte they start at."""
    p = pattern.replace("++", "+").replace("'", "''")  # nothing follows the possessive repeat
    hits = f"SELECT doc_id, string_split_regex(text, '{p}') AS g, regexp_extract_all(text, '{p}') AS h FROM t"
    at = "list_sum(list_transform(g[1:i], lambda x: strlen(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: strlen(x))), 0)"
    return f"SELECT doc_id, unnest(list_transform(range(1, len(h) + 1), lambda i: {{'s': {at}, 'v': h[i]}})) AS m FROM ({hits})"


_RUNS = "|".join(f"{a}{a + 1}{a + 2}|{a + 2}{a + 1}{a}" for a in range(8))


@query("detect_phone", f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({' UNION '.join(map(_spans, fixed.PHONES))}),
d AS (SELECT doc_id, m.v AS v, regexp_replace(m.v, '[^0-9]', '', 'g') AS d FROM m),
s AS (SELECT doc_id, v, CASE WHEN length(d) NOT BETWEEN 7 AND 15 THEN 0 WHEN length(replace(d, d[1], '')) = 0 THEN 0.55 WHEN regexp_matches(d, '{_RUNS}') THEN 0.6 ELSE 0.85 END AS score FROM d)
SELECT t.doc_id, count(s.v) AS n, round(coalesce(sum(score), 0)::DOUBLE, 4) AS score, coalesce(sum(strlen(v)), 0)::BIGINT AS n_bytes FROM t LEFT JOIN s ON s.doc_id = t.doc_id AND score > 0 GROUP BY t.doc_id""")
def detect_phone(spark, sf_dir):
    return _count(_scan(_docs(spark, sf_dir), only=("phone",)), "PHONE")


_LUHN = "list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN (length(d) - i) % 2 = 1 THEN (d[i]::INT * 2) // 10 + (d[i]::INT * 2) % 10 ELSE d[i]::INT END)) % 10 = 0"


@query("detect_card", rf"""
WITH m AS (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(coalesce(text, ''), '\b[0-9][0-9 .-]{{11,}}[0-9]\b')), '[^0-9]', '', 'g') AS d FROM documents),
g AS (SELECT doc_id, d FROM m WHERE {' OR '.join(f"(length(d) BETWEEN {a} AND {b} AND regexp_matches(d, '^(?:{p})'))" for p, a, b in fixed.ISSUERS)})
SELECT doc_id, d AS number, CASE WHEN {_LUHN} THEN 0.95 ELSE 0.85 END::DOUBLE AS confidence, count(*) AS n FROM g GROUP BY ALL""")
def detect_card(spark, sf_dir):
    found = det.rows(_scan(_docs(spark, sf_dir), only=("card",)), ["doc_id"], "raw_entities")
    return found.groupBy("doc_id", checks.digits(F.col("value")).alias("number"), "confidence").agg(F.count(F.lit(1)).alias("n"))


@query("detect_secret_entropy")
def detect_secret_entropy(spark, sf_dir):
    return _count(_scan(_docs(spark, sf_dir), only=("secret_entropy",)), "SECRET")


@query("luhn_check", f"SELECT o_orderkey, {_LUHN} AS ok FROM (SELECT o_orderkey, (1000 + o_orderkey * 7919)::VARCHAR AS d FROM orders)")
def luhn_check(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", checks.luhn_ok((F.lit(1000) + F.col("o_orderkey") * 7919).cast("string")).alias("ok"))


@query("mod97_check", "SELECT c_custkey, (lpad((c_custkey * 7919)::VARCHAR, 18, '0') || '131400')::HUGEINT % 97 + 97 * 0 + lpad((c_custkey % 97)::VARCHAR, 2, '0')::INT IN (1, 98) AS ok FROM customer")
def mod97_check(spark, sf_dir):
    iban = F.concat(F.lit("DE"), F.lpad((F.col("c_custkey") % 97).cast("string"), 2, "0"), F.lpad((F.col("c_custkey") * 7919).cast("string"), 18, "0"))
    return _t(spark, sf_dir, "customer").select("c_custkey", checks.mod97_ok(iban).alias("ok"))


@query("entropy_score", """
WITH h AS (SELECT c_custkey, md5(c_name) AS s FROM customer), c AS (SELECT c_custkey, x, count(*) AS k FROM (SELECT c_custkey, unnest(string_split(s, '')) AS x FROM h) GROUP BY ALL)
SELECT c_custkey, round(-sum(k / 32.0 * log2(floor(k * 256 / 32) / 256)), 6)::DOUBLE AS h FROM c GROUP BY c_custkey""")
def entropy_score(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", F.round(checks.entropy(F.md5("c_name")), 6).alias("h"))


@query("infer_names", """
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Anna ' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) WHEN c_custkey % 3 = 1 THEN 'J ' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) END AS name,
CASE WHEN c_custkey % 3 = 0 THEN 0.7 WHEN c_custkey % 3 = 1 THEN 0.55 END::DOUBLE AS confidence FROM customer""")
def infer_names(spark, sf_dir):
    local = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("anna."), "c_mktsegment", F.lit("+x"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("j_"), "c_mktsegment")).otherwise(F.lit("info"))
    found = det.infer_name(F.concat(local, F.lit("@example.org")))
    return _t(spark, sf_dir, "customer").select("c_custkey", found["name"].alias("name"), found["confidence"].alias("confidence"))


@query("overlap_resolve", """
WITH e AS (SELECT o_orderkey, [{'s': (o_orderkey % 7)::INT, 'e': (o_orderkey % 7 + 5)::INT, 'c': 0.8, 'r': 0}, {'s': (o_orderkey % 5)::INT, 'e': (o_orderkey % 5 + 9)::INT, 'c': 0.9, 'r': 1}, {'s': 12, 'e': 20, 'c': 0.9, 'r': 2}] AS l FROM orders),
f AS (SELECT o_orderkey, list_transform(list_sort(list_transform(l, lambda x: {'s': x.s, 'm': -x.e, 'e': x.e, 'c': x.c, 'r': x.r})), lambda x: [{'s': x.s, 'e': x.e, 'c': x.c, 'r': x.r}]) AS l FROM e),
k AS (SELECT o_orderkey, list_reduce(l, lambda k, x: CASE WHEN k[-1].e <= x[1].s THEN k || x WHEN (k[-1].c > x[1].c) OR (k[-1].c = x[1].c AND k[-1].r <= x[1].r) THEN k ELSE k[:-2] || x END) AS l FROM f)
SELECT o_orderkey, array_to_string(list_transform(l, lambda x: x.s || '-' || x.e || ':' || x.r), ',') AS kept FROM k""")
def overlap_resolve(spark, sf_dir):
    kinds = ("EMAIL", "PHONE", "IBAN")

    def own(r, start, size, score):
        at = F.expr(start).cast("int")
        return F.struct(F.lit(kinds[r]).alias("type"), F.lit("regex").alias("source"), F.lit(score).alias("confidence"), at.alias("start"), (at + size).alias("end"), F.lit("v").alias("value"), F.lit(r).alias("ord"))

    every = F.array(own(0, "o_orderkey % 7", 5, 0.8), own(1, "o_orderkey % 5", 9, 0.9), own(2, "12", 8, 0.9)).cast(f"array<{ENTITY}>")
    kept = hold(_t(spark, sf_dir, "orders").select("o_orderkey"), "k", all=resolve_overlaps(every, fixed.TYPES))
    return kept.select("o_orderkey", F.array_join(F.transform(F.col("k")["all"], lambda e: F.concat(e["start"].cast("string"), F.lit("-"), e["end"].cast("string"), F.lit(":"), e["ord"].cast("string"))), ",").alias("kept"))


@query("entity_rollup")
def entity_rollup(spark, sf_dir):
    """All recognizers over all documents: entities and their mean score by source and type."""
    found = det.rows(_scan(_docs(spark, sf_dir)), ["source"])
    return found.groupBy("source", "type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 4).alias("confidence"))


@query("audit_records")
def audit_records(spark, sf_dir):
    out = audit.records(_scan(_docs(spark, sf_dir)), direction="request")
    return out.select("doc_id", "status", "result", "bytes_analyzed", "entity_count", F.to_json("entity_summary").alias("entity_summary"), "direction")


@query("doc_result_label")
def doc_result_label(spark, sf_dir):
    scanned = _scan(_docs(spark, sf_dir))
    return scanned.groupBy(audit.label(F.col("entities"), F.col("status")).alias("result")).agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("entities")).cast("long").alias("entities"))


@query("entity_grouping_sets")
def entity_grouping_sets(spark, sf_dir):
    return audit.rollup(det.rows(_scan(_docs(spark, sf_dir)), ["lang", "source"]), "lang", "source")


@query("email_grouping_sets", f"""
WITH d AS (SELECT lang, source, unnest(list_filter(regexp_extract_all(coalesce(text, ''), '{_MAIL}'), lambda m: {_GOOD})) AS m FROM documents) SELECT lang, source, count(*) AS n FROM d GROUP BY ROLLUP (lang, source)""")
def email_grouping_sets(spark, sf_dir):
    return audit.rollup(det.rows(_scan(_docs(spark, sf_dir), only=("email",)), ["lang", "source"], "raw_entities").where("type = 'EMAIL'"), "lang", "source")


# ---- tokens --------------------------------------------------------------------------------------------------------
_SAID = "concat(coalesce(text, ''), ' mail user', cast(turn % 3 as string), '@example.org or user', cast(conv_id % 2 as string), '@example.org')"


def _chats(spark, sf_dir) -> DataFrame:
    chats = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_SAID).alias("text"))
    return _scan(chats)


@query("token_assign", """
WITH v AS (SELECT conv_id, turn, 1 AS pos, 'user' || (turn % 3) || '@example.org' AS value FROM conversations UNION ALL SELECT conv_id, turn, 2, 'user' || (conv_id % 2) || '@example.org' FROM conversations),
f AS (SELECT conv_id, value, min(turn * 10 + pos) AS first FROM v GROUP BY ALL),
n AS (SELECT conv_id, value, row_number() OVER (PARTITION BY conv_id ORDER BY first) AS n FROM f) SELECT conv_id, value, n, '<<EMAIL_' || n || '>>' AS token FROM n""")
def token_assign(spark, sf_dir):
    return tokens.tokenize(_chats(spark, sf_dir), ["conv_id"], ["turn"])[1].select("conv_id", "value", "n", "token")


SQL_OF_TOKENS = """
WITH v AS (SELECT conv_id, turn, 1 AS pos, 'user' || (turn % 3) || '@example.org' AS value FROM conversations UNION ALL SELECT conv_id, turn, 2, 'user' || (conv_id % 2) || '@example.org' FROM conversations),
n AS (SELECT conv_id, value, '<<EMAIL_' || row_number() OVER (PARTITION BY conv_id ORDER BY min(turn * 10 + pos)) || '>>' AS token FROM v GROUP BY conv_id, value)
SELECT c.conv_id, c.turn, md5(coalesce(text, '') || ' mail ' || a.token || ' or ' || b.token) AS tokenized FROM conversations c JOIN n a ON a.conv_id = c.conv_id AND a.value = 'user' || (turn % 3) || '@example.org' JOIN n b ON b.conv_id = c.conv_id AND b.value = 'user' || (c.conv_id % 2) || '@example.org'"""


@query("tokenize_conversations", SQL_OF_TOKENS)
def tokenize_conversations(spark, sf_dir):
    return tokens.tokenize(_chats(spark, sf_dir), ["conv_id"], ["turn"])[0].select("conv_id", "turn", F.md5("tokenized").alias("tokenized"))


@query("rehydrate_roundtrip", "SELECT conv_id, turn, md5(coalesce(text, '') || ' mail user' || (turn % 3) || '@example.org or user' || (conv_id % 2) || '@example.org') AS text FROM conversations")
def rehydrate_roundtrip(spark, sf_dir):
    done, mapping = tokens.tokenize(_chats(spark, sf_dir), ["conv_id"], ["turn"])
    back = tokens.rehydrate(done.drop("text"), mapping, ["conv_id"], ["turn"])
    return back.select("conv_id", "turn", F.md5("rehydrated").alias("text"))


_NOTE = "concat('<<EMAIL_', cast(user_id as string), '>> <<PHONE_', cast(event_id % 9 as string), '>> ', repeat('<<OTHER_1>> ', int(event_id % 4)), '<<email_2>> <<EMAIL_x>> ', repeat('<<NAME_7>>', int(user_id % 3)))"
_NOTE_SQL = "'<<EMAIL_' || user_id || '>> <<PHONE_' || (event_id % 9) || '>> ' || repeat('<<OTHER_1>> ', event_id % 4) || '<<email_2>> <<EMAIL_x>> ' || repeat('<<NAME_7>>', user_id % 3)"


@query("token_counts", f"SELECT event_id, len(regexp_extract_all(x, '<<[A-Z_]+_[0-9]+>>')) AS present, len(regexp_extract_all(x, '<<(EMAIL|PHONE|IBAN|CREDIT_CARD|JWT|NAME|SECRET|PRIVATE_KEY)_[0-9]+>>')) AS known FROM (SELECT event_id, {_NOTE_SQL} AS x FROM events)")
def token_counts(spark, sf_dir):
    note = F.expr(_NOTE)
    return _t(spark, sf_dir, "events").select("event_id", tokens.count_tokens(note).cast("long").alias("present"), F.regexp_count(note, F.lit(fixed.TOKEN)).cast("long").alias("known"))


@query("token_max_counter", "SELECT event_type, 'EMAIL' AS type, max(user_id) AS top FROM events GROUP BY event_type UNION ALL SELECT event_type, 'PHONE', max(event_id % 9) FROM events GROUP BY event_type UNION ALL SELECT event_type, 'NAME', 7 FROM events WHERE user_id % 3 > 0 GROUP BY event_type")
def token_max_counter(spark, sf_dir):
    return tokens.max_counters(_t(spark, sf_dir, "events").select("event_type", F.expr(_NOTE).alias("note")), ["event_type"], "note")


@query("segment_replace", "SELECT c_custkey, 'X' || substr(c_name, 3, 4) || 'YZ' || substr(c_name, 10) AS body FROM customer")
def segment_replace(spark, sf_dir):
    part = lambda a, b, t: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(t).alias("text"))
    parts = F.array(part(6, 9, "YZ"), part(0, 2, "X"), part(5, 5, "no"), part(7, 8, "no"), part(90, 95, "no"))
    return _t(spark, sf_dir, "customer").select("c_custkey", tokens.replace_segments(F.col("c_name"), parts).alias("body"))


# ---- routing and guards --------------------------------------------------------------------------------------------
_CASES = " ".join(f"WHEN host = '{d}' OR ends_with(host, '.{d}') THEN '{p}'" for d, p in sorted(PROVIDERS, key=lambda x: -len(x[0])))


@query("route_hosts", f"""
WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages), r AS (SELECT *, CASE {_CASES} END AS p FROM h)
SELECT page_id, host, coalesce(p, 'unknown') AS provider, CASE WHEN p IS NULL THEN 'TUNNEL' ELSE 'MITM' END AS action FROM r""")
def route_hosts(spark, sf_dir):
    hosts = _t(spark, sf_dir, "pages").select("page_id", policy.clean_host(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)).alias("host"))
    providers = spark.createDataFrame(list(PROVIDERS), "domain string, provider string")
    return policy.route(hosts, providers).select("page_id", "host", "provider", "action")


@query("path_guard", """
WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/backend-api/f/Conversation/' || page_id WHEN 1 THEN '/backend-api/f/conversationXYZ' WHEN 2 THEN '/v1/messages' ELSE regexp_extract(url, '^[a-z]+://[^/]+([^?#]*)', 1) END AS path FROM pages)
SELECT page_id, page_id % 4 = 0 AS provider, page_id % 4 < 3 OR contains(lower(path), '/chat/') AS scanned FROM p""")
def path_guard(spark, sf_dir):
    k = F.col("page_id") % 4
    path = F.when(k == 0, F.concat(F.lit("/backend-api/f/Conversation/"), "page_id")).when(k == 1, "/backend-api/f/conversationXYZ").when(k == 2, "/v1/messages").otherwise(F.regexp_extract("url", "^[a-z]+://[^/]+([^?#]*)", 1))
    return _t(spark, sf_dir, "pages").select("page_id", policy.provider_path(path).alias("provider"), policy.scan_path(path).alias("scanned"))


@query("content_type_action", "SELECT page_id, ['skip', 'sse', 'analyze', 'analyze', 'skip'][page_id % 5 + 1] AS action FROM pages")
def content_type_action(spark, sf_dir):
    kinds = F.array(*map(F.lit, ("", "Text/Event-Stream; x=1", "application/json", " text/html", "image/png")))
    return _t(spark, sf_dir, "pages").select("page_id", policy.content_action(F.get(kinds, (F.col("page_id") % 5).cast("int"))).alias("action"))


@query("conversation_scope_hash", """
WITH h AS (SELECT conv_id, md5(conv_id::VARCHAR) AS m FROM (SELECT DISTINCT conv_id FROM conversations))
SELECT conv_id, sha256(CASE WHEN conv_id % 2 = 0 THEN m[1:8] || '-' || m[9:12] || '-' || m[13:16] || '-' || m[17:20] || '-' || m[21:32] ELSE conv_id::VARCHAR END) AS scope FROM h""")
def conversation_scope_hash(spark, sf_dir):
    m = F.upper(F.md5(F.col("conv_id").cast("string")))
    uuid = F.concat_ws("-", *(F.substring(m, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    path = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("/c/"), uuid)).otherwise("/c/none")
    return _t(spark, sf_dir, "conversations").select("conv_id").distinct().select("conv_id", policy.conversation_scope(path, F.col("conv_id").cast("string")).alias("scope"))


@query("domain_semi_join", "SELECT page_id FROM pages WHERE regexp_matches(lower(url), '^[a-z]+://([^/:?#]+[.])?example[.]com([/:?#]|$)')")
def domain_semi_join(spark, sf_dir):
    pages = _t(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"))
    return policy.route(pages, spark.createDataFrame([("example.com", "alpha")], "domain string, provider string")).where("action = 'MITM'").select("page_id")


# ---- vault ---------------------------------------------------------------------------------------------------------
def _writes(spark, sf_dir) -> DataFrame:
    token = F.concat(F.lit("<<"), F.upper("event_type"), F.lit("_"), F.col("event_id").cast("string"), F.lit(">>"))
    return _t(spark, sf_dir, "events").select(F.lit("alpha").alias("provider"), F.col("user_id").cast("string").alias("conversation_id"), token.alias("token"), F.upper("event_type").alias("type"), F.col("props").alias("value"), F.col("ts").alias("created_at"))


@query("vault_metadata", "SELECT user_id::VARCHAR AS conversation_id, count(*) AS pii_count, array_to_string(list_sort(list(DISTINCT upper(event_type))), ',') AS pii_types, min(ts) AS created_at, max(ts) AS updated_at FROM events GROUP BY user_id")
def vault_metadata(spark, sf_dir):
    return vault.metadata(_writes(spark, sf_dir)).select("conversation_id", "pii_count", F.array_join("pii_types", ",").alias("pii_types"), "created_at", "updated_at")


@query("vault_active", f"SELECT user_id::VARCHAR AS conversation_id, count(*) AS pii_count FROM events GROUP BY user_id HAVING NOT min(ts) + INTERVAL 168 HOURS < {NOW}")
def vault_active(spark, sf_dir):
    return vault.active(vault.metadata(_writes(spark, sf_dir)), F.expr(NOW), 168).select("conversation_id", "pii_count")


@query("vault_expired_anti", f"SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events GROUP BY user_id HAVING min(ts) + INTERVAL 168 HOURS < {NOW})")
def vault_expired_anti(spark, sf_dir):
    writes = _writes(spark, sf_dir)
    return vault.purge(writes, vault.metadata(writes), F.expr(NOW), 168).select(F.regexp_extract("token", "_([0-9]+)>>$", 1).cast("long").alias("event_id"))


@query("vault_roundtrip", "SELECT event_id, props AS value, strlen(props)::BIGINT + 28 AS sealed FROM events")
def vault_roundtrip(spark, sf_dir):
    key = bytes(range(32))
    sealed = vault.entries(_writes(spark, sf_dir), key, F.col("created_at"))
    return sealed.select(F.regexp_extract("token", "_([0-9]+)>>$", 1).cast("long").alias("event_id"), vault.unseal(F.col("value"), key).alias("value"), F.length("value").cast("long").alias("sealed"))


@query("vault_upsert", "SELECT user_id::VARCHAR AS conversation_id, upper(event_type) AS type, arg_max(props, (event_id % 2, ts, props)) AS value FROM events GROUP BY ALL")
def vault_upsert(spark, sf_dir):
    """Writes of even events stand, those of odd events come; each batch holds the newest write of a token."""
    writes = _writes(spark, sf_dir).withColumn("odd", F.regexp_extract("token", "_([0-9]+)>>$", 1).cast("long") % 2).withColumn("token", F.concat(F.lit("<<"), "type", F.lit("_1>>")))
    newest = writes.groupBy("odd", "provider", "conversation_id", "token").agg(F.max_by(F.struct("type", "value", "created_at"), F.struct("created_at", "value")).alias("e")).select("odd", "provider", "conversation_id", "token", "e.*")
    return vault.upsert(newest.where("odd = 0").drop("odd"), newest.where("odd = 1").drop("odd")).select("conversation_id", "type", "value")


# ---- flows, bodies, streams ----------------------------------------------------------------------------------------
@query("flow_last50", "SELECT event_id, event_type, row_number() OVER (ORDER BY ts, event_id) AS ring_id FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 50)")
def flow_last50(spark, sf_dir):
    return audit.ring(_t(spark, sf_dir, "events").select("event_id", "event_type", "ts"), ["ts", "event_id"]).select("event_id", "event_type", "ring_id")


@query("json_parts_extract", "SELECT conv_id, turn, 2::BIGINT AS n, md5(coalesce(text, '') || '|' || role) AS parts FROM conversations WHERE text IS NOT NULL")
def json_parts_extract(spark, sf_dir):
    body = F.to_json(F.struct(F.lit("m").alias("model"), F.array(F.struct(F.lit("user").alias("author"), F.struct(F.array("text", "role").alias("parts")).alias("content"))).alias("messages")))
    rows = _t(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", extract.valid_segments(extract.request_parts(body)).alias("p"))
    return rows.select("conv_id", "turn", F.size("p").cast("long").alias("n"), F.md5(F.array_join("p", "|")).alias("parts"))


@query("json_all_strings", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 2 + event_id % 3 END::BIGINT AS n, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN event_type || '|x|' || props ELSE event_type || '|x|' || props || '|deep' END AS strings FROM events")
def json_all_strings(spark, sf_dir):
    deep = F.when(F.col("event_id") % 3 == 2, F.array(F.struct(F.lit("deep").alias("z"))))
    body = F.to_json(F.struct(F.col("event_type").alias("a"), F.struct(F.array(F.lit("x")).alias("b"), F.col("value").alias("n")).alias("c"), F.col("props").alias("d"), deep.alias("e")))
    broken = F.when(F.col("event_id") % 3 == 0, F.concat(body, F.lit("}"))).otherwise(body)
    found = extract.all_strings(_t(spark, sf_dir, "events").select("event_id", broken.alias("body")), "body")
    return found.select("event_id", F.size("strings").cast("long").alias("n"), F.array_join("strings", "|").alias("strings"))


_FRAMES_SQL = """
WITH n AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations)
SELECT conv_id AS stream_id, 2 * k - 1 AS frame_no, 'turn' AS event, role AS data FROM n UNION ALL SELECT conv_id, 2 * k, '', 'part ' || turn FROM n"""


def _event_text(spark, sf_dir) -> DataFrame:
    text = F.concat(F.lit("event: turn\r\ndata: "), F.col("role"), F.lit("\r\n\r\ndata: part "), F.col("turn").cast("string"), F.lit("\n\n"))
    return _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("seq"), text.alias("chunk"))


@query("sse_frames", _FRAMES_SQL)
def sse_frames(spark, sf_dir):
    return sse.frames(_event_text(spark, sf_dir))


@query("sse_split_frames", _FRAMES_SQL)
def sse_split_frames(spark, sf_dir):
    """The same frames from chunks of seven characters, whose ends fall anywhere."""
    whole = _event_text(spark, sf_dir).groupBy("stream_id").agg(F.sort_array(F.collect_list(F.struct("seq", "chunk"))).alias("c")).select("stream_id", F.array_join(F.transform("c", lambda c: c["chunk"]), "").alias("t"))
    cut = F.transform(F.sequence(F.lit(0), F.ceil(F.length("t") / 7).cast("int") - 1), lambda k: F.substring(F.col("t"), k * 7 + 1, F.lit(7)))
    return sse.frames(whole.select("stream_id", F.posexplode(cut).alias("seq", "chunk")))


@query("patch_text", "SELECT conv_id AS stream_id, string_agg('t' || turn, '' ORDER BY turn) AS text, count(*) AS events FROM conversations GROUP BY conv_id")
def patch_text(spark, sf_dir):
    kind = F.when(F.col("turn") == 0, "add").otherwise("append")  # nothing is appended to what is not there
    op = F.to_json(F.struct(kind.alias("o"), F.lit("/message/content/parts/0").alias("p"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("v")))
    events = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("frame_no"), F.lit("delta").alias("event"), op.alias("data"))
    folded = sse.patch_text(events).groupBy("stream_id").agg(F.sort_array(F.collect_list(F.struct("frame_no", "text"))).alias("l"))
    return folded.select("stream_id", F.array_join(F.transform("l", lambda x: x["text"]), "").alias("text"), F.size("l").cast("long").alias("events"))


@query("stream_totals", "SELECT conv_id AS stream_id, count(*) AS frames, 2 * count(*)::BIGINT AS entity_count, sum(strlen(text || ' mail user' || (turn % 3) || '@example.org or user' || (conv_id % 2) || '@example.org'))::BIGINT AS bytes FROM conversations GROUP BY conv_id")
def stream_totals(spark, sf_dir):
    return audit.stream_totals(_chats(spark, sf_dir).select(F.col("conv_id").alias("stream_id"), "entities", F.col("text").alias("data")))


@query("events_windowed", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def events_windowed(spark, sf_dir):
    return windowed_counts(_t(spark, sf_dir, "events"))


@query("events_sessionized", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY user_id, k""")
def events_sessionized(spark, sf_dir):
    grouped = _t(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n"))
    return grouped.select("user_id", "first_ts", "last_ts", "n")


from quillmask.plans import flows, live, planted  # noqa: E402,F401  (they register more queries)
