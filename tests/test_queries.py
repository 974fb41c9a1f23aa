import json
import os

import pytest

from quillmask.functions import plain
from quillmask.plans.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
#: these plan all recognizers, which takes Spark longer than running them; rehydrate_roundtrip, planted_audit and scan_bodies stand for them here
ALIKE = {"token_assign", "tokenize_conversations", "stream_totals", "planted_rollup", "planted_entities", "planted_limit", "scan_audit", "scan_monitor", "restore_bodies"}
@pytest.mark.skipif(not os.path.isdir(DATA), reason="tables are absent")
@pytest.mark.parametrize("name", sorted(set(SQL) - ALIKE))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("customer", "orders", "events", "documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = QUERIES[name](spark, DATA).toPandas(), con.execute(SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda d: sorted(map(tuple, d[columns].astype(str).values.tolist()))
    assert rows(got) == rows(want)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="tables are absent")
def test_queries_without_sql_equal_plain_python(spark):
    from collections import Counter

    docs = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    found = {i: plain.detect(r.text) for i, r in docs.items()}
    kinds = {}
    for i, entities in found.items():
        for e in entities:
            kinds.setdefault((docs[i].source, e["type"]), []).append(e["confidence"])
    assert {(r.source, r.type): (r.n, r.confidence) for r in QUERIES["entity_rollup"](spark, DATA).collect()} == {k: (len(v), round(sum(v) / len(v), 4)) for k, v in kinds.items()}
    labels = Counter("pii_found" if e else "clean" for e in found.values())
    assert {r.result: (r.docs, r.entities) for r in QUERIES["doc_result_label"](spark, DATA).collect()} == {"pii_found": (labels["pii_found"], sum(map(len, found.values()))), "clean": (labels["clean"], 0)}
    sets = Counter(key for i, entities in found.items() for _ in entities for key in ((docs[i].lang, docs[i].source), (docs[i].lang, None), (None, None)))
    assert {(r.lang, r.source): r.n for r in QUERIES["entity_grouping_sets"](spark, DATA).collect()} == sets
    for r in QUERIES["audit_records"](spark, DATA).collect():
        own = found[r.doc_id]
        assert (r.status, r.result, r.entity_count, r.bytes_analyzed) == ("ok", "pii_found" if own else "clean", len(own), len((docs[r.doc_id].text or "").encode())) or docs[r.doc_id].text is None
        assert json.loads(r.entity_summary or "{}") == Counter(e["type"] for e in own)
    for r in QUERIES["detect_secret_entropy"](spark, DATA).collect():
        own = [e for e in plain.raw_entities(docs[r.doc_id].text) if e["source"] == "entropy"]
        assert (r.n, r.score, r.n_bytes) == (len(own), round(sum(e["confidence"] for e in own), 4), sum(e["end"] - e["start"] for e in own))
