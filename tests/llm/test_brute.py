"""Operators and the pipeline against second computations in plain Python."""

import hashlib
import json
import os
import random
import re
import struct
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillmask.llm import chat_format, embedding_dedup, media, mixing, packing, secrets, toxicity

DATA = "/root/testdata"
needs_tables = pytest.mark.skipif(not os.path.isdir(f"{DATA}/sf0.001"), reason="tables are absent")
PATH = public_tokenizers.path("byte_bpe_50k.json")


# ---- secrets -------------------------------------------------------------------------------------------------------
def parts_by_hand(text, scope=secrets.SCOPE):
    """Spans (start, rank, end) of all six kinds, with Python's re and every pair of parts."""
    find = lambda p: list(re.finditer(p, text, re.A))
    span = lambda ms: [m.span() for m in ms]
    assign = span(m for m in find(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""") if len(m[2]) >= 8)
    access = span(m for m in find("AKIA[A-Z0-9]+") if len(m[0]) >= 16)
    hexes = span(m for m in find("[0-9a-f]+") if len(m[0]) >= 32)
    ids = span(find(secrets.IDENTIFIER))
    weak = span(m for m in find(secrets.WEAK) if re.search("[0-9]", m[0]) and re.search("[A-Z]", m[0]) and re.search("[a-z]", m[0]) and not m[0].startswith("AKIA"))
    ends = span(find(secrets.ENDPOINT))
    if not ids and "AKIA" not in text:
        weak = ends = []
    near = lambda p, others: any((o[1] <= p[0] and p[0] - o[1] <= scope) or (o[0] >= p[1] and o[0] - p[1] <= scope) for o in others)
    linked_id = [p for p in ids if near(p, assign + hexes + weak)]
    linked_secret = [p for p in weak if near(p, ids + access)]
    linked_end = [p for p in ends if near(p, ids + access) and near(p, assign + hexes + weak)]
    return sorted((a, rank, b) for rank, kind in enumerate((assign, access, hexes, linked_id, linked_secret, linked_end)) for a, b in kind)


def line(spans):
    return ",".join(f"{secrets.KINDS[r]}:{a}:{b}" for a, r, b in spans)


BITS = ["password: ", "Secret = '", "api_key=", "abcd1234", "Zx9aaaaaaaBBBB12345678", "AKIA", "ABCDEFGH12345678", "0af" * 12, "client_id=", "acme01", "user_name: ", "aB3" * 8, " ", " ", "é", "\n", "https://x.example/p?k=", "redis://h:1", "tokens", "x" * 150, "login:", "Kſ"]


def test_secrets_equal_plain_search(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choices(BITS, k=rng.randrange(0, 14))) for _ in range(1500)] + [None, "client_id=Zx9aaaaaaaBBBB12345678", "user_name: aB3aB3aB3aB3aB3aB3aB3aB3", "login: abc https://h.example/Zx9aaaaaaaBBBB12345678"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    some = set()
    for r in secrets.scan(df).collect():
        want = parts_by_hand(texts[r.doc_id] or "")
        base = [s for s in want if s[1] < 3]
        assert r.spans == line(want), texts[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(line(base).encode()).hexdigest() and [r.n_assign, r.n_access, r.n_hex] == [sum(s[1] == k for s in base) for k in range(3)]
        some |= {s[1] for s in want}
    assert some == set(range(6))


def test_overlapping_parts_are_no_partners(spark):
    texts = ["client_id=Zx9aaaaaaaBBBB12345678", "user_name: aB3aB3aB3aB3aB3aB3aB3aB3", "client_id=Zx9aaaaaaaBBBB12345678 and Qw8bbbbbbbCCCC12345678"]
    got = {r.doc_id: r.spans for r in secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0] == got[1] == "" and got[2] == "linked_id:0:32,linked_secret:10:32,linked_secret:37:59".replace("linked_secret:10:32,", "")


def test_a_megabyte_of_secrets(spark):
    text = "secret=abcdefgh " * 65_000
    df = spark.createDataFrame([(1, text, "a"), (2, None, "b"), (1, text, "c")], "doc_id long, text string, found string").withColumn("_secrets0", F.lit(1)).withColumn("spans", F.lit(2))
    began = time.time()
    rows = secrets.scan(df).collect()
    assert sorted(r.n_assign for r in rows) == [0, 65_000, 65_000] and time.time() - began < 120
    clean = secrets.redact(df)
    assert clean.columns == df.columns and clean.where("doc_id = 1").select(F.max(F.length("text"))).first()[0] == 65_000 * 9


# ---- media ---------------------------------------------------------------------------------------------------------
def test_media_rows_equal_second_computation(spark):
    rng = random.Random(3)
    texts = [None, "", "a", "é" * 96, "x" * 191, "y" * 193, "z" * 40_000, "z" * 40_000] + ["".join(rng.choices("ab é\n", k=rng.randrange(0, 9000))) for _ in range(25)]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, id string, media int")
    rows = {r.doc_id: r for r in media.media_columns(df, keep_media=True).collect()}
    for k, text in enumerate(texts):
        data, r = (text or "").encode(), rows[k]
        payload = data.ljust(max(192, -(-len(data) // 192) * 192), b" ")
        stored = bytes(r.media)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest()) and stored.endswith(payload)
        first, per = len(stored) - len(payload), 21
        keys = [[first + c * per * 192, first + c * per * 192 + 192] for c in range(0, -(-len(payload) // (192 * per)), 4)]
        assert json.loads(r.feature) == [{"codec": "raw ", "seconds": len(payload) / 8000, "samples": len(payload) // 192, "keyframes": keys}]
    assert rows[6].media_sha256 == rows[7].media_sha256


def test_broken_containers(spark):
    good = media.write(b"ab" * 9600)
    deep = b""
    for _ in range(3000):
        deep = struct.pack(">I4s", len(deep) + 8, b"moov") + deep
    at = good.index(b"stsz") + 4
    claims = good[:at] + struct.pack(">III", 0, 1, 0xFFFFFFFF) + good[at + 12 :]
    files = [good, None, b"", deep, claims, *(good[:n] for n in range(0, len(good), 97)), *(good[:n] + b"\xff" * 4 + good[n + 4 :] for n in range(0, 700, 5))]
    df = spark.createDataFrame([(k, None if f is None else bytearray(f), "x") for k, f in enumerate(files)], "id long, data binary, description string")
    got = {r.id: r.description for r in media.container_columns(df, "id", "data").collect()}
    assert len(got) == len(files) and json.loads(got[0])[0]["samples"] == 100 and got[1] == got[2] == got[3] == "[]" and all(json.loads(d) is not None for d in got.values())
    assert media.container_columns(df.limit(0), "id", "data").count() == 0


# ---- toxicity ------------------------------------------------------------------------------------------------------
def test_swapping_spares_neutral_mentions(spark):
    rng = random.Random(5)
    filler = ["lake", "tree", "river", "stone", "cloud", "meadow", "harbour", "street"]
    rows, labels = [], []
    for k in range(900):
        bad = k % 3 == 0
        words = rng.choices(filler, k=10) + (["vilest"] if bad and rng.random() < 0.7 else []) + ["muslim" if rng.random() < (0.8 if bad else 0.05) else "christian"]
        rng.shuffle(words)
        rows.append((k, " ".join(words) + "."))
        labels.append((k, int(bad)))
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    plain, fair = (toxicity.fit(df, lab, swap=s) for s in (0.0, 8.0))
    neutral = [" ".join(rng.choices(filler, k=10)) + " muslim." for _ in range(60)]
    wrong = [sum(m.score(toxicity.words(t)) >= 0.5 for t in neutral) for m in (plain, fair)]
    means = [np.mean([m.score(toxicity.words(t)) for t in neutral]) for m in (plain, fair)]
    assert means[1] < means[0] - 0.1 and wrong[1] < wrong[0]
    assert fair.score(toxicity.words("lake tree vilest stone river")) >= 0.5


@needs_tables
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    again = toxicity.fit(docs.withColumn("_score", F.lit(1)), labels)
    assert model == again  # one fit, whatever other columns there are
    scored = toxicity.score(docs.select("doc_id", "text"), model).where(toxicity.fold(F.col("doc_id")) == 0).join(labels, "doc_id").select("toxic", "score").collect()
    right = np.mean([(r.score >= 0.5) == bool(r.toxic) for r in scored])
    assert len(scored) > 20 and right >= 0.9 and any(r.toxic for r in scored)


def test_toxicity_of_a_long_text_and_clashing_columns(spark):
    model = toxicity.Model({"^vilest$": 0}, [0.0, 9.0, 0.0, 0.0, 0.0], -4.0)
    df = spark.createDataFrame([(1, "vilest word " * 90_000, "s"), (2, None, "t"), (2, None, "t"), (3, "vilest", "u")], "c0 long, text string, _score string")
    got = toxicity.score(df, model).collect()
    assert sorted((r.c0, r._score, r.score >= 0.5) for r in got) == [(1, "s", True), (2, "t", False), (2, "t", False), (3, "u", False)]
    assert toxicity.reject(df, model).columns == df.columns and toxicity.reject(df, model).count() == 3


# ---- mixing --------------------------------------------------------------------------------------------------------
def raked(cells, powers, keep, rounds):
    """cells: {(source, lang, topic): mass} -> weights, by plain loops."""
    whole, out, names = sum(cells.values()), {c: float(m) for c, m in cells.items()}, list(powers)
    sums = [{} for _ in names]
    for c, m in cells.items():
        for k in range(len(names)):
            sums[k][c[k]] = sums[k].get(c[k], 0) + m
    goals = [{v: s ** powers[n] for v, s in sums[k].items()} for k, n in enumerate(names)]
    goals = [{v: g * whole / sum(by.values()) for v, g in by.items()} for by in goals]
    for _ in range(rounds):
        for k in range(len(names)):
            have = {}
            for c, w in out.items():
                have[c[k]] = have.get(c[k], 0) + w
            out = {c: min(w * goals[k][c[k]] / have[c[k]], cells[c] / keep) for c, w in out.items()}
    for _ in range(mixing.SPREAD):
        free = sum(w for c, w in out.items() if w < cells[c] / keep)
        full = sum(w for c, w in out.items() if w >= cells[c] / keep)
        out = {c: min(w * (whole - full) / free, cells[c] / keep) if w < cells[c] / keep else w for c, w in out.items()}
    return out


def topic_by_hand(text):
    size = len((text or "").encode())
    if not size:
        return "empty"
    return next((n for n, p in mixing.TOPICS if re.search(p, text, re.A)), "long" if size >= mixing.LONG else "short")


def mix_by_hand(rows):
    """rows: (doc_id, source, lang, text) -> ids that are sampled."""
    marks = [(i, (s, g, topic_by_hand(t)), max(1, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")))) for i, s, g, t in rows]
    cells = {}
    for _, c, n in marks:
        cells[c] = cells.get(c, 0) + n
    weights = raked(cells, mixing.POWERS, mixing.KEEP, mixing.ROUNDS)
    draw = lambda i: int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:8], 16) / 2**32
    return {i for i, c, _ in marks if draw(i) < round(min(1.0, weights[c] / cells[c] * mixing.KEEP), 6)}


def test_mixing_meets_targets_that_can_be_met(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice("aaaaab"), rng.choice("xy"), rng.choice(["p", "q"]), "w " * rng.randrange(1, 30)) for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, t string, text string")
    want = {"source": {"a": 0.8, "b": 0.2, "not there": 5.0}, "lang": {"x": 1.0, "y": 3.0}, "topic": 0.5}
    report = mixing.report(df, topic_col="t", targets=want, keep=0.3, rounds=20)
    for r in mixing.marginals(report, want).collect():
        assert abs(r.target - r.expected) < 2e-3, r
    kept, whole = (report.agg(F.sum(F.col("n_tokens") * c)).first()[0] for c in (F.col("probability"), F.lit(1)))
    assert abs(kept / whole - 0.3) < 1e-3


def test_no_cell_gives_more_than_it_has(spark):
    rows = [(k, "rare" if k < 5 else "hot", "x", "t", "w") for k in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, t string, text string")
    got = {r.source: r for r in mixing.report(df, topic_col="t", targets={"source": {"rare": 1.0, "hot": 1.0}}).groupBy("source").agg(F.max("probability").alias("p"), F.max("weight").alias("w")).collect()}
    assert got["rare"].p == 1.0 and got["rare"].w == 2.0 and abs(got["hot"].p - 495 / 995) < 1e-4


def test_mixing_takes_nulls_and_values_without_target(spark):
    rows = [(1, "a", "x", None, "w"), (2, None, None, "t", None), (3, "b", "x", "t", "w w"), (None, "a", "x", "t", ""), (3, "b", "x", "t", "w w")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, t string, text string")
    got = mixing.report(df, topic_col="t", targets={"source": {"a": 1.0, None: 1.0}}).collect()
    assert len(got) == 5 and all(r.probability == 0 and not r.sampled for r in got if r.source == "b") and all(r.probability > 0 for r in got if r.source != "b")


# ---- chats, packing, vectors -----------------------------------------------------------------------------------------
def test_chats_with_repeated_rows(spark):
    rows = [(1, 0, "u", "a"), (1, 0, "u", "a"), (2, 0, "u", "a"), (3, 0, "u", "a"), (3, 0, "u", "a"), (3, 1, "b", "c")]
    got = {r.conv_id: (r.n_turns, r.rendered) for r in chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    assert got == {3: (3, "<|u|>\na<|end|>\n" * 2 + "<|b|>\nc<|end|>\n")}
    names = spark.createDataFrame([("x", 0, "u", "a"), (None, 0, "u", "b"), ("0", 0, "u", "c"), (None, 1, "u", "d")], "conv_id string, turn int, role string, text string")
    assert {r.conv_id: r.n_turns for r in chat_format.format_chats(names).collect()} == {"x": 1, None: 2, "0": 1}


@needs_tables
def test_packing_pads_little(spark):
    rows = packing.pack(spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").coalesce(1), PATH).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    padding = sum(0 if r.n & (r.n - 1) == 0 else 2048 - r.n for r in rows)
    assert padding < 0.02 * sum(r.n for r in rows) and all(r.n <= 2048 for r in rows)


def test_vectors_of_any_scale(spark):
    rows = [(1, [1e200, 2e200]), (2, [1e-200, 2e-200]), (3, [1.0, 2.0]), (4, [5e-324, 0.0]), (5, [1e308, 0.0]), (6, [-1.0, -2.0]), (7, [float("inf"), 1.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4), 6: (0, 6), 7: (0, 7)}


@needs_tables
def test_recall_at_default_pivots(spark):
    """Vectors of the table with near copies around the threshold, and one large group of them."""
    rng = np.random.default_rng(7)
    x = np.array([r.embedding for r in spark.read.parquet(f"{DATA}/sf0.01/embeddings.parquet").collect() if r.embedding is not None and len(r.embedding) == 64 and None not in r.embedding], np.float32)
    x = x[np.abs(x).sum(axis=1) > 0]
    size = np.linalg.norm(x, axis=1, keepdims=True)
    copies = [x + rng.normal(size=x.shape).astype(np.float32) * size / 8 * rng.choice([0.05, 0.2, 0.33], size=(len(x), 1)) for _ in range(3)]
    hot = x[0] + rng.normal(size=(1500, 64)).astype(np.float32) * size[0] / 8 * 0.22
    x = np.concatenate([x, *copies, hot]).astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = (u @ u.T >= 0.95).sum(axis=1) - 1
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    found = np.array([got[k].n_links for k in range(len(x))])
    assert (found <= want).all() and want.sum() > 10_000 and found.sum() >= 0.98 * want.sum(), (found.sum(), want.sum())


# ---- the pipeline ----------------------------------------------------------------------------------------------------
def near_copies_by_hand(rows):
    """Ids that link with no smaller id, directly or through others."""
    sets = {}
    for i, text in rows:
        words = [w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and label[a] != label[b] and (both := len(sets[a] & sets[b])) and 100 * both >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {i for i in sets if label[i] == i}


def masked_by_hand(text):
    if text is None:
        return None
    out, at = "", 0
    spans = sorted((a, b) for a, r, b in parts_by_hand(text) if r < 5)
    while spans:
        a, b = spans.pop(0)
        while spans and spans[0][0] <= b:
            b = max(b, spans.pop(0)[1])
        out, at = out + text[at:a] + "[SECRET]", b
    return out + text[at:]


@needs_tables
def test_pipeline_equals_its_stages_by_hand(spark):
    from tokenizers import Tokenizer

    sf_dir = f"{DATA}/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    rows = {r.doc_id: r for r in docs.collect() if model.score(toxicity.words(r.text or "")) < 0.5}
    kept = near_copies_by_hand([(i, r.text) for i, r in rows.items()])
    texts = {i: masked_by_hand(rows[i].text) for i in kept}
    sampled = mix_by_hand([(i, rows[i].source, rows[i].lang, texts[i]) for i in kept])
    library = Tokenizer.from_file(PATH)
    ids = {i: library.encode(texts[i] or "", add_special_tokens=False).ids + [1] for i in sampled}
    got = {}
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        assert zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        got.setdefault(r.doc_id, []).append((r.start, r.length))
    assert set(got) == sampled and 0 < len(sampled) < len(kept) < docs.count()
    for i, pieces in got.items():
        assert [a for a, _ in sorted(pieces)] == [sum(n for _, n in sorted(pieces)[:k]) for k in range(len(pieces))] and sum(n for _, n in pieces) == len(ids[i])


@needs_tables
def test_stages_take_empty_tables(spark):
    sf_dir = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0 and (name == "packing" or out.columns == docs.columns)


@needs_tables
def test_stages_take_nulls_and_repeated_rows(spark):
    sf_dir = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", "web", 0), (-1, "", "en", "web", 0), (-2, "tree lake", None, None, None)], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, sf_dir)
        n = out.count()
        assert n == 4 if name in ("toxicity", "near_duplicates", "secrets", "packing") else n <= 4, name
