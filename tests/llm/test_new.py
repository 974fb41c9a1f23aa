"""Hard negatives, residual packing and alignment against second computations, and their odd rows."""

import hashlib
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillmask.llm import alignment, hard_negatives, queries, residual_packing, words

DATA = "/root/testdata"
needs_tables = pytest.mark.skipif(not os.path.isdir(f"{DATA}/sf0.001"), reason="tables are absent")
WORD, A, B = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
DOCS = "doc_id long, text string, id string, block string, bin string, fill string, done string, pairs string"
BITS = ["'s", "'re", " ", "  ", "\n", "\t", "a", "Z", "É", "é", "́", "漢", "12", "²", "!", "''", "<|endoftext|>", "<|startoftext|>", "<s>", "<0x0A>", "'ll", "the", "\x85", "\x1c", "　", "\xa0", "​", "\0", "😀", "tion", "Σ", "İ.", "=", "ß,", "; ", ".", "#", "%", "&,", "▁"]


def random_texts(n, seed, longest=40):
    rng = random.Random(seed)
    return ["".join(rng.choices(BITS, k=rng.randrange(0, longest))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    texts = [None, "", "a", "It's  here\n\n<|endoftext|> 123 naïve 漢字 😀", "word " * 30_000, "token: abcdefgh12 ▁", "x" * 5000, "\n" * 3000, " " * 3001, *random_texts(60, 4)]
    rows = [(k, t, "i", "b", "c", "f", "d", "p") for k, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[3], (None, "a null id", *"ibcfdp"[:6])], DOCS).repartition(3)


# ---- hard negatives ------------------------------------------------------------------------------------------------
VECTORS = "vec_id long, embedding array<float>, label int, q long, v string, cell string, anchor boolean"


def negatives_by_hand(rows, positives=5, negatives=10):
    sound = [(i, [int(np.floor(256 * float(x))) for x in v], lab) for i, v, lab in rows if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = Counter()
    for i, v, lab in sound:
        if i % 100:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, o) for j, w, o in sound if j != i and len(w) == len(v)]
        scored.sort(key=lambda x: (-x[0], x[1]))
        for p, pid, _ in [x for x in scored if x[2] == lab][:positives]:
            for rank, (s, j, _) in enumerate([x for x in scored if x[2] != lab and 30 * p <= 100 * x[0] <= 90 * p][:negatives], 1):
                out[i, pid, rank, j, p, s] += 1
    return out


def mined(df, **more):
    got = hard_negatives.mine(df, F.col("vec_id") % 100 == 0, **more)
    return Counter(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()))


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_hard_negatives_equal_all_pairs(spark, spread):
    """Clustered vectors, ties, repeated vectors, other lengths and rows that take no part; one tree of several leaves, and many small ones."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    rows = [(k, (centres[k % 6] + spread * rng.normal(size=8)).round(2).astype(np.float32).tolist(), int(rng.integers(0, 3))) for k in range(900)]
    rows += [(1000 + k, rows[100][1], k % 3) for k in range(60)]  # ties
    rows += [(1200, None, 1), (1300, [1.0] * 8, None), (1400, [float("nan")] * 8, 1), (1500, [1.0] * 7 + [None], 0), (1600, [], 0), (None, [1.0] * 8, 1), (1700, [float("inf")] * 8, 1)]
    rows += [(2000 + k, rng.normal(size=3).astype(np.float32).tolist(), k % 2) for k in range(50)] + [(2100, [0.0] * 8, 0), (-100, [-0.5] * 8, 2)]
    df = spark.createDataFrame([(*r, 1, "v", "c", False) for r in rows], VECTORS)
    want = negatives_by_hand([(i, v, lab) for i, v, lab in rows])
    assert len(want) > 100
    assert mined(df) == want
    assert mined(df, splits=1) == want
    assert mined(df, chunk=3, splits=5) == want


def test_ball_tree_leaves_out_only_what_cannot_be_a_hit():
    rng = np.random.default_rng(0)
    x = (256 * (rng.normal(size=(8, 1, 16)) + 0.05 * rng.normal(size=(8, 500, 16)))).astype(np.int64).reshape(-1, 16)
    ids, labels = np.arange(len(x)), np.arange(len(x)) // 500
    mixed = rng.permutation(len(x))
    x, labels = x[mixed], labels[mixed]
    low, high = np.full((30, 1), 50_000), np.full((30, 1), 900_000)
    search = hard_negatives.Search(x[::130][:30], ids[::130][:30], labels[::130][:30], low, high, 10, False)
    for at in range(0, len(x), 2000):
        search.add(x[at : at + 2000], ids[at : at + 2000], labels[at : at + 2000])
    for k in range(30):
        s = x @ search.vectors[k]
        fits = [(-s[j], j) for j in ids if labels[j] != search.labels[k] and 50_000 <= s[j] <= 900_000]
        got = [(-a, b) for a, b in zip(search.score[k, 0], search.ids[k, 0]) if a > -(1 << 62)]
        assert got == sorted(fits)[:10]
    assert search.scored < 30 * len(x) * 0.6  # nodes were pruned
    big = hard_negatives.Search(x[:2] * 10_000_000, ids[:2], labels[:2], low[:2] - (1 << 60), high[:2] + (1 << 60), 3, False)
    big.add(x * 3_000, ids, labels)  # beyond what doubles hold exactly
    s = [sum(int(a) * 30_000_000_000 * int(b) for a, b in zip(x[0], w)) for w in x]
    assert big.score[0, 0].tolist() == sorted((v for v, lab in zip(s, labels) if lab != labels[0] and -(1 << 60) <= v <= (1 << 60)), reverse=True)[:3]


def test_hard_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert hard_negatives.mine(empty, F.col("vec_id") % 100 == 0).count() == 0
    lone = spark.createDataFrame([(100, [1.0], 1, 0, "", "", None), (100, [1.0], 1, 0, "", "", None)], VECTORS)
    assert not mined(lone)


# ---- residual packing ----------------------------------------------------------------------------------------------
def word_ids(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(WORD).encode_batch(texts, add_special_tokens=False)]


def test_words_are_encoded_as_texts():
    texts = [*random_texts(4000, 1), "word, " * 3000, "x" * 3000, "İ.İ,"]
    flat, sizes = residual_packing.encode(texts, WORD)
    assert [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] == word_ids(texts)


def test_letters_are_lowered_as_the_library_does():
    letters = [c for c in map(chr, range(0x250)) if re.fullmatch(f"[{words.LETTERS}]", c)]
    texts = [t for c in letters for t in (c, f"x{c}Q", f"{c}\u0331{c}.", f"{c}\u0301,{c}'S")]
    texts += ["<|ENDOFTEXT|> The<|endoftext|>THE", "H\u0331 J\u030c T\u0308", "THE the The", "\u00c9T\u00c9 \u00c9t\u00e9!", "A" * 70 + " B", "NA\u0130VE \u03a3\u03a3. \u01c5", "\u1e9e \ufb01X"]
    flat, sizes = residual_packing.encode(texts, WORD)
    assert [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] == word_ids(texts)


def test_other_files_are_asked_for_every_word(tmp_path):
    import json

    from tokenizers import Tokenizer

    with open(WORD, encoding="utf-8") as f:
        spec = json.load(f)
    spec["normalizer"] = {"type": "NFC"}
    path = str(tmp_path / "cased.json")
    (tmp_path / "cased.json").write_text(json.dumps(spec), encoding="utf-8")
    texts = [*random_texts(500, 12), "The THE the. \u00c9t\u00e9 H\u0331"]
    flat, sizes = residual_packing.encode(texts, path)
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] == want != word_ids(texts)


def test_words_not_seen_before_cost_less_than_the_whole_library(monkeypatch):
    """The share of the time that words of letters alone take where none comes again."""
    monkeypatch.setenv("TOKENIZERS_PARALLELISM", "false")
    own, rng = words.tokenizer(WORD), random.Random(9)
    residual_packing.encode(["a b"], WORD)
    took = []
    for _ in range(3):
        new = sorted({"".join(rng.choices(["th", "on", "tion", "er", "\u00e9", "in", "X"], k=9)) for _ in range(20_000)})
        began = time.process_time()
        ids = [i for e in own.encode_batch_fast(new, add_special_tokens=False) for i in e.ids]
        whole = time.process_time() - began
        began = time.process_time()
        flat, _ = residual_packing.encode([" ".join(new)], WORD)
        took.append((time.process_time() - began) / whole)
        assert flat.tolist() == ids
    assert min(took) < 0.75


def test_known_words_are_made_again_only_when_both_halves_lost_them():
    made = []
    known = words.Known(lambda w: made.append(w) or w.encode(), most=6)
    assert [known[w] for w in "abcadbea"] == [w.encode() for w in "abcadbea"] and made == list("abcde")
    assert len(known) <= 3 and len(known.older) <= 3
    for w in "fghijk":
        known[w]
    assert known["a"] == b"a" and made.count("a") == 2
    long = "x" * (words.LONGEST + 1)
    assert known[long] == known[long] == long.encode() and long not in known and made.count(long) == 2


def check_pieces(rows, ids, capacity):
    """rows: (key of ids, piece, start, length, crc, sequence, offset); every id once, sequences gapless and within capacity."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for key, piece, start, length, crc, sequence, offset in rows:
        by_doc[key].append((piece, start, length, crc))
        by_sequence[sequence].append((offset, length))
    assert set(by_doc) == set(ids)
    for key, (own, copies) in ids.items():
        want = [(k, at, len(own[at : at + capacity]), zlib.crc32(np.array(own[at : at + capacity], "<u4").tobytes())) for k, at in enumerate(range(0, len(own), capacity))]
        assert sorted(by_doc[key]) == sorted(want * copies)
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by_sequence)


def test_residual_packing_is_whole(spark, docs):
    rows = docs.collect()
    ids = {}
    for r, own in zip(rows, word_ids([r.text or "" for r in rows])):
        ids[r.doc_id] = ([*own, 1], ids.get(r.doc_id, (0, 0))[1] + 1)
    for more in ({}, {"capacity": 64, "slack": 0, "block": 20, "group": 30}, {"capacity": 64, "slack": 4, "block": 5, "group": 8}):
        got = residual_packing.pack(docs, WORD, **more)
        assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
        used = check_pieces(list(map(tuple, got.collect())), ids, more.get("capacity", 4096))
        tokens = sum(len(own) * n for own, n in ids.values())
        assert used <= tokens / more.get("capacity", 4096) * 1.1 + 2
    assert residual_packing.pack(docs.limit(0), WORD).count() == 0
    with pytest.raises(ValueError):
        residual_packing.pack(docs, A)


@needs_tables
def test_sequences_are_few(spark):
    got = queries.op12_residual_packing(spark, f"{DATA}/sf0.01")
    n, tokens, docs = got.agg(F.countDistinct("sequence_id"), F.sum("length"), F.countDistinct("doc_id")).first()
    assert docs == 1000 and n <= tokens / 4096 * 1.01 + 1


def test_best_fit_by_hand():
    rng = random.Random(5)
    for _ in range(50):
        sizes = [rng.randrange(1, 40) for _ in range(rng.randrange(0, 60))]
        where, offset, fill = residual_packing.best_fit(sizes, 40)
        bins = []  # the same rule, looking through all bins
        for n in sorted(sizes, reverse=True):
            rooms = [b for b in bins if b + n <= 40]
            if rooms:
                bins.remove(max(rooms))
            bins.append((max(rooms) if rooms else 0) + n)
        assert sorted(fill.tolist()) == sorted(bins)
        for b in range(len(fill)):
            assert sorted(offset[where == b].tolist()) == np.cumsum([0, *sorted((s for s, w in zip(sizes, where) if w == b), reverse=True)])[:-1].tolist()


# ---- alignment -----------------------------------------------------------------------------------------------------
def tokens_by_hand(texts):
    """(A tokens, B tokens) as (id, end), or None, by whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    stand_in = alignment.bpe.byte_alphabet()
    out = []
    for text in texts:
        if not text:
            out.append(None)
            continue
        raw, both = (" " + text).encode(), []
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        for ids, of in ((x, lambda k: bytes(stand_in[c] for c in a.id_to_token(k))), (y, lambda k: bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode())):
            parts = [of(k) for k in ids]
            both.append(list(zip(ids, np.cumsum(list(map(len, parts))).tolist())) if b"".join(parts) == raw else None)
        out.append(tuple(both) if None not in both else None)
    return out


def groups_by_hand(a, b):
    cuts, out = {e for _, e in a} & {e for _, e in b}, {}
    ends = sorted(cuts)
    for side, own in enumerate((a, b)):
        at = 0
        for i, e in own:
            out.setdefault(ends[at], ([], []))[side].append(i)
            at += e == ends[at]
    return list(out.values())


def alignments_by_hand(texts):
    every = [groups_by_hand(*t) if t else [] for t in tokens_by_hand(texts)]
    links = [[(x, y) for a, b in groups for x in a for y in b] for groups in every]
    count = Counter(p for own in links for p in set(own))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for groups, own in zip(every, links):
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(own), sum(count[p] == best[p[0]] for p in own), sum(count[p] for p in own), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return out


@pytest.mark.parametrize("block", [alignment.BLOCK, 100])
def test_alignment_by_hand(spark, docs, block):
    rows = docs.collect()
    want = Counter((r.doc_id, *w) for r, w in zip(rows, alignments_by_hand([r.text for r in rows])))
    assert sum(w[1] > 0 for w in want) > 20
    got = alignment.linked_counts(docs, A, B, block=block)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, got.collect())) == want
    assert alignment.linked_counts(docs.limit(0), A, B).count() == 0


def test_many_texts_align_as_the_libraries_do():
    texts = random_texts(3000, 8, 25)
    both = alignment.pair(A, B)
    x, tokens = alignment.align_texts(texts, both), tokens_by_hand(texts)
    assert x.n_a.tolist() == [len(t[0]) if t else 0 for t in tokens]
    assert x.a.tolist() == [i for t in tokens if t for i, _ in t[0]] and x.b.tolist() == [i for t in tokens if t for i, _ in t[1]]
    assert alignment.group_texts(x, both) == [";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups_by_hand(*t)) if t else "" for t in tokens]


def test_align_gives_spans_overlaps_and_groups(spark, docs):
    rows = {(r.doc_id, r.text): t for r, t in zip(docs.collect(), tokens_by_hand([r.text for r in docs.collect()]))}
    found = {r.doc_id: r for r in alignment.align(docs.where("doc_id <> 4"), A, B).collect()}
    for (k, text), both in rows.items():
        if k is None or k == 4:
            continue
        spans = [[(t.id, t.end) for t in found[k][c]] for c in "ab"]
        assert spans == [list(s) for s in (both or ((), ()))]
        a, b = found[k].a, found[k].b
        assert all(t.start == (own[n - 1].end if n else 0) for own in (a, b) for n, t in enumerate(own))
        want = [(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x.start < y.end and y.start < x.end] if len(a) * len(b) < 10**5 else None
        assert want is None or sorted(map(tuple, found[k].overlaps)) == want
        assert [([a[i].id for i in range(g.a_from, g.a_to)], [b[i].id for i in range(g.b_from, g.b_to)]) for g in found[k].groups] == (groups_by_hand(*both) if both else [])


# ---- folds of the classifier ---------------------------------------------------------------------------------------
def test_folds_are_those_of_crc32(spark):
    from quillmask.llm import toxicity

    rows = spark.range(-5, 500).select("id", (toxicity.fold(F.col("id")) == 0).alias("out")).collect()
    assert all(r.out == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)
