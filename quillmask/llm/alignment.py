"""Alignment of two tokenizers' tokens over one text, by byte-owner arrays.

Both tokenizers' tokens cover the bytes of a space and the text.  np.repeat writes each token's number over its bytes,
once for A and once for B; where a pair of owners differs from the pair before, an overlap of two tokens begins, and
where both owners change at one place, both tokenizers cut there.  Cuts divide the tokens into groups, and every A token
of a group is linked with every B token of it.

1. One narrow pass encodes and aligns texts in blocks of `block` bytes.  A block keeps its distinct linked id pairs with
   the number of its documents that hold them, and its documents name pairs by their place in that list, so what
   is shuffled grows with distinct pairs by block and not with links.
2. Pairs are summed over all blocks, and the highest count of each A id is found among the distinct pairs.
3. Counts go back to the blocks by pair, and each block's documents add up their own.

Memory: one block and one batch of texts a task; a text longer than a block is one block.  Links are counted by
distinct pairs of a group, so a long run of one repeated token costs no more than its distinct ids; copies are counted row by row.

Texts that are null or empty, or whose joined token bytes differ from a space and the text (a text that holds U+2581), have
no tokens and give zeros.  A null id stays null; repeated rows are documents of their own; extra columns are not looked at; an
empty table gives no rows.  Special strings inside texts are plain text.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmask.llm import bpe
from quillmask.llm.common import mark, tidy, written
from quillmask.llm.words import LETTERS, MARKS, Words, code, flat, sums, tokenizer

#: bytes of text in a block; texts that Python functions get at once
BLOCK, ROWS = 2_000_000, 1_000
#: what marks the B ids of a word's code
_B = 1 << 31


class Pair:
    """Tokenizers A (byte-level BPE of the tokenizers library) and B (a sentencepiece model without normalisation)."""

    def __init__(self, path_a: str, path_b: str):
        import numpy as np
        import sentencepiece

        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") is not None or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            raise ValueError(f"{path_a}: not a plain byte-level tokenizer")
        self.a, self.b = tokenizer(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError(f"{path_b}: pieces go over the ends of words")
        stand_in = bpe.byte_alphabet()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, k in self.a.get_vocab(with_added_tokens=False).items():
            self.bytes_a[k] = bytes(stand_in[c] for c in token)
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.fromiter(map(len, every), np.int64, len(every)) for every in (self.bytes_a, self.bytes_b))
        self.of_a = [f"{k}{end}" for k in range(len(self.bytes_a)) for end in ",|"]
        self.of_b = [f"{k}{end}" for k in range(len(self.bytes_b)) for end in ",;"]
        # neither tokenizer joins what stands on both sides of a space after something that is no white space, nor of a mark after a letter where no piece of B does
        marks = "".join(m for m in MARKS if not any(re.search(f"[{LETTERS}]{re.escape(m)}", p) for p in pieces))
        self.cut = re.compile(rf"(?= )(?<=\S)|(?=[{re.escape(marks)}])(?<=[{LETTERS}])" if marks else r"(?= )(?<=\S)")
        self.words = Words(self._words)

    def _words(self, words: list[str]) -> list:
        """Codes of parts of a text, A ids and then marked B ids; None where the tokens' bytes are not the part's.

        A part that begins with a space is encoded by B as the text after it, since B adds one; the others stand behind a
        letter that is encoded by itself, and are encoded behind it.
        """
        out, space, lead = [], [self.b.piece_to_id("▁")], self.b.encode("a")
        every = self.b.encode([w[1:] if w[0] == " " else "a" + w for w in words], num_threads=1)
        for word, a, b in zip(words, self.a.encode_batch_fast(words, add_special_tokens=False), every):
            if word[0] != " ":
                b = b[len(lead) :] if b[: len(lead)] == lead else []
            raw, a, b = word.encode(), a.ids, b or space  # the library gives an empty text no space
            same = b"".join([self.bytes_a[k] for k in a]) == raw and b"".join([self.bytes_b[k] for k in b]) == raw
            out.append(code(a) + code([k | _B for k in b]) if same else None)
        return out

    def encode(self, texts: list[str]):
        """(A ids, their number by text, B ids, their number by text); texts that do not come back have none."""
        import numpy as np

        parts = [self.cut.split(" " + t) if t else [] for t in texts]
        values, at = self.words.values([w for p in parts for w in p]), 0
        for k, part in enumerate(parts):
            if None in values[at : at + len(part)]:
                values[at : at + len(part)] = [b""] * len(part)
            at += len(part)
        ids, sizes = flat(values)
        of_b = ids >= _B
        n, n_b = (sums(x, np.fromiter(map(len, parts), np.int64, len(parts))) for x in (sizes, sums(of_b, sizes)))
        return ids[~of_b].astype(np.int64), n - n_b, (ids[of_b] & np.uint32(_B - 1)).astype(np.int64), n_b


@lru_cache(maxsize=2)
def pair(path_a: str, path_b: str) -> Pair:
    """Per Python worker."""
    return Pair(path_a, path_b)


@dataclass
class Aligned:
    """Texts' tokens (ids, number by text, first byte, size) and groups; `group_of_*` by token, `text_of` by group, overlaps as (A token, B token)."""

    a: object
    b: object
    n_a: object
    n_b: object
    start_a: object
    start_b: object
    group_a: object
    group_b: object
    text_of: object
    overlaps: object


def align_texts(texts: list[str], tokens: Pair) -> Aligned:
    import numpy as np

    a, n_a, b, n_b = tokens.encode(texts)
    size_a, size_b = tokens.size_a[a], tokens.size_b[b]
    own_a, own_b = np.repeat(np.arange(len(a), dtype=np.int32), size_a), np.repeat(np.arange(len(b), dtype=np.int32), size_b)
    new_a, new_b = (np.diff(own, prepend=np.int32(-1)) != 0 for own in (own_a, own_b))
    both = np.flatnonzero(new_a | new_b)
    group = np.cumsum(new_a & new_b) - 1
    start_a, start_b = np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b
    text = np.repeat(np.arange(len(texts)), n_a)
    group_a, group_b = group[start_a], group[start_b]
    text_of = np.zeros(int(group[-1]) + 1 if len(group) else 0, np.int64)
    text_of[group_a] = text
    return Aligned(a, b, n_a, n_b, start_a, start_b, group_a, group_b, text_of, (own_a[both], own_b[both]))


def linked(x: Aligned):
    """(text, A id << 32 | B id, times): links by text and pair of ids, a pair of a group once with its number of links."""
    import numpy as np

    sides = []
    for ids, group in ((x.a, x.group_a), (x.b, x.group_b)):
        keys, times = np.unique(group << 32 | ids, return_counts=True)
        sides.append((keys >> 32, keys & 0xFFFFFFFF, times, np.bincount(keys >> 32, minlength=len(x.text_of))))
    (group, a, times_a, _), (_, b, times_b, each) = sides
    first = np.cumsum(each) - each
    more = each[group]
    left = np.repeat(np.arange(len(a)), more)
    right = np.arange(len(left)) - np.repeat(np.cumsum(more) - more, more) + np.repeat(first[group], more)
    return x.text_of[group[left]], a[left] << 32 | b[right], times_a[left] * times_b[right]


def group_texts(x: Aligned, tokens: Pair) -> list[str]:
    """By text, `a1,a2|b1;a3|b2`: the ids of each group."""
    import numpy as np

    groups = len(x.text_of)
    n_a, n_b = np.bincount(x.group_a, minlength=groups), np.bincount(x.group_b, minlength=groups)
    last_a, last_b = np.zeros(len(x.a), np.int64), np.zeros(len(x.b), np.int64)
    last_a[np.cumsum(n_a) - 1] = last_b[np.cumsum(n_b) - 1] = 1
    said = np.zeros(len(x.a) + len(x.b), np.int64)
    said[np.arange(len(x.a)) + (np.cumsum(n_b) - n_b)[x.group_a]] = 2 * x.a + last_a
    said[np.arange(len(x.b)) + np.cumsum(n_a)[x.group_b]] = 2 * x.b + last_b + len(tokens.of_a)
    words, begin, out = tokens.of_a + tokens.of_b, 0, []
    for n in (x.n_a + x.n_b).tolist():
        out.append("".join(map(words.__getitem__, said[begin : begin + n].tolist()))[:-1])
        begin += n
    return out


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: id, a and b (array<struct<id, start, end>>, bytes of a space and the text), overlaps and groups (of token places)."""
    token = "array<struct<id:int,start:long,end:long>>"
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, a {token}, b {token}, overlaps array<struct<a:int,b:int>>, groups array<struct<a_from:int,a_to:int,b_from:int,b_to:int>>"

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            tokens = pair(path_a, path_b)
            for lo, texts in bpe.parts(batch.column(1)):
                rows = []
                for text in texts:
                    x = align_texts([text], tokens)
                    spans = [[{"id": i, "start": s, "end": s + n} for i, s, n in zip(ids.tolist(), start.tolist(), size[ids].tolist())] for ids, start, size in ((x.a, x.start_a, tokens.size_a), (x.b, x.start_b, tokens.size_b))]
                    edges = [np.searchsorted(g, np.arange(len(x.text_of) + 1)).tolist() for g in (x.group_a, x.group_b)]
                    groups = [dict(zip(("a_from", "a_to", "b_from", "b_to"), g)) for g in zip(edges[0], edges[0][1:], edges[1], edges[1][1:])]
                    rows.append((*spans, [{"a": i, "b": j} for i, j in zip(*(o.tolist() for o in x.overlaps))], groups))
                kinds = [batch.schema.field(0).type] + [pa.list_(pa.struct([("id", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))] * 2
                kinds += [pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])), pa.list_(pa.struct([(n, pa.int32()) for n in ("a_from", "a_to", "b_from", "b_to")]))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds[1:]))], ["id", "a", "b", "overlaps", "groups"])

    read = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return read.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def _blocks(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str, block: int) -> DataFrame:
    """Documents with their places in the block's list of pairs, and one row a block (pairs not null) with that list."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"block long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places array<int>, times array<long>, pairs array<long>, held array<long>"

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            tokens = pair(path_a, path_b)
            for lo, texts in bpe.parts(batch.column(1), block):
                x, n = align_texts(texts, tokens), len(texts)
                text, pairs, times = linked(x)
                known, place = np.unique(pairs, return_inverse=True)
                keys, where = np.unique(text * len(known) + place, return_inverse=True)  # of a text and a pair
                total = np.zeros(len(keys), np.int64)
                np.add.at(total, where, times)
                text, place = keys // max(len(known), 1), keys % max(len(known), 1)
                links = np.zeros(n, np.int64)
                np.add.at(links, text, total)
                sha = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in group_texts(x, tokens)]
                edges = np.searchsorted(text, np.arange(n + 1)).astype(np.int32)
                lists = lambda values: pa.ListArray.from_arrays(pa.array(edges), values)
                held = np.bincount(place, minlength=len(known))
                none = lambda t: pa.nulls(n, t)
                names = ["block", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "places", "times", "pairs", "held"]
                longs = pa.list_(pa.int64())
                counts = [pa.array(c, pa.int64()) for c in (np.full(n, number), x.n_a, x.n_b, np.bincount(x.text_of, minlength=n), links)]
                yield pa.RecordBatch.from_arrays([counts[0], batch.column(0).slice(lo, n), *counts[1:], pa.array(sha), lists(pa.array(place, pa.int32())), lists(pa.array(total)), none(longs), none(longs)], names)
                one = [pa.array([number], pa.int64()), *(pa.nulls(1, batch.schema.field(0).type if k == 0 else pa.int64()) for k in range(5)), pa.nulls(1, pa.string()), pa.nulls(1, pa.list_(pa.int32())), pa.nulls(1, longs)]
                yield pa.RecordBatch.from_arrays([*one, pa.array([known], longs), pa.array([held], longs)], names)
                number += 1

    read = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return read.mapInArrow(run, schema)


def linked_counts(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per text: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    n_best: links whose pair of ids is held by as many documents as any of its A id; count_sum: documents that hold a
    link's pair, added up over links.
    """
    spark, since = docs.sparkSession, mark()
    blocks = written(_blocks(docs, path_a, path_b, id_col, text_col, block), "aligned", ROWS)
    by_block = blocks.where("pairs IS NOT NULL").select("block", F.posexplode(F.arrays_zip("pairs", "held")).alias("place", "own")).select("block", "place", "own.pairs", "own.held")
    counted = by_block.groupBy("pairs").agg(F.sum("held").alias("n"))
    top = F.max("n").over(Window.partitionBy(F.shiftright("pairs", 32)))
    counted = written(counted.select("pairs", "n", (F.col("n") == top).alias("best")), "counted")
    back = by_block.select("block", "place", "pairs").join(counted, "pairs").select(F.col("block").alias("own_block"), "place", "n", "best")
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def run(own, looked):
        import numpy as np
        import pyarrow as pa

        n, best = np.zeros(looked.num_rows, np.int64), np.zeros(looked.num_rows, np.int64)
        place = looked.column("place").to_numpy()
        n[place], best[place] = looked.column("n").to_numpy(), looked.column("best").to_numpy()
        own = own.combine_chunks()
        size = own.column("places").combine_chunks().value_lengths().to_numpy() if own.num_rows else np.zeros(0, np.int64)
        places, times = (own.column(c).combine_chunks().flatten().to_numpy() for c in ("places", "times"))
        added = [pa.array(sums(values[places] * times, size)) for values in (best, n)]
        columns = [own.column(c) for c in ("id", "n_a", "n_b", "n_groups", "n_links")]
        return pa.Table.from_arrays([*columns, *added, own.column("groups_sha256")], names=[f.split()[0] for f in schema.split(", ")])

    texts = blocks.where("pairs IS NULL").drop("pairs", "held")
    out = texts.groupBy("block").cogroup(back.groupBy("own_block")).applyInArrow(run, schema)
    tidy(spark, since, "aligned", "counted")
    return out.withColumnRenamed("id", id_col)
