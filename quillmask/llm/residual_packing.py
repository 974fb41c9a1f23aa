"""Best-fit packing in rounds: partitions pack locally, nearly full bins are done, underfull bins are the next round's items.

1. Each partition of documents is one narrow pass: texts become ids by the library, documents beyond `capacity` are cut
   into pieces of that many ids, and every `block` pieces are packed by best fit in order of decreasing length.
2. Bins with room for `slack` ids at most are done.  The others are items of their fill: they are dealt into groups of
   `group` at most and packed again, group by group, into larger bins, of which those nearly full are done again.  Groups
   become fewer from round to round, down to one, or until a round joins hardly any bins.
3. Rounds only carry (bin, fill).  Each is written, so a lost executor repeats its own part and gets the same bins.  The
   way of a first bin through the rounds is put together from these small tables and joined to its pieces once.

Null and empty texts are documents of the end id alone.  Repeated rows are packed one by one, a null id stays null, equal
lengths go in their stored order.  Texts of any length are encoded whole.  An empty table gives no rows; extra columns are
not looked at, so their names cannot clash.  A tokenizer file must drop white space, as word tokenizers do: texts are
cut there, and words that come again are not encoded again.  Other files raise ValueError.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmask.llm import bpe
from quillmask.llm.common import mark, tidy, written
from quillmask.llm.words import LETTERS, MARKS, Known, code, flat, tokenizer

CAPACITY, END_ID, SLACK = 4096, 1, 8
#: pieces that are packed at once in a partition; bins that are packed at once in a group
BLOCK, GROUP = 200_000, 100_000
#: rounds end when they leave more than this share of the bins
GAIN = 0.99
#: Python functions get so many texts at once
ROWS = 1_000


def best_fit(sizes, capacity: int = CAPACITY):
    """(bin, offset) by item and fill by bin: items by decreasing size, each into the fullest bin that has room."""
    import numpy as np

    sizes = np.asarray(sizes, np.int64)
    where, offset, fill = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by the room they have
    some = 0  # a bit for each room that a bin has
    for k in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[k])
        if above := some >> n:
            room = n + (above & -above).bit_length() - 1
            at = rooms[room].pop()
            if not rooms[room]:
                some ^= 1 << room
        else:
            room, at = capacity, len(fill)
            fill.append(0)
        where[k], offset[k] = at, fill[at]
        fill[at] += n
        if left := room - n:
            rooms[left].append(at)
            some |= 1 << left
    return where, offset, np.array(fill, np.int64)


_MARK = re.compile(f"[{MARKS}](?<=[{LETTERS}].)")
#: what a file says whose words of letters alone are lowered and go to BPE byte by byte
_LOWERED = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_LETTER_RUNS = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_BY_BYTE = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
_PLAIN = re.compile(f"[{LETTERS}]+")


class _Encoder:
    """Codes of texts: the ids of a word are looked up, and made by the library where the word is not known.

    Of words of plain letters only BPE is asked for, as the other steps do no more to them than lower them: these letters
    are composed, and a run of them is one pre-token.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
        self.lowers = (
            (spec.get("normalizer") or {}).get("normalizers") == _LOWERED and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
            and len(steps) == 2 and steps[0].get("pattern", {}).get("Regex") == _LETTER_RUNS and _BY_BYTE.items() <= steps[1].items()
        )
        self.special = [t["content"].lower() for t in spec.get("added_tokens", [])]
        self.lowers = self.lowers and not any(_PLAIN.fullmatch(s) for s in self.special)
        self.own, self.stand_in = tokenizer(path), {byte: c for c, byte in bpe.byte_alphabet().items()}
        self.bpe, self.words = self.own.model, Known(self._word)

    def _word(self, word: str) -> bytes:
        if self.lowers and _PLAIN.fullmatch(word):
            word = word.lower()
            if not word.isascii():
                word = word.encode().decode("latin-1").translate(self.stand_in)
            return code([t.id for t in self.bpe.tokenize(word)])
        return code(self.own.encode_batch_fast([word], add_special_tokens=False)[0].ids)

    def _lower(self, text: str) -> str:
        """A to Z lowered, so that a word is known in either case; not in texts beyond Latin-1, whose marks may be composed with the letter before, nor where a special string would come of it."""
        if not self.lowers:
            return text
        try:
            low = text.encode("latin-1").lower().decode("latin-1")
        except UnicodeEncodeError:
            return text
        return text if any(s in low for s in self.special) else low

    def codes(self, texts: list[str]) -> list[bytes]:
        known = self.words.__getitem__
        cut = (_MARK.sub(r" \g<0>", self._lower(t)).replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts)
        return [b"".join(map(known, words)) for words in cut]


@lru_cache(maxsize=2)
def _encoder(path: str) -> _Encoder:
    """Per Python worker."""
    return _Encoder(path)


def _drops_space(path: str) -> bool:
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    pattern = first.get("pattern", {}).get("Regex", "")
    whole = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["content"].split() != [t["content"]] for t in spec.get("added_tokens", []))
    return whole and spec.get("post_processor") is None and first.get("behavior") == "Removed" and first.get("invert") is True and "[^\\s" in pattern and " " not in pattern and "\\s+" not in pattern


def encode(texts: list[str], path: str):
    """(all ids, number of ids by text)."""
    return flat(_encoder(path).codes(texts))


def _pieces(docs: DataFrame, path: str, id_col: str, text_col: str, capacity: int, end_id: int, slack: int, block: int) -> DataFrame:
    """Pieces and the bins of their partition: id, piece, start, length, ids_crc32, bin, offset, fill, done."""
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long"

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        names = ["id", "piece", "start", "length", "ids_crc32", "bin", "offset", "fill"]
        first, held, kind, last = TaskContext.get().partitionId() << 36, [], None, code([end_id])

        def packed():
            nonlocal first
            ids, piece, start, length, crc = zip(*held)
            held.clear()
            where, offset, fill = best_fit(length, capacity)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, kind), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc)), pa.array(where + first), pa.array(offset), pa.array(fill[where])], names
            )
            first += len(fill)

        for batch in batches:
            kind = batch.schema.field(0).type
            keys = batch.column(0).to_pylist()
            for lo, texts in bpe.parts(batch.column(1)):
                for k, own in enumerate(_encoder(path).codes(texts)):
                    own += last
                    for piece, at in enumerate(range(0, len(own) // 4, capacity)):
                        part = own[4 * at : 4 * (at + capacity)]
                        held.append((keys[lo + k], piece, at, len(part) // 4, zlib.crc32(part)))
                    if len(held) >= block:
                        yield from packed()
        if held:
            yield from packed()

    read = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return read.mapInArrow(run, schema).withColumn("done", F.col("fill") >= capacity - slack)


def _round(bins: DataFrame, number: int, groups: int, capacity: int) -> DataFrame:
    """bin, parent, offset, fill (of the parent): bins packed into larger ones, group by group."""

    def run(key, table):
        import numpy as np
        import pyarrow as pa

        bins, fill = (table.column(c).to_numpy() for c in ("bin", "fill"))
        order = np.argsort(bins)  # rows come in any order: a repeated task must give the same
        bins, fill = bins[order], fill[order]
        where, offset, full = best_fit(fill, capacity)
        return pa.table({"bin": bins, "parent": where + ((number << 57) | (int(table.column("part")[0].as_py()) << 32)), "offset": offset, "fill": full[where]})

    dealt = bins.withColumn("part", F.pmod(F.xxhash64("bin", F.lit(number)), F.lit(groups)).cast("int"))
    return dealt.groupBy("part").applyInArrow(run, "bin long, parent long, offset long, fill long")


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, slack: int = SLACK, block: int = BLOCK, group: int = GROUP,
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    if not _drops_space(tokenizer):
        raise ValueError(f"{tokenizer}: not a tokenizer that drops white space")
    spark, since = docs.sparkSession, mark()
    pieces = written(_pieces(docs, tokenizer, id_col, text_col, capacity, end_id, slack, block), "fitted", ROWS)
    bins = written(pieces.where("offset = 0 AND NOT done").select("bin", "fill"), "bins")
    way, left, number = None, bins.count(), 0
    while left > 1:
        number, groups = number + 1, max(1, math.ceil(left / group))
        step = written(_round(bins, number, groups, capacity), "round")
        bins = step.where((F.col("offset") == 0) & (F.col("fill") < capacity - slack)).select(F.col("parent").alias("bin"), "fill")
        if way is None:
            way = step.select("bin", F.col("parent").alias("top"), F.col("offset").alias("below"))
        else:
            later = step.select(F.col("bin").alias("top"), "parent", "offset")
            way = written(way.join(later, "top", "left").select("bin", F.coalesce("parent", "top").alias("top"), (F.col("below") + F.coalesce("offset", F.lit(0))).alias("below")), "way")
        before, left = left, bins.count()
        if groups == 1 or left > GAIN * before:
            break
    columns = [F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32"]
    if way is None:
        return pieces.select(*columns, F.col("bin").alias("sequence_id"), "offset")
    moved = pieces.where("NOT done").join(way, "bin", "left").select(*columns, F.coalesce("top", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("below", F.lit(0))).alias("offset"))
    out = pieces.where("done").select(*columns, F.col("bin").alias("sequence_id"), "offset").unionByName(moved)
    tidy(spark, since, "fitted", "round", "way")
    return out
