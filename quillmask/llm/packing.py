"""Order-preserving packing of documents into fixed windows by dynamic programming.

The documents of an input partition form one stream in their stored order.  Window cuts are chosen among document
ends, sentence ends and, where a sentence is too long or padding would cost more, every `grid`-th other place, so that
the sum of padding and of penalties for cutting documents is smallest among such cuts of a block of `block` tokens:

    cost(j) = penalty(j) + min over i, 0 < j - i <= size, of cost(i) + padding(j - i)

padding(n) = 0 if n is a power of two, else size - n.  Since size - (j - i) splits into a part of i and a part of j,
the minimum over the sliding window is kept in a monotone queue, and the powers of two add one look-up each.

The sum is smallest within a block; a block's last windows are planned again with the next one.
Null and empty texts are documents of the end id alone.  Repeated rows are packed one by one.  A text of any length is
streamed through blocks of `block` tokens, whose last windows are carried into the next block, so memory does not
grow with the partition.  An empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmask.llm import bpe

SIZE, END_ID = 2048, 1
#: what cutting costs, in padding tokens
AT_SENTENCE, ANYWHERE = 4, 48
GRID = 256


def plan_cuts(places: list[int], penalties: list[int], size: int = SIZE) -> list[int]:
    """Cuts (indices of places, last included) of the cheapest windows from 0 to the last place.

    places: ascending positions, the first 0, gaps of size at most.
    """
    n = len(places)
    cost, back = [0] * n, [0] * n
    at = {p: k for k, p in enumerate(places)}
    powers = [1 << k for k in range(size.bit_length()) if 1 << k < size]
    queue: deque[int] = deque([0])
    value = [0] * n  # cost + place: what is compared in the queue
    value[0] = places[0]
    for j in range(1, n):
        p = places[j]
        while places[queue[0]] < p - size:
            queue.popleft()
        i = queue[0]
        best, came = value[i] + size - p, i
        for w in powers:
            k = at.get(p - w)
            if k is not None and cost[k] < best:
                best, came = cost[k], k
        cost[j], back[j] = best + penalties[j], came
        value[j] = cost[j] + p
        while queue and value[queue[-1]] >= value[j]:
            queue.pop()
        queue.append(j)
    out, j = [], n - 1
    while j:
        out.append(j)
        j = back[j]
    return out[::-1]


class _Stream:
    """Collects documents and gives out finished windows."""

    def __init__(self, size: int, grid: int):
        self.size, self.grid = size, grid
        self.docs: deque = deque()  # (id, first id's number in its document, ids, total)
        self.places, self.penalties = [0], [0]
        self.length = 0

    def add(self, doc_id, ids, ends, total: int, skipped: int = 0) -> None:
        """ends: ascending numbers of ids after which a sentence ends."""
        import numpy as np

        n, start = len(ids), self.length
        free = np.arange(self.grid, n, self.grid)
        kind = np.full(n + 1, -1, np.int16)
        kind[free] = ANYWHERE
        kind[ends] = AT_SENTENCE
        kind[n] = 0 if skipped + n == total else ANYWHERE
        kind[0] = -1
        where = np.flatnonzero(kind >= 0)
        self.places += (where + start).tolist()
        self.penalties += kind[where].tolist()
        self.docs.append((doc_id, skipped, ids, total))
        self.length += n

    def windows(self, last: bool):
        """Finished windows as lists of (doc_id, start, ids, total); all but the last few unless it is the end."""
        if self.length == 0:
            return
        cuts = plan_cuts(self.places, self.penalties, self.size)
        if not last:
            cuts = cuts[:-8]
        if not cuts:
            return
        began = 0
        for cut in cuts:
            need, window = self.places[cut] - began, []
            began = self.places[cut]
            while need:
                doc_id, start, ids, total = self.docs.popleft()
                take = min(need, len(ids))
                window.append((doc_id, start, ids[:take], total))
                if take < len(ids):
                    self.docs.appendleft((doc_id, start + take, ids[take:], total))
                need -= take
            yield window
        keep = cuts[-1]
        base = self.places[keep]
        self.places = [p - base for p in self.places[keep:]]
        self.penalties = [0] + self.penalties[keep + 1 :]
        self.length -= base


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = END_ID, grid: int = GRID, block: int = 1_000_000, keep_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for).

    One narrow pass: sequences are numbered within their partition, whose number stands in the upper bits, so
    nothing is shuffled and a lost task is simply run again with the same result.
    """
    packed = bpe.class_table(tokenizer)
    id_type = docs.schema[id_col].dataType.simpleString()
    part = "id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long".format(id_type)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encoder = bpe.encoder(tokenizer, packed)
        stops = np.zeros(1 << 16, bool)
        for token, number in encoder.splitter_vocab():
            stops[number] = token.endswith((b".", b"!", b"?", b"\n"))
        stream, number = _Stream(size, grid), TaskContext.get().partitionId() << 36

        def rows(last: bool):
            nonlocal number
            out = []
            for window in stream.windows(last):
                offset = 0
                for doc_id, start, ids, total in window:
                    out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, number, offset, ids))
                    offset += len(ids)
                number += 1
            if out:
                cols = list(zip(*out))
                arrays = [pa.array(cols[0], id_arrow), *(pa.array(c, pa.int64()) for c in cols[1:7])]
                if keep_ids:
                    arrays.append(pa.array([i.tolist() for i in cols[7]], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(arrays, ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: len(arrays)])

        id_arrow = None
        for batch in batches:
            id_arrow = batch.schema.field(0).type
            names = batch.column(0).to_pylist()
            for lo, texts in bpe.parts(batch.column(1)):
                flat, sizes = encoder.ids(texts)
                bounds = np.concatenate(([0], np.cumsum(sizes)))
                for k in range(len(texts)):
                    ids = np.append(flat[bounds[k] : bounds[k + 1]], np.uint32(end_id)).astype("<u4")
                    ends = np.flatnonzero(stops[np.minimum(ids[:-1], len(stops) - 1)]) + 1
                    for cut in range(0, len(ids), block):  # a document longer than a block comes in parts
                        piece = ids[cut : cut + block]
                        own = ends[(ends > cut) & (ends <= cut + len(piece))] - cut
                        stream.add(names[lo + k], piece, own, len(ids), cut)
                        if stream.length >= block:
                            yield from rows(False)
        yield from rows(True)

    read = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    out = read.mapInArrow(run, part + (", ids array<long>" if keep_ids else ""))
    return out.withColumnRenamed("id", id_col)
