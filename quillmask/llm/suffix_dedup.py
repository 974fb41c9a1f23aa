"""Removal of byte strings that repeat across documents, by bounded interval expansion on a Burrows-Wheeler transform.

A byte goes if a string of `length` bytes covers it that also starts in a document of smaller id.

1. Texts that equal one of a smaller id as a whole need no search.  The others are dealt to blocks of a megabyte or two by
   their ids.  In a block every window of `length` bytes has an
   anchor, its k-gram of smallest hash; windows in a row with one anchor form a fragment.  Equal windows have equal
   anchors, at equal places.
2. Blocks send their different anchor hashes to buckets, which answer with those that occur in two documents.
3. Fragments of such anchors meet in buckets by anchor, once a block for equal ones (the smallest id stands for all).
   Anchors with more than `hot` different fragments are split further: their windows go by their own hash.
4. In a bucket equal fragments need no search.  The others are searched with a Burrows-Wheeler transform of their
   concatenation: starting with the interval of the empty string, intervals are extended backwards breadth first,
   which yields common prefixes of neighbours by increasing value; it stops at `length`.  Neighbours without a value then
   share `length` bytes or more, and runs of them are the classes of equal windows.
5. Blocks get the ranges to remove and make the results.

Fragments are equal where their bytes are; rolling hashes only choose anchors and deal work.  Whole texts are equal where their
SHA-256 is.  A block has a row for each
bucket that its anchors occur in, so rows grow with blocks times buckets until there are fewer anchors.  Null texts are empty.
Rows with one id are one document's for "smaller id", but have a row each.  Rows with a null id keep their text.  Extra
columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmask.llm import pieces
from quillmask.llm.common import written

LENGTH, GRAM, HOT = 50, 24, 512
BLOCK_BYTES = 1_500_000
#: places in a block have so many bits beside a hash
_LOW = (1 << 34) - 1
#: bytes that are searched at once
SEARCH = 600_000

_KEPT: dict = {}


def _powers(n: int):
    """Powers of an odd base and of its inverse modulo 2**64, kept between blocks."""
    size = 1 << max(16, n.bit_length())
    if _KEPT.get("n", 0) < size:
        base = 0xD1342543DE82EF95
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _KEPT.update(n=size, up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
    return _KEPT["up"], _KEPT["down"]


class _Hashes:
    """Rolling hashes of any ranges of a byte string.  Equal ranges have equal hashes; the other way round nothing rests on it."""

    def __init__(self, data):
        table = pieces.scramble((np.arange(256, dtype=np.uint64) + np.uint64(11)) * np.uint64(0x94D049BB133111EB))
        up, self.down = _powers(len(data) + 1)
        self.sum = np.concatenate((np.zeros(1, np.uint64), np.cumsum(table[data] * up[: len(data)], dtype=np.uint64)))

    def of(self, lo, hi):
        return pieces.scramble((self.sum[hi] - self.sum[lo]) * self.down[lo])

    def grams(self, n: int, size: int):
        return pieces.scramble((self.sum[size : n + 1] - self.sum[: n + 1 - size]) * self.down[: n + 1 - size])


class _Block:
    """Texts of a block in one byte string, in order of id and text."""

    def __init__(self, ids, texts):
        order = sorted(range(len(ids)), key=lambda k: (ids[k], texts[k]))
        self.ids = np.array([ids[k] for k in order], np.int64)
        self.texts = [texts[k] for k in order]
        self.raw = b"".join(self.texts)
        self.data = np.frombuffer(self.raw, np.uint8)
        self.ends = np.cumsum([len(t) for t in self.texts]).astype(np.int64)
        self.begins = self.ends - np.array([len(t) for t in self.texts], np.int64)

    def fragments(self, length: int, gram: int):
        """(hashes, anchor hash, first window, last window + 1, document) of each fragment."""
        n = len(self.data)
        hashes = _Hashes(self.data)
        none = np.zeros(0, np.int64)
        if n < length:
            return hashes, np.zeros(0, np.uint64), none, none, none
        grams = hashes.grams(n, gram)
        low = (grams & np.uint64(~_LOW & (1 << 64) - 1)) | np.arange(len(grams), dtype=np.uint64)
        width, have = length - gram + 1, 1
        while have * 2 <= width:  # minimum over twice as many
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        if have < width:
            low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
        anchor = (low & np.uint64(_LOW)).astype(np.int64)  # of the window that starts here
        document = np.repeat(np.arange(len(self.ends)), self.ends - self.begins)[: len(anchor)]
        valid = np.arange(len(anchor)) + length <= self.ends[document]
        new = np.ones(len(anchor), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (document[1:] != document[:-1]) | (valid[1:] != valid[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(anchor))
        keep = valid[first]
        first, last = first[keep], last[keep]
        return hashes, grams[anchor[first]], first, last, document[first]



def _without(docs, copies):
    """(a block's documents to search, those that repeat a whole text of smaller id); rows with null ids are in neither."""
    docs = docs[docs.id.notna()]
    known = {x for part in copies for x in part}
    if not known:
        return docs, docs.iloc[:0]
    again = [(int(i), hashlib.sha256(t).digest()) in known for i, t in zip(docs.id, docs.text)]
    return docs[[not a for a in again]], docs[again]


def _named(copies):
    return [[(int(c["id"]), bytes(c["key"])) for c in part] for part in copies if part is not None]


def _short(anchor):
    """Within its bucket an anchor is known by 32 bits: whether it is shared is a filter, so a chance equality costs only work."""
    return ((anchor >> np.uint64(29)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _by_bucket(bucket):
    """(bucket, places of its members) of the buckets that occur."""
    order = np.argsort(bucket, kind="stable")
    edge = np.flatnonzero(np.diff(bucket[order])) + 1
    if len(order):
        for part in np.split(order, edge):
            yield int(bucket[part[0]]), part


def _anchors(docs, copies, length: int, gram: int, buckets: int):
    """Different anchors of a block by bucket, with how many different fragments each has (up to 255; 128 more: in two documents)."""
    import pandas as pd

    pdf, _ = _without(docs, _named(copies.gone))
    block = _Block(pdf.id.tolist(), pdf.text.tolist())
    hashes, anchor, first, last, document = block.fragments(length, gram)
    out = []
    if len(anchor):
        order = np.lexsort((hashes.of(first, last + (length - 1)), anchor))
        anchor, content, owner = anchor[order], hashes.of(first, last + (length - 1))[order], block.ids[document[order]]
        new = np.concatenate(([True], anchor[1:] != anchor[:-1]))
        at = np.flatnonzero(new)
        kinds = np.add.reduceat((new | np.concatenate(([True], content[1:] != content[:-1]))).astype(np.int64), at)
        many = np.minimum.reduceat(owner, at) != np.maximum.reduceat(owner, at)
        anchor = anchor[at]
        count = (np.minimum(kinds, 127) + 128 * many).astype(np.uint8)
        number = docs.block.iloc[0]
        for b, part in _by_bucket(anchor % np.uint64(buckets)):
            out.append((b, number, _short(anchor[part]).tobytes(), count[part].tobytes()))
    return pd.DataFrame(out, columns=["bucket", "block", "hashes", "counts"])


def _shared(pdf, hot: int):
    """Anchors of a bucket that occur in two documents or blocks, by block; hot ones marked."""
    import pandas as pd

    blocks, sizes = pdf.block.to_numpy(), np.array([len(c) for c in pdf.counts])
    hashes, counts = np.frombuffer(b"".join(pdf.hashes), np.uint32), np.frombuffer(b"".join(pdf.counts), np.uint8)
    order = np.argsort(hashes, kind="stable")
    at = np.flatnonzero(np.concatenate(([True], hashes[order][1:] != hashes[order][:-1])))
    runs = np.diff(np.append(at, len(order)))
    good = (runs > 1) | (np.maximum.reduceat(counts[order], at) >= 128)
    many = np.add.reduceat((counts[order] & 127).astype(np.int64), at) > hot
    mark = np.empty(len(order), np.uint8)
    mark[order] = np.repeat(good * (1 + many), runs)
    out, edges = [], np.concatenate(([0], np.cumsum(sizes)))
    for k in range(len(blocks)):
        own = slice(int(edges[k]), int(edges[k + 1]))
        chosen = mark[own] > 0
        if chosen.any():
            out.append((blocks[k], pdf.bucket.iloc[0], hashes[own][chosen].tobytes(), mark[own][chosen].tobytes()))
    return pd.DataFrame(out, columns=["block", "bucket", "hashes", "marks"])


def _candidates(docs, answers, length: int, gram: int, known_by: int, buckets: int):
    """Fragments that may repeat elsewhere, by bucket; ranges that repeat within the block go along."""
    import pandas as pd

    columns = ["bucket", "block", "anchors", "ids", "sizes", "bytes", "owners", "starts", "ranges"]
    docs, _ = _without(docs, _named(answers.gone))
    answers = answers[answers.hashes.notna()]
    if not len(docs) or not len(answers):
        return pd.DataFrame([], columns=columns)
    block = _Block(docs.id.tolist(), docs.text.tolist())
    hashes, anchor, first, last, document = block.fragments(length, gram)
    known = np.concatenate([np.frombuffer(h, np.uint32).astype(np.uint64) | np.uint64(int(b) << 32) for b, h in zip(answers.bucket, answers.hashes)])
    mark = np.frombuffer(b"".join(answers.marks), np.uint8)
    order = np.argsort(known)
    known, mark = known[order], mark[order]
    name = _short(anchor).astype(np.uint64) | (anchor % np.uint64(known_by)) << np.uint64(32)
    at = np.minimum(np.searchsorted(known, name), len(known) - 1)
    got = np.where(known[at] == name, mark[at], 0)
    keep = got > 0
    anchor, first, last, document, got = anchor[keep], first[keep], last[keep], document[keep], got[keep]
    # windows of hot anchors on their own
    split = got == 2
    n = (last - first)[split]
    lone = np.repeat(first[split], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    first = np.concatenate((first[~split], lone))
    last = np.concatenate((last[~split], lone + 1))
    document = np.concatenate((document[~split], np.repeat(document[split], n)))
    route = np.concatenate((anchor[~split], hashes.of(lone, lone + length)))
    stop = last + length - 1
    owner = block.ids[document]
    _, which = pieces.distinct(pieces.buffer(block.raw), first, stop - first)  # compared byte by byte
    order = np.lexsort((first, owner, which))
    first, stop, document, route, owner, which = (x[order] for x in (first, stop, document, route, owner, which))
    new = np.concatenate(([True], which[1:] != which[:-1])) if len(first) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    lowest = owner == owner[at][group] if len(at) else np.zeros(0, bool)
    begin = first - block.begins[document] if len(first) else first
    ranges = np.stack((document[~lowest], begin[~lowest], begin[~lowest] + (stop - first)[~lowest]), axis=1).astype(np.int32) if len(first) else np.zeros((0, 3), np.int32)
    number, out = docs.block.iloc[0], []
    out.append((int(number % buckets), number, b"", b"", b"", b"", b"", b"", ranges.tobytes()))
    bucket = (route[at] % np.uint64(buckets)).astype(np.int64)
    # occurrences in the lowest document, by group
    spots = np.flatnonzero(lowest)
    spot_cut = np.searchsorted(group[spots], np.arange(len(at) + 1))
    raw = block.raw
    for b, part in _by_bucket(bucket):
        lo, hi = first[at[part]].tolist(), stop[at[part]].tolist()
        where = np.concatenate([spots[spot_cut[g] : spot_cut[g + 1]] for g in part])
        times = (spot_cut[part + 1] - spot_cut[part]).astype(np.int32)
        flat = np.stack((document[where], begin[where]), axis=1).astype(np.int32)
        out.append((b, number, (route[at[part]] >> np.uint64(32)).astype(np.uint32).tobytes(), owner[at[part]].tobytes(), np.array([y - x for x, y in zip(lo, hi)], np.uint16).tobytes(), b"".join(raw[x:y] for x, y in zip(lo, hi)), times.tobytes(), flat.tobytes(), b""))
    return pd.DataFrame(out, columns=columns)


def transform(text):
    """(suffix array, Burrows-Wheeler transform, LF mapping) of the cyclic shifts of integers 0 to 256."""
    n = len(text)
    rank, have = text.astype(np.int64), 1
    if n >= 8:
        rank, have = np.zeros(n, np.int64), 7
        for k in range(7):
            rank = (rank << 9) | np.roll(text, -k)
    while True:
        order = np.argsort(rank, kind="stable")
        ranked = rank[order]
        step = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1])))
        dense = np.empty(n, np.int64)
        dense[order] = step
        if step[-1] == n - 1 or have >= n:
            break
        rank = dense * n + np.roll(dense, -have)
        have *= 2
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = order - 1
    return order, text[before], place[before]


def common_prefixes(bwt, lf, stop: int):
    """Common prefix of each shift and the one before it, by increasing value up to stop - 1; -1 where it is stop or more.

    Breadth first: level l holds intervals of strings of l symbols whose right end was found at the level before.
    """
    n = len(bwt)
    lcp = np.full(n + 1, -1, np.int16)
    lcp[0] = lcp[n] = 0
    lo, hi = np.array([0]), np.array([n])
    owner = np.full(n + 1, -1, np.int64)
    first_symbol = np.sort(bwt)
    for level in range(stop):
        size = hi - lo
        index = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
        to = lf[index]
        owner[to] = np.repeat(np.arange(len(lo)), size)
        to.sort()
        own, symbol = owner[to], first_symbol[to]
        edge = np.ones(len(to), bool)  # the last shift of an extended interval
        edge[:-1] = (to[1:] != to[:-1] + 1) | (own[1:] != own[:-1]) | (symbol[1:] != symbol[:-1])
        end = np.flatnonzero(edge)
        begin = np.concatenate(([0], end[:-1] + 1)) if len(end) else end
        lo, hi = to[begin], to[end] + 1
        fresh = lcp[hi] < 0
        if level == 0:
            fresh |= hi == n
        lcp[hi[lcp[hi] < 0]] = level
        lo, hi = lo[fresh], hi[fresh]
        if not len(lo):
            break
    return lcp[:n]


def repeated_windows(fragments: list[bytes], ids, length: int):
    """For each fragment, a mask of its windows that also occur in a fragment of smaller id."""
    sizes = np.array([len(f) for f in fragments])
    text = np.zeros(int((sizes + 1).sum()), np.int64)
    ends = np.cumsum(sizes + 1) - 1
    body = np.ones(len(text), bool)
    body[ends] = False
    text[body] = np.frombuffer(b"".join(fragments), np.uint8).astype(np.int64) + 1
    order, bwt, lf = transform(text)
    group = np.cumsum(common_prefixes(bwt, lf, length) >= 0) - 1
    owner = np.repeat(np.arange(len(fragments)), sizes + 1)
    valid = np.arange(len(text)) + length <= ends[owner]
    doc = np.asarray(ids, np.int64)[owner]
    low = np.full(group[-1] + 1, np.iinfo(np.int64).max)
    inside = valid[order]
    np.minimum.at(low, group[inside], doc[order][inside])
    hit = np.zeros(len(text), bool)
    hit[order] = inside & (low[group] < doc[order])
    starts = ends - sizes
    return [hit[s : s + n - length + 1] for s, n in zip(starts.tolist(), sizes.tolist())]


def _search(pdf, length: int):
    """Ranges to remove, by block, from a bucket's fragments."""
    import pandas as pd

    out: dict = {}
    seen: dict = {}
    for r in pdf.itertuples():
        if r.ranges:
            out.setdefault(r.block, []).append(np.frombuffer(r.ranges, np.int32).reshape(-1, 3))
        if not r.ids:
            continue
        sizes = np.frombuffer(r.sizes, np.uint16).tolist()
        cut = np.cumsum(np.frombuffer(r.owners, np.int32), dtype=np.int64).tolist()
        spots, lo, at = np.frombuffer(r.starts, np.int32).reshape(-1, 2), 0, 0
        for anchor, doc, n, stop in zip(np.frombuffer(r.anchors, np.uint32).tolist(), np.frombuffer(r.ids, np.int64).tolist(), sizes, cut):
            seen.setdefault(anchor, {}).setdefault(r.bytes[lo : lo + n], []).append((doc, r.block, spots[at:stop]))
            lo, at = lo + n, stop

    def remove(block, spots, lo: int, hi: int):
        out.setdefault(block, []).append(np.column_stack((spots[:, 0], spots[:, 1] + lo, spots[:, 1] + hi)))

    batch: list = []

    def search():
        masks = repeated_windows([f for f, _, _ in batch], [d for _, d, _ in batch], length)
        for (_, _, places), mask in zip(batch, masks):
            if mask.any():
                edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
                for lo, hi in edge.reshape(-1, 2).tolist():
                    for block, spots in places:
                        remove(block, spots, lo, hi + length - 1)

    size = 0
    for fragments in seen.values():
        for text, found in fragments.items():
            low = min(doc for doc, _, _ in found)
            for doc, block, spots in found:
                if doc > low:
                    remove(block, spots, 0, len(text))
            if len(fragments) > 1:
                batch.append((text, low, [(b, s) for d, b, s in found if d == low]))
                size += len(text) + 1
        if size >= SEARCH:
            search()
            batch, size = [], 0
    if batch:
        search()
    return pd.DataFrame([(b, np.concatenate(v).astype(np.int32).tobytes()) for b, v in out.items()], columns=["block", "ranges"])


def _results(docs, found, length: int, keep_text: bool):
    """A row per text of a block."""
    import pandas as pd

    lost = docs[docs.id.isna()]
    docs, again = _without(docs, _named(found.gone))
    found = found[found.ranges.notna()]
    block = _Block(docs.id.tolist(), docs.text.tolist())
    change = np.zeros(len(block.data) + 1, np.int32)
    if len(found) and len(block.ids):
        ranges = np.frombuffer(b"".join(found.ranges), np.int32).reshape(-1, 3)
        base = block.begins[ranges[:, 0]]
        np.add.at(change, base + ranges[:, 1], 1)
        np.add.at(change, base + ranges[:, 2], -1)
    gone = np.cumsum(change[:-1]) > 0
    out = []
    for doc, text, lo, hi in zip(block.ids.tolist(), block.texts, block.begins.tolist(), block.ends.tolist()):
        mask = gone[lo:hi]
        removed = int(mask.sum())
        kept = block.data[lo:hi][~mask].tobytes() if removed else text
        spans = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum()) if removed else 0
        out.append((doc, len(text), removed, spans, hashlib.sha256(kept).hexdigest(), *([kept] if keep_text else [])))
    nothing = hashlib.sha256(b"").hexdigest()
    for doc, t in zip(again.id.tolist(), again.text.tolist()):
        whole = len(t) >= length
        out.append((doc, len(t), len(t) * whole, int(whole), nothing if whole else hashlib.sha256(t).hexdigest(), *([b"" if whole else t] if keep_text else [])))
    out += [(None, len(t), 0, 0, hashlib.sha256(t).hexdigest(), *([t] if keep_text else [])) for t in lost.text]
    frame = pd.DataFrame(out, columns=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + keep_text])
    frame["id"] = frame["id"].astype("Int64")
    return frame


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT, block_bytes: int = BLOCK_BYTES, keep_text: bool = False) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes, if asked for).

    The texts are shuffled once, by block; the three steps over them read the same exchange.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("text"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(8, -(-total // block_bytes))
    buckets, anchor_buckets = max(8, blocks // 4), max(8, blocks // 16)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("long"))
    keyed = rows.where("id IS NOT NULL").select("block", "id", F.unhex(F.sha2("text", 256)).alias("key"))
    lowest = written(keyed.groupBy("key").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "low"), "lowest")
    again = keyed.join(lowest, "key").where("id <> low").select("block", F.struct("id", "key").alias("c")).distinct()
    copies = written(again.groupBy("block").agg(F.collect_list("c").alias("gone")), "copies")
    none = lambda *names: [F.lit(None).cast("binary").alias(n) for n in names]
    anchors = rows.groupBy("block").cogroup(copies.groupBy("block")).applyInPandas(lambda a, b: _anchors(a, b, length, gram, anchor_buckets), "bucket long, block long, hashes binary, counts binary")
    answers = anchors.groupBy("bucket").applyInPandas(lambda pdf: _shared(pdf, hot), "block long, bucket long, hashes binary, marks binary")
    answers = answers.select("block", "bucket", "hashes", "marks", F.lit(None).cast(copies.schema["gone"].dataType).alias("gone")).union(copies.select("block", F.lit(None).cast("long").alias("bucket"), *none("hashes", "marks"), "gone"))
    wanted = "bucket long, block long, anchors binary, ids binary, sizes binary, bytes binary, owners binary, starts binary, ranges binary"
    candidates = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(lambda a, b: _candidates(a, b, length, gram, anchor_buckets, buckets), wanted)
    ranges = candidates.groupBy("bucket").applyInPandas(lambda pdf: _search(pdf, length), "block long, ranges binary")
    ranges = ranges.select("block", "ranges", F.lit(None).cast(copies.schema["gone"].dataType).alias("gone")).union(copies.select("block", *none("ranges"), "gone"))
    out = rows.groupBy("block").cogroup(ranges.groupBy("block")).applyInPandas(lambda a, b: _results(a, b, length, keep_text), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)
    return out.withColumnRenamed("id", id_col)
