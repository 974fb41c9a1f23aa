"""N-gram Jaccard self-join by set relations: which texts link at a Jaccard similarity of 3/4 of their word shingles.

1. Equal texts form classes (hash of the text); one row of each class goes on.
2. A text's set is cut to its prefix, its smallest shingle hashes: sets that link share a prefix shingle.  The prefix is
   lengthened by a few, `slack`, so that common shingles need not be looked up (step 4).
3. Inverted lists are kept in blocks in order of set size and position.
4. Lists longer than `common` are looked up only for dense texts, those whose prefix is full of common shingles: sets
   that link share l shingles of their prefixes lengthened by l - 1, so a text with fewer than l common ones in it
   finds every partner in a short list.  Dense texts are looked up among themselves by whole sets: shingles that more
   than `common` of them hold come last in their order, so a prefix leads from what is a text's own to what many share.
5. Answers of similar sets: sets are compared with the leader of their lists, the text with most of its shingles common,
   if they meet in several.  A set that links with its leader has the leader's component as its answer.  What it links
   with beyond that follows from the difference of the two: partners that share one of its own shingles stand in that
   one's short list, and partners that share none share at most its common shingles.
6. So a text stands in long lists only if its common shingles alone could make three quarters of it.  Lists are kept in
   blocks by size and by position of the shingle in the set; two blocks are skipped if sizes, positions or common
   shingles of their members cannot make a link.  Of the others, pairs whose components differ are compared, first by
   the parities of their sets.  Every link between different texts is thus checked or implied by links that were.

Lower-casing is A-Z only; words are runs of other characters than ASCII white space; a text with fewer than `width`
words is one shingle; a text without words, or null, has none and links with nothing.  Shingles are 64-bit hashes.
Rows with a null id are returned, with themselves alone.  Repeated rows are one text twice.  Other columns are not
looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmask.llm import common as shared
from quillmask.llm import pieces
from quillmask.llm.graph import components

WIDTH, PERCENT = 5, 75
COMMON, BLOCK = 32, 256
#: bytes of text that are hashed at once, rows sent to Python at once
SLICE, ROWS = 500_000, 1_000
#: parities kept of a dense text's set
BITS = 512
#: tells lists of turned prefixes from others; a number beyond all list lengths
TURNED, MANY = 0x5851F42D4C957F2D, 1 << 30
#: ids that are sent to all tasks at most (8 MB); beyond it they are joined
SENT = 1_000_000


def slack(n):
    """By how much a prefix is lengthened."""
    return n // 12 + 8


def prefix(n, percent: int = PERCENT):
    """Elements of a set of n of which one is shared by every set that links: n - ceil(n * percent / 100) + 1."""
    return n - (n * percent + 99) // 100 + 1


def shingle_sets(texts: list[str], width: int = WIDTH):
    """(flat shingle hashes, each set sorted and distinct; set sizes)."""
    import numpy as np

    data = "\n".join(t.replace("\n", " ") for t in texts).encode("utf-8")
    raw = np.frombuffer(data + b"\n", np.uint8)
    lower = raw + ((raw >= 65) & (raw <= 90)) * np.uint8(32)
    gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
    word = np.flatnonzero(~gap & np.concatenate(([True], gap[:-1])))
    stop = np.flatnonzero(gap & np.concatenate(([False], ~gap[:-1])))
    owner_end = np.flatnonzero(raw == 10)  # one at each text's end
    if not len(word):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    step = np.uint64(0x9E3779B97F4A7C15)
    each = pieces.hashes(np.append(lower, np.zeros(pieces.SPARE, np.uint8)), word, stop - word)
    owner = np.searchsorted(owner_end, word)
    n_words = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(n_words) - n_words
    out = np.zeros(len(each), np.uint64)
    for k in range(width):  # word k places on, where the text has one
        at = np.arange(len(each)) + k
        inside = at < (first + n_words)[owner]
        part = np.where(inside, each[np.minimum(at, len(each) - 1)], 0)
        out = pieces.scramble(out * step + part + np.uint64(k + 1))
    place = np.arange(len(each)) - first[owner]
    full = (place + width <= n_words[owner]) | (place == 0)
    short = n_words < width
    if (short & (n_words > 0)).any():  # the whole sequence as one: told apart from longer ones by its length
        at = first[short & (n_words > 0)]
        out[at] = pieces.scramble(out[at] + n_words[short & (n_words > 0)].astype(np.uint64))
    owner, out = owner[full], out[full]
    order = np.lexsort((out, owner))
    owner, out = owner[order], out[order]
    new = np.ones(len(out), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (out[1:] != out[:-1])
    return out[new], np.bincount(owner[new], minlength=len(texts))


def _sets(batches, width: int, percent: int, part: str):
    """id, key, n and, as signed hashes in order, the lengthened prefix ("prefix"), the whole set ("all") or nothing ("none").

    "parities": BITS bits, each the parity of the elements whose hash falls on it.
    """
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        lo, texts = 0, [t or "" for t in batch.column(2).to_pylist()]
        while lo < len(texts):
            hi, chars = lo, 0
            while hi < len(texts) and (hi == lo or chars + len(texts[hi]) <= SLICE):
                chars += len(texts[hi])
                hi += 1
            flat, sizes = shingle_sets(texts[lo:hi], width)
            lengths = sizes
            if part == "none":
                lengths, flat = np.zeros_like(sizes), flat[:0]
            elif part == "parities":
                owner = np.repeat(np.arange(hi - lo), sizes)
                bits = np.bincount(owner * BITS + (flat & np.uint64(BITS - 1)).astype(np.int64), minlength=(hi - lo) * BITS) & 1
                lengths, flat = np.full_like(sizes, BITS // 64), np.packbits(bits.astype(np.uint8)).view(np.uint64)
            elif part == "prefix":
                lengths = np.where(sizes > 0, np.minimum(sizes, prefix(sizes, percent) + slack(sizes)), 0)
                place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                flat = flat[place < np.repeat(lengths, sizes)]
            offsets = np.concatenate(([0], np.cumsum(lengths)))
            items = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.view(np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(sizes, pa.int32()), items], ["id", "key", "n", "items"])
            lo = hi


def _lists(batches, block: int):
    """Blocks of the lists with two members at least, from postings (item, n and place in one number, id) in order."""
    import numpy as np
    import pyarrow as pa

    held = None  # the last, unfinished list: (item, block number, leader, members already out, ids, sizes)

    def rows(item, first, lead, ids, ns, last):
        """Whole blocks; the rest too if the list ends here.  A list of one member gives nothing."""
        out, k = [], 0
        while k < len(ids) and (last or len(ids) - k > block):
            if last and first == 0 and k == 0 and len(ids) == 1:
                break
            out.append((item, first, lead, ids[k : k + block], ns[k : k + block]))
            first, k = first + 1, k + block
        return out, first, ids[k:], ns[k:]

    def emit(out):
        return pa.RecordBatch.from_pylist([{"item": i, "block": b, "lead": lead, "members": [{"id": x, "n": n >> 32, "place": n & 0xFFFFFFFF} for x, n in zip(ids, ns)]} for i, b, lead, ids, ns in out], _LIST)

    for batch in batches:
        items, ns, ids = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        if not len(items):
            continue
        new = np.concatenate(([True], (items[1:] != items[:-1]) | (ns[1:] != ns[:-1]) | (ids[1:] != ids[:-1])))  # a row twice is one member
        items, ns, ids = items[new], ns[new], ids[new]
        cut = np.flatnonzero(np.concatenate(([True], items[1:] != items[:-1])))
        size = np.diff(np.append(cut, len(items)))
        keep = size > 1
        keep[0] = keep[-1] = True
        out = []
        for a, s in zip(cut[keep].tolist(), size[keep].tolist()):
            item, own, sizes = int(items[a]), ids[a : a + s].tolist(), ns[a : a + s].tolist()
            if held and held[0] == item:
                _, first, lead, before, before_n = held
                if before and (before[-1], before_n[-1]) == (own[0], sizes[0]):
                    own, sizes = own[1:], sizes[1:]
                own, sizes = before + own, before_n + sizes
            else:
                if held:
                    out += rows(*held, True)[0]
                first, lead = 0, own[0]
            done, first, own, sizes = rows(item, first, lead, own, sizes, False)
            out += done
            held = (item, first, lead, own, sizes)
        if out:
            yield emit(out)
    if held:
        out = rows(*held, True)[0]
        if out:
            yield emit(out)


def _list_schema():
    import pyarrow as pa

    return pa.schema([("item", pa.int64()), ("block", pa.int32()), ("lead", pa.int64()), ("members", pa.list_(pa.struct([("id", pa.int64()), ("n", pa.int32()), ("place", pa.int32())])))])


_LIST = _list_schema()


def _ragged(column):
    """(offsets of the lists, their members' fields)."""
    import numpy as np

    members = column.flatten()
    offsets = np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))))
    fields = {f.name: members.field(k) for k, f in enumerate(members.type)}
    lists = {k: f.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(f), -1) for k, f in fields.items() if k == "parities" and len(f)}
    return offsets, lists | {k: f.to_numpy(zero_copy_only=False) for k, f in fields.items() if k != "parities"}


def _pairs(batches, percent: int, at_once: int = 1_000_000):
    """Pairs of one member of "odd" and one of "all2" that sizes, places and components leave, counted within a batch.

    `place` bounds what two sets share: as many elements before the common one as the nearer has, and as many after it.
    """
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        main = batch.column(0).to_numpy(zero_copy_only=False)
        (xo, x), (yo, y) = _ragged(batch.column(1)), _ragged(batch.column(2))
        wide = np.diff(yo)
        work = np.concatenate(([0], np.cumsum(np.diff(xo) * wide)))
        lo = 0
        while lo < len(main):
            hi = max(lo + 1, int(np.searchsorted(work, work[lo] + at_once, "right")) - 1)
            row = np.repeat(np.arange(lo, hi), np.diff(work[lo : hi + 1]))
            at = np.arange(work[lo], work[hi]) - work[row]
            i, j = xo[row] + at // wide[row], yo[row] + at % wide[row]
            lo = hi
            keep = (x["c"][i] != y["c"][j]) & ((y["c"][j] == main[row]) | (x["id"][i] < y["id"][j]))
            keep &= np.minimum(x["n"][i], y["n"][j]) * 100 >= np.maximum(x["n"][i], y["n"][j]) * percent
            i, j, row = i[keep], j[keep], row[keep]
            (nx, ny), (px, py) = (d["n"].astype(np.int64)[k] for d, k in ((x, i), (y, j))), (d["place"].astype(np.int64)[k] for d, k in ((x, i), (y, j)))
            shared = np.minimum(px, py) + np.minimum(nx - px, ny - py)
            keep = shared * (100 + percent) >= percent * (nx + ny)
            i, j, nx, ny = i[keep], j[keep], nx[keep], ny[keep]
            if not len(i):
                continue
            # sets that link share this many of their lengthened prefixes, the ones in long lists not counted
            low, high = np.minimum(nx, ny), np.maximum(nx, ny)
            need = np.minimum(low // 12 + 9, (high * percent + 99) // 100) - np.minimum(x["often"][i], y["often"][j])
            a, b = np.minimum(x["id"][i], y["id"][j]), np.maximum(x["id"][i], y["id"][j])
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
            counts = np.diff(np.append(new, len(a)))
            columns = [a[new], b[new], counts, np.minimum.reduceat(need[order], new)]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(columns, types)], ["a", "b", "met", "need"])


def _long_pairs(batches, percent: int):
    """Pairs of one member of "odd" and one of "all2" of which sizes, places, parities and components leave that they may link.

    Two sets differ in as many elements at least as in parities.
    """
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        main = batch.column(0).to_numpy(zero_copy_only=False)
        (xo, x), (yo, y) = _ragged(batch.column(1)), _ragged(batch.column(2))
        found = [np.zeros((0, 2), np.int64)]
        for r in range(len(main)):
            u, v = {k: f[xo[r] : xo[r + 1]][:, None] for k, f in x.items()}, {k: f[yo[r] : yo[r + 1]][None, :] for k, f in y.items()}
            both = u["n"].astype(np.int64) + v["n"]
            share = -(-percent * both // (100 + percent))  # elements that sets which link share
            keep = (u["c"] != v["c"]) & ((v["c"] == main[r]) | (u["id"] < v["id"])) & (np.minimum(u["n"], v["n"]) >= share)
            keep &= np.minimum(u["commons"], v["commons"]) >= share
            keep &= np.minimum(u["place"], v["place"]) + np.minimum(u["n"] - u["place"], v["n"] - v["place"]) >= share
            if not keep.any():
                continue
            differ = np.zeros(keep.shape, np.int64)
            for k in range(BITS // 64):
                differ += np.bitwise_count(u["parities"][..., k] ^ v["parities"][..., k])
            i, j = np.nonzero(keep & (differ <= both - 2 * share))
            a, b = x["id"][xo[r] + i], y["id"][yo[r] + j]
            found.append(np.stack((np.minimum(a, b), np.maximum(a, b)), 1))
        out = np.unique(np.concatenate(found), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["a", "b"])


def written(df: DataFrame, name: str) -> DataFrame:
    return shared.written(df, name, ROWS)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link."""
    left = sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("items").alias("ia"))
    right = sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("items").alias("ib"))
    both = F.size(F.array_intersect("ia", "ib"))
    return pairs.join(left, "a").join(right, "b").where(both * 100 >= percent * (F.col("na") + F.col("nb") - both)).select("a", "b")


def _chosen(rows: DataFrame, ids: DataFrame, on: list[str], how: str) -> DataFrame:
    """rows semi- or anti-joined with few or many ids: few (counted) are sent to all tasks, many are joined."""
    return rows.join(F.broadcast(ids) if ids.count() <= SENT else ids, on, how)


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, common: int = COMMON, block: int = BLOCK) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id that links lead to; null for a null id)."""
    since = shared.mark()
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.md5(text.cast("binary")).alias("key"), text.alias("text"))
    named = rows.select("id", "key")
    classes = written(named.groupBy("key").agg(F.min("id").alias("rep")), "classes")
    copies = written(named.where("id IS NOT NULL").join(classes, "key").where("id <> rep").select("id", "key"), "copies")
    own = _chosen(rows, copies, ["id", "key"], "left_anti")

    # inverted lists over lengthened prefixes
    schema = "id long, key string, n int, items array<long>"
    postings = own.where("id IS NOT NULL").mapInArrow(partial(_sets, width=width, percent=percent, part="prefix"), schema)
    postings = postings.select("id", "n", F.posexplode("items").alias("place", "item"))
    postings = postings.select("item", (F.shiftleft(F.col("n").cast("long"), 32) + F.col("place")).alias("at"), "id")
    ordered = postings.repartition("item").sortWithinPartitions("item", "at", "id")
    lists = written(ordered.mapInArrow(partial(_lists, block=block), "item long, block int, lead long, members array<struct<id:long,n:int,place:int>>"), "lists")
    long_list = (F.size("members") > common) | (F.col("block") > 0)
    member = lambda df: df.select("item", "block", "lead", F.explode("members").alias("m")).select("item", "block", "lead", "m.*")
    short = member(lists.where(~long_list)).select("item", F.col("block").cast("long").alias("block"), "id", "n", "place", "lead", F.lit(False).alias("long"))

    # dense texts: most of their prefix stands in long lists
    in_long = member(lists.where(long_list))
    least = F.expr(f"CAST((n * {percent} + 99) DIV 100 AS INT)")  # elements that partners share
    escapes = F.exists(F.sequence(F.lit(1), F.least(F.expr("CAST(n DIV 12 AS INT) + 9"), least)), lambda k: (k > F.size("q")) | (F.get("q", k - 1) >= F.col("n") - least + k))
    frequent = in_long.groupBy("id", "n").agg(F.sort_array(F.collect_list("place")).alias("q"))
    frequent = written(frequent.select("id", "n", F.size("q").alias("often"), (~escapes).alias("dense")), "frequent")
    # dense texts among themselves, by whole sets: prefixes in another order, common shingles last
    dense = _chosen(own, frequent.where("dense").select("id"), ["id"], "left_semi")
    whole = dense.mapInArrow(partial(_sets, width=width, percent=percent, part="all"), schema).select("id", "n", F.explode("items").alias("item"))
    common_items = written(whole.groupBy("item").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > common).select("item"), "common")
    flagged = F.broadcast(common_items) if common_items.count() <= SENT else common_items
    marked = whole.join(flagged.withColumn("last", F.lit(1)), "item", "left")
    turned = marked.groupBy("id", "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("last", F.lit(0)).alias("last"), "item"))).alias("s"), F.count("last").cast("int").alias("commons"))
    own_prefix = turned.select("id", "n", "commons", F.posexplode(F.slice("s", F.lit(1), F.col("n") - least + 1)).alias("place", "e"))
    own_prefix = written(own_prefix.select(F.expr(f"e.item ^ {TURNED}").alias("item"), (F.col("e.last") == 1).alias("long"), "id", "n", "place", "commons"), "turned")
    # a list's leader is the text with most of its shingles common, the one that others vary
    share = F.struct(F.col("commons") / F.col("n"), -F.col("id"))
    lead = written(own_prefix.groupBy("item").agg(F.max_by("id", share).alias("lead"), F.count(F.lit(1)).alias("k")).where("k > 1"), "leads")
    active = own_prefix.join(lead, "item")
    # members of a long list that share no other than common shingles share `commons` at most: too few of them, no look-up
    active = active.where((~F.col("long")) | (F.col("commons") >= least))
    # blocks by size (the k-th e-fold tenth) and by position, of about `block` members
    band, spot = F.floor(F.log("n") * 10), F.floor(F.col("place") * 32 / F.col("n"))
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("k") / block))
    number = F.when(F.col("long"), ((band * 40 + spot) * 100_000 + F.least(part, F.lit(99_999))).cast("long"))
    active = written(active.select("item", F.coalesce(number, F.lit(0)).alias("block"), "id", "n", "place", "lead", "long", "commons"), "active")
    members = short.withColumn("commons", F.lit(None).cast("int")).unionByName(active)

    def checked(pairs: DataFrame) -> DataFrame:
        """The pairs that link; whole sets are made for their texts only."""
        nodes = written(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "nodes")
        sets = written(_chosen(own, nodes, ["id"], "left_semi").mapInArrow(partial(_sets, width=width, percent=percent, part="all"), schema).select("id", "n", "items"), "sets")
        return written(_verified(pairs, sets, percent), "links")

    # every set against the first of its lists, where they meet in several: what this misses is found below
    stars = members.where("id <> lead").groupBy(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).agg(F.count(F.lit(1)).alias("met"), F.max("n").alias("n"))
    stars = written(stars.where(F.col("met") * 80 >= F.col("n")).select("a", "b"), "stars")
    links = checked(stars)
    known = written(components(links), "known")

    # what is left: pairs in one list with different components
    placed = members.join(known.withColumnRenamed("node", "id"), "id", "left").join(frequent.groupBy("id").agg(F.max("often").alias("often")), "id", "left")
    often = F.when(F.col("commons").isNull(), F.coalesce("often", F.lit(0))).otherwise(MANY)  # one shared shingle of a turned prefix is enough
    placed = written(placed.select("item", "block", "long", "id", "n", "place", "commons", F.coalesce("component", "id").alias("c"), often.alias("often")), "placed")
    # in each list the members outside its largest component against all others
    parts = placed.groupBy("item", "c").agg(F.count(F.lit(1)).alias("k")).groupBy("item").agg(F.count(F.lit(1)).alias("parts"), F.max_by("c", F.struct("k", "c")).alias("main")).where("parts > 1")
    placed = placed.join(parts.select("item", "main"), "item")
    odd = F.filter("all2", lambda x: x["c"] != F.col("main")).alias("odd")
    alone = placed.where("NOT long").groupBy("item", "main").agg(F.collect_list(F.struct("n", "id", "c", "place", "often")).alias("all2")).select("main", odd, "all2")
    pairs = alone.mapInArrow(partial(_pairs, percent=percent), "a long, b long, met long, need int").groupBy("a", "b").agg(F.sum("met").alias("met"), F.min("need").alias("need"))
    pairs = pairs.where(F.col("met") >= F.col("need")).select("a", "b")
    parities = dense.mapInArrow(partial(_sets, width=width, percent=percent, part="parities"), schema).select("id", "n", F.col("items").alias("parities"))
    # most that members of two blocks can share, by what is common and by their positions, against what the smallest must
    bounds = {"n": F.min("n"), "size": F.max("n"), "commons": F.max("commons"), "before": F.max("place"), "after": F.max(F.col("n") - F.col("place"))}
    blocks = placed.where("long").join(parities, ["id", "n"]).groupBy("item", "block", "main").agg(F.collect_list(F.struct("n", "id", "c", "place", "commons", "parities")).alias("all2"), *(f.alias(k) for k, f in bounds.items()))
    blocks = written(blocks.select("item", "main", odd, "all2", *bounds), "blocks")
    other = blocks.select("item", "all2", *(F.col(k).alias(f"{k}2") for k in bounds))
    need = F.expr(f"({percent} * (n + n2) + {99 + percent}) DIV {100 + percent}")
    fits = (F.col("n2") * percent <= F.col("size") * 100) & (F.col("n") * percent <= F.col("size2") * 100) & (F.least("commons", "commons2") >= need) & (F.least("before", "before2") + F.least("after", "after2") >= need)
    met = blocks.where("size(odd) > 0").drop("all2").join(other, "item").where(fits)
    pairs = pairs.union(met.select("main", "odd", "all2").mapInArrow(partial(_long_pairs, percent=percent), "a long, b long")).distinct().join(stars, ["a", "b"], "left_anti")
    final = components(links.union(checked(written(pairs, "pairs"))))

    # back to all rows
    sizes = own.mapInArrow(partial(_sets, width=width, percent=percent, part="none"), schema).select("key", F.col("n").cast("long").alias("n")).distinct()
    by_key = classes.join(sizes, "key").join(final, F.col("rep") == F.col("node"), "left")
    by_key = written(by_key.select("key", "n", F.coalesce("component", "rep").alias("component")), "by_key")
    shared.tidy(docs.sparkSession, since, "by_key")
    out = named.join(by_key, "key")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).when(F.col("id").isNotNull(), F.col("component")).alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the rows that link to a smaller id; of rows with one id and one component all stay or go."""
    since = shared.mark()
    found = similar(docs, id_col, text_col, **options)
    drop = written(found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_drop")).distinct(), "drop")
    shared.tidy(docs.sparkSession, since, "drop")
    drop = F.broadcast(drop) if drop.count() <= SENT else drop
    return docs.join(drop, docs[id_col] == F.col("_drop"), "left_anti")


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 5 THEN [array_to_string(words, ' ')] ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * i >= 75 * (x.n + y.n - i)),
g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT g.b, r.c FROM r JOIN g ON r.doc_id = g.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m ON m.doc_id = d.doc_id
"""
