"""Near-duplicate vectors by a pivot-permutation index.

1. Equal vectors form classes (128-bit hash of the vector); one of each goes on, with the class's size.
2. Pivots are chosen from a sample of `sample` vectors (by hash): vectors closer than `apart` to a chosen pivot are left
   out, so that a large group of near copies holds one pivot or two and its members order the others alike.
3. A vector is described by its `nearest` pivots in order.  Inverted lists are kept by pairs of pivots, so vectors that
   meet in a list share at least two: the list of the two smallest shared pivots counts a pair, the others skip it.
4. Members of a list are verified by cosine in double precision; lists longer than `block` are split and every two
   blocks meet in a list of their own.  Tasks take lists as they come and give link counts and spanning edges, never
   pairs.  A vector is sent once a list, in the precision it came in.

Every vector is indexed; only the pivots come from a sample.  Vectors that are null, zero or hold null, infinite or NaN
components, and rows with a null id, link with nothing and keep themselves.  Vectors of different lengths never link.
Repeated rows are other vectors of their class.  Extra columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmask.llm.common import mark, tidy, written
from quillmask.llm.graph import components

PIVOTS, SAMPLE, APART, NEAREST, LEAST = 256, 2048, 0.6, 5, 0.95
BLOCK, SHORT = 1024, 64
#: long lists that are sent to all tasks at most (12 bytes each)
SENT = 100_000


def choose_pivots(vectors: list[list[float]], most: int = PIVOTS, apart: float = APART):
    """Unit vectors of the most frequent length, no two closer than apart."""
    import numpy as np

    if not vectors:
        return np.zeros((0, 0))
    lengths = [len(v) for v in vectors]
    size = max(set(lengths), key=lambda n: (lengths.count(n), n))
    kept: list = []
    for v in (unit([v])[0] for v in vectors if len(v) == size):
        if not kept or float((np.array(kept) @ v).max()) < apart:
            kept.append(v)
            if len(kept) == most:
                break
    return np.array(kept)


def describe(x, pivots, nearest: int = NEAREST):
    """Nearest pivots of unit vectors, nearest first; ties go to the smaller number."""
    import numpy as np

    return np.argsort(-np.round(x @ pivots.T, 12), axis=1, kind="stable")[:, :nearest]


def unit(x):
    """Rows of length one, in double precision; scaled by their largest component first, so that no square overflows or vanishes."""
    import numpy as np

    x = np.asarray(x, float)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column):
    """The vectors of an Arrow column of lists of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _by_length(column):
    """(places, vectors) for each length that occurs."""
    import numpy as np
    import pyarrow as pa

    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, _matrix(column.take(pa.array(at)))


def _describe(batches, pivots, nearest: int):
    """Adds near, the numbers of a vector's nearest pivots in ascending order; vectors of another length share one list."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        near: list = [None] * batch.num_rows
        for at, x in _by_length(batch.column(1)):
            known = pivots.size and x.shape[1] == pivots.shape[1] and len(pivots) > 1
            order = np.sort(describe(unit(x), pivots, nearest), axis=1) if known else np.tile(np.arange(2), (len(at), 1))
            for k, row in zip(at.tolist(), order.tolist()):
                near[k] = row
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.list_(pa.int32()))], ["rep", "embedding", "copies", "near"])


def _forest(a, b):
    """Pairs that keep what (a, b) connects, few: each node with its smallest partner, until labels stay."""
    import numpy as np

    out = []
    while len(a):
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        low = np.arange(max(hi) + 1)
        np.minimum.at(low, hi, lo)
        nodes = np.flatnonzero(low < np.arange(len(low)))
        out += zip(nodes.tolist(), low[nodes].tolist())
        while (low[low] != low).any():
            low = low[low]
        a, b = low[lo], low[hi]
        a, b = a[a != b], b[a != b]
    return out


def _verify(batches, least: float, at_once: int = 400_000):
    """Link counts and spanning edges of lists that come in order of (key, lo, hi), each whole before the next."""
    import numpy as np
    import pyarrow as pa

    schema = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("to", pa.int64())])
    held: list = []

    def candidates(cut, size, mine, lo, hi):
        """(places of both members) of the pairs of all lists, many short lists or one long one at once."""
        done = 0
        work = np.cumsum(size * (size - 1) // 2)
        while done < len(cut):
            stop = max(done + 1, int(np.searchsorted(work, (work[done - 1] if done else 0) + at_once, "right")))
            a, b = [], []
            for n in np.unique(size[done:stop]).tolist():  # lists of one length have the same pairs
                first = cut[done:stop][size[done:stop] == n]
                i, j = np.triu_indices(n, 1)
                a.append((first[:, None] + i).ravel())
                b.append((first[:, None] + j).ravel())
            a, b = np.concatenate(a), np.concatenate(b)
            fits = (lo[a] == hi[a]) | (mine[a] != mine[b])
            yield a[fits], b[fits]
            done = stop

    def run(table):
        key, lo, hi, mine, rep, copies = (table.column(c).to_numpy() for c in ("key", "lo", "hi", "mine", "rep", "copies"))
        new = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))))
        size = np.diff(np.append(new, len(key)))
        if not (size > 1).any():
            return
        vectors, near = table.column("embedding").combine_chunks(), table.column("near").combine_chunks()
        where, units = np.zeros(len(key), np.int64), []  # lists hold vectors of one length
        for at, x in _by_length(vectors):
            where[at] = np.arange(len(at))
            units.append((at, unit(x)))
        close_a, close_b = [], []
        for at, x in units:
            inside = np.zeros(len(key), bool)
            inside[at] = True
            picked = _matrix(near.take(pa.array(at)))

            def owned(a, b):  # whether a pair's list is that of the two smallest pivots it shares
                i, j = where[a], where[b]
                first, second = np.divmod(key[a] % 1_000_000_000, 10_000)
                fits = np.ones(len(a), bool)
                for k in range(picked.shape[1]):
                    p = picked[i, k]
                    fits &= (p >= second) | (p == first) | ~(picked[j] == p[:, None]).any(axis=1)
                return a[fits], b[fits]

            own = inside[new] & (size > 1)
            for a, b in candidates(new[own & (size <= SHORT)], size[own & (size <= SHORT)], mine, lo, hi):
                a, b = owned(a, b)
                for start in range(0, len(a), 50_000):
                    i, j = a[start : start + 50_000], b[start : start + 50_000]
                    linked = np.einsum("ij,ij->i", x[where[i]], x[where[j]]) >= least
                    close_a.append(i[linked])
                    close_b.append(j[linked])
            for first, n in zip(new[own & (size > SHORT)].tolist(), size[own & (size > SHORT)].tolist()):
                members = np.arange(first, first + n)
                same = lo[first] == hi[first]
                left = members if same else members[mine[members] == lo[first]]
                right = members if same else members[mine[members] == hi[first]]
                linked = x[where[left]] @ x[where[right]].T >= least
                a, b = np.nonzero(np.triu(linked, 1) if same else linked)
                a, b = owned(left[a], right[b])
                close_a.append(a)
                close_b.append(b)
        a, b = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (close_a, close_b))
        if not len(a):
            return
        names, which = np.unique(rep, return_inverse=True)
        a, b, weight = which[a], which[b], np.zeros(len(names), np.int64)
        weight[which] = copies
        links = np.bincount(a, weight[b], len(names)) + np.bincount(b, weight[a], len(names))
        some = np.flatnonzero(links)
        edges = np.array(_forest(a, b), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(links[some].astype(np.int64)), pa.nulls(len(some), pa.int64())], schema=schema)
        yield pa.RecordBatch.from_arrays([pa.array(names[edges[:, 0]]), pa.array(np.zeros(len(edges), np.int64)), pa.array(names[edges[:, 1]])], schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        last = [batch.column(k)[batch.num_rows - 1].as_py() for k in range(3)]
        keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
        begin = int(np.flatnonzero(~((keys[0] == last[0]) & (keys[1] == last[1]) & (keys[2] == last[2])))[-1:].sum() + 1) if not all((c == v).all() for c, v in zip(keys, last)) else 0
        if held and (begin or [held[-1].column(k)[held[-1].num_rows - 1].as_py() for k in range(3)] != last):
            yield from run(pa.Table.from_batches([*held, batch.slice(0, begin)]))
            held = []
        elif begin:
            yield from run(pa.Table.from_batches([batch.slice(0, begin)]))
        held.append(batch.slice(begin))
    if held:
        yield from run(pa.Table.from_batches(held))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = LEAST, pivots: int = PIVOTS, sample: int = SAMPLE, nearest: int = NEAREST, block: int = BLOCK) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept."""
    since = mark()
    kind = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    vector = F.col(f"`{vector_col}`").cast(f"array<{kind}>")
    odd = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.transform(vector, lambda v: (v + F.lit(0.0)).cast(kind)).alias("embedding"), odd.alias("odd"))
    usable = F.col("id").isNotNull() & F.coalesce(~F.col("odd"), F.lit(False)) & F.coalesce(F.exists("embedding", lambda v: v != 0), F.lit(False))
    rows = rows.select("id", "embedding", usable.alias("usable"), F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(1), "embedding").alias("k2"))
    classes = rows.where("usable").groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.any_value("embedding").alias("embedding"))
    classes = written(classes, "vectors")
    drawn = classes.select("embedding", "k1", "k2").orderBy("k1", "k2").limit(sample).collect()
    chosen = choose_pivots([r.embedding for r in drawn], pivots)

    schema = f"rep long, embedding array<{kind}>, copies long, near array<int>"
    described = written(classes.select("rep", "embedding", "copies").mapInArrow(partial(_describe, pivots=chosen, nearest=nearest), schema), "described")
    # inverted lists by pairs of pivots
    n, base = F.size("near"), F.size("embedding").cast("long") * 1_000_000_000
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.transform(F.slice("near", i + 2, n), lambda q: base + F.get("near", i) * 10_000 + q)))
    counts = described.select(F.explode(pairs).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    long = written(counts.where(F.col("n") > block).select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "long_lists")
    long = F.broadcast(long) if long.count() <= SENT else long
    marked = described.withColumn("key", F.explode(pairs)).join(long, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    marked = marked.withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    marked = marked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    marked = marked.select("key", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "rep", "copies", "near", "embedding")
    dealt = marked.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    found = written(dealt.mapInArrow(partial(_verify, least=least), "rep long, links long, to long"), "found")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.where(F.col("to").isNotNull()).select(F.col("rep").alias("a"), F.col("to").alias("b")))
    by_class = classes.select("k1", "k2", "rep", "copies").join(links, "rep", "left").join(joined, F.col("rep") == F.col("node"), "left")
    by_class = written(by_class.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component")), "by_class")
    tidy(vectors.sparkSession, since, "by_class")
    good = rows.where("usable").select("id", "k1", "k2").join(by_class, ["k1", "k2"]).select("id", "links", "component")
    rest = rows.where("NOT usable").select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("component"))
    out = good.union(rest)
    return out.select(F.col("id").alias(id_col), F.col("links").alias("n_links"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))
