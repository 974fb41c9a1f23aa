"""Hard-negative mining by ball trees with branch and bound.

An anchor's positives are the rows of its label with the highest scores, its negatives for a positive those rows of
other labels with the highest scores whose score lies in a window given by the positive's.  A score is the inner product of
vectors of whole numbers, floor(scale * x).

1. Anchors are dealt in chunks of `chunk` at most, rows in `splits`; each cell of this grid is one partition, to which
   the anchors of the chunk come first and the rows of the split after them, one sorted stream of Arrow batches.
2. A task gathers `block` rows at a time and builds a ball tree over them.  A node's centre c and radius r bound the inner
   products of its rows with a vector q from both sides, q.c - |q|r and q.c + |q|r.  A node is left out for those anchors
   whose window lies outside the bounds, or whose current last hit is strictly above them, and where its labels cannot fit.
3. The best hits of an anchor are carried from block to block, so a task gives k rows a window at most, and a last ranking
   takes the best over the splits.

Memory: one chunk of anchors and one block of rows a task.  Rows sent: each row once a chunk, each anchor once a split.
Bounds only leave out what cannot be a hit, and scores are compared as whole numbers, so results are exact.

Rows with a null id, label or vector, or with any null, infinite or NaN component take no part, nor those whose integer
vector has a squared length of 2**55 or more (a hundredfold inner product would not fit a long).  Vectors of different lengths have no score.
Rows of an anchor's own id are never its hits; other repeated rows count one by one, and a repeated anchor has its results
again.  Ties: smaller ids first.  Extra columns are not looked at; an empty table, or one without anchors, gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmask.llm.common import mark, tidy, written

#: anchors in a chunk at most; rows in a tree; rows in a leaf
CHUNK, BLOCK, LEAF = 50_000, 16_384, 128
#: rows are dealt in one split a million, within these bounds
SPLITS = 16, 128
#: anchors that are scored against a leaf at once
SLICE = 8_192
_NONE = -(1 << 62)
#: the contract's query in DuckDB
SQL = """
WITH sound AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x::DOUBLE)]) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM sound a JOIN sound b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
), positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
), ranked AS (
  SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.other)::INTEGER AS rank, n.other AS negative_id, positive_score, n.score AS negative_score
  FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * positive_score <= 100 * n.score AND 100 * n.score <= 90 * positive_score
)
SELECT * FROM ranked WHERE rank <= 10"""


class BallTree:
    """Rows in the order of their leaves, and nodes as (from, to, centre, radius, lowest label, highest label, children)."""

    def __init__(self, vectors, labels, leaf: int = LEAF):
        import numpy as np

        self.order = np.arange(len(vectors))
        self.nodes: list = []
        self._vectors, self._labels, self._leaf = vectors, labels, leaf
        self.root = self._build(0, len(vectors)) if len(vectors) else None
        del self._vectors, self._labels

    def _build(self, lo: int, hi: int) -> int:
        import numpy as np

        own = self.order[lo:hi]
        x = self._vectors[own].astype(np.float64)
        centre = x.mean(axis=0)
        far = ((x - centre) ** 2).sum(axis=1)
        radius, tags = math.sqrt(far.max()), self._labels[own]
        number = len(self.nodes)
        self.nodes.append(None)
        children = None
        if hi - lo > self._leaf and radius > 0:
            a = x[far.argmax()]
            b = x[((x - a) ** 2).sum(axis=1).argmax()]
            place = np.argsort(x @ (b - a), kind="stable")
            self.order[lo:hi] = own[place]
            mid = (lo + hi) // 2
            children = self._build(lo, mid), self._build(mid, hi)
        self.nodes[number] = (lo, hi, centre, radius, tags.min(), tags.max(), children)
        return number


class Search:
    """The best hits so far of some anchors, by window: `score` and `ids` of shape (anchors, windows, k)."""

    def __init__(self, vectors, ids, labels, low, high, k: int, same: bool):
        import numpy as np

        self.vectors, self.own, self.labels, self.low, self.high, self.same, self.k = vectors, ids, labels, low, high, same, k
        self.norm = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        self.score = np.full((*low.shape, k), _NONE, np.int64)
        self.ids = np.full((*low.shape, k), np.iinfo(np.int64).max, np.int64)
        self.scored = 0  # pairs whose score was computed

    def _floor(self, who):
        """The least score that can still be a hit, by window."""
        import numpy as np

        return np.maximum(self.low[who], self.score[who, :, -1])

    def add(self, vectors, ids, labels) -> None:
        """Looks through a block of rows."""
        import numpy as np

        tree = BallTree(vectors, labels)
        if tree.root is None or not len(self.own):
            return
        vectors, ids, labels = vectors[tree.order], ids[tree.order], labels[tree.order]
        longest = math.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1).max()) * (self.norm.max() + 1)
        # sums of products stay below the product of the lengths, so these are exact
        exact = np.float32 if longest < 1 << 24 else np.float64 if longest < 1 << 53 else np.int64
        rows, anchors = vectors.astype(exact), self.vectors.astype(exact)
        stack = [(tree.root, np.arange(len(self.own)))]
        while stack:
            number, who = stack.pop()
            lo, hi, centre, radius, least, most, children = tree.nodes[number]
            tag = self.labels[who]
            who = who[(tag >= least) & (tag <= most)] if self.same else who[(tag != least) | (least != most)]
            if not len(who):
                continue
            near = self.vectors[who].astype(np.float64) @ centre
            wide = self.norm[who] * radius
            slack = 0.5 + 1e-9 * self.norm[who] * (radius + math.sqrt(centre @ centre))
            top, bottom = near + wide + slack, near - wide - slack
            alive = ((top[:, None] >= self._floor(who)) & (bottom[:, None] <= self.high[who]) & (self.low[who] <= self.high[who])).any(axis=1)
            who = who[alive]
            if not len(who):
                continue
            if children is None:
                for at in range(0, len(who), SLICE):
                    self._leaf(who[at : at + SLICE], anchors, rows[lo:hi], ids[lo:hi], labels[lo:hi])
            else:  # the child that is nearer on the whole is looked through first
                mean = near[alive].mean()
                first, last = sorted(children, key=lambda c: abs(float((self.vectors[who].astype(np.float64) @ tree.nodes[c][2]).mean()) - mean))
                stack += [(last, who), (first, who)]

    def _leaf(self, who, anchors, rows, ids, labels) -> None:
        import numpy as np

        score = (anchors[who] @ rows.T).astype(np.int64)
        self.scored += score.size
        fits = (self.labels[who][:, None] == labels) == self.same
        fits &= self.own[who][:, None] != ids
        floor, high = self._floor(who), self.high[who]
        for w in range(floor.shape[1]):
            a, b = np.nonzero(fits & (score >= floor[:, w : w + 1]) & (score <= high[:, w : w + 1]))
            if len(a):
                self._merge(who, w, a, score[a, b], ids[b])

    def _merge(self, who, w: int, a, score, ids) -> None:
        import numpy as np

        some, k = np.unique(a), self.k
        mine = who[some]
        at = np.concatenate((np.repeat(some, k), a))
        score = np.concatenate((self.score[mine, w].ravel(), score))
        ids = np.concatenate((self.ids[mine, w].ravel(), ids))
        order = np.lexsort((ids, -score, at))
        best = order[np.searchsorted(at[order], some)[:, None] + np.arange(k)]
        self.score[mine, w], self.ids[mine, w] = score[best], ids[best]


def _find(items: DataFrame, anchors: DataFrame, chunks: int, splits: int, windows: int, k: int, same: bool) -> DataFrame:
    """q, w, score, id: the k best rows of each split for every anchor and window.  anchors: q, id, label, v, lows, highs."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        now, searches, held, count = None, {}, [], 0

        def matrix(column, places):
            lists = column.take(pa.array(places))
            return np.asarray(lists.flatten()).reshape(len(places), -1)

        def by_length(batch):
            size = np.asarray(batch.column("v").value_lengths())
            for n in np.unique(size):
                places = np.flatnonzero(size == n)
                yield int(n), batch.take(pa.array(places)), matrix(batch.column("v"), places)

        def start():
            """Searches of the anchors that were held, by length of their vectors."""
            table = pa.Table.from_batches(held).combine_chunks().to_batches()
            for batch in table:
                for n, own, vectors in by_length(batch):
                    low, high = (matrix(own.column(c), np.arange(own.num_rows)) for c in ("lows", "highs"))
                    tags = np.asarray(own.column("label"))
                    searches[n] = np.asarray(own.column("q")), Search(vectors, np.asarray(own.column("id")), tags, low, high, k, same)

        def look():
            """A block of rows."""
            for batch in pa.Table.from_batches(held).combine_chunks().to_batches():
                for n, own, vectors in by_length(batch):
                    if n in searches:
                        searches[n][1].add(vectors, np.asarray(own.column("id")), np.asarray(own.column("label")))

        def hits():
            for q, search in searches.values():
                a, w, rank = np.nonzero(search.score > _NONE)
                for at in range(0, len(a), 50_000):
                    s = slice(at, at + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array(q[a[s]]), pa.array(w[s].astype(np.int32)), pa.array(search.score[a[s], w[s], rank[s]]), pa.array(search.ids[a[s], w[s], rank[s]])], ["q", "w", "score", "id"])

        def flush():
            nonlocal count
            if held:
                start() if now[1] == 0 else look()
            held.clear()
            count = 0

        for batch in batches:
            cell, kind = np.asarray(batch.column("cell")), np.asarray(batch.column("kind"))
            edges = np.flatnonzero((np.diff(cell) != 0) | (np.diff(kind) != 0)) + 1
            for lo, hi in zip([0, *edges], [*edges, len(cell)]):
                if hi == lo:
                    continue
                here = cell[lo], kind[lo]
                if here != now:
                    flush()
                    if now is not None and here[0] != now[0]:
                        yield from hits()
                        searches.clear()
                    now = here
                for at in range(lo, hi, BLOCK):
                    part = batch.slice(at, min(BLOCK, hi - at))
                    if now[1] == 1 and count + part.num_rows > BLOCK:
                        flush()
                    held.append(part)
                    count += part.num_rows
        flush()
        yield from hits()

    none = F.array().cast("array<long>")
    chunk = F.pmod(F.xxhash64("q"), F.lit(chunks)).cast("int")
    split = F.pmod(F.xxhash64("id", "label"), F.lit(splits)).cast("int")
    every = lambda n, cell: F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), cell)).alias("cell")
    asked = anchors.select("q", "id", "label", "v", "lows", "highs", F.lit(0).alias("kind"), every(splits, lambda j: chunk * splits + j))
    rows = items.select(F.lit(-1).cast("long").alias("q"), "id", "label", "v", none.alias("lows"), none.alias("highs"), F.lit(1).alias("kind"), every(chunks, lambda i: i * splits + split))
    grid = asked.unionByName(rows).repartitionById(chunks * splits, F.col("cell")).sortWithinPartitions("cell", "kind")
    found = grid.mapInArrow(run, "q long, w int, score long, id long")
    best = Window.partitionBy("q", "w").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mine(
    table: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256,
    positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, chunk: int = CHUNK, splits: int | None = None,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchors: which rows are anchors, by the table's columns.  low, high: a negative's score in hundredths of the positive's.
    """
    spark, since = table.sparkSession, mark()
    quote = lambda c: F.col(f"`{c}`")
    whole = F.transform(quote(vector_col), lambda x: F.floor(x.cast("double") * scale))
    odd = F.exists(quote(vector_col), lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    size = F.aggregate(quote(vector_col), F.lit(0.0), lambda a, x: a + F.pow(F.floor(x.cast("double") * scale).cast("double"), F.lit(2.0)))
    sound = table.where(quote(id_col).isNotNull() & quote(label_col).isNotNull() & quote(vector_col).isNotNull() & (F.size(quote(vector_col)) > 0) & ~odd & (size < float(1 << 55)))
    items = written(sound.select(quote(id_col).cast("long").alias("id"), quote(label_col).cast("long").alias("label"), whole.alias("v"), F.coalesce(anchors, F.lit(False)).alias("anchor")), "items")
    asked = written(items.where("anchor").select("id", "label", "v", F.monotonically_increasing_id().alias("q")), "anchors")
    n, n_asked = items.count(), asked.count()
    chunks = max(1, math.ceil(n_asked / chunk))
    splits = splits or min(max(SPLITS[0], math.ceil(n / 1_000_000)), SPLITS[1])

    free = asked.withColumns({"lows": F.array(F.lit(_NONE + 1)), "highs": F.array(F.lit(-_NONE))})
    firsts = _find(items, free, chunks, splits, 1, positives, True).select("q", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    firsts = written(firsts, "positives")

    # windows of an anchor: one for each score of a positive, filled up with windows that nothing fits
    scores = firsts.groupBy("q").agg(F.array_sort(F.collect_set("positive_score")).alias("s"))
    down = lambda x: F.call_function("div", x - F.pmod(x, F.lit(100)), F.lit(100))
    lows, highs = F.transform("s", lambda p: -down(-p * low)), F.transform("s", lambda p: down(p * high))
    fill = lambda a, v: F.slice(F.concat(a, F.array_repeat(F.lit(v).cast("long"), positives)), 1, positives)
    windows = asked.join(scores, "q").select("q", "id", "label", "v", "s", fill(lows, 1).alias("lows"), fill(highs, 0).alias("highs"))
    windows = written(windows, "windows")
    found = _find(items, windows.drop("s"), chunks, splits, positives, negatives, False)
    scored = found.join(windows.select("q", F.col("id").alias("anchor_id"), "s"), "q").select("q", "anchor_id", F.get("s", F.col("w")).alias("positive_score"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = scored.join(firsts, ["q", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    tidy(spark, since, "items", "positives", "windows")
    return out
