"""A toxicity classifier whose fit penalises score changes when identity terms are swapped.

Features are words and word beginnings (`GRAMS`), each at a few counts and rates (`LEVELS`).  They are chosen by how
unevenly they occur over the two labels; identity terms always take part.  The fit minimises

    log loss + l2 |w|^2 + swap * mean over labelled sentences with an identity term of (w.x - w.x')^2

where x' is the sentence with the term swapped for another of its group, so that neutral mentions of a group do not
move the score.

The fit reads a bounded sample of labelled rows: about `fit_rows` of them, by a hash of the id.  Features are counted
on the executors; the driver gets at most `features` of them, the sample's feature lists and the weights.  Scoring is
one narrow pass over whole texts, with everything but the text ignored.

Null and empty texts get the score of a text without features; repeated rows score alike; extra columns pass through;
without labelled rows of both kinds the only kind's score is given to all.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmask.llm.common import fresh, mark, tidy, written

#: lengths of word beginnings that are features beside whole words
GRAMS = (4, 5, 6)
#: (least count, least share of the text's words)
LEVELS = ((1, 0.0), (2, 0.0), (4, 0.0), (2, 0.01), (2, 0.03))
#: interchangeable mentions, by group
IDENTITIES = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"), ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"), ("gay", "lesbian", "straight", "bisexual", "trans"),
    ("immigrant", "refugee", "native", "foreigner"), ("old", "young", "disabled", "deaf", "blind"),
    ("femme", "homme"), ("femmes", "hommes"), ("musulman", "chrétien", "juif"), ("frau", "mann"), ("frauen", "männer"), ("muslim", "christ", "jude"),
    ("mujer", "hombre"), ("mujeres", "hombres"), ("musulmán", "cristiano", "judío"),
)
_TERMS = {t: g[(k + 1) % len(g)] for g in reversed(IDENTITIES) for k, t in enumerate(g)}
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")


def grams(word: str) -> list[str]:
    return [f"^{word}$", *(f"^{word[:n]}" for n in GRAMS if len(word) >= n)]


def words(text: str) -> Counter:
    return Counter(_WORD.findall(text.lower()))


@dataclass
class Model:
    vocabulary: dict[str, int] = field(default_factory=dict)
    weights: list[float] = field(default_factory=list)
    bias: float = -30.0

    def features(self, counts: Counter, memo: dict | None = None) -> list[int]:
        """Indices of the features of a text with these word counts."""
        memo = {} if memo is None else memo
        total, found = sum(counts.values()), Counter()
        for word, n in counts.items():
            known = memo.get(word)
            if known is None:
                known = tuple(k for g in grams(word) if (k := self.vocabulary.get(g)) is not None)
                if len(memo) > 100_000:
                    memo.clear()
                if len(word) <= 40:
                    memo[word] = known
            for k in known:
                found[k] += n
        return [k * len(LEVELS) + j for k, n in found.items() for j, (least, share) in enumerate(LEVELS) if n >= least and n >= share * total]

    def score(self, counts: Counter, memo: dict | None = None) -> float:
        z = self.bias + sum(self.weights[k] for k in self.features(counts, memo))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def swapped(sentence: str) -> str:
    return _WORD.sub(lambda m: _TERMS.get(m[0], m[0]), sentence.lower())


def pairs(text: str) -> list[tuple[str, str]]:
    """Sentences with an identity term, and their swapped forms."""
    low = text.lower()
    if not any(t in low for t in _TERMS):
        return []
    return [(s, other) for s in _SENTENCE.findall(low) if (other := swapped(s)) != s]


def fold(docs_id) -> F.Column:
    """crc32 of the id as text, modulo 5; null counts as empty text."""
    return F.crc32(F.coalesce(docs_id.cast("string"), F.lit("")).cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = 8000, features: int = 600, least: int = 6, l2: float = 3e-4, swap: float = 1.0, rounds: int = 300) -> Model:
    """Learns from about fit_rows labelled rows whose fold is not 0."""
    import numpy as np

    kept = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & (fold(F.col("id")) != 0))
    n = kept.count()
    share = min(1.0, fit_rows / max(1, n))
    sample = kept.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1.0))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).join(F.broadcast(sample), "id").select("label", "text")
    since = mark()
    rows, sizes = written(rows, "labelled"), [0, 0]
    for r in rows.groupBy("label").count().collect():
        sizes[r.label] = r["count"]
    if not all(sizes):
        return Model(bias=30.0 if sizes[1] else -30.0)

    def count(batches):
        import pyarrow as pa

        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[label].update({g for w in words(text) for g in grams(w)})
        out = [(g, seen[0][g], seen[1][g]) for g in {*seen[0], *seen[1]}]
        for lo in range(0, len(out), 50_000):
            yield pa.RecordBatch.from_pylist([dict(zip(("gram", "n0", "n1"), x)) for x in out[lo : lo + 50_000]], pa.schema([("gram", pa.string()), ("n0", pa.int64()), ("n1", pa.int64())]))

    counted = rows.mapInArrow(count, "gram string, n0 long, n1 long").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    spread = F.sqrt((F.col("n0") + F.col("n1") + 1) / F.lit(sum(sizes)))
    uneven = F.abs(F.col("n1") / F.lit(sizes[1]) - F.col("n0") / F.lit(sizes[0])) / spread
    top = counted.where(F.col("n0") + F.col("n1") >= least).orderBy(uneven.desc(), "gram").limit(features).collect()
    names = sorted({r.gram for r in top} | {f"^{t}$" for t in _TERMS})
    model = Model({g: k for k, g in enumerate(names)})

    def extract(batches):
        import pyarrow as pa

        memo: dict = {}
        for batch in batches:
            out = []
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out.append({"label": label, "x": model.features(words(text), memo), "y": []})
                out += [{"label": -1, "x": model.features(words(a), memo), "y": model.features(words(b), memo)} for a, b in pairs(text)]
            yield pa.RecordBatch.from_pylist(out, pa.schema([("label", pa.int32()), ("x", pa.list_(pa.int32())), ("y", pa.list_(pa.int32()))]))

    got = rows.mapInArrow(extract, "label int, x array<int>, y array<int>").toPandas()
    tidy(docs.sparkSession, since)
    width = len(names) * len(LEVELS)
    real = got[got.label >= 0]
    order = np.lexsort((real.x.map(len).to_numpy(), real.label.to_numpy()))  # the same sums however rows came
    x, y = _sparse(real.x.to_numpy()[order]), real.label.to_numpy()[order].astype(float)
    before, after = _sparse(got.x[got.label < 0].to_numpy()), _sparse(got.y[got.label < 0].to_numpy())
    m, k = len(y), max(1, (got.label < 0).sum())
    w, b, vw, vb = np.zeros(width), math.log(sizes[1] / sizes[0]), np.zeros(width), 0.0
    # steps that the curvature allows, found by power iteration
    v, bend = np.ones(width + 1), 1.0
    for _ in range(20):
        v /= np.linalg.norm(v)
        line, move = _times(x, v[:-1], m) + v[-1], (_times(before, v[:-1], k) - _times(after, v[:-1], k)) / k
        v = np.append(_back(x, line / (4 * m), width) + 2 * l2 * v[:-1] + 2 * swap * (_back(before, move, width) - _back(after, move, width)), line.mean() / 4)
        bend = max(float(np.linalg.norm(v)), 1e-9)
    step = 1 / bend
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(_times(x, w, m) + b, -50, 50)))
        change = (_times(before, w, k) - _times(after, w, k)) / k
        grad = _back(x, (p - y) / m, width) + 2 * l2 * w + 2 * swap * (_back(before, change, width) - _back(after, change, width))
        vw, vb = 0.9 * vw + grad, 0.9 * vb + (p - y).mean()
        w, b = w - step * vw, b - step * vb
    return Model(model.vocabulary, w.tolist(), float(b))


def _sparse(lists):
    import numpy as np

    return np.repeat(np.arange(len(lists)), [len(v) for v in lists]).astype(int), np.concatenate([np.asarray(v, int) for v in lists]) if len(lists) else np.zeros(0, int)


def _times(x, w, rows):
    import numpy as np

    return np.bincount(x[0], w[x[1]], rows)


def _back(x, r, width):
    import numpy as np

    return np.bincount(x[1], r[x[0]], width)


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs and their scores (0 to 1)."""
    at = docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        memo: dict = {}
        for batch in batches:
            scores = [model.score(words(t.as_py() or ""), memo) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [f"c{k}" for k in range(batch.num_columns + 1)])

    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema) + f", c{len(docs.columns)} double"
    return plain.mapInArrow(run, schema).toDF(*docs.columns, out)


def reject(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents whose score is below the threshold, columns as they were."""
    name = fresh(docs, "_score")
    return score(docs, model, text_col, name).where(F.col(name) < threshold).drop(name)
