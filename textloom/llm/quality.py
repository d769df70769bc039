"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics of a text are computed in an Arrow function. Trees are grown on the driver from a bounded sample of
labelled rows (histograms of binned statistics, Newton steps on the logistic loss) and flattened into arrays; scoring
walks all trees for all rows of a batch at once in numpy.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from .common import held_out, quoted

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Labelled rows that a model learns from at most (those with the smallest hashes of their ids).
SAMPLE = 20_000
SYMBOLS = b".,!?;:|%$&*#@/\\<>()[]{}\"'-_=+~^`0"
N_FEATURES = 26 + len(SYMBOLS)


def statistics(text: bytes):
    """The document statistics of a UTF-8 text: shares of characters, words and lines of several kinds."""
    import numpy as np
    from collections import Counter

    n = max(1, len(text))
    c = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    nw, nl = max(1, len(words)), max(1, len(lines))
    of_word = Counter(words)
    of_line = Counter(lines)
    most = [k for _, k in of_word.most_common(3)] + [0, 0, 0]
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    upper, lower, digit, high = c[65:91].sum(), c[97:123].sum(), c[48:58].sum(), c[128:].sum()
    bare = [w for w in words if w.isalpha()]
    p = c[c > 0] / n
    out = [
        np.log1p(len(text)), np.log1p(len(words)), np.log1p(len(lines)),
        upper / n, lower / n, digit / n, high / n, c[32] / n, c[10] / n, c[9] / n,
        upper / max(1, upper + lower), (n - upper - lower - digit - high - c[32] - c[10]) / n,
        len(of_word) / nw, most[0] / nw, sum(most[:3]) / nw, sum(1 for k in of_word.values() if k == 1) / nw,
        lengths.mean(), lengths.std(), np.log1p(lengths.max()), (lengths <= 2).mean(), (lengths >= 12).mean(),
        len(bare) / nw, len(of_line) / nl, nw / nl, sum(len(x) * (k - 1) for x, k in of_line.items()) / n,
        float(-(p * np.log(p)).sum()),
    ]
    return np.concatenate([out, c[np.frombuffer(SYMBOLS, np.uint8)] / nw]).astype(np.float32)


@dataclass(frozen=True)
class Trees:
    """All nodes of all trees in flat arrays; a leaf is its own child."""

    roots: object
    feature: object
    threshold: object
    left: object
    right: object
    value: object
    depth: int
    base: float

    def score(self, x):
        """Probability of label 1 for each row of x."""
        import numpy as np

        out = np.full(len(x), self.base)
        for at in range(0, len(x), 4096):
            part = x[at : at + 4096]
            node = np.repeat(self.roots[None, :], len(part), axis=0)
            rows = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                node = np.where(part[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out[at : at + 4096] += self.value[node].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def grow(x, y, trees: int = 120, depth: int = 4, bins: int = 64, rate: float = 0.1, least: float = 5.0, ridge: float = 1.0) -> Trees:
    """Boosted trees for labels y (0 or 1). Without rows, or with one class only, a constant."""
    import numpy as np

    none = np.zeros(0)
    p = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(p / (1 - p)))
    if not len(y) or y.min() == y.max():
        z = np.zeros(1, np.int32)
        return Trees(z, z, np.zeros(1, np.float32), z, z, np.zeros(1), 1, base)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32)) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(x.shape[1])], axis=1).astype(np.int64)
    roots, feature, threshold, left, right, value = [], [], [], [], [], []
    margin = np.full(len(y), base)

    def leaf() -> int:
        k = len(feature)
        feature.append(0), threshold.append(0.0), left.append(k), right.append(k), value.append(0.0)
        return k

    for _ in range(trees):
        prob = 1 / (1 + np.exp(-margin))
        g, h = prob - y, prob * (1 - prob)
        at = np.zeros(len(y), np.int64)
        level = [leaf()]
        roots.append(level[0])
        at[:] = level[0]
        for _ in range(depth):
            slot = {k: i for i, k in enumerate(level)}
            of = np.full(len(feature), -1)
            of[level] = range(len(level))
            live = np.flatnonzero(of[at] >= 0)
            if not len(live):
                break
            s = of[at[live]]
            best = np.full(len(level), 1e-6)
            how: list = [None] * len(level)
            for f in range(x.shape[1]):
                if not len(cuts[f]):
                    continue
                key = s * bins + binned[live, f]
                gs = np.bincount(key, g[live], len(level) * bins).reshape(-1, bins)
                hs = np.bincount(key, h[live], len(level) * bins).reshape(-1, bins)
                gl, hl = gs.cumsum(1), hs.cumsum(1)
                ga, ha = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
                gain[(hl < least / 4) | (ha - hl < least / 4)] = 0
                gain = gain[:, : len(cuts[f])]
                k = gain.argmax(1)
                top = gain[np.arange(len(level)), k]
                for i in np.flatnonzero(top > best):
                    best[i], how[i] = top[i], (f, k[i])
            following = []
            for node, i in slot.items():
                if how[i] is None:
                    continue
                f, k = how[i]
                a, b = leaf(), leaf()
                feature[node], threshold[node], left[node], right[node] = f, cuts[f][k], a, b
                own = live[s == i]
                go = binned[own, f] <= k
                at[own] = np.where(go, a, b)
                following += [a, b]
            level = following
            if not level:
                break
        gs, hs = np.bincount(at, g, len(feature)), np.bincount(at, h, len(feature))
        for k in np.unique(at):
            value[k] = -rate * gs[k] / (hs[k] + ridge)
        margin += np.array(value)[at]
    del none
    return Trees(np.array(roots, np.int32), np.array(feature, np.int32), np.array(threshold, np.float32), np.array(left, np.int32), np.array(right, np.int32), np.array(value), depth, base)


def _with_statistics(rows: DataFrame) -> DataFrame:
    """rows(doc_id, text, ...) to doc_id and x, the statistics."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            x = np.array([statistics(t.as_py() or b"") for t in b.column("text").cast(pa.binary())], np.float32).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * N_FEATURES), pa.array(x.ravel()))], ["doc_id", "x"])

    return rows.select("doc_id", "text").mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, x array<float>")


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text: str = "text", doc_id: str = "doc_id") -> Trees:
    """Trees that tell quality 1 from 0, from at most `sample` labelled rows that aren't held out.

    The sample's ids (a bounded number) go to every task; an id that labels or docs repeat counts once, with its
    larger label and text statistics. Null labels and ids are passed over.
    """
    import numpy as np

    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("label_id")).agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("label_id"), "label_id").limit(sample)
    rows = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text")).join(F.broadcast(known.select("label_id")), F.col("doc_id") == F.col("label_id"), "left_semi")
    found = _with_statistics(rows).groupBy("doc_id").agg(F.max("x").alias("x")).join(known, F.col("doc_id") == F.col("label_id")).select("doc_id", "x", "quality").toPandas()
    found = found.sort_values("doc_id")
    x = np.array(found["x"].tolist(), np.float32).reshape(-1, N_FEATURES)
    return grow(x, found["quality"].to_numpy(np.float64))


def predict(docs: DataFrame, model: Trees, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= 0.5) of each row.

    Null and empty texts are scored by the statistics of an empty text. Repeated rows get equal scores; labels,
    language, source and id aren't inputs.
    """
    rows = docs.select(quoted(doc_id).alias("doc_id"), quoted(text).alias("text"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            x = np.array([statistics(t.as_py() or b"") for t in b.column("text").cast(pa.binary())], np.float32).reshape(-1, N_FEATURES)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    scored = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def good_rows(docs: DataFrame, model: Trees, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of docs whose score is at least `least`, with all their columns, whatever their names; null texts are scored as empty."""
    names = docs.columns
    at = names.index(text)
    plain = docs.toDF(*(f"c{k}" for k in range(len(names))))  # a name with a dot can't go through mapInArrow

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            x = np.array([statistics(t.as_py() or b"") for t in b.column(at).cast(pa.binary())], np.float32).reshape(-1, N_FEATURES)
            yield b.filter(pa.array(model.score(x) >= least))

    return plain.mapInArrow(run, plain.schema).toDF(*names)
