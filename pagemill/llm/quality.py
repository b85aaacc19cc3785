"""Quality classifier: histogram gradient-boosted trees over document statistics, flattened into arrays.

The trees are fitted on at most `sample` labelled rows outside the held-out fold, those with the smallest hashes of
doc_id; of rows with one id the smallest text is learned. Statistics come from the whole text, however long. Null and
empty texts have all statistics 0 and get the score of that row; rows of equal text tie with equal scores; without labels
of both classes every score is the share of label 1 (0.5 without labels); repeated rows are scored each; extra columns
are ignored, by keep_quality kept, whatever their names; an empty table gives an empty result."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import fold, slices

SAMPLE = 20_000
BINS = 64
N_FEATURES = 18


def features(text: bytes | None) -> np.ndarray:
    """Counts and ratios of bytes and words of a whole text."""
    out = np.zeros(N_FEATURES)
    if not text:
        return out
    b = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n = len(text)
    upper, lower, digit, space = b[65:91].sum(), b[97:123].sum(), b[48:58].sum(), b[9:14].sum() + b[32]
    high = b[128:].sum()
    words = text.split()
    nw = len(words)
    if not nw:
        return out
    lens = np.fromiter(map(len, words), np.int64, nw)
    kinds = len(set(words))
    repeats = sum(map(bytes.__eq__, words[1:], words[:-1]))
    lines = text.split(b"\n")
    punct = n - upper - lower - digit - space - high
    out[:] = (
        np.log1p(n), np.log1p(nw), lens.mean(), lens.std(), upper / n, lower / n, digit / n, space / n, punct / n, high / n,
        kinds / nw, repeats / nw, len(set(lines)) / len(lines), nw / len(lines), (b[33] + b[63]) / nw, (b[46] + b[44]) / nw,
        (b[35] + b[36] + b[37] + b[38] + b[42] + b[124] + b[60] + b[62] + b[123] + b[125]) / nw, np.log1p(nw) - np.log1p(kinds),
    )
    return out


class Trees:
    """Boosted trees of one depth, flattened: inner node i has the children 2i+1 and 2i+2; arrays (trees, nodes)."""

    def __init__(self, base: float, depth: int):
        self.base, self.depth = base, depth
        self.feature: list[np.ndarray] = []
        self.cut: list[np.ndarray] = []
        self.leaf: list[np.ndarray] = []

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += leaf[at - len(f)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, l2: float = 1.0) -> Trees:
    """Newton boosting of the log loss; each feature in BINS quantile bins."""
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    model = Trees(float(np.log(share / (1 - share))), depth)
    if len(set(y.tolist())) < 2:
        return model
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    margin = np.full(len(y), model.base)
    inner = 2**depth - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            local = node - first
            bin_cut = np.full(width, BINS)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                slot = local * BINS + binned[:, j]
                gs = np.bincount(slot, g, width * BINS).reshape(width, BINS).cumsum(1)
                hs = np.bincount(slot, h, width * BINS).reshape(width, BINS).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                ok = (hs > 1) & (ht - hs > 1)
                gain = np.where(ok, gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2), 0)[:, : len(c)]
                k = gain.argmax(1)
                top = gain[np.arange(width), k]
                better = top > best
                best[better] = top[better]
                feature[first : first + width][better] = j
                cut[first : first + width][better] = c[k[better]]
                bin_cut[better] = k[better]
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > bin_cut[local])
        slot = node - inner
        leaf = -rate * np.bincount(slot, g, inner + 1) / (np.bincount(slot, h, inner + 1) + l2)
        margin += leaf[slot]
        model.feature.append(feature)
        model.cut.append(cut)
        model.leaf.append(leaf)
    return model


def training_rows(docs: DataFrame, labels: DataFrame, label: str, held_out, sample: int) -> DataFrame:
    """doc_id, text, y of at most `sample` labelled documents, of rows with one id the one with the smallest text; the ids
    are bounded, so they are broadcast."""
    picked = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    def run(batches):
        for batch in batches:
            x = [features(t).tobytes() for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.binary()), batch.column("y")], ["doc_id", "x", "y"])

    rows = training_rows(docs, labels, "quality", fold("doc_id", 3) == 1, sample).mapInArrow(run, "doc_id long, x binary, y int").toPandas().sort_values("doc_id")
    x = np.frombuffer(b"".join(rows.x), np.float64).reshape(-1, N_FEATURES)
    return fit_trees(x, rows.y.to_numpy(np.float64))


def score_quality(docs: DataFrame, model: Trees) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            s = model.score(np.stack([features(t) for t in texts]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    d = docs.select("doc_id", "text", (fold("doc_id", 3) == 1).alias("held_out"))
    return d.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_quality(docs: DataFrame, model: Trees) -> DataFrame:
    """The rows of docs that the model doesn't reject, with all their columns."""
    schema, columns = docs.schema, docs.columns

    def run(batches):
        for batch, texts in slices(batches, "text"):
            s = model.score(np.stack([features(t) for t in texts]))
            yield batch.select(columns).filter(pa.array(s >= 0.5))

    return docs.mapInArrow(run, schema)
