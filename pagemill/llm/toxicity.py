"""Toxicity: a factorization machine over hashed terms.

A text is the set of its hashed words (lower-cased A-Z, punctuation at the ends cut). Besides a weight, every term has
a vector; the products of two terms' vectors tell what the words mean together. It is fitted on at most `sample`
labelled rows outside the held-out fold. Terms get a weight and a vector if they depend on the label alone, or in pairs:
of the PAIR_TERMS most frequent terms every two are counted, and both are taken if the label with both of them is not
what it is with each alone. Terms of fewer than MIN_ROWS of the sampled rows are left out, as they say nothing about
others. The point at which a score is 0.5 comes from two machines, each fitted on half of the rows and scored on the
other half.

Null, empty and unknown texts get the base score; very long texts are taken whole; repeated words count once; repeated
rows are scored each, and of rows with one id the smallest text is learned; texts with the same terms tie with equal
scores; extra columns are ignored, whatever their names; an empty table gives an empty result; without labels of both
classes all scores are the share of label 1."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagemill.llm.common import WordHash, fold, slices
from pagemill.llm.quality import training_rows

SAMPLE = 20_000
SPACE = 1 << 22
CHI2 = 20.0  # of a term and the label
PAIR_CHI2 = 60.0  # of two terms and the label, beyond each alone
PAIR_TERMS = 1_024
MIN_ROWS = 3
RANK = 4
EDGES = b".,;:!?\"'()[]{}*#&$%|-_"


class TermHash(WordHash):
    def __missing__(self, word: bytes) -> int:
        value = super().__missing__(word.lower().strip(EDGES))
        self[word] = value
        return value


def terms(text: bytes | None, seen: TermHash) -> np.ndarray:
    """Distinct hashed terms of a whole text, sorted."""
    if not text:
        return np.zeros(0, np.int32)
    return np.unique((seen.of(list(set(text.split()))) % np.uint64(SPACE)).astype(np.int32))


class Machine:
    def __init__(self, chosen: np.ndarray, base: float, seed: int = 7):
        self.chosen = chosen
        self.base = base
        self.w = np.zeros(len(chosen))
        self.v = np.random.default_rng(seed).normal(0, 0.05, (len(chosen), RANK))

    def locate(self, found: np.ndarray) -> np.ndarray:
        if not len(self.chosen):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.chosen, found), len(self.chosen) - 1)
        return at[self.chosen[at] == found]

    def margin(self, row: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        total = np.stack([np.bincount(row, self.v[at, f], n) for f in range(RANK)], 1)
        squares = np.bincount(row, (self.v[at] ** 2).sum(1), n)
        return self.base + np.bincount(row, self.w[at], n) + 0.5 * ((total**2).sum(1) - squares), total

    def score(self, found: list[np.ndarray]) -> np.ndarray:
        ats = [self.locate(f) for f in found]
        row = np.repeat(np.arange(len(ats)), [len(a) for a in ats])
        at = np.concatenate(ats) if ats else np.zeros(0, np.int64)
        return 1 / (1 + np.exp(-np.clip(self.margin(row, at.astype(np.int64), len(ats))[0], -30, 30)))


def dependent_pairs(slot: np.ndarray, owner: np.ndarray, y: np.ndarray, m: int) -> np.ndarray:
    """Which of m terms are in a pair whose joint presence shifts the label from where the terms put it by themselves.
    slot, owner: term and row of every occurrence."""
    x = np.zeros((len(y), m), np.float32)
    x[owner, slot] = 1
    both, hits = x.T @ x, (x * y[:, None].astype(np.float32)).T @ x
    df, p = np.maximum(both.diagonal(), 1), y.mean()
    odds = np.log((hits.diagonal() + 0.5) / (df - hits.diagonal() + 0.5)) - np.log(p / (1 - p))
    # the label's share if each term shifted the odds as it does alone
    q = 1 / (1 + np.exp(-np.clip(np.log(p / (1 - p)) + odds[:, None] + odds[None, :], -15, 15)))
    chi2 = (hits - both * q) ** 2 / np.maximum(both * q * (1 - q), 1.0)
    chi2[(both < MIN_ROWS) | (both >= 0.9 * np.minimum(df[:, None], df[None, :]))] = 0
    np.fill_diagonal(chi2, 0)
    return (chi2 >= PAIR_CHI2).any(1)


def chosen_terms(found: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    n, p = len(y), y.mean()
    flat, owner = np.concatenate(found), np.repeat(np.arange(n), [len(f) for f in found])
    kinds, inverse = np.unique(flat, return_inverse=True)
    df, pos = np.bincount(inverse), np.bincount(inverse, y[owner])
    expected = df * p
    chi2 = (pos - expected) ** 2 / (expected * (1 - p)) * n / np.maximum(n - df, 1)
    keep = (chi2 >= CHI2) & (df >= MIN_ROWS)
    often = np.argsort(-df, kind="stable")[:PAIR_TERMS]
    often = often[(df[often] >= MIN_ROWS) & (df[often] < n)]
    if len(often):
        slot = np.full(len(kinds), -1)
        slot[often] = np.arange(len(often))
        some = slot[inverse] >= 0
        keep[often[dependent_pairs(slot[inverse][some], owner[some], y, len(often))]] = True
    return kinds[keep]


def descend(m: Machine, found: list[np.ndarray], y: np.ndarray, epochs: int, rate: float, l2: float) -> Machine:
    """Adagrad on the log loss."""
    n, p = len(y), y.mean()
    ats = [m.locate(f) for f in found]
    start = np.concatenate([[0], np.cumsum([len(a) for a in ats])])
    at = np.concatenate(ats)
    gw, gv, gb = np.full(m.w.shape, 1e-3), np.full(m.v.shape, 1e-3), 1e-3
    cost = np.where(y > 0, np.sqrt(max(1.0, (1 - p) / p)), 1.0)  # the rarer label 1 counts more
    rng = np.random.default_rng(11)
    for _ in range(epochs):
        order = rng.permutation(n)
        for k in range(0, n, 512):
            docs = order[k : k + 512]
            sizes = start[docs + 1] - start[docs]
            row = np.repeat(np.arange(len(docs)), sizes)
            a = at[np.repeat(start[docs] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]
            margin, total = m.margin(row, a, len(docs))
            err = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[docs]) * cost[docs] / len(docs)
            dw = np.bincount(a, err[row], len(m.w)) + l2 * m.w
            dv = np.stack([np.bincount(a, err[row] * (total[row, f] - m.v[a, f]), len(m.w)) for f in range(RANK)], 1) + l2 * m.v
            gw += dw**2
            gv += dv**2
            gb += err.sum() ** 2
            m.w -= rate * dw / np.sqrt(gw)
            m.v -= rate * dv / np.sqrt(gv)
            m.base -= rate * err.sum() / np.sqrt(gb)
    return m


def threshold(margin: np.ndarray, y: np.ndarray) -> float:
    """The margin that parts the labels best, by the mean of the shares of both that lie on their side; amid equal ones."""
    order = np.argsort(margin, kind="stable")
    m, one = margin[order], y[order]
    under = np.concatenate([[0], np.cumsum(1 - one)]) / max((1 - one).sum(), 1)
    over = 1 - np.concatenate([[0], np.cumsum(one)]) / max(one.sum(), 1)
    cuts = np.concatenate([[m[0] - 1], (m[1:] + m[:-1]) / 2, [m[-1] + 1]])
    best = np.flatnonzero(under + over >= (under + over).max() - 1e-12)
    return float((cuts[best[0]] + cuts[best[-1]]) / 2)


def fit_machine(found: list[np.ndarray], y: np.ndarray, epochs: int = 40, rate: float = 0.1, l2: float = 1e-4) -> Machine:
    n = len(y)
    share = (y.sum() + 0.5) / (n + 1) if n else 0.5
    base = float(np.log(share / (1 - share)))
    if n == 0 or not 0 < y.sum() < n:
        return Machine(np.zeros(0, np.int32), base)
    terms_ = chosen_terms(found, y)
    if not len(terms_):
        return Machine(terms_, base)
    half = np.arange(n) % 2
    cuts = []
    for side in (0, 1):
        fit, test = np.flatnonzero(half == side), np.flatnonzero(half != side)
        if 0 < y[fit].sum() < len(fit) and 0 < y[test].sum() < len(test):
            own = chosen_terms([found[i] for i in fit], y[fit])
            part = descend(Machine(own, base), [found[i] for i in fit], y[fit], epochs, rate, l2)
            s = part.score([found[i] for i in test])
            cuts.append(threshold(np.log(s / (1 - s)), y[test]))
    m = descend(Machine(terms_, base), found, y, epochs, rate, l2)
    m.base -= float(np.mean(cuts)) if cuts else 0.0
    return m


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    def run(batches):
        seen = TermHash()
        for batch, texts in slices(batches, "text"):
            x = [terms(t, seen).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.binary()), batch.column("y")], ["doc_id", "x", "y"])

    rows = training_rows(docs, labels, "toxic", fold("doc_id", 5) == 0, sample).mapInArrow(run, "doc_id long, x binary, y int").toPandas().sort_values("doc_id")
    return fit_machine([np.frombuffer(x, np.int32) for x in rows.x], rows.y.to_numpy(np.float64))


def score_toxicity(docs: DataFrame, model: Machine) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""

    def run(batches):
        seen = TermHash()
        for batch, texts in slices(batches, "text"):
            s = model.score([terms(t, seen) for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    d = docs.select("doc_id", "text", (fold("doc_id", 5) == 0).alias("held_out"))
    return d.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
