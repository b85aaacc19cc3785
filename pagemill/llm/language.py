"""Language ID by multilingual mixture inference.

Every language has a distribution over hashed byte trigrams, counted in Spark over all training rows. A document is a
mixture of languages: expectation-maximisation finds the proportions, then languages are dropped from the set as long
as the penalised likelihood rises. The prediction is the language of the largest share, of equal shares the first by
name. Null texts, texts without a letter and all texts when nothing was learned are `und` with score 0; very long texts
are taken whole; rows with null lang teach nothing; repeated rows count as rows; extra columns are ignored, by
keep_languages kept, whatever their names; an empty table gives an empty result. What reaches the driver is languages
times bins; more than LANGUAGES distinct values of lang raise an error, as they aren't languages."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import fold, slices

SPACE = 1 << 14
LANGUAGES = 1_000
LETTER = regex.compile(r"\p{L}")
# Bytes that say nothing about the language become a space: controls, digits, ASCII punctuation.
PLAIN = bytes(c + 32 if 65 <= c < 91 else (c if 97 <= c < 123 or c >= 128 else 32) for c in range(256))


def trigrams(text: bytes) -> np.ndarray:
    """Hashed byte trigrams of a whole text, case and punctuation folded; runs of spaces count once."""
    b = np.frombuffer(b" " + b" ".join(text.translate(PLAIN).split()) + b" ", np.uint8).astype(np.uint32)
    h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
    return ((h ^ (h >> np.uint32(15))) * np.uint32(0x27D4EB2F)) >> np.uint32(18)


class Languages:
    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = names
        p = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * SPACE) if len(names) else counts
        self.p = np.ascontiguousarray(p.T)

    def mixture(self, bins: np.ndarray, n: np.ndarray, use: list[int], start: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
        like = self.p[bins][:, use]
        share = start
        for _ in range(rounds):
            joint = like * share
            total = joint.sum(1)
            new = (n / total) @ joint / n.sum()
            done = np.abs(new - share).max() < 1e-4
            share = new
            if done:
                break
        return share, float(n @ np.log(like @ share))

    def predict(self, text: bytes | None) -> tuple[str, float, dict[str, float]]:
        if not self.names or not text or not LETTER.search(text.decode("utf-8", "replace")):
            return "und", 0.0, {}
        bins, n = np.unique(trigrams(text), return_counts=True)
        n = n.astype(np.float64)
        use = list(range(len(self.names)))
        share, fit = self.mixture(bins, n, use, np.full(len(use), 1 / len(use)), 15)
        penalty = 0.5 * np.log(n.sum() + 1) + 2.0
        while len(use) > 1:
            worst = int(share.argmin())
            rest = use[:worst] + use[worst + 1 :]
            start = np.maximum(np.delete(share, worst), 1e-6)
            less, fit_less = self.mixture(bins, n, rest, start / start.sum(), 8 if len(rest) > 1 else 1)
            if fit_less + penalty < fit:
                break
            use, share, fit = rest, less, fit_less
        best = int(share.argmax())
        return self.names[use[best]], float(min(1.0, share[best])), {self.names[i]: float(s) for i, s in zip(use, share)}


def fit_languages(docs: DataFrame) -> Languages:
    """Counts per language and bin over all rows outside the held-out fold; what reaches the driver has the size
    languages x bins."""

    def run(batches):
        sums: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(SPACE, np.int64))
        for batch, texts in slices(batches, "text"):
            for lang, t in zip(batch.column("lang").to_pylist(), texts):
                sums[lang] += np.bincount(trigrams(t), minlength=SPACE)
        for lang, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], ["lang", "bin", "n"])

    train = docs.where((fold("doc_id", 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    kinds = train.select("lang").distinct().limit(LANGUAGES + 1).count()
    if kinds > LANGUAGES:
        raise ValueError(f"lang has more than {LANGUAGES} distinct values")
    rows = train.mapInArrow(run, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(set(rows.lang))
    counts = np.zeros((len(names), SPACE))
    place = {name: i for i, name in enumerate(names)}
    counts[rows.lang.map(place).to_numpy(np.int64), rows.bin.to_numpy(np.int64)] = rows.n
    return Languages(names, counts)


def predict_languages(docs: DataFrame, model: Languages) -> DataFrame:
    """doc_id, held_out, lang_pred, score, and the shares of all languages found, for every row."""

    def run(batches):
        for batch, texts in slices(batches, "text"):
            found = [model.predict(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array([f[0] for f in found]), pa.array([f[1] for f in found], pa.float64()), pa.array([list(f[2].items()) for f in found], pa.map_(pa.string(), pa.float64()))],
                ["doc_id", "held_out", "lang_pred", "score", "shares"],
            )

    d = docs.select("doc_id", "text", (fold("doc_id", 4) == 2).alias("held_out"))
    return d.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, shares map<string,double>")


def keep_languages(docs: DataFrame, model: Languages, least: float = 0.4) -> DataFrame:
    """Rows with a language that makes up at least `least` of the text."""
    columns = docs.columns

    def run(batches):
        for batch, texts in slices(batches, "text"):
            found = [model.predict(t) for t in texts]
            yield batch.select(columns).filter(pa.array([f[0] != "und" and f[1] >= least for f in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
