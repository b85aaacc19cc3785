"""LM scoring by deleted interpolation.

A text is its lower-cased words and one end token. A word's probability after its predecessor mixes the bigram and
unigram maximum-likelihood estimates and a uniform share for the unknown; the weights depend on how often the
predecessor was seen, in buckets of doubling counts, and are learned by expectation-maximisation on one in ten of the
training documents, by hash, whose own counts are taken out (a table too small to have such a document keeps the weights
of the start). Null and empty texts are one end token; words are known by 64-bit hashes; a null
doc_id counts as empty text and so is held out; repeated rows count and score as rows; very long texts are taken whole;
there is nothing to tie; extra columns are ignored, whatever their names; an empty table gives an empty result.

Work is dealt out twice: documents go into slices by a hash of the row, those for the weights into slices of their own;
each slice asks for the counts of its distinct n-grams as packed arrays, by hash range. A hash range sums up, in 64
bits, what all slices counted and answers each slice. Slices and ranges are bounded by bytes and rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import WordHash, fold, mixed, partitions, stored

END = b"\n"  # no word holds it
SLICE = 6 << 20
SLICE_ROWS = 100_000
RANGE_BYTES = 16 << 20  # text per hash range of n-grams
LEVELS = 16  # context-frequency buckets
STEPS = 4  # histogram steps per factor 2
BINS = 40 * STEPS
DEV = 10  # one document in so many is held out for the weights, in slices with numbers below 0
ROUNDS = 60


def slice_ngrams(texts: list, seen: WordHash) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unigram hashes of all tokens, bigram hashes (predecessor, token; the end token also stands before the first
    word), and the number of tokens of each text."""
    words: list[bytes] = []
    sizes = np.empty(len(texts), np.int64)
    for i, t in enumerate(texts):
        w = t.lower().split() if t else []
        words += w
        words.append(END)
        sizes[i] = len(w) + 1
    uni = mixed(seen.of(words))
    before = np.empty_like(uni)
    before[1:] = uni[:-1]
    before[:1] = mixed(seen.of([END]))
    return uni, mixed(before * np.uint64(0xA0761D6478BD642F) + uni), sizes


ASK = "slice long, kind int, part int, dev boolean, hashes binary, counts binary"
ANSWER = "slice long, kind int, part int, counts binary, dev_counts binary, kinds long, tokens long"


def _ranges(kinds: np.ndarray, parts: int) -> np.ndarray:
    """Where each of the equal hash ranges begins in sorted hashes."""
    edges = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
    return np.concatenate([[0], np.searchsorted(kinds, edges), [len(kinds)]])


def packed(counts: np.ndarray) -> bytes:
    """Counts in 4 bytes each where they fit, else in 8; the first byte tells which."""
    return b"4" + counts.astype(np.uint32).tobytes() if int(counts.max(initial=0)) < 1 << 32 else b"8" + counts.astype(np.int64).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint32 if raw[:1] == b"4" else np.int64, offset=1).astype(np.int64)


def with_slices(docs: DataFrame, size: int, rows: int) -> DataFrame:
    n = max(1, -(-size // SLICE), -(-rows // SLICE_ROWS))
    spread = F.xxhash64("doc_id", "text", F.lit(1))
    dev = F.pmod(F.xxhash64("doc_id", "text", F.lit(2)), F.lit(DEV)) == 0
    d = docs.select("doc_id", "text", (fold("doc_id", 10) == 0).alias("held_out"))
    return d.withColumn("slice", F.when(dev, -1 - F.pmod(spread, F.lit(-(-n // DEV)))).otherwise(F.pmod(spread, F.lit(n))).cast("long"))


def counts_of(sliced: DataFrame, parts: int) -> DataFrame:
    """For every slice, kind of n-gram and hash range: the corpus counts of the slice's n-grams, in hash order."""

    def ask(key, docs):
        slice_id = key[0].as_py()
        train = [not h for h in docs.column("held_out").to_pylist()]
        texts = docs.column("text").cast(pa.binary()).to_pylist()
        uni, bi, sizes = slice_ngrams(texts, WordHash())
        t = np.repeat(np.array(train, bool), sizes)
        rows = []
        for kind, h in ((1, uni), (2, bi)):
            kinds, inverse = np.unique(h, return_inverse=True)
            n = np.bincount(inverse, t, len(kinds)).astype(np.int64)
            at = _ranges(kinds, parts)
            rows += [(slice_id, kind, p, slice_id < 0, kinds[at[p] : at[p + 1]].tobytes(), packed(n[at[p] : at[p + 1]])) for p in range(parts) if at[p] < at[p + 1]]
        return pa.table([pa.array(column, f.type) for column, f in zip(zip(*rows), ASK_TYPE)], ASK_TYPE)

    def answer(rows):
        got = rows.to_pydict()
        hashes = [np.frombuffer(h, np.uint64) for h in got["hashes"]]
        counts = np.concatenate([unpacked(c) for c in got["counts"]])
        dev = np.repeat(got["dev"], [len(h) for h in hashes])
        kinds, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        total, held = np.zeros(len(kinds), np.int64), np.zeros(len(kinds), np.int64)
        np.add.at(total, inverse, counts)
        np.add.at(held, inverse[dev], counts[dev])
        known, tokens, at = int((total > 0).sum()), int(total.sum()), 0
        counts, dev_counts = [], []
        for h, held_out in zip(hashes, got["dev"]):
            of = inverse[at : at + len(h)]
            at += len(h)
            counts.append(packed(total[of]))
            dev_counts.append(packed(held[of]) if held_out else None)
        once = np.zeros(len(hashes), np.int64)
        once[0] = 1
        return pa.table(
            {
                "slice": rows.column("slice"), "kind": rows.column("kind"), "part": rows.column("part"), "counts": pa.array(counts, pa.binary()),
                "dev_counts": pa.array(dev_counts, pa.binary()), "kinds": pa.array(once * known), "tokens": pa.array(once * tokens),
            }
        )

    asked = sliced.groupBy("slice").applyInArrow(ask, ASK)
    return asked.groupBy("kind", "part").applyInArrow(answer, ANSWER)


ASK_TYPE = pa.schema([("slice", pa.int64()), ("kind", pa.int32()), ("part", pa.int32()), ("dev", pa.bool_()), ("hashes", pa.binary()), ("counts", pa.binary())])


class SliceCounts:
    """A slice's tokens with their counts, put together from its texts and the answers."""

    def __init__(self, docs: pa.Table, answers: pa.Table, held_out_counts: bool = False):
        self.texts = docs.column("text").cast(pa.binary()).to_pylist()
        uni, bi, self.sizes = slice_ngrams(self.texts, WordHash())
        got = answers.to_pydict()
        order = sorted(range(len(got["kind"])), key=lambda i: (got["kind"][i], got["part"][i]))

        def joined(kind, column):
            return np.concatenate([unpacked(got[column][i]) for i in order if got["kind"][i] == kind])

        at1, at2 = np.unique(uni, return_inverse=True)[1], np.unique(bi, return_inverse=True)[1]
        self.c1, self.c2 = joined(1, "counts")[at1], joined(2, "counts")[at2]
        if held_out_counts:
            self.c1 = self.c1 - joined(1, "dev_counts")[at1]
            self.c2 = self.c2 - joined(2, "dev_counts")[at2]
        # how often the predecessor stands before anything: its own count; the end token stands before every text
        starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.before = np.empty_like(self.c1)
        self.before[1:] = self.c1[:-1]
        ends = starts + self.sizes - 1
        if len(ends):
            self.before[starts] = self.c1[ends[0]]


def level(before: np.ndarray) -> np.ndarray:
    return np.minimum(np.ceil(np.log2(before + 1)).astype(np.int64), LEVELS - 1)


def _bin(p: np.ndarray) -> np.ndarray:
    """0 for no probability, else steps of 2 ** (1 / STEPS)."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(np.round(-np.log2(p) * STEPS), 0, BINS - 2) + 1, 0).astype(np.int64)


def learn_weights(sliced: DataFrame, answers: DataFrame, tokens: int, dev_tokens: int, kinds: int) -> np.ndarray:
    """(LEVELS, 3) weights of bigram, unigram and uniform share. Spark counts the held-out tokens by context bucket
    and the two estimates, in fine steps; this table's size doesn't depend on the corpus, and EM runs on it."""
    left = tokens - dev_tokens

    def count(key, docs, found):
        empty = pa.table({"cell": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        if not docs.num_rows or left <= 0:
            return empty
        s = SliceCounts(docs, found, True)
        train = np.repeat([not h for h in docs.column("held_out").to_pylist()], s.sizes)
        p2 = s.c2 / np.maximum(s.before, 1)
        cell = ((level(s.before) * BINS + _bin(np.minimum(p2, 1))) * BINS + _bin(s.c1 / left))[train]
        cells, n = np.unique(cell, return_counts=True)
        return pa.table({"cell": pa.array(cells, pa.int64()), "n": pa.array(n, pa.int64())})

    dev = F.col("slice") < 0
    held = sliced.where(dev).groupBy("slice").cogroup(answers.where(dev).groupBy("slice")).applyInArrow(count, "cell long, n long")
    rows = held.groupBy("cell").agg(F.sum("n").alias("n")).toPandas().sort_values("cell")
    cell, n = rows.cell.to_numpy(np.int64), rows.n.to_numpy(np.float64)
    lvl, b2, b1 = cell // BINS // BINS, cell // BINS % BINS, cell % BINS
    p = np.stack([np.where(b > 0, 2.0 ** (-(b - 1) / STEPS), 0) for b in (b2, b1)] + [np.full(len(cell), 1 / (kinds + 1))], 1)
    weights = np.tile([0.4, 0.5, 0.1], (LEVELS, 1))
    weights[0] = [0, 0.9, 0.1]
    for _ in range(ROUNDS):
        share = weights[lvl] * p
        share *= (n / share.sum(1))[:, None]
        new = np.stack([np.bincount(lvl, share[:, j], LEVELS) for j in range(3)], 1) + weights * 1.0
        weights = new / new.sum(1, keepdims=True)
    return weights


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_lm(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    size, n_rows = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    size = size or 0
    sliced = with_slices(docs, size, n_rows)
    answers = stored(counts_of(sliced, max(partitions(docs.sparkSession), -(-size // RANGE_BYTES))), "counts")
    first = answers.where("kind = 1").agg(F.sum("kinds"), F.sum("tokens")).first()
    kinds, tokens = first[0] or 0, first[1] or 0
    # tokens of the training documents that the weights are learned on
    dev = sliced.where((F.col("slice") < 0) & ~F.col("held_out"))
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)) + 1
    dev_tokens = dev.agg(F.sum(words)).first()[0] or 0
    weights = learn_weights(sliced, answers, tokens, dev_tokens, kinds)

    def run(key, rows, found):
        s = SliceCounts(rows, found)
        n = len(s.sizes)
        own = np.repeat(np.arange(n), s.sizes)
        w = weights[level(s.before)]
        p = w[:, 0] * np.minimum(s.c2 / np.maximum(s.before, 1), 1) + w[:, 1] * (s.c1 / max(tokens, 1)) + w[:, 2] / (kinds + 1)
        base = np.log10((s.c1 + 0.1) / (tokens + 0.1 * (kinds + 1)))
        return pa.table(
            {
                "doc_id": rows.column("doc_id"), "held_out": rows.column("held_out"), "n_tokens": pa.array(s.sizes, pa.int64()),
                "n_known": pa.array(np.bincount(own, s.c1 > 0, n).astype(np.int64)), "train_tokens": pa.array([tokens] * n, pa.int64()),
                "base_score": pa.array(np.bincount(own, base, n), pa.float64()), "score": pa.array(np.bincount(own, np.log10(p), n), pa.float64()),
            }
        )

    return sliced.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(run, SCORED)
