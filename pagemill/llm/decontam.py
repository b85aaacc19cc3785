"""Benchmark decontamination: SimHash fingerprints of item-sized windows, multi-index Hamming blocks, exact check.

Words are lower-cased (A-Z), punctuation at their ends is cut, empty words fall out. Items and windows are sets of
5-word shingles (of all words, where an item has fewer), weighted by rarity among all items, which Spark counts. A match
is a window that has at least 0.8 of its item's weight. Such a window shares a shingle with the item, so windows are laid
where a document's shingle is one of an item, and those whose known shingles weigh too little for any item of their length
fall out. Each other window gets a fingerprint of 256 bits from its known shingles, and is compared with the items of its
length within RADIUS bits.

The root of a weight is what a shingle adds to a bit, so that the cosine of window and item is the root of the share that
they have in common, if the window knows nothing else: at 0.8 they differ in 38 bits on average (standard deviation 6),
and in 52 if other items' shingles fill the rest; unrelated ones differ in 128 (standard deviation 8). The blocks are of 16
bits: within the radius, one of the first RADIUS % 16 + 1 blocks differs in RADIUS // 16 bits at most, or one of the others
in one less, so that the tables of block values give every item within the radius. The tests measure both sides: what the
radius loses against the exact check and how many unrelated items it lets pass.

Null and empty texts and items match nothing; very long texts are taken whole, a piece of their windows at a time;
repeated items and rows are matched each; there is nothing to tie, as every match is returned; an empty table or
benchmark matches nothing; a null doc_id is carried on; extra columns are ignored by contaminated and kept by
decontaminate, whatever their names. Items go to the tasks in blocks bounded in rows and bytes, which don't change any
result; a benchmark over one block costs another pass per block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import WordHash, mixed, shingles, slices, stored
from pagemill.llm.toxicity import EDGES

K = 5
SIMILAR = 0.8
BITS = 256
RADIUS = 79  # of the bits
BLOCK = 50_000  # items
BLOCK_BYTES = 32 << 20  # of their words, shingles and fingerprints
ITEM_BYTES = 256  # of a fingerprint, its block values and the places of them
PLACES = 1 << 20  # places of shingles in items that are looked at at once
SPAN = 1 << 12  # shingles of a document whose running sums are held at once


class PlainHash(WordHash):
    def __missing__(self, word: bytes) -> int:
        plain = word.lower().strip(EDGES)
        value = self[word] = super().__missing__(plain) if plain else 0
        return value


def plain_words(text: bytes | None, seen: PlainHash) -> np.ndarray:
    h = seen.of((text or b"").split())
    return h[h != 0]


class BitSums:
    """Sums of the signed weights of each bit over the shingles from one place to another; the running sums of SPAN
    shingles are held at once. A weight is changed by up to a thousandth, by its shingle, so that bits don't tie."""

    def __init__(self, h: np.ndarray, weight: np.ndarray):
        self.h = h
        self.w = np.sqrt(weight) * (1 + (h >> np.uint64(44)) / 1e9)
        self.low = self.high = 0
        self.sums = np.zeros((1, BITS))

    def signed(self, begin: int, end: int) -> np.ndarray:
        h = np.stack([mixed(self.h[begin:end] + np.uint64(j)) for j in range(BITS // 64)], 1).astype("<u8")
        return (np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").astype(np.float32) * 2 - 1) * self.w[begin:end, None]

    def between(self, begin: int, end: int) -> np.ndarray:
        if end - begin > SPAN:
            return np.sum([self.signed(i, min(i + SPAN, end)).sum(0) for i in range(begin, end, SPAN)], axis=0)
        if begin < self.low or end > self.high:
            self.low, self.high = begin, min(len(self.h), begin + SPAN)
            self.sums = np.zeros((self.high - self.low + 1, BITS))
            np.cumsum(self.signed(self.low, self.high), axis=0, out=self.sums[1:])
        return self.sums[end - self.low] - self.sums[begin - self.low]

    def fingerprint(self, begin: int, end: int) -> np.ndarray:
        """The bits in blocks of 16."""
        return np.packbits(self.between(begin, end) > 0, bitorder="little").view("<u2")


class Prints:
    """Fingerprints and, by block, the distinct values of its 16 bits with the fingerprints that have them."""

    def __init__(self, prints: np.ndarray, radius: int):
        m, blocks = prints.shape
        self.whole, self.radius = np.ascontiguousarray(prints).view("<u8"), radius
        keys = (np.arange(blocks, dtype=np.uint32) << np.uint32(16))[:, None] | prints.T
        keys, inverse = np.unique(keys.ravel(), return_inverse=True)
        self.block, self.value = (keys >> np.uint32(16)).astype(np.uint8), (keys & np.uint32(0xFFFF)).astype(np.uint16)
        self.owner = (np.argsort(inverse, kind="stable") % m).astype(np.int32)
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(inverse))])
        self.reach = np.where(self.block <= radius % blocks, radius // blocks, radius // blocks - 1).astype(np.int8)

    def within(self, print_: np.ndarray) -> np.ndarray:
        near = np.flatnonzero(np.bitwise_count(self.value ^ print_[self.block]) <= self.reach)
        many = self.begin[near + 1] - self.begin[near]
        found = np.unique(self.owner[np.repeat(self.begin[near] - (np.cumsum(many) - many), many) + np.arange(many.sum())])
        return found[np.bitwise_count(self.whole[found] ^ print_.view("<u8")).sum(1) <= self.radius]


class Items:
    """Items of one shingle length, by their number of words. df: in how many of the `total` items of this shingle
    length each of the sorted shingles `known` is."""

    def __init__(self, k: int, ids: list[int], words: list[np.ndarray], known: np.ndarray, df: np.ndarray, total: int, radius: int = RADIUS):
        self.k, self.ids, self.known, self.radius = k, ids, known, radius
        runs = [shingles(w, k) for w in words]
        self.weight = np.log1p(total / df)
        self.sets = [known.searchsorted(np.unique(r)) for r in runs]
        self.total = np.array([self.weight[s].sum() for s in self.sets])
        # every place of a known shingle in an item: item and offset, by shingle
        where = np.concatenate([known.searchsorted(r) for r in runs])
        order = np.argsort(where, kind="stable")
        self.offset = np.concatenate([np.arange(len(r)) for r in runs])[order]
        self.length = np.repeat([len(w) for w in words], [len(r) for r in runs])[order]
        self.begin = np.searchsorted(where[order], np.arange(len(known) + 1))
        self.by_length = {}
        for n in sorted({len(w) for w in words}):
            of = [i for i, w in enumerate(words) if len(w) == n]
            prints = np.stack([BitSums(runs[i], self.weight[known.searchsorted(runs[i])]).fingerprint(0, len(runs[i])) for i in of])
            self.by_length[n] = (np.array(of), Prints(prints, radius), SIMILAR * self.total[of].min() - 1e-9)

    def windows(self, places: np.ndarray, at: np.ndarray, n_words: int) -> np.ndarray:
        """(length, begin) of the item-sized windows around the places of known shingles."""
        many = self.begin[at[places] + 1] - self.begin[at[places]]
        upto, out, i = np.cumsum(many), [], 0
        while i < len(places):
            stop = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + PLACES, "right")))
            m = many[i:stop]
            entry = np.repeat(self.begin[at[places[i:stop]]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            start = np.repeat(places[i:stop], m) - self.offset[entry]
            out.append(np.unique(np.stack([np.clip(start, 0, n_words), self.length[entry]], 1), axis=0))
            i = stop
        return np.unique(np.concatenate(out), axis=0)[:, ::-1]

    def matches(self, words: np.ndarray) -> dict[int, float]:
        """Index of each matching item and its best similarity."""
        if len(words) < self.k:
            return {}
        h = shingles(words, self.k)
        at = np.minimum(self.known.searchsorted(h), len(self.known) - 1)
        hit = self.known[at] == h
        places = np.flatnonzero(hit)
        if not len(places):
            return {}
        out: dict[int, float] = {}
        hits = at[places]
        sums, weight = BitSums(h[places], self.weight[hits]), np.concatenate([[0], np.cumsum(self.weight[hits])])
        windows = self.windows(places, at, len(words))
        low = np.searchsorted(places, windows[:, 1])
        high = np.searchsorted(places, windows[:, 1] + windows[:, 0] - self.k + 1)
        for n, lo, hi in zip(windows[:, 0].tolist(), low.tolist(), high.tolist()):  # in the order of their begin
            of, prints, least = self.by_length[n]
            if weight[hi] - weight[lo] < least:
                continue
            found = of[prints.within(sums.fingerprint(lo, hi))]
            inside = np.unique(hits[lo:hi]) if len(found) else None
            for i in found.tolist():
                shared = np.intersect1d(inside, self.sets[i], assume_unique=True)
                similar = self.weight[shared].sum() / self.total[i]
                if similar >= SIMILAR - 1e-12 and similar > out.get(i, 0):
                    out[i] = float(min(1.0, similar))
        return out


def counted_items(benchmark: DataFrame) -> DataFrame:
    """item_id, k, words and the item's distinct shingles with the number of items that have them, for every item with
    words. The counts are over the whole benchmark."""

    def hashed(batches):
        seen = PlainHash()
        for batch, texts in slices(batches, "text"):
            words = [plain_words(t, seen) for t in texts]
            k = [min(K, len(w)) for w in words]
            rows = pa.RecordBatch.from_arrays([batch.column("row"), batch.column("item_id"), pa.array(k, pa.int32()), pa.array([w.tobytes() for w in words], pa.binary())], ["row", "item_id", "k", "words"])
            yield rows.filter(pa.array([n > 0 for n in k], pa.bool_()))

    def spread(batches):
        for batch in batches:
            for row, k, raw in zip(*(batch.column(c).to_pylist() for c in ("row", "k", "words"))):
                h = np.unique(shingles(np.frombuffer(raw, np.uint64), k)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(h), pa.int64()), pa.array([k] * len(h), pa.int32()), pa.array(h)], ["row", "k", "h"])

    items = benchmark.select(F.monotonically_increasing_id().alias("row"), F.col("item_id").cast("long").alias("item_id"), "text")
    items = stored(items.mapInArrow(hashed, "row long, item_id long, k int, words binary"), "items")
    each = items.mapInArrow(spread, "row long, k int, h long")
    df = each.groupBy("k", "h").agg(F.count("*").alias("df"))
    of = each.join(df, ["k", "h"]).groupBy("row").agg(F.collect_list(F.struct("h", "df")).alias("shingles"))
    return stored(items.join(of, "row").select("item_id", "k", "words", F.col("shingles.h").alias("h"), F.col("shingles.df").alias("df")), "counted")


def item_blocks(benchmark: DataFrame, block: int = BLOCK) -> Iterator[list[Items]]:
    """The benchmark in blocks that are small enough to go with the tasks."""
    items = counted_items(benchmark)
    totals = {r.k: r["count"] for r in items.groupBy("k").count().collect()}
    rows: list = []

    def built():
        out = []
        for k in sorted({r.k for r in rows}):
            of = [r for r in rows if r.k == k]
            known, first = np.unique(np.array([h for r in of for h in r.h], np.int64).view(np.uint64), return_index=True)
            df = np.array([n for r in of for n in r.df], np.int64)[first]
            out.append(Items(k, [r.item_id for r in of], [np.frombuffer(r.words, np.uint64) for r in of], known, df, totals[k]))
        return out

    size = 0
    for row in items.toLocalIterator():
        rows.append(row)
        size += len(row.words) + 16 * len(row.h) + ITEM_BYTES
        if len(rows) == block or size >= BLOCK_BYTES:
            yield built()
            rows, size = [], 0
    if rows:
        yield built()


def contaminated(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, similarity for every document and item that match; documents with repeated ids by row."""
    schema = "doc_id long, item_id long, similarity double"
    out = None
    for items in item_blocks(benchmark, block):

        def run(batches, items=items):
            seen = PlainHash()
            for batch, texts in slices(batches, "text"):
                rows = []
                for doc, text in zip(batch.column("doc_id").to_pylist(), texts):
                    words = plain_words(text, seen)
                    rows += [(doc, g.ids[i], s) for g in items for i, s in g.matches(words).items()]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())], ["doc_id", "item_id", "similarity"])

        found = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of docs that match no item, with all their columns."""
    columns = docs.columns
    for items in item_blocks(benchmark, block):

        def run(batches, items=items):
            seen = PlainHash()
            for batch, texts in slices(batches, "text"):
                clean = []
                for text in texts:
                    words = plain_words(text, seen)
                    clean.append(not any(g.matches(words) for g in items))
                yield batch.select(columns).filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
