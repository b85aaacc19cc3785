"""Ranked lexical search by bag deduplication.

Items are the queries. Equal bags of item terms are one query; queries are dealt into blocks of a bounded number and size,
and a block's vocabulary goes to the tasks. Each document is reduced to the vocabulary: its tf-vector, and its number of
terms. Documents of one class, with the same vector and the same m, get the same score from every query: they meet under
a hash of both, and are grouped by their equality, so a hash that two classes share does no harm. A class is scored once,
by numpy over a bounded piece of classes at a time. Its members come in by ascending doc_id, at most `top` of them, as
no more can be in a result; likewise at most `top` classes of each query leave a task.

The number of documents holding a term, the number of documents and of all terms are counted over all rows. A class of any
size is cut to `top` members before and after its shuffle. A block costs a pass over all documents.

A document is a row: repeated rows have ranks of their own, null ids come first among equal scores. A null text, or one
without a term, has no score; it isn't counted. An item is a distinct (item_id, text); one without a term has no results.
Long texts are taken whole; other columns, whatever their names, aren't read; empty tables give an empty result."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import slices, small_batches, stored

TOP = 50
BLOCK_ITEMS = 8_192  # queries in a block, on average half of it
BLOCK_BYTES = 4 << 20  # their terms, likewise
PIECE = 1 << 22  # cells of a piece of classes by their terms
GATHER = 2_000  # terms of queries that are summed up at a time

# Bytes of UTF-8: letters a to z, digits and all beyond ASCII make terms, A to Z become a to z, others are white space.
PLAIN = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

BAG = "doc_id long, n long, terms array<int>, tfs array<int>"
HIT = "b1 long, b2 long, score long, members array<long>"


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(PLAIN).split() if text else []


def item_terms(text: Column) -> Column:
    """The distinct terms of an item, in order."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))))


def restricted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs): of each document with a term the number of its terms, and those of the vocabulary with their
    occurrences, by number."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # bounded by BLOCK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch, texts in slices(batches, "text"):
            sizes, ends, terms, tfs, has = [], [0], [], [], []
            for text in texts:
                words = terms_of(text)
                found = sorted((number[t], c) for t, c in Counter(words).items() if t in number)
                has.append(bool(words))
                if words:
                    sizes.append(len(words))
                    terms += [t for t, _ in found]
                    tfs += [c for _, c in found]
                    ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tfs)]
            ids = batch.column("doc_id").filter(pa.array(has, pa.bool_())).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return docs.select("doc_id", "text").mapInArrow(run, BAG)


def classes_of(bags: DataFrame, n_docs: int, n_terms: int, top: int = TOP) -> DataFrame:
    """(h, terms, tfs, m, members): one row per class with its first members, each as a struct."""
    m = F.expr(f"100L - 50L + (50L * n * {n_docs}L) div {n_terms}L")
    d = bags.where(F.size("terms") > 0).select("doc_id", "terms", "tfs", m.alias("m")).withColumn("h", F.xxhash64("terms", "tfs", "m"))
    same = ["h", "terms", "tfs", "m"]
    first = F.row_number().over(Window.partitionBy(*same).orderBy(F.col("doc_id").asc_nulls_first()))
    return d.withColumn("_first", first).where(F.col("_first") <= top).groupBy(*same).agg(F.sort_array(F.collect_list(F.struct("doc_id"))).alias("members"))


class Best:
    """The `top` best classes of each query among those seen, by score, then by the first member."""

    def __init__(self, queries: int, top: int):
        self.top, self.least = top, np.ones(queries, np.int64)  # scores below it don't count any more
        self.rows, self.waiting, self.limit = [], 0, max(100_000, 2 * top * queries)
        self.members: dict[int, list] = {}

    def add(self, query: np.ndarray, score: np.ndarray, first: np.ndarray, ref: np.ndarray) -> None:
        self.rows.append((query, score, first, ref))
        self.waiting += len(query)
        if self.waiting > self.limit:
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        if not self.rows:
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        query, score, first, ref = (np.concatenate(x) for x in zip(*self.rows))
        order = np.lexsort((first, -score, query))
        query, score, first, ref = query[order], score[order], first[order], ref[order]
        start = np.searchsorted(query, query)
        place = np.arange(len(query)) - start
        full = place == self.top - 1
        self.least[query[full]] = score[full]
        keep = place < self.top
        rows = tuple(x[keep] for x in (query, score, first, ref))
        self.rows, self.waiting = [rows], 0
        used = set(rows[3].tolist())
        self.members = {k: v for k, v in self.members.items() if k in used}
        return rows


def scores(values: np.ndarray, ends: np.ndarray, tfs: np.ndarray, m: np.ndarray, weights: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For a piece of classes, their vectors one after the other: blocks of queries, by the number of the first one, and the
    scores of queries by classes. flat and starts hold the queries' terms. All integers are exact."""
    counts = np.diff(ends)
    seen, local = np.unique(values, return_inverse=True)
    cells = np.zeros((len(seen) + 1, len(counts)), np.int64)  # the last row is for terms that no class has
    tf = tfs.astype(np.int64)
    cells[local, np.repeat(np.arange(len(counts)), counts)] = weights[values] * ((1_000_000_000 * tf) // (1000 * tf + 20 * np.repeat(m, counts)))
    place = np.searchsorted(seen, flat)
    place[place == len(seen)] = 0
    place = np.where(seen[place] == flat, place, len(seen))
    at = 0
    while at < len(starts) - 1:
        stop = max(at + 1, int(np.searchsorted(starts, starts[at] + GATHER, "right")) - 1)
        yield at, np.add.reduceat(cells[place[starts[at] : starts[stop]]], starts[at:stop] - starts[at], axis=0)
        at = stop


def score_classes(classes: DataFrame, queries: list[list[int]], keys: list[tuple[int, int]], weights: np.ndarray, top: int = TOP) -> DataFrame:
    """(b1, b2, score, members): of each task the best classes of every query, whose keys are b1 and b2."""
    flat, starts = np.concatenate([np.array(q, np.int64) for q in queries]), np.cumsum([0, *map(len, queries)])
    shared = classes.sparkSession.sparkContext.broadcast((flat, starts, weights, keys))  # bounded by BLOCK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, starts, weights, keys = shared.value
        best, number = Best(len(keys), top), 0
        for batch in batches:
            lists, m = batch.column("terms"), batch.column("m").to_numpy()
            ends = lists.offsets.to_numpy().astype(np.int64)
            values, tfs = (x.values.to_numpy()[ends[0] : ends[-1]] for x in (lists, batch.column("tfs")))
            ends = ends - ends[0]
            at = 0
            while at < len(m):
                stop = at + 1  # a piece's terms times its classes stay bounded
                while stop < len(m) and (ends[stop + 1] - ends[at]) * (stop + 1 - at) <= PIECE:
                    stop += 1
                inside = slice(ends[at], ends[stop])
                members = [[x["doc_id"] for x in row] for row in batch.column("members").slice(at, stop - at).to_pylist()]
                first = np.array([-(1 << 63) if x[0] is None else x[0] for x in members], np.int64)
                for query, s in scores(values[inside], ends[at : stop + 1] - ends[at], tfs[inside], m[at:stop], weights, flat, starts):
                    q, c = np.nonzero(s >= best.least[query : query + len(s), None])
                    if len(q):
                        best.members |= {number + i: members[i] for i in np.unique(c).tolist()}
                        best.add(q + query, s[q, c], first[c], c + number)
                number += stop - at
                at = stop
        query, score, _, ref = best.cut()
        for i in range(0, len(query), 10_000):
            q, r = query[i : i + 10_000].tolist(), ref[i : i + 10_000].tolist()
            yield pa.RecordBatch.from_arrays([pa.array([keys[x][0] for x in q], pa.int64()), pa.array([keys[x][1] for x in q], pa.int64()), pa.array(score[i : i + 10_000]), pa.array([best.members[x] for x in r], pa.list_(pa.int64()))], ["b1", "b2", "score", "members"])

    return classes.select("terms", "tfs", "m", "members").mapInArrow(run, HIT)


def ranked(hits: DataFrame, top: int = TOP) -> DataFrame:
    """(b1, b2, rank, doc_id, score): the `top` documents of each query, out of the best classes of the tasks."""
    of = Window.partitionBy("b1", "b2")
    best = hits.withColumn("_class", F.row_number().over(of.orderBy(F.col("score").desc(), F.get("members", F.lit(0)).asc_nulls_first()))).where(F.col("_class") <= top)
    docs = best.select("b1", "b2", "score", F.explode("members").alias("doc_id"))
    return docs.withColumn("rank", F.row_number().over(of.orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first()))).where(F.col("rank") <= top).select("b1", "b2", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_items: int = BLOCK_ITEMS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` highest-scoring documents of each item."""
    spark = docs.sparkSession
    terms = F.col("terms")
    items = stored(items.select("item_id", "text").distinct().select("item_id", item_terms(F.col("text")).alias("terms")).where(F.size("terms") > 0).select("*", F.xxhash64(terms).alias("b1"), F.xxhash64(F.lit(11), terms).alias("b2")), "items")
    bags = stored(items.groupBy("b1", "b2").agg(F.first("terms").alias("terms")), "item-bags")  # one class of equal bags, one query
    n, size = bags.agg(F.count("*"), F.coalesce(F.sum(F.length(F.array_join("terms", " "))), F.lit(0))).first()
    blocks = math.ceil(max(2 * n / block_items, 2 * size / block_bytes))
    out = spark.createDataFrame([], "b1 long, b2 long, rank int, doc_id long, score long")
    for block in range(blocks):
        rows = bags.where(F.pmod("b1", F.lit(blocks)) == block).collect()  # bounded by the block
        if not rows:
            continue
        names = sorted({t for r in rows for t in r.terms})
        number = {t: i for i, t in enumerate(names)}
        with small_batches(spark):
            d = stored(restricted(docs, {t.encode(): i for t, i in number.items()}), "item-terms")
        n_docs, n_terms = d.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = dict(d.select(F.explode("terms").alias("term")).groupBy("term").count().collect())  # a row per term of the block
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(names))], np.int64)
        if n_docs:
            hits = score_classes(classes_of(d, n_docs, n_terms, top), [[number[t] for t in r.terms] for r in rows], [(r.b1, r.b2) for r in rows], weights, top)
            out = out.unionByName(stored(ranked(hits, top), "ranked"))
    return items.join(out, ["b1", "b2"]).select("item_id", "rank", "doc_id", "score")


def search_sql(docs: str = "documents", items: str = "benchmark", top: int = TOP) -> str:
    def terms(text: str) -> str:
        return f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"

    return f"""
WITH q AS (SELECT row_number() OVER () AS k, item_id, list_distinct({terms("text")}) AS ts FROM (SELECT DISTINCT item_id, text FROM {items})),
qt AS (SELECT k, unnest(ts) AS term FROM q),
d AS (SELECT row_number() OVER () AS r, doc_id, {terms("text")} AS ts FROM {docs}),
s AS (SELECT count(*) AS nn, sum(len(ts)) AS ll FROM d WHERE len(ts) > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY term, nn),
m AS (SELECT r, doc_id, 100 - 50 + (50 * len(ts)::BIGINT * nn) // ll AS m FROM d, s WHERE len(ts) > 0),
c AS (SELECT r, term, w * ((1000000000 * tf::BIGINT) // (1000 * tf + 20 * m)) AS c FROM tf JOIN w USING (term) JOIN m USING (r)),
p AS (SELECT k, r, sum(c)::BIGINT AS score FROM qt JOIN c USING (term) GROUP BY k, r HAVING sum(c) > 0),
o AS (SELECT k, doc_id, score, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id NULLS FIRST)::INT AS rank FROM p JOIN m USING (r))
SELECT item_id, rank, doc_id, score FROM o JOIN q USING (k) WHERE rank <= {top}
"""
