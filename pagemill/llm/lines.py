"""Line deduplication: long lines that many documents share stay in one document only, in native Spark functions.

Lines of every document are exploded with their place, stripped of white space and lower-cased (A-Z), and reduced to two
64-bit hashes. A hash's documents are counted distinct, with counting before each shuffle; hashes over the threshold form a
stored table with the largest doc_id of each. The lines that have to go are joined with it, gathered by document as
places, and texts are put together again from the places that are left. Only hashes and places are shuffled for the
counts; the texts are read twice and shuffled once, with the places to drop.

A line that a third of all documents hold is counted by partial sums, and its join and the join of repeated rows have an
exchange on either side, so that Spark can split a key that is too large. Nothing is gathered but places of one text.

A document is its doc_id; null ids are one document, below all others. Repeated rows are one document and lose the same
lines. A null or empty text is one empty line, too short to go. Other columns of dedup_lines, whatever their names, are
carried on; an empty table gives an empty result; a key's ties don't arise, as the largest doc_id is one document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import let
from pagemill.llm.common import stored

WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_CHARS = 40
MIN_DOCS = 5


def line_key(line: Column) -> Column:
    return F.translate(F.trim(line, F.lit(WHITE)), UPPER, LOWER)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dropped_places(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(_k1, _k2, places) of each text, by the hashes of id and text, that loses lines: the places of these, ascending."""
    keys = F.filter(F.transform(lines_of(F.col("text")), lambda line, i: F.struct(i.alias("place"), line_key(line).alias("key"))), lambda x: F.length(x.key) >= min_chars)
    hashed = F.transform(keys, lambda x: F.struct(x.place.alias("place"), F.xxhash64(x.key).alias("h1"), F.xxhash64(F.lit(13), x.key).alias("h2")))
    lines = stored(docs.select("doc_id", *row_key(), F.explode(hashed).alias("x")).select("doc_id", "_k1", "_k2", "x.*"), "lines")
    of_docs = lines.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
    common = of_docs.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")).where(F.col("n") >= min_docs).select("h1", "h2", "last")
    met = lines.join(stored(common, "common-lines"), ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("last")))
    places = met.groupBy("_k1", "_k2", "place").agg(F.lit(1).alias("one"))  # repeated rows have the same places
    return stored(places.groupBy("_k1", "_k2").agg(F.sort_array(F.collect_list("place")).alias("_places")), "dropped-lines")


def row_key() -> list[Column]:
    """Two hashes that stand for a row's id and text."""
    return [F.xxhash64("doc_id", "text").alias("_k1"), F.xxhash64(F.lit(17), "doc_id", "text").alias("_k2")]


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The rows of docs with all their columns as struct `row`, and n_lines, n_dropped and kept, the text that is left."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("_text"), *row_key())
    d = rows.join(dropped_places(docs, min_chars, min_docs), ["_k1", "_k2"], "left")
    n = F.size("_lines").cast("long")
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_places"))
    kept = let(F.struct(F.col("_lines").alias("lines"), left.alias("left")), lambda x: F.array_join(F.transform(x.left, lambda i: F.get(x.lines, i)), "\n"))
    d = d.withColumn("_lines", lines_of(F.col("_text")))
    return d.select("row", n.alias("n_lines"), F.coalesce(F.size("_places"), F.lit(0)).cast("long").alias("n_dropped"), F.when(F.col("_places").isNull(), F.coalesce("_text", F.lit(""))).otherwise(kept).alias("kept"))


def line_report(docs: DataFrame) -> DataFrame:
    d = dedup_lines(docs)
    return d.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def lines_sql(docs: str = "documents", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM {docs}),
l AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= {min_chars} GROUP BY key HAVING count(DISTINCT coalesce(doc_id::VARCHAR, '')) >= {min_docs}),
g AS (SELECT r, count(*) AS n_dropped, list(i) AS gone FROM k JOIN c USING (key) WHERE doc_id IS DISTINCT FROM last GROUP BY r)
SELECT doc_id, len(ls)::BIGINT AS n_lines, coalesce(n_dropped, 0)::BIGINT AS n_dropped,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN ls ELSE list_filter(ls, lambda x, i: NOT list_contains(gone, i)) END, chr(10))) AS kept_sha256
FROM d LEFT JOIN g USING (r)
"""
