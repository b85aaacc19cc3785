"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in native Spark functions only.

Every document gets the key -ln(u) / w: u from a digest of its id and text, w its quality weight. In the order of the
keys, sizes are summed up within each source. A source whose target is over its size gives complete epochs first; the
rest is taken from the front of the order. A source's documents are dealt over key ranges, so that no task sorts a whole
source: ranges are even steps of the key's logarithm, and whatever the weights are, a step of 1/R holds no more than
1/(e R) of a source, as each weight's share is exponentially distributed. R rises with the number of rows.

Null text has size 0 and is taken 0 times; very long texts are taken whole; null source is a source of its own, last;
equal keys go by doc_id, then by digest; repeated rows count as rows; other columns are carried on by mixed_rows,
whatever their names; an empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import stored

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
RANGES = 64  # key ranges per step e of the key, at least
RANGE_ROWS = 200_000  # rows of a source in a range, at most


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, cap=CAP) -> DataFrame:
    """source_key, source_size, target for (source_key, source_size), one row per source: water-filling in closed form.

    Sources in the order of cap/weight: the level of source i is what the sources before it leave, when they get their
    caps, over the weights from i on. It rises as long as a source is at its cap and falls after, so the largest level
    is the one at which all is dealt out. The windows see one row per source, never documents."""
    by_name = Window.orderBy(F.col("source_key").isNull(), F.col("source_key"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    s = sizes.withColumn("w", w).withColumn("cap", F.lit(float(cap)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source_key").isNull(), F.col("source_key"))
    whole = Window.partitionBy()
    s = (
        s.withColumn("cap_before", F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("w_after", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("budget", F.lit(float(share)) * F.sum("source_size").over(whole))
        .withColumn("level", (F.col("budget") - F.coalesce("cap_before", F.lit(0.0))) / F.col("w_after"))
        .withColumn("level", F.max("level").over(whole))
    )
    return s.select("source_key", "source_size", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def quality_weight(text: str) -> F.Column:
    """Share of letters, of any script, and spaces among the characters, in 0.05 steps from 0.05 to 1."""
    plain = F.length(F.regexp_replace(text, r"[^\p{L}\p{M} ]", ""))
    return F.greatest(F.ceil(F.lit(20.0) * plain / F.greatest(F.length(text), F.lit(1))) / 20.0, F.lit(0.05))


def mix(docs: DataFrame, columns: list[str], ranges: int = RANGES) -> DataFrame:
    """size, source_size, target and taken (words taken, repeats counted) of each row of docs, with these columns of it
    as struct `_row`."""
    ranges = max(ranges, -(-docs.count() // RANGE_ROWS))
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.col("source").alias("source_key"), F.col("doc_id").alias("_id"), text.alias("_text"))
    u = (F.conv(F.substring("_digest", 1, 12), 16, 10).cast("long") + 1) / F.lit(float(2**48 + 1))
    d = (
        d.withColumn("size", F.regexp_count("_text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long"))
        .withColumn("_digest", F.md5(F.concat_ws("|", F.coalesce(F.col("_id").cast("string"), F.lit("")), "_text")))
        .withColumn("_key", -F.log(u) / quality_weight("_text"))
        .withColumn("_range", F.floor(F.log("_key") * ranges).cast("int"))
        .drop("_text")
    )
    d = stored(d, "mix")  # texts are looked at once
    sums = d.groupBy("source_key", "_range").agg(F.sum("size").alias("range_size"))
    before = F.sum("range_size").over(Window.partitionBy("source_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.withColumn("range_start", F.coalesce(before, F.lit(0)))
    targets = source_targets(sums.groupBy("source_key").agg(F.sum("range_size").alias("source_size")))
    plan = starts.alias("s").join(targets.alias("t"), F.expr("s.source_key <=> t.source_key")).select(F.col("s.source_key").alias("k"), F.col("s._range").alias("r"), "range_start", "source_size", "target")
    inner = F.sum("size").over(Window.partitionBy("source_key", "_range").orderBy("_key", "_id", "_digest").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    d = d.withColumn("_inner", inner)
    j = d.join(plan, F.expr("source_key <=> k and _range = r"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - epochs * F.col("source_size")
    middle = F.col("range_start") + F.col("_inner") - F.col("size") / 2.0
    return j.select("_row", "size", "source_size", "target", (F.col("size") * (epochs + F.when(middle < rest, 1).otherwise(0))).cast("long").alias("taken"))


def mix_report(docs: DataFrame) -> DataFrame:
    m = mix(docs, ["doc_id"])
    return m.select("_row.doc_id", "size", "source_size", "target", "taken")


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The mixed corpus: each document as often as it is taken, with the columns of docs."""
    m = mix(docs, docs.columns).withColumn("_n", F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(0))
    return m.where("_n > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_copy")).select("_row.*")


def mix_sql(docs: str = "documents") -> str:
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, md5(concat_ws('|', coalesce(doc_id::VARCHAR, ''), coalesce(text, ''))) AS g FROM {docs}),
e AS (SELECT doc_id, source, g, CAST(len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
  -ln((('0x' || substr(g, 1, 12))::BIGINT + 1) / 281474976710657.0::DOUBLE) /
  greatest(ceil(20.0::DOUBLE * length(regexp_replace(t, '[^\\p{{L}}\\p{{M}} ]', '', 'g')) / greatest(length(t), 1)) / 20.0::DOUBLE, 0.05::DOUBLE) AS k FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size) AS cap FROM e GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM s),
a AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cb,
  sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS wa, 1.5::DOUBLE * sum(source_size) OVER () AS b FROM w),
l AS (SELECT *, (b - cb) / wa AS lv FROM a),
t AS (SELECT source, source_size, least(cap, max(lv) OVER () * w) AS target FROM l),
p AS (SELECT e.*, source_size, target, sum(size) OVER (PARTITION BY e.source ORDER BY k, doc_id, g ROWS UNBOUNDED PRECEDING) AS c FROM e JOIN t ON e.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target::DOUBLE AS target,
  CAST(size * (CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END + CASE WHEN source_size > 0 AND c - size / 2.0::DOUBLE < target - floor(target / source_size) * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM p
"""
