"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact intersection of sorted arrays.

A document is its set of word 4-shingles (of all words, where it has fewer). Equal sets form one class, known by a
64-bit digest of the sorted set. Spark counts in how many sets each shingle is; every set is put in the order of rising
counts, and two sets that link share one of the first n - ceil(0.85 n) + 1 shingles of both. Those among them that no
other set has can't be shared and are left out, so what remains, with the tile of the set's size, are the keys under
which sets meet. Tiles double in size; a set whose size is within the threshold of the next smaller tile lies in that
too. Sets meet in three steps, each of which leaves less to the next: a set and the smallest set that any of its keys
has; then, in up to ROUNDS rounds, of keys whose sets are still in different components, one set of each component and
CENTRES sets of the largest one, others in each round; last, of what is left, every two sets of a key that are in
different components, in tiles of at most TILE rows each.
There the places of the key and the bitmaps bound a pair's overlap from above (each bit that only one set has is a
shingle that the other lacks), and only pairs that can still reach the threshold leave the tile. All pairs are decided
exactly by intersection of the sorted sets.

Counting is by hash range: each slice of rows sends a range its shingles as one packed row, and gets back those that are
in two sets or more; slices and ranges grow with the square root of the text beyond 32 GB, so that packed rows stay
packed. Documents without words have n_shingles 0 and link with nothing; very long texts are taken whole. Rows with the
same text are linked; null doc_ids take part, and are the component_id only where a component has no other; ties and the
order of rows play no part; extra columns are ignored by jaccard_components and kept by keep_one, whatever their names;
an empty table gives an empty result."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import WordHash, components, mixed, partitions, shingles, slices, small_batches, stored

K = 4
PERCENT = 85
BITS = 1_024
CENTRES = 16  # sets of a key's largest component that meet one of each other component in a round
ROUNDS = 2
RANGE_BYTES = 6 << 20  # text per hash range of shingles
SLICE = 4 << 20  # text per slice of rows
GROWTH_BYTES = 32 << 30  # text from which ranges and slices grow
TILE = 1_024  # sets of a key that are compared in one piece
WIDE = 1 << 18  # pairs of a tile that are looked at at once


def shingle_set(text: bytes | None, seen: WordHash, k: int = K) -> np.ndarray:
    return np.unique(shingles(seen.of((text or b"").lower().split()), k))


def bitmap(s: np.ndarray) -> bytes:
    bits = np.zeros(BITS, bool)
    bits[(mixed(s) % np.uint64(BITS)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def planes(x: np.ndarray) -> bytes:
    """Bytes of an integer array, 16 bits of every number after the other, which compresses well where they are sorted."""
    return x.view(np.uint16).reshape(len(x), x.dtype.itemsize // 2).T.tobytes()


def unplaned(raw: list[bytes], kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize // 2
    return np.concatenate([np.ascontiguousarray(np.frombuffer(r, np.uint16).reshape(width, -1).T).view(kind).ravel() for r in raw] or [np.zeros(0, kind)])


def prefix_length(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return n - -(-percent * n // 100) + 1


def tile_keys(h: np.ndarray, n: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Keys of shingles h of sets of size n, in the sets' own tiles and in the next smaller ones where a partner may
    lie there; and for each key the place of its shingle."""
    tile = np.frexp(n.astype(np.float64))[1].astype(np.int64) - 1
    lower = np.flatnonzero((tile > 0) & (-(-percent * n // 100) < 1 << tile))
    of = np.concatenate([np.arange(len(h)), lower])
    at = np.concatenate([tile, tile[lower] - 1])
    return mixed(h[of] + mixed((at + 1).astype(np.uint64))), of


DEALT = "slice long, part long, shingles binary, owners binary, counts binary"
SIGNATURE = "doc_id long, row long, n long, sid long, bitmap binary, keys array<long>, places array<int>"


def row_hash() -> F.Column:
    """By which a row is found again; rows of equal id and text have the same."""
    return F.xxhash64("doc_id", "text")


def signatures(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """One row per document; of the documents of a slice with the same set, the first one has the keys."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    growth = min(16.0, max(1.0, (size / GROWTH_BYTES) ** 0.5))
    parts = max(partitions(docs.sparkSession), -(-size // int(RANGE_BYTES * growth)))
    limit = int(SLICE * growth)
    edges = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
    dealt = pa.schema([("slice", pa.int64()), ("part", pa.int64()), ("shingles", pa.binary()), ("owners", pa.binary()), ("counts", pa.binary())])

    def ask(batches):
        """For each slice and hash range the slice's shingles, sorted, with the places of their sets; and a row, under
        a part below 0, with the slice's documents."""
        seen = WordHash()
        first = TaskContext.get().partitionId() << 32
        for number, (batch, texts) in enumerate(slices(batches, "text", limit)):
            n, sid, maps, place, sets = [], [], [], {}, []
            for text in texts:
                s = shingle_set(text, seen, k)
                one = xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)
                n.append(len(s))
                sid.append(one)
                if len(s) and one not in place:
                    place[one] = len(maps)
                    sets.append((len(maps), s))
                    maps.append(bitmap(s))
                else:
                    maps.append(maps[place[one]] if len(s) else b"")
            known = pa.record_batch([batch.column("doc_id"), batch.column("row"), pa.array(n, pa.int64()), pa.array(sid, pa.int64()), pa.array(maps, pa.binary())], ["doc_id", "row", "n", "sid", "bitmap"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, known.schema) as writer:
                writer.write_batch(known)
            rows = [(first + number, -1 - (first + number) % parts, sink.getvalue().to_pybytes(), None, None)]
            if sets:
                h = np.concatenate([s for _, s in sets])
                owner = np.repeat(np.array([i for i, _ in sets], np.uint32), [len(s) for _, s in sets])
                order = np.argsort(h)
                h, owner = h[order], owner[order]
                at = np.concatenate([[0], np.searchsorted(h, edges), [len(h)]])
                h = h >> np.uint64(16)  # 48 bits are enough to count and to meet
                rows += [(first + number, p, planes(h[at[p] : at[p + 1]])[: 6 * (at[p + 1] - at[p])], planes(owner[at[p] : at[p + 1]]), None) for p in range(parts) if at[p] < at[p + 1]]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), dealt)], schema=dealt)

    def answer(key, rows):
        """Of each slice's shingles those that are in two sets or more, with a byte that rises with their count."""
        if key[0].as_py() < 0:
            return rows
        h = [unplaned([r + bytes(len(r) // 3)], np.uint64) for r in rows.column("shingles").to_pylist()]
        ends = np.cumsum([len(one) for one in h])
        h = np.concatenate(h)
        order = np.argsort(h)
        first = np.flatnonzero(np.concatenate([[True], h[order[1:]] != h[order[:-1]]]))
        n = np.diff(np.append(first, len(h)))
        code = np.empty(len(h), np.uint8)
        code[order] = np.repeat(np.minimum(8 * np.log2(n), 255).astype(np.uint8), n)
        del order, first, n
        out = []
        for i, (start, end) in enumerate(zip(np.append(0, ends[:-1]), ends)):
            some = code[start:end] > 0
            owners = unplaned([rows.column("owners")[i].as_py()], np.uint32)
            out.append((planes(h[start:end][some]), planes(owners[some]), code[start:end][some].tobytes()))
        got = [pa.array(c, pa.binary()) for c in zip(*out)]
        return pa.table([rows.column("slice"), rows.column("part"), *got], schema=dealt)

    def finish(rows):
        got = rows.to_pydict()
        about = next(i for i, p in enumerate(got["part"]) if p < 0)
        known = pa.ipc.open_stream(got["shingles"][about]).read_all()
        n = known.column("n").to_numpy()
        use = [i for i in range(rows.num_rows) if i != about]
        h, owner = (unplaned([got[c][i] for i in use], kind) for c, kind in (("shingles", np.uint64), ("owners", np.uint32)))
        code = np.frombuffer(b"".join(got["counts"][i] for i in use), np.uint8)
        order = np.lexsort((h, code, owner))
        h, owner = h[order], owner[order].astype(np.int64)
        shared = np.bincount(owner, minlength=len(n))
        # shingles that no other set has come first
        place = n[owner] - shared[owner] + np.arange(len(h)) - np.searchsorted(owner, owner)
        h, owner, place = (x[place < prefix_length(n[owner], percent)] for x in (h, owner, place))
        key, of = tile_keys(h, n[owner], percent)
        owner = owner[of]
        order = np.lexsort((key, owner))
        starts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(n)))]).astype(np.int32)
        keys = pa.ListArray.from_arrays(pa.array(starts), pa.array(key[order].view(np.int64)))
        places = pa.ListArray.from_arrays(pa.array(starts), pa.array(place[of][order].astype(np.int32)))
        return pa.table([*known.columns, pa.chunked_array([keys]), pa.chunked_array([places])], ["doc_id", "row", "n", "sid", "bitmap", "keys", "places"])

    asked = docs.select("doc_id", "text", row_hash().alias("row")).mapInArrow(ask, DEALT)
    return asked.groupBy("part").applyInArrow(answer, DEALT).groupBy("slice").applyInArrow(finish, SIGNATURE)


def may_link(pairs: DataFrame, sig: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) whose sizes and bitmaps allow a link. sig has one row per set."""
    left = sig.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("bitmap").alias("ba"))
    right = sig.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("bitmap").alias("bb"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, BITS // 64) for c in ("ba", "bb"))
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            over = np.minimum(na - np.bitwise_count(x & ~y).sum(1, np.int64), nb - np.bitwise_count(y & ~x).sum(1, np.int64))
            yield batch.select(["a", "b"]).filter(pa.array((100 + percent) * over >= percent * (na + nb)))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "ba", "bb").mapInArrow(run, "a long, b long")


def tile_pairs(low: np.ndarray, high: np.ndarray, cols: dict[str, np.ndarray], percent: int) -> np.ndarray:
    """Of the pairs (low[i], high[i]) of rows those that can still link: rows of different components whose sizes, what
    follows the key in their orders, and their bitmaps leave an overlap that is enough. What precedes the first key of
    two sets is in one of them only, so a linked pair passes at that key."""
    n, left = cols["n"], cols["n"] - cols["place"]
    need = percent * (n[low] + n[high])
    ok = (cols["root"][low] != cols["root"][high]) & ((100 + percent) * np.minimum(left[low], left[high]) >= need)
    low, high, need = low[ok], high[ok], need[ok]
    x, y = cols["bits"][low], cols["bits"][high]
    both = np.bitwise_count(x & y).sum(1, np.int64)
    over = np.minimum(n[low] - cols["count"][low], n[high] - cols["count"][high]) + both
    ok = (100 + percent) * over >= need
    a, b = cols["sid"][low[ok]], cols["sid"][high[ok]]
    return np.stack([np.minimum(a, b), np.maximum(a, b)], 1)


def tiled(member: DataFrame, percent: int = PERCENT, tile: int = TILE) -> DataFrame:
    """(a, b): every two sets of a key, of different components, that bounds don't rule out. The sets of a key are dealt
    into blocks of about `tile` rows, and every two blocks meet in a group of their own; keys of one block share groups.
    member: key, place, sid, n, root, bitmap."""
    sizes = member.groupBy("key").agg(F.count("*").alias("m"))
    few = sizes.where(F.col("m") <= tile).agg(F.sum("m")).first()[0] or 0
    groups = max(partitions(member.sparkSession), -(-few // (8 * tile)))
    rows = member.join(sizes, "key").withColumn("g", F.ceil(F.col("m") / tile).cast("long")).withColumn("own", F.pmod(F.xxhash64("sid"), F.col("g")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)))
    together = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    rows = rows.withColumn("meet", F.when(F.col("g") > 1, together).otherwise(F.pmod(F.xxhash64("key"), F.lit(groups))))

    def run(group):
        cols = {c: group.column(c).to_numpy() for c in ("key", "own", "other", "sid", "n", "place", "root")}
        cols["bits"] = np.frombuffer(b"".join(group.column("bitmap").to_pylist()), np.uint64).reshape(-1, BITS // 64)
        cols["count"] = np.bitwise_count(cols["bits"]).sum(1, np.int64)
        # the rows of a key and pair of blocks follow each other, those of the lower block first
        order = np.lexsort((cols["n"], cols["own"], cols["own"] + cols["other"], cols["key"]))
        cols = {c: v[order] for c, v in cols.items()}
        cuts = np.flatnonzero(np.concatenate([[True], (np.diff(cols["key"]) != 0) | (np.diff(cols["own"] + cols["other"]) != 0), [True]]))
        end = np.repeat(cuts[1:], np.diff(cuts))
        # each row meets those that follow it in its key; in two different blocks, those of the other one only
        cross = cols["own"] < cols["other"]
        inner = cols["own"] == cols["other"]
        begin = np.where(inner, np.arange(len(end)) + 1, end)
        first_high = np.concatenate([np.repeat(start + np.count_nonzero(cross[start:stop]), stop - start) for start, stop in zip(cuts[:-1], cuts[1:])])
        begin = np.where(cross, first_high, begin)
        many = np.maximum(end - begin, 0)
        out, at, upto = [], 0, np.cumsum(many)
        while at < len(many):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + WIDE, "right")))
            low = np.repeat(np.arange(at, stop), many[at:stop])
            step = np.arange(len(low)) - np.repeat(np.cumsum(many[at:stop]) - many[at:stop], many[at:stop])
            out.append(np.unique(tile_pairs(low, begin[low] + step, cols, percent), axis=0))
            at = stop
        found = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    return rows.select("meet", "key", "own", "other", "sid", "n", "place", "root", "bitmap").groupBy("meet").applyInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, sig: DataFrame, docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """The pairs that link, by exact intersection. sig has one row per set, with the row of a document that has it."""
    sids = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
    wanted = sig.select("sid", "row").join(sids, "sid")

    def sets(batches):
        seen = WordHash()
        for batch, texts in slices(batches, "text"):
            s = [shingle_set(t, seen, k).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("sid"), pa.array(s, pa.binary())], ["sid", "s"])

    texts = docs.select("text", row_hash().alias("row")).join(wanted, "row").select("sid", "text")
    found = stored(texts.mapInArrow(sets, "sid long, s binary"), "sets").dropDuplicates(["sid"])

    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left, right = found.select(F.col("sid").alias("a"), F.col("s").alias("sa")), found.select(F.col("sid").alias("b"), F.col("s").alias("sb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def components_of_sets(sets: DataFrame, docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """(node, root) of the sets that link. sets: one row per set that shares a shingle."""

    def decided(pairs: DataFrame, label: str) -> DataFrame:
        return stored(verified(stored(may_link(pairs, sets, percent), f"{label}-pairs"), sets, docs, k, percent), f"{label}-links")

    def rooted(comp: DataFrame) -> DataFrame:
        return rows.join(comp, F.col("sid") == F.col("node"), "left").select("key", "place", "sid", F.coalesce("root", "sid").alias("root"))

    keyed = sets.select("sid", F.explode(F.arrays_zip("keys", "places")).alias("e")).select(F.col("e.keys").alias("key"), F.col("e.places").alias("place"), "sid")
    centres = keyed.groupBy("key").agg(F.min("sid").alias("a"), F.max("sid").alias("m")).where("a < m").select("key", "a")
    rows = stored(keyed.join(centres, "key"), "keys")
    tried = stored(rows.where("a < sid").groupBy(F.col("sid").alias("b")).agg(F.min("a").alias("a")).select("a", "b"), "tried")
    links = decided(tried, "first")
    comp = components(links)
    for number in range(ROUNDS):
        # no set of a key is collected: a component's centres are those with the smallest of several hashes
        some = [F.min_by("sid", F.xxhash64("sid", F.lit(number * CENTRES + i))) for i in range(CENTRES)]
        by_root = rooted(comp).groupBy("key", "root").agg(F.count("*").alias("n"), F.array_distinct(F.array(*some)).alias("some"))
        by_root = stored(by_root, "roots")
        top = by_root.groupBy("key").agg(F.max_by(F.struct("root", "some"), F.struct("n", "root")).alias("top"), F.count("*").alias("roots")).where("roots > 1")
        pairs = by_root.join(top, "key").where("root <> top.root").select(F.get("some", F.lit(0)).alias("x"), F.explode("top.some").alias("y"))
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        pairs = stored(pairs.join(tried, ["a", "b"], "left_anti"), "round")
        found = decided(pairs, "round")
        tried = tried.unionByName(pairs)
        if found.isEmpty():
            break
        links = links.unionByName(found)
        comp = components(links)
    member = rooted(comp)
    several = member.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("m")).where("least < m").select("key")
    member = stored(member.join(several, "key").join(sets.select("sid", "n", "bitmap"), "sid"), "members")
    last = stored(tiled(member, percent).join(tried, ["a", "b"], "left_anti"), "last")
    if last.isEmpty():
        return comp
    return components(links.unionByName(stored(verified(last, sets, docs, k, percent), "last-links")))


def placed_rows(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """doc_id, row, n_shingles, root, component_id for every row of docs: row is its hash, root the component's number."""
    with small_batches(docs.sparkSession):
        sig = stored(signatures(docs, k, percent), "signatures")
        sets = stored(sig.where("size(keys) > 0").dropDuplicates(["sid"]).drop("doc_id"), "classes")
        comp = components_of_sets(sets, docs, k, percent)
    placed = sig.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("d"))
    placed = placed.join(comp, F.col("sid") == F.col("node"), "left").select("sid", "d", F.coalesce("root", "sid").alias("root"))
    least = placed.groupBy("root").agg(F.min("d").alias("component_id"))
    named = placed.join(least, "root").select("sid", "root", "component_id")
    out = sig.select("doc_id", "row", "n", "sid").join(named, "sid", "left")
    return out.select("doc_id", "row", F.col("n").alias("n_shingles"), "root", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def jaccard_components(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    return placed_rows(docs, k, percent).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """One row of docs per component: the one with the smallest doc_id (null only where there is no other), of those
    the one with the smallest hash of its id and text. Rows without words are all kept; columns of any name are carried on.
    Only hashes decide; the rows themselves are moved once, to meet them."""
    placed = stored(placed_rows(docs, k, percent).select("doc_id", "row", "n_shingles", "root"), "placed")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    first = placed.where("n_shingles > 0").groupBy("root").agg(F.min_by("row", order).alias("row")).select("row")
    times = placed.groupBy("row").agg(F.count("*").alias("n"))
    keep = first.join(times, "row").unionByName(placed.where("n_shingles = 0").select("row").distinct().withColumn("n", F.lit(1).cast("long")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"), row_hash().alias("row"))
    once = rows.join(keep.where("n = 1").select("row"), "row").select("r.*")
    again = rows.join(keep.where("n > 1").select("row"), "row").groupBy("row").agg(F.min_by("r", F.to_json("r")).alias("r")).select("r.*")
    return once.unionByName(again)
