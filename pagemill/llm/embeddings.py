"""Embedding near-duplicates by a robust-pruned flat graph.

Equal vectors of a label form one class. Classes are dealt into clusters, and clusters over LIMIT again, so that shards
stay small; a class goes to its nearest centre, and to the second one too if that is about as near, so that shards
overlap. Every shard builds its graph: nearest neighbours, robust-pruned. The adjacency lists of all shards are united;
in every shard a greedy search from the medoid runs for each vector over the united lists, then expands from what it
found within reach. Pairs are checked in double precision and don't leave the shard: it returns each class's number of
links, every pair counted in the first of the shards that hold both, and a spanning forest of what is linked.
A search doesn't leave its shard, so the members of a component that no one shard holds are compared with each other
once more, exactly and in blocks of rows; only the sums of links leave a block. near_duplicates() ends with an audit:
AUDIT classes against all by brute force; recall below LEAST raises an error. Classes are counted, not their rows, as
equal vectors are found without a graph.

Vectors that are null, empty, zero or hold null or non-finite components, and those with a null label, link with
nothing. Vectors of different length are never compared. Repeated rows are vectors of their own; a null vec_id takes
part and is the component only where there is no other; there is nothing to tie; extra columns are ignored, whatever
their names; an empty table gives an empty result."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import components, stored

COSINE = 0.98
LIMIT = 2_000
CENTRES = 32
DEGREE = 24
NEAREST = 64
BEAM = 32
REACH = 0.95
MARGIN = 0.41  # radians: twice the angle of COSINE; a second centre that much farther than the first can't matter
LEVELS = 8
BLOCK = 2_000
AUDIT = 500
LEAST = 0.9


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with class id cid (null where a vector takes no part), and the classes (cid, space, x, size, vec_id)."""
    good = F.coalesce(F.expr("label is not null and size(embedding) > 0 and not exists(embedding, v -> v is null or isnan(v) or abs(v) = double('infinity')) and exists(embedding, v -> v <> 0)"), F.lit(False))
    plain = F.transform("embedding", lambda v: v.cast("double") + 0.0)
    rows = vectors.select("vec_id", F.when(good, F.xxhash64("label", plain)).alias("cid"), F.struct(F.col("label"), F.size("embedding").alias("dim")).alias("space"), plain.alias("x"))
    found = rows.where("cid is not null").groupBy("cid").agg(F.min(F.struct("space", "x")).alias("v"), F.count("*").alias("size"), F.min("vec_id").alias("vec_id"))
    return rows.select("vec_id", "cid"), found.select("cid", F.xxhash64("v.space").alias("shard"), F.col("v.x").alias("x"), "size", "vec_id")


def unit(column: pa.Array) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in column.to_pylist()])
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def shards(found: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(shard, cid, x) with shards of about `limit` rows. Per level of splitting a class is in one shard, or in two where
    two centres are about as near. Only classes that stay alike at every level are dealt on and on, and those that are
    over `limit` after LEVELS of up to CENTRES centres each would be 10 ** 15 vectors."""
    ready = None
    left = found.select("shard", "cid", "x")
    for depth in range(LEVELS):
        sizes = left.groupBy("shard").agg(F.count("*").alias("n"))
        big = sizes.where(F.col("n") > limit)
        left = stored(left.join(sizes, "shard"), f"level{depth}")
        small = left.where(F.col("n") <= limit).select("shard", "cid", "x")
        ready = small if ready is None else ready.unionByName(small)
        left = left.where(F.col("n") > limit)
        if left.isEmpty():
            return ready.dropDuplicates(["shard", "cid"])
        # the centres of a shard are those of its rows with the smallest hashes: the share that gives enough of them
        k = F.least(F.ceil(2 * F.col("n") / limit) + 2, F.lit(CENTRES))
        share = F.pmod(F.xxhash64("cid", F.lit(depth)), F.lit(1 << 30)) < (1 << 30) * 4.0 * k / F.col("n")
        picked = left.where(share).select("shard", "x", k.alias("k"), F.xxhash64("cid", F.lit(depth)).alias("h"))
        centres = picked.groupBy("shard").agg(F.slice(F.sort_array(F.collect_list(F.struct("h", "x"))), 1, F.max("k").cast("int")).alias("c"))
        centres = centres.select("shard", F.transform("c", lambda v: v.x).alias("centres"))

        def deal(batches):
            known: dict = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = unit(batch.column("x"))
                two, near = np.zeros((len(x), 2), np.int64), np.zeros(len(x), bool)
                own = batch.column("shard").to_pylist()
                for s in set(own):
                    rows = np.flatnonzero(np.array([o == s for o in own]))
                    if s not in known:
                        known[s] = unit(batch.column("centres").slice(int(rows[0]), 1).flatten())
                    angle = np.arccos(np.clip(x[rows] @ known[s].T, -1, 1))
                    order = np.argsort(angle, axis=1, kind="stable")[:, [0, min(1, angle.shape[1] - 1)]]
                    two[rows] = order
                    away = np.take_along_axis(angle, order, 1)
                    near[rows] = (order[:, 0] != order[:, 1]) & (away[:, 1] - away[:, 0] <= MARGIN)
                names = ["shard", "c", "cid", "x"]
                yield pa.RecordBatch.from_arrays([batch.column("shard"), pa.array(two[:, 0]), batch.column("cid"), batch.column("x")], names)
                yield pa.RecordBatch.from_arrays([batch.column("shard"), pa.array(two[:, 1]), batch.column("cid"), batch.column("x")], names).filter(pa.array(near))

        dealt = left.join(centres, "shard").select("shard", "cid", "x", "centres").mapInArrow(deal, "shard long, c long, cid long, x array<double>")
        left = dealt.select(F.xxhash64("shard", "c").alias("shard"), "cid", "x").dropDuplicates(["shard", "cid"])
    return ready.unionByName(left).dropDuplicates(["shard", "cid"])


def build(x: np.ndarray) -> list[np.ndarray]:
    """Robust-pruned neighbours of each row among its nearest rows, in slices of the similarity matrix."""
    n = len(x)
    out = []
    k = min(NEAREST, n - 1)
    for at in range(0, n, 512):
        sims = x[at : at + 512] @ x.T
        sims[np.arange(len(sims)), np.arange(at, at + len(sims))] = -2
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k else np.zeros((len(sims), 0), np.int64)
        for i, row in enumerate(near):
            row = row[np.argsort(-sims[i, row], kind="stable")]
            between = x[row] @ x[row].T
            alive, chosen = np.ones(len(row), bool), []
            while alive.any() and len(chosen) < DEGREE:
                j = int(alive.argmax())
                chosen.append(row[j])
                # a neighbour is pruned if a chosen one is nearer to it, by a margin, than the row is
                alive &= 1.44 * (1 - between[j]) > (1 - sims[i, row])
                alive[j] = False
            out.append(np.array(chosen, np.int64))
    return out


def search(x: np.ndarray, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) found over the edges (src, dst). All queries move in step. The greedy search looks at the first
    NEAREST neighbours of a node; the expansion follows all."""
    n = len(x)
    order = np.lexsort((dst, src))
    src, dst = src[order], dst[order]
    begin = np.searchsorted(src, np.arange(n + 1))
    place = np.arange(len(src)) - begin[src]
    neighbours = np.full((n, NEAREST), -1, np.int64)
    neighbours[src[place < NEAREST], place[place < NEAREST]] = dst[place < NEAREST]
    medoid = int((x @ x.mean(0)).argmax())
    a, b = [], []
    for at in range(0, n, 256):
        q = np.arange(at, min(n, at + 256))
        seen = np.zeros((len(q), n), bool)
        beam = np.full((len(q), BEAM), -1, np.int64)
        sims = np.full((len(q), BEAM), -2.0)
        done = np.ones((len(q), BEAM), bool)
        beam[:, 0], sims[:, 0], done[:, 0] = medoid, x[q] @ x[medoid], False
        seen[:, medoid] = True
        for _ in range(4 * BEAM):
            value = np.where(done, -3, sims)
            best = value.argmax(1)
            go = np.flatnonzero(value[np.arange(len(q)), best] > -3)
            if not len(go):
                break
            done[go, best[go]] = True
            near = neighbours[beam[go, best[go]]]
            fresh = (near >= 0) & ~seen[go[:, None], near]
            seen[np.repeat(go, near.shape[1])[fresh.ravel()], near[fresh]] = True
            s = np.where(fresh, np.einsum("ijk,ik->ij", x[near], x[q[go]]), -2.0)
            all_sims = np.concatenate([sims[go], s], 1)
            top = np.argsort(-all_sims, axis=1, kind="stable")[:, :BEAM]
            sims[go] = np.take_along_axis(all_sims, top, 1)
            beam[go] = np.take_along_axis(np.concatenate([beam[go], near], 1), top, 1)
            done[go] = np.take_along_axis(np.concatenate([done[go], ~fresh], 1), top, 1)
        # range expansion: from everything within reach to all neighbours within reach
        row, col = np.nonzero(sims >= REACH)
        node = beam[row, col]
        found = np.zeros((len(q), n), bool)
        found[row, node] = True
        found[np.arange(len(q)), q] = True
        row, node = np.nonzero(found)
        while len(row):
            many = begin[node + 1] - begin[node]
            r = np.repeat(row, many)
            m = dst[np.repeat(begin[node] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
            new = ~found[r, m]
            key = np.unique(r[new] * n + m[new])
            r, m = key // n, key % n
            ok = np.einsum("ij,ij->i", x[q[r]], x[m]) >= REACH
            row, node = r[ok], m[ok]
            found[row, node] = True
        row, node = np.nonzero(found)
        a.append(q[row])
        b.append(node)
    return np.concatenate(a), np.concatenate(b)


def forest(low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of n nodes reaches over the edges (low, high)."""
    root = np.arange(n)
    while len(low):
        least = np.minimum(root[low], root[high])
        before = root.copy()
        np.minimum.at(root, root[low], least)
        np.minimum.at(root, root[high], least)
        np.minimum.at(root, low, least)
        np.minimum.at(root, high, least)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        if (root == before).all():
            break
    return root


def linked(dealt: DataFrame, found: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(shard, cid, n, m, top) for the classes of each shard that have a link there: n and m, the rows and classes they link with in pairs
    that belong to the shard, the first of those that hold both; top, a class of the shard that they are connected to."""
    dealt = dealt.join(found.select("cid", "size"), "cid")
    dealt = stored(dealt.join(dealt.groupBy("cid").agg(F.sort_array(F.collect_set("shard")).alias("held")), "cid").select("shard", "cid", "x", "size", "held"), "held")

    def graph(rows):
        x, cid = unit(rows.column("x")), rows.column("cid").to_numpy()
        near = build(x)
        src = np.repeat(cid, [len(v) for v in near])
        dst = cid[np.concatenate(near)] if len(src) else src
        return pa.table({"src": np.concatenate([src, dst]), "dst": np.concatenate([dst, src])})

    edges = dealt.select("shard", "cid", "x").groupBy("shard").applyInArrow(graph, "src long, dst long").distinct()
    lists = edges.join(dealt.select(F.col("shard").alias("of"), F.col("cid").alias("src")), "src").select("of", "src", "dst")

    def run(key, rows, adjacent):
        names = ["shard", "cid", "n", "m", "top"]
        if not rows.num_rows:
            return pa.table([pa.array([], pa.int64())] * 5, names)
        shard, cid = key[0].as_py(), rows.column("cid").to_numpy()
        order = np.argsort(cid)
        cid, x, size = cid[order], unit(rows.column("x"))[order], rows.column("size").to_numpy()[order]
        held = rows.column("held").to_pylist()
        held = [held[i] for i in order]
        width = max(map(len, held))
        held = np.array([h + [np.iinfo(np.int64).max] * (width - len(h)) for h in held], np.int64)
        src, dst = adjacent.column("src").to_numpy(), adjacent.column("dst").to_numpy()
        at = np.minimum(np.searchsorted(cid, dst), len(cid) - 1)
        ok = cid[at] == dst
        src, dst = np.searchsorted(cid, src[ok]), at[ok]
        low, high = search(x, src, dst)
        low, high = np.minimum(low, high), np.maximum(low, high)
        pair = np.unique(low[low < high] * len(cid) + high[low < high])
        low, high = pair // len(cid), pair % len(cid)
        near = np.einsum("ij,ij->i", x[low], x[high]) >= cosine
        low, high = low[near], high[near]
        # a pair belongs to the first shard that both have: no smaller one is in both lists
        own = np.ones(len(low), bool)
        for i in range(width):
            one = held[low, i]
            for j in range(width):
                own &= ~((one == held[high, j]) & (one < shard))
        n = np.bincount(low[own], size[high[own]], len(cid)) + np.bincount(high[own], size[low[own]], len(cid))
        m = np.bincount(low[own], minlength=len(cid)) + np.bincount(high[own], minlength=len(cid))
        some = np.unique(np.concatenate([low, high]))
        top = cid[forest(low, high, len(cid))]
        return pa.table([pa.array([shard] * len(some), pa.int64()), pa.array(cid[some]), pa.array(n[some].astype(np.int64)), pa.array(m[some].astype(np.int64)), pa.array(top[some])], names)

    return dealt.groupBy("shard").cogroup(lists.groupBy("of")).applyInArrow(run, "shard long, cid long, n long, m long, top long")


def spread(comp: DataFrame, dealt: DataFrame) -> DataFrame:
    """(root, n): components that no one shard holds, with their number of classes."""
    held = dealt.join(comp, F.col("cid") == F.col("node")).groupBy("root", "shard").agg(F.count("*").alias("k"))
    sizes = comp.groupBy("root").agg(F.count("*").alias("n"))
    return held.groupBy("root").agg(F.max("k").alias("k")).join(sizes, "root").where("k < n").select("root", "n")


def links_in_blocks(found: DataFrame, comp: DataFrame, wide: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """(a, n, m): for the classes of the components in `wide`, how many rows and classes link with them, by comparing every two classes
    of a component. A component is cut into blocks of about `block` rows, and every two of its blocks meet in a group;
    components of one block share groups."""
    rows = found.select("cid", "x", "size").join(comp.join(wide, "root"), F.col("cid") == F.col("node"))
    rows = rows.withColumn("g", F.ceil(F.col("n") / block).cast("long")).withColumn("own", F.pmod(F.xxhash64("cid", F.lit(2)), F.col("g")))
    few = wide.where(F.col("n") <= block).agg(F.sum("n")).first()[0] or 0
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)))
    together = F.struct(F.col("root"), F.least("own", "other"), F.greatest("own", "other"))
    shared = F.struct(F.pmod(F.xxhash64("root"), F.lit(-(-few // block) or 1)), F.lit(-1).cast("long"), F.lit(-1).cast("long"))
    rows = rows.withColumn("meet", F.when(F.col("g") > 1, F.xxhash64(together)).otherwise(F.xxhash64(shared)))

    def count(group):
        root, own, other = (group.column(c).to_numpy() for c in ("root", "own", "other"))
        x, size, n = unit(group.column("x")), group.column("size").to_numpy(), np.zeros(group.num_rows, np.int64)
        m = np.zeros(group.num_rows, np.int64)
        # rows of the lower block, and of the higher one; a block that meets itself is both
        order = np.lexsort((own, other + own, root))
        cuts = np.flatnonzero(np.concatenate([[True], (np.diff(root[order]) != 0) | (np.diff((own + other)[order]) != 0), [True]]))
        for start, end in zip(cuts[:-1], cuts[1:]):
            of = order[start:end]
            low, high = of[own[of] <= other[of]], of[own[of] >= other[of]]
            same = own[of[0]] == other[of[0]]
            for at in range(0, len(low), 512):
                some = low[at : at + 512]
                near = x[some] @ x[high].T >= cosine
                if same:
                    near[np.arange(len(some)), np.arange(at, at + len(some))] = False
                else:
                    n[high] += size[some] @ near
                    m[high] += near.sum(0)
                n[some] += near @ size[high]
                m[some] += near.sum(1)
        return pa.table({"a": group.column("cid"), "n": pa.array(n), "m": pa.array(m)})

    counted = rows.select("meet", "root", "own", "other", "cid", "size", "x").groupBy("meet").applyInArrow(count, "a long, n long, m long")
    return counted.groupBy("a").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def near_duplicates(vectors: DataFrame, sample: int = AUDIT, least: float = LEAST) -> DataFrame:
    """vec_id, n_links, component_id, kept, n_classes (unequal vectors linked, equal ones once) and class_id (of equal
    vectors; null where a vector takes no part) for every row. If audit() finds less than `least`, an error is raised."""
    rows, found = classes(vectors)
    found = stored(found, "classes")
    dealt = stored(shards(found), "shards")
    links = stored(linked(dealt, found), "links")
    comp = components(links.where("cid <> top").select(F.col("cid").alias("a"), F.col("top").alias("b")))
    wide = stored(spread(comp, dealt), "wide")
    exact = comp.join(wide, "root").select(F.col("node").alias("cid"))
    others = links.join(exact, "cid", "left_anti").groupBy(F.col("cid").alias("a")).agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    others = others.unionByName(links_in_blocks(found, comp, wide))
    c = found.select("cid", "size", "vec_id").join(comp, F.col("cid") == F.col("node"), "left").select("cid", "size", "vec_id", F.coalesce("root", "cid").alias("root"))
    tops = c.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    c = c.join(tops, "root").join(others, F.col("cid") == F.col("a"), "left")
    c = c.select("cid", (F.col("size") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id", "m")
    out = rows.join(c, "cid", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("cid").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("m", F.lit(0)).cast("long").alias("n_classes"), F.col("cid").alias("class_id"))
    out = out.select("vec_id", "n_links", "component_id", F.expr("vec_id <=> component_id").alias("kept"), "n_classes", "class_id")
    if sample:
        out = stored(out, "embeddings")
        recall = audit(vectors, out, sample)
        if recall < least:
            raise RuntimeError(f"of the audited links {recall:.3f} were found, less than {least}")
    return out


def audit(vectors: DataFrame, result: DataFrame, sample: int = AUDIT) -> float:
    """Share of the links between unequal vectors that `result` has, by brute force for `sample` classes of equal vectors,
    those with the smallest hashes, against all classes: the smaller of the share of all their links and the mean share
    of a class. A link too many makes up for none that is lost by another class. 1 if there are no links."""
    found = classes(vectors)[1].select("cid", "shard", "x")
    picked = found.orderBy(F.xxhash64("cid", F.lit(1)), "cid").limit(sample).toArrow()
    by = {}
    for shard in picked.column("shard").unique().to_pylist():
        of = picked.filter(pc.equal(picked.column("shard"), shard))
        by[shard] = of.column("cid").to_numpy(), unit(of.column("x"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                shards_ = part.column("shard").to_numpy()
                for shard in by.keys() & set(shards_.tolist()):
                    cid, v = by[shard]
                    n = (unit(part.column("x").filter(pa.array(shards_ == shard))) @ v.T >= COSINE).sum(0)
                    yield pa.RecordBatch.from_arrays([pa.array(cid[n > 0]), pa.array(n[n > 0])], ["cid", "want"])

    # each class meets itself once
    want = found.select("shard", "x").mapInArrow(run, "cid long, want long").groupBy("cid").agg((F.sum("want") - 1).alias("want")).where("want > 0")
    got = result.select(F.col("class_id").alias("cid"), "n_classes").join(F.broadcast(want), "cid").groupBy("cid").agg(F.min(F.least("n_classes", "want")).alias("got"), F.first("want").alias("want"))
    shares = got.agg(F.sum("got") / F.sum("want"), F.avg(F.col("got") / F.col("want"))).first()
    return min((float(s) for s in shares if s is not None), default=1.0)
