"""The operators against brute force, and on tables with nulls, empty and long texts, ties, repeats and odd columns."""

from __future__ import annotations

import functools
import math
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from pagemill.llm import common, decontam, embeddings, extraction, jaccard, language, mixing, quality, scores, toxicity, url_filters

DOCS = "doc_id long, text string, lang string, source string, n_chars long, sid long, keys string, path string"


@pytest.fixture(scope="session")
def spark():
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC"}
    return SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()


def texts():
    rng = random.Random(5)
    words = ["w%d" % i for i in range(300)]
    base = [[rng.choice(words) for _ in range(rng.choice([2, 3, 6, 9, 40, 120]))] for _ in range(40)]
    out = [" ".join(b) for b in base]
    for b in base:
        for _ in range(3):
            c = list(b)
            for _ in range(rng.choice([0, 1, 2, 4])):
                c[rng.randrange(len(c))] = rng.choice(words)
            out.append(" ".join(c))
    return [*out, None, "", " \n\t", "one", "ONE", "ÉÀ x", " ".join(words * 20), out[0]]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, ["en", "fr", None][i % 3], ["a", "b", None][min(i % 9, 2)], 0, 1, "k", "p") for i, t in enumerate(texts())]
    rows += [rows[0], rows[5], (None, "null id here", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def tokens(t):
    return (t or "").encode().lower().split()


def test_jaccard_is_brute_force(docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets = []
    for _, t in rows:
        w = tokens(t)
        sets.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    want = Counter((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets)))
    assert Counter(map(tuple, jaccard.jaccard_components(docs).collect())) == want
    assert jaccard.jaccard_components(empty).count() == 0
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    full = [r.doc_id for r in kept.collect() if tokens(r.text)]
    assert sorted(full, key=str) == sorted({c for (_, n, c) in want if n}, key=str)


def test_pipeline_drops_copies_between_thresholds(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:330])), (3, " ".join(words[:300])), (4, "some other words that stand alone here")]
    some = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.component_id for r in jaccard.jaccard_components(some).collect()) == [1, 2, 2, 4]
    some = some.where("doc_id <> 3")
    assert {r.doc_id for r in jaccard.keep_one(some).collect()} == {1, 2, 4}
    assert {r.doc_id for r in corpus_pipeline.dedup_stage(spark, some, "").collect()} == {1, 4}
    assert jaccard.planes(np.zeros(0, np.uint64)) == b""


def test_one_row_of_each_component_stays(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(None, a), (None, b), (7, c), (7, d), (8, c), (9, d + " more"), (None, d), (None, ""), (7, None), (7, c)]
    got = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([(None, a), (None, b), (7, c), (7, d), (None, ""), (7, None)])


def naive_components(texts, k, percent):
    sets = []
    for t in texts:
        w = tokens(t)
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def test_tiles_find_what_the_first_steps_leave(spark, monkeypatch):
    rng = random.Random(8)
    shared = [f"s{i}" for i in range(30)]
    texts = []
    for _ in range(60):  # alike below the threshold, so every two sets of the key are compared
        texts.append(" ".join(shared[:20] + [f"u{rng.randrange(40)}" for _ in range(6)]))
    for i in range(0, 60, 7):
        texts.append(texts[i] + " end")
    used = []
    tiled = jaccard.tiled
    monkeypatch.setattr(jaccard, "tiled", lambda *a: used.append(1) or tiled(*a, tile=5))
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(table).collect()}
    assert used and got == dict(enumerate(naive_components(texts, 4, 85)))


def test_unrelated_documents_and_any_partitions(spark):
    rows = [(1, "a b c d e f"), (2, "g h i j k l"), (3, "a b c d e f"), (4, "m"), (5, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    try:
        for n in ("1", "211"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert [r.component_id for r in jaccard.jaccard_components(table.where("doc_id < 3")).orderBy("doc_id").collect()] == [1, 2]
            assert [r.component_id for r in jaccard.jaccard_components(table).orderBy("doc_id").collect()] == [1, 2, 1, 4, 5]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_columns_of_any_name_are_carried_on(spark):
    names = "_id _empty _some _copy _row _sid _n row sid root host".split()
    rows = [(i, f"word{i} and more of it", "s", *[f"{n}{i}" for n in names]) for i in range(6)]
    table = spark.createDataFrame(rows, ["doc_id", "text", "source", *names])
    for got in (jaccard.keep_one(table), mixing.mixed_rows(table)):
        assert got.columns == table.columns
        assert {tuple(r) for r in got.collect()} <= set(rows) and got.count() > 3


def test_components_of_a_chain(spark):
    chain = spark.range(400).selectExpr("id as a", "id + 1 as b")
    assert common.components(chain).groupBy("root").count().collect() == [(0, 401)]
    with pytest.raises(RuntimeError):
        common.components(chain, rounds=3)


def test_bitmap_bounds_overlap():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(rng.integers(0, 400, 200).astype(np.uint64))
        b = np.unique(rng.integers(0, 400, 250).astype(np.uint64))
        x, y = (np.unpackbits(np.frombuffer(jaccard.bitmap(s), np.uint8)) for s in (a, b))
        assert len(np.intersect1d(a, b)) <= min(len(a) - (x & ~y & 1).sum(), len(b) - (y & ~x & 1).sum())


def test_scores(docs, empty):
    rows = docs.collect()
    held = [zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 10 == 0 for r in rows]
    count = Counter(w for r, h in zip(rows, held) if not h for w in [*tokens(r.text), b"\n"])
    n, v = sum(count.values()), len(count)
    want = Counter()
    for r, h in zip(rows, held):
        t = [*tokens(r.text), b"\n"]
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        want[(r.doc_id, h, len(t), sum(count[w] > 0 for w in t), n, round(base, 6))] += 1
    got = scores.score_lm(docs).collect()
    assert Counter((*r[:5], round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert scores.score_lm(empty).count() == 0


def test_interpolated_score_is_the_plain_one(docs, monkeypatch):
    found = []
    learn = scores.learn_weights
    monkeypatch.setattr(scores, "learn_weights", lambda *a: found.append(learn(*a)) or found[0])
    got = Counter((r.doc_id, round(r.score, 6)) for r in scores.score_lm(docs).collect())
    rows = [(r.doc_id, [*tokens(r.text), b"\n"]) for r in docs.collect()]
    train = [t for d, t in rows if zlib.crc32(str("" if d is None else d).encode()) % 10]
    one = Counter(w for t in train for w in t)
    two = Counter(p for t in train for p in zip([b"\n", *t], t))
    total, want = sum(one.values()), Counter()
    for d, t in rows:
        score = 0.0
        for before, w in zip([b"\n", *t], t):
            c = one[before]
            a, b, u = found[0][min(math.ceil(math.log2(c + 1)), scores.LEVELS - 1)]
            score += math.log10(a * min(two[before, w] / max(c, 1), 1) + b * one[w] / total + u / (len(one) + 1))
        want[(d, round(score, 6))] += 1
    assert got == want


def test_packed_counts():
    for x in (np.array([], np.int64), np.array([0, 5, 2**32 - 1]), np.array([1, 2**40])):
        assert scores.unpacked(scores.packed(x)).tolist() == x.tolist()


def test_weights_are_learned_at_small_sizes(docs, monkeypatch):
    found = []
    learn = scores.learn_weights
    monkeypatch.setattr(scores, "learn_weights", lambda *a: found.append(learn(*a)) or found[0])
    assert scores.score_lm(docs).count() == docs.count()
    start = np.tile([0.4, 0.5, 0.1], (scores.LEVELS, 1))
    start[0] = [0, 0.9, 0.1]
    assert (np.abs(found[0] - start).max(1) > 0.05).sum() >= 3
    assert np.allclose(found[0].sum(1), 1)


def test_hash_ranges_follow_the_text(docs, monkeypatch):
    used = []
    counts = scores.counts_of
    monkeypatch.setattr(scores, "counts_of", lambda sliced, parts: used.append(parts) or counts(sliced, parts))
    want = Counter((r.doc_id, round(r.score, 6)) for r in scores.score_lm(docs).collect())
    monkeypatch.setattr(scores, "RANGE_BYTES", 1000)
    assert Counter((r.doc_id, round(r.score, 6)) for r in scores.score_lm(docs).collect()) == want
    size = sum(len((r.text or "").encode()) for r in docs.collect())
    assert used == [4, -(-size // 1000)] and used[1] > 4


def test_classifiers(spark, docs, empty):
    labels = docs.where("doc_id is not null").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic")).distinct()
    for fit, score in ((quality.fit_quality, quality.score_quality), (toxicity.fit_toxicity, toxicity.score_toxicity)):
        for some in (labels, labels.limit(0), labels.where("quality = 1")):
            got = score(docs, fit(docs, some)).collect()
            assert len(got) == docs.count()
            assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
        assert score(empty, fit(docs, labels)).count() == 0
    assert quality.keep_quality(docs, quality.fit_quality(docs, labels)).columns == docs.columns


def test_interactions_are_learned():
    rng = np.random.default_rng(3)
    both = rng.integers(0, 2, (4000, 2))
    y = both.prod(1).astype(float)
    found = [np.array([i + 10 for i in (0, 1) if row[i]], np.int32) for row in both]
    s = toxicity.fit_machine(found, y).score(found)
    assert ((s >= 0.5) == (y == 1)).all()


def test_terms_that_mean_nothing_alone_are_learned():
    rng = np.random.default_rng(3)

    def table():
        either = rng.integers(0, 2, (4000, 2))
        noise = [rng.choice(200, 8, replace=False) + 100 for _ in either]
        return [np.sort(np.concatenate([np.flatnonzero(r) + 10, x])).astype(np.int32) for r, x in zip(either, noise)], (either.sum(1) == 1).astype(float)

    machine, (found, y) = toxicity.fit_machine(*table()), table()
    assert ((machine.score(found) >= 0.5) == (y == 1)).all()  # no weighted sum of the two terms parts them


def test_trees_against_plain_ones():
    """Each tree's walk node by node gives the flat arrays' margin, and the trees learn what no single cut parts."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, quality.N_FEATURES))
    y = ((x[:, 3] > 0) ^ (x[:, 7] > 0.5)).astype(float)
    model = quality.fit_trees(x, y)
    test = rng.normal(size=(500, quality.N_FEATURES))
    for row, margin in zip(test[:50], model.margin(test[:50])):
        total = model.base
        for f, c, leaf in zip(model.feature, model.cut, model.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > c[node] else 1)
            total += leaf[node - len(f)]
        assert total == pytest.approx(margin)
    assert ((model.score(test) >= 0.5) == ((test[:, 3] > 0) ^ (test[:, 7] > 0.5))).mean() > 0.95


def test_mixtures_of_languages(spark):
    rng = random.Random(4)
    alphabets = {"aa": "abcdefg", "bb": "hijklmn", "cc": "opqrstu"}

    def words(lang, n):
        return " ".join("".join(rng.choice(alphabets[lang]) for _ in range(5)) for _ in range(n))

    rows = [(i, words(lang, 60), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 20)]
    model = language.fit_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    for first, second in (("aa", "bb"), ("cc", "aa")):
        lang, score, shares = model.predict((words(first, 140) + " " + words(second, 60)).encode())
        assert lang == first and set(shares) == {first, second}
        assert shares[first] == score == pytest.approx(0.7, abs=0.05)
    assert set(model.predict(words("bb", 50).encode())[2]) == {"bb"}


def test_languages(docs, empty):
    model = language.fit_languages(docs)
    got = language.predict_languages(docs, model).collect()
    assert len(got) == docs.count() and {r.lang_pred for r in got} <= {"en", "fr", "und"}
    assert all((r.lang_pred == "und") <= (r.score == 0) for r in got)
    assert model.predict(None)[0] == model.predict(b"12 34")[0] == "und"
    assert language.fit_languages(empty).predict(b"abc")[0] == "und"
    assert language.predict_languages(empty, model).count() == 0


def test_decontamination(spark, docs, empty):
    rng = random.Random(2)
    passage = [f"item{rng.randrange(10**6)}" for _ in range(30)]
    near = passage[:12] + ["changed"] + passage[13:]
    far = [w if i % 3 else "other" for i, w in enumerate(passage)]
    items = spark.createDataFrame([(1, " ".join(passage)), (2, None), (3, "")], "item_id long, text string")
    extra = [(1000 + i, f"begin of {' '.join(p)}, and the end".upper(), None, None, None, None, None, None) for i, p in enumerate((passage, near, far))]
    table = docs.unionByName(spark.createDataFrame(extra, DOCS))
    got = {r.doc_id: r.similarity for r in decontam.contaminated(table, items).collect()}
    assert set(got) == {1000, 1001} and got[1000] > 0.99 and 0.8 <= got[1001] < 0.9
    assert table.count() - decontam.decontaminate(table, items).count() == 2
    assert decontam.contaminated(table, items.limit(0)).count() == 0
    assert decontam.contaminated(empty, items).count() == 0


def test_benchmark_blocks_and_radius_lose_nothing(spark):
    rng = random.Random(12)
    word = lambda: f"v{min(int(rng.expovariate(0.004)), 3000)}"
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 8, 20, 60, 120])))) for i in range(60)]
    docs = []
    for i, (_, t) in enumerate(items):
        w = t.split()
        for change in (0, 1, 2, 3):
            c = list(w)
            for _ in range(change):
                c[rng.randrange(len(c))] = word()
            docs.append((4 * i + change, " ".join([word() for _ in range(40)] + c + [word() for _ in range(40)])))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    got = {n: {(r.doc_id, r.item_id, round(r.similarity, 9)) for r in decontam.contaminated(docs, bench, n).collect()} for n in (3, 7, 5000)}
    assert got[3] == got[7] == got[5000]
    # every window of an item's length, without fingerprints
    df = {k: Counter() for k in range(1, 6)}
    plain = {i: t.split() for i, t in items}
    sets = {i: (min(5, len(w)), {tuple(w[j : j + min(5, len(w))]) for j in range(len(w) - min(5, len(w)) + 1)}) for i, w in plain.items()}
    for k, s in sets.values():
        df[k].update(s)
    n_items = Counter(k for k, _ in sets.values())
    weight = lambda k, g: math.log1p(n_items[k] / df[k][g])
    want = set()
    for r in docs.collect():
        w = r.text.split()
        for i, (k, s) in sets.items():
            best, n = 0.0, len(plain[i])
            grams = [tuple(w[j : j + k]) for j in range(len(w) - k + 1)]
            if not s.intersection(grams):
                continue
            for begin in range(max(1, len(w) - n + 1)):
                best = max(best, sum(weight(k, g) for g in s.intersection(grams[begin : begin + n - k + 1])))
            if best >= 0.8 * sum(weight(k, g) for g in s) - 1e-9:
                want.add((r.doc_id, i))
    found = {(d, i) for d, i, _ in got[7]}
    assert len(want) > 100 and found <= want and len(found & want) >= 0.99 * len(want)


def plain_items(word_lists):
    hashes = [decontam.plain_words(" ".join(w).encode(), decontam.PlainHash()) for w in word_lists]
    known, df = np.unique(np.concatenate([np.unique(common.shingles(h, 5)) for h in hashes]), return_counts=True)
    return decontam.Items(5, list(range(len(hashes))), hashes, known, df, len(hashes)), hashes


@pytest.mark.parametrize("n", [5, 6, 8, 40, 400])
def test_fingerprints_of_unrelated_items_are_far(n):
    rng = random.Random(n)
    items, _ = plain_items([[f"u{rng.randrange(10**9)}" for _ in range(n)] for _ in range(400)])
    _, prints, _ = items.by_length[n]
    far = np.bitwise_count(prints.whole[:, None] ^ prints.whole[None]).sum(2)
    assert ((far <= decontam.RADIUS).sum() - 400) / (400 * 399) < 0.001
    # the block tables give all within the radius, whatever it is
    for radius in (40, 79, 110, 128):
        index = decontam.Prints(prints.whole.view("<u2"), radius)
        for i in range(0, 400, 13):
            assert list(index.within(index.whole[i].view("<u2"))) == list(np.flatnonzero(far[i] <= radius))


def test_fingerprints_keep_matches_of_items_with_common_passages():
    rng = random.Random(8)
    word = lambda: f"x{rng.randrange(10**6)}"
    common_ = [[word() for _ in range(12)] for _ in range(3)]
    lists = []
    for i in range(300):
        w = [word() for _ in range(rng.choice([3, 8, 20, 60]))]
        lists.append(common_[i % 3] + w if i % 2 else w + [word() for _ in range(5)])
    items, _ = plain_items(lists)
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in lists]
    df = Counter(g for s in sets for g in s)
    weight = lambda gs: sum(math.log1p(300 / df[g]) for g in gs)
    want = kept = 0
    for i, w in enumerate(lists):
        for _ in range(12):
            c = list(w)
            for _ in range(rng.choice([0, 1, 1, 2])):
                c[rng.randrange(len(c))] = rng.choice(lists)[0] if rng.random() < 0.5 else word()
            doc = [word() for _ in range(9)] + c + rng.choice(lists)
            grams = [tuple(doc[j : j + 5]) for j in range(len(doc) - 4)]
            got = items.matches(decontam.plain_words(" ".join(doc).encode(), decontam.PlainHash()))
            for j, s in enumerate(sets):
                if s.intersection(grams):
                    n = len(lists[j])
                    best = max(weight(s.intersection(grams[b : b + n - 4])) for b in range(len(grams)))
                    if best >= 0.8 * weight(s) + 1e-9:
                        want, kept = want + 1, kept + (j in got)
    assert want > 3000 and kept >= 0.99 * want


@pytest.mark.parametrize("shape", ["<div>{} ", "<div class='a b'>t<p>{}</p></i>", "<b x {} ", "<b<", "<script x ", "<!x ", '<b "', "<b x='", "</div>", "<div><p>{}</span></section>"])
def test_deep_and_broken_pages_cost_in_proportion(shape):
    def cost(n):
        html = "".join(shape.format(i) for i in range(n)) + "<p>the end"
        tracemalloc.start()
        page = extraction.Page(html)
        text = page.text(page.path_of(page.best()[0]))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert not text or text.count("\n") <= 2 * n
        start = time.process_time()
        extraction.Page(html).best()
        return peak, time.process_time() - start

    cost(200)
    (small, _), (large, seconds) = cost(4_000), cost(32_000)
    assert large < 12 * small + (1 << 20) and seconds < 6


def test_paths_have_the_id_of_their_steps():
    page = extraction.Page("<html><body><div class='post x1'><section><p>one</p></section></div><article id=a><p>two</article></body>")
    assert [extraction.path_hash(page.path_of(k)) for k in range(len(page.step))] == page.path_id
    assert page.text(">html>body>article.no") == page.text(None) and page.text(">html>body>div.post.x") == "one"


def test_embeddings_find_what_brute_force_finds(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(60, 16))
    rows = [(i, [float(x) for x in centre[i % 60] + rng.normal(scale=0.05, size=16)], i % 60 % 3) for i in range(600)]
    rows += [(600, None, 1), (601, [0.0] * 16, 1), (602, [float("nan")] * 16, 1), (603, rows[0][1], None), (604, rows[0][1], 0), (605, [1.0], 0), (606, [], 0), (607, [None, 1.0], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = embeddings.near_duplicates(table)
    out = {r.vec_id: r for r in got.collect()}
    assert len(out) == 608 and embeddings.audit(table, got) >= 0.9
    # lost links between unequal vectors show, whatever the copies; links too many of some don't make up for them
    copies = table.unionByName(table.where("vec_id < 40").withColumn("vec_id", F.explode(F.expr("sequence(1000 + vec_id * 50, 1049 + vec_id * 50)"))))
    full = embeddings.near_duplicates(copies).cache()
    assert embeddings.audit(copies, full) >= 0.9
    assert embeddings.audit(copies, full.withColumn("n_classes", F.lit(0))) == 0
    half = full.withColumn("n_classes", F.when(F.col("class_id") % 2 == 0, 0).otherwise(99))
    assert embeddings.audit(copies, half) < 0.7
    x = np.array([np.float32(r[1]) for r in rows[:600]], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = ((x @ x.T >= 0.98) & (np.array([r[2] for r in rows[:600]])[:, None] == np.array([r[2] for r in rows[:600]]))).sum() - 600
    assert sum(out[i].n_links for i in range(600)) >= 0.9 * want
    assert all(out[i].n_links == 0 and out[i].kept for i in (600, 601, 602, 603, 605, 606, 607)) and out[604].component_id == 0
    assert embeddings.near_duplicates(table.limit(0)).count() == 0


def test_embeddings_link_all_of_a_large_group(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=64)
    near = base / np.linalg.norm(base) + rng.normal(scale=0.0148, size=(3000, 64))
    some = np.concatenate([near, rng.normal(size=(300, 64))])
    table = spark.createDataFrame([(i, [float(v) for v in x], 0) for i, x in enumerate(some)], "vec_id long, embedding array<double>, label int").repartition(4)
    got = embeddings.near_duplicates(table).cache()
    x = some / np.linalg.norm(some, axis=1, keepdims=True)
    want = (x @ x.T >= embeddings.COSINE).sum(1) - 1
    assert want.sum() > 5_000_000
    assert {r.vec_id: r.n_links for r in got.collect()} == dict(enumerate(want.tolist()))
    assert len({r.component_id for r in got.where("vec_id < 3000").collect()}) == 1
    assert embeddings.audit(table, got) == 1


def test_url_rules(spark):
    urls = [None, "", "x", "http://a.NET/q", "http://a.net", "https://www.example.net/en/1?x", "http://notexample.net/en/", "http://m.example.com/de/", "http://example.org/fr/#a", "http://spam.org/x", "http://evil.com/x.net/y"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = [(r.rule, r.verdict) for r in url_filters.judge_urls(pages).orderBy("page_id").collect()]
    assert got == [(None, "allow")] * 3 + [("net/", "block"), (None, "allow"), ("example.net/en/", "allow"), ("net/", "block"), ("example.com/de/", "block"), ("org/fr/", "allow"), (None, "block"), (None, "allow")]
    assert url_filters.judge_urls(pages.limit(0)).count() == 0


def test_globs_are_a_plain_matcher():
    rng = random.Random(6)
    globs = [tuple("".join(rng.choice(c) for _ in range(rng.randrange(1, 7))) for c in (["a", "b", ".", "*", "?"], ["/", "a", "b", "*", "**", "?"])) for _ in range(300)]
    globs = [(h, "/" + re.sub(r"\*{3,}", "**", p)) for h, p in ((re.sub(r"\*{2,}", "*", h), p) for h, p in globs)]
    machine = url_filters.compile_globs([h.encode() + b"\xff" + p.encode() for h, p in globs])

    def pattern(glob):
        return "".join({"**": "(?s:.*)", "*": "[^\xff]*", "?": "[^\xff]"}.get(x, re.escape(x)) for x in re.findall(r"\*\*|.", glob))

    urls = [("".join(rng.choice("ab.") for _ in range(rng.randrange(0, 6))), "/" + "".join(rng.choice("ab/") for _ in range(rng.randrange(0, 7)))) for _ in range(300)]
    got = machine.run([h.encode() + b"\xff" + p.encode() for h, p in urls])
    want = [[bool(re.fullmatch(pattern(h) + "\xff" + pattern(p), f"{host}\xff{path}")) for h, p in globs] for host, path in urls]
    assert got.tolist() == want and got.any()


def test_globs_over_word_bounds():
    machine = url_filters.compile_globs([b"a" * 70 + b"*z", b"?b", b"*q"])
    assert machine.run([b"a" * 70 + b"xxz", b"ab", b"xq", b""]).tolist() == [[True, False, False], [False, True, False], [False, False, True], [False] * 3]


def test_mixing(docs, empty):
    got = mixing.mix_report(docs).collect()
    assert len(got) == docs.count() and sorted(map(str, got)) == sorted(map(str, mixing.mix_report(docs).collect()))
    assert all(r.taken <= 2 * r["size"] for r in got)
    total = sum(r["size"] for r in got)
    targets = {r.source_size: r.target for r in got}
    assert abs(sum(targets.values()) - 1.5 * total) < 1e-6 and all(t <= 2 * s for s, t in targets.items())
    for size, target in targets.items():
        of = [r for r in got if r.source_size == size]
        assert abs(sum(r.taken for r in of) - target) <= max(r["size"] for r in of)
    assert mixing.mixed_rows(docs).columns == docs.columns
    assert mixing.mix_report(empty).count() == 0


def test_key_ranges_are_small_for_any_script(spark):
    rows = [(i, " ".join(chr(0x4E00 + (i * 7 + j) % 900) * 3 for j in range(5)) + " 12345 67890 !?" * (i % 2), "cjk") for i in range(4000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    text = F.coalesce(F.col("text"), F.lit(""))
    assert table.select(mixing.quality_weight("text").alias("w")).where("w > 0.9").count() == 2000
    key = -F.log((F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long") + 1) / F.lit(float(2**48 + 1))) / mixing.quality_weight("text")
    sizes = table.groupBy(F.floor(F.log(key) * mixing.RANGES)).count()
    assert sizes.agg(F.max("count")).first()[0] <= 0.03 * 4000


def test_targets_by_resharing(spark):
    rng = random.Random(9)
    for n in (1, 2, 7, 25):
        sizes = [(None if i == 3 else f"s{i:02d}", rng.choice([0, 1, 50, 1000, 90000])) for i in range(n)]
        got = {r.source_key: r.target for r in mixing.source_targets(spark.createDataFrame(sizes, "source_key string, source_size long")).collect()}
        order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
        weight = {s: (3, 1, 2)[i % 3] for i, (s, _) in enumerate(order)}
        left, free, want = 1.5 * sum(s for _, s in sizes), dict(sizes), {}
        while free:
            level = left / sum(weight[s] for s in free)
            over = [s for s in free if level * weight[s] > 2 * free[s]]
            for s in over or list(free):
                want[s] = 2.0 * free[s] if over else level * weight[s]
                left -= want[s]
                del free[s]
        assert got == pytest.approx(want)


def test_extraction(spark):
    page = "<html><head><title>no</title></head><body><header>top</header><nav><a href='/'>menu</a></nav><div class='ad'>buy</div><div class='post'><h1>A &amp; B</h1><p>One\n two<br>three <b>four</b><p>Five &lt;x&gt;<script>var a='</p>';</script></div><section id='comments'><p>reader words here</p></section><footer>end</footer></body></html>"
    pages = spark.createDataFrame([(1, "http://h/a", page), (2, None, page), (3, "http://h/b", None), (4, "http://h/c", ""), (1, "http://h/a", page), (5, "http://h/d", "<p>" + "long " * 50000)], "page_id long, url string, html string")
    got = extraction.extract(pages).orderBy("page_id").collect()
    assert [r.text for r in got[:3]] == ["A & B\nOne two three four\nFive <x>"] * 3
    assert [r.text for r in got[3:5]] == ["", ""] and got[5].n_chars == 249999
    assert all(r.n_chars == len(r.text) for r in got)
    assert extraction.extract(pages.limit(0)).count() == 0


def test_extraction_keeps_what_holds_the_page():
    body = "some words of a long article " * 9
    got = lambda html: extraction.Page(html).text(None)
    for html in (
        f"<html><body><form action='/x'><div><p>{body}</p></div></form></body></html>",
        f"<article><div class='social-story'><p>{body}</p></div></article>",
        f"<div class='content no-sidebar'><p>{body}</p></div>",
        f"<div class='widget'><p>{body}</p></div><p>ad</p>",
        f"<div class='notice-page share-it'><p title='a hidden gem' data-class='ad'>{body}</p></div>",
        f"<div><p>{body}</p><div class='post-comments'><p>{body * 3}</p></div><form><p>your mail</p></form><div class='cookie-notice'>We use</div></div>",
    ):
        assert got(html) == body.strip()
    assert got(f"<p>a <span class='notice'>b</span> c {body}</p>").startswith("a b c some")
    assert got("<nav><p>menu only</p></nav>") == ""


def test_hot_hosts_are_dealt_by_salt(spark, monkeypatch):
    rows = [(i, f"http://h{i % 3}/p", f"<div class='x'><p>page {i} with words</p></div><div><p>no</p></div>") for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(map(tuple, extraction.extract(pages).collect()))
    monkeypatch.setattr(extraction, "PATHS", 0)
    assert sorted(map(tuple, extraction.extract(pages).collect())) == want


def plain_pipeline(spark, sf):
    """The five stages over plain lists; the learned models are the operators' own, applied row by row."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    raw = lambda r: r["text"].encode() if r["text"] else None
    trees = quality.fit_quality(docs, labels)
    rows = [r for r in rows if trees.score(quality.features(raw(r))[None])[0] >= 0.5]
    model = language.fit_languages(spark.createDataFrame(rows, docs.schema))
    found = [model.predict(raw(r)) for r in rows]
    rows = [r for r, f in zip(rows, found) if f[0] != "und" and f[1] >= 0.4]
    best = {}
    for r, root in zip(rows, naive_components([r["text"] for r in rows], 5, 80)):
        if root not in best or (r["doc_id"], r["text"]) < (best[root]["doc_id"], best[root]["text"]):
            best[root] = r
    rows = list(best.values())
    items = [i.encode() for (i,) in spark.read.parquet(f"{sf}/benchmark.parquet").select("text").collect() if i]
    words = lambda t: [w for w in (x.lower().strip(decontam.EDGES) for x in t.split()) if w]
    grams = lambda w, k: [tuple(w[j : j + k]) for j in range(len(w) - k + 1)]
    items = [w for w in map(words, items) if w]
    df = Counter((min(5, len(w)), g) for w in items for g in set(grams(w, min(5, len(w)))))
    total = Counter(min(5, len(w)) for w in items)

    def clean(r):
        w = words(raw(r))
        for item in items:
            k = min(5, len(item))
            s, own = set(grams(item, k)), grams(w, k)
            if s.isdisjoint(own):
                continue
            weight = {g: math.log1p(total[k] / df[k, g]) for g in s}
            for begin in range(max(1, len(w) - len(item) + 1)):
                if sum(weight[g] for g in s.intersection(own[begin : begin + len(item) - k + 1])) >= 0.8 * sum(weight.values()) - 1e-9:
                    return False
        return True

    rows = [r for r in rows if clean(r)]
    table = spark.createDataFrame(rows, docs.schema)
    taken = {r.doc_id: r.taken // r["size"] if r["size"] else 0 for r in mixing.mix_report(table).collect()}
    return Counter(tuple(r.values()) for r in rows for _ in range(taken[r["doc_id"]]))


def test_pipeline_is_the_plain_one(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    got = corpus_pipeline.run(spark, sf)
    want = plain_pipeline(spark, sf)
    assert Counter(map(tuple, got.collect())) == want and len(want) > 50


def test_pipeline_stages_on_odd_tables(spark, docs):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    for table in (docs.limit(0), docs.where("text is null or trim(text) = ''"), docs):
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, table, sf)
            assert after.columns == table.columns, name
            assert {tuple(r) for r in after.collect()} <= {tuple(r) for r in table.collect()}, name


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, sf).cache()
        assert after.columns == docs.columns and 0 < after.count(), name
        assert {r.doc_id for r in after.collect()} <= {r.doc_id for r in docs.collect()}
        docs = after
