"""Search, conversation repair and line deduplication against brute force, and on odd tables."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import SparkSession

from pagemill.llm import conversations, lines, search

DOCS = "doc_id long, text string, lang string, n long, row string, members string, _k1 long"
CONV = "conv_id long, turn long, role string, text string, n string, part long, fault int"


@pytest.fixture(scope="session")
def spark():
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC"}
    return SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()


def texts(seed=3):
    rng = random.Random(seed)
    words = ["alpha", "BETA", "gamma", "Élan", "x1", "und", "the"]
    out = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 5, 30]))) for _ in range(60)]
    return [*out, *out[:20], None, "", " \n.,", "the" * 3, "Éric-the.BETA", "the " * 5_000]


def docs_of(spark, texts):
    rows = [(None if i % 17 == 5 else i % 61, t, "l", 7, "r", "m", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[0], rows[0], (None, "the the", None, None, None, None, None)], DOCS).repartition(3)


def plain_search(docs, items, top=50):
    term = re.compile(search.TERM)
    lower = str.maketrans(search.UPPER, search.LOWER)
    bags = [(d, Counter(term.findall((t or "").translate(lower)))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n, total = len(bags), sum(x[2] for x in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    out = []
    for item, text in set(items):
        found = []
        for d, b, size in bags:
            m = 100 - 50 + 50 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 20 * m)) for t in set(term.findall((text or "").translate(lower))) if b[t])
            if s > 0:
                found.append((-s, d is not None, d or 0))
        out += [(item, r, d if has else None, -s) for r, (s, has, d) in enumerate(sorted(found)[:top], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("block", "piece", "top"), [(search.BLOCK_ITEMS, search.PIECE, 50), (2, 60, 3)])
def test_search_is_brute_force(spark, monkeypatch, block, piece, top):
    monkeypatch.setattr(search, "PIECE", piece)
    docs = docs_of(spark, texts())
    items = [(1, "the und"), (2, "Alpha beta, x1 x1"), (3, None), (4, "..."), (5, "unknown words"), (2, "the und"), (1, "the und"), (None, "élan gamma"), (6, "the " * 2_000 + "ALPHA")]
    table = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, terms long")
    got = search.search(docs, table, top, block_items=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_search([(r.doc_id, r.text) for r in docs.collect()], items, top)


def test_search_of_empty_tables(spark):
    docs, none = docs_of(spark, ["a b"]), spark.createDataFrame([], DOCS)
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search.search(none, items).count() == 0
    assert search.search(docs, items.where("item_id > 1")).count() == 0


def test_a_class_of_any_size_is_cut_to_its_first_members(spark):
    docs = spark.range(9_000).selectExpr("9000 - id as doc_id", "if(id < 4000, 'other', 'same words here') as text")
    got = search.search(docs, spark.createDataFrame([(1, "words")], "item_id long, text string")).orderBy("rank").collect()
    assert [r.doc_id for r in got] == list(range(1, 51))


# --- conversations


def plain_repair(rows):
    """Cost and the least audit of rows (initial, fault), by trying every string of edits."""
    best = None
    choices = [[("D", None)] + ([("R", "u"), ("R", "a"), ("K", i)] if f in (0, 3) else []) for i, f in rows]
    slots = [[""], *[["", "I", "II"]] * len(rows)][1:] + [["", "I", "II"]]
    for edits in itertools.product(*choices):
        for ins in itertools.product(*slots):
            options = [[("", "")] if not x else [("I" * len(x), "".join(r)) for r in itertools.product("ua", repeat=len(x))] for x in ins]
            for roles in itertools.product(*options):
                audit = "".join(roles[k][0] + edits[k][0] for k in range(len(rows))) + roles[-1][0]
                shape = "".join(roles[k][1] + (edits[k][1] or "") if edits[k][0] != "D" else roles[k][1] for k in range(len(rows))) + roles[-1][1]
                if re.fullmatch("(s?(ua)+)?", shape):
                    cost = sum({"D": 2, "R": 1, "K": 0}[e] + 5 * (f == 3 and e != "D") for (e, _), (_, f) in zip(edits, rows)) + 5 * sum(map(len, ins))
                    best = min(best or (cost, audit), (cost, audit))
    return best


def test_repair_is_the_cheapest_and_the_least():
    rng = random.Random(1)
    for _ in range(60):
        rows = [(rng.choice("suaax"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randrange(1, 4))]
        t = conversations.walked([("" if i == "x" else i, f, 1) for i, f in rows], conversations.START)
        end = conversations.ended(t)
        got = t.cost[end] + 5 * len(conversations.TAILS[end]), "".join(t.path(end)) + conversations.TAILS[end]
        assert got == plain_repair(rows), rows


def forward_least(rows):
    """The same by complete strings per state, for longer conversations."""
    best = {0: (0, "")}
    for i, f in rows:
        new = {}
        for a, b, c, s in conversations.STEPS[i, f]:
            if a in best:
                way = (best[a][0] + c, best[a][1] + s)
                new[b] = min(new.get(b, way), way)
        best = new
    return min((best[s][0] + 5 * len(conversations.TAILS[s]), best[s][1] + conversations.TAILS[s]) for s in best)


def test_long_ties_and_settled_edits():
    rng = random.Random(2)
    for roles, faults in (("ua", [0] * 9 + [3]), ("", [0]), ("suaa", [0, 1, 2, 3]), ("u", [0])):
        rows = [(rng.choice(roles or [""]), rng.choice(faults)) for _ in range(700)]
        t = conversations.walked([(*r, 1) for r in rows], 0)
        end = conversations.ended(t)
        assert (t.cost[end] + 5 * len(conversations.TAILS[end]), "".join(t.path(end)) + conversations.TAILS[end]) == forward_least(rows)
        if roles == "ua":
            assert len(t.out) > 500  # survivors shared their first edits


def plain_report(rows, damaged=True):
    """The report of rows (conv_id, turn, role, text) by lists."""
    out, of = {}, defaultdict(list)
    for conv, turn, role, text in rows:
        out.setdefault(conv, None)
        text, role = " " if text is None else text, " " if role is None else role
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damaged else 9
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        of[conv] += [(turn is not None, turn or 0, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    for conv in out:
        seen, faults, had = set(), [], sorted(of[conv])
        for _, _, role, text in had:
            plain = text.strip(" \t\n\x0b\f\r")
            faults.append(1 if not plain else 2 if (role, text) in seen else 3 if plain[-1] not in ".!?" else 0)
            seen.add((role, text))
        first = [r[2][:1] for r in had]
        cost, audit = forward_least([(i if i in ("s", "u", "a") else "", f) for i, f in zip(first, faults)]) if had else (0, "")
        kept, state, j = [], 0, 0
        for edit in audit:
            if edit == "I":
                state = conversations.NEXT[state]
                kept.append(("user" if state == 2 else "assistant") + ":")
                continue
            _, _, role, text = had[j]
            j += 1
            if edit == "K" and role[:1] == "s":
                state = 1
                kept.append(f"{role}:{text}")
            elif edit != "D":
                state = conversations.NEXT[state]
                kept.append((role if edit == "K" else "user" if state == 2 else "assistant") + ":" + text)
        turns = {t for has, t, _, _ in had if has}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, faults.count(1), faults.count(2), faults.count(3), sum(a + b not in conversations.LEGAL for a, b in zip(first, first[1:])), cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def odd_conversations(seed=4):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "so", "", " \n", None, "Well? \t", "ünd.", "x" * 3_000 + "."]
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "system", "tool", None, ""]), rng.choice(texts) if rng.random() < 0.5 else f"line {t} of {c}.") for c in range(12) for t in range(rng.choice([1, 3, 8, 30]))]
    rows += [(99, t, "user" if t % 2 else "assistant", f"t{t // 3}.") for t in range(400)]
    rows += [(98, 1, "user", "again.")] * 50 + [(97, None, "user", f"n{i % 7}.") for i in range(20)] + [(None, t % 4, "system", "z.") for t in range(9)]
    return [*rows, (20, 6, "user", None), (21, None, None, None)]


@pytest.mark.parametrize("limits", [(conversations.CHUNK_ROWS, conversations.CHUNK_BYTES), (5, 1_000), (1, 1)])
def test_report_is_the_plain_one_in_pieces_of_any_size(spark, limits):
    rows = odd_conversations()
    table = spark.createDataFrame([(*r, "n", 1, 2) for r in rows], CONV).repartition(5)
    got = conversations.repair_damaged(table, *limits)
    assert {r.conv_id: tuple(r)[1:] for r in got.collect()} == plain_report(rows)
    assert got.count() == len({r[0] for r in rows})


def test_repaired_rows_and_empty_tables(spark):
    rows = [(1, 0, "user", "a."), (1, 1, "user", "b."), (1, 2, "assistant", "c.")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = conversations.repair(table).orderBy("part", "seq", "place").collect()
    assert [(r.role, r.text) for r in got] == [("user", "b."), ("assistant", "c.")]
    assert conversations.repair_damaged(table.where("turn > 5")).count() == 0


# --- lines


def plain_lines(rows, min_chars=40, min_docs=5):
    white, lower = " \t\n\x0b\f\r", str.maketrans(lines.UPPER, lines.LOWER)
    key = lambda x: x.strip(white).translate(lower)
    ids = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars:
                ids[key(x)].add((d is not None, d or 0))
    last = {k: max(v) for k, v in ids.items() if len(v) >= min_docs}
    out = []
    for d, t in rows:
        had = (t or "").split("\n")
        kept = [x for x in had if last.get(key(x), (d is not None, d or 0)) == (d is not None, d or 0)]
        out.append((d, len(had), len(had) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_lines_are_brute_force(spark):
    rng = random.Random(6)
    pool = ["Line %d " % i + "é" * (34 + i % 4) for i in range(12)] + ["\t %s \r" % ("COMMON line " * 4), "common line " * 4, "", "short", "x" * 5_000]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.choice([1, 3, 9]))), "l", 1, "r", "m", 5) for i in range(80)]
    rows += [rows[3], rows[3], (3, "other\n" + pool[12], None, None, None, None, None), (None, pool[13], None, None, None, None, None), (None, pool[13], None, None, None, None, None), (81, None, None, None, None, None, None), (82, "", None, None, None, None, None), (83, "\n\n" + pool[13] + "\n", None, None, None, None, None)]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    got = lines.line_report(docs)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_lines([r[:2] for r in rows])
    kept = lines.dedup_lines(docs)
    assert kept.select("row.*").columns == docs.columns and kept.count() == len(rows)
    assert lines.line_report(docs.where("doc_id > 900")).count() == 0
