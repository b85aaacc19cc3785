"""URL filters: all glob rules run at once over each canonical URL, as one multiword Shift-And automaton.

A canonical URL is the lower-cased host, a separator byte and the path. In a glob `?` is any byte of a part, `*` any
run within host or path, `**` any run at all. Rules are prefixes of host and path and come first, the longest of them
wins and of equal lengths the first; globs decide what no rule fits, the first that matches. Both are plain tables, of
(verdict, host, path) rows, of any number: the automaton takes about a bit per byte of them.

Null URLs and URLs without `://` have an empty host and path and are judged like any other; very long URLs are read
whole. Repeated rows are judged each; extra columns are ignored, whatever their names; an empty table gives an empty
result."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEPARATOR = 0xFF  # never part of UTF-8

# The rules of the query, as (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
# Globs that decide where no rule fits, as (verdict, host, path).
GLOBS = [
    ("block", "*spam*", "**"), ("block", "*pills*", "**"), ("block", "*casino*", "**"), ("block", "*viagra*", "**"), ("block", "*payday*", "**"), ("block", "*porn*", "**"),
    ("block", "ads.*", "**"), ("block", "adserver.*", "**"), ("block", "*doubleclick*", "**"), ("block", "*", "/wp-login.php"), ("block", "*", "/cgi-bin/**"), ("block", "*", "**/xmlrpc.php"),
]


@dataclass
class Automaton:
    step: np.ndarray  # (256, words): states that a byte leads into
    stay: np.ndarray  # (256, words): states that a byte may stay in
    start: np.ndarray
    final: list[tuple[int, int]]  # word and bit of each pattern's last state

    def run(self, texts: list[bytes]) -> np.ndarray:
        """(texts, patterns) booleans. Texts are sorted by length, so that ended ones fall out of the loop."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        lengths = np.array([len(texts[i]) for i in order], np.int64)
        flat = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
        begin = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(order) else lengths
        state = np.repeat(self.start[None, :], len(order), 0)
        for at in range(int(lengths.max(initial=0))):
            live = int(np.searchsorted(-lengths, -at, "left"))
            byte = flat[begin[:live] + at]
            old = state[:live]
            moved = old << np.uint64(1)
            moved[:, 1:] |= old[:, :-1] >> np.uint64(63)
            state[:live] = (moved & self.step[byte]) | (old & self.stay[byte])
        out = np.zeros((len(order), len(self.final)), bool)
        for p, (word, bit) in enumerate(self.final):
            out[order, p] = (state[:, word] >> np.uint64(bit)) & np.uint64(1) != 0
        return out


def compile_globs(patterns: list[bytes]) -> Automaton:
    parsed = []
    for pattern in patterns:
        items, loops, i = [], {}, 0
        while i < len(pattern):
            if pattern[i : i + 2] == b"**":
                loops[len(items)] = 2
                i += 2
            elif pattern[i] == ord("*"):
                loops[len(items)] = max(1, loops.get(len(items), 0))
                i += 1
            else:
                items.append(pattern[i])
                i += 1
        parsed.append((items, loops))
    bits = sum(len(items) + 1 for items, _ in parsed)
    words = max(1, -(-bits // 64))
    step, stay, start = np.zeros((256, words), np.uint64), np.zeros((256, words), np.uint64), np.zeros(words, np.uint64)
    part = np.arange(256) != SEPARATOR
    final, first = [], 0
    for items, loops in parsed:
        start[first // 64] |= np.uint64(1 << (first % 64))
        for k, c in enumerate(items, 1):
            at = first + k
            where = part if c == ord("?") else np.arange(256) == c
            step[where, at // 64] |= np.uint64(1 << (at % 64))
        for k, kind in loops.items():
            at = first + k
            stay[part if kind == 1 else slice(None), at // 64] |= np.uint64(1 << (at % 64))
        final.append(((first + len(items)) // 64, (first + len(items)) % 64))
        first += len(items) + 1
    return Automaton(step, stay, start, final)


def url_parts(df: DataFrame, col: str = "url") -> DataFrame:
    """Adds host and path of the contract."""
    rest = F.when(F.instr(col, "://") > 0, F.expr(f"substr({col}, instr({col}, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.expr("substr(_rest, length(_host) + 1)"), r"^[^?#]*", 0)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return df.withColumn("_rest", rest).withColumn("_host", host).withColumn("path", path).withColumn("host", F.translate("_host", upper, lower)).drop("_rest", "_host")


def judge_urls(pages: DataFrame, rules=RULES, globs=GLOBS) -> DataFrame:
    """page_id, host, path, rule, verdict. The longest rule that fits decides, of equal lengths the first; else the first
    glob that matches; a URL is allowed if none does."""
    rules = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    sep = bytes([SEPARATOR])
    patterns = []
    for _, host, path in rules:
        tail = host.encode() + sep + path.encode() + b"**"
        patterns += [tail, b"*." + tail]
    patterns += [host.encode() + sep + path.encode() for _, host, path in globs]
    machine = compile_globs(patterns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            hit = machine.run([h.encode() + sep + p.encode() for h, p in zip(hosts, paths)])
            n = len(rules)
            fits = hit[:, : 2 * n].reshape(len(hosts), n, 2).any(2) if n else np.zeros((len(hosts), 0), bool)
            other = [globs[int(row.argmax())][0] if row.any() else "allow" for row in hit[:, 2 * n :]] if globs else ["allow"] * len(hosts)
            first = [int(row.argmax()) if row.any() else -1 for row in fits]
            rule = [rules[i][1] + rules[i][2] if i >= 0 else None for i in first]
            verdict = [rules[i][0] if i >= 0 else v for i, v in zip(first, other)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("host"), batch.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    parts = url_parts(pages.select("page_id", "url")).select("page_id", "host", "path")
    return parts.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


SQL = """
WITH r AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*', 0)) + 1), '^[^?#]*', 0) AS path FROM r),
f AS (SELECT *, CASE
  WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
  WHEN rule IS NOT NULL OR regexp_matches(host, 'spam|pills|casino|viagra|payday|porn|doubleclick') OR host LIKE 'ads.%' OR host LIKE 'adserver.%'
    OR path = '/wp-login.php' OR path LIKE '/cgi-bin/%' OR path LIKE '%/xmlrpc.php' THEN 'block' ELSE 'allow' END AS verdict FROM f
"""
