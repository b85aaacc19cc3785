"""HTML extraction with consensus host paths.

Each page's containers are scored by the text of their blocks; the best container's generalised path (tags and classes,
digits left out) is the page's vote. Spark counts the votes per host; the path with most votes wins (of equal ones the
first), and every page is extracted anew from the containers on its host's path, or from its own best one where it has
none. Menus, headers, footers, sidebars, dialogs and what is hidden fall out by tag or role, scripts and styles as they
are read. Forms, and elements whose class or id has a word such as advert, notice or comments, fall out too unless they
hold most of the page's text outside links (nearly all of it, for reader comments, which may be longer than what they
comment on); inline elements never fall out by class. A block's white space becomes single spaces (a line break
too); blocks are joined by one newline.

Null or empty html gives an empty text; very long pages are taken whole; pages without a host vote for nobody but
themselves; repeated rows are extracted each; extra columns are ignored, whatever their names; an empty table gives an
empty result. A page's paths are held as steps and 64-bit hashes, so that time and memory rise with its length, however
deep or broken it is. Pages meet their host's path by a broadcast of the paths up to PATHS rows and PATH_BYTES, else by
host and salt."""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import slices, stored
from pagemill.llm.url_filters import url_parts

# Attributes end where another tag begins, so that what isn't closed is looked at once.
ATTRIBUTES = r"(?>(?:[^<>\"']+|\"[^\"]*\"|'[^']*'|<(?![a-zA-Z/!]))*)"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|math|iframe|textarea|select|button|title|object|canvas|audio|video)(?=[\s/>])(?>[^<>]*>|{ATTRIBUTES}>).*?(?:</\1\s*>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/<>]*+)({ATTRIBUTES})>|<[!?][^>]*(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("html body div section article main aside nav header footer form dialog center fieldset".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption pre blockquote figure figcaption hr address details summary head".split())
OUT_TAGS = frozenset("nav footer aside dialog".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
OUT_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs sidebar footer masthead cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login share sharing social related recommended recommendations "
    "widget widgets pagination pager toolbar skip".split()
)
REPLY_WORDS = frozenset("comment comments disqus respond replies".split())
HEADER_WORDS = frozenset(["header", "topbar", "sitehead"])
DENIED = frozenset("no not has have with without is non".split())  # in front of a word: about the element, not its kind
MOST, NEARLY_ALL = 0.5, 0.9  # shares of a page's unlinked text over which forms and elements with a word, or with a reply word, stay
PATHS = 200_000
PATH_BYTES = 32 << 20
SALTS = 32
SPACE = re.compile(r"\s+")
WORD = re.compile(r"[a-z]+")


def named(names: str, words: frozenset) -> bool:
    """Whether one of the class or id names is about one of the words: its first or last word is one, as in ad-slot or
    post-comments, but not in has-comments."""
    for name in names.split():
        parts = WORD.findall(name)
        if parts and parts[0] not in DENIED and (parts[0] in words or parts[-1] in words):
            return True
    return False


def below(path_id: int, step: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{path_id}>{step}")


def path_hash(path: str) -> int:
    """The id of a path as Page.path_of gives it."""
    out = 0
    for step in path.split(">")[1:]:
        out = below(out, step)
    return out


class Page:
    """Containers (parent, tag path, kind) and blocks (container, text, share of text in links) of a page. Kinds: KEEP,
    SOFT and REPLY (fall out unless they hold most, or nearly all, of the text), OUT."""

    KEEP, SOFT, REPLY, OUT = range(4)

    def __init__(self, source: str):
        self.parent: list[int] = [-1]
        self.step: list[str] = [""]
        self.path_id: list[int] = [0]
        self.tag: list[str] = ["#"]
        self.kind: list[int] = [self.KEEP]
        self.blocks: list[tuple[int, str, float]] = []
        stack: list[tuple[str, int]] = []  # tag, container before it
        here = link = linked = inside = 0  # inside: open article or main elements
        buffer: list[str] = []
        opened: Counter[str] = Counter()  # tags on the stack

        def flush():
            nonlocal linked
            if buffer:
                text = SPACE.sub(" ", entities.unescape("".join(buffer))).strip()
                if text:
                    self.blocks.append((here, text, min(1.0, linked / len(text))))
                buffer.clear()
            linked = 0

        def close(depth):
            nonlocal here, inside
            while len(stack) > depth:
                name, here = stack.pop()
                opened[name] -= 1
                inside -= name in ("article", "main")

        at = 0
        for m in TOKEN.finditer(source):
            if m.start() > at:
                raw = source[at : m.start()]
                buffer.append(raw)
                linked += len(raw) if link else 0
            at = m.end()
            name = m.group(3)
            if not name:
                continue
            name = name.lower()
            if name == "a":
                link = 0 if m.group(2) else 1
                continue
            if name == "br":
                buffer.append(" ")
                continue
            block = name in BLOCKS
            if m.group(2):
                if block:
                    flush()
                if opened[name]:
                    flush()
                    close(next(depth for depth in range(len(stack) - 1, -1, -1) if stack[depth][0] == name))
                continue
            if block:
                flush()
                if stack and stack[-1][0] == "p":
                    close(len(stack) - 1)
                if stack and name == stack[-1][0] and name in ("li", "td", "tr", "dt", "dd"):
                    close(len(stack) - 1)
            if name in VOID or (m.group(4).endswith("/") and name not in CONTAINERS):
                continue
            attrs = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(m.group(4))} if m.group(4) else {}
            kind = self.kind_of(name, attrs, block, inside) if attrs or name in OUT_TAGS or name in ("form", "header") else self.KEEP
            if name in CONTAINERS or kind:
                flush()
                stack.append((name, here))
                opened[name] += 1
                inside += name in ("article", "main")
                plain = ".".join([name, *sorted(set(WORD.findall(attrs.get("class", "").lower())))])
                self.parent.append(here)
                self.step.append(plain)
                self.path_id.append(below(self.path_id[here], plain))
                self.tag.append(name)
                self.kind.append(kind)
                here = len(self.parent) - 1
        if at < len(source):
            buffer.append(source[at:])
        flush()
        self.strip()

    def kind_of(self, name: str, attrs: dict[str, str], block: bool, inside: int) -> int:
        if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower():
            return self.OUT
        if name in ("html", "body", "article", "main"):
            return self.KEEP
        if name in OUT_TAGS or attrs.get("role", "").lower() in OUT_ROLES or (name == "header" and not inside):
            return self.OUT
        names = f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()
        if block and named(names, REPLY_WORDS):
            return self.REPLY
        soft = name == "form" or (block and (named(names, OUT_WORDS) or (not inside and named(names, HEADER_WORDS))))
        return self.SOFT if soft else self.KEEP

    def strip(self) -> None:
        """Takes out the blocks of what falls out."""
        n = len(self.parent)

        def without(out: list[bool]) -> list[tuple[int, str, float]]:
            for k in range(1, n):
                out[k] = out[k] or out[self.parent[k]]
            return [b for b in self.blocks if not out[b[0]]]

        self.blocks = without([k == self.OUT for k in self.kind])
        held = [0.0] * n
        for c, text, links in self.blocks:
            held[c] += len(text) * (1 - links)
        for k in range(n - 1, 0, -1):
            held[self.parent[k]] += held[k]
        most = {self.KEEP: -1.0, self.SOFT: MOST * held[0], self.REPLY: NEARLY_ALL * held[0], self.OUT: held[0]}
        self.blocks = without([held[i] <= most[k] for i, k in enumerate(self.kind)])

    def best(self) -> tuple[int, float]:
        score = [0.0] * len(self.parent)
        for c, text, links in self.blocks:
            score[c] += len(text) * (1 - links)
        for k in range(len(score) - 1, 0, -1):  # a container comes after the one that it is in
            score[self.parent[k]] += 0.7 * score[k]
        score = [s * (1.5 if t in ("article", "main") else 1.0) for s, t in zip(score, self.tag)]
        top = max(range(len(score)), key=lambda k: (score[k], -k))
        return top, score[top]

    def path_of(self, k: int) -> str:
        steps = []
        while k > 0:
            steps.append(self.step[k])
            k = self.parent[k]
        return "".join(f">{s}" for s in reversed(steps))

    def text(self, path: str | None) -> str:
        if not self.blocks:
            return ""
        wanted = path_hash(path) if path else None
        chosen = {k for k, p in enumerate(self.path_id) if p == wanted} if path else set()
        chosen = chosen or {self.best()[0]}
        under = [k in chosen for k in range(len(self.parent))]
        for k in range(1, len(self.parent)):
            under[k] = under[k] or under[self.parent[k]]
        found = "\n".join(t for c, t, _ in self.blocks if under[c])
        return found or self.text(None) if path else found


def host_paths(pages: DataFrame) -> DataFrame:
    """host, path: the winning container path of each host."""

    def run(batches):
        for batch, texts in slices(batches, "html"):
            hosts, paths = [], []
            for host, raw in zip(batch.column("host").to_pylist(), texts):
                page = Page(raw.decode("utf-8", "replace") if raw else "")
                top, score = page.best()
                if score > 0:
                    hosts.append(host)
                    paths.append(page.path_of(top))
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string())], ["host", "path"])

    votes = url_parts(pages.select("url", "html")).where("host <> ''").select("host", "html").mapInArrow(run, "host string, path string")
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("n"))
    return counted.groupBy("host").agg(F.min_by("path", F.struct(-F.col("n"), F.col("path"))).alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, and the path taken from the host, for every row."""

    def run(batches):
        for batch, texts in slices(batches, "html"):
            found = [Page(raw.decode("utf-8", "replace") if raw else "").text(path) for raw, path in zip(texts, batch.column("path").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64()), batch.column("path")],
                ["page_id", "url", "text", "n_chars", "host_path"],
            )

    d = url_parts(pages.select("page_id", "url", "html")).drop("path")
    paths = stored(host_paths(pages), "paths")
    size = paths.agg(F.count("*").alias("n"), F.sum(F.octet_length("host") + F.octet_length("path")).alias("bytes")).first()
    if size.n <= PATHS and (size.bytes or 0) <= PATH_BYTES:
        d = d.join(F.broadcast(paths), "host", "left")
    else:  # a host's pages are dealt over several tasks
        paths = paths.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        d = d.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(paths, ["host", "salt"], "left")
    return d.select("page_id", "url", "html", "path").mapInArrow(run, "page_id long, url string, text string, n_chars long, host_path string")
