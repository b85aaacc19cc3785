"""A page's elements, by one walk over its tags. It runs in tasks on one page at a time; what an element is taken for is told by the
native expressions of operators/structure.py."""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import accumulate

from pagemill.operators.pages import BLOCKS, TOKEN, VOID

SPACE = r" \t\n\x0b\f\r"  # what \s is to native expressions
TOKENS = re.compile(TOKEN.replace(r"\s", f"[{SPACE}]"))
TAG = re.compile(r"</?([A-Za-z][A-Za-z0-9-]*)")
ATTRIBUTE = re.compile(rf"""[{SPACE}"']([A-Za-z_:@][-A-Za-z0-9_:.@]*)(?:[{SPACE}]*=[{SPACE}]*("[^"]*"|'[^']*'|[^{SPACE}"'>]+))?""")
SPACED = re.compile(f"[{SPACE}]")
WHITE = re.compile("[\\x20\\x09-\\x0D\\xA0]+")
BREAK = "\x01"  # stands in a page's text where a block element begins or ends
SHAPES = "path use rect circle".split()  # without an end, if they are written so
SHORT = 256  # tags up to this length are remembered
END = 1 << 30  # beyond every page


def tag_of(tok: str) -> tuple[str, int | None, str]:
    """A tag's name, its step (1 opens, 0 has no end, -1 closes, None says nothing) and what it leaves in the text."""
    m = TAG.match(tok)
    tag = m[1].lower() if m else ""
    if tok.startswith("</"):
        step = -1
    elif tag in ("", "script", "style"):
        return tag, None, ""
    else:
        step = 0 if tag in VOID or (tag in SHAPES and tok.endswith("/>")) else 1
    return tag, step, BREAK if tag in BLOCKS else ""


def attributes_of(tok: str) -> tuple[str, list[str], str, list[str], list[str]]:
    """id, classes, role, names and values of an opening tag."""
    found = ATTRIBUTE.findall(tok) if SPACED.search(tok) else []
    names, values = [name.lower() for name, _ in found], [value[1:-1] if value[:1] in ('"', "'") else value for _, value in found]
    word = lambda name: values[names.index(name)] if name in names else ""
    return word("id"), WHITE.sub(" ", word("class")).strip(" ").split(" "), word("role").lower(), names, values


short_tag_of = lru_cache(4096)(tag_of)


def openings_of(toks: list[str]) -> tuple[list[tuple], list[str]]:
    """(pos, tag, pos of its closing token or None, pos of the next opening of its tag, whether it has no end) of every opening, in page
    order, and what each token leaves in the text. From a page's end on, an opening takes the last closing token of its tag that is left."""
    ends: dict[str, list[int]] = {}
    after: dict[str, int] = {}
    out, pieces = [], list(toks)
    for pos in range(len(toks) - 1, -1, -1):
        tok = toks[pos]
        if tok[0] != "<":
            continue
        tag, step, pieces[pos] = short_tag_of(tok) if len(tok) <= SHORT else tag_of(tok)
        if step == -1:
            ends.setdefault(tag, []).append(pos)
        elif step is not None:
            pair = pos if step == 0 else ends[tag].pop() if ends.get(tag) else None
            out.append((pos, tag, pair, after.get(tag, END + 1), step == 0))
            after[tag] = pos
    out.reverse()
    return out, pieces


def value_of(e: tuple, name: str) -> str | None:
    """An attribute of an element as it stands in the page."""
    return e[11][e[10].index(name)] if name in e[10] else None


class Walk:
    """Called with a page's html: text and elements as page_structure() has them. An element that isn't closed ends before the next one of
    its tag, or with the innermost closed one around it, whichever is first, else with the page. Elements that open at the places
    `removed` are left out with all that they hold; of the others `tags` are kept. `kinds` tells of an element's tag, id, classes, role,
    names and values what it may be; then only elements that may be something are kept, and it stands last in them."""

    def __init__(self, tags=None, kinds=None):
        self.tags, self.kinds, self.known = tags, kinds, None

    def words_of(self, tag: str, tok: str) -> tuple:
        """What is known of a tag without the page that it stands in."""
        words = attributes_of(tok)
        return (tag, *words, self.kinds(tag, *words)) if self.kinds else (tag, *words)

    def __call__(self, html: str, removed: list[int] | None = None) -> tuple[bytes, list[tuple]]:
        self.known = self.known or lru_cache(4096)(self.words_of)
        toks = TOKENS.findall(html)
        openings, pieces = openings_of(toks)
        last, skip, gone, n, crossed = len(toks) - 1, set(removed or ()), -1, 0, False
        stack, found, cuts = [[2 * END, None, None, False, 0]], [], []  # what reaches to the next opening: close, index, pos, is closed, children
        for pos, tag, pair, following, void in openings:
            if crossed:
                stack = [h for h in stack if h[0] >= pos]
            while stack[-1][0] < pos:
                stack.pop()
            close = pair
            if close is None:
                around = next((h[0] for h in reversed(stack) if h[3]), END + 1)
                close = max(min(following - 1, around - 1, END), pos)
            out = pos in skip
            if out or pos <= gone:
                if out and close > gone:
                    cuts.append((max(pos, gone + 1), min(close, last)))
                    gone = close
                continue
            up = stack[-1]
            up[4] += 1
            if self.tags is None or tag in self.tags:
                words = self.known(tag, toks[pos]) if len(toks[pos]) <= SHORT else self.words_of(tag, toks[pos])
                if not self.kinds or words[-1]:
                    found.append((pos, min(close, last), up[1], up[2], len(stack), up[4], words))
            if not void:
                crossed = crossed or close > up[0]
                stack.append([close, n, pos, pair is not None, 0])
            n += 1
        for first, end in cuts:
            pieces[first : end + 1] = [""] * (end + 1 - first)
        raw = [piece.encode() for piece in pieces]
        upto = list(accumulate(map(len, raw)))
        return b"".join(raw), [(*e[:6], *e[6][:6], upto[e[0]], upto[e[1]] - upto[e[0]], *e[6][6:]) for e in found]


class Hits:
    """Called with a page's html, or with the text and elements of page_structure(): what collect_hits() asks for. `picks` are (kind,
    field, rank, take), `scopes` the kinds that are scopes, by their names; kinds are numbers of the list `els`."""

    def __init__(self, els: list, picks: list[tuple], scopes: list[tuple]):
        self.els, self.scopes = els, {kind for kind, _ in scopes}
        self.asks: list[list[tuple]] = [[] for _ in els]  # field, rank, take and a scope's name
        for kind, field, rank, take in picks:
            self.asks[kind].append((field, rank, take, None))
        for rank, (kind, name) in enumerate(scopes):
            self.asks[kind].append(("scope", rank, "scope", name))
        number = {el: i for i, el in enumerate(els)}
        self.inside, self.under = [number.get(el.inside) for el in els], [number.get(el.under) for el in els]
        self.places = {i for i in [*self.inside, *self.under] if i is not None}
        self.walk = Walk(kinds=self.kinds)

    def kinds(self, tag: str, id: str, classes: list[str], role: str, names: list[str], values: list[str]) -> list[int]:
        """What an element may be, but for where it lies."""
        return [i for i, el in enumerate(self.els) if (names or el.is_bare()) and el.fits(tag, id, classes, role, names, values)]

    def of_page(self, html: str) -> list[tuple]:
        return self.of_elements(*self.walk(html))

    def of_structure(self, text: bytes, elements: list) -> list[tuple]:
        return self.of_elements(bytes(text), [(*e, self.kinds(*e[6:12])) for e in elements])

    def of_elements(self, text: bytes, elements: list[tuple]) -> list[tuple]:
        """(scope, pos, close, parent, field, rank, take, raw) of each hit."""
        holders: dict[int, list[tuple[int, int]]] = {i: [] for i in [-1, *self.places]}

        def innermost(kind: int, pos: int) -> int | None:
            held = holders[kind]
            while held and held[-1][1] < pos:
                held.pop()
            return held[-1][0] if held else None

        hits = []
        for e in elements:
            pos, close, parent, is_one = e[0], e[1], e[3], []
            for kind in e[14]:
                inside, under = self.inside[kind], self.under[kind]
                if (inside is None or innermost(inside, pos) is not None) and (under is None or (parent is not None and innermost(under, pos) == parent)):
                    is_one.append(kind)
            scope, shown = innermost(-1, pos) if is_one else None, None
            for kind in is_one:
                for field, rank, take, raw in self.asks[kind]:
                    if take in ("text", "raw"):
                        raw = shown = text[e[12] : e[12] + e[13]].decode() if shown is None else shown
                    elif take not in ("none", "scope"):
                        raw = value_of(e, take)
                    hits.append((-1 if scope is None else scope, pos, close, parent, field, rank, take, raw))
                if kind in self.scopes and (not holders[-1] or holders[-1][-1][0] != pos):
                    holders[-1].append((pos, close))
            for kind in is_one:
                if kind in self.places:
                    holders[kind].append((pos, close))
        return hits
