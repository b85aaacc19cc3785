"""Text expressions. All are native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f) -> Column:
    """f(value) with value worked out once, however often f uses it; else every use would repeat the whole expression, and
    nested ones would grow beyond measure."""
    return F.get(F.transform(F.array(value), lambda v: f(v)), F.lit(0))


SPACE = r"[\x20\x09-\x0D\x{A0}]+"

# Named references and what they stand for, &amp; last so that nothing is decoded twice.
NAMED = [
    ("&nbsp;", " "), ("&copy;", "©"), ("&reg;", "®"), ("&trade;", "™"), ("&middot;", "·"), ("&bull;", "•"), ("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"),
    ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&rsquo;", "’"), ("&lsquo;", "‘"), ("&rdquo;", "”"), ("&ldquo;", "“"), ("&laquo;", "«"), ("&raquo;", "»"), ("&euro;", "€"),
    ("&amp;", "&"),
]
# The references that titles are cleaned of, in the order in which they are replaced; quotes become plain.
TITLE_NAMED = [
    ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"),
    ("&rsquo;", "'"), ("&lsquo;", "'"), ("&rdquo;", '"'), ("&ldquo;", '"'),
]


def collapsed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends. A single space is left as it is."""
    return F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D\x{A0}]{2,}|[\x09-\x0D\x{A0}]", " "))


def _number(ref: Column) -> Column:
    digits = F.regexp_extract(ref, r"[0-9a-fA-F]+", 0)
    code = F.when(F.lower(F.substring(ref, 3, 1)) == "x", F.conv(digits, 16, 10)).otherwise(digits).cast("long")
    return F.when((code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF), F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise("")


def numeric_decoded(text: Column) -> Column:
    """Decimal and hexadecimal character references of a text; each distinct one is replaced once."""
    refs = F.array_distinct(F.regexp_extract_all(text, F.lit(r"&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"), F.lit(0)))
    return F.aggregate(refs, text, lambda acc, ref: F.replace(acc, ref, _number(ref)))


def decoded(text: Column) -> Column:
    """All numeric and the usual named references, as a browser would show them. Only those that are there are looked for."""
    chars = F.create_map(*[F.lit(x) for pair in NAMED for x in pair])

    def named(t: Column) -> Column:
        there = F.array_intersect(F.array(*[F.lit(name) for name, _ in NAMED]), F.regexp_extract_all(t, F.lit("&[a-z]+;"), F.lit(0)))
        return F.aggregate(there, t, lambda acc, name: F.replace(acc, name, F.element_at(chars, name)))

    return let(text, lambda t: F.when(F.contains(t, F.lit("&")), let(numeric_decoded(t), named)).otherwise(t))


def title_decoded(text: Column) -> Column:
    for name, char in TITLE_NAMED:
        text = F.replace(text, F.lit(name), F.lit(char))
    return numeric_decoded(text)


def blank_as_null(text: Column) -> Column:
    return F.when(F.trim(text) != "", text)


def first_of_each(values: Column, key=F.lower) -> Column:
    """An array without the values whose key came before."""
    keys = F.transform(values, key)
    return F.filter(values, lambda v, i: F.array_position(keys, key(v)) == i + 1)


def raw_attribute(tok: Column, name: str) -> Column:
    """An attribute's value as it stands, quoted or not; null where there is none."""
    found = F.regexp_extract_all(tok, F.lit(rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""), F.lit(1))
    return F.regexp_replace(F.get(found, F.lit(0)), r"""^["']|["']$""", "")


def attribute(tok: Column, name: str) -> Column:
    """An attribute's value, decoded; empty where there is none."""
    return F.coalesce(decoded(raw_attribute(tok, name)), F.lit(""))
