"""Text expressions with the semantics of web feeds and pages; JVM-side only.

White space is the set that web scripts use (it has the no-break space, U+FEFF and the Unicode spaces, but not U+0085), and lengths
count UTF-16 units, because the thresholds of the operators are stated in them.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
# The named references that feeds and pages may use.
XML_NAMES = {"amp": "&", "apos": "'", "gt": ">", "lt": "<", "quot": '"'}
HTML_NAMES = XML_NAMES | {"nbsp": " "}


def once(c: Column, f) -> Column:
    """f(c) with c evaluated once however often f names it."""
    return F.get(F.transform(F.array(c), lambda x: f(x)), F.lit(0))


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return trim(F.regexp_replace(c, f"{WS}+", " "))


def utf16_length(c: Column) -> Column:
    return (F.length(F.encode(c, "UTF-16BE")) / 2).cast("int")


def _character(code: Column) -> Column:
    """The character of a code point; null beyond Unicode."""
    sound = (code >= 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(sound, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))


def _reference(token: Column, names: dict[str, str]) -> Column:
    digits = F.substring(token, 2, 20)
    code = F.when(token.rlike("^#[xX]"), F.conv(F.substring(token, 3, 20), 16, 10)).when(token.rlike("^#[0-9]"), F.regexp_extract(digits, "^[0-9]+", 0))
    named = F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), F.lower(token))
    return F.coalesce(F.when(token.startswith("#"), _character(code.cast("bigint"))).otherwise(named), F.concat(F.lit("&"), token, F.lit(";")))


def decode_references(c: Column, names: dict[str, str]) -> Column:
    """Character references, each replaced once and in one pass, so nothing is decoded twice."""
    pattern = f"(?i)&(#x?[0-9a-f]+|{'|'.join(names)});"

    def decode(x: Column) -> Column:
        found = F.transform(F.regexp_extract_all(x, F.lit(pattern), F.lit(1)), lambda t: _reference(t, names))
        joined = F.array_join(F.zip_with(F.split(x, pattern, -1), found, lambda p, d: F.concat(p, F.coalesce(d, F.lit("")))), "")
        return F.when(F.contains(x, F.lit("&")), joined).otherwise(x)

    return once(c, decode)


def decode_xml(c: Column) -> Column:
    return decode_references(c, XML_NAMES)


def decode_html(c: Column) -> Column:
    return decode_references(c, HTML_NAMES)


def decode_repeatedly(c: Column) -> Column:
    """At most three passes of decoding; a text that has settled no longer changes."""
    return collapse(decode_html(decode_html(decode_html(c))))


def feed_text(c: Column) -> Column:
    """CDATA unwrapped, tags to spaces, then references decoded and white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(c, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"), "<[^>]+>", " ")
    return collapse(decode_xml(bare))


def tidy_lines(c: Column) -> Column:
    """White space normalised with line breaks kept; at most one blank line in a row."""
    steps = (("\r", ""), ("[ \t]+\n", "\n"), ("\n[ \t]+", "\n"), ("[ \t]{2,}", " "), ("\n{3,}", "\n\n"))
    for pattern, to in steps:
        c = F.regexp_replace(c, pattern, to)
    return trim(c)


def fragment_text(c: Column, unsafe: str = "script|style|noscript|svg|form", closers: str = "p|div|li|h1|h2|h3|h4|blockquote|section") -> Column:
    """Readable text of an HTML fragment."""
    c = F.regexp_replace(c, rf"(?is)<({unsafe})\b[^>]*>.*?</\1>", " ")
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", " ")
    c = F.regexp_replace(c, r"(?i)<(?:br|hr)\b[^>]*/?>", "\n")
    c = F.regexp_replace(c, rf"(?i)</(?:{closers})>", "\n")
    return tidy_lines(decode_html(F.regexp_replace(c, "<[^>]+>", " ")))


def publisher_fragment_text(c: Column) -> Column:
    return fragment_text(c, "script|style|noscript|svg|form|button", "p|div|li|blockquote")


def diagnostic_length(c: Column) -> Column:
    """Text length for structure reports; references are replaced one kind after the other here."""
    c = F.regexp_replace(c, r"(?is)<(script|style|noscript|svg|form)\b[^>]*>.*?</\1>", " ")
    c = F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), "(?i)&nbsp;", " ")
    return utf16_length(collapse(F.regexp_replace(c, "(?i)&amp;", "&")))


@lru_cache
def _fold_table() -> tuple[str, str]:
    """Characters of the basic plane whose base letter is an ASCII letter or digit, and those letters."""
    pairs = {"đ": "d", "Đ": "d"}
    for code in range(0x80, 0x10000):
        base = "".join(x for x in unicodedata.normalize("NFD", chr(code)) if not unicodedata.category(x).startswith("M"))
        if len(base) == 1 and base.isascii() and base.isalnum():
            pairs[chr(code)] = base.lower()
    return "".join(pairs), "".join(pairs.values())


def fold(c: Column) -> Column:
    """Lower-case letters and digits without marks, one space between words."""
    source, target = _fold_table()
    bare = F.regexp_replace(F.translate(c, source, target), r"\p{M}", "")
    return F.trim(F.regexp_replace(F.lower(bare), "[^a-z0-9]+", " "))
