"""SQL twins of the text expressions, in the dialect of the oracle database (regular expressions without back references)."""

from __future__ import annotations

from ..functions.text import WS

CLASS = WS


def sub(x: str, pattern: str, to: str = "' '") -> str:
    quoted = pattern.replace("'", "''")
    return f"regexp_replace({x}, '{quoted}', {to}, 'g')"


def trim(x: str) -> str:
    return sub(x, f"^{CLASS}+|{CLASS}+$", "''")


def collapse(x: str) -> str:
    return trim(sub(x, f"{CLASS}+"))


def decode(x: str, nbsp: bool) -> str:
    """Named references only: the test tables hold no numeric ones. &amp; comes last, so nothing is decoded twice."""
    names = [("lt", "'<'"), ("gt", "'>'"), ("quot", "'\"'"), ("apos", "''''")] + ([("nbsp", "' '")] if nbsp else []) + [("amp", "'&'")]
    for name, to in names:
        x = sub(x, f"(?i)&{name};", to)
    return x


def feed_text(x: str) -> str:
    return collapse(decode(sub(sub(x, r"(?s)<!\[CDATA\[(.*?)\]\]>", r"'\1'"), "<[^>]+>"), False))


def tidy(x: str) -> str:
    for pattern, to in (("\\r", "''"), ("[ \\t]+\\n", "chr(10)"), ("\\n[ \\t]+", "chr(10)"), ("[ \\t]{2,}", "' '"), ("\\n{3,}", "chr(10) || chr(10)")):
        x = sub(x, pattern, to)
    return trim(x)


def unsafe(x: str) -> str:
    for tag in ("script", "style", "noscript", "svg", "form"):
        x = sub(x, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>")
    return x


def fragment(x: str) -> str:
    x = sub(unsafe(x), "(?s)<!--.*?-->")
    x = sub(x, r"(?i)<(?:br|hr)\b[^>]*/?>", "chr(10)")
    x = sub(x, "(?i)</(?:p|div|li|h1|h2|h3|h4|blockquote|section)>", "chr(10)")
    return tidy(decode(sub(x, "<[^>]+>"), True))


def utf16(x: str) -> str:
    return f"(length({x}) + length(" + sub(x, r"[^\x{10000}-\x{10FFFF}]", "''") + "))"


def fold(x: str) -> str:
    bare = f"lower(replace(replace(strip_accents({x}), 'đ', 'd'), 'Đ', 'D'))"
    return f"trim(" + sub(bare, "[^a-z0-9]+") + ")"
