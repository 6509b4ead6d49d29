"""Article extraction from raw HTML as column expressions: metadata, JSON-LD, main text, quality.

Errors are columns, never exceptions. Array functions are used for repeated elements, so a page stays one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import StringType

from ..functions import text as t

# Boilerplate openings of paragraphs, thresholds in UTF-16 units.
BASE_OPENINGS = ("xem thêm", "đọc thêm", "theo dõi", "chia sẻ", "đăng ký", "nguồn:")
PUBLISHER_OPENINGS = (*BASE_OPENINGS, "tin liên quan")
LEAST_PARAGRAPH = 30
LEAST_TEXT = 250
MOST_PARAGRAPHS = 30
PARAGRAPH = r"(?is)<p\b[^>]*>(.*?)</p>"
ARTICLE_TYPES = ("article", "newsarticle", "reportagenewsarticle")
# Hosts and text containers of the known publishers.
PUBLISHER_HOSTS = {"VnExpress": ("vnexpress.net", "www.vnexpress.net"), "Tuổi Trẻ": ("tuoitre.vn", "www.tuoitre.vn"), "Thanh Niên": ("thanhnien.vn", "www.thanhnien.vn")}
CONTAINERS = {"VnExpress": ("article", ("fck_detail",)), "Tuổi Trẻ": ("div", ("detail-content", "afcbc-body"))}
# Fixed value: class names of blocks inside a container that are no text.
NOISE = "VCSortableInPreviewMode|detail__related|detail__qc|box-related|box-tinlienquan|content-readmore|readmore-body-box|ads|advertisement"


def paragraphs(fragment: Column, openings: tuple[str, ...] = BASE_OPENINGS, publisher: bool = False) -> Column:
    """Texts of the <p> elements that are long enough and do not open like boilerplate."""
    to_text = t.publisher_fragment_text if publisher else t.fragment_text
    texts = F.transform(F.regexp_extract_all(fragment, F.lit(PARAGRAPH), F.lit(1)), lambda p: to_text(p))
    start = f"(?iu)^({'|'.join(openings)})"
    return F.filter(texts, lambda p: (t.utf16_length(p) >= LEAST_PARAGRAPH) & ~p.rlike(start))


def title(html: Column) -> Column:
    return F.nullif(t.fragment_text(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1)), F.lit(""))


def attributes(tag: Column) -> Column:
    """Map of the quoted attributes of a tag: names in lower case, the last of equal names wins."""
    pattern = r"""(?s)([:\w-]+)\s*=\s*(["'])(.*?)\2"""
    names = F.transform(F.regexp_extract_all(tag, F.lit(pattern), F.lit(1)), lambda n: F.lower(n))
    values = F.transform(F.regexp_extract_all(tag, F.lit(pattern), F.lit(3)), lambda v: t.decode_html(t.trim(v)))
    pairs = F.zip_with(names, values, lambda k, v: F.struct(k.alias("k"), v.alias("v")))
    last = lambda p: F.filter(p, lambda x, i: ~F.exists(F.slice(p, i + 2, F.size(p)), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(t.once(pairs, last))


def meta_tags(html: Column) -> Column:
    return F.transform(F.regexp_extract_all(html, F.lit(r"(?i)<meta\b[^>]*>"), F.lit(0)), lambda tag: attributes(tag))


def meta_content(tags: Column, names: tuple[str, ...]) -> Column:
    """Content of the first of meta_tags(), in page order, with a wanted property, name or itemprop."""
    key = lambda a: F.lower(F.coalesce(a["property"], a["name"], a["itemprop"]))
    hits = F.filter(tags, lambda a: key(a).isin(*[n.lower() for n in names]) & (F.coalesce(a["content"], F.lit("")) != ""))
    return t.tidy_lines(F.get(hits, F.lit(0))["content"])


def canonical_link(html: Column) -> Column:
    tags = F.transform(F.regexp_extract_all(html, F.lit(r"(?i)<link\b[^>]*>"), F.lit(0)), lambda tag: attributes(tag))
    hits = F.filter(tags, lambda a: F.array_contains(F.split(F.lower(a["rel"]), f"{t.WS}+"), "canonical") & (F.coalesce(a["href"], F.lit("")) != ""))
    return F.get(hits, F.lit(0))["href"]


def json_ld_records(html: Column) -> Column:
    """Objects of all JSON-LD scripts as JSON strings: list members and, after their parent, members of @graph, two levels deep."""
    pattern = r"""(?is)<script\b[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""
    bodies = F.transform(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)), lambda s: t.trim(F.regexp_replace(s, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1")))
    sound = F.filter(bodies, lambda s: F.try_parse_json(s).isNotNull())

    def members(s: Column) -> Column:
        return F.when(s.startswith("["), F.from_json(s, "array<string>")).otherwise(F.array(s))

    def with_graph(s: Column) -> Column:
        graph = F.get_json_object(s, "$['@graph']")
        return F.concat(F.array(s), F.when(graph.isNull(), F.array().cast("array<string>")).otherwise(members(graph)))

    once = F.flatten(F.transform(F.flatten(F.transform(sound, members)), with_graph))
    return F.filter(once, lambda s: s.startswith("{"))


def json_ld_article(html: Column) -> Column:
    """Struct of the first article record with a headline or body; null if there is none."""
    def types(s: Column) -> Column:
        kind = F.get_json_object(s, "$['@type']")
        return F.when(kind.startswith("["), F.from_json(kind, "array<string>")).otherwise(F.array(kind))

    def first(s: Column, path: str) -> Column:
        value = F.get_json_object(s, path)
        return F.nullif(t.trim(F.when(value.startswith("["), F.get(F.from_json(value, "array<string>"), F.lit(0))).otherwise(value)), F.lit(""))

    def author(s: Column) -> Column:
        value = F.get_json_object(s, "$.author")
        one = lambda v: F.when(v.startswith("{"), F.get_json_object(v, "$.name")).otherwise(v)
        many = F.array_join(F.filter(F.transform(F.from_json(value, "array<string>"), one), lambda v: v.isNotNull() & (v != "")), ", ")
        return F.nullif(F.when(value.startswith("["), many).otherwise(one(value)), F.lit(""))

    def main_entity(s: Column) -> Column:
        value = F.get_json_object(s, "$.mainEntityOfPage")
        return F.when(value.startswith("{"), F.coalesce(F.get_json_object(value, "$['@id']"), F.get_json_object(value, "$.url"))).otherwise(value)

    def record(s: Column) -> Column:
        return F.struct(
            first(s, "$.headline").alias("headline"), first(s, "$.articleBody").alias("body"), author(s).alias("author"), first(s, "$.datePublished").alias("published_at"),
            first(s, "$.dateModified").alias("updated_at"), F.coalesce(main_entity(s), first(s, "$.url")).alias("url"),
        )

    articles = F.filter(json_ld_records(html), lambda s: F.exists(types(s), lambda k: F.lower(k).isin(*ARTICLE_TYPES)))
    return F.get(F.filter(F.transform(articles, record), lambda r: r["headline"].isNotNull() | r["body"].isNotNull()), F.lit(0))


def with_main_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds text, paragraph_count and extraction_strategy: JSON-LD body, else the first <article>'s paragraphs, else the page's.

    Each candidate is a column of its own, so that no regular expression runs twice for a page."""
    found = pages.withColumn("__ld", json_ld_article(F.col(html)))
    found = found.withColumn("__body", t.fragment_text(F.col("__ld.body")))
    found = found.withColumn("__in", paragraphs(F.regexp_extract(html, r"(?is)<article\b[^>]*>(.*?)</article>", 1)))
    found = found.withColumn("__inside", F.array_join("__in", "\n\n"))
    in_article = t.utf16_length(F.col("__inside")) >= LEAST_TEXT
    from_ld = F.coalesce(t.utf16_length(F.col("__body")) >= LEAST_TEXT, F.lit(False))
    found = found.withColumn("__all", F.when(from_ld | in_article, F.array().cast("array<string>")).otherwise(paragraphs(F.col(html))))
    found = found.withColumn("__whole", F.array_join("__all", "\n\n"))
    in_page = t.utf16_length(F.col("__whole")) >= LEAST_TEXT
    pick = lambda a, b, c: F.when(from_ld, a).when(in_article, b).when(in_page, c)
    ld_count = F.size(F.filter(F.split("__body", "\n+"), lambda p: t.trim(p) != ""))
    out = found.withColumn("text", pick(F.col("__body"), F.col("__inside"), F.col("__whole")))
    out = out.withColumn("paragraph_count", pick(ld_count, F.size("__in"), F.size("__all")))
    out = out.withColumn("extraction_strategy", pick(F.lit("json-ld"), F.lit("article-paragraphs"), F.lit("page-paragraphs")))
    return out.drop("__body", "__in", "__inside", "__all", "__whole")


def warnings(strategy: Column, count: Column, publisher_author: Column) -> Column:
    """Quality warnings in their fixed order."""
    return F.array_compact(
        F.array(
            F.when(strategy == "page-paragraphs", F.lit("broad-page-paragraph-fallback")), F.when(count > MOST_PARAGRAPHS, F.lit("high-paragraph-count")),
            F.when(publisher_author, F.lit("publisher-reported-as-author")),
        )
    )


def decision(ok: Column, found: Column) -> Column:
    fallback = F.arrays_overlap(found, F.array(F.lit("broad-page-paragraph-fallback"), F.lit("high-paragraph-count")))
    return F.when(~ok, "failed").when(F.coalesce(fallback, F.lit(False)), "fallback-required").otherwise("ready")


def is_publisher_author(publisher: Column, author: Column) -> Column:
    """Equal but for case, as the Vietnamese collation sees it."""
    folded = lambda c: F.collate(F.regexp_replace(c, f"{t.WS}+", " "), "vi_CI_AI")
    return F.coalesce(folded(t.trim(author)) == folded(t.trim(publisher)), F.lit(False))


def extract_articles(pages: DataFrame) -> DataFrame:
    """pages(publisher, url, html, ...) -> the normalised article of each page, its warnings, decision and error."""
    found = with_main_text(pages).withColumn("__meta", meta_tags(F.col("html")))
    name = F.coalesce(F.col("__ld.headline"), meta_content(F.col("__meta"), ("og:title", "twitter:title")), title(F.col("html")))
    found = found.withColumn("title", t.decode_repeatedly(name)).withColumn("author", t.decode_repeatedly(F.coalesce(F.col("__ld.author"), meta_content(F.col("__meta"), ("author", "article:author")))))
    found = found.withColumn("published_at", F.coalesce(F.col("__ld.published_at"), meta_content(F.col("__meta"), ("article:published_time", "datepublished"))))
    found = found.withColumn("canonical_candidate", F.coalesce(F.col("__ld.url"), canonical_link(F.col("html")), meta_content(F.col("__meta"), ("og:url",))))
    boxed = publisher_content(F.col("publisher"), F.col("html"))
    found = found.withColumn("__box", boxed)
    found = found.withColumn("text", F.coalesce("__box.text", "text")).withColumn("paragraph_count", F.coalesce("__box.paragraph_count", "paragraph_count"))
    found = found.withColumn("extraction_strategy", F.when(F.col("__box.text").isNotNull(), F.lit("publisher-container")).otherwise(F.col("extraction_strategy")))
    by_publisher = is_publisher_author(F.col("publisher"), F.col("author"))
    ok = F.col("title").isNotNull() & (F.col("title") != "") & F.col("text").isNotNull()
    found = found.withColumn("ok", ok).withColumn("quality_warnings", F.when(ok, warnings(F.col("extraction_strategy"), F.col("paragraph_count"), by_publisher)).otherwise(F.array().cast("array<string>")))
    found = found.withColumn("author", F.when(~by_publisher, F.nullif("author", F.lit(""))))
    return found.withColumns({
        "author_status": F.when(F.col("author").isNull(), "unknown").otherwise("reported"),
        "quality_decision": decision(F.col("ok"), F.col("quality_warnings")),
        "content_hash": F.sha2("text", 256),
        "text_length": t.utf16_length(F.col("text")),
        "error": F.when(F.col("title").isNull() | (F.col("title") == ""), "Article title not found").when(F.col("text").isNull(), "Article text too short"),
    }).drop("__ld", "__box", "__meta")


def balanced(source: str, tag: str, classes: tuple[str, ...]) -> str | None:
    """Inner HTML of the first <tag> that has all classes and is closed at its own depth."""
    import re

    marks = [(m.start(), m.end(), m.group(0)) for m in re.finditer(rf"(?i)</?{tag}\b[^>]*>", source)]
    for k, (_, begin, opening) in enumerate(marks):
        if opening.startswith("</") or opening.endswith("/>"):
            continue
        own = re.search(r"""(?i)\bclass\s*=\s*(["'])([\s\S]*?)\1""", opening)
        if not own or not set(classes) <= set(own.group(2).split()):
            continue
        depth = 1
        for start, _, mark in marks[k + 1 :]:
            depth += -1 if mark.startswith("</") else 0 if mark.endswith("/>") else 1
            if not depth:
                return source[begin:start]
    return None


def without_noise(fragment: str) -> str:
    """Blanks the inside of <div>s whose opening tag names noise; the element found by their first class goes."""
    import re

    out = fragment
    for m in re.finditer(r"(?i)<div\b[^>]*>", fragment):
        own = re.search(r"""(?i)\bclass\s*=\s*(["'])([\s\S]*?)\1""", m.group(0))
        names = own.group(2).split() if own else []
        if names and re.search(f"(?i)(?:{NOISE})", m.group(0)):
            inner = balanced(out, "div", (names[0],))
            if inner:
                out = out.replace(inner, " ", 1)
    return out


def container_html(publisher: Column, html: Column) -> Column:
    """The publisher's text container without noise blocks, or null. Nesting needs a stack, hence an Arrow function."""
    rules = dict(CONTAINERS)

    def cut(names: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for who, pages in names:
            out = []
            for name, page in zip(who, pages):
                rule = rules.get(name)
                found = balanced(page, *rule) if rule and page else None
                out.append(without_noise(found) if found else None)
            yield pd.Series(out, dtype=object)

    cut.__annotations__ = {"names": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(cut, StringType())(publisher, html)


def publisher_content(publisher: Column, html: Column) -> Column:
    """struct(text, paragraph_count) of the publisher's container if it has two paragraphs and 250 characters, else null."""
    found = F.transform(F.array(container_html(publisher, html)), lambda h: paragraphs(h, PUBLISHER_OPENINGS, True))[0]
    text = F.array_join(found, "\n\n")
    enough = (F.size(found) >= 2) & (t.utf16_length(text) >= LEAST_TEXT)
    return F.when(enough, F.struct(text.alias("text"), F.size(found).alias("paragraph_count")))


def check_url(url: Column, hosts: Column) -> Column:
    """Why a URL may not be fetched; null if it may: parsable, https, and its host is one of the publisher's."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    allowed = F.coalesce(F.array_contains(hosts, host), F.lit(False))
    return (
        F.when(host.isNull(), F.concat(F.lit("Invalid article URL: "), F.coalesce(url, F.lit(""))))
        .when(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))) != "https", "Article URL must use HTTPS")
        .when(~allowed, F.concat(F.lit("Host "), host, F.lit(" is not allowed")))
    )


@F.pandas_udf(StringType())
def resolve_url(base: pd.Series, link: pd.Series) -> pd.Series:
    """link against base, normalised: host in lower case, no default port, spaces encoded, a path at least."""

    def one(b: str | None, x: str | None) -> str | None:
        if not x:
            return None
        try:
            parts = urlsplit(urljoin(b or "", x.strip()))
            port = parts.port
        except ValueError:
            return None
        if not parts.scheme or not parts.hostname:
            return None
        default = {"http": 80, "https": 443}.get(parts.scheme)
        host = parts.hostname.lower() + (f":{port}" if port and port != default else "")
        return urlunsplit((parts.scheme, host, (parts.path or "/").replace(" ", "%20"), parts.query.replace(" ", "%20"), parts.fragment))

    return pd.Series([one(b, x) for b, x in zip(base, link)], dtype=object)


def canonical_url(requested: Column, candidate: Column, hosts: Column) -> Column:
    """The candidate resolved against the requested URL if it may be fetched, else the requested URL."""
    resolved = resolve_url(requested, candidate)
    return F.when(resolved.isNotNull() & check_url(resolved, hosts).isNull(), resolved).otherwise(requested)


def inspect_fetched(fetched: DataFrame, targets: DataFrame, hosts: dict[str, tuple[str, ...]] = PUBLISHER_HOSTS) -> DataFrame:
    """fetched(id, status, content_type, body, error, duration_ms), targets(id, publisher, category, url) -> one inspection row per target, without texts.

    A page that was not fetched, is no HTML or gives no article is a row with ok false and its error."""
    strange = F.col("content_type").isNotNull() & ~F.col("content_type").rlike("(?i)html")
    early = F.coalesce("error", F.when(strange, F.concat(F.lit("Unexpected content type: "), "content_type")))
    rows = targets.join(fetched.withColumn("__early", early).drop("url", "error"), "id").withColumn("html", F.when(F.col("__early").isNull(), F.col("body")))
    found = extract_articles(rows.drop("body")).withColumn("error", F.coalesce("__early", "error")).withColumn("ok", F.col("error").isNull())
    allowed = F.element_at(F.create_map(*(x for k, v in hosts.items() for x in (F.lit(k), F.array(*map(F.lit, v))))), F.col("publisher"))
    if_ok = lambda c: F.when(F.col("ok"), F.col(c)).alias(c)
    metrics = ("title", "author", "published_at", "text_length", "paragraph_count", "extraction_strategy", "content_hash")
    return found.select(
        F.col("id").alias("target_id"), "publisher", "category", F.col("url").alias("requested_url"), "ok", "duration_ms", F.col("status").alias("http_status"), *(if_ok(c) for c in metrics),
        F.when(F.col("ok"), canonical_url(F.col("url"), F.col("canonical_candidate"), allowed)).alias("canonical_url"), F.when(F.col("ok"), F.col("author_status")).otherwise("unknown").alias("author_status"),
        decision(F.col("ok"), F.col("quality_warnings")).alias("quality_decision"), "quality_warnings", "error",
    )
