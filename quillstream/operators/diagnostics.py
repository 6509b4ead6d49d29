"""Structure reports over raw HTML: selector hints, bylines, container candidates (top k), JSON-LD keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as t
from . import html as h

# Which hints are of interest.
CONTENT = "(?i)(article|body|content|detail|entry|main|story|text)"
BYLINE = "(?i)(author|byline|writer|reporter|name)"
MOST_TOKENS, MOST_BYLINES, MOST_CANDIDATES = 60, 30, 20
STRUCTURE_TAG = r"(?i)<(article|main|section|div)\b[^>]*>"
ANY_TAG = r"(?i)<([a-z][\w-]*)\b[^>]*>"


def attribute(tag: Column, name: str) -> Column:
    return F.nullif(t.trim(F.regexp_extract(tag, rf"""(?i)\b{name}\s*=\s*(["'])(.*?)\1""", 2)), F.lit(""))


def selector_hint(tag_name: Column, tag: Column) -> Column:
    """tag#id.c1...c5, or null for a tag without id and class."""
    classes = F.slice(F.filter(F.split(attribute(tag, "class"), f"{t.WS}+"), lambda c: c != ""), 1, 5)
    dotted = F.coalesce(F.array_join(F.transform(classes, lambda c: F.concat(F.lit("."), c)), ""), F.lit(""))
    named = F.coalesce(F.concat(F.lit("#"), attribute(tag, "id")), F.lit(""))
    return F.when((named != "") | (dotted != ""), F.concat(F.lower(tag_name), named, dotted))


def hints(html: Column, tags: str, wanted: str, most: int) -> Column:
    """Sorted distinct hints of the tags that match `wanted`."""
    opened = F.regexp_extract_all(html, F.lit(tags), F.lit(0))
    found = F.transform(opened, lambda tag: selector_hint(F.regexp_extract(tag, tags, 1), tag))
    return F.slice(F.array_sort(F.array_distinct(F.filter(found, lambda x: F.coalesce(x.rlike(wanted), F.lit(False))))), 1, most)


def structural_tokens(html: Column, wanted: str = CONTENT) -> Column:
    return hints(html, STRUCTURE_TAG, wanted, MOST_TOKENS)


def byline_hints(html: Column, wanted: str = BYLINE) -> Column:
    return hints(html, ANY_TAG, wanted, MOST_BYLINES)


def container_candidates(pages: DataFrame, key: str, wanted: str = CONTENT, most: int = MOST_CANDIDATES) -> DataFrame:
    """pages(key, html) -> the `most` best containers of each page (key, rank, selector_hint, paragraph_count, text_length).

    A candidate reaches to the next closing tag of its name; the first of each hint that has two paragraphs and 250 characters counts."""
    split = F.split(F.col("html"), r"(?i)(?=<(?:article|main|section|div)\b)", -1)
    # the texts of a page stay in its task: what follows a tag is the parts from its own on, so no window needs them
    parts = pages.select(key, split.alias("parts")).select(key, F.posexplode_outer("parts").alias("at", "part"), "parts")
    opened = parts.withColumn("tag", F.regexp_extract("part", STRUCTURE_TAG, 0)).withColumn("name", F.lower(F.regexp_extract("part", STRUCTURE_TAG, 1)))
    opened = opened.withColumn("selector_hint", selector_hint(F.col("name"), F.col("tag")))
    opened = opened.where(F.coalesce(F.col("selector_hint").rlike(wanted), F.lit(False)))
    whole = F.array_join(F.slice("parts", F.col("at") + 1, F.size("parts")), "")
    rest = F.substring(whole, F.length("tag") + 1, F.length(whole))
    cut = opened.withColumn("rest", rest).withColumn("close", F.expr("instr(rest, concat('</', name, '>'))"))
    body = F.expr("substring(rest, 1, close - 1)")
    sized = cut.where("close > 0").withColumn("paragraph_count", F.size(F.regexp_extract_all(body, F.lit(r"(?i)<p\b[^>]*>"), F.lit(0)))).withColumn("text_length", t.diagnostic_length(body))
    good = sized.where((F.col("paragraph_count") >= 2) & (F.col("text_length") >= h.LEAST_TEXT)).select(key, "at", "selector_hint", "paragraph_count", "text_length")
    first = good.withColumn("__n", F.row_number().over(Window.partitionBy(key, "selector_hint").orderBy("at"))).where("__n = 1")
    score = F.col("paragraph_count") * 500 + F.col("text_length")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(score.desc(), "at")))
    return ranked.where(F.col("rank") <= most).select(key, "rank", "selector_hint", "paragraph_count", "text_length")


def json_ld_keys(html: Column) -> Column:
    """Sorted distinct keys of the JSON-LD records whose type names an article."""
    records = F.filter(h.json_ld_records(html), lambda s: F.coalesce(F.get_json_object(s, "$['@type']").rlike("(?i)article"), F.lit(False)))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(records, F.json_object_keys))))


def structure_report(pages: DataFrame, key: str) -> DataFrame:
    tops = container_candidates(pages, key).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("rank", "selector_hint", "paragraph_count", "text_length"))).alias("candidates"))
    heads = pages.select(key, structural_tokens(F.col("html")).alias("structural_tokens"), byline_hints(F.col("html")).alias("byline_hints"), json_ld_keys(F.col("html")).alias("json_ld_keys"))
    return heads.join(tops, key, "left")
