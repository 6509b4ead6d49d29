"""Queries whose pages, summaries and manifests are written around the texts of the test tables, with a defect that the row's number picks.

The SQL twins state what each defect must lead to."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut, spread
from ..operators import citations, feeds, html, manifest, routing
from . import sqltext as s
from .catalogue import query, table

_LINE = "split_part(text, chr(10), 1)"


def _pick(number: Column, of: int, values: dict[int, Column], other: Column) -> Column:
    out = other
    for k, value in values.items():
        out = F.when(number % of == k, value).otherwise(out)
    return out


def _quoted(c: Column) -> Column:
    """The text as a JSON string, quotes included."""
    whole = F.to_json(F.struct(c.alias("t")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def _changed(base: str, number: Column, of: int, edits: dict[int, tuple[str, str]], fill: dict[str, Column]) -> Column:
    """base with the row's edit made, then with the marks replaced by what they stand for."""
    for k, (old, _) in edits.items():
        if old not in base:
            raise ValueError(f"edit {k} changes nothing")
    body = _pick(number, of, {k: F.lit(base.replace(old, new)) for k, (old, new) in edits.items()}, F.lit(base))
    return reduce(lambda c, x: F.replace(c, F.lit(x[0]), x[1]), fill.items(), body)


_SENTENCE = {
    "id": "1", "kind": "one-line", "text": "@T@", "claimIds": ["c1"], "citations": [{"articleId": "a1", "articleVersionId": "v1", "claimIds": ["c1"]}],
    "assertion": {
        "propositionId": "p1", "epistemicStatus": "reported", "polarity": "affirmed", "entities": ["@L@"],
        "numbers": [{"key": "n", "value": "90", "unit": "x", "scale": "unit"}], "times": [{"key": "t", "value": "2024-02-28", "role": "event"}],
    },
}
_SUMMARY = {"schemaVersion": citations.SUMMARY_SCHEMA, "snapshotId": "@L@", "snapshotVersion": 1, "sentences": [_SENTENCE]}
_BASE = json.dumps(_SUMMARY, separators=(",", ":"))
_ASSERTION = json.dumps(_SENTENCE["assertion"], separators=(",", ":"))
_SHAPE_EDITS = {
    1: (_BASE, "{"), 2: ('"snapshotVersion":1', '"snapshotVersion":1,"more":1'), 3: ('"snapshotId":"@L@",', ""), 4: ('"one-line"', '"x"'), 5: ('"@T@"', '"  "'),
    6: ('"snapshotVersion":1', '"snapshotVersion":0'), 7: (json.dumps([_SENTENCE], separators=(",", ":")), "[]"), 8: ('"90"', '"09"'), 9: ('"event"', '"x"'),
    10: ('"v1","claimIds":["c1"]', '"v1","claimIds":[5,""]'), 11: (_ASSERTION, '"x"'), 12: ('"2024-02-28"', '"28.2.2024"'), 13: ('"numbers":[', '"numbers":["x",'),
}
_S = "$.sentences[0]"


@query(f"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS summary_id, CAST(doc_id % 14 AS INT) AS k, {_LINE} AS line FROM documents),
x(k, code, path) AS (VALUES (1, 'invalid-type', '$'), (2, 'unknown-field', '$.more'), (3, 'missing-field', '$.snapshotId'), (3, 'invalid-type', '$.snapshotId'), (4, 'invalid-enum', '{_S}.kind'), (6, 'invalid-format', '$.snapshotVersion'),
(7, 'empty-value', '$.sentences'), (8, 'invalid-format', '{_S}.assertion.numbers[0].value'), (9, 'invalid-enum', '{_S}.assertion.times[0].role'), (10, 'invalid-type', '{_S}.citations[0].claimIds[0]'), (10, 'empty-value', '{_S}.citations[0].claimIds[1]'),
(11, 'invalid-type', '{_S}.assertion'), (12, 'invalid-format', '{_S}.assertion.times[0].value'), (13, 'invalid-type', '{_S}.assertion.numbers[0]'))
SELECT summary_id, code, path FROM d JOIN x ON d.k = x.k UNION ALL SELECT summary_id, 'empty-value', '{_S}.text' FROM d WHERE k NOT IN (1, 7) AND (k = 5 OR trim(line) = '')""")
def summary_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as summaries of one sentence, their first line; thirteen of fourteen have a defect of form."""
    docs = table(spark, sf_dir, "documents")
    line = F.substring_index("text", "\n", 1)
    body = _changed(_BASE, F.col("doc_id"), 14, _SHAPE_EDITS, {"@L@": F.lit("s"), '"@T@"': _quoted(line)})
    return citations.shape_issues(cut(docs.select(F.col("doc_id").cast("string").alias("summary_id"), body.alias("body"))))


_TWO = {k: json.dumps([_SENTENCE, _SENTENCE | more], separators=(",", ":")) for k, more in ((3, {"id": "2"}), (4, {"kind": "bullet"}))}
_ONE = json.dumps([_SENTENCE], separators=(",", ":"))
_VALID_EDITS = {1: ('"snapshotId":"@L@"', '"snapshotId":"zz"'), 2: ('"snapshotVersion":1', '"snapshotVersion":2'), 3: (_ONE, _TWO[3]), 4: (_ONE, _TWO[4]), 5: ('"epistemicStatus":"reported"', '"epistemicStatus":"confirmed"')}
_NONE = "CAST(NULL AS VARCHAR)"


@query(f"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS summary_id, doc_id % 6 AS k, lang FROM documents), ok AS (SELECT * FROM d WHERE lang <> 'fr'),
sen AS (SELECT summary_id, lang, k, unnest(CASE WHEN k IN (3, 4) THEN [0, 1] ELSE [0] END) AS pos FROM ok), ids AS (SELECT *, CASE WHEN k = 3 AND pos = 1 THEN '2' ELSE '1' END AS sid FROM sen),
i AS (SELECT summary_id, 'invalid-snapshot' AS code, '$snapshot' AS path, {_NONE} AS sentence_id FROM d WHERE lang = 'fr' UNION ALL SELECT summary_id, 'snapshot-id-mismatch', '$.snapshotId', NULL FROM ok WHERE k = 1
UNION ALL SELECT summary_id, 'snapshot-version-mismatch', '$.snapshotVersion', NULL FROM ok WHERE k = 2 UNION ALL SELECT summary_id, 'multiple-one-line-sentences', '$.sentences', NULL FROM ok WHERE k = 3
UNION ALL SELECT summary_id, 'duplicate-sentence-id', '$.sentences[1].id', '1' FROM ok WHERE k = 4 UNION ALL SELECT summary_id, 'epistemic-upgrade', '{_S}.assertion.epistemicStatus', '1' FROM ok WHERE k = 5
UNION ALL SELECT summary_id, 'unsupported-entity', '$.sentences[' || pos || '].assertion.entities[0]', sid FROM ids WHERE lang = 'de'
UNION ALL SELECT summary_id, 'unsupported-number', '$.sentences[' || pos || '].assertion.numbers[0]', sid FROM ids WHERE lang = 'es' UNION ALL SELECT summary_id, 'unsupported-time', '$.sentences[' || pos || '].assertion.times[0]', sid FROM ids WHERE lang = 'es')
SELECT *, {_NONE} AS article_id, {_NONE} AS article_version_id, {_NONE} AS claim_id FROM i""")
def summary_validate(spark, sf_dir):
    """Documents as summaries that are held against the snapshot of their language. French has a snapshot of another schema, the German claim another entity, the Spanish one a currency and another role."""
    docs = table(spark, sf_dir, "documents")
    line = F.concat(F.lit("x "), F.substring_index("text", "\n", 1))
    body = _changed(_BASE, F.col("doc_id"), 6, _VALID_EDITS, {"@L@": F.col("lang"), '"@T@"': _quoted(line)})
    summaries = cut(docs.select(F.col("doc_id").cast("string").alias("summary_id"), F.col("lang").alias("snapshot_id"), body.alias("body")))
    langs = docs.select(F.col("lang").alias("snapshot_id")).distinct()
    snapshots = langs.select("snapshot_id", F.when(F.col("snapshot_id") == "fr", "other").otherwise(citations.SNAPSHOT_SCHEMA).alias("schema_version"), F.lit(1).alias("snapshot_version"))
    versions = langs.select("snapshot_id", F.lit(0).alias("pos"), F.lit("a1").alias("article_id"), F.lit("v1").alias("article_version_id"), F.lit("active").alias("state"))
    spanish = F.col("snapshot_id") == "es"
    number = F.struct(F.lit("n").alias("key"), F.lit("90").alias("value"), F.lit("x").alias("unit"), F.when(spanish, "EUR").alias("currency"), F.lit("unit").alias("scale"))
    time = F.struct(F.lit("t").alias("key"), F.lit("2024-02-28").alias("value"), F.when(spanish, "published").otherwise("event").alias("role"))
    claims = versions.select(
        "snapshot_id", "pos", F.lit("c1").alias("claim_id"), "article_id", "article_version_id", "state", F.lit("p1").alias("proposition_id"), F.lit("reported").alias("epistemic_status"), F.lit("affirmed").alias("polarity"),
        F.array(F.when(F.col("snapshot_id") == "de", "other").otherwise(F.col("snapshot_id"))).alias("entities"), F.array(number).alias("numbers"), F.array(time).alias("times"),
    )
    return citations.validate(summaries, snapshots, versions, claims)


# --- pages written around documents --------------------------------------------------------------------------------------

_LD = '<html><head><title>T</title><script type="application/ld+json">@J@</script></head><body></body></html>'


@query(f"""WITH d AS (SELECT doc_id, doc_id % 4 AS k, nullif({s.trim(_LINE)}, '') AS h, nullif({s.trim('text')}, '') AS b FROM documents), f AS (SELECT *, k < 3 AND (h IS NOT NULL OR b IS NOT NULL) AS ok FROM d)
SELECT doc_id AS page_id, CASE WHEN ok THEN h END AS headline, CASE WHEN ok THEN sha256(b) END AS body_hash, CASE WHEN ok THEN CASE k WHEN 0 THEN 'An, Bình' ELSE 'An' END END AS author, CASE WHEN ok THEN '2026-01-02' END AS published_at,
CASE WHEN ok AND k = 1 THEN '2026-01-03' END AS updated_at, CASE WHEN ok THEN CASE k WHEN 2 THEN 'https://m.example/' ELSE 'https://e.example/' END || doc_id END AS url FROM f""")
def jsonld_articles(spark, sf_dir):
    """Documents as JSON-LD articles: in a graph, as an object, in a list, and as a record of another type."""
    docs = table(spark, sf_dir, "documents")
    rest = '"headline":@H@,"articleBody":@B@,"datePublished":"2026-01-02","url":"https://e.example/@N@"'
    bodies = {
        0: '{"@context":"x","@graph":[{"@type":"WebPage"},{"@type":["NewsArticle"],"author":[{"name":"An"},"Bình"],' + rest + "}]}",
        1: '{"@type":"Article","author":{"name":"An"},"dateModified":"2026-01-03",' + rest + "}",
        2: '[{"@type":"Person"},{"@type":"ReportageNewsArticle","author":"An","mainEntityOfPage":{"@id":"https://m.example/@N@"},' + rest + "}]",
    }
    body = _pick(F.col("doc_id"), 4, {k: F.lit(_LD.replace("@J@", b)) for k, b in bodies.items()}, F.lit(_LD.replace("@J@", '{"@type":"Recipe",' + rest + "}")))
    for mark, value in (("@N@", F.col("doc_id").cast("string")), ("@H@", _quoted(F.substring_index("text", "\n", 1))), ("@B@", _quoted(F.col("text")))):
        body = F.replace(body, F.lit(mark), value)
    pages = cut(docs.select(F.col("doc_id").alias("page_id"), body.alias("html"))).select("page_id", html.json_ld_article(F.col("html")).alias("a"))
    return pages.select("page_id", "a.headline", F.sha2("a.body", 256).alias("body_hash"), "a.author", "a.published_at", "a.updated_at", "a.url")


_FIXED = "Một đoạn văn đủ dài để vượt qua ngưỡng của bộ lọc đoạn văn, và còn dài hơn nữa cho chắc. " * 3
_BARE = "regexp_replace(text, '[<>&]', ' ', 'g')"
_START = "(?i)^(xem thêm|đọc thêm|theo dõi|chia sẻ|đăng ký|nguồn:|tin liên quan)"


@query(f"""WITH d AS (SELECT doc_id, doc_id % 3 AS k, {s.tidy(_BARE)} AS x FROM documents), f AS (SELECT *, k < 2 AND {s.utf16('x')} >= 30 AND NOT regexp_matches(x, '{_START}') AS ok FROM d)
SELECT doc_id AS page_id, CASE WHEN ok THEN sha256(x || chr(10) || chr(10) || '{_FIXED.strip()}') END AS text_hash, CASE WHEN ok THEN 2 END AS paragraph_count FROM f""")
def publisher_container(spark, sf_dir):
    """Documents as publishers' pages: a nested container with a noise block, a plain one, and a publisher without one."""
    bare = F.regexp_replace("text", "[<>&]", " ")
    nested = f"<div class='other'><p>{_FIXED}</p></div><div class='detail-content afcbc-body'><div><p>@P@</p></div><p>{_FIXED}</p><div class='box-related'><p>{_FIXED}</p></div></div><footer><p>{_FIXED}</p></footer>"
    plain = f'<article class="fck_detail width"><p class="Normal">@P@</p><p>{_FIXED}</p></article><p>{_FIXED}</p>'
    page = F.replace(_pick(F.col("doc_id"), 3, {0: F.lit(nested), 1: F.lit(plain)}, F.lit(plain)), F.lit("@P@"), bare)
    who = _pick(F.col("doc_id"), 3, {0: F.lit("Tuổi Trẻ"), 1: F.lit("VnExpress")}, F.lit("Thanh Niên"))
    pages = cut(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), who.alias("publisher"), page.alias("html")))
    pages = pages.select("page_id", html.publisher_content(F.col("publisher"), F.col("html")).alias("c"))
    return pages.select("page_id", F.sha2("c.text", 256).alias("text_hash"), "c.paragraph_count")


_START_BASE = _START.replace("|tin liên quan", "")


@query(f"""WITH d AS (SELECT doc_id, doc_id % 6 AS k, {s.tidy(_BARE)} AS x, {s.collapse(f"split_part({_BARE}, chr(10), 1)")} AS h FROM documents),
g AS (SELECT *, {s.utf16('x')} AS n, {s.utf16('x')} >= 30 AND NOT regexp_matches(x, '{_START_BASE}') AS para FROM d),
t AS (SELECT *, CASE k WHEN 0 THEN CASE WHEN n >= 250 THEN x END WHEN 1 THEN CASE WHEN para THEN rtrim(repeat(x || chr(10) || chr(10), 32), chr(10)) END WHEN 2 THEN CASE WHEN para AND n >= 250 THEN x END WHEN 3 THEN NULL ELSE CASE WHEN para AND n >= 250 THEN x END END AS text,
CASE k WHEN 0 THEN coalesce(nullif(h, ''), 'T') WHEN 1 THEN coalesce(nullif(h, ''), 'T') WHEN 4 THEN NULL ELSE 'T' END AS title FROM g),
o AS (SELECT *, title IS NOT NULL AND text IS NOT NULL AS ok, CASE WHEN text IS NOT NULL THEN CASE k WHEN 0 THEN 'json-ld' WHEN 2 THEN 'page-paragraphs' ELSE 'article-paragraphs' END END AS st,
CASE WHEN text IS NOT NULL THEN CASE k WHEN 0 THEN len(list_filter(string_split(text, chr(10)), lambda p: {s.trim('p')} <> '')) WHEN 1 THEN 32 ELSE 1 END END AS c FROM t),
w AS (SELECT *, concat_ws(',', CASE WHEN st = 'page-paragraphs' THEN 'broad-page-paragraph-fallback' END, CASE WHEN c > 30 THEN 'high-paragraph-count' END, CASE WHEN k = 1 THEN 'publisher-reported-as-author' END) AS said FROM o)
SELECT doc_id AS page_id, title, CASE k WHEN 0 THEN 'An' WHEN 5 THEN 'Bình & Co' END AS author, CASE WHEN k IN (0, 5) THEN 'reported' ELSE 'unknown' END AS author_status, st AS extraction_strategy, CAST(c AS INT) AS paragraph_count, CAST({s.utf16('text')} AS INT) AS text_length, sha256(text) AS content_hash,
CASE WHEN NOT ok THEN 'failed' WHEN said LIKE '%fallback%' OR said LIKE '%high%' THEN 'fallback-required' ELSE 'ready' END AS quality_decision, CASE WHEN ok THEN said ELSE '' END AS warnings,
CASE WHEN title IS NULL THEN 'Article title not found' WHEN text IS NULL THEN 'Article text too short' END AS error FROM w""")
def normalized_articles(spark, sf_dir):
    """Documents as Thanh Niên pages: JSON-LD; 32 paragraphs, an Open Graph title and the publisher as author; paragraphs without an article; no text; no title; an author with a reference decoded twice."""
    bare = F.regexp_replace("text", "[<>&]", " ")
    line = F.substring_index(bare, "\n", 1)
    forms = {
        0: _LD.replace("@J@", '{"@type":"Article","author":"An","headline":@H@,"articleBody":@B@}'),
        1: '<title>T</title><meta content="@A@" property="og:title"><meta name="author" content="THANH  NIÊN"><article>' + "<p>@P@</p>" * 32 + "</article>", 2: "<title>T</title><p>@P@</p>", 3: "<title>T</title><div>@P@</div>", 4: "<article><p>@P@</p></article>",
        5: "<title>T</title><meta name='article:author' content='Bình &amp;amp; Co'><article><p>@P@</p></article>",
    }
    page = _pick(F.col("doc_id"), 6, {k: F.lit(x) for k, x in forms.items()}, F.lit(""))
    for mark, value in (("@A@", F.replace(line, F.lit('"'), F.lit("&quot;"))), ("@P@", bare), ("@H@", _quoted(line)), ("@B@", _quoted(bare))):
        page = F.replace(page, F.lit(mark), value)
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.lit("Thanh Niên").alias("publisher"), F.lit("https://thanhnien.vn/a").alias("url"), page.alias("html"))
    found = html.extract_articles(cut(pages))
    return found.select(
        "page_id", "title", "author", "author_status", "extraction_strategy", "paragraph_count", "text_length", "content_hash", "quality_decision", F.array_join("quality_warnings", ",").alias("warnings"), "error",
    )


_FETCHED = "CASE doc_id % 5 WHEN 1 THEN 'HTTP 500' WHEN 2 THEN 'Unexpected content type: text/html' WHEN 3 THEN 'Unsupported XML feed root' END"


@query(f"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS source_id, lang AS category, {_FETCHED} AS early, doc_id % 5 AS k, {s.feed_text(f"split_part({_BARE}, chr(10), 1)")} AS title FROM documents),
f AS (SELECT *, coalesce(early, CASE WHEN title = '' THEN 'No valid item entries found' END) AS error FROM d)
SELECT source_id, category, error IS NULL AS ok, CAST(CASE WHEN error IS NULL THEN 200 END AS INT) AS http_status, CASE WHEN error IS NULL AND k = 0 THEN 'application/rss+xml' END AS content_type, CASE WHEN error IS NULL THEN 1 END AS item_count,
CASE WHEN error IS NULL THEN '2026-01-02T00:00:00Z' END AS latest_published_at, error FROM f""")
def feed_inspection(spark, sf_dir):
    """Documents as answers to feed requests: sound, a server error, a web page, another XML, and one without a content type."""
    k = F.col("doc_id")
    bare = F.regexp_replace("text", "[<>&]", " ")
    feed = F.concat(F.lit("<rss><channel><item><title>"), F.substring_index(bare, "\n", 1), F.lit("</title><link>l</link><pubDate>2026-01-02T00:00:00Z</pubDate></item></channel></rss>"))
    docs = table(spark, sf_dir, "documents")
    fetched = docs.select(
        k.cast("string").alias("id"), _pick(k, 5, {1: F.lit(500)}, F.lit(200)).alias("status"), _pick(k, 5, {0: F.lit("application/rss+xml"), 2: F.lit("text/html")}, F.lit(None).cast("string")).alias("content_type"),
        _pick(k, 5, {3: F.lit("<opml/>")}, feed).alias("body"), _pick(k, 5, {1: F.lit("HTTP 500")}, F.lit(None).cast("string")).alias("error"), F.lit(5).alias("duration_ms"),
    )
    sources = docs.select(k.cast("string").alias("id"), F.col("source").alias("publisher"), F.col("lang").alias("category"), F.lit("https://e.example/").alias("feed_url"))
    return feeds.inspect_fetched(cut(fetched), sources).select("source_id", "category", "ok", "http_status", "content_type", "item_count", "latest_published_at", "error")


@query(f"""SELECT CAST(doc_id AS VARCHAR) AS id, CAST(CASE WHEN doc_id % 4 > 0 AND {s.utf16(s.trim('text'))} >= 250 THEN {s.utf16(s.trim('text'))} END AS INT) AS text_length, CASE WHEN doc_id % 4 > 0 AND {s.utf16(s.trim('text'))} >= 250 THEN sha256({s.trim('text')}) END AS content_hash,
CASE WHEN doc_id % 4 = 0 THEN 'HTTP 429' WHEN {s.utf16(s.trim('text'))} < 250 THEN 'Browser text is too short' END AS error FROM documents""")
def browser_metrics(spark, sf_dir):
    """Documents as answers of a browser service, every fourth refused."""
    refused = F.col("doc_id") % 4 == 0
    fetched = table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.lit("https://e.example/").alias("url"), F.when(~refused, F.to_json(F.struct(F.lit(True).alias("success"), F.col("text").alias("result")))).alias("body"),
        F.when(refused, "HTTP 429").alias("error"), F.lit(5).alias("duration_ms"),
    )
    return routing.browser_metrics(fetched).select("id", "text_length", "content_hash", "error")


# --- manifests -----------------------------------------------------------------------------------------------------------

_MANIFEST = '{"schemaVersion":"2.0.0","datasetVersion":"v","generatedAt":"2024","legalBoundary":"x","articles":[],"cases":[]}'
_ROOT_EDITS = {1: ('"2.0.0"', '"1.0.0"'), 2: ('"datasetVersion":"v"', '"datasetVersion":7'), 3: ('"x"', '" "'), 4: ('"articles":[]', '"articles":{}'), 5: (_MANIFEST, "{"), 6: ('"cases":[]', '"cases":null')}
_NON_EMPTY = " must be a non-empty string"


@query(f"""WITH d AS (SELECT CAST(c_custkey % 7 AS INT) AS k FROM customer), x(k, issue) AS (VALUES (1, 'schemaVersion must be 2.0.0'), (2, 'datasetVersion{_NON_EMPTY}'), (3, 'legalBoundary{_NON_EMPTY}'), (4, 'articles must be an array'), (6, 'cases must be an array'),
(5, 'schemaVersion must be 2.0.0'), (5, 'datasetVersion{_NON_EMPTY}'), (5, 'generatedAt{_NON_EMPTY}'), (5, 'legalBoundary{_NON_EMPTY}'), (5, 'articles must be an array'), (5, 'cases must be an array'))
SELECT issue, count(*) AS n FROM d JOIN x USING (k) GROUP BY issue""")
def manifest_roots(spark, sf_dir):
    """A manifest for each customer, six of seven with a wrong head."""
    body = _changed(_MANIFEST, F.col("c_custkey"), 7, _ROOT_EDITS, {})
    return manifest.root_issues(manifest.parse(table(spark, sf_dir, "customer").select(body.alias("body")))).groupBy("issue").agg(F.count("*").alias("n"))


@query(f"""WITH d AS (SELECT CAST(p_partkey AS VARCHAR) AS i, CAST(p_partkey % 6 AS INT) AS k FROM part), x(k, issue) AS (VALUES (1, '.id{_NON_EMPTY}'), (2, '.title{_NON_EMPTY}'), (3, '.entities must contain non-empty strings'), (4, '.entities must contain non-empty strings'), (5, '.uncertainty is unsupported'))
SELECT 'articles[0]' || issue AS issue, count(*) AS n FROM d JOIN x USING (k) GROUP BY 1""")
def manifest_types(spark, sf_dir):
    """A manifest of one article for each part, whose name is the title; five of six have a value of a wrong JSON type."""
    article = '{"id":"a","category":"sports","sourceId":"s","title":@T@,"canonicalUrl":"https://e.example/","observedDate":"2024-02-28","verification":"page-fetched","contentType":"report","entities":["x"],"uncertainty":"none"}'
    edits = {1: ('"id":"a"', '"id":5'), 2: ("@T@", "9"), 3: ('["x"]', '["x",5]'), 4: ('["x"]', '"x"'), 5: ('"none"', "null")}
    body = _changed(_MANIFEST.replace('"articles":[]', f'"articles":[{article}]'), F.col("p_partkey"), 6, edits, {"@T@": _quoted(F.col("p_name"))})
    rows = manifest.articles_of(manifest.parse(spread(table(spark, sf_dir, "part").select("p_partkey", "p_name")).select(body.alias("body"))))
    return manifest.article_issues(rows).groupBy("issue").agg(F.count("*").alias("n"))


@query(f"""WITH o AS (SELECT CAST(o_orderkey AS INT) AS index, CAST(o_orderkey % 9 AS INT) AS k, o_custkey AS c FROM orders),
x(k, pos, said) AS (VALUES (1, 1, '.kind is unsupported'), (2, 2, '.articleIds must be a non-empty array'), (3, 3, '.articleIds must be unique'), (4, 4, '.expectedRelation is unsupported'), (5, 5, '.evaluationFocus{_NON_EMPTY}'), (6, 7, '.labelProvenance must be an object'),
(7, 12, ' accepted labels require human-review provenance'), (7, 13, ' accepted labels require at least one reviewer'), (7, 14, ' accepted labels require reviewedAt'), (8, 11, '.labelProvenance.notes{_NON_EMPTY}'))
SELECT index, CAST(pos AS INT) AS pos, 'cases[' || index || ']' || said AS issue FROM o JOIN x USING (k)
UNION ALL SELECT index, CAST(101 AS INT), 'cases[' || index || '].articleIds references unknown article ' || (c + 900) FROM o WHERE k NOT IN (2, 3) AND c + 900 NOT IN (SELECT c_custkey FROM customer)""")
def manifest_cases(spark, sf_dir):
    """Orders as manifest cases, customers as articles."""
    k, n = F.col("o_orderkey"), F.col("o_custkey")
    ids = _pick(k, 9, {2: F.array().cast("array<string>"), 3: F.array(n.cast("string"), n.cast("string"))}, F.array(n.cast("string"), (n + 900).cast("string")))
    accepted = k % 9 == 7
    provenance = F.struct(
        F.when(accepted, "accepted").otherwise("provisional").alias("status"), F.lit("project-seed").alias("method"), F.array().cast("array<string>").alias("reviewedBy"), F.lit(None).cast("string").alias("reviewedAt"),
        F.when(k % 9 == 8, " ").otherwise("n").alias("notes"),
    )
    cases = table(spark, sf_dir, "orders").select(
        k.cast("int").alias("index"), F.concat(F.lit("k"), k.cast("string")).alias("id"), F.when(k % 9 == 1, "x").otherwise("same-event").alias("kind"), ids.alias("articleIds"), F.when(k % 9 == 4, "x").otherwise("same-event").alias("expectedRelation"),
        F.when(k % 9 == 5, "").otherwise("f").alias("evaluationFocus"), F.lit("none").alias("knownUncertainty"), F.when(k % 9 != 6, provenance).alias("labelProvenance"),
    )
    return manifest.case_issues(cases, table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id")))


_KINDS = ", ".join(f"'{k}'" for k in manifest.RELATION_OF_KIND)
_RELATIONS = ", ".join(f"'{r}'" for r in manifest.RELATIONS)


@query(f"""WITH c AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id AS d, [{_KINDS}][doc_id % 6 + 1] AS kind, [{_RELATIONS}][doc_id % 6 + 1] AS wanted, [{_RELATIONS}][doc_id % 4 + 1] AS rel, CASE WHEN doc_id % 5 = 0 THEN [doc_id] WHEN doc_id % 7 = 0 THEN [doc_id, doc_id] ELSE [doc_id, doc_id + 1] END AS a FROM labels),
x AS (SELECT c.id FROM c, (SELECT doc_id, lang FROM documents) y WHERE list_contains(c.a, y.doc_id) AND kind = 'same-event' GROUP BY c.id HAVING count(DISTINCT lang) > 1)
SELECT id, CAST(0 AS INT) AS pos, id || ' kind ' || kind || ' requires relation ' || wanted AS issue FROM c WHERE rel <> wanted UNION ALL SELECT id, 1, id || ' requires at least two articles' FROM c WHERE kind IN ('same-event', 'related-subevent', 'hard-negative') AND len(a) < 2
UNION ALL SELECT id, 2, id || ' same-event case requires expectedClusterId' FROM c WHERE kind = 'same-event' AND d % 4 = 0 UNION ALL SELECT id, 3, id || ' same-event articles cross categories' FROM x UNION ALL SELECT id, 4, id || ' hard-negative requires distinct articles' FROM c WHERE kind = 'hard-negative' AND len(list_distinct(a)) < 2""")
def case_semantics(spark, sf_dir):
    """Labels as cases, documents as articles whose category is the language."""
    d = F.col("doc_id")
    one = lambda values, of: F.element_at(F.array(*map(F.lit, values)), (d % of + 1).cast("int"))
    ids = F.when(d % 5 == 0, F.array(d)).when(d % 7 == 0, F.array(d, d)).otherwise(F.array(d, d + 1))
    cases = table(spark, sf_dir, "labels").select(
        d.cast("string").alias("id"), one(manifest.RELATION_OF_KIND, 6).alias("kind"), ids.cast("array<string>").alias("articleIds"), one(manifest.RELATIONS, 4).alias("expectedRelation"), F.when(d % 4 != 0, "c").alias("expectedClusterId"),
    )
    return manifest.semantic_issues(cases, table(spark, sf_dir, "documents").select(d.cast("string").alias("id"), F.col("lang").alias("category")))
