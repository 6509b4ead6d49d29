"""All registered queries of the library and their SQL twins. Test tables take the roles that each query's comment names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.lineage import spread
from ..operators import citations, diagnostics, evaluation, feeds, html, manifest, relations, routing, versions
from ..sources import registry
from . import sqltext as s

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- pages: raw HTML -----------------------------------------------------------------------------------------------------

_START = "(?i)^(xem thêm|đọc thêm|theo dõi|chia sẻ|đăng ký|nguồn:)"
_PARAGRAPHS = f"""
raw AS (SELECT page_id, url, html, regexp_extract(html, '(?is)<article\\b[^>]*>(.*?)</article>', 1) AS art FROM pages),
bits AS (SELECT page_id, k, i, p FROM (
    SELECT page_id, 'all' AS k, unnest(regexp_extract_all(html, '(?is)<p\\b[^>]*>(.*?)</p>', 1)) AS p, generate_subscripts(regexp_extract_all(html, '(?is)<p\\b[^>]*>(.*?)</p>', 1), 1) AS i FROM raw
    UNION ALL
    SELECT page_id, 'in' AS k, unnest(regexp_extract_all(art, '(?is)<p\\b[^>]*>(.*?)</p>', 1)) AS p, generate_subscripts(regexp_extract_all(art, '(?is)<p\\b[^>]*>(.*?)</p>', 1), 1) AS i FROM raw)),
texts AS (SELECT page_id, k, i, {s.fragment('p')} AS x FROM bits),
good AS (SELECT page_id, k, i, x FROM texts WHERE {s.utf16('x')} >= 30 AND NOT regexp_matches(x, '{_START}')),
joined AS (SELECT page_id, k, count(*) AS n, string_agg(x, chr(10) || chr(10) ORDER BY i) AS body FROM good GROUP BY page_id, k),
picked AS (SELECT r.page_id, r.url, nullif({s.fragment("regexp_extract(r.html, '(?is)<title\\b[^>]*>(.*?)</title>', 1)")}, '') AS title,
    CASE WHEN {s.utf16('a.body')} >= 250 THEN 'article-paragraphs' WHEN {s.utf16('w.body')} >= 250 THEN 'page-paragraphs' END AS strategy, a.n AS an, w.n AS wn, a.body AS ab, w.body AS wb
    FROM raw r LEFT JOIN joined a ON a.page_id = r.page_id AND a.k = 'in' LEFT JOIN joined w ON w.page_id = r.page_id AND w.k = 'all'),
ext AS (SELECT page_id, url, title, strategy AS extraction_strategy, CAST(CASE strategy WHEN 'article-paragraphs' THEN an WHEN 'page-paragraphs' THEN wn END AS INT) AS paragraph_count,
    CASE strategy WHEN 'article-paragraphs' THEN ab WHEN 'page-paragraphs' THEN wb END AS body FROM picked),
judged AS (SELECT page_id, url, title, extraction_strategy, paragraph_count, CAST({s.utf16('body')} AS INT) AS text_length, sha256(body) AS content_hash,
    CASE WHEN title IS NULL OR body IS NULL THEN 'failed' WHEN extraction_strategy = 'page-paragraphs' OR paragraph_count > 30 THEN 'fallback-required' ELSE 'ready' END AS quality_decision FROM ext)
"""


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.with_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    out = found.withColumn("title", html.title(F.col("html"))).withColumn("text_length", t.utf16_length(F.col("text"))).withColumn("content_hash", F.sha2("text", 256))
    ok = F.col("title").isNotNull() & F.col("text").isNotNull()
    said = html.warnings(F.col("extraction_strategy"), F.col("paragraph_count"), F.lit(False))
    return out.withColumn("quality_decision", html.decision(ok, said)).drop("__ld", "html", "text")


@query(f"WITH {_PARAGRAPHS} SELECT page_id, title, extraction_strategy, paragraph_count, text_length, content_hash, quality_decision FROM judged")
def page_extract(spark, sf_dir):
    return _articles(spark, sf_dir).select("page_id", "title", "extraction_strategy", "paragraph_count", "text_length", "content_hash", "quality_decision")


_TITLE = s.fragment("regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title>', 1)")


@query(f"SELECT page_id, nullif({_TITLE}, '') AS title FROM pages")
def page_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.title(F.col("html")).alias("title"))


@query(f"WITH {_PARAGRAPHS} SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INT) AS pos, x AS paragraph FROM good WHERE k = 'all'")
def page_paragraphs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.posexplode(html.paragraphs(F.col("html"))).alias("pos", "paragraph"))


@query(f"WITH {_PARAGRAPHS} SELECT quality_decision, count(*) AS n, CAST(sum(paragraph_count) AS BIGINT) AS paragraphs FROM judged GROUP BY quality_decision")
def page_quality_summary(spark, sf_dir):
    return _articles(spark, sf_dir).groupBy("quality_decision").agg(F.count("*").alias("n"), F.sum("paragraph_count").alias("paragraphs"))


_HOST = "regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)"


@query(f"""SELECT page_id, CASE WHEN url NOT LIKE 'https://%' THEN 'Article URL must use HTTPS' WHEN NOT ends_with({_HOST}, '.example.com') THEN 'Host ' || {_HOST} || ' is not allowed' END AS error FROM pages""")
def page_url_allowlist(spark, sf_dir):
    """Hosts under example.com are the publisher's."""
    pages = table(spark, sf_dir, "pages")
    host = F.lower(F.try_parse_url("url", F.lit("HOST")))
    hosts = F.when(host.endswith(".example.com"), F.array(host)).otherwise(F.array().cast("array<string>"))
    return pages.select("page_id", html.check_url(F.col("url"), hosts).alias("error"))


@query(f"""WITH {_PARAGRAPHS}, r AS (SELECT page_id, {_HOST} AS source_id, quality_decision AS q FROM judged)
SELECT page_id, source_id, CASE q WHEN 'failed' THEN 'failed' WHEN 'ready' THEN 'direct' ELSE CASE WHEN ends_with(source_id, '.com') THEN 'browser-markdown' ELSE 'hold-for-review' END END AS route,
CASE q WHEN 'failed' THEN 'direct-fetch-failed' WHEN 'ready' THEN 'direct-quality-ready' ELSE CASE WHEN ends_with(source_id, '.com') THEN 'browser-fallback-enabled' ELSE 'browser-fallback-unavailable' END END AS reason FROM r""")
def acquisition_route(spark, sf_dir):
    """Hosts under .com are on the fallback list."""
    host = F.lower(F.try_parse_url("url", F.lit("HOST")))
    results = _articles(spark, sf_dir).select("page_id", host.alias("source_id"), (F.col("quality_decision") != "failed").alias("ok"), "quality_decision")
    listed = table(spark, sf_dir, "pages").select(host.alias("source_id")).where("source_id like '%.com'")
    return routing.with_routes(results, listed, True).select("page_id", "source_id", "route", "reason")


@query(f"""SELECT page_id, CAST(n AS INT) AS request_number, CASE WHEN n > 3 THEN 'Browser request budget of 3 is used up' END AS error
FROM (SELECT page_id, row_number() OVER (PARTITION BY {_HOST} ORDER BY page_id) AS n FROM pages)""")
def browser_budget(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("host", F.try_parse_url("url", F.lit("HOST")))
    return routing.with_budget(pages, ["host"], ["page_id"], 3).select("page_id", "request_number", "error")


@query("""WITH o AS (SELECT page_id, unnest(regexp_extract_all(html, '(?i)<(?:article|main|section|div)\\b[^>]*>')) AS tag FROM pages),
h AS (SELECT DISTINCT page_id, lower(regexp_extract(tag, '(?i)<([a-z]+)', 1)) || '.' || regexp_extract(tag, '(?i)\\bclass\\s*=\\s*"(.*?)"', 1) AS hint FROM o WHERE regexp_matches(tag, '(?i)\\bclass\\s*=\\s*"[^"]'))
SELECT p.page_id, coalesce(string_agg(hint, ' ' ORDER BY hint), '') AS tokens FROM pages p LEFT JOIN h USING (page_id) GROUP BY p.page_id""")
def structure_tokens(spark, sf_dir):
    tokens = diagnostics.structural_tokens(F.col("html"), "(?i)(ad|article)")
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(tokens, " ").alias("tokens"))


_WRAPPED = "'<div class=\"story ' || source || '\"><p>' || replace(text, chr(10), '</p><p>') || '</p></div>'"
_INNER = "'<p>' || replace(text, chr(10), '</p><p>') || '</p>'"


@query(f"""WITH b AS (SELECT doc_id, source, {_INNER} AS x FROM documents WHERE NOT regexp_matches(text, '(?i)</?(article|main|section|div)')),
m AS (SELECT doc_id, source, CAST(len(regexp_extract_all(x, '(?i)<p\\b[^>]*>')) AS INT) AS paragraph_count, CAST({s.utf16(s.collapse(s.sub(s.sub(s.sub(s.unsafe('x'), '<[^>]+>'), '(?i)&nbsp;'), '(?i)&amp;', "'&'")))} AS INT) AS text_length FROM b)
SELECT doc_id, CAST(1 AS INT) AS rank, 'div.story.' || source AS selector_hint, paragraph_count, text_length FROM m WHERE paragraph_count >= 2 AND text_length >= 250""")
def container_topk(spark, sf_dir):
    """Documents as containers, their lines as paragraphs."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).where("text not rlike '(?i)</?(article|main|section|div)'")
    wrapped = F.concat(F.lit('<div class="story '), "source", F.lit('"><p>'), F.replace("text", F.lit("\n"), F.lit("</p><p>")), F.lit("</p></div>"))
    return diagnostics.container_candidates(docs.select("doc_id", wrapped.alias("html")), "doc_id")


# --- feeds ---------------------------------------------------------------------------------------------------------------

_LINE = "split_part(text, chr(10), 1)"


@query(f"""SELECT source_id, pos, title, link, published_at, guid FROM (SELECT CAST(doc_id AS VARCHAR) AS source_id, CAST(0 AS INT) AS pos, {s.feed_text(_LINE)} AS title,
'https://feeds.example/' || source || '?a=1&b=' || doc_id AS link, CAST(NULL AS VARCHAR) AS published_at, 'doc-' || doc_id AS guid FROM documents) WHERE title <> ''""")
def feed_items(spark, sf_dir):
    """Each document as a feed of one item: its first line is the title."""
    line = F.substring_index("text", "\n", 1)
    body = F.concat(
        F.lit("<rss version='2.0'><channel><title>Feed</title><item><title>"), line, F.lit("</title><link>https://feeds.example/"), "source", F.lit("?a=1&amp;b="), F.col("doc_id").cast("string"),
        F.lit("</link><guid isPermaLink='false'>doc-"), F.col("doc_id").cast("string"), F.lit("</guid></item></channel></rss>"),
    )
    return feeds.feed_items(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("source_id"), body.alias("body")))


@query("""SELECT CAST(user_id AS VARCHAR) AS source_id, count(*) AS item_count, arg_max(strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), (date_trunc('second', ts), -event_id)) AS latest_published_at FROM events GROUP BY user_id""")
def feed_latest(spark, sf_dir):
    """Users as feeds, events as their items."""
    items = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("source_id"), F.col("event_id").alias("pos"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at"))
    return feeds.feed_metrics(items)


@query("""WITH r AS (SELECT s_suppkey AS pos, 's' || (s_suppkey % 90) AS id, CASE WHEN s_nationkey % 7 = 0 THEN 'no url' WHEN s_nationkey % 3 = 0 THEN 'http://f.example/' || (s_suppkey % 95) ELSE 'https://f.example/' || (s_suppkey % 95) END AS u, s_nationkey AS p FROM supplier),
m AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) > 1 AS di, row_number() OVER (PARTITION BY u ORDER BY pos) > 1 AS du FROM r)
SELECT pos, CAST(0 AS INT) AS n, 'Duplicate source ID: ' || id AS issue FROM m WHERE di UNION ALL SELECT pos, 1, 'Duplicate feed URL: ' || u FROM m WHERE du UNION ALL SELECT pos, 2, 'Invalid feed URL for ' || id || ': ' || u FROM m WHERE u = 'no url'
UNION ALL SELECT pos, 3, 'Feed URL must use HTTPS for ' || id FROM m WHERE u LIKE 'http:%' UNION ALL SELECT pos, 4, 'pollMinutes must be an integer >= 5 for ' || id FROM m WHERE u <> 'no url' AND p < 5""")
def registry_issues(spark, sf_dir):
    """Suppliers as feed sources."""
    url = F.expr("CASE WHEN s_nationkey % 7 = 0 THEN 'no url' WHEN s_nationkey % 3 = 0 THEN concat('http://f.example/', s_suppkey % 95) ELSE concat('https://f.example/', s_suppkey % 95) END")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("pos"), F.expr("concat('s', s_suppkey % 90)").alias("id"), url.alias("feed_url"), F.col("s_nationkey").alias("poll_minutes"))
    return manifest.source_issues(rows)


@query()
def feed_registry(spark, sf_dir):
    return registry.sources(spark)


# --- versions ------------------------------------------------------------------------------------------------------------

_CHAIN = """snap AS (SELECT doc_id, source, sha256(text) AS h, lag(sha256(text)) OVER (PARTITION BY source ORDER BY doc_id) AS b, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
chain AS (SELECT doc_id, source, h, rn, CAST(sum(CASE WHEN rn = 1 OR h <> b THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS INT) AS v, CASE WHEN rn = 1 THEN 'created' WHEN h <> b THEN 'version-appended' ELSE 'unchanged' END AS o FROM snap)"""


def _versioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's documents as the snapshots of one article."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").alias("seq"), F.col("doc_id").alias("observed_at"), F.col("source").alias("article_id"), F.col("lang").alias("source_id"), F.expr("nullif(cast(n_chars % 5 as string), '0')").alias("source_article_id"), F.sha2("text", 256).alias("content_hash"))
    return versions.with_versions(rows)


@query(f"WITH {_CHAIN} SELECT doc_id AS seq, source AS article_id, v AS version_number, o AS outcome FROM chain")
def version_chain(spark, sf_dir):
    return _versioned(spark, sf_dir).select("seq", "article_id", "version_number", "outcome")


@query(f"WITH {_CHAIN} SELECT source AS article_id, arg_max(h, doc_id) AS content_hash, max(v) AS current_version_number, min(doc_id) AS first_seen_at, max(doc_id) AS last_seen_at FROM chain GROUP BY source")
def article_heads(spark, sf_dir):
    return versions.heads(_versioned(spark, sf_dir)).select("article_id", "content_hash", "current_version_number", "first_seen_at", "last_seen_at")


@query(f"WITH {_CHAIN} SELECT o AS outcome, count(*) AS n FROM chain GROUP BY o")
def persist_outcomes(spark, sf_dir):
    return _versioned(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("n"))


@query("""SELECT source AS article_id, lang AS source_id, first(i ORDER BY doc_id DESC) AS source_article_id, min(doc_id) AS first_seen_at, max(doc_id) AS last_seen_at
FROM (SELECT source, lang, doc_id, nullif(CAST(n_chars % 5 AS VARCHAR), '0') AS i FROM documents) GROUP BY source, lang""")
def article_links(spark, sf_dir):
    return versions.links(_versioned(spark, sf_dir))


@query("SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1")
def content_hash_groups(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


@query("""WITH l AS (SELECT l_suppkey, l_partkey, min(l_orderkey) AS a FROM lineitem WHERE l_linenumber = 1 GROUP BY 1, 2)
SELECT i.l_orderkey AS seq, i.l_linenumber AS line, coalesce(l.a, o.o_orderkey) AS article_id, CASE WHEN l.a IS NOT NULL THEN 'stable-id' WHEN o.o_orderkey IS NOT NULL THEN 'canonical-url' END AS matched_by
FROM lineitem i LEFT JOIN l ON l.l_suppkey = i.l_suppkey AND l.l_partkey = i.l_partkey LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'F') o ON o.o_orderkey = i.l_orderkey""")
def identity_resolution(spark, sf_dir):
    """Lines as snapshots: (supplier, part) is the stable id, the order the URL; first lines and open orders are stored already."""
    lines = table(spark, sf_dir, "lineitem")
    incoming = lines.select(F.col("l_orderkey").alias("seq"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("source_article_id"), F.col("l_orderkey").alias("canonical_url"))
    known = lines.where("l_linenumber = 1").groupBy(F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("source_article_id")).agg(F.min("l_orderkey").alias("article_id"))
    articles = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("canonical_url"), F.col("o_orderkey").alias("article_id"))
    return versions.lookup(incoming, known, articles).select("seq", "line", "article_id", "matched_by")


_STATUS = "CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'partial' END"


@query(f"""WITH e AS (SELECT {_STATUS} AS following, lag({_STATUS}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS current FROM events)
SELECT current, following, (current || '>' || following) IN ('queued>running', 'queued>cancelled', 'running>succeeded', 'running>partial', 'running>failed', 'running>cancelled', 'partial>queued', 'failed>queued') AS allowed, count(*) AS n
FROM e WHERE current IS NOT NULL GROUP BY ALL""")
def run_transitions(spark, sf_dir):
    """Events as the states of a user's run."""
    events = table(spark, sf_dir, "events").withColumn("following", F.expr(_STATUS))
    changes = events.withColumn("current", F.lag("following").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).where("current is not null")
    return changes.groupBy("current", "following").agg(F.count("*").alias("n")).withColumn("allowed", routing.transition_allowed(F.col("current"), F.col("following")))


@query("""WITH e AS (SELECT CAST(event_id % 5 AS INT) AS a, 3 AS m, event_type = 'error' AS r FROM events)
SELECT CASE WHEN a < 1 OR m < a THEN NULL ELSE 'failed' END AS terminal_status, CASE WHEN a < 1 OR m < a THEN NULL ELSE r AND a < m END AS should_retry, CASE WHEN a >= 1 AND m >= a AND r AND a < m THEN a + 1 END AS next_attempt,
CASE WHEN a < 1 OR m < a THEN 'Invalid processing failure attempt counters' END AS error, count(*) AS n FROM e GROUP BY ALL""")
def retry_decisions(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.expr("cast(event_id % 5 as int)").alias("a"), (F.col("event_type") == "error").alias("r"))
    return rows.select(routing.failure_decision(F.col("r"), F.col("a"), F.lit(3)).alias("d")).select("d.*").groupBy("terminal_status", "should_retry", "next_attempt", "error").agg(F.count("*").alias("n"))


@query("SELECT min(event_id) AS event_id, props AS idempotency_key FROM events GROUP BY props")
def idempotent_runs(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select("event_id", F.col("props").alias("idempotency_key"))
    return versions.idempotent(runs, "idempotency_key", "event_id")


@query("""SELECT k AS code, k IN ('23505', '40001', '40P01') AS retryable, CASE WHEN k = '23505' THEN 'uq' END AS violated, count(*) AS n
FROM (SELECT CASE event_id % 4 WHEN 0 THEN '23505' WHEN 1 THEN '40001' WHEN 2 THEN '23503' END AS k FROM events) GROUP BY ALL""")
def error_codes(spark, sf_dir):
    """The code sits at the second cause of each chain."""
    chain = F.array(F.lit(None).cast("string"), F.expr("CASE event_id % 4 WHEN 0 THEN '23505' WHEN 1 THEN '40001' WHEN 2 THEN '23503' END"))
    rows = table(spark, sf_dir, "events").select(routing.error_code(chain).alias("code"), routing.violated_constraint(chain, F.lit("uq")).alias("violated"))
    return rows.groupBy("code", "violated").agg(F.count("*").alias("n")).withColumn("retryable", F.col("code").isin(*routing.RETRYABLE_CODES))


# --- relations and evaluation --------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, length({s.fold('text')}) AS n, sha256({s.fold('text')}) AS folded_hash FROM documents")
def text_fold(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", t.fold(F.col("text")).alias("f")).select("doc_id", F.length("f").cast("long").alias("n"), F.sha2("f", 256).alias("folded_hash"))


_STOPS = ", ".join(f"'{w}'" for w in relations.STOP_WORDS)
_TOKENS = f"tok AS (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest(string_split({s.fold(_LINE)}, ' ')) AS w FROM documents) WHERE length(w) >= 3 AND w NOT IN ({_STOPS}) AND NOT regexp_matches(w, '^[0-9]+$'))"


def _first_line(c: str = "text"):
    return F.substring_index(c, "\n", 1)


@query(f"WITH {_TOKENS} SELECT d.doc_id, coalesce(string_agg(w, ' ' ORDER BY w), '') AS tokens FROM documents d LEFT JOIN tok USING (doc_id) GROUP BY d.doc_id")
def title_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(relations.title_tokens(_first_line())), " ").alias("tokens"))


def _relation_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles: language is the category, the first line the title, its first word and the source the entities."""
    docs = table(spark, sf_dir, "documents")
    kinds = F.array(*(F.lit(k) for k in ("match-report", "match-preview", "match-result", "post-match-reaction", "policy")))
    return docs.select(
        F.col("doc_id").alias("id"), F.col("lang").alias("category"), _first_line().alias("title"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 12).cast("int")), "yyyy-MM-dd").alias("observed_date"),
        F.element_at(kinds, (F.col("doc_id") % 5 + 1).cast("int")).alias("content_type"), F.array(F.substring_index(_first_line(), " ", 1), F.concat("source", F.lit(" 2024"))).alias("entities"),
    )


def _neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the one before it in its source."""
    before = F.lag("doc_id").over(Window.partitionBy("source").orderBy("doc_id"))
    return table(spark, sf_dir, "documents").select(before.alias("left_id"), F.col("doc_id").alias("right_id")).where("left_id is not null")


@query(f"""WITH {_TOKENS}, p AS (SELECT * FROM (SELECT lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS l, doc_id AS r FROM documents) WHERE l IS NOT NULL),
i AS (SELECT p.l, p.r, count(*) AS k FROM p JOIN tok a ON a.doc_id = p.l JOIN tok b ON b.doc_id = p.r AND a.w = b.w GROUP BY p.l, p.r), c AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id)
SELECT p.l AS left_id, p.r AS right_id, round(CASE WHEN coalesce(x.n, 0) + coalesce(y.n, 0) = 0 THEN 0.0 ELSE coalesce(i.k, 0) / (coalesce(x.n, 0) + coalesce(y.n, 0) - coalesce(i.k, 0)) END, 6) AS jaccard
FROM p LEFT JOIN i ON i.l = p.l AND i.r = p.r LEFT JOIN c x ON x.doc_id = p.l LEFT JOIN c y ON y.doc_id = p.r""")
def title_jaccard(spark, sf_dir):
    tokens = table(spark, sf_dir, "documents").select(F.col("doc_id"), relations.title_tokens(_first_line()).alias("w"))
    a, b = tokens.select(F.col("doc_id").alias("left_id"), F.col("w").alias("a")), tokens.select(F.col("doc_id").alias("right_id"), F.col("w").alias("b"))
    return _neighbours(spark, sf_dir).join(a, "left_id").join(b, "right_id").select("left_id", "right_id", F.round(relations.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


_GENERIC = ", ".join(f"'{g}'" for g in relations.GENERIC)
_BROAD = ", ".join(f"'{g}'" for g in relations.BROAD)
_KEY = s.fold(f"split_part({_LINE}, ' ', 1)")


@query(f"""WITH {_TOKENS}, a AS (SELECT doc_id, lang, source, CAST(doc_id % 12 AS INT) AS d, CAST(doc_id % 5 AS INT) AS ct, trim(regexp_replace(regexp_replace({_KEY}, '\\b(?:19|20)\\d{{2}}\\b', '', 'g'), ' +', ' ', 'g')) AS k1, {s.fold('source')} AS k2 FROM documents),
ks AS (SELECT doc_id, k1 AS k FROM a WHERE k1 <> '' AND k1 NOT IN ({_GENERIC}) UNION SELECT doc_id, k2 FROM a WHERE k2 <> '' AND k2 NOT IN ({_GENERIC})),
p AS (SELECT * FROM (SELECT lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS l, doc_id AS r FROM documents) WHERE l IS NOT NULL),
sh AS (SELECT p.l, p.r, count(*) AS n, min(x.k) AS one FROM p JOIN ks x ON x.doc_id = p.l JOIN ks y ON y.doc_id = p.r AND x.k = y.k GROUP BY p.l, p.r),
i AS (SELECT p.l, p.r, count(*) AS k FROM p JOIN tok u ON u.doc_id = p.l JOIN tok v ON v.doc_id = p.r AND u.w = v.w GROUP BY p.l, p.r), c AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id),
f AS (SELECT p.l, p.r, x.lang = y.lang AS cat, coalesce(sh.n, 0) AS n, sh.one, abs(x.d - y.d) AS days, (x.ct = 3) <> (y.ct = 3) OR (x.ct = 1 AND y.ct = 2) OR (x.ct = 2 AND y.ct = 1) AS bound, (x.ct = 4) = (y.ct = 4) AS fam,
 CASE WHEN coalesce(cx.n, 0) + coalesce(cy.n, 0) = 0 THEN 0.0 ELSE coalesce(i.k, 0) / (coalesce(cx.n, 0) + coalesce(cy.n, 0) - coalesce(i.k, 0)) END AS o
 FROM p JOIN a x ON x.doc_id = p.l JOIN a y ON y.doc_id = p.r LEFT JOIN sh ON sh.l = p.l AND sh.r = p.r LEFT JOIN i ON i.l = p.l AND i.r = p.r LEFT JOIN c cx ON cx.doc_id = p.l LEFT JOIN c cy ON cy.doc_id = p.r)
SELECT l AS left_id, r AS right_id, CAST(n AS INT) AS n_shared, round(o, 6) AS overlap,
CASE WHEN NOT cat THEN 'different-event/high/category-mismatch' WHEN n > 0 AND bound THEN 'related-not-merge/high/protected-content-boundary' WHEN n >= 2 AND days <= 2 THEN 'same-event-candidate/high/multiple-shared-entities'
WHEN n = 1 AND one NOT IN ({_BROAD}) AND fam AND days <= 1 THEN 'same-event-candidate/medium/single-shared-entity-same-family' WHEN n = 1 AND one IN ({_BROAD}) THEN 'uncertain/low/broad-single-entity,insufficient-evidence'
WHEN n = 0 AND o < 0.2 THEN 'different-event/medium/no-shared-entity,weak-title-overlap' WHEN n = 0 AND days > 7 THEN 'different-event/medium/no-shared-entity,date-outside-window' ELSE 'uncertain/low/insufficient-evidence' END AS decision FROM f""")
def event_relation(spark, sf_dir):
    decided = relations.relate(_neighbours(spark, sf_dir), _relation_articles(spark, sf_dir))
    said = F.concat_ws("/", "decision.relation", "decision.confidence", F.array_join("decision.reasons", ","))
    return decided.select("left_id", "right_id", F.size("decision.signals.shared_entities").alias("n_shared"), F.round("decision.signals.title_token_overlap", 6).alias("overlap"), said.alias("decision"))


@query(f"""WITH {_TOKENS}, a AS (SELECT doc_id, lang, trim(regexp_replace(regexp_replace({_KEY}, '\\b(?:19|20)\\d{{2}}\\b', '', 'g'), ' +', ' ', 'g')) AS k1, {s.fold('source')} AS k2 FROM documents),
ks AS (SELECT doc_id, lang, k1 AS k FROM a WHERE k1 <> '' AND k1 NOT IN ({_GENERIC}) UNION SELECT doc_id, lang, k2 FROM a WHERE k2 <> '' AND k2 NOT IN ({_GENERIC})),
c AS (SELECT doc_id, count(*) AS n FROM tok GROUP BY doc_id),
near AS (SELECT u.doc_id AS l, v.doc_id AS r, count(*) AS k FROM tok u JOIN tok v ON u.w = v.w AND u.doc_id < v.doc_id JOIN a x ON x.doc_id = u.doc_id JOIN a y ON y.doc_id = v.doc_id AND x.lang = y.lang GROUP BY 1, 2)
SELECT l AS left_id, r AS right_id FROM near JOIN c x ON x.doc_id = l JOIN c y ON y.doc_id = r WHERE k / (x.n + y.n - k) >= 0.2
UNION SELECT x.doc_id, y.doc_id FROM ks x JOIN ks y ON x.lang = y.lang AND x.k = y.k AND x.doc_id < y.doc_id""")
def relation_candidates(spark, sf_dir):
    """All pairs of a language that the decision rules can link, without comparing all pairs."""
    return relations.candidate_pairs(_relation_articles(spark, sf_dir))


_LISTED = "pc AS (SELECT doc_id AS c, doc_id + a AS l, doc_id + b AS r FROM labels, (VALUES (0, 1), (0, 3), (1, 3)) v(a, b)), p AS (SELECT DISTINCT l, r FROM pc)"
_EVERY = "p AS (SELECT * FROM (SELECT lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS l, doc_id AS r FROM documents) WHERE l IS NOT NULL)"
_DECIDED = SQL["event_relation"].replace(_EVERY, _LISTED).replace("SELECT l AS left_id", ", dec AS (SELECT l AS left_id")


@query(f"""{_DECIDED}) SELECT c AS case_id, pc.l AS left_id, pc.r AS right_id, dec.decision, CASE WHEN pc.l NOT IN (SELECT doc_id FROM documents) THEN 'Unknown article: ' || pc.l WHEN pc.r NOT IN (SELECT doc_id FROM documents) THEN 'Unknown article: ' || pc.r END AS error
FROM pc LEFT JOIN dec ON dec.left_id = pc.l AND dec.right_id = pc.r""")
def case_pair_decisions(spark, sf_dir):
    """Labelled documents as cases of three articles each: the document, the next and the third after it, where they exist."""
    cases = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("case_id"), F.array("doc_id", F.col("doc_id") + 1, F.col("doc_id") + 3).alias("article_ids"))
    decided = relations.relate(relations.case_pairs(cases), _relation_articles(spark, sf_dir))
    said = F.concat_ws("/", "decision.relation", "decision.confidence", F.array_join("decision.reasons", ","))
    return decided.select("case_id", "left_id", "right_id", F.when(F.col("error").isNull(), said).alias("decision"), "error")


_CASES = "cases AS (SELECT doc_id AS case_id, ['same-event', 'related-subevent', 'hard-negative', 'uncertainty', 'numeric-fact', 'developing-story'][doc_id % 6 + 1] AS kind, CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'accepted' ELSE 'provisional' END AS label_status FROM labels)"
_ROLLED = f"""{_CASES}, dec AS (SELECT doc_id - doc_id % 3 AS case_id, ['same-event-candidate', 'related-not-merge', 'different-event', 'uncertain'][n_chars % 4 + 1] AS rel FROM documents),
k AS (SELECT *, CASE kind WHEN 'same-event' THEN 'same-event-candidate' WHEN 'related-subevent' THEN 'related-not-merge' WHEN 'hard-negative' THEN 'different-event' END AS expected_relation FROM cases),
rolled AS (SELECT k.case_id, any_value(kind) AS kind, any_value(label_status) AS label_status, any_value(expected_relation) AS expected_relation, CASE WHEN count(DISTINCT rel) = 1 THEN min(rel) ELSE 'mixed' END AS predicted_relation, coalesce(bool_and(rel = expected_relation), true) AS matches_expected
FROM k LEFT JOIN dec USING (case_id) WHERE expected_relation IS NOT NULL GROUP BY k.case_id)"""


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*(F.lit(k) for k in evaluation.KINDS))
    status = F.when(F.col("toxic") == 1, "rejected").when(F.col("quality") == 1, "accepted").otherwise("provisional")
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("case_id"), F.element_at(kinds, (F.col("doc_id") % 6 + 1).cast("int")).alias("kind"), status.alias("label_status"))


def _rolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*(F.lit(k) for k in ("same-event-candidate", "related-not-merge", "different-event", "uncertain")))
    decided = table(spark, sf_dir, "documents").select(F.expr("doc_id - doc_id % 3").alias("case_id"), F.element_at(names, (F.col("n_chars") % 4 + 1).cast("int")).alias("relation"))
    return evaluation.roll_up(_cases(spark, sf_dir), decided)


@query(f"WITH {_ROLLED} SELECT * FROM rolled")
def case_rollup(spark, sf_dir):
    """Labels as cases, documents as decided pairs."""
    return _rolled(spark, sf_dir)


@query(f"""WITH {_ROLLED} SELECT count(*) AS evaluated_cases, count_if(kind = 'hard-negative' AND NOT matches_expected) AS hard_negative_failures, count_if(label_status = 'accepted') AS accepted_cases, count_if(label_status = 'accepted' AND matches_expected) AS accepted_matches,
count_if(label_status = 'accepted' AND NOT matches_expected) AS accepted_mismatches, count_if(label_status = 'provisional') AS provisional_cases, count_if(label_status = 'provisional' AND matches_expected) AS provisional_matches, count_if(label_status = 'provisional' AND NOT matches_expected) AS provisional_mismatches,
(SELECT count(*) FROM cases) - count(*) AS skipped_cases FROM rolled""")
def evaluation_summary(spark, sf_dir):
    return evaluation.summary(_rolled(spark, sf_dir), _cases(spark, sf_dir))


@query(f"WITH {_ROLLED} SELECT case_id FROM rolled WHERE NOT matches_expected AND (label_status IN ('accepted', 'provisional') OR kind = 'hard-negative')")
def blocking_cases(spark, sf_dir):
    return evaluation.blocking(_rolled(spark, sf_dir), strict=True)


@query(f"""WITH {_ROLLED}, g AS (SELECT count(*) AS total, CAST(count_if(matches_expected OR NOT (label_status IN ('accepted', 'provisional') OR kind = 'hard-negative')) AS BIGINT) AS passed FROM rolled)
SELECT passed, total, CAST(passed < total AS INT) AS exit_code FROM g""")
def gate_counts(spark, sf_dir):
    return evaluation.gate_counts(_rolled(spark, sf_dir), strict=True)


_INVENTORY = f"""{_CASES}, art AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'technology' WHEN 'fr' THEN 'sports' END AS category, source FROM documents),
inv AS (SELECT 'category' AS dimension, v AS value, (SELECT count(*) FROM art WHERE category = v) AS n FROM (SELECT unnest(['technology', 'entertainment', 'sports']) AS v)
UNION ALL SELECT 'case_kind', v, (SELECT count(*) FROM cases WHERE kind = v) FROM (SELECT unnest(['same-event', 'related-subevent', 'hard-negative', 'uncertainty', 'numeric-fact', 'developing-story']) AS v)
UNION ALL SELECT 'label_status', v, (SELECT count(*) FROM cases WHERE label_status = v) FROM (SELECT unnest(['provisional', 'accepted', 'rejected']) AS v)
UNION ALL SELECT 'multi_source', 'same-event', (SELECT count(*) FROM cases c JOIN art x ON x.doc_id = c.case_id JOIN art y ON y.doc_id = c.case_id + 1 WHERE kind = 'same-event' AND x.source <> y.source))"""


def _inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case lists its document and the next."""
    docs = table(spark, sf_dir, "documents")
    articles = docs.select(F.col("doc_id").alias("id"), F.when(F.col("lang") == "en", "technology").when(F.col("lang") == "fr", "sports").alias("category"), F.col("source").alias("source_id"))
    cases = _cases(spark, sf_dir).withColumn("article_ids", F.array("case_id", F.col("case_id") + 1))
    return evaluation.inventory(cases, articles)


@query(f"WITH {_INVENTORY} SELECT dimension, value, n FROM inv")
def inventory_counts(spark, sf_dir):
    return _inventory(spark, sf_dir)


@query(f"""WITH {_INVENTORY}, v AS (SELECT CAST(sum(n) FILTER (dimension = 'category') AS BIGINT) AS a, CAST(sum(n) FILTER (dimension = 'case_kind') AS BIGINT) AS c FROM inv)
SELECT CAST(pos AS INT) AS pos, name || ' ' || n || ' is below ' || least AS issue FROM (SELECT 0 AS pos, 'articleCount' AS name, a AS n, 30 AS least FROM v
UNION ALL SELECT 1, 'technology article count', n, 10 FROM inv WHERE value = 'technology' UNION ALL SELECT 2, 'entertainment article count', n, 10 FROM inv WHERE value = 'entertainment' UNION ALL SELECT 3, 'sports article count', n, 10 FROM inv WHERE value = 'sports'
UNION ALL SELECT 4, 'caseCount', c, 14 FROM v UNION ALL SELECT 5, 'multiSourceSameEventCases', n, 4 FROM inv WHERE dimension = 'multi_source' UNION ALL SELECT 6, 'hardNegativeCases', n, 4 FROM inv WHERE value = 'hard-negative' UNION ALL SELECT 7, 'uncertaintyCases', n, 2 FROM inv WHERE value = 'uncertainty') WHERE n < least""")
def coverage_policy(spark, sf_dir):
    return evaluation.coverage_issues(_inventory(spark, sf_dir))


@query("SELECT case_id, count(DISTINCT source) AS sources FROM (SELECT sha256(text) AS case_id, source FROM documents) GROUP BY case_id HAVING count(DISTINCT source) >= 2")
def multi_source_cases(spark, sf_dir):
    """Documents of one text as a case."""
    docs = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("case_id"), "doc_id", "source")
    cases = docs.groupBy("case_id").agg(F.collect_list("doc_id").alias("article_ids")).withColumn("kind", F.lit("same-event"))
    return evaluation.multi_source_cases(cases, docs.select(F.col("doc_id").alias("id"), F.col("source").alias("source_id"))).select("case_id", "sources")


# --- manifests and citations ---------------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT CAST(page_id AS INT) AS index, CAST(page_id AS VARCHAR) AS id, url, CASE WHEN page_id % 9 = 0 THEN '2024-02-30' ELSE '2024-02-28' END AS d, CASE WHEN page_id % 5 = 0 THEN '' ELSE 'title' END AS title, CASE WHEN page_id % 4 = 0 THEN 'other' ELSE 'sports' END AS c FROM pages)
SELECT index, 1 AS pos, 'articles[' || index || '].category is unsupported' AS issue FROM a WHERE c = 'other' UNION ALL SELECT index, 3, 'articles[' || index || '].title must be a non-empty string' FROM a WHERE title = ''
UNION ALL SELECT index, 5, 'articles[' || index || '].canonicalUrl must be HTTPS' FROM a WHERE url NOT LIKE 'https:%' UNION ALL SELECT index, 7, 'articles[' || index || '].observedDate must use YYYY-MM-DD' FROM a WHERE d = '2024-02-30'""")
def manifest_issues(spark, sf_dir):
    """Pages as manifest articles."""
    rows = table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("int").alias("index"), F.col("page_id").cast("string").alias("id"), F.expr("if(page_id % 4 = 0, 'other', 'sports')").alias("category"), F.lit("s").alias("sourceId"), F.expr("if(page_id % 5 = 0, '', 'title')").alias("title"),
        F.col("url").alias("canonicalUrl"), F.expr("if(page_id % 9 = 0, '2024-02-30', '2024-02-28')").alias("observedDate"), F.lit("page-fetched").alias("verification"), F.lit("report").alias("contentType"), F.array(F.lit("x")).alias("entities"), F.lit("none").alias("uncertainty"),
    )
    return manifest.article_issues(rows)


@query("SELECT DISTINCT o_orderkey AS case_id, x AS id FROM (SELECT o_orderkey, unnest([o_custkey, o_custkey + 900]) AS x FROM orders) WHERE x NOT IN (SELECT c_custkey FROM customer)")
def unknown_references(spark, sf_dir):
    """Orders as cases, customers as articles."""
    cases = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.array("o_custkey", F.col("o_custkey") + 900).alias("article_ids"))
    return evaluation.unknown_references(cases, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")))


@query("""WITH k AS (SELECT CAST(event_id AS VARCHAR) AS summary_id, json_keys(props) AS keys FROM events), f AS (SELECT unnest(['articleId', 'articleVersionId', 'claimIds']) AS name)
SELECT summary_id, 'unknown-field' AS code, '$.' || key AS path FROM (SELECT summary_id, unnest(keys) AS key FROM k) WHERE key NOT IN (SELECT name FROM f)
UNION ALL SELECT summary_id, code, '$.' || name FROM k, f, (SELECT unnest(['missing-field', 'invalid-type']) AS code) WHERE NOT list_contains(keys, name)""")
def json_closed_keys(spark, sf_dir):
    """Event properties held against the closed shape of a citation."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("summary_id"), F.lit("$").alias("path"), F.try_parse_json("props").alias("v"))
    return citations.record_issues(rows, "citation")


@query("""WITH c AS (SELECT l_orderkey AS o, l_linenumber AS n, 'a' || l_suppkey AS a, 'c' || l_partkey AS k FROM lineitem),
p AS (SELECT CASE WHEN p_partkey % 4 = 0 THEN 'x' ELSE 'c' END || p_partkey AS k, 'a' || (p_partkey % 100 + 1) AS a, CASE WHEN p_size % 10 = 0 THEN 'disabled' ELSE 'active' END AS st, 'p' || (p_partkey % 3) AS prop FROM part),
v AS (SELECT CASE WHEN s_suppkey % 9 = 0 THEN 'b' ELSE 'a' END || s_suppkey AS a, CASE WHEN s_nationkey = 3 THEN 'disabled' ELSE 'active' END AS st FROM supplier),
j AS (SELECT c.*, p.k IS NULL AS lost, p.st, p.a AS pa, p.prop FROM c LEFT JOIN p ON p.k = c.k),
g AS (SELECT o, count(DISTINCT prop) AS props, bool_or(prop = 'p1') AS has FROM j WHERE NOT lost GROUP BY o)
SELECT code, count(*) AS n FROM (SELECT 'unknown-article-version' AS code FROM c LEFT JOIN v ON v.a = c.a WHERE v.a IS NULL UNION ALL SELECT 'disabled-article-version' FROM c JOIN v ON v.a = c.a WHERE v.st <> 'active'
UNION ALL SELECT 'unknown-claim' FROM j WHERE lost UNION ALL SELECT 'disabled-claim' FROM j WHERE st <> 'active' UNION ALL SELECT 'claim-provenance-mismatch' FROM j WHERE NOT lost AND pa <> a
UNION ALL SELECT 'duplicate-claim-reference' FROM (SELECT row_number() OVER (PARTITION BY o, k ORDER BY n) AS r FROM c) WHERE r > 1 UNION ALL SELECT 'duplicate-citation' FROM (SELECT row_number() OVER (PARTITION BY o, a, k ORDER BY n) AS r FROM c) WHERE r > 1
UNION ALL SELECT 'claim-set-mismatch' FROM (SELECT o, count(*) AS x, count(DISTINCT k) AS y FROM c GROUP BY o) WHERE x <> y UNION ALL SELECT 'mixed-proposition' FROM g WHERE props <> 1 UNION ALL SELECT 'proposition-mismatch' FROM g WHERE props <> 1 OR NOT has) GROUP BY code""")
def citation_issues(spark, sf_dir):
    """Orders as sentences, lines as their citations, parts as claims, suppliers as article versions; every fourth claim and ninth version has another key."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("a"), F.col("l_suppkey").cast("string")).alias("a"), F.concat(F.lit("c"), F.col("l_partkey").cast("string")).alias("k"))
    cited = F.sort_array(F.collect_list(F.struct("l_linenumber", F.struct(F.col("a").alias("articleId"), F.lit("v").alias("articleVersionId"), F.array("k").alias("claimIds")).alias("c"))))
    rows = lines.groupBy("l_orderkey").agg(cited.alias("x"))
    assertion = F.struct(F.lit("p1").alias("propositionId"), F.lit("uncertain").alias("epistemicStatus"), F.lit("affirmed").alias("polarity"), *(F.array().cast("array<string>").alias(n) for n in ("entities", "numbers", "times")))
    sentence = F.struct(F.lit("s").alias("id"), F.lit("bullet").alias("kind"), F.lit("t").alias("text"), F.flatten(F.col("x.c.claimIds")).alias("claimIds"), F.col("x.c").alias("citations"), assertion.alias("assertion"))
    summaries = rows.select(F.col("l_orderkey").cast("string").alias("summary_id"), F.lit("snap").alias("snapshot_id"), F.to_json(F.struct(F.array(sentence).alias("sentences"))).alias("body"))
    versions_ = table(spark, sf_dir, "supplier").select(F.lit("snap").alias("snapshot_id"), F.expr("concat(if(s_suppkey % 9 = 0, 'b', 'a'), s_suppkey)").alias("article_id"), F.lit("v").alias("article_version_id"), F.expr("if(s_nationkey = 3, 'disabled', 'active')").alias("state"))
    claims = table(spark, sf_dir, "part").select(
        F.lit("snap").alias("snapshot_id"), F.expr("concat(if(p_partkey % 4 = 0, 'x', 'c'), p_partkey)").alias("claim_id"), F.expr("concat('a', p_partkey % 100 + 1)").alias("article_id"), F.lit("v").alias("article_version_id"), F.expr("if(p_size % 10 = 0, 'disabled', 'active')").alias("state"),
        F.expr("concat('p', p_partkey % 3)").alias("proposition_id"), F.lit("reported").alias("epistemic_status"), F.lit("affirmed").alias("polarity"), F.array().cast("array<string>").alias("entities"),
        F.array().cast("array<struct<key:string,value:string,unit:string,currency:string,scale:string>>").alias("numbers"), F.array().cast("array<struct<key:string,value:string,role:string>>").alias("times"),
    )
    return citations.sentence_issues(summaries, versions_, claims).groupBy("code").agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT l_orderkey, list('s' || l_suppkey) AS l, list(DISTINCT 's' || (l_partkey % 100 + 1)) AS r FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, len(l) <> len(r) OR NOT list_has_all(r, l) AS mismatch FROM a""")
def claim_set_mismatch(spark, sf_dir):
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.expr("concat('s', l_suppkey)")).alias("l"), F.collect_set(F.expr("concat('s', l_partkey % 100 + 1)")).alias("r"))
    return lists.select("l_orderkey", (~citations.same_strings(F.col("l"), F.col("r"))).alias("mismatch"))


_PAIR = "CASE {0} WHEN 'R' THEN 'confirmed' WHEN 'A' THEN 'reported' WHEN 'N' THEN 'rumor' WHEN 'F' THEN 'reported' ELSE 'uncertain' END"


@query(f"""SELECT x AS claim_status, y AS asserted_status, x <> y AND y <> 'uncertain' AND NOT (x = 'confirmed' AND y = 'reported') AS upgrade, count(*) AS n
FROM (SELECT {_PAIR.format('l_returnflag')} AS x, {_PAIR.format('l_linestatus')} AS y FROM lineitem) GROUP BY ALL""")
def epistemic_upgrade(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").select(F.expr(_PAIR.format("l_returnflag")).alias("claim_status"), F.expr(_PAIR.format("l_linestatus")).alias("asserted_status"))
    allowed = spark.createDataFrame(citations.DOWNGRADES, "claim_status string, asserted_status string").withColumn("ok", F.lit(True))
    counted = pairs.groupBy("claim_status", "asserted_status").agg(F.count("*").alias("n"))
    return counted.join(allowed, ["claim_status", "asserted_status"], "left").select("claim_status", "asserted_status", F.col("ok").isNull().alias("upgrade"), "n")


@query("SELECT doc_id, round(length(text) / nullif(n_chars - n_chars % 7, 0), 3) AS length_ratio, sha256(text) = sha256(trim(text)) AS same_hash FROM documents")
def direct_vs_browser(spark, sf_dir):
    c = routing.compare_direct(F.expr("n_chars - n_chars % 7"), F.length("text"), F.sha2("text", 256), F.sha2(F.trim("text"), 256))
    return table(spark, sf_dir, "documents").select("doc_id", c.alias("c")).select("doc_id", "c.*")


@query(f"""SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'quota; slow' WHEN {s.utf16(s.trim('text'))} < 250 THEN 'Browser text is too short' END AS error, CASE WHEN doc_id % 11 > 0 AND {s.utf16(s.trim('text'))} >= 250 THEN sha256({s.trim('text')}) END AS content_hash FROM documents""")
def browser_envelope(spark, sf_dir):
    """Texts wrapped into a service's JSON answers, as a string, .markdown or .content; some report errors."""
    docs = table(spark, sf_dir, "documents")
    wrap = lambda name: F.to_json(F.struct(F.lit(True).alias("success"), F.struct(F.col("text").alias(name)).alias("result")))
    plain = F.to_json(F.struct(F.lit(True).alias("success"), F.col("text").alias("result")))
    failed = F.lit('{"success": false, "errors": [{"code": 1, "message": " quota "}, {"message": ""}, {"message": "slow"}]}')
    body = F.when(F.col("doc_id") % 11 == 0, failed).when(F.col("doc_id") % 3 == 0, plain).when(F.col("doc_id") % 3 == 1, wrap("markdown")).otherwise(wrap("content"))
    return docs.select("doc_id", routing.envelope(body).alias("e")).select("doc_id", "e.error", "e.content_hash")


def queries() -> dict[str, Callable]:
    from . import composed  # noqa: F401 - registers its queries

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
