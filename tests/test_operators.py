"""Behaviour that the test tables do not reach."""

import json

import pytest
from pyspark.sql import functions as F

from quillstream.functions import text as t
from quillstream.operators import citations, diagnostics, evaluation, feeds, html, manifest, relations, routing, versions
from quillstream.sources import http, registry, tables


def values(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], schema).select(column).collect()]


def test_text_primitives(spark):
    x = F.col("x")
    assert values(spark, t.decode_html(x), ["&amp;#234;", "&#234;&#x1F600;&nbsp;|", "&copy;&#xD800;&#99999999;", "a & b", None]) == ["&#234;", "ê\U0001f600 |", "&copy;&#xD800;&#99999999;", "a & b", None]
    assert values(spark, t.decode_repeatedly(x), ["&amp;amp;#234;  x﻿"]) == ["ê x"]
    assert values(spark, t.collapse(x), ["  a 　b\u0085 "]) == ["a b\u0085"]
    assert values(spark, t.utf16_length(x), ["😀a", ""]) == [3, 0]
    assert values(spark, t.fold(x), ["Đội tuyển Việt Nam, 2026!", "é́Ñ ß", "Kİ"]) == ["doi tuyen viet nam 2026", "en", "ki"]
    assert values(spark, t.tidy_lines(x), [" a \r\n\n\n\n  b  c "]) == ["a\n\nb c"]


def test_feeds(spark):
    rss = "<rss><channel><title><![CDATA[A &amp; <b>B</b>]]></title><item><title>T</title><link>l</link><pubDate>Mon, 02 Feb 2026 10:00:00 GMT</pubDate></item><item><title>x</title></item><item><title>U</title><link>m</link><pubDate>2026-02-30</pubDate></item></channel></rss>"
    atom = "<feed><title>F</title><entry><title>T</title><link href='no'/><link href='yes' type='x' rel='alternate'/><updated>2026-01-01T00:00:00Z</updated><id>g</id></entry></feed>"
    rows = spark.createDataFrame([("r", rss), ("a", atom), ("h", "<html/>"), ("n", "{}"), ("e", "<rss></rss>"), ("0", None)], "source_id string, body string")
    got = {r.source_id: r for r in feeds.inspect_feeds(rows).collect()}
    assert (got["r"].ok, got["r"].title, got["r"].item_count, got["r"].latest_published_at) == (True, "A & B", 2, "Mon, 02 Feb 2026 10:00:00 GMT")
    assert got["a"].format == "atom" and got["a"].latest_published_at == "2026-01-01T00:00:00Z"
    assert {k: got[k].error for k in "hne"} == {"h": "Unsupported XML feed root", "n": "Feed response is not XML", "e": "No valid item entries found"}
    assert [r.link for r in feeds.feed_items(rows.where("source_id = 'a'")).collect()] == ["yes"]


def fixture_pages(spark):
    line = "Một đoạn văn đủ dài để vượt qua ngưỡng của bộ lọc đoạn văn, và còn dài hơn nữa cho chắc. "
    ld = '{"@context": "x", "@graph": [{"@type": "WebPage"}, {"@type": ["NewsArticle"], "headline": "Tiêu đề &amp;amp; phụ", "articleBody": "' + line * 4 + '", "author": [{"name": "An"}, "Bình"], "datePublished": "2026-01-02"}]}'
    rows = [
        (1, "VnExpress", "https://vnexpress.net/a", f'<html><head><title>T</title><script type="application/ld+json">{ld}</script></head></html>'),
        (2, "Tuổi Trẻ", "https://tuoitre.vn/b", "<title>B</title><div class='detail-content afcbc-body'><div><p>" + line + "</p></div><p>" + line * 3 + "</p><div class='box-related'><p>" + line + "</p></div></div><footer><p>" + line + "</p></footer>"),
        (3, "Thanh Niên", "https://thanhnien.vn/c", '<meta content="Từ meta" property="og:title"><meta name="author" content="THANH NIÊN"><link rel="canonical" href="/c-chuan"><article>' + f"<p>{line}</p>" * 32 + "</article>"),
        (4, "Thanh Niên", "http://thanhnien.vn/d", "<title>short</title><p>x</p>"),
    ]
    return spark.createDataFrame(rows, "page_id long, publisher string, url string, html string")


def normalized_articles(spark):
    found = html.extract_articles(fixture_pages(spark))
    hosts = F.element_at(F.create_map(*(x for k, v in html.PUBLISHER_HOSTS.items() for x in (F.lit(k), F.array(*map(F.lit, v))))), F.col("publisher"))
    return found.select("page_id", "title", "author", "author_status", "extraction_strategy", "paragraph_count", "text_length", "content_hash", "quality_decision", F.array_join("quality_warnings", ",").alias("warnings"), "error", html.canonical_url(F.col("url"), F.col("canonical_candidate"), hosts).alias("canonical_url"))


def test_articles(spark):
    got = {r.page_id: r for r in normalized_articles(spark).collect()}
    assert got[1].title == "Tiêu đề & phụ" and got[1].author == "An, Bình" and got[1].extraction_strategy == "json-ld"
    assert got[2].extraction_strategy == "publisher-container" and got[2].paragraph_count == 2 and got[2].quality_decision == "ready"
    assert got[3].title == "Từ meta" and got[3].author is None and got[3].warnings == "high-paragraph-count,publisher-reported-as-author" and got[3].quality_decision == "fallback-required"
    assert got[3].canonical_url == "https://thanhnien.vn/c-chuan"
    assert got[4].quality_decision == "failed" and got[4].error
    assert html.balanced('<div class="a b"><div>x</div>y</div>z', "div", ("a", "b")) == "<div>x</div>y"
    assert html.balanced('<div class="a"><div>', "div", ("a",)) is None
    assert html.without_noise('<div class="uploads x">k</div><p>t</p>') == '<div class="uploads x"> </div><p>t</p>'


def test_relation_rules(spark):
    a = ("technology", "Google ra mắt dịch vụ bản đồ", "2026-08-01", "policy", ["Google Earth"])
    rows = [
        ("1", *a), ("2", *a[:4], ["Google Earth 2026", "AI"]), ("3", "sports", *a[1:]), ("4", *a[:3], "reaction", a[4]), ("5", *a[:4], ["Đội tuyển Việt Nam"]), ("6", *a[:4], ["Việt Nam"]),
        ("7", "technology", "khác hẳn nhau", "x", "policy", []), ("8", a[0], a[1], "2026-09-01", "policy", []), ("9", a[0], a[1], "2026-08-02", "policy", []),
    ]
    articles = spark.createDataFrame(rows, "id string, category string, title string, observed_date string, content_type string, entities array<string>")
    pairs = [("1", "2"), ("1", "3"), ("1", "4"), ("5", "6"), ("1", "7"), ("1", "8"), ("1", "9")]
    both = spark.createDataFrame(pairs + [(b, x) for x, b in pairs], "left_id string, right_id string")
    got = {(r.left_id, r.right_id): (r.decision.relation, r.decision.reasons[0]) for r in relations.relate(both, articles).collect()}
    want = ["single-shared-entity-same-family", "category-mismatch", "protected-content-boundary", "broad-single-entity", "no-shared-entity", "no-shared-entity", "insufficient-evidence"]
    assert [got[p][1] for p in pairs] == want and all(got[a, b] == got[b, a] for a, b in pairs)
    assert got["1", "8"][0] == "different-event" and got["1", "9"][0] == "uncertain"


def test_versions_replay_and_links(spark):
    rows = [
        (1, "s1", "k", "u1", "h1"), (2, "s1", "k", "u1", "h2"), (3, "s1", "k", "u1", "h1"), (4, "s2", None, "u1", "h1"), (5, "s1", "k", "u2", "h1"), (6, "s3", "", "u2", "h3"), (7, "s1", "", "u9", "h9"), (8, "s1", None, "u2", "h3"), (9, "nope", None, "u3", "h"),
    ]
    frame = spark.createDataFrame([(*r, r[0], "ready") for r in rows], "seq long, source_id string, source_article_id string, canonical_url string, content_hash string, observed_at long, quality_decision string")
    out = versions.persist(frame, spark.createDataFrame([("s1",), ("s2",), ("s3",)], "id string"))
    got = {r.seq: (r.outcome, r.version_number) for r in out["results"].collect()}
    assert got == {1: ("created", 1), 2: ("version-appended", 2), 3: ("version-appended", 3), 4: ("unchanged", 3), 5: ("unchanged", 3), 6: ("version-appended", 4), 7: ("created", 1), 8: ("unchanged", 4)}
    assert [r.seq for r in out["rejected"].collect()] == [9] and out["articles"].count() == 2
    links = {(r.source_id): (r.source_article_id, r.first_seen_at, r.last_seen_at) for r in out["article_sources"].collect() if r.last_seen_at != 7}
    assert links["s1"] == (None, 1, 8)


def test_policies(spark):
    rows = spark.createDataFrame([("queued", "running"), ("running", "queued")], "current string, following string")
    assert [r.current for r in routing.invalid_transitions(rows).collect()] == ["running"]
    with pytest.raises(ValueError):
        routing.with_budget(rows, ["current"], ["following"], -1)
    tries = []

    def act():
        tries.append(1)
        if len(tries) < 3:
            raise KeyError("40001")
        return "done"

    assert routing.with_retry(act, lambda e: True, sleep=lambda s: None) == "done" and len(tries) == 3
    assert routing.retry_schedule() == [10, 20]


def test_manifest(spark):
    body = '{"schemaVersion": "2.0.0", "datasetVersion": "d", "generatedAt": "g", "legalBoundary": "", "articles": [{"id": "A", "category": "sports", "sourceId": "s", "title": "t", "canonicalUrl": "https://x/", "observedDate": "2026-01-01", "verification": "page-fetched", "contentType": "c", "entities": ["e"], "uncertainty": "none"}], "cases": [{"id": "C", "kind": "same-event", "articleIds": ["A", "B"], "expectedRelation": "same-event", "evaluationFocus": "f", "knownUncertainty": "u", "labelProvenance": {"status": "accepted", "method": "project-seed", "reviewedBy": [], "notes": "n"}}]}'
    parsed = manifest.parse(spark.createDataFrame([(body,)], "body string"))
    issues = [r.issue for r in manifest.validate(parsed).orderBy("part", "index", "pos").collect()]
    assert issues == [
        "legalBoundary must be a non-empty string", "cases[0] accepted labels require human-review provenance", "cases[0] accepted labels require at least one reviewer",
        "cases[0] accepted labels require reviewedAt", "cases[0].articleIds references unknown article B",
    ]
    assert [r.issue for r in manifest.semantic_issues(manifest.cases_of(parsed), manifest.articles_of(parsed)).collect()] == ["C same-event case requires expectedClusterId"]


def test_evaluation_keeps_labels_apart(spark):
    cases = spark.createDataFrame([(1, "same-event", "accepted"), (2, "hard-negative", "provisional"), (3, "uncertainty", "accepted"), (4, "same-event", "rejected")], "case_id long, kind string, label_status string")
    decided = spark.createDataFrame([(1, "same-event-candidate"), (1, "uncertain"), (2, "same-event-candidate")], "case_id long, relation string")
    rolled = evaluation.roll_up(cases, decided)
    got = {r.case_id: (r.predicted_relation, r.matches_expected) for r in rolled.collect()}
    assert got == {1: ("mixed", False), 2: ("same-event-candidate", False), 4: ("mixed", True)}
    assert sorted(r.case_id for r in evaluation.blocking(rolled).collect()) == [1, 2]
    row = evaluation.summary(rolled, cases).first()
    assert (row.evaluated_cases, row.skipped_cases, row.hard_negative_failures, row.accepted_mismatches) == (3, 1, 1, 1)


def summary_fixture(spark):
    citation = {"articleId": "a1", "articleVersionId": "v1", "claimIds": ["c1"]}
    assertion = {"propositionId": "p1", "epistemicStatus": "reported", "polarity": "affirmed", "entities": ["E"], "numbers": [{"key": "n", "value": "90", "unit": "x", "scale": "unit"}], "times": []}
    base = {"schemaVersion": citations.SUMMARY_SCHEMA, "snapshotId": "s", "snapshotVersion": 1, "sentences": [{"id": "1", "kind": "one-line", "text": "t", "claimIds": ["c1"], "citations": [citation], "assertion": assertion}]}

    def changed(edit):
        copy = json.loads(json.dumps(base))
        edit(copy)
        return json.dumps(copy)

    first = lambda c: c["sentences"][0]
    rows = [
        ("valid", json.dumps(base)), ("no-json", "{"), ("extra", changed(lambda c: c.update(more=1))), ("lost", changed(lambda c: c.pop("snapshotId"))), ("enum", changed(lambda c: first(c).update(kind="x"))),
        ("upgrade", changed(lambda c: first(c)["assertion"].update(epistemicStatus="confirmed"))), ("number", changed(lambda c: first(c)["assertion"]["numbers"][0].update(value="90.0"))), ("format", changed(lambda c: first(c)["assertion"]["numbers"][0].update(value="09"))),
        ("version", changed(lambda c: c.update(snapshotVersion=2))), ("claim", changed(lambda c: first(c)["citations"][0].update(claimIds=["c9"]))), ("twice", changed(lambda c: c["sentences"].append(first(c)))), ("empty", changed(lambda c: c.update(sentences=[]))),
    ]
    summaries = spark.createDataFrame([(k, "s", b) for k, b in rows], "summary_id string, snapshot_id string, body string")
    snapshots = spark.createDataFrame([("s", citations.SNAPSHOT_SCHEMA, 1)], "snapshot_id string, schema_version string, snapshot_version int")
    versions_ = spark.createDataFrame([("s", 0, "a1", "v1", "active")], "snapshot_id string, pos int, article_id string, article_version_id string, state string")
    claims = spark.createDataFrame(
        [("s", 0, "c1", "a1", "v1", "active", "p1", "reported", "affirmed", ["E"], [("n", "90", "x", None, "unit")], [])],
        "snapshot_id string, pos int, claim_id string, article_id string, article_version_id string, state string, proposition_id string, epistemic_status string, polarity string, entities array<string>, "
        "numbers array<struct<key:string,value:string,unit:string,currency:string,scale:string>>, times array<struct<key:string,value:string,role:string>>",
    )
    return summaries, snapshots, versions_, claims


def test_summaries(spark):
    found = {}
    for r in citations.validate(*summary_fixture(spark)).collect():
        found.setdefault(r.summary_id, set()).add(r.code)
    assert "valid" not in found
    assert found["no-json"] == {"invalid-type"} and found["extra"] == {"unknown-field"} and found["enum"] == {"invalid-enum"} and found["upgrade"] == {"epistemic-upgrade"}
    assert found["number"] == {"unsupported-number"} and found["format"] == {"invalid-format"} and found["version"] == {"snapshot-version-mismatch"} and found["empty"] == {"empty-value"}
    assert {"missing-field", "invalid-type"} == found["lost"] and {"unknown-claim", "claim-set-mismatch"} == found["claim"] and {"duplicate-sentence-id", "multiple-one-line-sentences"} == found["twice"]


def test_sources(spark, tmp_path):
    assert registry.sources(spark).count() == 9 and registry.by_id(registry.sources(spark), "tn-tech").first().publisher == "Thanh Niên"
    with pytest.raises(Exception, match="Unknown id"):
        registry.by_id(registry.sources(spark), "zz").collect()
    answers = {"https://a.example/": (302, {"location": "/b"}, b""), "https://a.example/b": (200, {"content-type": "text/xml"}, b"ok"), "https://a.example/x": (302, {"location": "https://evil.example/"}, b"")}
    opener = lambda url, timeout: answers[url]
    assert http.fetch({"id": 1, "url": "https://a.example/", "hosts": ["a.example"]}, opener=opener) == (1, "https://a.example/b", 200, "text/xml", "ok", None)
    assert http.fetch({"id": 1, "url": "https://a.example/x", "hosts": ["a.example"]}, opener=opener)[-1] == "Host evil.example is not allowed"
    assert http.fetch({"id": 1, "url": "http://a.example/", "hosts": None}, opener=opener)[-1] == "URL must use HTTPS"
    rows = spark.createDataFrame([("a", "https://f/", "rss", True), ("a", "https://f/", "rss", True), ("b", "ftp://g", "rss", True)], tables.SCHEMAS["source_endpoints"])
    tables.write(rows, str(tmp_path), "source_endpoints")
    tables.write(rows, str(tmp_path), "source_endpoints")
    back = tables.read(spark, str(tmp_path), "source_endpoints")
    broken = {(r["constraint"], r.n) for r in tables.violations({"source_endpoints": back}).collect()}
    assert broken == {("check https", 1), ("unique source_id, url", 1)}


def test_stream_equals_batch(spark, tmp_path):
    from quillstream.streaming import versions as stream

    rows = [("a", h, i, i) for i, h in enumerate(["x", "x", "y", "x"])] + [("b", "q", 9, 9)]
    schema = "article_id string, content_hash string, observed_at long, seq long"
    for k, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = stream.versions_stream(feed).writeStream.format("memory").queryName("versions_out").outputMode("append").start()
    run.processAllAvailable()
    run.stop()
    got = sorted((r.article_id, r.seq, r.version_number, r.outcome) for r in spark.table("versions_out").collect())
    batch = versions.with_versions(spark.createDataFrame(rows, schema))
    assert got == sorted((r.article_id, r.seq, r.version_number, r.outcome) for r in batch.collect())


def test_unknown_articles_fail_their_case(spark):
    articles = spark.createDataFrame([("a", "sports", "One two", "2024-01-01", "report", ["X"])], "id string, category string, title string, observed_date string, content_type string, entities array<string>")
    pairs = relations.relate(spark.createDataFrame([("a", "zz"), ("a", "a")], "left_id string, right_id string"), articles).collect()
    assert {(x.right_id, x.error, x.decision is None) for x in pairs} == {("zz", "Unknown article: zz", True), ("a", None, False)}
    cases = spark.createDataFrame([(1, "same-event", "accepted", ["a", "zz"])], "case_id long, kind string, label_status string, article_ids array<string>")
    rolled, _ = evaluation.evaluate(cases, articles)
    assert [(x.predicted_relation, x.matches_expected) for x in rolled.collect()] == [("unknown-article", False)]
    gates = evaluation.gate_counts(rolled).first()
    assert (gates.passed, gates.total, gates.exit_code) == (0, 1, 1)


def test_numbers_are_no_strings_in_a_manifest(spark):
    article = {"id": 5, "category": "sports", "sourceId": "s", "title": 9, "canonicalUrl": "https://e.example/", "observedDate": "2024-02-28", "verification": "page-fetched", "contentType": "r", "entities": ["x", 1], "uncertainty": "none"}
    case = {"id": "k", "kind": "same-event", "articleIds": [5], "expectedRelation": "same-event", "evaluationFocus": "f", "knownUncertainty": "n", "labelProvenance": {"status": "accepted", "method": "human-review", "reviewedBy": [1], "reviewedAt": "2024-01-01", "notes": 3}}
    body = json.dumps({"schemaVersion": "2.0.0", "datasetVersion": 7, "generatedAt": "2024", "legalBoundary": "x", "articles": [article], "cases": [case]})
    issues = {x.issue for x in manifest.validate(manifest.parse(spark.createDataFrame([(body,)], "body string"))).collect()}
    assert {"datasetVersion must be a non-empty string", "articles[0].id must be a non-empty string", "articles[0].title must be a non-empty string", "articles[0].entities must contain non-empty strings"} <= issues
    assert {"cases[0].labelProvenance.reviewedBy must be a string array", "cases[0].labelProvenance.notes must be a non-empty string"} <= issues


def test_posts_secrets_and_times():
    asked = []

    def opener(url, timeout, headers=None, data=None):
        asked.append((url, headers, data))
        return 200, {"content-type": "application/json"}, b"{}"

    request = http.browser_request("t", "https://vnexpress.net/a", ["vnexpress.net"], "https://browser.example/run", " secret ")
    row = http.timed_fetch(request, opener=opener)
    assert row[:6] == ("t", "https://browser.example/run", 200, "application/json", "{}", None) and row[6] >= 0
    assert asked == [("https://browser.example/run", {"Authorization": "Bearer secret", "Content-Type": "application/json"}, '{"url": "https://vnexpress.net/a"}')]
    with pytest.raises(ValueError, match="token is required"):
        http.browser_request("t", "https://vnexpress.net/a", ["vnexpress.net"], "https://browser.example/run", "  ")
    with pytest.raises(ValueError, match="is not allowed"):
        http.browser_request("t", "https://evil.example/", ["vnexpress.net"], "https://browser.example/run", "x")

    def slow(url, timeout):
        raise TimeoutError

    assert http.fetch({"id": 1, "url": "https://a.example/"}, 15.0, slow)[-1] == "Timed out after 15000ms"


def test_tables_change_together_or_not_at_all(spark, tmp_path):
    root = str(tmp_path / "store")
    runs = lambda n, status: spark.createDataFrame([(str(n), f"k{n}", "source-poll", status, 1, 3)], tables.SCHEMAS["ingestion_runs"])
    failures = spark.createDataFrame([("f", "1", "network", True, "m")], tables.SCHEMAS["processing_failures"])
    tables.write_all({"ingestion_runs": runs(1, "queued"), "processing_failures": failures}, root)
    broken = failures.select("id", "run_id", "category", "retryable", F.raise_error(F.lit("lost")).cast("string").alias("message"))
    with pytest.raises(Exception, match="lost"):
        tables.write_all({"ingestion_runs": runs(2, "nonsense"), "processing_failures": broken}, root)
    assert [r.id for r in tables.read(spark, root, "ingestion_runs").collect()] == ["1"]
    tables.write_all({"ingestion_runs": runs(2, "nonsense")}, root)
    tables.clean(spark, root)
    both = {n: tables.read(spark, root, n) for n in ("ingestion_runs", "processing_failures")}
    assert {(r.table, r["constraint"], r.n) for r in tables.violations(both).collect()} == {("ingestion_runs", "enum status", 1), ("processing_failures", "reference run_id", 1)}
    with pytest.raises(ValueError, match="no table"):
        tables.read(spark, root, "articles")


def test_article_inspection_rows(spark):
    line = "Một đoạn văn đủ dài để vượt qua ngưỡng của bộ lọc đoạn văn, và còn dài hơn nữa cho chắc. "
    page = f"<title>T</title><article><p>{line * 3}</p></article>"
    fetched = spark.createDataFrame(
        [("a", "u", 200, "text/html; charset=utf-8", page, None, 7), ("b", "u", None, None, None, "HTTP 404", 3), ("c", "u", 200, "application/pdf", page, None, 3), ("d", "u", 200, None, "<title>T</title>", None, 3)], http.SCHEMA
    )
    targets = spark.createDataFrame([(k, "Thanh Niên", "sports", "https://thanhnien.vn/x") for k in "abcd"], "id string, publisher string, category string, url string")
    got = {r.target_id: r for r in html.inspect_fetched(fetched, targets).collect()}
    assert (got["a"].ok, got["a"].title, got["a"].duration_ms, got["a"].quality_decision, got["a"].canonical_url) == (True, "T", 7, "ready", "https://thanhnien.vn/x")
    assert {k: got[k].error for k in "bcd"} == {"b": "HTTP 404", "c": "Unexpected content type: application/pdf", "d": "Article text too short"}
    assert all(got[k].quality_decision == "failed" and got[k].content_hash is None for k in "bcd") and "text" not in got["a"].asDict()


def test_candidate_pairs_are_made_once_and_in_blocks(spark, monkeypatch):
    """All pairs of a hot key and of alike titles, each once, without gathering pairs; also where an id repeats."""
    monkeypatch.setattr(relations, "BLOCK", 7)
    words = [f"word{chr(97 + k)}" for k in range(20)]
    rows = [(k, "c" if k % 3 else "d", " ".join(words[(k * 7 + j * (1 + k % 4)) % 20] for j in range(1 + k % 9)), "2024-01-01", "policy", ["hot" if k % 2 else f"own{k}", f"key{k % 5}"]) for k in range(60)]
    rows += [(100, None, "worda wordb", "2024-01-01", "policy", ["hot"]), (None, "c", "worda", "2024-01-01", "policy", ["hot"])]
    schema = "id long, category string, title string, observed_date string, content_type string, entities array<string>"

    def wanted(rows):
        of, out = {}, set()  # rows of one id and category count as one, as in SQL
        for r in rows:
            if r[0] is not None and r[1]:
                keys, title = of.setdefault(r[:2], (set(), set()))
                keys.update(r[5]), title.update(r[2].split())
        held = [(*k, *v) for k, v in of.items()]
        for a in held:
            for b in held:
                if a[0] < b[0] and a[1] == b[1] and (a[2] & b[2] or 5 * len(a[3] & b[3]) >= len(a[3] | b[3])):
                    out.add((a[0], b[0]))
        return sorted(out)

    found = relations.candidate_pairs(spark.createDataFrame(rows, schema))
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in found.collect()) == wanted(rows)
    rows.append((3, "d", "wordq wordr", "2024-01-01", "policy", ["key1", "hot"]))
    assert sorted(tuple(r) for r in relations.candidate_pairs(spark.createDataFrame(rows, schema)).collect()) == wanted(rows)


def test_small_tables_are_spread_over_the_cores(spark):
    """One file of many rows is the work of all cores; JSON texts are parsed once."""
    from quillstream.functions.lineage import spread
    from quillstream.plans import catalogue

    one = spark.range(100).coalesce(1)
    assert spread(one).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and sorted(r.id for r in spread(one).collect()) == list(range(100))
    plan = catalogue.queries()["manifest_types"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan
    body = '{"schemaVersion":"2.0.0","datasetVersion":"v","generatedAt":"2024","legalBoundary":"x","articles":[{}],"cases":[]}'
    plan = manifest.parse(spark.createDataFrame([(body,)], "body string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") <= 1
    assert "size(articles" not in manifest.articles_of(manifest.parse(spark.createDataFrame([(body,)], "body string")))._jdf.queryExecution().optimizedPlan().toString()
    empty = spark.createDataFrame([([],), (None,), (['{"id":"a"}', "{"],)], "articles array<string>")
    assert [(r["index"], r.id) for r in manifest.articles_of(empty).collect()] == [(0, "a"), (1, None)]


def test_container_texts_are_not_shuffled(spark):
    """Nested containers and one without an end; windows get numbers and hints only."""
    text = "x" * 300
    page = f"<div><p>a</p></div><div class='story one'><p>{text}</p><section id=main><p>{text}</p><p>{text}</p></section></div><article class=\"story\"><p>{text}</p><p>b</p>"
    found = diagnostics.container_candidates(spark.createDataFrame([(1, page), (2, None), (3, "")], "k long, html string"), "k")
    assert [(r.selector_hint, r.paragraph_count, r.text_length) for r in found.collect()] == [("div.story.one", 3, 902)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any("parts" in x or "html" in x for x in plan.split("\n") if "Sort [" in x or "Window" in x) and plan.count("sum(length") == 0


def test_only_a_sentence_id_goes_along_with_citations(spark):
    body = '{"sentences":[{"id":"1","text":"t","citations":[{"articleId":"a","articleVersionId":"v","claimIds":["c"]}],"claimIds":["c"]}]}'
    rows = spark.createDataFrame([("x", "s", body)], "summary_id string, snapshot_id string, body string")
    known = spark.createDataFrame([("s", 0, "a", "v", "active")], "snapshot_id string, pos int, article_id string, article_version_id string, state string")
    claims = known.selectExpr("*", "'c' claim_id", "'p' proposition_id", "'reported' epistemic_status", "'affirmed' polarity", "array('x') entities", "array(named_struct('key', 'k', 'value', '1', 'unit', 'u', 'currency', 'e', 'scale', 's')) numbers", "array(named_struct('key', 'k', 'value', '1', 'role', 'r')) times")
    plan = citations.sentence_issues(rows, known, claims)._jdf.queryExecution().analyzed().toString()
    assert "struct(id, s#" in plan
