"""Citation-safe validation of proposed summaries against a snapshot of claims.

Three stages, each of which ends the validation of a summary if it finds something: the snapshot itself, the closed-world shape of
the untrusted JSON text, and the sentences against the claims that they cite. Issues are rows (summary_id, code, path, ...).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut

SNAPSHOT_SCHEMA, SUMMARY_SCHEMA = "event-snapshot.v1", "citation-safe-summary.v1"
# Closed sets, formats and the statuses that a claim's status may be weakened to.
STATES = ("active", "disabled")
STATUSES = ("confirmed", "reported", "estimate", "prediction", "rumor", "allegation", "opinion", "correction", "uncertain")
POLARITIES = ("affirmed", "denied")
SCALES = ("unit", "thousand", "million", "billion", "trillion", "percent", "basis-point")
ROLES = ("event", "published", "updated", "effective", "announced")
SENTENCE_KINDS = ("one-line", "bullet")
DOWNGRADES = tuple((s, s) for s in STATUSES) + tuple((s, "uncertain") for s in STATUSES if s != "uncertain") + (("confirmed", "reported"),)
DECIMAL = r"^-?(0|[1-9]\d*)(\.\d+)?$"
INSTANT = r"^\d{4}-\d{2}-\d{2}(T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:\d{2}))?$"

# Fields of each record: name -> (type, closed set or format).
SHAPES: dict[str, dict[str, tuple]] = {
    "summary": {"schemaVersion": ("enum", (SUMMARY_SCHEMA,)), "snapshotId": ("string",), "snapshotVersion": ("integer",), "sentences": ("array",)},
    "sentence": {"id": ("string",), "kind": ("enum", SENTENCE_KINDS), "text": ("string",), "claimIds": ("strings",), "citations": ("array",), "assertion": ("record",)},
    "citation": {"articleId": ("string",), "articleVersionId": ("string",), "claimIds": ("strings",)},
    "assertion": {
        "propositionId": ("string",), "epistemicStatus": ("enum", STATUSES), "polarity": ("enum", POLARITIES), "entities": ("strings?",), "numbers": ("array?",), "times": ("array?",),
    },
    "number": {"key": ("string",), "value": ("format", DECIMAL), "unit": ("string",), "currency": ("optional",), "scale": ("enum", SCALES)},
    "time": {"key": ("string",), "value": ("format", INSTANT), "role": ("enum", ROLES)},
}


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _field(v: Column, name: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def _type(v: Column) -> Column:
    """Leading word of a variant's type; MISSING where there is none."""
    return F.coalesce(F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0), F.lit("MISSING"))


def _is_integer(v: Column) -> Column:
    x = F.try_variant_get(v, "$", "double")
    return F.coalesce(_type(v).isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT") & (x == F.floor(x)) & (x >= 1), F.lit(False))


def record_issues(rows: DataFrame, shape: str) -> DataFrame:
    """rows(summary_id, path, v) -> (summary_id, code, path): wrong type, unknown and missing keys, then each field's own issue."""
    fields = SHAPES[shape]
    issue = lambda when, code, path: F.when(when, F.struct(F.lit(code).alias("code"), path.alias("path")))
    here, v = F.col("path"), F.col("v")
    is_record = _type(v) == "OBJECT"
    at = lambda n: F.concat(here, F.lit(f".{n}"))
    said = [issue(~is_record, "invalid-type", here)]
    for name, (kind, *extra) in fields.items():
        x = _field(v, name)
        found, text = _type(x), F.try_variant_get(x, "$", "string")
        optional = kind == "optional"
        if not optional:
            said.append(issue(is_record & (found == "MISSING"), "missing-field", at(name)))
        kind_ = kind.rstrip("?")
        if kind_ in ("string", "optional", "enum", "format"):
            wrong = (found != "STRING") & ((found != "MISSING") if optional else F.lit(True))
            said.append(issue(is_record & wrong, "invalid-type", at(name)))
            if kind_ == "enum":
                said.append(issue(is_record & (found == "STRING") & ~text.isin(*extra[0]), "invalid-enum", at(name)))
            else:
                said.append(issue(is_record & (found == "STRING") & (F.trim(text) == ""), "empty-value", at(name)))
            if kind_ == "format":
                said.append(issue(is_record & (found == "STRING") & (F.trim(text) != "") & ~text.rlike(extra[0]), "invalid-format", at(name)))
        elif kind_ == "integer":
            said.append(issue(is_record & ~_is_integer(x), "invalid-format", at(name)))
        elif kind_ in ("array", "strings"):
            said.append(issue(is_record & (found != "ARRAY"), "invalid-type", at(name)))
            if not kind.endswith("?"):
                said.append(issue(is_record & (found == "ARRAY") & (F.size(F.try_variant_get(x, "$", "array<variant>")) == 0), "empty-value", at(name)))
        elif kind_ == "record":
            said.append(issue(is_record & (found != "OBJECT"), "invalid-type", at(name)))
    unknown = F.array_except(F.coalesce(F.json_object_keys(F.to_json(v)), F.array().cast("array<string>")), F.array(*(F.lit(n) for n in fields)))
    extra_keys = F.transform(unknown, lambda k: F.struct(F.lit("unknown-field").alias("code"), F.concat(here, F.lit("."), k).alias("path")))
    every = F.concat(F.array_compact(F.array(*said)), F.when(is_record, extra_keys).otherwise(F.array().cast("array<struct<code:string,path:string>>")))
    out = [rows.select("summary_id", F.explode(every).alias("i")).select("summary_id", "i.code", "i.path")]
    for name, (kind, *_) in fields.items():
        if kind.startswith("strings"):
            members = rows.where(is_record).select("summary_id", "path", F.posexplode(F.try_variant_get(_field(v, name), "$", "array<variant>")).alias("k", "m"))
            place = F.concat("path", F.lit(f".{name}["), F.col("k").cast("string"), F.lit("]"))
            kind_of, value = _type(F.col("m")), F.try_variant_get("m", "$", "string")
            code = F.when(kind_of != "STRING", "invalid-type").when(F.trim(value) == "", "empty-value")
            out.append(members.select("summary_id", code.alias("code"), place.alias("path")).where("code is not null"))
    return _union(out)


def _members(rows: DataFrame, name: str) -> DataFrame:
    held = rows.where(_type(F.col("v")) == "OBJECT").select("summary_id", "path", F.posexplode(F.try_variant_get(_field(F.col("v"), name), "$", "array<variant>")).alias("k", "v"))
    return held.select("summary_id", F.concat("path", F.lit(f".{name}["), F.col("k").cast("string"), F.lit("]")).alias("path"), "v")


def _inner(rows: DataFrame, name: str) -> DataFrame:
    held = rows.where(_type(_field(F.col("v"), name)) == "OBJECT")
    return held.select("summary_id", F.concat("path", F.lit(f".{name}")).alias("path"), _field(F.col("v"), name).alias("v"))


def shape_issues(summaries: DataFrame) -> DataFrame:
    """summaries(summary_id, body) -> issues of the JSON text."""
    root = summaries.select("summary_id", F.lit("$").alias("path"), F.try_parse_json("body").alias("v"))
    broken = root.where("v is null").select("summary_id", F.lit("invalid-type").alias("code"), "path")
    root = root.where("v is not null")
    sentences = cut(_members(root, "sentences"))
    citations, assertions = _members(sentences, "citations"), _inner(sentences, "assertion")
    levels = (("summary", root), ("sentence", sentences), ("citation", citations), ("assertion", assertions), ("number", _members(assertions, "numbers")), ("time", _members(assertions, "times")))
    return _union([broken, *(record_issues(rows, shape) for shape, rows in levels)])


SENTENCES = (
    "struct<schemaVersion:string,snapshotId:string,snapshotVersion:double,sentences:array<struct<id:string,kind:string,text:string,claimIds:array<string>,"
    "citations:array<struct<articleId:string,articleVersionId:string,claimIds:array<string>>>,assertion:struct<propositionId:string,epistemicStatus:string,polarity:string,"
    "entities:array<string>,numbers:array<struct<key:string,value:string,unit:string,currency:string,scale:string>>,times:array<struct<key:string,value:string,role:string>>>>>>"
)


def snapshot_issues(snapshots: DataFrame, article_versions: DataFrame, claims: DataFrame) -> DataFrame:
    """(snapshot_id, code, path, claim_id): wrong head, article versions or claims, duplicates and claims without their version."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    out = lambda df, path, claim=None: df.select("snapshot_id", F.lit("invalid-snapshot").alias("code"), path.alias("path"), (F.col(claim) if claim else F.lit(None).cast("string")).alias("claim_id"))
    head = snapshots.where(~F.col("schema_version").eqNullSafe(SNAPSHOT_SCHEMA) | blank("snapshot_id") | F.coalesce(F.col("snapshot_version") < 1, F.lit(True)))
    key = ("article_id", "article_version_id")
    bad = reduce(lambda a, b: a | b, [blank(c) for c in key]) | ~F.coalesce(F.col("state").isin(*STATES), F.lit(False))
    again = F.row_number().over(Window.partitionBy("snapshot_id", *key).orderBy("pos")) > 1
    marked = article_versions.withColumn("__bad", bad)
    twice = marked.where(~F.col("__bad")).withColumn("__again", again).where("__again")
    at = lambda n: F.concat(F.lit(f"$snapshot.{n}["), F.col("pos").cast("string"), F.lit("]"))
    names = ("claim_id", *key, "proposition_id")
    closed = F.col("state").isin(*STATES) & F.col("epistemic_status").isin(*STATUSES) & F.col("polarity").isin(*POLARITIES)
    wrong = reduce(lambda a, b: a | b, [blank(c) for c in names]) | ~F.coalesce(closed, F.lit(False))
    known = marked.where(~F.col("__bad")).select("snapshot_id", *key).distinct().withColumn("__known", F.lit(True))
    judged = claims.join(known, ["snapshot_id", *key], "left").withColumn("__bad", wrong | F.col("__known").isNull())
    doubled = judged.where(~F.col("__bad")).withColumn("__again", F.row_number().over(Window.partitionBy("snapshot_id", "claim_id").orderBy("pos")) > 1).where("__again")
    body = _union([
        out(marked.where("__bad"), at("articleVersions")), out(twice, at("articleVersions")), out(judged.where("__bad"), at("claims"), "claim_id"), out(doubled, at("claims"), "claim_id"),
    ])
    top = out(head, F.lit("$snapshot"))
    return top.unionByName(body.join(head.select("snapshot_id"), "snapshot_id", "left_anti"))


def _member(name: str):
    return lambda k: k[name]


def _lacks(name: str, key):
    """Whether a claim does not hold the asserted value in column f."""
    return lambda k: ~F.exists(k[name], lambda x: key(x) == key(F.col("f")))


def same_strings(a: Column, b: Column) -> Column:
    """Equal sizes and every member of a in b; repeated members of a go unnoticed."""
    return (F.size(a) == F.size(b)) & F.forall(a, lambda x: F.array_contains(b, x))


def sentence_issues(summaries: DataFrame, article_versions: DataFrame, claims: DataFrame) -> DataFrame:
    """Well-formed summaries(summary_id, snapshot_id, body) -> issues of their sentences and citations."""
    parsed = summaries.select("summary_id", "snapshot_id", F.from_json("body", SENTENCES).alias("b"))
    rows = cut(parsed.select("summary_id", "snapshot_id", F.posexplode("b.sentences").alias("pos", "s")))  # parsed once for all checks
    path = F.concat(F.lit("$.sentences["), F.col("pos").cast("string"), F.lit("]"))
    out = lambda df, code, where, **refs: df.select(
        "summary_id", F.lit(code).alias("code"), where.alias("path"), F.col("s.id").alias("sentence_id"), *(refs.get(n, F.lit(None).cast("string")).alias(n) for n in ("article_id", "article_version_id", "claim_id"))
    )
    # of the sentence, only the id goes along with each citation: the whole would be moved once for every one of them
    cited = rows.select("summary_id", "snapshot_id", "pos", F.struct(F.col("s.id").alias("id")).alias("s"), F.posexplode("s.citations").alias("cpos", "c"))
    cpath = F.concat(path, F.lit(".citations["), F.col("cpos").cast("string"), F.lit("]"))
    refs = {"article_id": F.col("c.articleId"), "article_version_id": F.col("c.articleVersionId")}
    same = Window.partitionBy("summary_id", "pos", "c.articleId", "c.articleVersionId", "ids").orderBy("cpos")
    twice = cited.withColumn("ids", F.array_sort("c.claimIds")).withColumn("__n", F.row_number().over(same)).where("__n > 1")
    versions = article_versions.select(F.col("snapshot_id").alias("__s"), F.col("article_id").alias("__a"), F.col("article_version_id").alias("__v"), F.col("state").alias("article_state"))
    met = cited.join(versions, (F.col("snapshot_id") == F.col("__s")) & (F.col("c.articleId") == F.col("__a")) & (F.col("c.articleVersionId") == F.col("__v")), "left")
    used = cited.select("*", F.posexplode("c.claimIds").alias("kpos", "claim"))
    kpath = F.concat(cpath, F.lit(".claimIds["), F.col("kpos").cast("string"), F.lit("]"))
    known = claims.select(F.col("snapshot_id").alias("__s"), F.col("claim_id").alias("__c"), F.struct(*(c for c in claims.columns if c not in ("snapshot_id", "claim_id"))).alias("k"))
    met_claims = used.join(known, (F.col("snapshot_id") == F.col("__s")) & (F.col("claim") == F.col("__c")), "left")
    referred = used.withColumn("__n", F.row_number().over(Window.partitionBy("summary_id", "pos", "claim").orderBy("cpos", "kpos"))).where("__n > 1")
    moved = (F.col("k.article_id") != F.col("c.articleId")) | (F.col("k.article_version_id") != F.col("c.articleVersionId"))
    issue = lambda when, code, where, **refs: F.when(when, F.struct(F.lit(code).alias("code"), where.alias("path"), *(refs.get(n, F.lit(None).cast("string")).alias(n) for n in ("article_id", "article_version_id", "claim_id"))))
    said = lambda df, *found: df.select("summary_id", F.col("s.id").alias("sentence_id"), F.explode(F.array_compact(F.array(*found))).alias("i")).select("summary_id", "i.code", "i.path", "sentence_id", "i.article_id", "i.article_version_id", "i.claim_id")
    claim = {"claim_id": F.col("claim")}
    parts = [
        out(twice, "duplicate-citation", cpath, **refs), out(referred, "duplicate-claim-reference", kpath, **claim),
        said(met, issue(F.col("article_state").isNull(), "unknown-article-version", cpath, **refs), issue(F.col("article_state") != "active", "disabled-article-version", cpath, **refs)),
        said(
            met_claims, issue(F.col("k").isNull(), "unknown-claim", kpath, **claim), issue(F.col("k.state") != "active", "disabled-claim", kpath, **claim),
            issue(moved, "claim-provenance-mismatch", kpath, **claim, **refs),
        ),
    ]
    gathered = met_claims.groupBy("summary_id", "pos").agg(F.collect_set("claim").alias("ids"), F.collect_list("k").alias("ks"))  # bounded by one sentence
    whole = cut(rows.join(gathered, ["summary_id", "pos"], "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>"))))
    is_backed = F.coalesce(F.size("ks") > 0, F.lit(False))
    backed = whole.where(is_backed)
    a = lambda n: F.col(f"s.assertion.{n}")
    weaker = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in DOWNGRADES))
    upgrade = F.exists("ks", lambda k: ~F.array_contains(weaker, F.struct(k["epistemic_status"].alias("x"), a("epistemicStatus").alias("y"))))
    found = [issue(~same_strings(F.col("s.claimIds"), F.col("ids")), "claim-set-mismatch", F.concat(path, F.lit(".claimIds")))]
    for field, column, mixed, other in (("propositionId", "proposition_id", "mixed-proposition", "proposition-mismatch"), ("polarity", "polarity", "mixed-polarity", "polarity-mismatch")):
        values = F.array_distinct(F.transform("ks", _member(column)))
        spot = F.concat(path, F.lit(".assertion" if field == "propositionId" else ".assertion.polarity"))
        found.append(issue(is_backed & (F.size(values) != 1), mixed, spot))
        found.append(issue(is_backed & ((F.size(values) != 1) | ~F.array_contains(values, a(field))), other, F.concat(path, F.lit(f".assertion.{field}"))))
    found.append(issue(is_backed & upgrade, "epistemic-upgrade", F.concat(path, F.lit(".assertion.epistemicStatus"))))
    parts.append(said(whole, *found))
    text = lambda names: lambda x: F.concat_ws("\u0000", *(F.coalesce(x[n], F.lit("\u0001")) for n in names))
    plans = (("entities", "unsupported-entity", lambda x: x), ("numbers", "unsupported-number", text(("key", "value", "unit", "currency", "scale"))), ("times", "unsupported-time", text(("key", "value", "role"))))
    for field, code, key in plans:
        members = backed.select("summary_id", "pos", "s", "ks", F.posexplode(a(field)).alias("fpos", "f"))
        missing = F.exists("ks", _lacks(field, key))
        parts.append(out(members.where(missing), code, F.concat(path, F.lit(f".assertion.{field}["), F.col("fpos").cast("string"), F.lit("]"))))
    again = rows.withColumn("__n", F.row_number().over(Window.partitionBy("summary_id", "s.id").orderBy("pos"))).where("__n > 1")
    parts.append(out(again, "duplicate-sentence-id", F.concat(path, F.lit(".id"))))
    return _union(parts)


def validate(summaries: DataFrame, snapshots: DataFrame, article_versions: DataFrame, claims: DataFrame) -> DataFrame:
    """summaries(summary_id, snapshot_id, body) held against their snapshot -> all issues; a summary without rows is valid."""
    columns = ("summary_id", "code", "path", "sentence_id", "article_id", "article_version_id", "claim_id")
    fill = lambda df: df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns))
    first = cut(snapshot_issues(snapshots, article_versions, claims))
    stage0 = fill(summaries.select("summary_id", "snapshot_id").join(first, "snapshot_id"))
    sound = summaries.join(first.select("snapshot_id").distinct(), "snapshot_id", "left_anti")
    stage1 = cut(fill(shape_issues(sound)))
    formed = cut(sound.join(stage1.select("summary_id").distinct(), "summary_id", "left_anti"))
    heads = formed.select("summary_id", "snapshot_id", F.from_json("body", SENTENCES).alias("b")).join(snapshots.select("snapshot_id", "snapshot_version"), "snapshot_id")
    lines = F.size(F.filter("b.sentences", lambda s: s["kind"] == "one-line"))
    said = F.array(
        F.when(F.col("b.snapshotId") != F.col("snapshot_id"), F.struct(F.lit("snapshot-id-mismatch").alias("code"), F.lit("$.snapshotId").alias("path"))),
        F.when(F.col("b.snapshotVersion") != F.col("snapshot_version"), F.struct(F.lit("snapshot-version-mismatch").alias("code"), F.lit("$.snapshotVersion").alias("path"))),
        F.when(lines > 1, F.struct(F.lit("multiple-one-line-sentences").alias("code"), F.lit("$.sentences").alias("path"))),
    )
    top = heads.select("summary_id", F.explode(F.array_compact(said)).alias("i")).select("summary_id", "i.code", "i.path")
    return _union([stage0, stage1, fill(top), fill(sentence_issues(formed, article_versions, claims))])
