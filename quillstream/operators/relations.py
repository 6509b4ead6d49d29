"""Event relations between article pairs: features once per article, one decision column per pair, and blocked candidate search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.lineage import cut

# Generic and broad entity names, title stop words, name aliases, content families in order of precedence.
GENERIC = ("ai", "bao chi", "cong nghe", "dien anh", "giai tri", "nguoi ham mo", "phong ve", "the thao")
BROAD = ("apple", "google", "ha noi", "indonesia", "meta", "netflix", "samsung", "trung quoc", "uc", "viet nam")
STOP_WORDS = (
    "ai bi cho cua da dang de duoc gi hon khi la mot nhung o sau tai the theo thi tren trong tu va ve vi voi"
).split()
ALIASES = ((r"\b(?:doi tuyen|tuyen) viet nam\b", "viet nam"), (r"\bhlv indonesia\b", "indonesia"), (r"\bnguoi nhen\b", "spider man"))
FAMILIES = (("box office", "box-office"), *((x, x) for x in ("match", "policy", "rumor", "reaction", "milestone", "preview", "result")))
OVERLAP, MULTI_DAYS, SINGLE_DAYS, FAR_DAYS = 0.2, 2, 1, 7
#: Rows of a key or token in a block; all pairs of two blocks are one group of a join.
BLOCK = 4_096


def entity_keys(entities: Column) -> Column:
    """Distinct keys of an array of names: folded, years dropped, aliases added, generic names removed."""

    def keys(name: Column) -> Column:
        base = F.trim(F.regexp_replace(F.regexp_replace(t.fold(name), r"\b(?:19|20)\d{2}\b", ""), " +", " "))
        return F.array(F.nullif(base, F.lit("")), *(F.when(base.rlike(p), F.lit(alias)) for p, alias in ALIASES))

    every = F.array_compact(F.flatten(F.transform(entities, keys)))
    return F.array_distinct(F.array_except(every, F.array(*(F.lit(g) for g in GENERIC))))


def content_family(folded: Column) -> Column:
    out = None
    for part, family in FAMILIES:
        hit = F.contains(folded, F.lit(part))
        out = F.when(hit, family) if out is None else out.when(hit, family)
    return out.otherwise(folded)


def title_tokens(title: Column) -> Column:
    words = F.split(t.fold(title), " ")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*STOP_WORDS) & ~w.rlike("^[0-9]+$")))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def day_distance(a: Column, b: Column) -> Column:
    """Days between two YYYY-MM-DD strings; infinite if one is no date."""
    day = lambda c: F.try_to_date(c, "yyyy-MM-dd")
    return F.coalesce(F.abs(F.date_diff(day(a), day(b))).cast("double"), F.lit(float("inf")))


def features(articles: DataFrame) -> DataFrame:
    """articles(id, category, title, observed_date, content_type, entities) -> what pairs need, computed once per article."""
    kind = t.fold(F.col("content_type"))
    has = lambda w: F.contains(kind, F.lit(w))
    return articles.select(
        "id", "category", "observed_date", entity_keys(F.col("entities")).alias("keys"), title_tokens(F.col("title")).alias("tokens"), content_family(kind).alias("family"),
        F.struct(*(has(w).alias(w) for w in ("reaction", "milestone", "preview", "result"))).alias("kind"),
    )


def decide(pairs: DataFrame, left: str = "l", right: str = "r") -> DataFrame:
    """pairs with feature structs `left` and `right`: adds struct decision(relation, confidence, reasons, signals)."""
    l, r = (lambda n: F.col(f"{left}.{n}")), (lambda n: F.col(f"{right}.{n}"))  # noqa: E741
    shared = F.array_sort(F.array_intersect(l("keys"), r("keys")))
    pairs = pairs.withColumn("__s", F.struct(
        (l("category") == r("category")).alias("same_category"), day_distance(l("observed_date"), r("observed_date")).alias("date_distance_days"),
        (l("family") == r("family")).alias("same_content_family"), shared.alias("shared_entities"), jaccard(l("tokens"), r("tokens")).alias("title_token_overlap"),
    ))
    n, days, overlap = F.size("__s.shared_entities"), F.col("__s.date_distance_days"), F.col("__s.title_token_overlap")
    boundary = (
        (l("kind.reaction") != r("kind.reaction")) | (l("kind.milestone") != r("kind.milestone"))
        | (l("kind.preview") & r("kind.result")) | (r("kind.preview") & l("kind.result"))
    )
    broad = F.get(F.col("__s.shared_entities"), F.lit(0)).isin(*BROAD)
    rules = (
        (~F.coalesce(F.col("__s.same_category"), F.lit(False)), "different-event", "high", ("category-mismatch",)),
        ((n > 0) & boundary, "related-not-merge", "high", ("protected-content-boundary",)),
        ((n >= 2) & (days <= MULTI_DAYS), "same-event-candidate", "high", ("multiple-shared-entities",)),
        ((n == 1) & ~broad & F.col("__s.same_content_family") & (days <= SINGLE_DAYS), "same-event-candidate", "medium", ("single-shared-entity-same-family",)),
        ((n == 1) & broad, "uncertain", "low", ("broad-single-entity", "insufficient-evidence")),
        ((n == 0) & (overlap < OVERLAP), "different-event", "medium", ("no-shared-entity", "weak-title-overlap")),
        ((n == 0) & (days > FAR_DAYS), "different-event", "medium", ("no-shared-entity", "date-outside-window")),
        (F.lit(True), "uncertain", "low", ("insufficient-evidence",)),
    )
    out = None
    for condition, relation, confidence, reasons in rules:
        value = F.struct(F.lit(relation).alias("relation"), F.lit(confidence).alias("confidence"), F.array(*(F.lit(x) for x in reasons)).alias("reasons"), F.col("__s").alias("signals"))
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return pairs.withColumn("decision", out).drop("__s")


def case_pairs(cases: DataFrame) -> DataFrame:
    """cases(case_id, article_ids) -> (case_id, left_id, right_id), earlier listed article first."""
    seats = cases.select("case_id", F.posexplode("article_ids").alias("pos", "id"))
    a, b = seats.alias("a"), seats.alias("b")
    joined = a.join(b, (F.col("a.case_id") == F.col("b.case_id")) & (F.col("a.pos") < F.col("b.pos")))
    return joined.select(F.col("a.case_id").alias("case_id"), F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id"))


def relate(pairs: DataFrame, articles: DataFrame) -> DataFrame:
    """pairs(left_id, right_id, ...) with the decision of each; a pair with an unknown article has no decision but an error."""
    f = features(articles)
    packed = f.select("id", F.struct(*(c for c in f.columns if c != "id")).alias("f"))
    found = pairs.join(packed.select(F.col("id").alias("left_id"), F.col("f").alias("l")), "left_id", "left").join(packed.select(F.col("id").alias("right_id"), F.col("f").alias("r")), "right_id", "left")
    unknown = lambda side, name: F.when(F.col(side).isNull(), F.concat(F.lit("Unknown article: "), F.col(name).cast("string")))
    said = decide(found).withColumn("error", F.coalesce(unknown("l", "left_id"), unknown("r", "right_id")))
    return said.withColumn("decision", F.when(F.col("error").isNull(), F.col("decision"))).drop("l", "r")


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows by keys in many tasks, whatever their size: few bytes make many pairs."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism), *keys)


def _numbered(held: DataFrame, what: str, order: Column) -> DataFrame:
    """Rows (id, category, `what`) -> the number of each (category, `what`) in `order` of their count and how many blocks its rows are cut into."""
    counted = held.groupBy("category", what).count().orderBy(order, "category", what)
    return cut(counted.select("category", what, F.monotonically_increasing_id().alias("n"), F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")))


def candidate_pairs(articles: DataFrame) -> DataFrame:
    """(left_id, right_id) of all pairs that rules 2 to 5, 7 and 8 can concern; every other pair is `different-event`.

    Such a pair has one category and shares an entity key or has title Jaccard of at least 0.2. The first kind is an equi-join on
    (category, key), at the first key that both have. For the second, tokens are numbered by frequency, rarest first; two titles with that Jaccard share a third of the
    smaller one's tokens and a fifth of the larger one's at least, so they share a token among the first n - ceil(n / 3) + 1 and n - ceil(n / 5) + 1, and only those are joined,
    sizes and places first. A pair is verified once, at the first token that both have, if they have no key in common. So each pair is made once and pairs
    are not moved. The pairs of one key are all part of the result, which grows with the square of the key's rows: rows of a key or token are cut
    into blocks of about BLOCK, and each pair of blocks is a group of its own."""
    f = cut(features(articles.where("id is not null and category is not null")).select("id", "category", "keys", "tokens"))
    by_key = f.select("id", "category", F.explode("keys").alias("k"))
    keyed = by_key.join(_numbered(by_key, "k", F.desc("count")), ["category", "k"])
    held = cut(keyed.groupBy("id", "category").agg(F.sort_array(F.collect_set("n")).alias("ks"), F.sort_array(F.collect_set(F.struct("n", "blocks"))).alias("all")))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    each = held.select("id", "ks", F.posexplode("all").alias("pos", "x")).select("id", "x.n", "x.blocks", F.slice("ks", F.lit(1), F.col("pos")).alias("before")).withColumn("block", block)
    a = _dealt(each.select("id", "n", "before", F.col("block").alias("i"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j")), "n", "i", "j").alias("a")
    b = _dealt(each.select("id", "n", "before", F.explode(F.sequence(F.lit(0), "block")).alias("i"), F.col("block").alias("j")), "n", "i", "j").alias("b")
    pair = [F.least("a.id", "b.id").alias("left_id"), F.greatest("a.id", "b.id").alias("right_id")]
    here = (F.col("a.n") == F.col("b.n")) & (F.col("a.i") == F.col("b.i")) & (F.col("a.j") == F.col("b.j"))
    once = (F.col("a.i") < F.col("a.j")) | (F.col("a.id") < F.col("b.id"))
    first = (F.size("a.before") == 0) | (F.size("b.before") == 0) | ~F.arrays_overlap("a.before", "b.before")
    same_key = a.join(b, here & once & first).select(*pair)

    words = f.select("id", "category", F.explode("tokens").alias("token"))
    numbered = words.join(_numbered(words, "token", F.asc("count")), ["category", "token"])
    ordered = numbered.groupBy("id", "category").agg(F.sort_array(F.collect_set(F.struct("n", "blocks"))).alias("all"))
    ordered = ordered.join(held.select("id", "category", "ks"), ["id", "category"], "left").select("id", F.coalesce("ks", F.array().cast("array<bigint>")).alias("ks"), "all", F.size("all").alias("size"))
    ordered = cut(ordered.withColumn("s", F.col("all.n")))
    size = F.col("size")

    def prefix(share: int) -> DataFrame:
        rows = ordered.select("id", "ks", "s", "size", F.posexplode(F.slice("all", F.lit(1), (size - F.ceil(size / share) + 1).cast("int"))).alias("pos", "x"))
        return rows.select("id", "ks", "s", "size", "pos", "x.n", "x.blocks").withColumn("block", block)

    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    columns = ("id", "ks", "s", "size", "pos", "n")
    a = _dealt(prefix(5).select(*columns, F.col("block").alias("i"), every.alias("j")), "n", "i", "j").alias("a")
    b = _dealt(prefix(3).select(*columns, every.alias("i"), F.col("block").alias("j")), "n", "i", "j").alias("b")
    larger = (F.col("a.size") > F.col("b.size")) | ((F.col("a.size") == F.col("b.size")) & (F.col("a.id") > F.col("b.id")))
    both = F.col("a.size") + F.col("b.size")
    left = F.least(F.col("a.size") - F.col("a.pos"), F.col("b.size") - F.col("b.pos"))  # tokens that both can have if this is the first
    shared = F.array_intersect("a.s", "b.s")
    alike = (F.col("a.size") <= 5 * F.col("b.size")) & (6 * left >= both) & ~F.arrays_overlap("a.ks", "b.ks") & (6 * F.size(shared) >= both) & (F.get(shared, F.lit(0)) == F.col("a.n"))
    near = a.join(b, here & larger & (F.col("a.id") != F.col("b.id")) & alike).select(*pair)
    found = same_key.unionByName(near)
    twice = not f.groupBy("id").count().where("count > 1").isEmpty()
    return found.distinct() if twice else found  # ids that repeat can meet in two ways
