import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillstream.llm import chaining as ch


PLACE = "row: long, begin: int, lead: int, size: int, open: boolean, words: binary"


def plain_chain_score(x, y):
    order = sorted(range(len(x)), key=lambda i: (x[i], y[i]))
    score = {}
    for j in order:
        gains = [score[i] - ch.GAP * (x[j] - x[i] + y[j] - y[i]) for i in order if x[i] < x[j] and y[i] < y[j] and i in score]
        score[j] = ch.K + max([0.0, *gains])
    return max(score.values())


def test_fenwick_chains_equal_the_quadratic_recurrence():
    r = random.Random(2)
    for _ in range(80):
        n = r.randint(1, 25)
        pts = list({(r.randint(0, 60), r.randint(0, 60)) for _ in range(n)})
        x, y = np.array([p[0] for p in pts]), np.array([p[1] for p in pts])
        found = ch.chains(x, y)
        assert sorted(tuple(p) for c in found for p in c.tolist()) == sorted(pts)
        c = found[0]
        assert (np.diff(c, axis=0) > 0).all()
        total = ch.K * len(c) - ch.GAP * float((c[-1] - c[0]).sum())
        assert abs(total - plain_chain_score(x.tolist(), y.tolist())) < 1e-9


def test_common():
    import difflib

    assert ch.common(np.array([1, 2, 3, 4]), np.array([2, 4, 5])) == 2
    assert ch.common(np.array([], int), np.array([1])) == 0
    assert difflib.SequenceMatcher(None, "abcd", "bd").ratio() > 0


def corpus():
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 5)))
    make = lambda n: [word() for _ in range(n)]
    passages = [make(70) for _ in range(5)]
    docs, planted = [], {}
    for i in range(90):
        body, at = make(r.randint(20, 150)), 10
        p = i % 9
        if p < 5:
            passage = list(passages[p])
            for k in range(r.randint(0, 3)):
                passage[r.randrange(5, 65)] = word()
            body = body[:at] + passage + body[at:]
            planted.setdefault(p, []).append(i)
        docs.append((i, " ".join(body)))
    return docs, planted, passages


def test_every_planted_passage_is_found_and_nothing_else(spark):
    docs, planted, _ = corpus()
    docs += [(200, None), (201, ""), (202, "a b c"), (203, docs[8][1]), (204, docs[8][1].upper())]
    got = ch.passages(spark.createDataFrame(docs, "row long, text string")).collect()
    group = {d: p for p, ds in planted.items() for d in ds} | {8: 99, 203: 99, 204: 99}
    assert all(group.get(x.a) == group.get(x.b) is not None and x.a < x.b for x in got)
    for p, ds in planted.items():
        later = {x.b for x in got if group[x.b] == p}
        assert later == set(ds) - {min(ds)}
        for x in got:
            if group[x.b] == p:
                assert 9 <= x.b_begin < x.b_end <= 82 and x.b_end - x.b_begin >= 40 and x.n_equal >= 0.8 * (x.b_end - x.b_begin)
    assert {x.b for x in got if group[x.b] == 99} == {203, 204}


def test_frequent_seeds_give_linear_links(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = spark.createDataFrame([(i, text) for i in range(200)], "row long, text string")
    found = ch.links(rows)
    n = found.count()
    per_doc = rows.limit(1).mapInArrow(ch._seed_rows, "h long, row long, at int").count()
    assert n <= 3 * 200 * per_doc
    got = ch.passages(rows).collect()
    assert {x.b for x in got} == set(range(1, 200)) and all(x.b_end - x.b_begin == 60 for x in got)


def test_empty_table_and_query_ids(spark, tmp_path):
    rows = spark.createDataFrame([], "row long, text string")
    assert ch.passages(rows).count() == 0
    text = " ".join(f"w{i}" for i in range(60))
    spark.createDataFrame([(5, text, "x"), (5, text + " end", "x"), (None, text, "x")], "doc_id long, text string, row string").write.parquet(str(tmp_path / "documents.parquet"))
    got = ch.query(spark, str(tmp_path)).collect()
    assert len(got) >= 2


def edited_copies(share):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(4, 8)))
    passage = [word() for _ in range(100)]
    docs = []
    for i in range(60):
        copy = [word() if r.random() < share else w for w in passage]
        docs.append((i, " ".join([word() for _ in range(40)] + copy + [word() for _ in range(40)])))
    return docs


def test_a_group_of_edited_copies_is_one_class_with_all_its_texts(spark):
    got = ch.passages(spark.createDataFrame(edited_copies(0.04), "row long, text string")).collect()
    assert {x.a for x in got} | {x.b for x in got} == set(range(60))
    assert len({x.class_id for x in got}) == 1 and {x.class_texts for x in got} == {60}


def test_links_do_not_depend_on_where_the_seeds_are_cut(spark):
    rows = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(i % 7, 60))) for i in range(40)] + [(i, "a b c d e f g") for i in range(40, 60)], "row long, text string")
    found, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for n in (1, 3, 17):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(sorted(map(tuple, ch.links(rows).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found[0] and found[0] == found[1] == found[2]


def test_shared_seeds_match_every_place():
    _, x, y = ch.shared_seeds(np.array([3, 1, 3]), np.array([9, 2, 4]), np.array([3, 7]), np.array([5, 6]))
    assert list(zip(x, y)) == [(4, 5), (9, 5)]
    many = np.full(50, 8)
    _, x, y = ch.shared_seeds(many, np.arange(50), many, np.arange(50))
    assert set(x) == set(y) == set(range(50)) and len(x) <= 4 * 100


def test_texts_are_linked_whatever_stands_before_them(spark):
    """The first and the previous place of each seed are in texts that hold too few words of the passage, so the link of the two that hold it was left out."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(4, 8)))
    make = lambda n: [word() for _ in range(n)]
    passage = make(44)
    text = lambda part: " ".join(make(30) + part + make(30))
    parts = lambda: [text(passage[k : k + 38]) for k in [*range(7), *[0, 6] * 12]]
    docs = list(enumerate([*parts(), text(passage), *parts(), text(passage)]))
    got = ch.passages(spark.createDataFrame(docs, "row long, text string")).collect()
    assert {(x.a, x.b) for x in got} == {(31, 63)} and all(x.b_end - x.b_begin == 44 for x in got)


def test_links_of_different_texts_equal_all_pairs(spark):
    docs = edited_copies(0.1)[:24] + [(100 + i, t) for i, t in edited_copies(0.1)[:3]]
    docs = [(i, " ".join(t.split()[: 60 + 7 * (i % 13)])) for i, t in docs]
    got = ch.passages(spark.createDataFrame(docs, "row long, text string")).collect()
    texts = {i: ch.word_hashes(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())])) for i, t in docs}
    found = {i: ch.seeds(*x) for i, x in texts.items()}
    wanted = set()
    for a in texts:
        for b in texts:
            if a < b:
                _, x, y = ch.shared_seeds(found[a][1].view(np.int64), found[a][0], found[b][1].view(np.int64), found[b][0])
                for c in ch.chains(x, y) if len(x) else []:
                    hit = ch.align(texts[a][0], texts[b][0], c[:, 0], c[:, 1]) if len(c) > 1 else None
                    if hit and min(hit[1] - hit[0], hit[3] - hit[2]) >= ch.LEAST_WORDS:
                        wanted.add((a, b))
    member, linked = {}, set()
    for x in got:
        linked.add((x.a, x.b))
        for row, node in ((x.a, x.a_node), (x.b, x.b_node)):
            if node is not None:
                member.setdefault(node, set()).add(row)
    for x in got:
        if x.a_node is not None:
            linked |= {(min(a, b), max(a, b)) for a in member[x.a_node] for b in member[x.b_node] if a != b}
    assert len(wanted) > 40 and linked == wanted


def test_pairs_of_nodes_move_as_numbers(spark, monkeypatch):
    """No join brings the words of both nodes to each pair of them."""
    plans, plain = {}, ch.written

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return plain(df, name)

    monkeypatch.setattr(ch, "written", noted)
    assert ch.passages(spark.createDataFrame(edited_copies(0.04), "row long, text string")).count() >= 59
    assert "words" in plans["nodes"] and "words" not in plans["node-pairs"]


def test_pairs_of_nodes_equal_all_pairs(spark):
    r = random.Random(4)
    numbers = [(k % 3 << ch.FILE_BITS) + k // 3 * 40 for k in range(90)]  # three files, many runs
    held = {n: set(r.sample(range(60), r.randint(0, 12))) | ({99} if k % 2 else set()) for k, n in enumerate(numbers)}
    rows = spark.createDataFrame([(n, h) for n, hs in held.items() for h in hs], "id long, h long").repartition(5)
    got = sorted((x.a, x.b) for x in ch.node_pairs(rows).collect())
    assert got == sorted((a, b) for a in numbers for b in numbers if a < b and len(held[a] & held[b]) > 1)


def test_content_is_found_by_number(spark, tmp_path):
    """Files of several batches; the lesser node is a; the last text is taken where both nodes begin with one text."""
    place = lambda row: (row, 1, 2, 3, False, b"%d" % row)
    nodes = [(k * 7919 % 1000 - 500, place(k // 2), place(2000 + k) if k % 4 else None, [k, k + 1], [0, k]) for k in range(1000)]
    schema = f"node long, top struct<{PLACE}>, far struct<{PLACE}>, h array<int>, at array<int>"
    rows = spark.createDataFrame(nodes, schema).repartition(2)
    numbered = ch.written(rows.mapInArrow(ch._content_rows(str(tmp_path)), "node long, id long, file string"), "numbers")
    files = {x.part: x.file for x in numbered.select(F.shiftright("id", ch.FILE_BITS).alias("part"), "file").distinct().collect()}
    ids = {x.node: x.id for x in numbered.collect()}
    assert len(files) > 1 and len(set(ids.values())) == 1000
    by_node, r = {n[0]: n for n in nodes}, random.Random(3)
    pairs = [tuple(r.sample(list(ids), 2)) for _ in range(500)] + [(nodes[k][0], nodes[k + 1][0]) for k in range(0, 1000, 2)]
    asked = pa.RecordBatch.from_pydict({c: [ids[p[i]] for p in pairs] for i, c in enumerate("ab")})
    got = [x for b in ch._fetched(str(tmp_path), files, lambda batches: batches)(iter([asked])) for x in b.to_pylist()]
    want = []
    for a, b in map(sorted, pairs):
        one, two = by_node[a], by_node[b]
        pa_, pb_ = one[1], two[1]
        if pa_[0] == pb_[0]:
            pa_, pb_ = (one[2], pb_) if one[2] else (pa_, two[2])
        want.append((a, b, pa_, pb_, one[3], one[4], two[3], two[4]))
    assert [(x["a"], x["b"], tuple(x["pa"].values()), tuple(x["pb"].values()), x["ha"], x["ata"], x["hb"], x["atb"]) for x in got] == want


SIDE = pa.struct([("row", pa.int64()), ("begin", pa.int32()), ("lead", pa.int32()), ("size", pa.int32()), ("open", pa.bool_()), ("words", pa.binary())])


def edited_pairs(n, seed):
    """Two edited versions of a text each, with the chains of their 5-word matches (some of them no match at all)."""
    r = random.Random(seed)
    for k in range(n):
        text = [r.randrange(9 if k % 3 == 0 else 5000) for _ in range(r.randint(8, 150))]
        sides = []
        for _ in range(2):
            side = [r.randrange(5000) for _ in range(r.choice([0, 3, 70]))]
            for w in text:
                side += [[w], [], [r.randrange(5000)], [w, r.randrange(9)], [w] + [r.randrange(9) for _ in range(80)]][r.choices(range(5), [90, 3, 3, 3, 1])[0]]
            sides.append(np.array(side + [r.randrange(5000) for _ in range(r.choice([0, 3, 70]))], np.uint32))
        a, b = sides
        where = {}
        for i in range(len(a) - ch.K + 1):
            where.setdefault(a[i : i + ch.K].tobytes(), []).append(i)
        points = [(i, j) for j in range(len(b) - ch.K + 1) for i in where.get(b[j : j + ch.K].tobytes(), []) if r.random() < 0.4]
        if min(len(a), len(b)) >= ch.K:
            points += [(r.randint(0, len(a) - ch.K), r.randint(0, len(b) - ch.K)) for _ in range(r.randint(0, 2))]
        points = np.array(sorted(set(points)), np.int64).reshape(-1, 2)
        yield a, b, ch.chains(points[:, 0], points[:, 1]) if len(points) else []


def test_common_words_of_many_gaps():
    r = np.random.RandomState(2)
    lists = [(r.randint(0, 6, n), r.randint(0, 6, m)) for n, m in r.randint(1, 65, (300, 2)).tolist() + [[1, 1]] * 9 + [[64, 64], [1, 64], [64, 1]]]
    a, b = (np.concatenate([x[k] for x in lists]).astype(np.uint32) for k in (0, 1))
    na, nb = (np.array([len(x[k]) for x in lists]) for k in (0, 1))
    assert ch.common_many(a, np.cumsum(na) - na, na, b, np.cumsum(nb) - nb, nb).tolist() == [ch.common(*x) for x in lists]


def test_chains_of_many_pairs_are_aligned_as_one_by_one(monkeypatch):
    pairs = list(edited_pairs(150, 6))
    side = lambda k: ch._Side(pa.array([(0, 0, 0, len(p[k]), False, p[k].tobytes()) for p in pairs], SIDE))
    row = np.array([k for k, p in enumerate(pairs) for _ in p[2]])
    every = [c for p in pairs for c in p[2]]
    limits, points = np.r_[0, np.cumsum([len(c) for c in every])], np.concatenate(every)
    wanted = [ch.align(*pairs[k][:2], c[:, 0], c[:, 1]) or (0,) * 5 for k, c in zip(row, every)]
    assert len(every) > 250 and sum(w[4] > 40 for w in wanted) > 40
    for compared, ahead in ((1 << 21, 64), (1 << 21, 1), (900, 8), (1, 3)):
        monkeypatch.setattr(ch, "COMPARED", compared)
        monkeypatch.setattr(ch, "AHEAD", ahead)
        found, before, after = ch.align_many(side(0), side(1), row, limits, points[:, 0], points[:, 1])
        assert list(map(tuple, found.T.tolist())) == wanted
        for k, c, p, q in zip(row, every, before, after):
            a, b, (x, y), (u, v) = *pairs[k][:2], c[0], c[-1]
            assert q == ch._equal(a[u:], b[v:]) and p == ch._equal(a[:x][::-1], b[:y][::-1])


def test_equal_predecessors_give_the_nearest():
    """Scores in words are whole numbers, so ties do not depend on rounding: of equal predecessors the one with the largest y is taken, then the one with the largest x."""
    r, per_match = random.Random(8), round(ch.K / ch.GAP)
    for _ in range(60):
        points = sorted({(r.randint(0, 200), r.randint(0, 200)) for _ in range(r.randint(2, 60))}, key=lambda p: (p[0], -p[1]))
        score, back = {}, {}
        for x, y in points:
            gain, v, u = max(((score[u, v] - (x - u) - (y - v), v, u) for u, v in score if u < x and v < y), default=(0, 0, 0))
            score[x, y], back[x, y] = (per_match + gain, (u, v)) if gain > 0 else (per_match, None)
        best, path = max(points, key=score.get), []
        while best:
            path, best = [list(best), *path], back[best]
        assert ch.chains(*np.array(points).T)[0].tolist() == path


def test_no_pair_of_nodes_is_aligned_alone(monkeypatch):
    """Python steps for each pair of nodes took longer than the limit on 0.51 GB."""
    texts = [np.array([t.encode() for t in text.split()]) for _, text in edited_copies(0.04)]
    words = {w: k + 1 for k, w in enumerate(sorted({w for t in texts for w in t}))}
    texts = [np.array([words[w] for w in t], np.uint32)[20:-20] for t in texts]
    found = []
    for t in texts:
        at, h = ch.seeds(t.astype(np.uint64), np.zeros(len(t), np.int64))
        found.append(((h >> np.uint64(32)).astype(np.uint32).view(np.int32), at.astype(np.int32)))
    pairs = [(a, b) for a in range(len(texts)) for b in range(a)]
    columns = {"a": [p[0] for p in pairs], "b": [p[1] for p in pairs]}
    for c, k in (("a", 0), ("b", 1)):
        columns[f"p{c}"] = pa.array([(p[k], 0, 0, len(texts[p[k]]), False, texts[p[k]].tobytes()) for p in pairs], SIDE)
        columns[f"h{c}"], columns[f"at{c}"] = (pa.array([found[p[k]][j] for p in pairs], pa.list_(pa.int32())) for j in (0, 1))
    batch = pa.RecordBatch.from_pydict(columns)
    monkeypatch.setattr(ch, "align", None)
    rows = [x for b in ch._node_rows(40)(iter([batch])) for x in b.to_pylist()]
    assert len({(x["a"], x["b"]) for x in rows}) > 1000 and all(x["a"] < x["b"] and x["a_end"] - x["a_begin"] >= 40 for x in rows)


def test_texts_of_nodes_move_as_numbers(spark, monkeypatch):
    """Words of both texts went by shuffle with every two texts that a pair of nodes asks for, and with every copy."""
    plans, plain = {}, ch.written

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return plain(df, name)

    monkeypatch.setattr(ch, "written", noted)
    docs = edited_copies(0.04)
    got = ch.passages(spark.createDataFrame(docs + [(100 + i, t + " end") for i, t in docs[:5]], "row long, text string")).collect()
    assert {(x.a, x.b) for x in got if x.a_node == x.b_node and x.a_node} >= {(i, 100 + i) for i in range(5)}
    assert "words" in plans["segments"] and "words" not in plans["passages"]


def test_pairs_of_nodes_are_counted_in_blocks(monkeypatch):
    """The lists of a count are bounded by a run and a block, whatever the number of nodes; the pairs are those of all nodes."""
    monkeypatch.setattr(ch, "BLOCK", 512)
    starts = ch._block_starts({0: 1_300, 1: 100, 2: 300, 3: 700})
    whole = [*range(1_300), *(k << 32 | n for k, size in ((1, 100), (2, 300), (3, 700)) for n in range(size))]
    r = random.Random(3)
    lists = [whole, whole[5::7], sorted(r.sample(whole, 900)), whole[10:11], whole[3:5]]
    batch = pa.RecordBatch.from_pydict({"ids": pa.array(lists, pa.list_(pa.int64()))})
    pieces = {}
    for out in ch._seed_groups(iter([batch]), starts):
        assert max(out.column("ids").value_lengths().to_pylist()) <= 512
        for k in range(out.num_rows):
            pieces.setdefault((out.column("g")[k].as_py(), out.column("block")[k].as_py()), []).append(out.slice(k, 1))
    got = sorted(p for group in pieces.values() for b in ch._group_pairs(iter(group)) for p in zip(b.column("a").to_pylist(), b.column("b").to_pylist()))
    counts = np.zeros((len(whole), len(lists)), np.int32)
    for k, one in enumerate(lists):
        counts[np.searchsorted(whole, one), k] = 1
    at = np.argwhere(np.triu(counts @ counts.T, 1) > 1)
    assert got == [(whole[i], whole[j]) for i, j in at.tolist()]
