import random

import pandas as pd
import xxhash
from pyspark.sql import functions as F

from quillstream.llm import simhash


def plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = min(3, len(words))
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), 42) for i in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprint_is_the_majority_of_shingle_hashes(spark):
    for text in ("", "One", "one two", "A b  c\nd e a b c", "é " * 50, "x y z " * 400):
        assert simhash.fingerprint(text.encode()) == plain(text)
    got = spark.createDataFrame([("a b c",)], "t string").select(F.xxhash64("t")).first()[0]
    assert got % 2**64 == simhash.fingerprint(b"A  b c")


def test_classes_equal_brute_force(spark):
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rows, base = [], [[r.choice(words) for _ in range(150)] for _ in range(25)]
    for i in range(200):
        text = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 5])):
            text[r.randrange(len(text))] = r.choice(words)
        rows.append((i, " ".join(text), "x"))
    rows += [(200, None, "x"), (201, "", None), (202, " \n", "x"), (203, "one", "x"), (7, rows[7][1], "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.classes(docs).toPandas()
    prints = [plain(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    want = sorted((d, prints[i], least[find(i)]) for i, (d, _, _) in enumerate(rows))
    assert sorted((a, b % 2**64, c) for a, b, c in got.itertuples(index=False)) == want
    assert len({c for _, _, c in want}) < 150
    kept = simhash.near_dedup(docs)
    assert kept.columns == docs.columns
    assert {x.doc_id for x in kept.collect()} == {c for _, _, c in want}


def test_links_find_every_pair_within_two_bits(spark):
    r = random.Random(1)
    seeds = [r.getrandbits(64) for _ in range(40)]
    fps = {s for x in seeds for s in [x, *(x ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(6))]}
    frame = spark.createDataFrame(pd.DataFrame({"fp": [f - 2**64 if f >= 2**63 else f for f in fps]}))
    got = {frozenset((a % 2**64, b % 2**64)) for a, b in simhash.links(frame).collect()}
    assert got == {frozenset((a, b)) for a in fps for b in fps if a != b and (a ^ b).bit_count() <= 2}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.classes(docs).count() == 0 and simhash.near_dedup(docs).count() == 0
