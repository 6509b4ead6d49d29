import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from quillstream.llm import suffix_dedup as sd


def brute(texts, length):
    bodies = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        runs = int((np.diff(np.r_[0, gone.astype(int), 0]) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def test_column_bwt_against_sorting():
    r = random.Random(3)
    for _ in range(60):
        strings = [[r.randint(1, 3) for _ in range(r.randint(0, 14))] for _ in range(r.randint(1, 12))]
        ends = np.cumsum([len(s) for s in strings])
        if not ends[-1]:
            continue
        bwt, lcp, string, start = sd.column_bwt(np.array([x for s in strings for x in s]), ends)
        want = sorted((tuple((1, x) for x in s[i:]) + ((0, k),), k, i) for k, s in enumerate(strings) for i in range(len(s) + 1))
        assert list(zip(string.tolist(), start.tolist())) == [(k, i) for _, k, i in want]

        def common(a, b):
            n = 0
            while a[n] == b[n]:
                n += 1
            return n

        assert lcp.tolist() == [0] + [common(want[i - 1][0], want[i][0]) for i in range(1, len(want))]
        assert [int(b > 0) for b in bwt] == [int(i > 0) for _, _, i in want]


def corpus(seed):
    r = random.Random(seed)
    words = ["lorem", "ipsum", "dé", "a", "of", "xyzzy", "quux", "\n", "été"] + [f"w{i}" for i in range(300)]
    make = lambda n: " ".join(r.choice(words) for _ in range(n))
    passages = [make(r.randint(10, 60)) for _ in range(8)]
    texts = [make(r.randint(0, 120)) for _ in range(40)]
    for _ in range(40):
        texts.append(make(r.randint(0, 40)) + r.choice(passages) + make(r.randint(0, 40)) + r.choice(passages)[: r.randint(1, 200)])
    texts += [texts[3], texts[3], texts[50], texts[45][:-5] + "!" + texts[45][-5:], None, "", "aaaa" * 60, "ab" * 90, "x" + "aaaa" * 30]
    return texts


@pytest.mark.parametrize("length,hot", [(100, 50_000), (64, 50_000), (100, 2), (77, 1)])
def test_cut_equals_brute_force(spark, length, hot):
    texts = corpus(length + hot)
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    got = {x.row: (x.n_bytes, x.n_removed, x.n_spans, hashlib.sha256(bytes(x.kept)).hexdigest()) for x in sd.cut_repeats(rows, length, hot).collect()}
    want = brute(texts, length)
    assert [got[i] for i in range(len(texts))] == want
    assert sum(w[1] > 0 for w in want) > 20


def test_pipeline_form(spark):
    base = "é" * 300
    docs = spark.createDataFrame(
        [(1, base, "en", 300), (2, base, "en", 300), (3, "tail " + base + " end", "en", 309), (3, "own text", None, 8), (None, None, "en", None), (5, "", "en", 0)],
        "doc_id long, text string, row string, n_chars long",
    )
    out = sorted((x.doc_id or 0, x.text, x.n_chars) for x in sd.dedup_documents(docs).collect() if x.text is not None)
    assert out == [(3, "own text", 8), (3, "tail  end", 9), (5, "", 0)]
    assert sd.dedup_documents(docs).columns == docs.columns
    assert sd.dedup_documents(docs.limit(0)).count() == 0


def test_query_tells_repeated_ids_apart(spark, tmp_path):
    texts = corpus(5)
    rows = [(i % 60, t) for i, t in enumerate(texts)]
    for name, table in (("twice", rows), ("unique", list(enumerate(texts)))):
        spark.createDataFrame(table, "doc_id long, text string").write.parquet(str(tmp_path / name / "documents.parquet"))
        got = sorted((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in sd.query(spark, str(tmp_path / name)).collect())
        assert got == sorted((d, *w) for (d, _), w in zip(table, brute(texts, sd.LENGTH)))


def test_a_core_with_more_slices_than_hot(spark):
    """One core whose flanks differ in more than HOT slices is cut again; equal to a count of all windows."""
    length, r = 64, np.random.RandomState(4)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
    tries = letters[r.randint(0, 26, 400_000)]
    at = np.arange(len(tries) - sd.GRAM)
    core = tries[(best := int(sd.Hasher(tries).of(at, at + sd.GRAM).argmin())) : best + sd.GRAM + 1].tobytes()  # every window around it picks this gram
    n = sd.HOT + 3000
    flanks = letters[r.randint(0, 26, (n, 62))]
    flanks[:1500, 12:44] = flanks[1500:3000, 12:44]  # these pairs share windows
    flanks[100:110] = flanks[90:100]
    texts = [f[:31].tobytes().decode() + core.decode() + f[31:].tobytes().decode() for f in flanks]
    windows = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    want = {}
    for row, t in enumerate(texts):
        gone = set()
        for i in range(len(t) - length + 1):
            if windows[t[i : i + length]] > 1:
                gone.update(range(i, i + length))
        want[row] = len(gone)
    assert sum(map(bool, want.values())) >= 2900
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    slices = rows.count()
    assert slices > sd.HOT
    assert {x.row: x.n_removed for x in sd.cut_repeats(rows, length).select("row", "n_removed").collect()} == want


def test_long_slices_with_known_collisions_are_told_apart():
    """Thue-Morse strings and their complements collide in polynomials modulo a power of two."""
    morse = np.array([bin(i).count("1") % 2 for i in range(2048)])
    data = np.where(np.r_[morse, 1 - morse] == 1, ord("b"), ord("a")).astype(np.uint8)
    hasher = sd.Hasher(data)
    a, b = np.array([0]), np.array([2048])
    assert hasher.raw(a, a + 2048) == hasher.raw(b, b + 2048)
    assert hasher.wide(a, a + 2048) != hasher.wide(b, b + 2048)
    again = sd.Hasher(np.concatenate([data, data]))
    assert again.wide(a, a + 1500) == again.wide(a + 4096, a + 5596)


def test_one_very_long_text(spark):
    r = random.Random(8)
    passage, filler = ("".join(r.choice("abcdefgh ") for _ in range(n)) for n in (900, 1_500_000))
    rows = spark.createDataFrame([(1, filler[:700_000] + passage + filler[700_000:]), (2, passage), (3, filler[:399])], "row long, text string")
    got = {x.row: x.n_removed for x in sd.cut_repeats(rows).collect()}
    assert got == {1: 900, 2: 900, 3: 0}


def test_memory_of_a_batch_does_not_grow_with_it():
    """A batch is hashed in short runs of rows: its arrays would take some hundred times its bytes."""
    import tracemalloc

    r = random.Random(8)
    texts = ["".join(r.choices("abcdefgh ", k=4000)) for _ in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000), pa.int64()), pa.array(texts)], names=["row", "text"])
    for _ in sd._anchor_rows(200)(iter([batch.slice(0, 10)])):
        pass
    tracemalloc.start()
    try:
        found = [b.num_rows for b in sd._anchor_rows(200)(iter([batch]))]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert sum(found) > 10_000 and peak < 80_000_000


def test_tables_between_the_steps_start_few_processes(spark, tmp_path, monkeypatch):
    """Each file that a task writes to a local disk starts a process, which shares the executor's memory for a moment."""
    import pathlib

    from quillstream.llm import shared

    monkeypatch.setattr(shared, "shared_folder", lambda _: str(tmp_path))
    passage = "".join(random.Random(2).choices("abcdefgh ", k=500))
    rows = spark.createDataFrame([(i, f"{i} {passage} {i}") for i in range(4)], "row long, text string")
    assert {x.n_removed >= 500 for x in sd.cut_repeats(rows).collect()} == {True}
    left = {p.name.rsplit("-", 1)[0] for p in pathlib.Path(tmp_path, "quillstream").iterdir()}
    assert left == {"repeated-anchors", "hits"}  # what is read once is not written
    table = shared.written(rows, "table")
    assert table.count() == 4 and not list(pathlib.Path(table._quillstream_path).glob(".*.crc"))
