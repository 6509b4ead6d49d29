import itertools
import random

import numpy as np
import pytest
import sentencepiece

from quillstream.llm import pieces

PATH = pieces.model_path()


@pytest.fixture(scope="module")
def model():
    return pieces.load(PATH)


def every_segmentation(lattice, escaped):
    out = []

    def walk(i, score, ids):
        if i == len(escaped):
            out.append((score, ids))
            return
        single = False
        for j in range(i + 1, len(escaped) + 1):
            piece = lattice.normal.get(escaped[i:j])
            if piece:
                single |= j == i + 1
                walk(j, score + piece[1], ids + [piece[0]])
        if not single:
            walk(i + 1, score + lattice.unknown, ids + [lattice.byte_ids[b] for b in escaped[i].encode()])

    walk(0, 0.0, [])
    return sorted(out, key=lambda x: -x[0])


def applied(ids, changes):
    ids = list(ids)
    for at, n, new in reversed(changes):
        ids[at : at + n] = new
    return ids


def test_n_best_equals_all_segmentations(model):
    r = random.Random(3)
    texts = ["a b", "the cat", "  x\n y", "é\U0001f600 z", "aaaaaaa", "a\n\nb c", "in in in", "\t"] + ["".join(r.choice("thean io\n") for _ in range(r.randint(1, 11))) for _ in range(40)]
    for n in (1, 2, 5):
        lattice = pieces.Lattice(model, n)
        for text in texts:
            merged, ids, score, others = lattice.encode(text)
            want = every_segmentation(lattice, ("▁" + text).replace(" ", "▁"))
            got = [(score, ids.tolist())] + [(s, applied(ids.tolist(), c)) for s, c in others]
            assert [s for s, _ in got] == [s for s, _ in want[:n]]
            assert len({tuple(i) for _, i in got}) == len(got)
            assert all((s, i) in want for s, i in got)
            assert lattice.decode(ids.tolist()) == lattice.decode(merged.tolist()) == text


def test_ids_equal_the_library(model):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    r = random.Random(5)
    texts = ["", " ", "  two  spaces ", "a▁b", "line\nline\r\n\tx", "\U0001f9ea 文 é", "…”word“ – x²", "\x00", "日本語 x" * 30, "x" * 500, "the" * 40 + "!?" * 30, "the " * 300]
    texts += ["".join(r.choice("thean ioéß.,'\n\U0001f600§") for _ in range(r.randint(1, 120))) for _ in range(300)]
    got = pieces.Lattice(model, 2).encode_all(texts)
    assert [x[0].tolist() for x in got] == library.encode(texts)


def test_array_steps_equal_the_search_of_one_chunk(model):
    """Short chunks go through arrays, long ones one at a time: both ways agree on both."""
    r = random.Random(6)
    chunks = list({"▁" * r.randint(0, 1) + "".join(r.choice("theanioé€") for _ in range(r.randint(1, pieces.LONG))) for _ in range(300)})
    lattice = pieces.Lattice(model, 2)
    rows = [lattice[c] for c in chunks]
    lattice.learn()
    for row, chunk in zip(rows, chunks):
        ids, score, loss = lattice.best_and_loss(chunk)
        one = np.array([row])
        assert (tuple(lattice.best.take(one)[0].tolist()), lattice.scores[row]) == (ids, score)
        assert lattice.losses[row] == pytest.approx(loss) and lattice.merged.take(one)[0].tolist() == lattice.merge(chunk)


def test_full_memo_changes_nothing(model, monkeypatch):
    texts = ["the cat in the hat", "one two three", "x" * 90, "the cat"] * 3
    want = [(a.tolist(), b.tolist(), s, o) for a, b, s, o in pieces.Lattice(model, 3).encode_all(texts)]
    monkeypatch.setattr(pieces, "MEMO", 3)
    lattice = pieces.Lattice(model, 3)
    got = [x for t in texts for x in lattice.encode_all([t])]
    assert [(a.tolist(), b.tolist(), s, o) for a, b, s, o in got] == want


def test_viterbi_equals_the_library_as_a_unigram_model(model):
    """The same file with its model type set to unigram segments by the same lattice."""
    data = bytearray(open(PATH, "rb").read())
    found = None
    for at in range(len(data) - 1, 0, -1):
        if data[at - 1] == 0x18 and data[at] == 2:
            copy = bytes(data[:at]) + b"\x01" + bytes(data[at + 1 :])
            try:
                library = sentencepiece.SentencePieceProcessor(model_proto=copy)
                library.nbest_encode_as_ids("the", 2)
                found = library
                break
            except Exception:
                continue
    if found is None:
        pytest.skip("the library does not read the changed file")
    lattice = pieces.Lattice(model, 3)
    score = {i: s for i, s in lattice.normal.values()}
    r = random.Random(1)
    for _ in range(60):
        text = " ".join("".join(r.choice("theanioé.") for _ in range(r.randint(1, 9))) for _ in range(r.randint(1, 6)))
        theirs = found.nbest_encode_as_ids(text, 3)
        _, ids, best, others = lattice.encode(text)
        assert [best] + [s for s, _ in others] == [sum(score[i] for i in x) for x in theirs]


def test_round_trip_and_edge_cases(spark):
    texts = ["plain text", "", None, "  two  spaces ", "line\nline\r\n\tx", "\U0001f9ea 文 é", "▁", "x" * 3000, "word " * 20_000, "\x00"]
    docs = spark.createDataFrame([(i % 8, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    out = pieces.encode(docs, PATH, 3)
    rows = out.collect()
    assert all(x.round_trip for x in rows) and len(rows) == len(texts)
    back = sorted((x.doc_id, x.text) for x in pieces.decode(out, PATH).collect())
    assert back == sorted((i % 8, (t or "").replace("▁", " ")) for i, t in enumerate(texts))
    best = sorted((x.doc_id, x.text) for x in pieces.decode(out, PATH, "best_ids").collect())
    assert best == back
    assert pieces.encode(docs.limit(0), PATH).count() == 0
    for x in rows:
        scores = [x.score] + [a.score for a in x.alternatives]
        assert scores == sorted(scores, reverse=True) and len(scores) <= 3


def test_document_sums_equal_brute_force(model):
    lattice = pieces.Lattice(model, 6)
    chunks = ["▁the", "▁on", "▁in"]
    options = [lattice.search(c) for c in chunks]
    want = sorted((-sum(o[0] for o in pick) for pick in itertools.product(*options)))[:6]
    _, _, best, others = lattice.encode("the on in")
    assert [-best] + [-s for s, _ in others] == want


def test_memory_of_the_texts_that_are_encoded_together(model):
    """The chunks of 500 texts of 4000 bytes took over 100 MB, at the start of every task."""
    import tracemalloc

    r = random.Random(4)
    words = ["".join(r.choices("abcdefghijklmnop", k=r.randint(2, 8))) for _ in range(3000)]
    texts = [" ".join(r.choices(words, k=650)) for _ in range(500)]
    lattice = pieces.Lattice(model)
    tracemalloc.start()
    try:
        for a in range(0, 500, pieces.TEXTS):
            assert all(len(ids) for ids, *_ in lattice.encode_all(texts[a : a + pieces.TEXTS]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 45_000_000
