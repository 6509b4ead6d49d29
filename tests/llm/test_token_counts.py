import random

import public_tokenizers
from tokenizers import Tokenizer

from quillstream.llm import token_counts as tc

PATH = public_tokenizers.path("word_bpe_49k.json")


def counter():
    v = tc.Vocabulary(PATH)
    return tc.Counter(v.pattern, v.special, v.ranks, v.whole, v.source), Tokenizer.from_file(PATH)


def test_every_proven_string_is_one_token_and_no_other_is():
    own, library = counter()
    assert len(own.whole) > 30_000
    ends = [k[: -len(tc.END)] for k in library.get_vocab() if k.endswith(tc.END)]
    for text in own.whole:
        if own.find(text) == [text] and text == text.lower():
            assert len(library.encode(text, add_special_tokens=False).ids) == 1, text
    assert {e for e in ends if e.isascii() and e.isalpha()} == {w for w in own.whole if w.isascii() and w.isalpha()}


def test_counts_equal_the_library(spark):
    r = random.Random(2)
    letters = "abcdeéßñΣσςçİıﬁŉ中文かな가а́ \n\t  　'’s!?.,;0123456789<|>&\U0001f600\U0001f468‍\U0001f469\x00\x1c\x85"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 80))) for _ in range(400)]
    texts += ["", None, "don't can'T I'LL we've 'd", "<|endoftext|>", "a<|startoftext|>b <|endoftext|> c", "<|endoftext|", "x" * 6000, "thing " * 30_000, "été"]
    _, library = counter()
    rows = spark.createDataFrame([(i % 390, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_bytes string")
    got = sorted((x.doc_id, x.n_bytes, x.n_tokens) for x in tc.count_tokens(rows, PATH).collect())
    want = sorted((i % 390, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts))
    assert got == want
    assert tc.count_tokens(rows.limit(0), PATH).count() == 0


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(tc, "MEMO", 50)
    own, library = counter()
    text = " ".join(f"zq{i}x" for i in range(500))
    assert own.count(text) == len(library.encode(text, add_special_tokens=False).ids)
    assert len(own) <= len(own.whole) + 60
