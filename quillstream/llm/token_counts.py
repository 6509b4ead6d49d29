"""Token counts of a byte-level BPE with word ends, by the whole-token shortcut.

Offline, `prove_whole` merges every vocabulary string that can stand alone (it ends a word) and
keeps those that the merges turn back into exactly one token. Online, a pre-token found in
that proven table counts one at once; only the rest is merged, with a bounded memo of results.
The normaliser (NFC, white space, lower case per character) and the pre-tokeniser are those that the
vocabulary file states. Texts are cut at the file's special strings first, which count
one token each. Characters on which this interpreter's Unicode tables and the library's
may differ are outside the proof: `Counter.count` takes `exact` (the library itself) for texts that hold one.

Defined results: null text = empty = 0 tokens; texts are whole, however long; repeated rows and ids give one row
each; other columns are dropped; an empty table gives none.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, keyed_text, prepare

LIMIT = 2048
#: Entries of a worker's memo of merged pre-tokens; a full memo starts afresh.
MEMO = 400_000
END = "</w>"


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


class Vocabulary:
    """What the counter needs of a tokenizer file; its size is that of the file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.source = f.read()
        spec = json.loads(self.source)
        model = spec["model"]
        steps = spec["normalizer"]["normalizers"]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if (
            model["type"] != "BPE"
            or model["end_of_word_suffix"] != END
            or [x["type"] for x in steps] != ["NFC", "Replace", "Lowercase"]
            or not (split["behavior"] == "Removed" and split["invert"])
        ):
            raise ValueError(f"{path}: not a lower-case byte-level BPE with word ends")
        self.pattern = split["pattern"]["Regex"]
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.ranks = {tuple(pair.split(" ") if isinstance(pair, str) else pair): i for i, pair in enumerate(model["merges"])}
        self.vocab = model["vocab"]
        self.whole = prove_whole(self.vocab, self.ranks)


def merged(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Applies the merge of the lowest rank until none applies."""
    get = ranks.get
    while len(symbols) > 1:
        best, at = None, -1
        for i in range(len(symbols) - 1):
            rank = get((symbols[i], symbols[i + 1]))
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            break
        pair = (symbols[at], symbols[at + 1])
        out, i, last = symbols[:at], at, len(symbols) - 1
        while i <= last:
            if i < last and symbols[i] == pair[0] and symbols[i + 1] == pair[1]:
                out.append(pair[0] + pair[1])
                i += 2
            else:
                out.append(symbols[i])
                i += 1
        symbols = out
    return symbols


def prove_whole(vocab: dict[str, int], ranks: dict[tuple[str, str], int]) -> set[str]:
    """Texts of the vocabulary strings that, alone, encode as one token."""
    back = {c: b for b, c in enumerate(byte_characters())}
    proven = set()
    for entry in vocab:
        body = entry[: -len(END)] if entry.endswith(END) else ""
        if not body or any(c not in back for c in body):
            continue
        try:
            text = bytes(back[c] for c in body).decode("utf-8")
        except UnicodeDecodeError:
            continue
        if merged([*body[:-1], body[-1] + END], ranks) == [entry]:
            proven.add(text)
    return proven


class Counter(dict):
    """Counts of pre-tokens; a missing one is merged and remembered."""

    def __init__(self, pattern: str, special: list[str], ranks: dict, whole: set[str], source: str | None = None):
        super().__init__(dict.fromkeys(whole, 1))
        self.whole, self.ranks, self.source = whole, ranks, source
        self.find = regex.compile(pattern).findall
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.characters = byte_characters()
        self.library = None

    def __missing__(self, token: str) -> int:
        body = [self.characters[b] for b in token.encode("utf-8")]
        body[-1] += END
        n = len(merged(body, self.ranks)) if len(body) < 2000 else self.exact(token)
        if len(self) > len(self.whole) + MEMO:
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))
        self[token] = n
        return n

    def exact(self, text: str) -> int:
        """The library's own count; also used for single runs so long that merging in Python would be quadratic."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.source)
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def _plain(self, text: str) -> int:
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:
            text = text.replace("Σ", "σ")  # no final form: lower case character by character
        return sum(map(self.__getitem__, self.find(text.lower())))

    def count(self, text: str) -> int:
        if self.source is not None and not text.isascii() and RARE.search(text):
            return self.exact(text)
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        return sum(map(self._plain, self.special.split(text))) + len(self.special.findall(text))


#: Everything outside the scripts whose Unicode data has been stable for decades (Latin, Greek, Cyrillic, CJK, kana, common punctuation).
RARE = regex.compile(r"[^\x00-ɏ̀-ͯΑ-ΡΣ-ωЀ-џḀ-ỿ‐-‧‰-⁞€←-⇿ぁ-ゖァ-ヺ一-龥가-힣]")


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_bytes, n_tokens)."""
    spark = docs.sparkSession
    prepare(spark)
    v = Vocabulary(path)
    parts = spark.sparkContext.broadcast((v.pattern, v.special, v.ranks, v.whole, v.source))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(*parts.value)
        for batch in batches:
            column = batch.column("text")
            tokens = [counter.count(t) for t in column.to_pylist()]
            sizes = np.asarray(pa.compute.binary_length(column), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return keyed_text(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = count_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
