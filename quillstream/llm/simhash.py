"""SimHash near-duplicate search by multi-index hashing.

Fingerprints: majority bits of the XXH64 (seed 42) of all 3-word shingles of a text whose A-Z are
lower-cased. Two texts are linked when their fingerprints differ in at most two bits.

Search: a 64-bit fingerprint is cut into two 32-bit segments. If two fingerprints differ in at most
two bits, one segment differs in at most one. So each distinct fingerprint looks up, in the table of
its segments, the Hamming ball of radius one around each segment; the complete distance is
verified on each match inside the join. A flip is tried from 0 to 1 only: of two segments
that differ in one bit, the one with the 0 finds the other.
Copies share a fingerprint and meet only in an aggregate, so a group of copies costs no pairs.

Two segments suit up to about 2**32 different fingerprints; beyond that, a bucket of a segment holds several on average, and the probes grow
faster than the data.

Defined results: null text = empty; a text without words has fingerprint zero and is linked like any
other; repeated doc_ids give one row per input row; rows without doc_id go; extra columns, clashing names included, are not read; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .shared import documents, keyed_text, prepare, without, written

SHINGLE = 3
SEED = 42
MAX_BITS = 2
SEGMENT_BITS = 32


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    n = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist())]
    ones = np.zeros(64, np.int64)
    packed = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    for k in range(0, len(packed), 65536):
        ones += np.unpackbits(packed[k : k + 65536], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        found = np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    prepare(docs.sparkSession)
    return keyed_text(docs).mapInArrow(_fingerprints, "doc_id long, fp long")


def links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """distinct(fp) -> (a, b): pairs of different fingerprints within max_bits (at most 3) bits."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two segments with balls of radius one find at most 3 differing bits")
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", SEGMENT_BITS)
    segments = distinct.select("fp", F.posexplode(F.array(low, high)).alias("seg", "part"))
    table = segments.select(F.col("seg"), F.col("part"), F.col("fp").alias("b"))
    flips = F.expr("filter(transform(sequence(0, 31), j -> shiftleft(1L, j)), m -> (part & m) = 0)")
    balls = F.concat(F.array(F.lit(0).cast("long")), flips)
    probes = segments.select("seg", "part", "fp", F.explode(balls).alias("flip")).select(
        "seg", F.col("part").bitwiseXOR(F.col("flip")).alias("part"), F.col("fp").alias("a"), "flip"
    )
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    once = (F.col("flip") != 0) | (F.col("a") < F.col("b"))
    return probes.join(table, (probes.seg == table.seg) & (probes.part == table.part) & near & once).select("a", "b")


def classes(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """-> (doc_id, fp long, component_id): the smallest doc_id that links lead to."""
    marked = written(fingerprints(docs), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(links(distinct.select("fp"), max_bits))
    rooted = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "roots")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return marked.join(rooted.join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """docs, one row of each group: the one with the smallest doc_id. All columns are kept.

    Rows without doc_id stay; of rows that share a doc_id all stay if it is the smallest.
    """
    return without(docs, classes(docs, max_bits).where("doc_id <> component_id").select("doc_id"), "doc_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
