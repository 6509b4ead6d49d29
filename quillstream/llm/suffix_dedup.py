"""Suffix-array dedup: removes every byte inside a long string that also starts anywhere else.

Repeats are read off a collection Burrows-Wheeler transform (BWT) and its longest-common-prefix
(LCP) column, both built column-wise: each round inserts one symbol of every string of the
collection, from right to left, and updates both columns in one sequential pass.

A round rewrites the columns, so the collections must hold short strings to be affordable. They are
made so without losing a repeat:

1. Anchors. Every window of `length` bytes picks the smallest hash of its GRAM-byte grams (leftmost
   on ties). Equal windows pick the same gram at the same offset. Only anchors whose
   hash occurs at least twice can lie in a repeated window.
2. Blocks. The windows of an anchor are cut, by their offset from it, into blocks of up to BLOCK
   consecutive starts. All windows of a block share its core, the bytes common to the whole block.
   A slice is: left flank, core (ONE symbol of the collection, named by a 128-bit hash), right flank;
   at most 2*BLOCK-1 symbols. A window is exactly BLOCK symbols of a slice that contain
   the core, and equal windows lie in slices of the same core at the same offset.
3. Collections. Anchors whose windows hold the same text, and then equal slices, are one string with a multiplicity
   (aggregated before the shuffle, so copies cost nothing). Slices meet by core. The column-wise construction over each bucket gives the
   LCP of neighbouring suffixes; a window start whose suffix shares BLOCK symbols with a
   neighbour, or whose slice has a multiplicity over one, is a repeat.
4. Cores that have very many different slices (HOT) are cut again into blocks of FINE starts, whose
   cores include most of the flanks, so that no bucket gathers them.

The columns of a bucket are arrays in memory, rewritten sequentially each round: a bucket is handled in
collections of at most COLLECTION strings of at most 2*BLOCK-1 symbols, so no scratch files are needed.

Defined results: null text = empty; matches never cross documents; rows are judged on their own, so repeated rows
and repeated doc_ids are distinct places; a text shorter than `length` keeps all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from .kernel import Hasher, chunks, mix, signed, spread, text_buffers
from .shared import documents, drop_written, is_numbered, prepare, with_row, written

LENGTH = 400
GRAM = 32
BLOCK = 32
FINE = 4
HOT = 50_000
COLLECTION = 4_000
#: Bytes of text hashed at once (a longer single text is hashed whole): the arrays of a chunk take some 100 times as much memory, more for short windows.
CHUNK = 1 << 18
#: Low bits of an anchor key that hold the place in a chunk: a single text may have up to 2 GB.
PLACE_BITS = np.uint64(31)
CORE = 256  # symbols below are bytes


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` keys, by block-wise prefix and suffix minima."""
    n = len(keys) - width + 1
    if n <= 0:
        return keys[:0]
    pad = -len(keys) % width
    grid = np.concatenate([keys, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, limits: np.ndarray, hasher: Hasher, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(position, hash, first window, last window, row) of every anchor and the run of windows that picked it."""
    none = np.zeros(0, np.int64)
    n = len(data) - length + 1
    if n <= 0:
        return none, none.view(np.uint64), none, none, none
    at = np.arange(len(data) - GRAM + 1)
    full = hasher.of(at, at + GRAM)
    keys = ((full >> PLACE_BITS) << PLACE_BITS) | at.astype(np.uint64)
    least = (sliding_least(keys, length - GRAM + 1) & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
    starts = np.arange(n)
    rows = np.searchsorted(limits, starts, side="right") - 1
    good = starts + length <= limits[rows + 1]
    starts, least, rows = starts[good], least[good], rows[good]
    if not len(starts):
        return none, none.view(np.uint64), none, none, none
    new = np.ones(len(starts), bool)
    new[1:] = (least[1:] != least[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return least[first], full[least[first]], starts[first], starts[last], rows[first]


def _anchor_rows(length: int):
    """(row, at, before, after, h, c): the anchor at byte `at` was picked by the windows that start before..after bytes
    ahead of it; h is its gram, c the text of all these windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("row")
            for rows, data, limits in chunks(batch, most=CHUNK):
                hasher = Hasher(data)
                at, hashes, lo, hi, row = anchors(data, limits, hasher, length)
                context = mix(mix(hasher.wide(lo, hi + length)) + ((at - lo) * (2 * length) + hi - lo).astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(rows.start).take(pa.array(row)), pa.array((at - limits[row]).astype(np.int32)), pa.array((at - lo).astype(np.int16)),
                        pa.array((at - hi).astype(np.int16)), pa.array(signed(hashes)), pa.array(signed(context)),
                    ],
                    names=["row", "at", "before", "after", "h", "c"],
                )

    return run


def _slice_rows(length: int, block: int):
    """Slices of the blocks of the wanted anchors of each text; start is relative to the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("wanted")
            wanted, wanted_at = lists.values, lists.offsets.to_numpy()
            for rows, data, limits in chunks(batch, most=CHUNK):
                hasher = Hasher(data)
                a, b = wanted_at[rows.start], wanted_at[rows.stop]
                mine = wanted.slice(a, b - a)
                owner = np.repeat(np.arange(rows.stop - rows.start), np.diff(wanted_at[rows.start : rows.stop + 1]))
                at = mine.field("at").to_numpy().astype(np.int64) + limits[owner]
                lo, hi = at - mine.field("before").to_numpy(), at - mine.field("after").to_numpy()
                # block j of an anchor: windows whose offset from it is in [j*block, (j+1)*block)
                j0, j1 = (at - hi) // block, (at - lo) // block
                times = j1 - j0 + 1
                which = np.repeat(np.arange(len(at)), times)
                j = j0[which] + np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
                at = at[which]
                s0 = np.maximum(lo[which], at - j * block - block + 1)
                s1 = np.minimum(hi[which], at - j * block)
                core0, core1 = at - j * block, at - j * block - block + 1 + length
                tag = (j.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                raw = hasher.wide(core0, core1)
                k1 = mix(raw ^ tag)
                k2 = mix((raw + tag) ^ hasher.of(at, at + GRAM) ^ hasher.raw(core0 + 1, core1 - 7))
                left, right = core0 - s0, s1 + length - core1
                size = left + right
                ends = np.cumsum(size)
                seat = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)
                in_left = seat < np.repeat(left, size)
                source = np.where(in_left, np.repeat(s0, size) + seat, np.repeat(core1 - left, size) + seat)
                offsets = np.concatenate([[0], ends]).astype(np.int32)
                flanks = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[source]))])
                index = pa.array(which)
                yield pa.RecordBatch.from_arrays(
                    [
                        mine.field("h").take(index), mine.field("c").take(index), mine.field("n").take(index), pa.array((s0 - at).astype(np.int16)),
                        pa.array(signed(k1)), pa.array(signed(k2)), flanks, pa.array(left.astype(np.int16)),
                    ],
                    names=["h", "c", "many", "start", "k1", "k2", "flanks", "left"],
                )

    return run


def column_bwt(symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Column-wise construction over strings that end at ends[i] in `symbols` (positive ints).

    Returns (bwt, lcp, string, start): for every suffix, in sorted order, the symbol before it (0: none), the
    common prefix with the suffix above, the string and the place it starts at. The end mark of string i sorts
    before all symbols and before that of string i+1.
    """
    n = len(ends)
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    alphabet, ranks = np.unique(symbols, return_inverse=True)
    symbols = (ranks + 1).astype(np.uint16 if len(alphabet) < 65000 else np.uint32)
    size = int((ends - begins).max(initial=0))
    here = ends.astype(np.int64)  # place of the first symbol of the suffix inserted last
    bwt = np.where(ends > begins, symbols[np.maximum(ends - 1, 0)], 0).astype(symbols.dtype)
    lcp = np.zeros(n, np.uint8 if size < 250 else np.int32)
    suffix = here.copy() * n + np.arange(n)  # place and string
    where = np.arange(n)  # row of that suffix in the columns
    alive = np.flatnonzero(ends > begins)
    while len(alive):
        order = np.argsort(bwt, kind="stable")
        by_symbol = bwt[order]
        rank = np.empty(len(bwt), np.int32)
        rank[order] = np.arange(len(bwt), dtype=np.int32)
        # rows whose symbol stands as the head of a suffix already: all but those whose symbol is inserted now
        standing = bwt > 0
        standing[where[alive]] = False
        before = np.cumsum(standing[order])
        seat = rank[where[alive]]
        by_seat = np.argsort(seat)  # by symbol, then by row: the order of the new suffixes
        alive, seat = alive[by_seat], seat[by_seat]
        insert = n + before[seat]  # suffixes of the columns that sort before; the n end marks come first

        levels, width = [lcp], 1
        while 2 * width <= len(lcp):
            levels.append(np.minimum(levels[-1][:-width], levels[-1][width:]))
            width *= 2

        def least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """Least common prefix in rows a+1..b, for a < b."""
            k = np.frexp((b - a).astype(np.float64))[1] - 1
            out = np.empty(len(a), np.int32)
            for level in np.unique(k):
                pick = k == level
                out[pick] = np.minimum(levels[level][a[pick] + 1], levels[level][b[pick] - (1 << int(level)) + 1])
            return out

        # two suffixes with one head symbol share one symbol more than the rows that they extend
        previous = np.maximum(seat - 1, 0)
        pair = (seat > 0) & (by_symbol[seat] == by_symbol[previous])
        above = np.zeros(len(alive), lcp.dtype)
        above[pair] = 1 + least(order[previous[pair]], order[seat[pair]])
        following = np.minimum(seat + 1, len(bwt) - 1)
        pair = (following > seat) & (by_symbol[seat] == by_symbol[following])
        pair[pair] = standing[order[following[pair]]]
        lcp = lcp.copy()
        lcp[insert[pair]] = 1 + least(order[seat[pair]], order[following[pair]])

        # one sequential pass writes the columns anew with the inserted rows
        here[alive] -= 1
        gone = here[alive] == begins[alive]
        back = np.where(gone, 0, symbols[np.maximum(here[alive] - 1, 0)])
        new_at = insert + np.arange(len(alive))
        fresh = np.zeros(len(bwt) + len(alive), bool)
        fresh[new_at] = True
        old = ~fresh
        columns = []
        for column, inserted in ((bwt, back), (lcp, above), (suffix, here[alive] * n + alive)):
            longer = np.empty(len(fresh), column.dtype)
            longer[old] = column
            longer[new_at] = inserted
            columns.append(longer)
        bwt, lcp, suffix = columns
        where[alive] = new_at
        alive = alive[~gone]
    string = suffix % n
    return bwt, lcp, string, suffix // n - begins[string]


def repeated_starts(k: np.ndarray, flanks: list[bytes], left: np.ndarray, many: np.ndarray, block: int) -> np.ndarray:
    """Bit i: the window that starts at symbol i of the slice is a repeat. k: number of the slice's core.

    A slice that is the only one of its core needs no sorting: equal windows share a core, so it repeats itself or nothing."""
    lengths = np.fromiter(map(len, flanks), np.int64, len(flanks))
    windows = lengths + 2 - block
    masks = np.where(many > 1, (np.int64(1) << windows) - 1, 0)
    alone = np.bincount(k)[k] == 1
    rest = np.flatnonzero(~alone)
    if not len(rest):
        return masks
    left, k = left[rest], k[rest]
    size = lengths[rest] + 1
    ends = np.cumsum(size)
    body = np.frombuffer(b"".join(flanks[i] for i in rest.tolist()), np.uint8)
    symbols = np.empty(ends[-1], np.int64)
    core = ends - size + left
    flank = np.ones(len(symbols), bool)
    flank[core] = False
    symbols[flank] = body.astype(np.int64) + 1
    symbols[core] = CORE + 1 + k
    _, lcp, string, start = column_bwt(symbols, ends)
    long = lcp >= block
    hit = long.copy()
    hit[:-1] |= long[1:]
    hit &= (start < size[string] - block + 1) & (start <= left[string])
    found = np.zeros(len(rest), np.int64)
    np.bitwise_or.at(found, string[hit], np.int64(1) << start[hit])
    masks[rest] |= found
    return masks


def _repeats(block: int):
    """Sorted slices of a bucket (s, k1, k2, flanks, left, many) -> (s, mask) of those with a repeat.

    Rows come sorted by core, so a collection is cut at a change of core; a core has at most HOT slices."""

    def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        k1, k2 = table["k1"].to_numpy(), table["k2"].to_numpy()
        core = np.cumsum(np.r_[0, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
        masks = repeated_starts(core, table["flanks"].to_pylist(), table["left"].to_numpy().astype(np.int64), table["many"].to_numpy(), block)
        some = np.flatnonzero(masks)
        return pa.RecordBatch.from_arrays(
            [table["s"].combine_chunks().take(pa.array(some)), pa.array(k1[some]), pa.array(masks[some])], names=["s", "k1", "mask"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n += batch.num_rows
            if n < COLLECTION:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            k1, k2 = table["k1"].to_numpy(), table["k2"].to_numpy()
            cuts = np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1
            if len(cuts):
                yield flush(table.slice(0, int(cuts[-1])).to_batches())
                held = table.slice(int(cuts[-1])).to_batches()
                n = sum(b.num_rows for b in held)
        if held:
            yield flush(held)

    return run


def _collections(slices: DataFrame, block: int) -> DataFrame:
    """Distinct slices (s, k1, k2, flanks, left, many) -> (s, mask)."""
    dealt = slices.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "s")
    return dealt.select("s", "k1", "k2", "flanks", "left", "many").mapInArrow(_repeats(block), "s long, k1 long, mask long")


def _finer(block: int, fine: int):
    """Cuts slices into slices of `fine` starts; base is the first of them, o1 the core that was cut.

    In a slice, the window at symbol i has offset left-i from the core. A cell is the windows of `fine` consecutive
    offsets; what all its windows share around the core joins the core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("s", "k1", "k2", "flanks", "left", "many")
        for batch in batches:
            out = []
            for s, k1, k2, flanks, left, many in zip(*(batch.column(c).to_pylist() for c in names)):
                nearest, farthest = left - (len(flanks) + 1 - block), left
                for cell in range(nearest // fine, farthest // fine + 1):
                    low, high = max(nearest, cell * fine), min(farthest, cell * fine + fine - 1)
                    core0, core1 = left - cell * fine, left + block - 1 - (cell * fine + fine - 1)
                    core1 = max(core1, left)
                    a, b = left - high, left + block - 1 - low
                    digest = hashlib.blake2b(flanks[core0:core1], digest_size=16, key=f"{k1},{k2},{cell}".encode()).digest()
                    out.append((
                        s, k1, a, int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True),
                        flanks[a:core0] + flanks[core1:b], core0 - a, many,
                    ))
            columns = list(zip(*out)) or [()] * 8
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int16(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=["s", "o1", "base", "k1", "k2", "flanks", "left", "many"]
            )

    return run


def _distinct(slices: DataFrame) -> DataFrame:
    return slices.groupBy("s", "k1", "k2", "flanks", "left").agg(F.sum("many").alias("many"))


def repeated_windows(rows: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """rows(row, text) -> (row, at, hits): bit i of a hit's mask says that the window at byte at+start+i is a repeat."""
    found = written(rows.mapInArrow(_anchor_rows(length), "row long, at int, before short, after short, h long, c long"), "anchors")
    often = found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    repeated = written(found.join(often, "h"), "repeated-anchors")
    # anchors with one text around them are one string with a multiplicity; its first place stands for all
    place = F.struct("row", "at", "before", "after")
    contexts = repeated.groupBy("h", "c").agg(F.count("*").alias("n"), F.min(place).alias("p"))
    wanted = contexts.groupBy("p.row").agg(F.collect_list(F.struct("p.at", "p.before", "p.after", "h", "c", "n")).alias("wanted"))
    located = rows.join(wanted, "row").select("row", "text", "wanted")
    slices = located.mapInArrow(_slice_rows(length, BLOCK), "h long, c long, many long, start short, k1 long, k2 long, flanks binary, left short")
    slices = written(slices.withColumn("s", F.xxhash64("k1", "k2", "flanks", "left")), "slices")
    distinct = _distinct(slices.select("s", "k1", "k2", "flanks", "left", "many"))
    heavy = distinct.groupBy("k1", "k2").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("k1", "k2")
    heavy = written(heavy, "hot-cores")
    if heavy.isEmpty():
        masks = _collections(distinct, BLOCK)
    else:
        cold = distinct.join(heavy, ["k1", "k2"], "left_anti")
        cut = distinct.join(heavy, ["k1", "k2"], "left_semi").select("s", "k1", "k2", "flanks", "left", "many")
        cut = cut.mapInArrow(_finer(BLOCK, FINE), "s long, o1 long, base int, k1 long, k2 long, flanks binary, left short, many long")
        cut = cut.withColumn("t", F.xxhash64("k1", "k2", "flanks", "left"))
        cut = written(cut, "fine-slices")
        fine = _collections(_distinct(cut.select(F.col("t").alias("s"), "k1", "k2", "flanks", "left", "many")), FINE)
        fine = cut.select("s", "o1", "t", "k1", "base").join(fine.withColumnRenamed("s", "t"), ["t", "k1"])
        fine = fine.groupBy("s", F.col("o1").alias("k1")).agg(F.bit_or(F.expr("shiftleft(mask, base)")).alias("mask"))
        masks = _collections(cold, BLOCK).unionByName(fine)
    hits = slices.select("h", "c", "start", "s", "k1").join(masks, ["s", "k1"])
    hits = written(hits.groupBy("h", "c").agg(F.collect_list(F.struct("start", "mask")).alias("hits")), "hits")
    for done in (found, slices, heavy):  # nothing after this reads them
        drop_written(done)
    return repeated.select("row", "at", "h", "c").join(hits, ["h", "c"]).select("row", "at", "hits")


def _cut_rows(length: int, keep: list[str]):
    """(row, text, found, other columns) -> what stays of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.arange(BLOCK)
        for batch in batches:
            kept, removed, spans = [], [], []
            data, limits = text_buffers(batch.column("text"))
            for i, found in enumerate(batch.column("found").to_pylist()):
                body = data[limits[i] : limits[i + 1]]
                if not found or not len(body):
                    kept.append(body.tobytes())
                    removed.append(0)
                    spans.append([])
                    continue
                start = np.array([x["at"] + y["start"] for x in found for y in x["hits"]], np.int64)
                mask = np.array([y["mask"] for x in found for y in x["hits"]], np.int64)
                hit = (start[:, None] + bits)[(mask[:, None] >> bits & 1).astype(bool)]
                inside = spread(hit, hit + length, len(body))
                edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
                kept.append(body[~inside].tobytes())
                removed.append(int(inside.sum()))
                spans.append([{"begin": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"), pa.array(np.diff(limits)), pa.array(removed, pa.int64()), pa.array([len(s) for s in spans], pa.int64()),
                    pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
                    *(batch.column(c) for c in keep),
                ],
                names=["row", "n_bytes", "n_removed", "n_spans", "kept", "spans", *keep],
            )

    return run


CUT_SCHEMA = "row long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<begin: long, end: long>>"


def cut_repeats(rows: DataFrame, length: int = LENGTH, hot: int = HOT, keep: tuple[str, ...] = ()) -> DataFrame:
    """rows(row unique, text, columns to keep) -> (row, n_bytes, n_removed, n_spans, kept binary, spans, those columns)."""
    if length < GRAM + BLOCK:
        raise ValueError(f"length must be at least {GRAM + BLOCK}")
    prepare(rows.sparkSession)
    texts = rows.select("row", F.coalesce("text", F.lit("")).alias("text"), *keep)
    found = repeated_windows(texts.select("row", "text"), length, hot).groupBy("row").agg(F.collect_list(F.struct("at", "hits")).alias("found"))
    schema = StructType(_parse_datatype_string(CUT_SCHEMA).fields + [texts.schema[c] for c in keep])
    return texts.join(found, "row", "left").select("row", "text", "found", *keep).mapInArrow(_cut_rows(length, list(keep)), schema)


def dedup_documents(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with repeated strings cut out of text; n_chars, if there, follows.

    A document that loses all its text goes; one that was empty or null before stays as it is. A cut can split a
    UTF-8 character: the bytes that are left of it go too."""
    names = {c: f"__{i}" for i, c in enumerate(docs.columns) if c != "text"}  # no clash with the columns made here
    held = with_row(docs).select(F.col("__row").alias("row"), "text", F.col("text").isNull().alias("__null"), *(F.col(c).alias(n) for c, n in names.items()))
    cut = cut_repeats(held, length, keep=("__null", *names.values()))
    whole = F.col("kept").cast("string")
    rest = F.when(F.col("__null"), F.lit(None)).when(F.col("n_removed") == 0, whole).otherwise(F.regexp_replace(F.make_valid_utf8(whole), "\uFFFD", ""))
    out = cut.withColumn("__text", rest).where("n_removed = 0 or length(__text) > 0")
    if "n_chars" in names:
        n = F.length("__text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn(names["n_chars"], F.when(F.col("n_removed") > 0, n).otherwise(F.col(names["n_chars"])))
    return out.select(*(F.col("__text" if c == "text" else names[c]).alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_row(documents(spark, sf_dir).select("doc_id", "text"))
    cut = cut_repeats(docs.select(F.col("__row").alias("row"), "text"))
    if is_numbered(docs):
        cut = cut.join(docs.select(F.col("__row").alias("row"), "doc_id"), "row")
    else:
        cut = cut.withColumnRenamed("row", "doc_id")
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
