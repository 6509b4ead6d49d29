"""Substring dedup by collinear chaining: fuzzy passages that documents share.

Words are maximal runs of bytes that are not white space, A-Z lower-cased.

1. Seeds: of every WINDOW neighbouring K-word shingles the smallest hash (a minimizer), so any run of WINDOW+K-1 equal
   words gives both documents the same seed. Seeds that occur once are dropped.
2. Segments: the places of a seed are sorted by (seed, document, place) in range partitions, so a frequent seed is spread over
   many tasks. Runs of repeated seeds of a document are its segments, from the first seed to the last (their core). Documents with the same core
   are one node: they share that passage, whatever surrounds it, so they need no pairs. A core that is too short to be a passage takes MARGIN words
   on both sides in.
3. Chains: all pairs of nodes that share two seeds are candidates, whichever documents stand between. They move as two numbers; what the nodes hold lies once in
   files of the shared folder, which the tasks map into memory (`_content_rows`, `_fetched`). A chain may step to a match that lies later in both; it pays
   GAP for each word skipped in either. As this cost splits into a part of each end, the best predecessor is a prefix maximum over places in the second
   node, kept as the steps where it rises.
4. Alignment: matches are extended word by word, and the gaps between them are aligned by
   longest common subsequence. The part of the chain with the largest sum of +1 per equal word and -4 per other word is the passage
   (80 % equal words is where that sum is zero); it is reported from LEAST_WORDS words on.
   If that many lie in both cores, the passage holds for all documents of both nodes; if it takes the words around, every two of these documents are aligned.
5. Rows: a node has a row for each document against its first one (membership: passage_id equals other_passage_id), two nodes have one row. Documents of one passage_id
   are linked with each other and, where a row pairs two ids, with all of the other; a row without ids links its two documents only. So no link between two documents
   is left out, and copies are not expanded. The pairs of nodes do grow with the square of the number of different versions of a passage.
   Passages that share a seed are of one class (connected components over the seeds of passages), with the number of texts in it.

Defined results: null text = empty; a passage that repeats inside one document only is not reported; repeated rows and ids are different documents;
texts of fewer than K words have no passages; empty tables give none.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import connected_components
from .kernel import LOWER, Hasher, chunks, shingles, signed, text_buffers, words
from .shared import documents, drop_folder, drop_written, prepare, shared_folder, with_row, written
from .suffix_dedup import sliding_least

K = 5
WINDOW = 16
GAP = 0.05
LEAST_WORDS = 40
#: Words fetched beyond both ends of a chain; runs of equal words longer than that have a seed, so they are in the chain.
MARGIN = WINDOW + K
#: Gaps between matches up to this many words are aligned word by word; more are other text.
MOST_GAP = 64
#: Seeds farther apart than this are in segments of their own: with MARGIN equal words beyond both, over MOST_GAP words differ, which costs more than the
#: LEAST_WORDS words that make a passage of its own.
FAR = K + MOST_GAP + 2 * MARGIN
PENALTY = 4
#: Nodes are numbered by the task that stores them (high bits) and the place in its file; the pairs of a run of 1 << GROUP_BITS numbers with a block of
#: BLOCK nodes at most are counted together, so the memory of a count does not grow with the number of nodes.
FILE_BITS, GROUP_BITS, BLOCK = 32, 8, 1 << 14
#: Nodes in a batch of a file; pairs whose content is fetched at once; batches that a task keeps open.
STORED, FETCHED, OPEN = 256, 500, 4_000
#: Bytes of words handed on at once; places of diagonals compared at once, beyond which a single pair of texts is aligned by align(); words
#: compared beyond the last match on a diagonal before the whole of it.
HANDED, COMPARED, AHEAD = 1 << 23, 1 << 21, 64
_PLACE = np.uint64(31)


def word_hashes(data: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = LOWER[data]
    starts, ends, rows = words(data, limits)
    return Hasher(data).of(starts, ends), rows


def seeds(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the first word, hash) of the minimizers; a short row gives its smallest shingle."""
    at, h = shingles(hashes, rows, K)
    if not len(at):
        return at, h
    keys = ((h >> _PLACE) << _PLACE) | np.arange(len(at), dtype=np.uint64)
    least = (sliding_least(keys, WINDOW) & ((np.uint64(1) << _PLACE) - np.uint64(1))).astype(np.int64)
    owner = rows[at]
    whole = owner[: len(least)] == owner[WINDOW - 1 :]
    picks = [least[whole]]
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    last = np.append(first[1:], len(at))
    for a, b in zip(first[last - first < WINDOW].tolist(), last[last - first < WINDOW].tolist()):
        picks.append(np.array([a + int(np.argmin(h[a:b] >> _PLACE))]))
    pick = np.unique(np.concatenate(picks))
    return at[pick], h[pick]


def _seed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("row")
        for part, data, limits in chunks(batch):
            hashes, rows = word_hashes(data, limits)
            at, h = seeds(hashes, rows)
            first = np.searchsorted(rows, np.arange(len(limits)))
            row = rows[at]
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(h)), ids.slice(part.start).take(pa.array(row)), pa.array((at - first[row]).astype(np.int32))], names=["h", "row", "at"]
            )


PLACE = "h long, row long, at int, before_row long, before_at int, top_row long, top_at int, edge int"


def _place_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted seeds -> the places of repeated seeds with the place before and the first place of the seed.

    edge is 1 for the first and 2 for the last place of the task (3 for both), which are given even if alone. Null: the place before the
    task's first place, and the first place of the seed that the task begins with."""
    last = top = None  # the place before the held one; the first place of its seed
    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]

    def rows(h, row, at, n: int, ended: bool) -> pa.RecordBatch:
        """The first n places; the one after them, if any, only tells whether the n-th is repeated."""
        nonlocal last, top
        new = np.r_[last is not None and h[0] != last[0], h[1:] != h[:-1]]
        start = np.maximum.accumulate(np.where(new, np.arange(len(h)), -1))
        inside = start >= 0
        top_row, top_at = (np.where(inside, c[np.maximum(start, 0)], top[k] if top else 0) for k, c in enumerate((row, at)))
        unknown = ~inside if top is None else np.zeros(len(h), bool)
        before_row, before_at = (np.r_[c[0] if last is None else last[k], c[:-1]] for k, c in ((1, row), (2, at)))
        edge = np.zeros(len(h), np.int32)
        if last is None:
            edge[0] |= 1
        if ended:
            edge[n - 1] |= 2
        keep = np.flatnonzero((~new | np.r_[~new[1:], False] | (edge > 0))[:n])
        lone = (new | (edge & 1 > 0))[keep]
        if not unknown[n - 1]:
            top = top_row[n - 1], top_at[n - 1]
        last = h[n - 1], row[n - 1], at[n - 1]
        columns = [
            pa.array(h[keep]), pa.array(row[keep]), pa.array(at[keep].astype(np.int32)), pa.array(before_row[keep], mask=lone), pa.array(before_at[keep].astype(np.int32), mask=lone),
            pa.array(top_row[keep], mask=unknown[keep]), pa.array(top_at[keep].astype(np.int32), mask=unknown[keep]), pa.array(edge[keep]),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["h", "row", "at", "before_row", "before_at", "top_row", "top_at", "edge"])

    for batch in batches:
        held = [np.concatenate([old, batch.column(c).to_numpy()]) for old, c in zip(held, ("h", "row", "at"))]
        if len(held[0]) > 1:
            yield rows(*held, len(held[0]) - 1, False)
            held = [c[-1:] for c in held]
    if len(held[0]):
        yield rows(*held, 1, True)


def places(rows: DataFrame) -> DataFrame:
    """rows(row, text) -> PLACE: the places of seeds that occur more than once (and at most two others a task)."""
    found = rows.mapInArrow(_seed_rows, "h long, row long, at int")
    return written(found.repartitionByRange("h", "row", "at").sortWithinPartitions("h", "row", "at").mapInArrow(_place_rows, PLACE), "places")


def linked(held: DataFrame) -> DataFrame:
    """places() -> (a, x, b, y), the same however the seeds were cut into tasks."""
    edges = held.where("edge > 0")
    tops = (
        edges.where("edge in (1, 3)").select("h", F.col("row").alias("r"), F.col("at").alias("p"))
        .unionByName(edges.where("edge in (2, 3) and top_row is not null").select("h", F.col("top_row").alias("r"), F.col("top_at").alias("p")))
        .groupBy("h").agg(F.min(F.struct("r", "p")).alias("top"))
    )
    place = [F.col("row").alias("b"), F.col("at").alias("y")]
    before = held.where("before_row <> row").select(F.col("before_row").alias("a"), F.col("before_at").alias("x"), *place)
    # a task begins and ends with one seed each, so the broadcast has at most two rows a task
    whole = held.join(F.broadcast(tops), "h", "left").withColumns({"top_row": F.coalesce("top_row", "top.r"), "top_at": F.coalesce("top_at", "top.p")})
    first = whole.where("top_row <> row and not (before_row <=> top_row and before_at <=> top_at)").select(F.col("top_row").alias("a"), F.col("top_at").alias("x"), *place)
    order = Window.partitionBy("h").orderBy("row", "at")
    over = edges.select("h", "row", "at", "edge", F.lag("row").over(order).alias("a"), F.lag("at").over(order).alias("x")).where("edge in (1, 3) and a <> row")
    return before.unionByName(first).unionByName(over.select("a", "x", *place))


def links(rows: DataFrame) -> DataFrame:
    """rows(row, text) -> (a, x, b, y): place x of row a and place y of row b > a start the same K words. At most two links a place: not all pairs, so passages() does not rest on it."""
    return linked(places(rows))


def shared_seeds(ha: np.ndarray, xa: np.ndarray, hb: np.ndarray, yb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(seed, x, y) of the seeds on both sides, sorted; a seed may hold the number of its pair of documents.

    A seed at p and q places gives all p * q matches while these are at most 4 * (p + q). Beyond that: the k-th with the k-th, from either end, the first with
    each and each with the first, so every place has a match and their number stays in proportion to the texts."""
    order = np.lexsort((xa, ha))
    ha, xa = ha[order], xa[order]
    order = np.lexsort((yb, hb))
    hb, yb = hb[order], yb[order]
    lo, first = np.searchsorted(hb, ha), np.searchsorted(ha, ha)
    q, p = np.searchsorted(hb, ha, side="right") - lo, np.searchsorted(ha, ha, side="right") - first
    few = (q > 0) & (p * q <= 4 * (p + q))
    n = np.where(few, q, 0)
    i = np.repeat(np.arange(len(ha)), n)
    j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + lo[i]
    hs, xs, ys = [ha[i]], [xa[i]], [yb[j]]
    for k in np.unique(first[(q > 0) & ~few]).tolist():
        x, y = xa[k : k + p[k]], yb[lo[k] : lo[k] + q[k]]
        m = min(len(x), len(y))
        xs += [x[:m], x[-m:], x, np.full(len(y), x[0])]
        ys += [y[:m], y[-m:], np.full(len(x), y[0]), y]
        hs.append(np.full(2 * m + len(x) + len(y), ha[k]))
    h, x, y = np.concatenate(hs), np.concatenate(xs).astype(np.int64), np.concatenate(ys).astype(np.int64)
    order = np.lexsort((y, x, h))
    h, x, y = h[order], x[order], y[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])][: len(h)]
    return h[new], x[new], y[new]


def chains(x: np.ndarray, y: np.ndarray, weight: float = K) -> list[np.ndarray]:
    """Collinear chains of the matches (x[i], y[i]), best first; every match is in one chain at most.

    score(j) = weight + max(0, max over i with x_i < x_j, y_i < y_j of score(i) - GAP * (steps in x and in y))."""
    order = np.lexsort((-y, x))
    x, y = x[order], y[order]
    return [np.stack([x[path], y[path]], axis=1).astype(np.int64) for path in _paths(x, y, round(weight / GAP))]


def _paths(x: np.ndarray, y: np.ndarray, weight: int, least: int = 1) -> list[list[int]]:
    """chains() of `least` matches and more, as numbers of the matches, which come in order of x and of falling y.

    Scores count in GAPs, so they are whole numbers and ties are ties: of equal predecessors the one with the largest y is taken, then the one with the largest x."""
    # prefix maxima over y of score + x + y, as the steps where they rise; a match is always above those of lesser y, and takes out what it is above
    steps, tops, who = [], [], []
    sums = x + y
    every, back = [0] * len(x), [-1] * len(x)
    for j, (here, sum_) in enumerate(zip(y.tolist(), sums.tolist())):
        at = bisect_left(steps, here)
        top = sum_
        if at and tops[at - 1] > sum_:
            top, back[j] = tops[at - 1], who[at - 1]
        top += weight
        every[j] = top
        if at == len(steps):
            steps.append(here)
            tops.append(top)
            who.append(j)
            continue
        upto = at
        if steps[at] == here:
            if tops[at] > top:
                continue
            upto += 1
        while upto < len(tops) and tops[upto] < top:
            upto += 1
        if upto == at + 1:
            steps[at], tops[at], who[at] = here, top, j
        else:
            steps[at:upto], tops[at:upto], who[at:upto] = (here,), (top,), (j,)
    out, used = [], bytearray(len(x) + 1)  # one more for -1
    used[-1] = 1
    for k in np.argsort(sums - np.array(every, np.int64), kind="stable").tolist():
        if not used[k]:
            used[k] = 1
            path = [k]
            k = back[k]
            while not used[k]:
                used[k] = 1
                path.append(k)
                k = back[k]
            if len(path) >= least:
                out.append(path[::-1])
    return out


PASSAGE = "a long, b long, a_begin long, a_end long, b_begin long, b_end long, n_equal long"
PLACE_OF_TEXT = ["row", "begin", "lead", "size", "open", "words"]
SEGMENT = "node long, row long, begin int, lead int, size int, open boolean, words binary, h array<long>, at array<int>"


def _segment_rows(least: int):
    """The segments of each text: `words` are 32 bits of each word's hash from word `begin` on; the core is its words lead..lead+size; `at` counts from the core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every_h, every_at = (batch.column(c).flatten().to_numpy() for c in ("h", "at"))
            offsets = np.r_[0, np.cumsum(pc.list_value_length(batch.column("h")).to_numpy())]
            ids, out = batch.column("row").to_numpy(), []
            for part, data, limits in chunks(batch):
                hashes, rows = word_hashes(data, limits)
                first = np.searchsorted(rows, np.arange(len(limits)))
                short = (hashes >> np.uint64(32)).astype(np.uint32)
                mine = slice(offsets[part.start], offsets[part.stop])
                owner = np.repeat(np.arange(part.stop - part.start), np.diff(offsets[part.start : part.stop + 1]))
                h, at = every_h[mine], every_at[mine]
                order = np.lexsort((at, owner))
                h, at, owner = h[order], at[order], owner[order]
                cuts = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (np.diff(at) > FAR)][: len(at)])
                for i, j in zip(cuts.tolist(), np.append(cuts[1:], len(at)).tolist()):
                    if j - i < 2:  # WINDOW + WINDOW + K - 1 equal words hold two minimizers
                        continue
                    w0, w1 = int(first[owner[i]]), int(first[owner[i] + 1])
                    a, z = w0 + int(at[i]), w0 + int(at[j - 1]) + K
                    lo, hi = max(w0, a - MARGIN), min(w1, z + MARGIN)
                    free = z - a >= least
                    if not free:
                        a, z = lo, hi
                    node = int.from_bytes(hashlib.blake2b(hashes[a:z].tobytes(), digest_size=8).digest(), "little", signed=True)
                    out.append((node, int(ids[part.start + owner[i]]), lo - w0, a - lo, z - a, free, short[lo:hi].tobytes(), h[i:j], (at[i:j] - (a - w0)).astype(np.int32)))
            yield _record(out, SEGMENT)

    return run


def _record(out: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    fields = [c.split() for c in schema.split(", ")]
    columns = list(zip(*out)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[kind]) for c, (_, kind) in zip(columns, fields)], names=[name for name, _ in fields])


def segments(rows: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """rows(row, text) -> SEGMENT: the runs of two and more repeated seeds, cut where two are over FAR words apart.

    Segments of one core are one node. A core of fewer than `least` words takes the words around it in, as its passage depends on them."""
    held = whole = places(rows)
    edges = held.where("edge > 0").select("h").distinct()  # at most two a task
    lone = held.join(F.broadcast(edges), "h").groupBy("h").agg(F.count("*").alias("n")).where("n = 1").select("h")
    held = held.join(F.broadcast(lone), "h", "left_anti")
    packs = held.groupBy("row").agg(F.collect_list(F.struct("h", "at")).alias("p")).select("row", "p.h", "p.at")
    out = written(rows.join(packs, "row").select("row", "text", "h", "at").mapInArrow(_segment_rows(least), SEGMENT), "segments")
    drop_written(whole)
    return out


def _local(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and its path there."""
    return fs.FileSystem.from_uri(re.sub("^file:/+", "/", folder))


def _content_rows(folder: str):
    """Nodes (node, top, far, h, at) -> (node, id, file); each task writes its nodes into one file, from which _fetched() reads them by number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _local(folder)
        part = TaskContext.get().partitionId()
        name, held, done, writer = f"{part}-{uuid.uuid4().hex}.arrow", [], 0, None

        def full(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            table = pa.Table.from_batches(held)
            upto = table.num_rows if last else table.num_rows // STORED * STORED
            held = table.slice(upto).to_batches()
            return (table.slice(k, min(STORED, upto - k)).combine_chunks().to_batches()[0] for k in range(0, upto, STORED))

        def store(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal done
            for batch in full(last):
                writer.write_batch(batch)
                ids = (part << FILE_BITS) + done + np.arange(batch.num_rows)
                done += batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(ids), pa.array([name] * batch.num_rows)], names=["node", "id", "file"])

        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                system.create_dir(path, recursive=True)
                sink = system.open_output_stream(f"{path}/{name}")
                writer = pa.ipc.new_file(sink, batch.schema)
            held.append(batch)
            if sum(b.num_rows for b in held) >= STORED:
                yield from store(False)
        if writer is not None:
            if held:
                yield from store(True)
            writer.close()
            sink.close()

    return run


def _seed_groups(batches: Iterator[pa.RecordBatch], starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sorted numbers of the nodes of each seed -> (g, block, own, ids): those of each run of numbers g and, block by block, those of the run and all that follow."""
    for batch in batches:
        every = batch.column("ids")
        for some in _runs(pc.list_value_length(every).to_numpy(), HANDED // 8):
            lists = every.slice(some.start, some.stop - some.start)
            flat, limits = lists.flatten().to_numpy(), np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy())]
            owner = np.repeat(np.arange(len(limits) - 1), np.diff(limits))
            named = flat >> GROUP_BITS, np.searchsorted(starts, flat, side="right")
            firsts = [np.flatnonzero(np.r_[True, (np.diff(name) != 0) | (np.diff(owner) != 0)][: len(flat)]) for name in named]
            (run, block), (run_end, block_end) = firsts, (np.append(x[1:], len(flat)) for x in firsts)
            # a run lies in one block; its pieces are that block from the run on and the blocks of the seed after it
            here, last = np.searchsorted(block, run, side="right") - 1, np.searchsorted(block, limits[owner[run] + 1]) - 1
            of, k = np.repeat(np.arange(len(run)), last - here + 1), _spans(here, last + 1)
            first, end = np.maximum(run[of], block[k]), block_end[k]
            pairs = end - first > (first == run[of])
            of, first, end = of[pairs], first[pairs], end[pairs]
            for some_ in _runs(run_end[of] - run[of] + end - first, HANDED // 8):
                mine = of[some_]
                own, ids = ((a, z) for a, z in ((run[mine], run_end[mine]), (first[some_], end[some_])))
                listed = [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(z - a)].astype(np.int32)), pa.array(flat[_spans(a, z)])) for a, z in (own, ids)]
                yield pa.RecordBatch.from_arrays([pa.array(named[0][run[mine]]), pa.array(named[1][first[some_]]), *listed], names=["g", "block", "own", "ids"])


def _group_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, block, own, ids) of one g and block -> (a, b): a in the run, b after it in the block, in two lists at least.

    The lists have no more than the seeds of the nodes of a run and a block, however many nodes there are; pairs are handed on as they are found."""
    table = pa.Table.from_batches(batches)
    own, lists = (table[c].combine_chunks() for c in ("own", "ids"))
    flat, limits = lists.flatten().to_numpy(), np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy())]
    nodes, piece = own.flatten().to_numpy(), np.repeat(np.arange(len(own)), pc.list_value_length(own).to_numpy())
    order = np.argsort(nodes, kind="stable")
    nodes, piece = nodes[order], piece[order]
    cuts = np.flatnonzero(np.r_[True, np.diff(nodes) != 0][: len(nodes)])
    a, b, n = [], [], 0
    for i, j in zip(cuts.tolist(), np.append(cuts[1:], len(nodes)).tolist()):
        if j - i > 1:
            others, times = np.unique(np.concatenate([flat[limits[k] : limits[k + 1]] for k in piece[i:j].tolist()]), return_counts=True)
            b.append(others[(times > 1) & (others > nodes[i])])
            a.append(np.full(len(b[-1]), nodes[i]))
            n += len(b[-1])
        if n > HANDED // 16:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
            a, b, n = [], [], 0
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])


def node_pairs(seeds_of: DataFrame, starts: np.ndarray = np.zeros(1, np.int64)) -> DataFrame:
    """(id, h) distinct -> (a, b), a < b: all pairs of nodes that share two seeds. What moves is the lists of nodes, once for each run of numbers, not the pairs of each seed.

    starts: the first numbers of the blocks."""
    lists = seeds_of.groupBy("h").agg(F.array_sort(F.collect_list("id")).alias("ids")).where("size(ids) > 1").select("ids")
    return lists.mapInArrow(lambda batches: _seed_groups(batches, starts), "g long, block long, own array<long>, ids array<long>").groupBy("g", "block").applyInArrow(_group_pairs, "a long, b long")


def _reader(folder: str, files: dict[int, str]):
    """-> a function of numbers in order, which gives the columns of what _content_rows() has stored under them; neighbouring numbers lie in one stored batch."""
    system, path = _local(folder)
    readers, stored = {}, {}

    def stored_at(part: int, at: int) -> pa.RecordBatch:
        if (part, at) not in stored:
            if part not in readers:
                name = f"{path}/{files[part]}"
                readers[part] = pa.ipc.open_file(pa.memory_map(name) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(name))
            if len(stored) >= (OPEN if isinstance(system, fs.LocalFileSystem) else 64):
                stored.clear()
            stored[part, at] = readers[part].get_batch(at)
        return stored[part, at]

    def read(ids: np.ndarray) -> dict[str, pa.Array]:
        place = ids & ((1 << FILE_BITS) - 1)
        cuts = np.flatnonzero(np.r_[True, (np.diff(ids >> FILE_BITS) != 0) | (np.diff(place // STORED) != 0)])
        found = [stored_at(int(ids[i] >> FILE_BITS), int(place[i] // STORED)).take(pa.array(place[i:j] % STORED)) for i, j in zip(cuts.tolist(), np.append(cuts[1:], len(ids)).tolist())]
        held = pa.Table.from_batches(found)
        return {c: held[c].combine_chunks() for c in held.column_names}

    return read


def _fetched(folder: str, files: dict[int, str], then):
    """Pairs (a, b) of numbers -> then() over batches (a, b, pa, pb, ha, ata, hb, atb) with what the nodes hold.

    A node's texts stand for each other; the last one is taken where the first is that of both nodes. A pair of nodes of one text only has no passage."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _reader(folder, files)
        for batch in batches:
            for k in range(0, batch.num_rows, FETCHED):
                # a node of several pairs is read once
                ids, at = np.unique(np.concatenate([batch.column(c).slice(k, FETCHED).to_numpy() for c in "ab"]), return_inverse=True)
                columns = read(ids)
                node, top = columns["node"].to_numpy(), columns["top"].field("row").to_numpy()
                has_far = columns["far"].is_valid().to_numpy(zero_copy_only=False)
                left, right = at[: len(at) // 2], at[len(at) // 2 :]
                left, right = np.where(node[left] < node[right], (left, right), (right, left))  # the lesser node is a
                same = top[left] == top[right]
                keep = np.flatnonzero(~same | has_far[left] | has_far[right])
                left, right, same = left[keep], right[keep], same[keep]
                far_left, far_right = same & has_far[left], same & ~has_far[left]
                places = pa.concat_arrays([columns["top"], columns["far"]]) if far_left.any() or far_right.any() else columns["top"]
                left_place, right_place = left + len(ids) * far_left, right + len(ids) * far_right
                size = pc.binary_length(places.field("words")).to_numpy(zero_copy_only=False)
                for some in _runs(size[left_place] + size[right_place], HANDED):
                    picked = {"a": columns["node"].take(pa.array(left[some])), "b": columns["node"].take(pa.array(right[some]))}
                    for c, side, place in (("a", left[some], left_place[some]), ("b", right[some], right_place[some])):
                        picked |= {f"p{c}": places.take(pa.array(place)), f"h{c}": columns["h"].take(pa.array(side)), f"at{c}": columns["at"].take(pa.array(side))}
                    yield pa.RecordBatch.from_pydict(picked)

    return lambda batches: then(rows(batches))


def _fetched_texts(folder: str, files: dict[int, str], then):
    """Pairs (a, b, ...) of numbers of segments -> then() over batches (pa, pb, ...) with their places; two places of one text are none."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _reader(folder, files)
        for batch in batches:
            for k in range(0, batch.num_rows, FETCHED):
                part = batch.slice(k, FETCHED)
                ids, at = np.unique(np.concatenate([part.column(c).to_numpy() for c in "ab"]), return_inverse=True)
                columns = read(ids)
                row, size = columns["row"].to_numpy(), pc.binary_length(columns["words"]).to_numpy()
                left, right = at[: part.num_rows], at[part.num_rows :]
                keep = np.flatnonzero(row[left] != row[right])
                left, right = left[keep], right[keep]
                places = pa.StructArray.from_arrays([columns[c] for c in PLACE_OF_TEXT], names=PLACE_OF_TEXT)
                for some in _runs(size[left] + size[right], HANDED):
                    others = part.take(pa.array(keep[some]))
                    picked = {c: others.column(c) for c in others.schema.names if c not in ("a", "b")}
                    yield pa.RecordBatch.from_pydict({"pa": places.take(pa.array(left[some])), "pb": places.take(pa.array(right[some])), **picked})

    return lambda batches: then(rows(batches))


ALIGNED = PASSAGE + ", seeds array<long>, a_node long, b_node long, xs array<int>, ys array<int>"


def _runs(cost: np.ndarray, most: float) -> list[slice]:
    """Cuts items into runs of at most `most` cost; an item beyond that is a run."""
    ends, first, out = np.cumsum(cost), 0, []
    while first < len(cost):
        last = max(int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, side="right")), first + 1)
        out.append(slice(first, last))
        first = last
    return out


class _Side:
    """A column of places: the words of all rows in one array, from `start` on `n` of them."""

    def __init__(self, column: pa.StructArray):
        fields = dict(zip((f.name for f in column.type), column.flatten()))
        data, limits = text_buffers(fields["words"])
        self.words, limits = np.frombuffer(data.tobytes(), np.uint32), limits // 4
        self.start, self.n = limits[:-1], np.diff(limits)
        self.row, self.begin, self.lead, self.size = (fields[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("row", "begin", "lead", "size"))
        self.open = fields["open"].to_numpy(zero_copy_only=False)


def _lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.ListArray:
    """The values of each of n rows; the owners are in order."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), pa.array(values))


def _seed_lists(side: _Side, row: np.ndarray, owner: np.ndarray, at: np.ndarray, n: int) -> pa.ListArray:
    """seed_ids() of n items: places `at` of the words of a row of the side, each for its owner."""
    whole = at + K <= side.n[row]
    row, owner, at = row[whole], owner[whole], at[whole]
    five = side.words[(side.start[row] + at)[:, None] + np.arange(K)].astype(np.uint64).ravel()
    h = signed(shingles(five, np.repeat(np.arange(len(at)), K), K)[1])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.r_[True, (np.diff(h) != 0) | (np.diff(owner) != 0)][: len(h)]
    return _lists(h[new], owner[new], n)


def _found_rows(one: _Side, two: _Side, row: np.ndarray, found: np.ndarray, own: pa.ListArray, nodes: tuple | None) -> pa.RecordBatch:
    """ALIGNED of passages found: the rows of the two sides, the lesser text as a."""
    n, swap = len(row), one.row[row] > two.row[row]
    turn = lambda x, y: (np.where(swap, y, x), np.where(swap, x, y))
    begin_a, begin_b = one.begin[row], two.begin[row]
    texts, begins, ends = turn(one.row[row], two.row[row]), turn(found[0] + begin_a, found[2] + begin_b), turn(found[1] + begin_a, found[3] + begin_b)
    named = [pa.array(c, pa.int64()) for c in turn(*nodes)] if nodes else [pa.nulls(n, pa.int64())] * 2
    columns = [*texts, begins[0], ends[0], begins[1], ends[1], found[4]]
    return _aligned([*(pa.array(c, pa.int64()) for c in columns), own, *named, *[pa.nulls(n, pa.list_(pa.int32()))] * 2])


def _aligned(columns: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in ALIGNED.split(", ")])


def _chains_of(pair: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Matches of pairs -> (pair of each chain, limits, xs, ys): the chains of two matches and more.

    Where all matches of a pair are collinear and each costs less than its weight, scores only rise, so they are one chain; chains() takes the others."""
    order = np.lexsort((-y, x, pair))
    pair, x, y = pair[order], x[order].astype(np.int64), y[order].astype(np.int64)
    first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]][: len(pair)])
    ends, dx, dy = np.append(first[1:], len(pair)), np.diff(x, prepend=0), np.diff(y, prepend=0)
    plain = (dx > 0) & (dy > 0) & (GAP * (dx + dy) < K)
    plain[first] = True
    whole = np.logical_and.reduceat(plain, first) if len(first) else np.zeros(0, bool)
    several = whole & (ends - first > 1)
    kept, owners, sizes = [np.flatnonzero(np.repeat(several, ends - first))], [pair[first[several]]], [(ends - first)[several]]
    for i, j in zip(first[~whole].tolist(), ends[~whole].tolist()):
        paths = _paths(x[i:j], y[i:j], round(K / GAP), 2)
        kept.append(np.fromiter(chain.from_iterable(paths), np.int64) + i)
        owners.append(np.full(len(paths), pair[i]))
        sizes.append(np.fromiter(map(len, paths), np.int64))
    kept = np.concatenate(kept)
    return np.concatenate(owners), np.r_[0, np.cumsum(np.concatenate(sizes))], x[kept], y[kept]


def _node_rows(least: int):
    """Pairs of nodes -> their passages. One whose words inside both cores suffice holds for all texts of both nodes; one that depends
    on the words around is given back with its chain (xs), for every two texts to be aligned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for c in "ab":
                hashes = batch.column(f"h{c}")
                pair = np.repeat(np.arange(batch.num_rows, dtype=np.int64), pc.list_value_length(hashes).to_numpy())
                sides += [pair << 32 | hashes.flatten().to_numpy().view(np.uint32).astype(np.int64), batch.column(f"at{c}").flatten().to_numpy()]
            h, x, y = shared_seeds(*sides)
            pair, limits, xs, ys = _chains_of(h >> 32, x, y)
            one, two = _Side(batch.column("pa")), _Side(batch.column("pb"))
            node_a, node_b = (batch.column(c).to_numpy() for c in "ab")
            owner = np.repeat(np.arange(len(pair)), np.diff(limits))
            la, lb = one.lead[pair], two.lead[pair]
            ea, eb = la + one.size[pair], lb + two.size[pair]
            xs, ys = xs + la[owner], ys + lb[owner]
            found, behind, ahead = align_many(one, two, pair, limits, xs, ys)
            inside = np.minimum(np.minimum(found[1], ea) - np.maximum(found[0], la), np.minimum(found[3], eb) - np.maximum(found[2], lb))
            good = (found[4] > 0) & (inside >= least)
            own = good[owner] & (xs >= found[0][owner]) & (xs + K <= found[1][owner])
            number = np.cumsum(good) - 1
            own = _seed_lists(one, pair[owner[own]], number[owner[own]], xs[own], int(good.sum()))
            yield _found_rows(one, two, pair[good], found[:, good], own, (node_a[pair[good]], node_b[pair[good]]))

            # not enough inside the cores: all equal from the chain to an end where a core is open?
            first, last = limits[:-1], limits[1:] - 1
            open_a, open_b, asked = one.open[pair], two.open[pair], np.zeros(len(pair), bool)
            for left_a, left_b, equal in ((ea - xs[last], eb - ys[last], ahead), (xs[first] - la, ys[first] - lb, behind)):
                n = np.minimum(left_a, left_b)
                asked |= ((open_a & (left_a == n)) | (open_b & (left_b == n))) & (equal >= n)
            asked &= ~good
            n, mine = int(asked.sum()), asked[owner]
            number = (np.cumsum(asked) - 1)[owner[mine]]
            at = [_lists(c.astype(np.int32), number, n) for c in ((xs - la[owner])[mine], (ys - lb[owner])[mine])]
            yield _aligned([*[pa.nulls(n, pa.int64())] * 7, pa.nulls(n, pa.list_(pa.int64())), pa.array(node_a[pair[asked]]), pa.array(node_b[pair[asked]]), *at])

    return run


def _text_rows(least: int):
    """Two segments (pa, pb) and a chain of matches of their cores -> the passage of these two texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = _Side(batch.column("pa")), _Side(batch.column("pb"))
            limits = np.r_[0, np.cumsum(pc.list_value_length(batch.column("xs")).to_numpy())]
            owner = np.repeat(np.arange(batch.num_rows), np.diff(limits))
            xs, ys = (batch.column(c).flatten().to_numpy() + side.lead[owner] for c, side in (("xs", one), ("ys", two)))
            found, _, _ = align_many(one, two, np.arange(batch.num_rows), limits, xs, ys)
            good = (found[4] > 0) & (np.minimum(found[1] - found[0], found[3] - found[2]) >= least)
            own = good[owner] & (xs >= found[0][owner]) & (xs + K <= found[1][owner])
            own = _seed_lists(one, owner[own], (np.cumsum(good) - 1)[owner[own]], xs[own], int(good.sum()))
            yield _found_rows(one, two, np.flatnonzero(good), found[:, good], own, None)

    return run


def _member_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first segment of a node (pa) and another (pb): the core and the equal words around it."""
    for batch in batches:
        one, two, every = _Side(batch.column("pa")), _Side(batch.column("pb")), np.arange(batch.num_rows)
        found, _, _ = align_many(one, two, every, np.arange(batch.num_rows + 1), one.lead, two.lead)
        owner = np.repeat(every, pc.list_value_length(batch.column("at")).to_numpy())
        own = _seed_lists(one, owner, owner, batch.column("at").flatten().to_numpy() + one.lead[owner], batch.num_rows)
        node = batch.column("node").to_numpy()
        yield _found_rows(one, two, every, found, own, (node, node))


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of two short word lists."""
    if not len(a) or not len(b):
        return 0
    row = np.zeros(len(b) + 1, np.int64)
    for word in a:
        row[1:] = np.maximum(row[1:], row[:-1] + (b == word))
        row = np.maximum.accumulate(row)
    return int(row[-1])


def align(a: np.ndarray, b: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> tuple[int, int, int, int, int] | None:
    """(begin, end in a, begin, end in b, equal words) of the passage of a chain of K-word matches, or None."""

    def equal(x: int, y: int, step: int) -> int:
        """Equal words from (x, y) on, in direction step."""
        n = min(len(a) - x, len(b) - y) if step > 0 else min(x, y) + 1
        if n <= 0:
            return 0
        differ = (a[x : x + n] != b[y : y + n]) if step > 0 else (a[x - n + 1 : x + 1][::-1] != b[y - n + 1 : y + 1][::-1])
        where = differ.argmax()
        return int(where) if differ[where] else n

    runs: list[list[int]] = []  # maximal runs of equal words: x, y, length
    for x, y in zip(xs.tolist(), ys.tolist()):
        if runs and x < runs[-1][0] + runs[-1][2]:
            continue  # inside the run before
        if runs and y < runs[-1][1] + runs[-1][2]:
            continue
        ahead = equal(x, y, 1)
        if not ahead:
            continue
        behind = equal(x - 1, y - 1, -1) if x and y else 0
        if runs:
            behind = min(behind, x - runs[-1][0] - runs[-1][2], y - runs[-1][1] - runs[-1][2])
        runs.append([x - behind, y - behind, ahead + behind])
    # the part with the largest sum of +1 per equal word and -PENALTY per other word
    best, here = (0, 0, 0, 0), None
    for i, (x, y, n) in enumerate(runs):
        if here is not None:
            px, py, pn = runs[i - 1]
            dx, dy = x - px - pn, y - py - pn
            same = common(a[px + pn : x], b[py + pn : y]) if 0 < max(dx, dy) <= MOST_GAP else 0
            total, matched, first = here
            total += same - PENALTY * (max(dx, dy) - same)
            here = (total, matched + same, first) if total > 0 else None
        here = (n, n, i) if here is None else (here[0] + n, here[1] + n, here[2])
        if here[0] > best[0]:
            best = (here[0], here[1], here[2], i)
    if not best[0]:
        return None
    _, matched, i, j = best
    return runs[i][0], runs[j][0] + runs[j][2], runs[i][1], runs[j][1] + runs[j][2], matched


def common_many(a: np.ndarray, at_a: np.ndarray, na: np.ndarray, b: np.ndarray, at_b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """common() of a[at_a:at_a+na] and b[at_b:at_b+nb], 1 to 64 words each, for many at once: a bit for each word of b, a step for each word of a."""
    out, longest = np.zeros(len(na), np.int64), np.maximum(na, nb)
    for less, width in ((0, 1), (1, 4), (4, 8), (8, 16), (16, 32), (32, 64)):
        every = np.flatnonzero((longest > less) & (longest <= width))
        for k in range(0, len(every), max(1, (1 << 20) // width**2)):
            some = every[k : k + max(1, (1 << 20) // width**2)]
            place = np.arange(width)
            # words beyond the end are unlike any other
            x, y = (
                np.where(place < n[some, None], w[at[some, None] + np.minimum(place, n[some, None] - 1)].astype(np.int64), none) for w, at, n, none in ((a, at_a, na, -1), (b, at_b, nb, -2))
            )
            bits = np.packbits(x[:, :, None] == y[:, None, :], axis=2, bitorder="little").view(f"<u{max(width // 8, 1)}")[:, :, 0]
            row = np.full(len(some), np.iinfo(bits.dtype).max, bits.dtype)
            for step in range(width):
                hit = row & bits[:, step]
                row = (row + hit) | (row & ~bits[:, step])
            out[some] = np.bitwise_count(~row)
    return out


def align_many(one: _Side, two: _Side, row: np.ndarray, limits: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """align() for many chains: the i-th is that of row[i] of both sides and has the matches limits[i]..limits[i+1].

    -> five rows of begin, end in a, begin, end in b, equal words (0: none); the equal words before each chain's first match and from its last one on."""
    found, behind, ahead = np.zeros((5, len(row)), np.int64), np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
    owner, diagonal = np.repeat(np.arange(len(row)), np.diff(limits)), ys - xs
    new = np.r_[True, (np.diff(owner) != 0) | (np.diff(diagonal) != 0)][: len(xs)]
    taken = np.flatnonzero(new)
    whose, x, y = row[owner[taken]], xs[taken], ys[taken]
    far = np.append(taken[1:], len(xs))[: len(taken)] - 1  # the last match on the diagonal
    lo, hi = np.maximum(0, x - y), np.minimum(one.n[whose], two.n[whose] + x - y)
    # a run goes back to the one before it at most, which lies beyond the match before, if that is none by its hash alone
    last = taken - ((taken > 0) & (owner[taken - 1] == owner[taken]))
    real = (last < taken) & (one.words[one.start[whose] + xs[last]] == two.words[two.start[whose] + ys[last]])
    lo = np.where(real, np.maximum(lo, x - np.maximum(x - xs[last], y - ys[last])), lo)
    most, hi = hi, np.minimum(hi, xs[far] + AHEAD)
    cost = np.bincount(owner[taken], weights=hi - lo, minlength=len(row))
    limits_of, again = np.searchsorted(owner[taken], np.arange(len(row) + 1)), []
    for whole in (False, True):
        if whole:  # those whose run of equal words goes on beyond what was compared
            again = np.concatenate(again) if again else np.zeros(0, np.int64)
            cost = np.bincount(owner[taken], weights=most - lo, minlength=len(row))[again]
        for some in _runs(cost, COMPARED):
            some = again[some] if whole else np.arange(some.start, some.stop)
            of, m = row[some], _spans(limits[:-1][some], limits[1:][some])
            t = _spans(limits_of[:-1][some], limits_of[1:][some])
            sides = one.words, one.start[of], one.n[of], two.words, two.start[of], two.n[of]
            size = np.r_[0, np.cumsum(limits[1:][some] - limits[:-1][some])]
            if len(some) == 1 and (most[t] - lo[t]).sum() > COMPARED:
                out = _align_alone(*sides, xs[m], ys[m])
            else:
                out = _align_run(*sides, size, xs[m], ys[m], lo[t], (most if whole else hi)[t], most[t])
            found[:, some], behind[some], ahead[some] = out[:3]
            if not whole and len(out) > 3:
                again.append(some[out[3]])
    return found, behind, ahead


def _spans(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of all half-open ranges."""
    size = end - first
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)


def _align_alone(a, at_a, na, b, at_b, nb, xs, ys) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One chain on many diagonals of long texts: only one of them is held at a time."""
    a, b = a[at_a[0] : at_a[0] + na[0]], b[at_b[0] : at_b[0] + nb[0]]
    p, q, x, y = int(xs[0]), int(ys[0]), int(xs[-1]), int(ys[-1])
    found = align(a, b, xs, ys) or (0,) * 5
    return np.array(found, np.int64)[:, None], np.array([_equal(a[:p][::-1], b[:q][::-1])]), np.array([_equal(a[x:], b[y:])])


def _align_run(a, at_a, na, b, at_b, nb, limits, xs, ys, lo, hi, most) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """align_many() of some chains, whose k-th diagonal is compared in lo[k]..hi[k]; the last result tells which chains that left open."""
    n, size = len(na), np.diff(limits)
    owner, diagonal = np.repeat(np.arange(n), size), ys - xs
    new = np.r_[True, (np.diff(owner) != 0) | (np.diff(diagonal) != 0)][: len(xs)]
    taken, number = np.flatnonzero(new), np.cumsum(new) - 1
    whose, shift, long = owner[taken], diagonal[taken], hi - lo
    ends = np.cumsum(long)
    base, total = ends - long, int(ends[-1]) if len(ends) else 0
    flat = np.arange(total)
    differ = a[np.repeat(at_a[whose] + lo - base, long) + flat] != b[np.repeat(at_b[whose] + lo + shift - base, long) + flat]
    bad = np.r_[-1, np.flatnonzero(differ), total]
    at = base[number] + xs - lo[number]
    after = np.searchsorted(bad, at)
    ahead = np.minimum(bad[after], ends[number]) - at
    behind = at - np.maximum(bad[after - 1] + 1, base[number])
    open_ = np.zeros(n, bool)
    open_[owner[(at + ahead == ends[number]) & (hi < most)[number]]] = True
    # maximal runs of equal words, the k-th match of all chains at once
    order = np.argsort(-size, kind="stable")
    first, count = limits[:-1][order], size[order]
    end_x, end_y = np.zeros(n, np.int64), np.zeros(n, np.int64)
    used, back = np.zeros(len(xs), bool), np.zeros(len(xs), np.int64)
    for k in range(int(count[0]) if n else 0):
        live = int(np.searchsorted(-count, -k))  # chains of more than k matches
        m = first[:live] + k
        x, y, far, ex, ey = xs[m], ys[m], ahead[m], end_x[:live], end_y[:live]
        take = (far > 0) & (x >= ex) & (y >= ey)
        used[m], back[m] = take, np.minimum(behind[m], np.minimum(x - ex, y - ey))
        end_x[:live], end_y[:live] = np.where(take, x + far, ex), np.where(take, y + far, ey)
    run = np.flatnonzero(used)
    rx, ry, rn, whose = xs[run] - back[run], ys[run] - back[run], ahead[run] + back[run], owner[run]
    # the gap before each run
    px, py = np.r_[0, rx[:-1] + rn[:-1]][: len(run)], np.r_[0, ry[:-1] + rn[:-1]][: len(run)]
    inner = np.r_[False, whose[1:] == whose[:-1]][: len(run)]
    dx, dy = rx - px, ry - py
    same = np.zeros(len(run), np.int64)
    gap = np.flatnonzero(inner & (np.minimum(dx, dy) > 0) & (np.maximum(dx, dy) <= MOST_GAP))
    same[gap] = common_many(a, at_a[whose[gap]] + px[gap], dx[gap], b, at_b[whose[gap]] + py[gap], dy[gap])
    loss = same - PENALTY * (np.maximum(dx, dy) - same)
    # the part with the largest sum, the k-th run of all chains at once
    size = np.bincount(whose, minlength=n)
    order = np.argsort(-size, kind="stable")
    first, count = (np.cumsum(size) - size)[order], size[order]
    sum_, matched, start, best = (np.zeros(n, np.int64) for _ in range(4))
    best_of = np.zeros((3, n), np.int64)  # equal words, first and last run
    for k in range(int(count[0]) if n else 0):
        live = int(np.searchsorted(-count, -k))
        m = first[:live] + k
        kept = sum_[:live] + loss[m] if k else np.zeros(live, np.int64)
        alive = kept > 0
        sum_[:live] = np.where(alive, kept, 0) + rn[m]
        matched[:live] = np.where(alive, matched[:live] + same[m], 0) + rn[m]
        start[:live] = np.where(alive, start[:live], m)
        better = np.flatnonzero(sum_[:live] > best[:live])
        best[better] = sum_[better]
        best_of[:, better] = matched[better], start[better], m[better]
    found = np.zeros((5, n), np.int64)
    some = np.flatnonzero(best > 0)
    equal, i, j = best_of[:, some]
    found[:, order[some]] = rx[i], rx[j] + rn[j], ry[i], ry[j] + rn[j], equal
    return found, behind[limits[:-1]], ahead[limits[1:] - 1], open_


def _equal(a: np.ndarray, b: np.ndarray) -> int:
    """Equal words at the start of both."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def seed_ids(words_: np.ndarray, at: np.ndarray) -> list[int]:
    """What names the K words at each place, whichever document they stand in."""
    h = shingles(words_.astype(np.uint64), np.zeros(len(words_), np.int64), K)[1]
    return sorted(set(signed(h)[at[(at >= 0) & (at < len(h))]].tolist()))


def _block_starts(sizes: dict[int, int]) -> np.ndarray:
    """The first numbers of blocks of BLOCK nodes at most: whole files where several fit into one, else parts of a file."""
    starts, held = [], BLOCK
    for part in sorted(sizes):
        for k in range(0, sizes[part], BLOCK):
            n = min(BLOCK, sizes[part] - k)
            if held + n > BLOCK:
                starts.append((part << FILE_BITS) + k)
                held = 0
            held += n
    return np.array(starts, np.int64)


def _stored(rows: DataFrame, *order: str) -> tuple[str, dict[int, str], np.ndarray, DataFrame]:
    """rows(node, low, ...) -> the folder in which they lie by number, its files, the starts of blocks, and (node, id); equal `low` and node stay together, in `order`."""
    folder = f"{shared_folder(rows.sparkSession)}/quillstream/content-{uuid.uuid4().hex}"
    ordered = rows.repartitionByRange("low", "node").sortWithinPartitions("low", "node", *order).drop("low")
    numbered = written(ordered.mapInArrow(_content_rows(folder), "node long, id long, file string"), "numbers")
    found = numbered.groupBy(F.shiftright("id", FILE_BITS).alias("part"), "file").agg(F.count("*").alias("n")).collect()
    return folder, {x.part: x.file for x in found}, _block_starts({x.part: x.n for x in found}), numbered.select("node", "id")


def _dealt(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, ...) of numbers take long, whatever their size: as many tasks as there are, with neighbouring numbers in one."""
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartition(n, F.shiftright("a", 4), F.shiftright("b", 12)).sortWithinPartitions("a", "b")


def passages(rows: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """rows(row unique, text) -> the fuzzy passages (a, b, a_begin, a_end, b_begin, b_end, n_equal, class_id, class_texts, a_node, b_node), in words, a < b."""
    spark = rows.sparkSession
    prepare(spark)
    rows = rows.select("row", F.coalesce("text", F.lit("")).alias("text"))
    held = segments(rows, least)
    place = F.struct(*PLACE_OF_TEXT)
    short = F.shiftright("h", 32).cast("int").alias("h")  # 32 bits are enough between two nodes; the words are compared later
    every = held.select("node", F.explode(F.arrays_zip("h", "at")).alias("m")).select("node", "m.h", "m.at").distinct()
    matches = every.groupBy("node").agg(F.array_sort(F.collect_list(F.struct(short, "at"))).alias("m")).select("node", "m.h", "m.at")
    nodes = held.groupBy("node").agg(F.min(place).alias("top"), F.max(place).alias("far"))
    nodes = nodes.withColumn("far", F.when(F.col("far.row") > F.col("top.row"), F.col("far"))).join(matches, "node").select("node", "top", "far", "h", "at")
    nodes = written(nodes, "nodes")
    # neighbouring numbers go to nodes with the same smallest seed, which mostly share others too
    folder, files, starts, numbered = _stored(nodes.withColumn("low", F.array_min("h")))
    several = written(nodes.where("far is not null and top.size >= " + str(least)).select("node", "at"), "several")
    pairs = node_pairs(every.select("node", "h").distinct().join(numbered, "node").select("id", "h"), starts)
    found = written(_dealt(pairs).mapInArrow(_fetched(folder, files, _node_rows(least)), ALIGNED), "node-pairs")
    drop_folder(spark, folder)
    drop_written(nodes)
    # texts of nodes move as numbers too: every other one of a node against its first, and those that a pair of nodes asks for
    folder, files, _, numbered = _stored(held.select("node", F.array_min("h").alias("low"), *PLACE_OF_TEXT), "row", "begin")
    first = numbered.groupBy("node").agg(F.min("id").alias("a"))
    members = several.join(first, "node").join(numbered.withColumnRenamed("id", "b"), "node").where("a <> b").select("a", "b", "node", "at")
    members = _dealt(members).mapInArrow(_fetched_texts(folder, files, _member_rows), ALIGNED)
    asked = found.where("xs is not null").select("a_node", "b_node", "xs", "ys")
    asked = asked.join(numbered.toDF("a_node", "a"), "a_node").join(numbered.toDF("b_node", "b"), "b_node").select("a", "b", "xs", "ys")
    texts = _dealt(asked).mapInArrow(_fetched_texts(folder, files, _text_rows(least)), ALIGNED)
    out = written(found.where("xs is null").unionByName(members).unionByName(texts).drop("xs", "ys"), "passages")
    drop_folder(spark, folder)
    drop_written(held)
    drop_written(found)
    return classes(out)


def classes(found: DataFrame) -> DataFrame:
    """Passages with their seeds -> the same with class_id, the smallest of all seeds that passages connect, and class_texts, the number of its texts."""
    top = F.array_min("seeds").alias("seed")
    edges = found.select(top, F.explode("seeds").alias("other")).distinct()
    roots = connected_components(edges.toDF("a", "b")).toDF("seed", "root")
    named = found.select("*", top).join(roots, "seed", "left").withColumn("class_id", F.coalesce("root", "seed")).drop("seeds", "seed", "root")
    named = written(named, "classes")
    texts = named.select("class_id", F.explode(F.array("a", "b")).alias("row")).distinct().groupBy("class_id").agg(F.count("*").alias("class_texts"))
    return named.join(texts, "class_id").select(*(c.split()[0] for c in PASSAGE.split(", ")), "class_id", "class_texts", "a_node", "b_node")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per passage: the later document and, as other, the earlier one that it was found against; the passage's class and its number of texts."""
    docs = with_row(documents(spark, sf_dir).select("doc_id", "text"))
    found = passages(docs.select(F.col("__row").alias("row"), "text"))
    names = docs.select(F.col("__row").alias("row"), "doc_id")
    ids = found.join(names.select(F.col("row").alias("a"), F.col("doc_id").alias("other_doc_id")), "a").join(names.select(F.col("row").alias("b"), "doc_id"), "b")
    return ids.select(
        "doc_id", F.col("b_begin").alias("begin_word"), F.col("b_end").alias("end_word"), "other_doc_id", F.col("a_begin").alias("other_begin_word"), F.col("a_end").alias("other_end_word"), "n_equal",
        "class_id", "class_texts", F.col("b_node").alias("passage_id"), F.col("a_node").alias("other_passage_id"),
    )
