"""SentencePiece encoding and decoding with the N best segmentations.

A text is escaped as the model asks (a leading space, spaces as U+2581). `ids` are the tokenizer's own: the file is a byte-fallback BPE, so the
adjacent pair whose union has the best score is merged first, leftmost on ties. Beside them stand the N best segmentations over the lattice of the
model's pieces, whose scores add up; a character in no piece is one edge with the unknown score (least score - 10), written as byte pieces. The
forward Viterbi pass gives the best score from the start to each place; it is an exact heuristic for a backward A* search from the end, which
therefore pops the N best segmentations in order and expands nothing else. The first is `best_ids`, the others are changes to it.

No piece crosses the start of a run of U+2581 or a change from letters to punctuation (read off the vocabulary), and a character in no piece is
a forced edge, so the lattice and the merges fall apart at those places into chunks (words). The distinct new chunks of a batch run through the
Viterbi pass and the merges together, one array step for a place of all chunks; a bounded memo per worker keeps them. The N best of a text are the
N smallest sums of losses over its chunks, which only its N-1 least losses can take part in: those chunks are searched by A*.

Defined results: null text = empty = no pieces, score 0, no alternatives; fewer than N segmentations give fewer alternatives; equal scores come in the order of the
search, which is fixed; rows without doc_id go, rows with an id that cannot be cast to long likewise; repeated rows and ids are encoded one by one; extra columns, clashing names
included, are not read; an empty table gives none. decode(encode(t)) == t except that U+2581 itself comes back as a space, as the format has it.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import re
import string
from bisect import insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, give_back, keyed_text, prepare

N_BEST = 4
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Chunks that a worker's memo holds; a full memo starts anew.
MEMO = 400_000
#: Texts whose chunks are held at once: each chunk is a string of some 100 bytes.
TEXTS = 64
#: Longer chunks are handled one at a time, with the same results.
LONG = 40
INFINITE = float("inf")
CHARACTER = 21  # bits of a code point
UNKNOWN = 1 << CHARACTER  # symbols from here on are code points in no piece


def load(path: str) -> dict:
    """What the search needs of a model file; its size is that of the file."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    byte = {model.id_to_piece(i): i for i in ids if model.is_byte(i)}
    normal = {model.id_to_piece(i): (i, model.get_score(i)) for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
    if len(byte) != 256:
        raise ValueError(f"{path}: needs byte pieces")
    if any(SPACE in p.lstrip(SPACE) for p in normal):
        raise ValueError(f"{path}: a piece has a space after a letter")
    if model.encode(" a  Ａ", out_type=str) and "Ａ" not in model.decode(model.encode("Ａ")):
        raise ValueError(f"{path}: the model normalises its input")
    characters = set("".join(normal))
    # punctuation that no piece has behind another kind of character, but for a few rare ones
    before = {p: {a for piece in normal for a, b in zip(piece, piece[1:]) if b == p} for p in string.punctuation}
    marks = {p for p, b in before.items() if not any(c.isascii() and c.isalnum() for c in b)}
    while wide := {p for p in marks if sum(c not in marks and c != SPACE for c in before[p]) > 20}:
        marks -= wide
    rare = {c for p in marks for c in before[p] if c not in marks and c != SPACE}
    return {
        "normal": normal,
        "bytes": [byte[f"<0x{b:02X}>"] for b in range(256)],
        "unknown": min(s for _, s in normal.values()) - UNKNOWN_PENALTY,
        "cuts": "".join(c for c in "\n\r\t" if c not in characters),
        "marks": "".join(sorted(marks)),
        "rare": "".join(sorted(rare)),
        "dummy_prefix": model.encode("a", out_type=str)[0].startswith(SPACE),
    }


class Table:
    """Keys (uint64) -> values by open addressing over arrays; look-ups are array steps."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, np.iinfo(np.uint64).max, np.uint64)
        self.values = np.full(1 << self.bits, -1, np.int64)
        seat, left, self.steps = self._seat(keys), np.arange(len(keys)), 0
        while len(left):
            self.steps += 1
            free = self.keys[seat[left]] == np.iinfo(np.uint64).max
            seats, first = np.unique(seat[left[free]], return_index=True)
            put = left[free][first]
            self.keys[seats], self.values[seats] = keys[put], values[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            seat[left] = (seat[left] + 1) & ((1 << self.bits) - 1)

    def _seat(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 where a key is not there."""
        seat = self._seat(keys)
        out = np.where(self.keys[seat] == keys, self.values[seat], -1)
        left = np.flatnonzero((out < 0) & (self.keys[seat] != np.iinfo(np.uint64).max))
        for _ in range(self.steps):
            if not len(left):
                break
            at = (seat[left] + 1) & ((1 << self.bits) - 1)
            seat[left] = at
            same = self.keys[at] == keys[left]
            out[left[same]] = self.values[at[same]]
            left = left[~same & (self.keys[at] != np.iinfo(np.uint64).max)]
        return out


def key_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.uint64) << np.uint64(CHARACTER + 1)) | b.astype(np.uint64)


class Vocabulary:
    """The pieces as arrays: the trie's edges, and which two symbols merge into which piece."""

    def __init__(self, normal: dict[str, tuple[int, float]]):
        nodes = {"": 0}
        for piece in normal:
            for k in range(1, len(piece) + 1):
                nodes.setdefault(piece[:k], len(nodes))
        rest = [p for p in nodes if p]
        self.child = Table(key_of(np.array([nodes[p[:-1]] for p in rest]), np.array([ord(p[-1]) for p in rest])), np.array([nodes[p] for p in rest]))
        self.piece = np.full(len(nodes), -1, np.int64)
        self.score = np.zeros(len(nodes))
        for piece, (i, score) in normal.items():
            self.piece[nodes[piece]], self.score[nodes[piece]] = i, score
        self.scores = np.zeros(1 + max(i for i, _ in normal.values()))
        pairs = []
        for piece, (i, score) in normal.items():
            self.scores[i] = score
            for k in range(1, len(piece)):
                a, b = (normal[x][0] if x in normal else UNKNOWN + ord(x) if len(x) == 1 else None for x in (piece[:k], piece[k:]))
                if a is not None and b is not None:
                    pairs.append((a, b, i))
        a, b, i = (np.array(x, np.int64) for x in zip(*pairs)) if pairs else [np.zeros(0, np.int64)] * 3
        self.pairs = Table(key_of(a, b), i)
        self.longest = max(map(len, normal))

    def symbols(self, codes: np.ndarray) -> np.ndarray:
        node = self.child.get(key_of(np.zeros(len(codes), np.int64), codes))
        piece = np.where(node >= 0, self.piece[node], -1)
        return np.where(piece >= 0, piece, UNKNOWN + codes)

    def merged(self, symbols: np.ndarray, limits: np.ndarray) -> np.ndarray:
        """The symbols after all merges; -1 where one went into its left neighbour."""
        out = np.full(len(symbols), -1, np.int64)
        sizes = np.diff(limits)
        for size in np.unique(sizes):
            which = np.flatnonzero(sizes == size)
            seats = limits[which][:, None] + np.arange(size)
            grid = symbols[seats]
            while len(grid):
                if grid.shape[1] == 1:
                    out[seats] = grid
                    break
                union = self.pairs.get(key_of(grid[:, :-1], grid[:, 1:]).ravel()).reshape(len(grid), -1)
                gain = np.where(union >= 0, self.scores[union], -INFINITE)
                at = gain.argmax(axis=1)
                line = np.arange(len(grid))
                done = gain[line, at] == -INFINITE
                if done.any():
                    out[seats[done]] = grid[done]
                    grid, seats, union, at = grid[~done], seats[~done], union[~done], at[~done]
                    line = np.arange(len(grid))
                grid[line, at] = union[line, at]
                keep = np.ones(grid.shape, bool)
                keep[line, at + 1] = False
                grid, seats = (x[keep].reshape(len(x), x.shape[1] - 1) for x in (grid, seats))
        return out

    def segmented(self, codes: np.ndarray, limits: np.ndarray, unknown: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Viterbi over all chunks: (piece that starts at each place on the best path or -1, best scores, losses of the second best)."""
        ends = np.repeat(limits[1:], np.diff(limits))
        begins = np.repeat(limits[:-1], np.diff(limits))
        here, node = np.arange(len(codes)), np.zeros(len(codes), np.int64)
        single = np.zeros(len(codes), bool)
        found = []  # (start, length, score, symbol)
        for k in range(1, self.longest + 1):
            node = self.child.get(key_of(node, codes[here + k - 1]))
            alive = node >= 0
            here, node = here[alive], node[alive]
            hit = self.piece[node] >= 0
            found.append((here[hit], np.full(int(hit.sum()), k), self.score[node[hit]], self.piece[node[hit]]))
            if k == 1:
                single[here[hit]] = True
            more = here + k < ends[here]
            here, node = here[more], node[more]
            if not len(here):
                break
        lone = np.flatnonzero(~single)
        found.append((lone, np.ones(len(lone), np.int64), np.full(len(lone), unknown), UNKNOWN + codes[lone]))
        start, length, score, symbol = (np.concatenate(x) for x in zip(*found))
        level = (start - begins[start]) * (self.longest + 1) + length
        order = np.argsort(level, kind="stable")
        start, length, score, symbol, level = start[order], length[order], score[order], symbol[order], level[order]
        cuts = np.flatnonzero(np.r_[True, level[1:] != level[:-1], True]) if len(level) else np.zeros(1, np.int64)
        n = len(limits) - 1
        # one seat more than places in each chunk
        chunk = np.repeat(np.arange(n), np.diff(limits))
        from_seat, to_seat, of = start + chunk[start], start + length + chunk[start], chunk[start]
        first, last = limits[:-1] + np.arange(n), limits[1:] + np.arange(n)
        best = np.full(len(codes) + n, -INFINITE)
        back = np.full(len(codes) + n, -1, np.int64)
        best[first] = 0.0
        steps = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:])]
        for s in steps:  # edges of one start and length: no two end in one seat
            ways = best[from_seat[s]] + score[s]
            to = to_seat[s]
            better = np.flatnonzero(ways > best[to])
            best[to[better]] = ways[better]
            back[to[better]] = better + s.start
        on = np.zeros(len(start), bool)
        at = last[last > first]
        while len(at):
            edge = back[at]
            on[edge] = True
            at = from_seat[edge]
            at = at[at > first[of[edge]]]
        path = np.full(len(codes), -1, np.int64)
        path[start[on]] = symbol[on]
        rest = np.full(len(codes) + n, -INFINITE)
        rest[last] = 0.0
        second = np.full(n, -INFINITE)
        for s in reversed(steps):
            ways = score[s] + rest[to_seat[s]]
            seat = from_seat[s]
            rest[seat] = np.maximum(rest[seat], ways)
            ways = np.where(on[s], -INFINITE, best[seat] + ways)
            second[of[s]] = np.maximum(second[of[s]], ways)
        return path, best[last], best[last] - second


class Ragged:
    """Growing lists of ids, one after another."""

    def __init__(self):
        self.ids, self.at, self.size = np.zeros(1024, np.int32), np.zeros(1024, np.int64), 0
        self.rows = 0

    def extend(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        while self.size + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.rows + len(sizes) + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.ids[self.size : self.size + len(ids)] = ids
        self.at[self.rows + 1 : self.rows + 1 + len(sizes)] = self.size + np.cumsum(sizes)
        self.size, self.rows = self.size + len(ids), self.rows + len(sizes)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of these rows joined, limits)."""
        begins, sizes = self.at[rows], self.at[rows + 1] - self.at[rows]
        limits = np.concatenate([[0], np.cumsum(sizes)])
        return self.ids[np.repeat(begins - limits[:-1], sizes) + np.arange(limits[-1])], limits


class Lattice(dict):
    """chunk -> row of the memo: the merged ids, the best ids of the lattice, their score, the loss of the second best, whether both give the chunk back."""

    def __init__(self, model: dict, n: int = N_BEST):
        super().__init__()
        self.n = n
        self.full: dict[str, list] = {}
        self.normal, self.unknown = model["normal"], model["unknown"]
        self.vocabulary = Vocabulary(self.normal)
        self.trie: dict = {}  # character -> node; "" -> (ids, score) of the piece that ends there
        for piece, (i, score) in self.normal.items():
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = ((i,), score)
        self.byte_ids = model["bytes"]
        self.dummy = SPACE if model["dummy_prefix"] else ""
        cuts = re.escape(model["cuts"])
        marks = re.escape(model["marks"])
        cut = f"|[{cuts}]" if cuts else ""
        self.coarse = re.compile(f"{SPACE}*[^{SPACE}{cuts}]+|{SPACE}+{cut}").findall
        self.split = re.compile(f"{SPACE}*[{marks}]*[^{SPACE}{marks}{cuts}]+|{SPACE}*[{marks}]+|{SPACE}+{cut}").findall if marks else self.coarse
        self.rare = re.compile(f"[{re.escape(model['rare'])}]").search if model["rare"] else lambda text: None
        self.surface = [b""] * (1 + max([i for i, _ in self.normal.values()] + self.byte_ids))
        for piece, (i, _) in self.normal.items():
            self.surface[i] = piece.replace(SPACE, " ").encode("utf-8")
        for b, i in enumerate(self.byte_ids):
            self.surface[i] = bytes([b])
        self._start()

    def _start(self) -> None:
        self.clear()
        self.fresh: list[str] = []
        self.merged, self.best = Ragged(), Ragged()
        self.scores, self.losses = np.zeros(0), np.zeros(0)

    def __missing__(self, chunk: str) -> int:
        self[chunk] = at = len(self)
        self.fresh.append(chunk)
        return at

    def forward(self, chunk: str) -> tuple[list[tuple], list[float], list[int]]:
        """Viterbi pass: the lattice's edges (start, end, score, ids) by start, the best score up to each place, the edge that gives it."""
        size, trie = len(chunk), self.trie
        edges: list[tuple] = []
        best = [-INFINITE] * (size + 1)
        back = [-1] * (size + 1)
        best[0] = 0.0
        n = 0
        for i in range(size):
            here, node, single = best[i], trie, False
            for j in range(i, size):
                node = node.get(chunk[j])
                if node is None:
                    break
                piece = node.get("")
                if piece is not None:
                    if j == i:
                        single = True
                    ids, score = piece
                    edges.append((i, j + 1, score, ids))
                    if here + score > best[j + 1]:
                        best[j + 1] = here + score
                        back[j + 1] = n
                    n += 1
            if not single:
                edges.append((i, i + 1, self.unknown, tuple(self.byte_ids[b] for b in chunk[i].encode("utf-8", "replace"))))
                if here + self.unknown > best[i + 1]:
                    best[i + 1] = here + self.unknown
                    back[i + 1] = n
                n += 1
        return edges, best, back

    def search(self, chunk: str) -> list[tuple[float, tuple[int, ...]]]:
        """The N best segmentations, best first: backward A* with the forward scores as its heuristic.

        As the heuristic is exact, each entry of the queue stands for a segmentation of exactly its total score, and different entries for
        different ones. So only as many entries as results are still wanted can matter, and the queue is a short sorted list."""
        edges, best, _ = self.forward(chunk)
        size = len(chunk)
        into: list[list] = [[] for _ in range(size + 1)]
        for edge in edges:
            into[edge[1]].append(edge)
        found: list[tuple[float, tuple[int, ...]]] = []
        order, wanted = 0, self.n
        queue = [(-best[size], 0, size, 0.0, None)]
        while queue:
            total, _, at, behind, tail = queue.pop(0)
            if at == 0:
                ids: list[int] = []
                while tail is not None:
                    ids.extend(tail[0])
                    tail = tail[1]
                found.append((-total, tuple(ids)))
                wanted -= 1
                if not wanted:
                    break
                continue
            for start, _, score, ids in into[at]:
                after = score + behind
                cost = -(best[start] + after)
                if len(queue) < wanted or cost < queue[-1][0]:
                    order += 1
                    insort(queue, (cost, order, start, after, (ids, tail)))
                    if len(queue) > wanted:
                        queue.pop()
        return found

    def best_and_loss(self, chunk: str) -> tuple[tuple[int, ...], float, float]:
        """(ids and score of the best segmentation, loss of the second best).

        The second best uses an edge off the best path, and the best segmentation through an edge is what leads to it plus what follows."""
        edges, best, back = self.forward(chunk)
        size = at = len(chunk)
        on, taken = set(), []
        while at:
            on.add(back[at])
            edge = edges[back[at]]
            taken.append(edge[3])
            at = edge[0]
        ids = tuple(chain.from_iterable(reversed(taken)))
        rest = [-INFINITE] * (size + 1)
        rest[size] = 0.0
        second = -INFINITE
        for k in range(len(edges) - 1, -1, -1):
            i, j, score, _ = edges[k]
            score += rest[j]
            if score > rest[i]:
                rest[i] = score
            if best[i] + score > second and k not in on:
                second = best[i] + score
        return ids, best[size], best[size] - second

    def merge(self, chunk: str) -> list[int]:
        """Ids of one chunk by merges over a queue, for chunks of any length."""
        parts: list[str | None] = list(chunk)
        after = [*range(1, len(parts)), -1]
        before = [-1, *range(len(parts) - 1)]
        queue: list[tuple] = []

        def offer(a: int) -> None:
            if a >= 0 and after[a] >= 0 and (union := self.normal.get(parts[a] + parts[after[a]])):
                heapq.heappush(queue, (-union[1], a, parts[a], parts[after[a]]))

        for a in range(len(parts) - 1):
            offer(a)
        while queue:
            _, a, left, right = heapq.heappop(queue)
            if parts[a] != left or after[a] < 0 or parts[after[a]] != right:
                continue
            b = after[a]
            parts[a], parts[b] = left + right, None
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(a)
            offer(before[a])
        out: list[int] = []
        for part in parts:
            if part is not None:
                out.extend([self.normal[part][0]] if part in self.normal else [self.byte_ids[b] for b in part.encode("utf-8", "replace")])
        return out

    def _spelled(self, path: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks, how many each has) from the symbols at their places; unknown characters become bytes."""
        on = path >= 0
        sizes = np.add.reduceat(np.r_[on, False].astype(np.int64), limits[:-1]) if len(limits) > 1 else np.zeros(0, np.int64)
        if (path >= UNKNOWN).any():
            rows = [[y for x in path[a:b].tolist() if x >= 0 for y in ([x] if x < UNKNOWN else [self.byte_ids[c] for c in chr(x - UNKNOWN).encode("utf-8", "replace")])] for a, b in zip(limits[:-1], limits[1:])]
            return np.array(list(chain.from_iterable(rows)), np.int32), np.array([len(r) for r in rows], np.int64)
        return path[on].astype(np.int32), sizes

    def learn(self) -> None:
        """Takes the chunks met since the last call into the memo."""
        fresh, self.fresh = self.fresh, []
        if not fresh:
            return
        sizes = np.fromiter(map(len, fresh), np.int64, len(fresh))
        scores, losses = np.zeros(len(fresh)), np.zeros(len(fresh))
        merged: list = [None] * 2  # ids and sizes of short chunks
        best: list = [None] * 2
        short = np.flatnonzero(sizes <= LONG)
        limits = np.concatenate([[0], np.cumsum(sizes[short])])
        codes = np.frombuffer("".join([fresh[i] for i in short.tolist()]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        path, scores[short], losses[short] = self.vocabulary.segmented(codes, limits, self.unknown)
        best = self._spelled(path, limits)
        merged = self._spelled(self.vocabulary.merged(self.vocabulary.symbols(codes), limits), limits)
        if len(short) < len(fresh):
            long_merged, long_best = {}, {}
            for i in np.flatnonzero(sizes > LONG).tolist():
                ids, scores[i], losses[i] = self.best_and_loss(fresh[i])
                long_merged[i], long_best[i] = self.merge(fresh[i]), ids
            merged, best = (self._woven(short, x, y, len(fresh)) for x, y in ((merged, long_merged), (best, long_best)))
        self.merged.extend(*merged)
        self.best.extend(*best)
        self.scores, self.losses = np.concatenate([self.scores, scores]), np.concatenate([self.losses, losses])

    @staticmethod
    def _woven(short: np.ndarray, pair: tuple[np.ndarray, np.ndarray], long: dict[int, list[int]], n: int) -> tuple[np.ndarray, np.ndarray]:
        """The lists of short and long chunks in the order of all."""
        sizes = np.zeros(n, np.int64)
        sizes[short] = pair[1]
        for i, x in long.items():
            sizes[i] = len(x)
        begins = np.cumsum(sizes) - sizes
        out = np.empty(sizes.sum(), np.int32)
        own = np.cumsum(pair[1]) - pair[1]
        out[np.repeat(begins[short] - own, pair[1]) + np.arange(len(pair[0]))] = pair[0]
        for i, x in long.items():
            out[begins[i] : begins[i] + len(x)] = x
        return out, sizes

    def alternatives(self, chunk: str) -> list[tuple[float, tuple[int, ...]]]:
        """(loss, ids) of the second to the N-th best."""
        found = self.full.get(chunk)
        if found is None:
            best, *rest = self.search(chunk)
            found = [(best[0] - s, ids) for s, ids in rest]
            if len(self.full) >= MEMO // 10:
                self.full.clear()
            self.full[chunk] = found
        return found

    def chunks(self, text: str) -> list[str]:
        if not text:
            return []
        split = self.coarse if self.rare(text) else self.split
        return split((self.dummy + text).replace(" ", SPACE))

    def encode_all(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, float, list[tuple[float, list[tuple[int, int, list[int]]]]]]]:
        """(merged ids, best ids, score, alternatives) of each text: an alternative is (score, [(first best id that changes, how many go, ids in their place)])."""
        if len(self) >= MEMO:
            self._start()
        parts = [self.chunks(t) for t in texts]
        rows = np.fromiter(map(self.__getitem__, chain.from_iterable(parts)), np.int64, sum(map(len, parts)))
        self.learn()
        ids, id_at = self.merged.take(rows)
        best, best_at = self.best.take(rows)
        scores, losses = self.scores[rows], self.losses[rows]
        a = 0
        for mine in parts:
            b = a + len(mine)
            score = sum(scores[a:b].tolist())
            others = self._others(mine, losses[a:b], best_at[a : b + 1] - best_at[a], score) if mine else []
            yield ids[id_at[a] : id_at[b]], best[best_at[a] : best_at[b]], score, others
            a = b

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, float, list]:
        return next(self.encode_all([text]))

    def _others(self, parts: list[str], losses: np.ndarray, begins: np.ndarray, score: float) -> list[tuple]:
        k = min(self.n - 1, len(parts))
        if k < 1:
            return []
        limit = np.partition(losses, k - 1)[k - 1]
        near = np.flatnonzero(losses <= limit)
        near = near[np.isfinite(losses[near])]
        near = near[np.argsort(losses[near], kind="stable")][:k].tolist()
        options = [self.alternatives(parts[i]) for i in near]
        return [
            (score - loss, sorted((int(begins[near[p]]), int(begins[near[p] + 1] - begins[near[p]]), list(options[p][a][1])) for p, a in choice))
            for loss, choice in self._least(options)
        ]

    def _least(self, options: list[list[tuple]]) -> list[tuple[float, tuple[tuple[int, int], ...]]]:
        """The N-1 smallest sums of losses, one alternative a chunk at most, best first."""
        heap = [(o[0][0], ((p, 0),)) for p, o in enumerate(options)]
        heapq.heapify(heap)
        out = []
        while heap and len(out) < self.n - 1:
            loss, choice = heapq.heappop(heap)
            out.append((loss, choice))
            p, a = choice[-1]  # grow only the last choice or add a later chunk: every set is made once
            if a + 1 < len(options[p]):
                heapq.heappush(heap, (loss - options[p][a][0] + options[p][a + 1][0], (*choice[:-1], (p, a + 1))))
            for q in range(p + 1, len(options)):
                heapq.heappush(heap, (loss + options[q][0][0], (*choice, (q, 0))))
        return out

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.dummy and text.startswith(" ") else text


def _sent(spark: SparkSession, lattice: Lattice):
    """The lattice as bytes for all tasks: building it takes seconds, reading it does not. Its size is that of the model file and its prefixes."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(lattice))


ENCODED = (
    "doc_id long, n_pieces long, ids array<int>, ids_sha256 string, round_trip boolean, score double, best_ids array<int>, "
    "alternatives array<struct<score: double, changes: array<struct<at: int, n: int, ids: array<int>>>>>"
)


def encode(docs: DataFrame, path: str, n: int = N_BEST) -> DataFrame:
    """docs(doc_id, text) -> the tokenizer's ids; the lattice's best ids and score, and the next n-1 as changes to them, best first."""
    if n < 1:
        raise ValueError("n must be positive")
    spark = docs.sparkSession
    prepare(spark)
    model = _sent(spark, Lattice(load(path), n))
    change = pa.struct([("at", pa.int32()), ("n", pa.int32()), ("ids", pa.list_(pa.int32()))])
    types = (pa.int64(), pa.string(), pa.bool_(), pa.float64(), pa.list_(pa.struct([("score", pa.float64()), ("changes", pa.list_(change))])))

    def lists(rows: list[np.ndarray]) -> pa.Array:
        limits = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(limits), pa.array(np.concatenate(rows).astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        lattice = pickle.loads(model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                out, merged, bests = [], [], []
                texts = part.column("text").to_pylist()
                for text, (ids, best, score, others) in zip(texts, lattice.encode_all(texts)):
                    merged.append(ids)
                    bests.append(best)
                    others = [{"score": s, "changes": [dict(zip(("at", "n", "ids"), c)) for c in changes]} for s, changes in others]
                    same = lattice.decode(ids.tolist()) == text.replace(SPACE, " ")
                    out.append((len(ids), hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest(), same, score, others))
                count, digest, same, score, others = (pa.array(c, t) for c, t in zip(zip(*out), types))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), count, lists(merged), digest, same, score, lists(bests), others],
                    names=["doc_id", "n_pieces", "ids", "ids_sha256", "round_trip", "score", "best_ids", "alternatives"],
                )

    return keyed_text(docs).mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """encoded(doc_id, a column of ids) -> (doc_id, text)."""
    spark = encoded.sparkSession
    prepare(spark)
    model = _sent(spark, Lattice(load(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = pickle.loads(model.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([lattice.decode(x or []) for x in batch.column("ids").to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", F.col(ids).alias("ids")).mapInArrow(run, "doc_id long, text string")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode(documents(spark, sf_dir), model_path())
    best = F.size("best_ids").cast("long").alias("n_best_pieces")
    return out.select("doc_id", "n_pieces", "ids_sha256", "round_trip", "score", best, F.expr("transform(alternatives, a -> a.score)").alias("alternative_scores"))
