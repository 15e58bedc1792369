"""Sampled segmentations of a SentencePiece vocabulary, and their lossless decoding.

Piece weights: p(piece) is proportional to (rank + RANK0)^-alpha, rank being the piece's place
among the vocabulary's scores (a merge vocabulary has ranks, not likelihoods). A
segmentation's probability is proportional to the product of its pieces' weights. It is
drawn exactly, by forward filtering over the lattice (the total weight of all ways to
reach each place) and backward sampling from the end.

Pieces have the space sign only in front, so the lattice falls apart before each run of
spaces, and around line ends, which are in no piece of several characters; what lies between is a unit. A
unit's forward table is made once per task and reused. Random numbers are a hash of seed,
row key and place in the text: the draw depends on nothing else, whatever the partitions,
batches or retries. A character that no piece covers is spelled in byte pieces.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from treeplan.llm.shared import attach, mixed, slices

RANK0 = 10.0
#: Shares are multiples of 1 / STEPS, and random numbers lie between those, so comparing them is exact at any node.
STEPS = 1 << 28
#: Units whose tables a task keeps.
CACHED = 600_000
#: Characters of a unit up to which many are filtered at once.
LONG = 64
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=2)
def vocabulary(path: str, alpha: float) -> "Vocabulary":
    return Vocabulary(path, alpha)


class Vocabulary:
    def __init__(self, path: str, alpha: float = 1.0) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes, self.byte_id, found = [b""] * n, {}, {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.bytes[i] = piece.replace("▁", " ").encode()
                found[piece.replace("▁", " ")] = (sp.get_score(i), i)
        if len(self.byte_id) < 256:
            raise ValueError("the vocabulary has no byte pieces: it cannot be lossless")
        if any(" " in p.lstrip(" ") for p in found):
            raise ValueError("a piece has a space inside")
        order = sorted(found.values(), key=lambda x: (-x[0], x[1]))
        raw = np.arange(len(order), dtype=float) + RANK0
        weight = raw**-alpha / (raw**-alpha).sum()
        #: Every beginning of a piece: (id, weight), or None where it is no piece itself.
        self.trie: dict[str, tuple[int, float] | None] = {}
        scale = float(1 / weight.max())  # a factor for each character: no draw changes, no product vanishes
        for (_, i), w in zip(order, weight.tolist(), strict=True):
            piece = self.bytes[i].decode()
            for k in range(1, len(piece)):
                self.trie.setdefault(piece[:k], None)
            self.trie[piece] = (i, w * scale ** len(piece))
        self.longest = max(map(len, found))
        # the same beginnings as a table of steps: state << 21 | character, sorted; the state reached; its piece and weight
        number = {"": 0} | {p: k for k, p in enumerate(self.trie, 1)}
        steps = sorted((number[p[:-1]] << 21 | ord(p[-1]), k) for p, k in number.items() if p)
        self.step, self.reached = (np.array(x, np.int64) for x in zip(*steps, strict=True))
        known = [(-1, 0.0), *[hit or (-1, 0.0) for hit in self.trie.values()]]
        self.piece, self.weight = np.array([i for i, _ in known], np.int64), np.array([w for _, w in known])
        self.single = np.array([self.byte_id[c] for c in range(128)] + [-1], np.int64)
        self.spelled = float(weight.min() * 1e-3 * scale)
        #: Characters in no piece of several characters but spaces: the lattice falls apart around them.
        self.alone = "".join(c for c in "\n\t\r" if not any(c in p and len(p) > 1 for p in found))
        self.unit = re.compile((f"[{re.escape(self.alone)}]|" if self.alone else "") + f" *[^ {re.escape(self.alone)}]+| +")

    def lattice(self, unit: str) -> list[list[tuple[int, int, float]]]:
        """By end place: (start, id, weight) of the pieces there; id -1 is a character spelled in several bytes."""
        trie, n = self.trie, len(unit)
        ends: list[list[tuple[int, int, float]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            one = False
            for j in range(i + 1, n + 1):
                hit = trie.get(unit[i:j], 0)
                if hit is None:
                    continue
                if hit == 0:
                    break
                one = one or j == i + 1
                ends[j].append((i, *hit))
            if not one:
                ends[i + 1].append((i, self.byte_id[ord(unit[i])] if unit[i] < "\x80" else -1, self.spelled))
        return ends

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")[1:]


class _Grown:
    """An array that grows at its end."""

    def __init__(self, kind) -> None:
        self.room, self.n = np.zeros(1 << 16, kind), 0

    def add(self, values: np.ndarray) -> None:
        n = self.n + len(values)
        if n > len(self.room):
            wide = np.zeros(max(n, 2 * len(self.room)), self.room.dtype)
            wide[: self.n] = self.room[: self.n]
            self.room = wide
        self.room[self.n : n] = values
        self.n = n

    @property
    def all(self) -> np.ndarray:
        return self.room[: self.n]


class Sampler:
    """Draws segmentations of texts; keeps the tables of the units it met.

    A unit of n characters has n nodes, its ends 1..n. Node x's choices are the pieces that end there, by
    start; they lie in x < cum <= x + 1, by their share of the weight of all ways to x."""

    def __init__(self, vocab: Vocabulary, seed: int) -> None:
        self.vocab, self.seed = vocab, seed
        self.clear()

    def clear(self) -> None:
        self.units: dict[str, int] = {}
        self.first, self.length = _Grown(np.int64), _Grown(np.int64)  # by unit: its first node, its characters
        self.nodes = 0
        self.cum, self.start, self.id = _Grown(float), _Grown(np.int32), _Grown(np.int32)

    def learn(self, new: list[str]) -> None:
        """Forward filtering of units; they get the next numbers in order."""
        size = np.array([len(u) for u in new], np.int64)
        base = np.zeros(len(new), np.int64)
        for wide in (False, True):
            some = np.flatnonzero((size > LONG) == wide)
            if not len(some):
                continue
            base[some] = self.nodes + np.concatenate([[0], np.cumsum(size[some])])[:-1]
            find = _filtered_long if wide else _filtered
            cum, start, ids, node = find(self.vocab, [new[k] for k in some.tolist()], size[some])
            self.cum.add(cum + (node + self.nodes))
            self.start.add(start)
            self.id.add(ids)
            self.nodes += int(size[some].sum())
        self.first.add(base)
        self.length.add(size)

    def draw(self, keys: list[int], texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; keys: an unsigned 64-bit number for each."""
        if len(self.units) > CACHED or self.nodes > 1 << 23:
            self.clear()
        units, find, met, count, new = self.units, self.vocab.unit.findall, [], [], []
        texts = [" " + t if t else "" for t in texts]
        for text in texts:
            own = find(text)
            got = list(map(units.get, own))
            if None in got:
                for k, at in enumerate(got):
                    if at is None:
                        u = own[k]
                        at = units.get(u)
                        if at is None:
                            at = units[u] = len(units)
                            new.append(u)
                        got[k] = at
            met.append(np.array(got, np.int64))
            count.append(len(own))
        if new:
            self.learn(new)
        unit = np.concatenate(met) if met else np.zeros(0, np.int64)
        node, end = self.first.all[unit], self.length.all[unit]
        place = np.cumsum(end) - end  # of each unit, in all texts
        base = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        of = np.repeat(np.arange(len(texts)), count)
        key = mixed(np.array([(k + self.seed * int(_GOLDEN)) % 2**64 for k in keys], np.uint64))[of] - base[of].astype(np.uint64) * _GOLDEN
        order = np.argsort(node, kind="stable")  # neighbours look in the same part of the tables
        node, end, place, key = node[order], end[order], place[order], key[order]
        cum, starts, ids = self.cum.all, self.start.all, self.id.all
        out = np.full(int(base[-1]), -2, np.int32)
        while len(node):
            u = ((mixed(key + (place + end).astype(np.uint64) * _GOLDEN) >> np.uint64(36)).astype(np.float64) + 0.5) / STEPS
            pick = np.searchsorted(cum, node + end - 1 + u)
            start = starts[pick].astype(np.int64)
            out[place + start] = ids[pick]
            more = np.flatnonzero(start)
            node, end, place, key = node[more], start[more], place[more], key[more]
        result, byte = [], self.vocab.byte_id
        several = set(of[np.searchsorted(np.cumsum(self.length.all[unit]), np.flatnonzero(out == -1), side="right")].tolist())
        for i, text in enumerate(texts):
            own = out[base[i] : base[i + 1]]
            if i in several:
                spelled: list[int] = []
                for at in np.flatnonzero(own > -2).tolist():
                    spelled += [byte[b] for b in text[at].encode("utf-8", "replace")] if own[at] == -1 else [int(own[at])]
                result.append(np.array(spelled, np.int32))
            else:
                result.append(own[own >= 0])
        return result


def _filtered(vocab: Vocabulary, units: list[str], size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cum within the node, start, id, node) of all choices, by node and start; for many short units at once."""
    codes = np.frombuffer("".join(units).encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    n = len(codes)
    head = np.repeat(np.cumsum(size) - size, size)  # by place: its unit's first place, and the one after its last
    stop = head + np.repeat(size, size)
    at, state, edges, covered = np.arange(n), np.zeros(n, np.int64), [], np.zeros(n, bool)
    for k in range(1, vocab.longest + 1):
        inside = at + k <= stop[at]
        at, state = at[inside], state[inside]
        key = state << 21 | codes[at + k - 1]
        to = np.minimum(np.searchsorted(vocab.step, key), len(vocab.step) - 1)
        real = np.flatnonzero(vocab.step[to] == key)
        at, state = at[real], vocab.reached[to[real]]
        piece = vocab.piece[state]
        hit = np.flatnonzero(piece >= 0)
        edges.append((at[hit], np.full(len(hit), k), piece[hit], vocab.weight[state[hit]]))
        if k == 1:
            covered[at[hit]] = True
        if not len(at):
            break
    bare = np.flatnonzero(~covered)
    edges.append((bare, np.ones(len(bare), np.int64), vocab.single[np.minimum(codes[bare], 128)], np.full(len(bare), vocab.spelled)))
    start, length, piece, weight = (np.concatenate(x) for x in zip(*edges, strict=True))
    node = start + length - 1
    order = np.argsort(node << 6 | (63 - length), kind="stable")
    start, piece, weight, node = start[order], piece[order], weight[order], node[order]
    count = np.bincount(node, minlength=n)
    first = np.cumsum(count) - count
    total, cum = np.zeros(n + 1), np.zeros(len(node))  # total[n]: of a unit's beginning
    total[n] = 1.0
    before = np.where(start == head[start], n, start - 1)
    level = np.arange(n) - head
    by_level = np.argsort(level, kind="stable")
    cut = np.searchsorted(level[by_level], np.arange(level.max(initial=-1) + 2))
    for a, b in zip(cut, cut[1:]):
        own = by_level[a:b]
        c = count[own]
        place = np.arange(c.max())
        held = place < c[:, None]
        edge = np.minimum(first[own, None] + place, len(node) - 1)
        ways = np.cumsum(np.where(held, total[before[edge]] * weight[edge], 0.0), axis=1)
        total[own] = ways[:, -1]
        cum[edge[held]] = (np.rint(ways / ways[:, -1:] * STEPS) / STEPS)[held]
    cum[first + count - 1] = 1.0
    return cum, (start - head[start]).astype(np.int32), piece.astype(np.int32), node


def _filtered_long(vocab: Vocabulary, units: list[str], size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same for units of any length, one after the other, with totals scaled on the way."""
    cum, starts, ids, nodes, node = [], [], [], [], 0
    for unit in units:
        total = [1.0]
        for edges in vocab.lattice(unit)[1:]:
            ways = [total[i] * w for i, _, w in edges]
            most = sum(ways)
            if not 1e-200 < most < 1e200:  # scale what later steps look back on
                back = max(0, len(total) - 2 * vocab.longest)
                total[back:] = [t / most for t in total[back:]]
                ways, most = [w / most for w in ways], 1.0
            total.append(most)
            run = 0.0
            for (i, p, _), w in zip(edges, ways, strict=True):
                run += w
                cum.append(np.rint(run / most * STEPS) / STEPS)
                starts.append(i)
                ids.append(p)
                nodes.append(node)
            cum[-1] = 1.0
            node += 1
    return np.array(cum), np.array(starts, np.int32), np.array(ids, np.int32), np.array(nodes, np.int64)


def row_key(value) -> int:
    return xxh64_intdigest(b"" if value is None else str(value).encode(), 42)


def encode(docs: DataFrame, model: str, seed: int = 7, alpha: float = 1.0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """One row for each row of docs: doc_id, n_pieces, ids array<int>, decoded_sha256 (of the text that the
    ids decode to), lossless (whether that is the text).

    The same key, text, seed and alpha give the same ids anywhere. A null text has null ids and
    0 pieces, an empty one none; a null key counts as an empty one; rows that repeat a key and text
    repeat its ids; an empty table gives no rows; other columns are not looked at; a very long text is drawn unit by unit.
    """
    attach(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model, alpha)
        sampler = Sampler(vocab, seed)
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                docs_, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                drawn = sampler.draw([row_key(d) for d in docs_], [t or "" for t in texts])
                sha, same = [], []
                for text, ids in zip(texts, drawn, strict=True):
                    if text is None:
                        sha.append(None)
                        same.append(True)
                        continue
                    back = vocab.decode(ids.tolist())
                    sha.append(hashlib.sha256(back.encode("utf-8", "replace")).hexdigest())
                    same.append(back == text)
                empty = np.array([t is None for t in texts])
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in drawn])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(empty, False)), pa.array(np.concatenate(drawn) if drawn else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets).astype(np.int64)), ids, pa.array(sha, pa.string()), pa.array(same, pa.bool_())], names=["doc_id", "n_pieces", "ids", "decoded_sha256", "lossless"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_pieces long, ids array<int>, decoded_sha256 string, lossless boolean")


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from ids; null ids give a null text, none an empty one; null keys and repeated rows stay; an empty
    table gives no rows; other columns are not looked at; a very long list of ids is one text."""
    attach(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model, 1.0)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [None if x.as_py() is None else vocab.decode(x.as_py()) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")
