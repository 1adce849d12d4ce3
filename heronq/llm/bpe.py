"""Byte-level BPE with a segment tree over adjacent pair ranks, for many pieces at once.

A piece of n symbols has n - 1 adjacent pairs. Leaf i of its tree holds rank * size + i for the
pair that starts at symbol i, or a value above all others; every inner node holds the lesser child. The
root therefore yields the leftmost pair of lowest rank. A merge changes three leaves (the pair
itself, the one before, the one that vanishes) and their O(log n) ancestors. Pieces of like length
share one array, so a step merges the roots of all unfinished pieces together; a few pieces alone, such as
very long words, have a tree each.

Null and empty texts have no ids. The text of an added token becomes its id, leftmost and longest
first, as in the tokenizer file.
"""

from __future__ import annotations

import json

import numpy as np
import regex

from heronq.llm.wordcache import CACHE_ENTRIES, PieceCache, encode_all, full_piece

_NONE = np.int64(1) << np.int64(62)
#: Symbols of pieces worked on together; fewer pieces than this go one by one.
_TOGETHER, _FEW = 1 << 18, 8


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in shown}
    spare = 256
    for b in range(256):
        if b not in table:
            table[b] = chr(spare)
            spare += 1
    return table


class PairRanks:
    """Open-addressed table from a pair of symbols to rank and merged symbol."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        size = 1 << max(4, int(np.ceil(np.log2(4 * len(left) + 1))))
        self.mask = size - 1
        self.keys = np.full(size, -1, np.int64)
        self.rank = np.full(size, -1, np.int64)
        self.merged = np.full(size, -1, np.int64)
        keys = (left.astype(np.int64) << 32) | right
        todo = np.arange(len(keys))
        at = self._slot(keys)
        while len(todo):  # each round places one key in every free slot asked for
            free = self.keys[at] == -1
            slots, chosen = np.unique(at[free], return_index=True)
            win = np.flatnonzero(free)[chosen]
            self.keys[slots], self.rank[slots], self.merged[slots] = keys[todo[win]], todo[win], merged[todo[win]]
            left_over = np.ones(len(todo), bool)
            left_over[win] = False
            todo, at = todo[left_over], (at[left_over] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h >> np.uint64(40)) & np.uint64(self.mask)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slots of pairs, or -1."""
        keys = (left.astype(np.int64) << 32) | right
        at = self._slot(keys)
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            got = self.keys[at]
            hit = got == keys[todo]
            out[todo[hit]] = at[hit]
            on = ~hit & (got != -1)
            todo, at = todo[on], (at[on] + 1) & self.mask
        return out


class SegmentTreeBPE:
    """Encoder and decoder over the vocabulary of a byte-level tokenizer file."""

    def __init__(self, path: str, pattern: str, entries: int = CACHE_ENTRIES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        alphabet = byte_alphabet()
        back = {c: b for b, c in alphabet.items()}
        self.symbol = np.array([vocab[alphabet[b]] for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left, right, merged = (np.array(x, np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in pairs)))
        self.pairs = PairRanks(left, right, merged)
        self.rank_of = {(a << 32) | b: i for i, (a, b) in enumerate(zip(left.tolist(), right.tolist()))}
        self.merged = merged.tolist()
        self.token_bytes = [b""] * (max([*vocab.values(), *added.values()]) + 1)
        for t, i in vocab.items():
            self.token_bytes[i] = bytes(back[c] for c in t)
        for t, i in added.items():
            self.token_bytes[i] = t.encode()
        self.added = added
        self.split_added = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.pattern = regex.compile(pattern)
        self.cache = PieceCache(self._fill, entries)
        self.parts: dict[str, bytes] = {}
        self.entries = entries

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """The ids of each piece, which no pre-token boundary divides."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(lengths, kind="stable")
        i = int(np.searchsorted(lengths[order], 1))
        while i < len(order):
            size = 1 << int(np.ceil(np.log2(max(2, lengths[order[i]]))))
            j = min(int(np.searchsorted(lengths[order], size, "right")), i + max(1, _TOGETHER // size))
            some = order[i:j]
            group = [pieces[k] for k in some]
            for k, ids in zip(some.tolist(), self._merge_group(group, size) if len(group) >= _FEW else map(self._merge_one, group)):
                out[k] = ids
            i = j
        return out

    def _merge_one(self, piece: bytes) -> np.ndarray:
        """The same tree for a piece by itself, as a plain list: a step costs some list accesses, not some array calls."""
        sym, n = self.symbol[np.frombuffer(piece, np.uint8)].tolist(), len(piece)
        size, none, rank_of, merged = 1 << (n - 1).bit_length(), int(_NONE), self.rank_of.get, self.merged
        tree = [none] * (2 * size)
        for i in range(n - 1):
            r = rank_of((sym[i] << 32) | sym[i + 1])
            if r is not None:
                tree[size + i] = r * size + i
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def update(i: int, value: int) -> None:
            i += size
            tree[i] = value
            while i > 1:
                i >>= 1
                a, b = tree[2 * i], tree[2 * i + 1]
                value = a if a < b else b
                if tree[i] == value:
                    return
                tree[i] = value

        def pair(i: int, j: int) -> int:
            r = rank_of((sym[i] << 32) | sym[j])
            return none if r is None else r * size + i

        while n > 1 and (root := tree[1]) < none:
            p = root & (size - 1)
            q = after[p]
            sym[p], sym[q] = merged[root // size], -1
            r = after[p] = after[q]
            update(q, none)
            if r < n:
                before[r] = p
            update(p, pair(p, r) if r < n else none)
            if (o := before[p]) >= 0:
                update(o, pair(o, p))
        return np.array([s for s in sym if s >= 0], "<u4")

    def _ranked(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, size: int) -> np.ndarray:
        at = self.pairs.find(left, right)
        return np.where(at >= 0, self.pairs.rank[at] * size + place, _NONE)

    def _merge_group(self, pieces: list[bytes], size: int) -> list[np.ndarray]:
        n = len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        row = np.repeat(np.arange(n), lengths)
        col = np.arange(len(raw)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        sym = np.full((n, size), -1, np.int64)
        sym[row, col] = self.symbol[raw]
        # neighbours: next symbol's place or size; previous symbol's place or -1
        after = np.where(np.arange(size) + 1 < lengths[:, None], np.arange(size) + 1, size)
        before = np.broadcast_to(np.arange(size) - 1, (n, size)).copy()
        tree = np.full((n, 2 * size), _NONE, np.int64)
        paired = (np.arange(size) + 1 < lengths[:, None]).nonzero()
        tree[paired[0], size + paired[1]] = self._ranked(sym[paired], sym[paired[0], paired[1] + 1], paired[1], size)
        level = size
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2

        def update(rows: np.ndarray, places: np.ndarray, values: np.ndarray) -> None:
            node = size + places
            tree[rows, node] = values
            while node[0] > 1:  # all nodes are on one level
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        live = np.flatnonzero(tree[:, 1] < _NONE)
        while len(live):
            p = tree[live, 1] % size
            q = after[live, p]
            at = self.pairs.find(sym[live, p], sym[live, q])
            sym[live, p] = self.pairs.merged[at]
            sym[live, q] = -1
            r = after[live, q]
            after[live, p] = r
            has = r < size
            before[live[has], r[has]] = p[has]
            update(live, q, np.full(len(live), _NONE))
            value = np.full(len(live), _NONE)
            value[has] = self._ranked(sym[live[has], p[has]], sym[live[has], r[has]], p[has], size)
            update(live, p, value)
            o = before[live, p]
            has = o >= 0
            if has.any():
                rows, o, p = live[has], o[has], p[has]
                update(rows, o, self._ranked(sym[rows, o], sym[rows, p], o, size))
            live = live[tree[live, 1] < _NONE]
        kept = sym >= 0
        ids = sym[kept].astype("<u4")
        edges = np.concatenate([[0], np.cumsum(kept.sum(axis=1))])
        return [ids[a:b] for a, b in zip(edges, edges[1:])]

    def _fill(self, keys: list[str]) -> list[bytes]:
        known, todo, cuts = self.parts, {}, []
        if len(known) > self.entries // 2:
            known.clear()
        for k in keys:
            cut = self.pattern.findall(full_piece(k))
            cuts.append(cut)
            for p in cut:
                if p not in known:
                    todo[p] = None
        if todo:
            known.update(zip(todo, (x.tobytes() for x in self.merge([p.encode() for p in todo]))))
        get = known.__getitem__
        return [get(c[0]) if len(c) == 1 else b"".join(map(get, c)) for c in cuts]

    def _whole(self, text: str) -> bytes:
        parts = self.split_added.split(text) if self.split_added else [text]
        out = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(np.asarray([self.added[part]], "<u4").tobytes())
            else:
                out += (x.tobytes() for x in self.merge([p.encode() for p in self.pattern.findall(part)]))
        return b"".join(out)

    def encode(self, texts: list[str]) -> list[bytes]:
        """ids as little-endian unsigned 32-bit integers."""
        return encode_all(texts, self.cache, self._whole, tuple(self.added))

    def decode(self, ids: bytes) -> str:
        get = self.token_bytes.__getitem__
        return b"".join(map(get, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_loaded: dict[tuple, SegmentTreeBPE] = {}


def segment_tree_bpe(path: str, pattern: str) -> SegmentTreeBPE:
    """This worker process's encoder for a file."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = SegmentTreeBPE(path, pattern)
    return _loaded[path, pattern]
