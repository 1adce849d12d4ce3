"""Encoding of whole texts piece by piece through a bounded cache, with the result of the whole-text call.

Every pre-tokeniser used here starts a new piece where a white-space character follows another
character, so a text cut at such places encodes to the pieces' ids in sequence. Natural text
repeats its pieces, and the cache saves encoding them again. Pieces are encoded many at a time.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa

from heronq.llm.common import lower_bytes, strings, utf8
from heronq.llm.runtable import WIDTH, RunTable, key_words

#: Entries of both generations of the cache together.
CACHE_ENTRIES = 1_500_000
#: Runs in the table of a library encoder.
RUN_ENTRIES = 650_000

_ODD = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_PIECE = re.compile(r"\s*\S+|\s+")
#: Characters about which libraries differ whether they are white space.
_DISPUTED = re.compile("[\x1c-\x1f\x85\u180e\u200b]")


class PieceCache:
    """Maps pieces to bytes; fill(list of new pieces) -> list of bytes. The piece before the first space is kept
    apart from the others by a leading NUL, the others stand without their space."""

    def __init__(self, fill: Callable[[list[str]], list[bytes]], entries: int = CACHE_ENTRIES):
        self.fill, self.limit = fill, max(2, entries // 2)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ensure(self, pieces: set[str]) -> dict[str, bytes]:
        if len(self.new) > self.limit:
            self.old, self.new = self.new, {}
        todo = []
        for p in pieces.difference(self.new):
            got = self.old.get(p)
            if got is None:
                todo.append(p)
            else:
                self.new[p] = got
        if todo:
            self.new.update(zip(todo, self.fill(todo)))
        return self.new


def split_spaced(text: str) -> list[str] | None:
    """The pieces of a text whose white space is single spaces and line ends between other characters; else None.

    Pieces after the first stand for themselves with a space before, or begin with their line end.
    """
    if not text or text[0].isspace() or text[-1].isspace() or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or _ODD.search(text) or "\0" in text:
        return None
    parts = text.replace("\n", " \n").split(" ")
    parts[0] = "\0" + parts[0]
    return parts


def full_piece(p: str) -> str:
    """The text that a cache key stands for."""
    return p[1:] if p[0] == "\0" or p[0] == "\1" else p if p[0] == "\n" else " " + p


def split_pieces(text: str) -> list[str] | None:
    """Keys of the pieces of any text, or None where libraries differ about its white space."""
    parts = split_spaced(text)
    if parts is None and not _DISPUTED.search(text) and "\0" not in text and "\1" not in text:
        return ["\1" + p for p in _PIECE.findall(text)]
    return parts


def encode_all(texts: list[str], cache: PieceCache, whole: Callable[[str], bytes], special: tuple[str, ...]) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit integers."""
    cut = [None if any(s in t for s in special) else split_pieces(t) for t in texts]
    known = cache.ensure(set().union(*[c for c in cut if c]))
    get = known.__getitem__
    return [whole(t) if c is None else b"".join(map(get, c)) for t, c in zip(texts, cut)]


#: What a byte is to the run cutter: part of a letter, a digit, a sign, one that only whole pieces know, a white space.
_LETTER, _DIGIT, _SIGN, _WHOLE, _SPACE = 1, 2, 3, 4, 5
_KIND = np.full(256, _WHOLE, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[[c for c in (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)) if c != 39]] = _SIGN
_KIND[[0x20, 0x0A]] = _SPACE
#: Bytes that make a text odd: control characters that are white space somewhere, and NUL; and pairs of bytes that begin wide white space.
_ODD_BYTE = np.zeros(256, bool)
_ODD_BYTE[[0, 0x09, 0x0B, 0x0C, 0x0D, *range(0x1C, 0x20)]] = True
_ODD_PAIR = [0xC285, 0xC2A0, 0xE19A, 0xE1A0, 0xE280, 0xE281, 0xE380]


class LibraryEncoder:
    """ids of texts as tokenizers.Tokenizer.encode(text, add_special_tokens=False) gives them, truncation and padding off.

    Texts are cut into runs that every pre-tokeniser cuts for certain (a space and letters, digits, signs), and only
    runs not in the table go to the library; pieces between spaces that hold other characters stay whole, and texts with
    other white space or the text of a special token are encoded piece by piece or as they are.
    """

    def __init__(self, path: str, entries: int = RUN_ENTRIES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.special = tuple(t.content for t in self.tok.get_added_tokens_decoder().values())
        self.pairs = np.zeros(1 << 16, bool)
        self.pairs[[*_ODD_PAIR, *(int.from_bytes((t.encode() + b"\0")[:2], "big") for t in self.special)]] = True
        self.cache = PieceCache(lambda keys: [self._whole(full_piece(k)) for k in keys], min(entries, CACHE_ENTRIES // 8))
        self.table, self.entries = RunTable(), entries
        self.lower = self.tok.normalizer is not None  # then white space leaves no ids
        self.line_end = None if self.lower else self._whole("\n")
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _many(self, runs: list[str]) -> list[np.ndarray]:
        """ids of runs of one kind, with a space before or not; told apart in one call by line ends or by word ends."""
        out = []
        for k in range(0, len(runs), 2000):
            some = runs[k : k + 2000]
            ids = np.asarray(self.tok.encode_batch_fast([(" " if self.lower else "\n").join(some)], add_special_tokens=False)[0].ids, np.uint32)
            if self.lower:  # a run of letters or signs is one word, one of digits a word for each
                last = np.cumsum([len(r) if "0" <= r[0] <= "9" else 1 for r in some])
                at = np.flatnonzero(self.ends[ids]) + 1
                if last[-1] != len(at):
                    raise AssertionError("word ends don't match the runs")
                edges = [0, *at[last - 1].tolist()]
                out += [ids[a:b] for a, b in zip(edges, edges[1:])]
            else:  # a line end between two runs is a token of its own
                at = np.flatnonzero(ids == np.frombuffer(self.line_end, "<u4")[0])
                edges = [-1, *at.tolist(), len(ids)]
                if len(edges) != len(some) + 1:
                    raise AssertionError("a run held a line end")
                out += [ids[a + 1 : b] for a, b in zip(edges, edges[1:])]
        return out

    def _new(self, runs: list[bytes], whole: list[bool]) -> list[np.ndarray]:
        texts = [r.decode() for r in runs]
        plain = [t for t, w in zip(texts, whole) if not w and t != "\n"]
        made = iter(self._many(plain) if plain else ())
        return [np.frombuffer(self._whole(t), "<u4") if w or t == "\n" else next(made) for t, w in zip(texts, whole)]

    def _odd(self, data: np.ndarray, offsets: np.ndarray, space: np.ndarray) -> np.ndarray:
        """Which texts the cutter leaves to split_pieces: their white space is not single spaces and line ends between other characters."""
        odd = np.zeros(len(offsets) - 1, bool)
        some = offsets[1:] > offsets[:-1]
        odd[some] = space[offsets[:-1][some]] | space[offsets[1:][some] - 1]
        pair = (data[:-1].astype(np.uint16) << np.uint16(8)) | data[1:]
        at = [np.flatnonzero(_ODD_BYTE[data]), np.flatnonzero(self.pairs[pair])]
        both = np.flatnonzero(space[1:] & space[:-1])
        at.append(both[~np.isin(both + 1, offsets)])
        where = np.concatenate(at)
        odd[np.searchsorted(offsets, where, "right") - 1] = True
        return odd

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's begin (one more than texts). Nulls are empty."""
        if self.table.n > self.entries:
            self.table.clear()
        data, offsets = utf8(column)
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        kind = _KIND[data]
        lead = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7))  # Latin letters of two bytes
        kind[lead] = kind[lead + 1] = _LETTER
        space = kind == _SPACE
        odd = self._odd(data, offsets, space)
        key = lower_bytes(data) if self.lower else data
        # pieces begin with their space or line end; runs begin where the kind changes in a piece without other characters
        begins = space.copy()
        begins[offsets[:-1][offsets[:-1] < len(data)]] = True
        piece = np.flatnonzero(begins)
        wholes = np.concatenate([[0], np.cumsum(kind == _WHOLE, dtype=np.int32)])
        whole = wholes[np.append(piece[1:], len(data))] > wholes[piece]
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = (kind[1:] != kind[:-1]) & ~space[:-1] & ~space[1:]
        cut[:-1] &= ~np.repeat(whole, np.diff(np.append(piece, len(data))))
        cut[piece] = True
        if not self.lower:  # a line end is a run of its own
            lines = piece[(data[piece] == 0x0A) & ~whole]
            cut[lines + 1] = True
        cut = cut[:-1]
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        doc = np.searchsorted(offsets, starts, "right") - 1
        use = ~odd[doc]
        starts, ends, doc = starts[use], ends[use], doc[use]
        if self.lower:
            starts = starts + space[starts]
        sizes = ends - starts
        padded = np.concatenate([key, np.zeros(WIDTH + 8, np.uint8)])
        words = key_words(padded, starts, sizes)
        value = np.full(len(starts), -1, np.int32)
        short = sizes <= WIDTH
        if short.all():
            value = self.table.find(words)
        else:
            value[short] = self.table.find([w[short] for w in words])
        new = np.flatnonzero((value < 0) & short)
        if len(new):
            order = new[np.lexsort([w[new] for w in words])]
            first = np.ones(len(order), bool)
            first[1:] = np.any([w[order[1:]] != w[order[:-1]] for w in words], axis=0)
            one = order[first]
            raw = key.tobytes()
            runs = [raw[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist())]
            self.table.add([w[one] for w in words], self._new(runs, (wholes[ends[one]] > wholes[starts[one]]).tolist()))
            value[new] = self.table.find([w[new] for w in words])
        far = np.flatnonzero(~short)
        if len(far):
            spans = [*zip(starts[far].tolist(), ends[far].tolist())]
            runs = [key[a:b].tobytes() for a, b in spans]
            todo = {r: bool(wholes[b] > wholes[a]) for r, (a, b) in zip(runs, spans) if r not in self.table.long}
            if todo:
                self.table.long.update(zip(todo, self.table.values(self._new([*todo], [*todo.values()])).tolist()))
            value[far] = [self.table.long[r] for r in runs]
        ids, sizes = self.table.gather(value)
        counts = np.bincount(doc, sizes, n).astype(np.int64) if len(doc) else np.zeros(n, np.int64)
        if not odd.any():
            return ids, np.concatenate([[0], np.cumsum(counts)])
        at = np.flatnonzero(odd)
        rest = [np.frombuffer(x, "<u4") for x in encode_all(strings(column.take(pa.array(at))), self.cache, self._whole, self.special)]
        counts[at] = [len(x) for x in rest]
        out = np.empty(int(counts.sum()), np.uint32)
        mine = np.repeat(odd, counts)
        out[~mine] = ids
        out[mine] = np.concatenate(rest)
        return out, np.concatenate([[0], np.cumsum(counts)])

    def __call__(self, texts: list[str]) -> list[bytes]:
        ids, at = self.encode(pa.array(texts, pa.large_string()))
        raw = ids.astype("<u4").tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip(at.tolist(), at[1:].tolist())]


_encoders: dict[str, LibraryEncoder] = {}


def library_encoder(path: str) -> LibraryEncoder:
    """This worker process's encoder for a file."""
    if path not in _encoders:
        _encoders[path] = LibraryEncoder(path)
    return _encoders[path]
