"""Quality rules: base counts of a text, and tokeniser fertility held against bands per language or script.

Fertility: each word is encoded on its own with a public vocabulary that falls back to bytes; a
text then has characters per token, tokens per word, the share of byte-fallback tokens, and the
entropy of its tokens in bits (with the Miller-Madow term, so that short texts compare with long
ones). A text whose measures leave the band of its language (of its script, where the
language has none) is rejected.

Words are runs of characters other than space and \\t-\\r. Defined results: null and empty texts have
no words, all counts 0, base_failed and not kept; null languages use the script's band; repeated
rows are judged alone; very long texts are measured whole; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from heronq.llm.common import IS_CONT, IS_SPACE, arrow_map, batch, ngram_hashes, utf8, word_hashes, word_spans
from heronq.llm.wordcache import PieceCache

#: Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
WINDOW = 3
MAX_REPEAT_PERCENT = 50


@dataclass(frozen=True)
class Band:
    """Bounds outside which a text is rejected."""

    chars_per_token: tuple[float, float] = (1.2, 8.0)
    max_byte_share: float = 0.2
    entropy_bits: tuple[float, float] = (4.5, 15.0)
    max_tokens_per_word: float = 6.0

    def holds(self, chars_per_token: float, byte_share: float, entropy_bits: float, tokens_per_word: float) -> bool:
        return (
            self.chars_per_token[0] <= chars_per_token <= self.chars_per_token[1]
            and byte_share <= self.max_byte_share
            and self.entropy_bits[0] <= entropy_bits <= self.entropy_bits[1]
            and tokens_per_word <= self.max_tokens_per_word
        )


#: Wide bands by script, for languages without one of their own.
SCRIPT_BANDS = {
    "latin": Band(),
    "cyrillic": Band((1.0, 6.0), 0.3, max_tokens_per_word=8.0),
    "greek": Band((0.7, 5.0), 0.5, max_tokens_per_word=12.0),
    "han": Band((0.3, 3.0), 0.8, max_tokens_per_word=1e9),
    "other": Band((0.2, 8.0), 1.0, (3.0, 15.0), 1e9),
}

_LETTERS = [("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("han", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF)]


def script_of(text: str) -> str:
    """The script of most letters of the whole text; latin without letters."""
    points, n = np.unique(np.frombuffer(text.encode("utf-32-le", "replace"), "<u4"), return_counts=True)
    letter = np.fromiter((chr(c).isalpha() for c in points.tolist()), bool, len(points))
    points, n = points[letter], n[letter]
    counts: dict[str, int] = {}
    for name, a, b in _LETTERS:
        counts[name] = counts.get(name, 0) + int(n[(points >= a) & (points <= b)].sum())
    counts["other"] = int(n.sum()) - sum(counts.values())
    return max(counts, key=lambda k: counts[k]) if len(points) else "latin"


class Fertility:
    """Token ids of words under a sentencepiece file, through a bounded cache."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.sp.is_byte(i) for i in range(self.sp.get_piece_size())])
        self.cache = PieceCache(lambda words: [np.asarray(x, "<u4").tobytes() for x in self.sp.encode(words, num_threads=1)])

    def measures(self, texts: list[list[str]], chars: list[int]) -> list[tuple[float, float, float, float]]:
        """(characters per token, byte share, entropy in bits, tokens per word) of each list of words."""
        known = self.cache.ensure(set().union(*texts))
        get = known.__getitem__
        out = []
        for words, n_chars in zip(texts, chars):
            ids = np.frombuffer(b"".join(map(get, words)), "<u4")
            n = len(ids)
            if not n:
                out.append((0.0, 0.0, 0.0, 0.0))
                continue
            counts = np.bincount(ids)
            counts = counts[counts > 0]
            share = counts / n
            out.append((n_chars / n, float(self.is_byte[ids].mean()), float(-(share * np.log2(share)).sum() + (len(counts) - 1) / (2 * n * np.log(2))), n / len(words)))
        return out


_fertility: dict[str, Fertility] = {}


def fertility(path: str) -> Fertility:
    if path not in _fertility:
        _fertility[path] = Fertility(path)
    return _fertility[path]


def _totals(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def repeat_words(hashes: np.ndarray, window: int = WINDOW) -> int:
    """Words in windows that occur twice or more."""
    grams = ngram_hashes(hashes, window)
    order = np.sort(grams)
    same = order[1:] == order[:-1]
    if not same.any():
        return 0
    found = np.isin(grams, order[1:][same])
    cover = np.zeros(len(hashes) + 1, np.int64)
    at = np.flatnonzero(found)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def repeat_lines(text: bytes) -> int:
    lines = text.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0
    seen: set[bytes] = set()
    n = 0
    for line in lines:
        if line in seen:
            n += bool(line.split())
        else:
            seen.add(line)
    return n


_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True

_MEASURED = pa.schema(
    [("doc_id", pa.int64())]
    + [(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("base_failed", pa.bool_()), ("kept", pa.bool_()), ("chars_per_token", pa.float64()), ("byte_share", pa.float64()), ("entropy_bits", pa.float64()), ("tokens_per_word", pa.float64())]
)


def quality_rules(docs: DataFrame, vocabulary: str, bands: dict[str, Band] | None = None) -> DataFrame:
    """(doc_id, text, lang) -> counts, base_failed, kept and the four measures; one row a document.

    bands: by language; languages without one take SCRIPT_BANDS.
    """
    by_lang = bands or {}

    def run(batches):
        pieces = fertility(vocabulary)
        for b in batches:
            data, offsets = utf8(b.column(1))
            langs = b.column(2).to_pylist()
            starts, ends, first = word_spans(data, offsets)
            hashes = word_hashes(data, starts, ends)
            n_words = np.diff(first)
            chars = _totals(~IS_CONT[data] & ~IS_SPACE[data], offsets)
            symbols = _totals(_IS_SYMBOL[data], offsets)
            raw = data.tobytes()
            texts = [raw[a:z] for a, z in zip(offsets.tolist(), offsets[1:].tolist())]
            lines = [repeat_lines(t) for t in texts]
            repeats = [repeat_words(hashes[a:z]) if z - a >= WINDOW else 0 for a, z in zip(first.tolist(), first[1:].tolist())]
            words = [[w.decode("utf-8", "replace") for w in t.split()] if not t.isascii() else t.decode().split() for t in texts]
            found = pieces.measures(words, chars.tolist())
            failed = (n_words < MIN_WORDS) | (100 * np.asarray(repeats, np.int64) > MAX_REPEAT_PERCENT * n_words)
            kept = []
            for k, measured in enumerate(found):
                if failed[k]:
                    kept.append(False)
                    continue
                band = by_lang.get(langs[k]) or SCRIPT_BANDS[script_of(texts[k].decode("utf-8", "replace"))]
                kept.append(band.holds(*measured))
            yield batch(_MEASURED, b.column(0).cast(pa.int64()), n_words, chars, symbols, lines, repeats, failed, kept, *[[m[i] for m in found] for i in range(4)])

    ddl = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, chars_per_token double, byte_share double, entropy_bits double, tokens_per_word double"
    return arrow_map(docs.select("doc_id", "text", "lang"), run, ddl)
