"""Substring dedup by level-wise doubling.

A window of `window` words repeats only if the shorter windows in it repeat. Level 1 finds repeated windows
of a quarter of that length; of these only anchors are looked at, the one of least hash in each full
window, so that equal full windows have equal anchors at equal places. Anchors that repeat (see held) are
extended to twice their length, to the right and to the left (every full window holds at least one of the
two around its anchor); the full windows around those that repeat are compared at last. A
level without survivors ends the search. Texts with equal word sequences are folded: all but
the one of smallest doc_id are removed whole.

A word is removed if a window over it has a word sequence that also starts earlier: at a smaller
doc_id, or earlier in the same document. All windows are those of the input. At level 1 a passage in a third of all
texts is one row a chunk of texts; at the others its count is an aggregate with partial sums that is written out before it
is joined, so that the engine can split the join's hot keys.

Defined results: null texts, and texts without words, keep the empty text; texts shorter than the
window keep all their words; kept words are joined by one space; of rows with equal doc_ids neither is
earlier than the other; null doc_ids count as one id after all others; what is found is kept by row, so rows
that share an id, null too, are judged each by its own text; very long texts have all their windows; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronq.llm.common import arrow_map, batch, discard, mix, ngram_hashes, settle, utf8, word_hashes, word_spans
from heronq.llm.held import SENT, SENT_BITS, buckets_for, held_tokens, unshort

LAST = (1 << 63) - 1
#: What names a row.
ROW = ["key", "text_id"]
_A, _B = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def double(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of windows of 2n words from those of n words, at every place where both fit."""
    m = len(h) - n
    return mix(h[:m] * _A + h[n:] * _B) if m > 0 else h[:0]


def anchors(base: np.ndarray, span: int) -> np.ndarray:
    """For each run of span windows the place of the (leftmost) least hash, by its upper bits."""
    if len(base) < span:
        return np.zeros(0, np.int64)
    block, places = 1 << 16, np.uint64((1 << 20) - 1)
    out = np.empty(len(base) - span + 1, np.int64)
    for k in range(0, len(out), block):
        part = base[k : k + block + span - 1]
        least = (part & ~places) | np.arange(len(part), dtype=np.uint64)
        width = 1
        while 2 * width <= span:  # least of 2, 4, 8, ... in a row
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(part) - span + 1], least[span - width :])
        out[k : k + len(least)] = (least & places).astype(np.int64) + k
    return out


class Windows:
    """Windows of a batch of texts: words one after another, and the place of each text's first (one more than texts)."""

    def __init__(self, words: np.ndarray, first: np.ndarray, window: int):
        self.words, self.first, self.window, self.base = words, first, window, max(1, window // 4)
        self.end = np.repeat(first[1:], np.diff(first))  # of each word's text
        self.grams = ngram_hashes(words, self.base)
        self.start = np.flatnonzero(self.end - np.arange(len(words)) >= window)
        every = anchors(self.grams, window - self.base + 1)
        self.at = every[self.start] if len(every) else np.zeros(0, np.int64)
        some = np.zeros(len(words), bool)
        some[self.at] = True
        self.place = np.flatnonzero(some)

    def anchor_hashes(self) -> list[np.ndarray]:
        """Of each text."""
        edge = np.searchsorted(self.place, self.first).tolist()
        hashes = self.grams[self.place]
        return [hashes[a:z] for a, z in zip(edge, edge[1:])]

    def around(self, repeated: np.ndarray) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
        """Of anchors whose sent bits are among those repeated (sorted; the text's number above the bits): place, hash to the right, hash to
        the left (0 where it does not fit in the text); of the windows around them: start, hash, place of the anchor, whether its right
        side fits in the window. Places count from the batch's first word."""
        p, begin = self.place, np.repeat(self.first[:-1], np.diff(self.first))
        text = np.searchsorted(self.first, p, "right") - 1
        p = p[np.isin((text.astype(np.uint64) << np.uint64(SENT_BITS)) | (self.grams[p] & SENT), repeated)]
        half = double(self.grams, self.base)
        right, left = np.zeros(len(p), np.uint64), np.zeros(len(p), np.uint64)
        fits = p + 2 * self.base <= self.end[p]
        right[fits] = half[p[fits]]
        fits = p - self.base >= begin[p]
        left[fits] = half[p[fits] - self.base]
        some = np.zeros(len(self.words), bool)
        some[p] = True
        on = some[self.at]
        start, at = self.start[on], self.at[on]
        whole = double(half, 2 * self.base) if self.window == 4 * self.base else ngram_hashes(self.words, self.window)
        return (p, right, left), (start, whole[start], at, at + 2 * self.base <= start + self.window)


def batch_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a batch, and the place of each text's first."""
    data, offsets = utf8(column)
    starts, ends, first = word_spans(data, offsets)
    return word_hashes(data, starts, ends), first


def each_text(words: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    return [words[a:z] for a, z in zip(first[:-1].tolist(), first[1:].tolist())]


_NAMED = pa.schema([("key", pa.int64()), ("text_id", pa.binary()), ("n_words", pa.int64()), ("name", pa.binary()), ("owner", pa.int64())])
_AROUND = pa.schema(
    [("key", pa.int64()), ("text_id", pa.binary())]
    + [("p", pa.list_(pa.int32())), ("r", pa.list_(pa.int64())), ("l", pa.list_(pa.int64()))]
    + [("start", pa.list_(pa.int32())), ("h", pa.list_(pa.int64())), ("at", pa.list_(pa.int32())), ("to_right", pa.list_(pa.bool_()))]
)
_FULL = pa.schema([("key", pa.int64()), ("text_id", pa.binary()), ("start", pa.list_(pa.int32())), ("h", pa.list_(pa.int64())), ("again", pa.list_(pa.int32()))])
_KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])


def keyed(docs: DataFrame) -> DataFrame:
    """docs with key, the doc_id or LAST, and text_id: empty where the doc_id is the row's alone, else the text's 128-bit name.

    Rows that agree in both have the same id and text, so they get the same result.
    """
    docs = docs.withColumn("key", F.coalesce("doc_id", F.lit(LAST)).cast("long"))
    name = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    shared = settle(docs.where("key <> %d" % LAST).groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key", F.lit(True).alias("shared")), "shared")
    if shared.head(1):
        docs = docs.join(shared, "key", "left")
    else:
        docs = docs.withColumn("shared", F.lit(None).cast("boolean"))
    return docs.withColumn("text_id", F.when((F.col("key") == LAST) | F.col("shared"), name).otherwise(F.lit(b""))).drop("shared")


def text_name(words: np.ndarray) -> bytes:
    return hashlib.blake2b(words.tobytes(), digest_size=16).digest()


def owner_of(name: bytes | None) -> int:
    return int.from_bytes(name[:8], "little", signed=True) if name else 0


def named_texts(docs: DataFrame, window: int) -> DataFrame:
    """keyed docs -> (key, text_id, n_words, name of the word sequence, owner: half of it); short texts have no name."""

    def run(batches):
        for b in batches:
            rows = each_text(*batch_words(b.column(2)))
            names = [text_name(w) if len(w) >= window else None for w in rows]
            yield batch(_NAMED, b.column(0), b.column(1), [len(w) for w in rows], names, [owner_of(x) for x in names])

    return arrow_map(docs.select("key", "text_id", "text"), run, "key long, text_id binary, n_words long, name binary, owner long")


def windows_around(docs: DataFrame, survivors: DataFrame, window: int) -> DataFrame:
    """keyed docs, survivors (key, text_id, tokens: sent bits of anchors) -> what Windows.around says of each, places counted from the text's first word."""

    def run(batches):
        for b in batches:
            words, first = batch_words(b.column(2))
            keys = [unshort(np.frombuffer(t, np.uint8).reshape(-1, SENT_BITS // 8)) | np.uint64(k << SENT_BITS) for k, t in enumerate(b.column(3).to_pylist())]
            columns = []
            for found in Windows(words, first, window).around(np.concatenate(keys)):
                place = found[0]
                edge = np.searchsorted(place, first).astype(np.int32)
                begin = np.repeat(first[:-1], np.diff(edge))
                for v in found:
                    v = v.view(np.int64) if v.dtype == np.uint64 else v if v.dtype == bool else (v - begin).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(edge), pa.array(v)))
            yield batch(_AROUND, b.column(0), b.column(1), *columns)

    rows = docs.select("key", "text_id", "text").join(survivors, ROW)
    ddl = "key long, text_id binary, p array<int>, r array<long>, l array<long>, start array<int>, h array<long>, at array<int>, to_right array<boolean>"
    return arrow_map(rows.select("key", "text_id", "text", "tokens"), run, ddl)


def full_windows(around: DataFrame, survivors: DataFrame) -> DataFrame:
    """windows_around, survivors (key, text_id, right, left: places of anchors) -> (key, text_id, start, h: the first of each distinct window in the text, again: starts of the others)."""

    def run(batches):
        for b in batches:
            out = ([], [], [])
            for start, h, at, to_right, right, left in zip(*(b.column(k) for k in range(2, 8))):
                start, h, at, to_right, right, left = (x.values.to_numpy(zero_copy_only=False) for x in (start, h, at, to_right, right, left))
                on = np.where(to_right, np.isin(at, right), np.isin(at, left))
                start, h = start[on], h[on]
                h, first = np.unique(h, return_index=True)
                again = np.ones(len(start), bool)
                again[first] = False
                for x, v in zip(out, (start[first], h, start[again])):
                    x.append(v)
            yield batch(_FULL, b.column(0), b.column(1), *out)

    rows = around.select(*ROW, "start", "h", "at", "to_right").join(survivors, ROW)
    return arrow_map(rows.select(*ROW, "start", "h", "at", "to_right", "right", "left"), run, "key long, text_id binary, start array<int>, h array<long>, again array<int>")


def keep_rest(docs: DataFrame, marks: DataFrame, window: int, keep_layout: bool = False) -> DataFrame:
    """keyed docs, marks (key, text_id, rep, start, again) -> the texts without the words that marked windows cover, without all if rep is another text.

    The other columns of docs but text come along, after those of the result, under the names c0, c1, ...
    """
    carried = [c for c in docs.columns if c not in ("doc_id", "text", *ROW)]
    fields = [docs.schema[c] for c in carried]

    def run(batches):
        for b in batches:
            sizes, removed, kept = [], [], []
            data, offsets = utf8(b.column(2))
            raw = data.tobytes()
            for k, (key, rep) in enumerate(zip(b.column(0).to_pylist(), b.column(3).to_pylist())):
                words = raw[offsets[k] : offsets[k + 1]].split()
                sizes.append(len(words))
                if rep is not None and rep != key:
                    removed.append(len(words))
                    kept.append("")
                    continue
                marks_ = [np.asarray(x[k].values.to_numpy(zero_copy_only=False), np.int64) for x in (b.column(4), b.column(5)) if x[k].is_valid]
                at = np.concatenate(marks_) if marks_ else np.zeros(0, np.int64)
                if not len(at) and keep_layout:
                    removed.append(0)
                    kept.append(raw[offsets[k] : offsets[k + 1]].decode("utf-8", "replace"))
                    continue
                if len(at):
                    cover = np.zeros(len(words) + 1, np.int64)
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + window, -1)
                    gone = np.cumsum(cover[:-1]) > 0
                    removed.append(int(gone.sum()))
                    words = [words[i] for i in np.flatnonzero(~gone).tolist()]
                else:
                    removed.append(0)
                kept.append(b" ".join(words).decode("utf-8", "replace"))
            made = batch(_KEPT, b.column(1), sizes, removed, kept)
            more = b.columns[6:]
            yield pa.RecordBatch.from_arrays([*made.columns, *more], names=[*_KEPT.names, *(f"c{i}" for i in range(len(more)))])

    rows = docs.select(*ROW, F.col("doc_id").cast("long").alias("id"), "text", *[F.col(c).alias(f"c{i}") for i, c in enumerate(carried)]).join(marks, ROW, "left")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())] + [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)])
    return arrow_map(rows.select("key", "id", "text", "rep", "start", "again", *[f"c{i}" for i in range(len(carried))]), run, schema)


def repeated(rows: DataFrame, column: str) -> DataFrame:
    """Values of a column that stand in two rows or more."""
    return rows.groupBy(column).agg(F.count("*").alias("m")).where("m > 1").select(column)


def substring_dedup(docs: DataFrame, window: int = 20) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_words, n_removed, kept_text), one row a document."""
    docs = keyed(docs.select("doc_id", "text"))
    return keep_rest(docs, find_repeats(docs, window), window)


def without_repeats(docs: DataFrame, window: int = 20) -> DataFrame:
    """docs with repeated passages cut from text; texts without any keep their layout, all other columns stay."""
    names = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = keyed(docs.select("doc_id", "text", *[F.col(c).alias(f"c{i}") for i, c in enumerate(names)]))
    got = keep_rest(rows, find_repeats(rows, window), window, keep_layout=True)
    where = {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": F.col("kept_text")} | {c: F.col(f"c{i}") for i, c in enumerate(names)}
    return got.select(*[where[c].alias(c) for c in docs.columns])


def find_repeats(docs: DataFrame, window: int) -> DataFrame:
    """keyed docs -> (key, text_id, rep, start, again): for texts that repeat, the smallest id of an equal text, and starts of windows that start earlier elsewhere."""
    if window < 2:
        raise ValueError("a window has two words at least")
    made = settle(named_texts(docs, window), "named")
    named = made.where("name is not null")
    classes = settle(named.groupBy("name").agg(F.min("key").alias("rep")), "classes")
    whole = settle(named.select(*ROW, "name").join(classes, "name").select(*ROW, "rep").groupBy(*ROW).agg(F.min("rep").alias("rep")).where("key <> rep"), "whole")
    mine = named.join(classes.select("name", F.col("rep").alias("key")), ["name", "key"], "left_semi")

    # level 1: anchors that repeat
    def tokens_of(texts: pa.Array):
        words, first = batch_words(texts)
        hashes = Windows(words, first, window).anchor_hashes()
        return ((owner_of(text_name(w)), h) for w, h in zip(each_text(words, first), hashes) if len(w) >= window)

    words = made.agg(F.sum("n_words")).first()[0] or 0
    anchored = held_tokens(docs.select("text"), tokens_of, buckets_for(docs, words // max(1, window // 8)))
    survivors = settle(mine.select(*ROW, "owner").join(anchored, "owner").select(*ROW, "tokens").dropDuplicates(ROW), "level1")
    around = settle(windows_around(docs, survivors, window), "around")
    for done in (made, classes, survivors):
        discard(done)
    # level 2: anchors doubled to either side
    rows = around.select(*ROW, F.explode(F.arrays_zip("p", "r", "l")).alias("x")).select(*ROW, "x.p", "x.r", "x.l")
    sides = rows.select(*ROW, "p", F.explode(F.array(F.struct(F.lit(True).alias("right"), F.col("r").alias("h")), F.struct(F.lit(False).alias("right"), F.col("l").alias("h")))).alias("x")).select(*ROW, "p", "x.right", "x.h").where("h <> 0")
    sides = sides.join(settle(repeated(sides.select("h"), "h"), "halves"), "h")
    place = lambda right: F.sort_array(F.collect_list(F.when(F.col("right") == right, F.col("p"))))
    survivors = settle(sides.groupBy(*ROW).agg(place(True).alias("right"), place(False).alias("left")), "level2")
    # level 3: whole windows
    full = settle(full_windows(around, survivors), "full")
    discard(around)
    discard(survivors)
    each = full.select(*ROW, F.explode(F.arrays_zip("start", "h")).alias("x")).select(*ROW, "x.start", "x.h")
    earliest = settle(each.groupBy("h").agg(F.min("key").alias("e"), F.count("*").alias("m")).where("m > 1").select("h", "e"), "earliest")
    late = each.join(earliest, "h").where("key > e")  # a row's own repeats are in again
    starts = late.groupBy(*ROW).agg(F.collect_list("start").alias("start"))
    again = full.where(F.size("again") > 0).groupBy(*ROW).agg(F.flatten(F.collect_list("again")).alias("again"))
    marks = whole.join(starts, ROW, "full").join(again, ROW, "full")
    marks = settle(marks.select(*ROW, "rep", "start", "again"), "marks")
    discard(full)
    discard(whole)
    return marks
