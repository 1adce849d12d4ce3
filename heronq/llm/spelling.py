"""Spelling variant grouping: Levenshtein automata of distance one against broadcast shards of a compact trie.

The words that occur often enough are dealt by ranges into shards; a shard is a trie in flat arrays (nodes numbered level by
level, so a node's children stand together), built where its words are. Shards are broadcast, as many at a time as fit
BROADCAST_BYTES, to tasks that each hold a range of words. A task walks every shard with the automata of its words: while no error
is used a word is at one node, from which each step first follows all branches that use the error (a letter put in, left
out or replaced) down to their ends, then goes on along the word. Branches are taken so that no neighbour is reached twice: a
letter is put in behind, or left out at the end of, a run of the same letter. Neighbours are reduced to their number and the best
form within the task, and across shards by an aggregate. Forms are followed to their roots by doubling: a form is at least
twice as frequent as its word, so chains are short.

Defined results: null and empty texts have no words; a null id is hashed as an empty decimal; equal ids and repeated rows
count each; texts and words may be of any length (a word longer than a shard is a shard of its own); columns other than id
and text are ignored; ties go to the smallest word in code-point order; no rows give no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronq.llm.common import arrow_map, bounded, settle, strings

#: Code points of words in a shard (more only for a single word), bytes of shards broadcast at once.
SHARD_CHARS, BROADCAST_BYTES = 3_000_000, 64 << 20
#: Words of a task, and of those walked at once.
TASK_WORDS, WALK_WORDS = 16_384, 4096
#: Distinct words counted in a task's memory before they are handed on.
COUNT_WORDS = 400_000

# the letters of a word in UTF-8: A-Z and a-z, and U+00C0 to U+00FF as 0xC3 and a byte; all other characters part words
_FOREIGN = re.compile(rb"[\xc2\xc4-\xf4][\x80-\xbf]+")
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 0x80 <= b < 0xC0 or b == 0xC3 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Maximal runs of letters, A-Z in lower case."""
    raw = text.encode()
    if not raw.isascii():
        raw = _FOREIGN.sub(b" ", raw)
    return raw.translate(_LETTERS).split()


def word_counts(docs: DataFrame, slips: int, least_chars: int, least_count: int) -> DataFrame:
    """(word, n) of the words kept. A run whose crc32 with its document's id is divisible by `slips` loses one code point."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def emit(total):
        words, counts = pa.array(list(total), pa.binary()).cast(pa.string()), pa.array(total.values(), pa.int64())
        yield pa.RecordBatch.from_arrays([words, counts], schema=schema)

    def run(batches):
        total: dict[bytes, int] = {}
        crc, get = zlib.crc32, total.get
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), strings(b.column(1))):
                head = crc(b"%d:" % doc_id if doc_id is not None else b":")
                for word, n in Counter(words_of(text)).items():
                    if len(word) < least_chars:  # fewer bytes, so fewer code points
                        continue
                    h = crc(word, head)
                    if h % slips == 0:
                        s = word.decode()
                        at = h % len(s)
                        word = (s[:at] + s[at + 1 :]).encode()
                    total[word] = get(word, 0) + n
                if len(total) >= COUNT_WORDS:
                    yield from emit(total)
                    total.clear()
        yield from emit(total)

    counts = arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "word string, n long")
    counts = counts.where(F.char_length("word") >= least_chars)
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points one after another, and where each word begins (one more than words)."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    return flat, np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)


class Trie:
    """Sorted distinct words as flat arrays: of each node its letter, its first child and the word that ends there or -1."""

    def __init__(self, words: list[str], counts: np.ndarray):
        self.words, self.n = words, counts
        flat, start = code_points(words)
        length = np.diff(start)
        # letters that each word shares with the one before
        shared, same = np.zeros(len(words), np.int64), np.arange(1, len(words))
        while len(same):
            d = shared[same]
            same = same[(length[same] > d) & (length[same - 1] > d)]
            same = same[flat[start[same] + shared[same]] == flat[start[same - 1] + shared[same]]]
            shared[same] += 1
        # nodes in order of words: word i adds those of depth shared + 1 to its length
        added = length - shared
        owner = np.repeat(np.arange(len(words)), added)
        depth = np.arange(len(owner)) - np.repeat(np.cumsum(added) - added, added) + shared[owner] + 1
        order = np.argsort(depth, kind="stable")
        level = np.searchsorted(depth[order], np.arange(1, depth.max(initial=0) + 2))
        parent = np.zeros(len(order) + 1, np.int64)
        for d in range(1, len(level) - 1):  # the parent is the last node one level higher that came before
            up, here = order[level[d - 1] : level[d]], order[level[d] : level[d + 1]]
            parent[level[d] + 1 : level[d + 1] + 1] = level[d - 1] + np.searchsorted(up, here)
        self.letter = np.concatenate([[0], flat[start[owner] + depth - 1][order]]).astype(np.uint32)
        self.first = np.searchsorted(parent[1:], np.arange(len(parent) + 1)).astype(np.int32) + 1
        ends = np.concatenate([[-1], np.where(depth == length[owner], owner, -1)[order]])
        self.ends = ends.astype(np.int32)
        self.index()

    def index(self) -> None:
        parent = np.repeat(np.arange(len(self.letter), dtype=np.int64), np.diff(self.first))
        self.keys = parent << 21 | self.letter[1:].astype(np.int64)

    def child(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The child of each node by each letter, or 0, the root, which is nobody's child."""
        key = node << 21 | letter
        at = np.searchsorted(self.keys, key)
        hit = self.keys[np.minimum(at, len(self.keys) - 1)] == key if len(self.keys) else np.zeros(len(at), bool)
        return np.where(hit, at + 1, 0)

    def pack(self) -> bytes:
        table = pa.table({"word": pa.array(self.words, pa.string()), "n": pa.array(self.n, pa.int64())})
        nodes = pa.table({"letter": self.letter, "first": self.first[:-1], "ends": self.ends})
        out = pa.BufferOutputStream()
        for t in (table, nodes):
            with pa.ipc.new_stream(out, t.schema) as w:
                w.write_table(t)
        return out.getvalue().to_pybytes()

    @staticmethod
    def unpack(raw: bytes) -> Trie:
        source, trie = pa.BufferReader(raw), Trie.__new__(Trie)
        table, nodes = (pa.ipc.open_stream(source).read_all() for _ in range(2))
        trie.words, trie.n = table["word"].combine_chunks(), table["n"].to_numpy()
        trie.letter, trie.ends = nodes["letter"].to_numpy(), nodes["ends"].to_numpy()
        trie.first = np.append(nodes["first"].to_numpy(), np.int32(len(trie.letter)))
        trie.index()
        return trie

    def neighbours(self, flat: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place of a word given, place of a word of the trie) at a distance of exactly one, each once."""
        length = np.diff(start)
        flat = np.append(flat, 0).astype(np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        word, node, p = np.arange(len(length)), np.zeros(len(length), np.int64), 0
        while len(word):
            more = length[word] > p
            letter = np.where(more, flat[start[word] + p * more], -1)
            # branches that put a letter in before p, or in place of p
            first = self.first[node]
            kids = self.first[node + 1] - first
            at = np.repeat(np.arange(len(word)), kids)
            child = first[at] + np.arange(len(at)) - np.repeat(np.cumsum(kids) - kids, kids)
            new = self.letter[child] != letter[at]
            at, child = at[new], child[new]
            replaced = more[at]
            # and that leave out p, the last of its run
            last = length[word] == p + 1
            out = more & (last | (flat[np.minimum(start[word] + p + 1, len(flat) - 1)] != letter))
            w = np.concatenate([word[at], word[at[replaced]], word[out]])
            x = np.concatenate([child, child[replaced], node[out]])
            pos = np.concatenate([np.full(len(at), p), np.full(int(replaced.sum()) + int(out.sum()), p + 1)])
            while len(w):
                done = pos == length[w]
                if done.any():
                    end = self.ends[x[done]]
                    found.append((w[done][end >= 0], end[end >= 0]))
                    w, x, pos = w[~done], x[~done], pos[~done]
                x = self.child(x, flat[start[w] + pos])
                on = x > 0
                w, x, pos = w[on], x[on], pos[on] + 1
            word, node, letter = word[more], node[more], letter[more]
            node = self.child(node, letter)
            word, node = word[node > 0], node[node > 0]
            p += 1
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def build_shards(words: DataFrame, chars: int, shard_chars: int) -> DataFrame:
    """(shard, size, trie): one row a shard of at most so many code points, or of one word; ranges of words."""
    schema = pa.schema([("size", pa.int64()), ("trie", pa.binary())])
    shards = max(1, -(-chars // shard_chars))

    def pack(held):
        t = pa.concat_tables(held).sort_by("word")
        raw = Trie(t["word"].to_pylist(), t["n"].to_numpy()).pack()
        return pa.RecordBatch.from_arrays([pa.array([len(raw)]), pa.array([raw], pa.binary())], schema=schema)

    def run(batches):
        held, size = [], 0
        for b in batches:
            for piece in bounded([b], shard_chars):
                more = len("".join(piece.column(0).to_pylist()))
                if held and size + more > shard_chars:
                    yield pack(held)
                    held, size = [], 0
                held.append(pa.Table.from_batches([piece]))
                size += more
        if held:
            yield pack(held)

    dealt = words.repartitionByRange(shards, "word").sortWithinPartitions("word").coalesce(shards)
    return settle(arrow_map(dealt, run, "size long, trie binary").select(F.monotonically_increasing_id().alias("shard"), "size", "trie"), "shards")


_NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form", pa.string()), ("form_n", pa.int64())])


def walk(batches, tries: list[Trie]):
    """Of each word near to another of these shards: how many there are and the best."""
    for b in batches:
        for k in range(0, b.num_rows, WALK_WORDS):
            words = b.column(0).slice(k, WALK_WORDS)
            flat, start = code_points(words.to_pylist())
            for trie in tries:
                w, v = trie.neighbours(flat, start)
                order = np.lexsort((v, -trie.n[v], w))
                w, v = w[order], v[order]
                head = np.flatnonzero(np.diff(w, prepend=-1))
                near = np.diff(np.append(head, len(w)))
                yield pa.RecordBatch.from_arrays([words.take(pa.array(w[head])), pa.array(near, pa.int64()), trie.words.take(pa.array(v[head])), pa.array(trie.n[v[head]], pa.int64())], schema=_NEAR)


def near_words(words: DataFrame, shard_chars: int, broadcast_bytes: int) -> DataFrame:
    """(word, n) -> (word, n_near, form, form_n) of the words that have a neighbour; form is the most frequent one."""
    spark = words.sparkSession
    total = words.agg(F.count("*"), F.sum(F.char_length("word"))).head()
    shards = build_shards(words, total[1] or 0, shard_chars)
    groups: list[list[int]] = []
    room = 0
    for r in shards.select("shard", "size").orderBy("shard").collect():
        if not groups or r["size"] > room:
            groups.append([])
            room = broadcast_bytes
        groups[-1].append(r["shard"])
        room -= r["size"]
    parts = []
    for group in groups:
        sent = spark.sparkContext.broadcast([bytes(r["trie"]) for r in shards.where(F.col("shard").isin(group)).select("trie").collect()])
        run = lambda batches, sent=sent: walk(batches, [Trie.unpack(x) for x in sent.value])
        tasks = words.select("word").repartitionByRange(-(-total[0] // TASK_WORDS), "word").sortWithinPartitions("word")
        parts.append(settle(arrow_map(tasks, run, "word string, n_near long, form string, form_n long"), "near"))
        sent.destroy()
    if not parts:
        return spark.createDataFrame([], "word string, n_near long, form string, form_n long")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    # the greatest count first, then the smallest word
    best = F.min_by(F.struct("form", "form_n"), F.struct(-F.col("form_n"), F.col("form")))
    return every.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", "b.form", "b.form_n")


def follow(forms: DataFrame) -> DataFrame:
    """(word, form) without cycles -> (word, root): the last form that each word leads to."""
    now = settle(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        nxt = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = settle(now.join(nxt, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = new.select("word", "root")
        if not new.where("moved").head(1):
            return now


def spelling_variants(docs: DataFrame, slips: int = 97, least_chars: int = 5, least_count: int = 3, times: int = 2, shard_chars: int = SHARD_CHARS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, text) -> (word, form, root, n, n_near, form_n), one row a word that occurs often enough.

    A word's form is its most frequent neighbour if that is at least `times` (2 or more) as frequent, else null.
    """
    words = settle(word_counts(docs, slips, least_chars, least_count), "words")
    near = words.join(near_words(words, shard_chars, broadcast_bytes), "word", "left")
    better = F.col("form_n") >= times * F.col("n")
    known = near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(better, F.col("form")).alias("form"), F.when(better, F.col("form_n")).alias("form_n"))
    known = settle(known, "forms")
    roots = follow(known.where("form is not null"))
    got = known.join(roots, "word", "left")
    return got.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
