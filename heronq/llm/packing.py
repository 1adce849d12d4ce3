"""Mixture-controlled packing: deficit round-robin over source queues into windows of fixed length.

Every source is a queue of its documents' tokens, cut into slots of SLOT tokens. In each round a
queue's deficit grows by its credit (its target share of a window's tokens) and the queue sends
slots while the deficit covers one; what is left is carried to the next round, and an emptied
queue drops out. Windows are the consecutive spans of `window` tokens of the resulting stream.

The deficit of queue s after r rounds is r * credit(s) - sent(s, r) * slot, with
sent(s, r) = min(slots(s), r * credit(s) div slot). So the place of any slot follows from
arithmetic on the queues' totals alone: deficits carry across windows and across partitions
without a task waiting for another. Every source has a queue of its own, however many there are:
totals of up to MAX_QUEUES queues go to the driver and the tasks; of more, the slots become a table
sorted by round and queue, whose running sums are the same places.

Defined results: null and empty texts are the end id alone; null sources are the queue "";
null doc_ids are carried along; repeated rows are packed again; a very long text is encoded alone and cut like others; other columns are ignored; an empty table gives no pieces. Only the
last window can be short.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronq.llm.common import arrow_map, batch, settle
from heronq.llm.wordcache import library_encoder

WINDOW = 2048
#: Tokens that a queue sends at once; divides the window. A window departs from the target mixture by a few of these at most.
SLOT = 32
#: Queues whose totals are held in memory at most; slots of more are placed by a table.
MAX_QUEUES = 64
#: Credits are counted in parts of a token, so many that a source of few tokens keeps its share.
SCALE = 1 << 20
#: Slots made at once of a queue's row.
SLOTS_AT_ONCE = 1 << 12


class Schedule:
    """Places of slots and tokens under deficit round-robin with credits by target share."""

    def __init__(self, totals: list[int], shares: list[float], window: int = WINDOW, slot: int = SLOT, whole: float | None = None):
        self.window, self.slot = window, slot
        self.totals = np.asarray(totals, np.int64)
        self.slots = -(-self.totals // slot)
        whole = (sum(shares) if whole is None else whole) or 1.0
        self.credit = np.asarray([max(1, round(x / whole * window * SCALE)) for x in shares], np.int64)
        self.cost = slot * SCALE
        self.rounds = -(-self.slots * self.cost // self.credit)  # after so many, a queue is empty
        last = np.maximum(self.slots - 1, 0)
        rank = self.rank(np.arange(len(totals)), last)
        some = self.totals > 0
        order = np.argsort(rank[some])
        self.short_rank = rank[some][order]  # each queue's last slot may be short
        self.short = np.concatenate([[0], np.cumsum((self.slots * slot - self.totals)[some][order])])

    def sent(self, queue: int, rounds: np.ndarray) -> np.ndarray:
        """Slots that a queue has sent after so many rounds."""
        return np.minimum(self.slots[queue], np.minimum(rounds, self.rounds[queue]) * self.credit[queue] // self.cost)

    def deficit(self, queue: int, rounds: np.ndarray) -> np.ndarray:
        """Parts of a token that a queue has to its credit after so many rounds; 0 once it is empty."""
        done = np.minimum(rounds, self.rounds[queue])
        left = done * self.credit[queue] - self.sent(queue, rounds) * self.cost
        return np.where(rounds >= self.rounds[queue], 0, left)

    def rank(self, queue: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """The place of each slot among all."""
        r = -(-(slot + 1) * self.cost // self.credit[queue]) - 1
        out = slot.copy()
        for t in range(len(self.totals)):
            before, after = self.sent(t, r), self.sent(t, r + 1)
            out += np.where(t < queue, after, np.where(t > queue, before, 0))
        return out

    def place(self, queue: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """The place of each slot's first token in the stream."""
        rank = self.rank(queue, slot)
        return rank * self.slot - self.short[np.searchsorted(self.short_rank, rank, "left")]

    def pieces(self, queue: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Documents by queue, place in it and length -> (document, start in it, length, place in the stream) of each piece."""
        doc, slot = slots_of(start, length, self.slot)
        return cut_slots(doc, slot, self.place(queue[doc], slot), start, length, self.window, self.slot)


def slots_of(start: np.ndarray, length: np.ndarray, slot: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, slot) of each slot that a document has tokens in."""
    first, last = start // slot, (start + length - 1) // slot
    count = np.where(length > 0, last - first + 1, 0)
    doc = np.repeat(np.arange(len(start)), count)
    return doc, np.repeat(first, count) + np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)


def cut_slots(doc: np.ndarray, slots: np.ndarray, place: np.ndarray, start: np.ndarray, length: np.ndarray, window: int, slot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """slots_of documents and the place of each slot's first token -> Schedule.pieces."""
    a = np.maximum(start[doc], slots * slot)
    b = np.minimum(start[doc] + length[doc], (slots + 1) * slot)
    at = place + a - slots * slot
    a = a - start[doc]
    b = b - start[doc]
    # cut where a window ends
    edge = (at // window + 1) * window
    over = np.flatnonzero(at + (b - a) > edge)
    cut = edge[over] - at[over]
    doc = np.concatenate([doc, doc[over]])
    at2, a2, b2 = edge[over], a[over] + cut, b[over].copy()
    b[over] = a2
    a, b, at = np.concatenate([a, a2]), np.concatenate([b, b2]), np.concatenate([at, at2])
    order = np.lexsort((a, doc))
    doc, a, b, at = doc[order], a[order], b[order], at[order]
    # join what is adjacent in document, stream and window
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + (b - a)[:-1]) | (at[1:] % window == 0)
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(doc)) - 1 if len(doc) else heads
    return doc[heads], a[heads], b[tails] - a[heads], at[heads]


_TOKENS = pa.schema([("doc_id", pa.int64()), ("queue", pa.string()), ("part", pa.int64()), ("local_start", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
_PIECES = pa.schema([("doc_id", pa.int64()), ("queue", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
_PIECES_DDL = "doc_id long, queue string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_SLOTS = pa.schema([("queue", pa.string()), ("slot", pa.int64()), ("part", pa.int64()), ("local", pa.int64()), ("size", pa.int64())])


def _queues(docs: DataFrame) -> DataFrame:
    """doc_id, text, queue: the source."""
    return docs.select("doc_id", "text", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("queue"))


def tokenise(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(doc_id, text, source) -> settled (doc_id, queue, part, local_start, n, ids): ids as u16 where they fit, and each
    document's place among those of its queue in its part of the input."""

    def run(batches):
        encode, at, part = library_encoder(tokenizer), {}, TaskContext.get().partitionId()
        kind = "<u2" if max(len(encode.ends) - 1, end_id) < 1 << 16 else "<u4"
        for b in batches:
            tokens, ends = encode.encode(b.column(1))
            tokens, ends = np.insert(tokens, ends[1:], end_id).astype(kind), ends + np.arange(len(ends))
            sizes = np.diff(ends).tolist()
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(ends * tokens.itemsize), pa.py_buffer(tokens)]).cast(pa.binary())
            queues, starts = b.column(2).to_pylist(), []
            for q, n in zip(queues, sizes):
                starts.append(at.get(q, 0))
                at[q] = starts[-1] + n
            yield batch(_TOKENS, b.column(0).cast(pa.int64()), queues, [part] * len(sizes), starts, sizes, raw)

    return settle(arrow_map(_queues(docs), run, "doc_id long, queue string, part long, local_start long, n long, ids binary"), "tokens")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, targets: dict[str, float] | None = None, window: int = WINDOW, slot: int = SLOT, max_queues: int = MAX_QUEUES) -> DataFrame:
    """(doc_id, text, source) -> pieces (doc_id, queue, start, length, ids u32 binary, doc_tokens, sequence_id, offset).

    targets: share of each source in a window; sources not named have what the named leave, in proportion to their
    tokens (without targets their share of all tokens). Where the named leave nothing, the others come when those are empty.
    """
    tokens = tokenise(docs, tokenizer, end_id)
    parts = tokens.groupBy("queue", "part").agg(F.sum("n").alias("n_part"))
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # written out, so that the engine knows its size: it is broadcast only if it is small, and then the tokens stay where they are
    bases = settle(parts.select("queue", "part", F.coalesce(F.sum("n_part").over(earlier), F.lit(0)).alias("base")), "bases")
    placed = tokens.join(bases, ["queue", "part"]).select("doc_id", "queue", (F.col("local_start") + F.col("base")).alias("at"), "n", "ids")
    totals = parts.groupBy("queue").agg(F.sum("n_part").alias("n"))
    few = totals.limit(max_queues + 1).collect()
    if len(few) > max_queues:
        return _placed_by_table(placed, settle(totals, "totals"), targets or {}, window, slot)
    few = sorted((r.queue, r.n) for r in few)
    names, sizes = [q for q, _ in few], [n for _, n in few]
    shares = _shares(dict(few), targets or {})

    def run(batches):
        schedule, number = Schedule(sizes, [shares(q, n) for q, n in few], window, slot, shares.whole), {q: i for i, q in enumerate(names)}
        for b in batches:
            queue = np.asarray([number[q] for q in b.column(1).to_pylist()], np.int64)
            yield _pieces(b, *schedule.pieces(queue, *(b.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))), window)

    return arrow_map(placed, run, _PIECES_DDL)


class _shares:
    """Shares of a window: a target where there is one; the other sources have what targets leave, in proportion to their tokens.

    named: totals of the sources, of those with a target at least; every: tokens of all sources.
    """

    def __init__(self, named: dict[str, int], targets: dict[str, float], every: int | None = None):
        self.given = {q: float(targets[q]) for q in named if q in targets}
        self.others = (sum(named.values()) if every is None else every) - sum(named[q] for q in self.given)
        total = math.fsum(self.given.values())
        self.rest = max(0.0, 1.0 - total) if self.others else 0.0
        self.whole = (total + self.rest) or 1.0

    def __call__(self, queue: str, n: int) -> float:
        return self.given[queue] if queue in self.given else n / self.others * self.rest if self.others else 0.0


def _pieces(b: pa.RecordBatch, doc: np.ndarray, a: np.ndarray, size: np.ndarray, at: np.ndarray, window: int) -> pa.RecordBatch:
    """Rows (doc_id, queue, at, n, ids, ...) and what cut_slots says of them -> pieces."""
    lengths, out = b.column(3).to_numpy(zero_copy_only=False), []
    wide = [np.frombuffer(x, f"<u{len(x) // k}").astype("<u4").tobytes() if k else b"" for x, k in zip(b.column(4).to_pylist(), lengths.tolist())]
    for d, s, m in zip(doc.tolist(), a.tolist(), size.tolist()):
        out.append(wide[d][4 * s : 4 * (s + m)])
    pick = pa.array(doc)
    return batch(_PIECES, b.column(0).take(pick), b.column(1).take(pick), a, size, out, lengths[doc], at // window, at % window)


def slot_places(totals: DataFrame, targets: dict[str, float], window: int, slot: int) -> DataFrame:
    """totals (queue, n) -> settled (queue, slot, place) of every slot: Schedule.place as a table, for any number of queues."""
    every = totals.agg(F.sum("n")).head()[0]
    named = {r.queue: r.n for r in totals.where(F.col("queue").isin(*targets)).collect()} if targets else {}
    shares = _shares(named, targets, every)
    share = F.col("n") / F.lit(float(shares.others or 1)) * F.lit(shares.rest)
    if named:
        given = F.create_map(*[F.lit(x) for q in named for x in (q, shares.given[q])])
        share = F.coalesce(F.try_element_at(given, F.col("queue")), share)
    credit = F.rint(share / F.lit(shares.whole) * F.lit(window) * F.lit(SCALE)).cast("long")
    cost = slot * SCALE
    rows = totals.select("queue", "n", F.greatest(F.lit(1), credit).alias("credit"), F.ceil(F.col("n") / slot).alias("slots"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.expr(f"(slots - 1) div {SLOTS_AT_ONCE}"))).alias("block")).repartition("queue", "block")
    rows = rows.select("*", F.explode(F.sequence(F.col("block") * SLOTS_AT_ONCE, F.least("slots", (F.col("block") + 1) * SLOTS_AT_ONCE) - 1)).alias("slot"))
    rows = rows.select(F.expr(f"((slot + 1) * {cost}L + credit - 1) div credit").alias("round"), "queue", "slot", F.least(F.lit(slot), F.col("n") - F.col("slot") * slot).alias("size"))
    order = ["round", "queue", "slot"]

    def run(batches):
        at, part = 0, TaskContext.get().partitionId()
        for b in batches:
            size = b.column(2).to_numpy(zero_copy_only=False)
            local = at + np.cumsum(size) - size
            at += int(size.sum())
            yield batch(_SLOTS, b.column(0), b.column(1), [part] * len(size), local, size)

    local = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("queue", "slot", "size")
    local = settle(arrow_map(local, run, "queue string, slot long, part long, local long, size long"), "slots")
    sums = local.groupBy("part").agg(F.sum("size").alias("n"))
    base = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return local.join(base, "part").select("queue", "slot", (F.col("local") + F.col("base")).alias("place"))


def _placed_by_table(placed: DataFrame, totals: DataFrame, targets: dict[str, float], window: int, slot: int) -> DataFrame:
    """placed (doc_id, queue, at, n, ids) -> pieces. Every document has a token, so (queue, at) names it."""
    touched = placed.select("queue", "at", F.explode(F.sequence(F.expr(f"at div {slot}"), F.expr(f"(at + n - 1) div {slot}"))).alias("slot"))
    touched = touched.join(slot_places(totals, targets, window, slot), ["queue", "slot"])
    places = touched.groupBy("queue", "at").agg(F.sort_array(F.collect_list(F.struct("slot", "place"))).getField("place").alias("places"))

    def run(batches):
        for b in batches:
            start, length = (b.column(k).to_numpy(zero_copy_only=False) for k in (2, 3))
            place = b.column(5).flatten().to_numpy(zero_copy_only=False)
            yield _pieces(b, *cut_slots(*slots_of(start, length, slot), place, start, length, window, slot), window)

    return arrow_map(placed.join(places, ["queue", "at"]).select("doc_id", "queue", "at", "n", "ids", "places"), run, _PIECES_DDL)


def sequences(pieces: DataFrame, pad_id: int = 0, window: int = WINDOW) -> DataFrame:
    """pieces -> (sequence_id, used, ids): each window's ids in order, padded to the window unless their count is a power of two."""
    rows = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("x"))
    ids = F.expr("aggregate(x, X'', (a, y) -> concat(a, y.ids))")
    used = (F.octet_length("ids") / 4).cast("int")
    whole = (used == window) | (F.bit_count(used) == 1)
    pad = F.unhex(F.repeat(F.lit(int(pad_id).to_bytes(4, "little").hex()), F.lit(window) - F.col("used")))
    return rows.select("sequence_id", ids.alias("ids")).select("sequence_id", used.alias("used"), "ids", whole.alias("whole")).select("sequence_id", "used", F.when(F.col("whole"), F.col("ids")).otherwise(F.concat("ids", pad)).alias("ids"))


def simulate(totals: list[int], credits: list[int], slot_cost: int, slot: int) -> list[tuple[int, int]]:
    """The same schedule by keeping every deficit round by round: (queue, slot) in order. For small tables and tests."""
    left = [-(-n // slot) for n in totals]
    sent, deficit, out = [0] * len(totals), [0] * len(totals), []
    while any(s < n for s, n in zip(sent, left)):
        for q in range(len(totals)):
            if sent[q] == left[q]:
                continue
            deficit[q] += credits[q]
            while deficit[q] >= slot_cost and sent[q] < left[q]:
                out.append((q, sent[q]))
                sent[q] += 1
                deficit[q] -= slot_cost
    return out

