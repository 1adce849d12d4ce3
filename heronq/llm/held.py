"""Which tokens of an owner (a set of shingles, a text) stand elsewhere too, counted over all owners.

Chunks of texts send each of their tokens once, with its owner, to the task of its hash bucket; a token that
stands several times in a chunk goes without owner, as its owners already know that it is repeated. So a token of a third of
all texts is one row a chunk, and a bucket's size is bounded by the number of buckets. Copies of an owner
in other chunks count as the same owner. Only SENT_BITS of a token are sent: what looks equal there is taken for
repeated, so an answer can name a token too many, never one too few. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from heronq.llm.common import arrow_map, batch

#: Tokens of a chunk of texts counted together, and of a hash bucket on average.
CHUNK_TOKENS, BUCKET_TOKENS = 1 << 20, 1 << 21
#: Bits of a token that are sent to its bucket.
SENT_BITS = 40
SENT = np.uint64((1 << SENT_BITS) - 1)
#: Stands for the owners of a token that stands several times in a chunk.
SEVERAL = -(1 << 63)

_POSTINGS = pa.schema([("bucket", pa.int32()), ("known", pa.bool_()), ("owners", pa.binary()), ("runs", pa.binary()), ("tokens", pa.binary())])
_POSTINGS_DDL = "bucket int, known boolean, owners binary, runs binary, tokens binary"


def buckets_for(df: DataFrame, tokens: int) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-tokens // BUCKET_TOKENS))


def short(tokens: np.ndarray) -> np.ndarray:
    """The bytes of each token that are sent, a row each."""
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : SENT_BITS // 8])


def unshort(raw: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, : SENT_BITS // 8] = raw
    return wide.view("<u8")[:, 0]


def chunk_postings(tokens: list[np.ndarray], owners: list[int], buckets: int, counts: bool) -> pa.RecordBatch:
    """Rows (bucket, known, owners, tokens of each, tokens) of a chunk of different owners; tokens may stand in an owner twice.

    One more row, marked known, has what the chunk alone knows to be repeated: for each owner its tokens or, for counts,
    how many places they stand at.
    """
    token = np.concatenate(tokens)
    owner = np.repeat(np.arange(len(tokens)), [len(g) for g in tokens])
    number = np.asarray([*owners, SEVERAL], "<i8")
    order = np.argsort(token)
    token, owner = token[order], owner[order]
    head = np.concatenate([[True], token[1:] != token[:-1]]) if len(token) else np.zeros(0, bool)
    runs = np.diff(np.append(np.flatnonzero(head), len(token)))
    several = np.repeat(runs > 1, runs)
    mine = np.argsort(owner[several], kind="stable")
    known = token[several][mine]
    local = np.bincount(owner[several], minlength=len(tokens))
    some = np.flatnonzero(local)
    rows = [[owners[0] % buckets], [True], [number[some].tobytes()], [local[some].astype("<u4").tobytes()], [b"" if counts else short(known).tobytes()]]
    once = head & several
    token = np.concatenate([token[~several], token[once]])
    owner = np.concatenate([owner[~several], np.full(int(once.sum()), len(tokens))])
    if len(token):
        place = ((token >> np.uint64(SENT_BITS)) % np.uint64(buckets)).astype(np.int64) * (len(tokens) + 1) + owner
        order = np.argsort(place)
        token, place = token[order], place[order]
        heads = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        runs = np.diff(np.append(heads, len(place))).astype("<u4")
        whose, bucket = number[place[heads] % (len(tokens) + 1)], place[heads] // (len(tokens) + 1)
        raw = short(token)
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        edge, at = [*first.tolist(), len(heads)], [*heads[first].tolist(), len(token)]
        rows[0] += bucket[first].tolist()
        rows[1] += [False] * len(first)
        rows[2] += [whose[a:z].tobytes() for a, z in zip(edge, edge[1:])]
        rows[3] += [runs[a:z].tobytes() for a, z in zip(edge, edge[1:])]
        rows[4] += [raw[a:z].tobytes() for a, z in zip(at, at[1:])]
    return batch(_POSTINGS, *rows)


def postings(texts: DataFrame, tokens_of: Callable[[pa.Array], Iterator[tuple[int, np.ndarray]]], buckets: int, counts: bool) -> DataFrame:
    """texts (one column) -> chunk_postings; tokens_of a batch gives (owner, tokens) of each text, an owner always with the same tokens."""

    def run(batches):
        held: dict[int, np.ndarray] = {}
        total = 0
        for b in batches:
            for owner, tokens in tokens_of(b.column(0)):
                if len(tokens) and owner not in held:
                    held[owner] = tokens
                    total += len(tokens)
                if total >= CHUNK_TOKENS:
                    yield chunk_postings([*held.values()], [*held], buckets, counts)
                    held, total = {}, 0
        if held:
            yield chunk_postings([*held.values()], [*held], buckets, counts)

    return arrow_map(texts, run, _POSTINGS_DDL)


_PARTS = pa.schema([("part", pa.int32()), ("owners", pa.binary()), ("runs", pa.binary()), ("tokens", pa.binary())])
_PARTS_DDL = "part int, owners binary, runs binary, tokens binary"
_COUNTS = pa.schema([("owner", pa.int64()), ("c", pa.int64())])
_LISTS = pa.schema([("owner", pa.int64()), ("tokens", pa.binary())])


def _unpacked(owners: bytes, runs: bytes, tokens: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(owners, "<i8"), np.frombuffer(runs, "<u4").astype(np.int64), np.frombuffer(tokens, np.uint8).reshape(-1, SENT_BITS // 8)


def repeated_in(table: pa.Table, counts: bool, parts: int) -> pa.Table:
    """The rows of a bucket -> of each owner its tokens that stand elsewhere too, or their count, packed by parts of the owners."""
    owner, token = [np.zeros(0, np.int64)], [np.zeros((0, SENT_BITS // 8), np.uint8)]
    out = []
    for known, *row in zip(*(table[c].to_pylist() for c in ("known", "owners", "runs", "tokens"))):
        o, r, t = _unpacked(*row)
        if known:
            out.append((o, r, t))
        else:
            owner.append(np.repeat(o, r))
            token.append(t)
    owner, token = np.concatenate(owner), unshort(np.concatenate(token))
    if len(token):
        order = np.argsort(token)
        token, owner = token[order], owner[order]
        heads = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        size = np.diff(np.append(heads, len(token)))
        other = (owner != np.repeat(owner[heads], size)) | (owner == SEVERAL)
        found = np.flatnonzero(np.repeat(np.logical_or.reduceat(other, heads), size) & (owner != SEVERAL))
        found = found[np.argsort(owner[found], kind="stable")]
        who, n = np.unique(owner[found], return_counts=True)
        out.append((who, n, short(token[found][: 0 if counts else None])))
    rows = []
    if out:
        owner, n, token = (np.concatenate(x) for x in zip(*out))
        part = owner % parts
        order = np.argsort(part, kind="stable")
        part, owner = part[order], owner[order]
        if not counts:
            token = token[np.argsort(np.repeat(np.argsort(order, kind="stable"), n), kind="stable")]
        n = n[order]
        edge = np.flatnonzero(np.concatenate([part[1:] != part[:-1], [True]])) + 1 if len(part) else []
        ends = np.concatenate([[0], np.cumsum(n)])
        for a, z in zip([0, *edge], edge):
            rows.append((int(part[a]), owner[a:z].astype("<i8").tobytes(), n[a:z].astype("<u4").tobytes(), b"" if counts else token[ends[a] : ends[z]].tobytes()))
    return pa.Table.from_batches([batch(_PARTS, *(zip(*rows) if rows else [[]] * 4))])


def gathered(table: pa.Table, counts: bool) -> pa.Table:
    """The rows of a part, from all buckets -> one row an owner."""
    rows = [_unpacked(*row) for row in zip(*(table[c].to_pylist() for c in ("owners", "runs", "tokens")))]
    owner, n, token = (np.concatenate(x) for x in zip(*rows))
    who, at = np.unique(owner, return_inverse=True)
    total = np.bincount(at, n, len(who)).astype(np.int64)
    if counts:
        return pa.Table.from_batches([batch(_COUNTS, who, total)])
    raw = token[np.argsort(np.repeat(at, n), kind="stable")].tobytes()
    ends = (np.cumsum(total) * (SENT_BITS // 8)).tolist()
    return pa.Table.from_batches([batch(_LISTS, who, [raw[a:z] for a, z in zip([0, *ends], ends)])])


def _held(texts: DataFrame, tokens_of, buckets: int, counts: bool, ddl: str) -> DataFrame:
    # owners meet in fewer parts than there are buckets: a part has a row of each bucket at most
    parts = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets // 16)
    rows = postings(texts, tokens_of, buckets, counts).groupBy("bucket").applyInArrow(lambda t: repeated_in(t, counts, parts), _PARTS_DDL)
    return rows.groupBy("part").applyInArrow(lambda t: gathered(t, counts), ddl)


def held_counts(texts: DataFrame, tokens_of, buckets: int) -> DataFrame:
    """(owner, c): how many of its tokens stand elsewhere, or more."""
    return _held(texts, tokens_of, buckets, True, "owner long, c long")


def held_tokens(texts: DataFrame, tokens_of, buckets: int) -> DataFrame:
    """(owner, tokens: SENT_BITS of each one after another): its tokens that stand elsewhere or twice in it, and perhaps some more."""
    return _held(texts, tokens_of, buckets, False, "owner long, tokens binary")
