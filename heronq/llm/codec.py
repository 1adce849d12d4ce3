"""Tables of texts to token ids and back, by the segment-tree encoder of bpe.

encode(): (doc_id, text) -> (doc_id, ids binary, little-endian unsigned 32-bit). decode(): back to
text, replacing bytes that are not UTF-8. Null and empty texts have no ids and decode to the empty
text; repeated rows stay; other columns are ignored; empty tables stay empty.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from heronq.llm.bpe import segment_tree_bpe
from heronq.llm.common import arrow_map, batch, strings

_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
_TEXT = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])


def encode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    def run(batches):
        codec = segment_tree_bpe(vocabulary, pattern)
        for b in batches:
            yield batch(_IDS, b.column(0).cast(pa.int64()), codec.encode(strings(b.column(1))))

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, ids binary")


def decode(tokens: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    def run(batches):
        codec = segment_tree_bpe(vocabulary, pattern)
        for b in batches:
            yield batch(_TEXT, b.column(0), [codec.decode(x or b"") for x in b.column(1).to_pylist()])

    return arrow_map(tokens.select("doc_id", "ids"), run, "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, text) -> (doc_id, ids, decoded): the ids of each row and what they decode to."""
    schema = pa.schema([*_IDS, ("decoded", pa.string())])

    def run(batches):
        codec = segment_tree_bpe(vocabulary, pattern)
        for b in batches:
            ids = codec.encode(strings(b.column(1)))
            yield batch(schema, b.column(0).cast(pa.int64()), ids, [codec.decode(x) for x in ids])

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, ids binary, decoded string")
