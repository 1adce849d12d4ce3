"""Token-ID output: whole texts encoded and written as patched frame-of-reference shards in ascending doc_id order.

encode_to_files() range-partitions the documents by doc_id (and by a hash of the text, so that rows of one doc_id, or of
none, can be dealt to several shards), each task sorts its range and streams it into one shard (see pfor) in the
shared folder; a manifest table lists the shards of the attempts that counted. read_files() reads shards back by their block index. Only the manifest (one
row a shard) is summed in order to place a shard among the others.

Defined results: null and empty texts give the end id alone; null doc_ids come first; equal doc_ids keep one entry a row,
next to each other in the order of that hash; a very long text is encoded alone and written block by block; other columns are ignored; an empty table gives an empty manifest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronq.llm import pfor, storage
from heronq.llm.common import arrow_map, batch, settle, shared_dir
from heronq.llm.wordcache import library_encoder

#: Documents that a range partition aims at; a shard's open block index and documents stay small.
SHARD_ROWS = 8_000

_MANIFEST = pa.schema([("path", pa.string()), ("first_id", pa.int64()), ("first_tie", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())])
_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def encode_to_files(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None, percentile: float = pfor.PERCENTILE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """documents (doc_id, text) -> manifest (path, first_id, first_tie, n_docs, n_ids, n_bytes), one row a shard."""
    spark = docs.sparkSession
    folder = folder or shared_dir(spark) + "/ids"
    shards = max(1, -(-docs.count() // shard_rows))

    def write(batches):
        encode = library_encoder(tokenizer)
        writer = stream = None
        for b in batches:
            tokens, at = encode.encode(b.column(1))
            tokens = np.insert(tokens, at[1:], end_id)
            at = at + np.arange(len(at))
            if writer is None and b.num_rows:
                path, first, tie = storage.attempt_path(folder, "shard", ".pfor"), b.column(0)[0].as_py(), b.column(2)[0].as_py()
                stream = storage.open_out(path)
                writer = pfor.Writer(stream, percentile)
            for doc, start, stop in zip(b.column(0).to_pylist(), at.tolist(), at[1:].tolist()):
                writer.add(doc, tokens[start:stop])
        if writer is not None:
            n_bytes = writer.close()
            stream.close()
            yield batch(_MANIFEST, [path], [first], [tie], [len(writer.ids)], [writer.total], [n_bytes])

    order = [F.asc_nulls_first("doc_id"), F.asc("tie")]
    ranged = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tie")).repartitionByRange(shards, *order).sortWithinPartitions(*order)
    return settle(arrow_map(ranged, write, "path string, first_id long, first_tie long, n_docs long, n_ids long, n_bytes long"), "manifest")


def read_files(manifest: DataFrame) -> DataFrame:
    """manifest -> (doc_id, start, n_tokens, ids_crc32), every value from the files."""
    order = Window.orderBy(F.asc_nulls_first("first_id"), "first_tie", "path").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.select("path", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("base"))

    def read(batches):
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with storage.open_in(path) as f:
                    rows = []
                    for doc, start, n, crc in pfor.Reader(f).documents():
                        rows.append((doc, base + start, n, crc))
                        if len(rows) >= 4096:
                            yield batch(_READ, *zip(*rows))
                            rows = []
                    if rows:
                        yield batch(_READ, *zip(*rows))

    shards = placed.repartition(max(1, manifest.count()), "path")
    return arrow_map(shards, read, "doc_id long, start long, n_tokens long, ids_crc32 long")
