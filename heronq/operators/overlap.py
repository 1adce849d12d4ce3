"""Overlap of a corpus with benchmark items: their runs of n words, searched for in all documents.

The items' runs are an index: a table of (run, item) and a Bloom filter of the runs. The filter goes to the documents as one
value of checked size and leaves few of their runs, which alone become rows; an exact semi-join with the index decides. An index
beyond the filter's size bound is joined without one. A hot run costs the documents that hold it one row a place, and the
aggregates that follow have partial sums; no pairs of documents and items are made.

Words are compared with A-Z in lower case. Defined results: null and empty texts have no runs; an item shorter than n words has
none either and a null share; repeated rows, equal and null ids count as rows of their own; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronq.functions.text import lower_ascii, run_hashes, run_text, words
from heronq.sources.scratch import settled

#: Bits of the filter for each run, and its greatest size; an index that needs more goes without a filter.
FILTER_BITS, MAX_FILTER_BYTES = 32, 1 << 20


def split_runs(texts: DataFrame, keys: list[str], n: int) -> DataFrame:
    """keys, words, runs: the hash of the run at each position."""
    if n < 2:  # with one reference to the hashes the optimiser would move them into the loop over positions
        raise ValueError("runs have two words or more")
    known = texts.select(*keys, words(lower_ascii(F.col("text"))).alias("words"))
    known = known.select(*keys, "words", F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    return known.select(*keys, "words", run_hashes(F.col("words"), F.col("hashes"), n).alias("runs"))


def run_index(items: DataFrame, n: int) -> DataFrame:
    """(item_row, item_id, run, hash): the distinct runs of each item; an item without runs has one row without a run."""
    numbered = settled(items.select("item_id", "text").withColumn("item_row", F.monotonically_increasing_id()), "items")
    runs = split_runs(numbered, ["item_row", "item_id"], n)
    texts = F.transform("runs", lambda h, i: F.struct(run_text(F.col("words"), i, n).alias("run"), h.alias("hash")))
    return settled(runs.select("item_row", "item_id", F.inline_outer(texts)).distinct(), "runs")


def places(hash_: Column, mask: int) -> list[Column]:
    """The two bits that a hash sets in a filter of mask + 1 bits."""
    return [hash_.bitwiseAND(F.lit(mask).cast("long")), F.shiftrightunsigned(hash_, 32).bitwiseAND(F.lit(mask).cast("long"))]


def bloom_filter(hashes: DataFrame, max_bytes: int) -> tuple[DataFrame, int] | None:
    """A table of one row, the filter's 64-bit words, and its mask; None if it would be larger than max_bytes."""
    runs = hashes.select("hash").distinct()
    bits = max(64, 1 << (runs.count() * FILTER_BITS - 1).bit_length())
    if bits // 8 > max_bytes:
        return None
    one = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(F.lit(63).cast("long")).cast("int"))
    at = runs.select(F.explode(F.array(*places(F.col("hash"), bits - 1))).alias("p"))
    at = at.select(F.shiftrightunsigned("p", 6).alias("word"), one(F.col("p")).alias("bit"))
    empty = hashes.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bit"))
    dense = at.unionByName(empty).groupBy("word").agg(F.bit_or("bit").alias("bit"))
    whole = dense.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bit"))), lambda s: s["bit"]).alias("bits"))
    return settled(whole, "filter"), bits - 1


def may_hold(bits: Column, hash_: Column, mask: int) -> Column:
    """Whether a filter has both bits of a hash."""
    bit = lambda p: F.call_function("shiftrightunsigned", F.get(bits, F.shiftrightunsigned(p, 6).cast("int")), p.bitwiseAND(F.lit(63).cast("long")).cast("int"))
    first, second = (bit(p).bitwiseAND(F.lit(1).cast("long")) == 1 for p in places(hash_, mask))
    return first & second


def found_runs(docs: DataFrame, index: DataFrame, n: int, max_bytes: int) -> DataFrame:
    """(doc_row, doc_id, n_runs, run): the documents' runs that pass the filter, a row a place; a document without any has one row."""
    numbered = docs.select("doc_id", "text").withColumn("doc_row", F.monotonically_increasing_id())
    runs = split_runs(numbered, ["doc_row", "doc_id"], n)
    sieve = bloom_filter(index.where("run is not null"), max_bytes)
    every = F.when(F.size("runs") > 0, F.sequence(F.lit(0), F.size("runs") - 1)).otherwise(F.array().cast("array<int>"))
    if sieve is None:
        kept = runs.select("doc_row", "doc_id", "words", F.size("runs").alias("n_runs"), every.alias("places"))
    else:
        bits, mask = sieve
        held = runs.select("*", bits.scalar().alias("bits"))
        kept = held.select("doc_row", "doc_id", "words", F.size("runs").alias("n_runs"), F.filter(every, lambda i: may_hold(F.col("bits"), F.get("runs", i), mask)).alias("places"))
    # texts are made before rows are, or each row would carry all words
    texts = F.transform("places", lambda i: run_text(F.col("words"), i, n))
    return kept.select("doc_row", "doc_id", F.col("n_runs").cast("long").alias("n_runs"), F.explode_outer(texts).alias("run"))


def overlap_of_documents(docs: DataFrame, items: DataFrame, n: int = 8, max_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """(doc_id, n_runs, n_hits, hit_share): of each document, its runs and how many of them some item has."""
    index = run_index(items, n)
    known = index.where("run is not null").select("run").distinct().withColumn("hit", F.lit(1))
    # a document without runs keeps a row, under a key that no run has and no other row
    found = found_runs(docs, index, n, max_bytes).withColumn("run", F.coalesce("run", F.concat(F.lit(" "), "doc_row")))
    found = found.join(known, "run", "left")
    sums = found.groupBy("doc_row").agg(F.first("doc_id").alias("doc_id"), F.first("n_runs").alias("n_runs"), F.count("hit").alias("n_hits"))
    return sums.select("doc_id", "n_runs", "n_hits", F.when(F.col("n_runs") > 0, F.col("n_hits") / F.col("n_runs")).alias("hit_share"))


def coverage_of_items(docs: DataFrame, items: DataFrame, n: int = 8, max_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """(item_id, n_runs, n_found, covered_share): of each item, its distinct runs and how many of them some document has."""
    index = run_index(items, n)
    found = found_runs(docs, index, n, max_bytes).where("run is not null").select("run").distinct().withColumn("hit", F.lit(1))
    sums = index.join(found, "run", "left").groupBy("item_row").agg(F.first("item_id").alias("item_id"), F.count("run").alias("n_runs"), F.count("hit").alias("n_found"))
    return sums.select("item_id", "n_runs", "n_found", F.when(F.col("n_runs") > 0, F.col("n_found") / F.col("n_runs")).alias("covered_share"))
