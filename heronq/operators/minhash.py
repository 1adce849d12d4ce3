"""Near-duplicate documents by min-wise hashing and banding, made exact by a prefix join of what banding left apart.

A document's set is that of the hashes of its runs of words. Equal sets are one class, known by 64 of the 128 bits of its name. Sets are
made anew from the texts in each pass, as that costs less than to keep them. Most classes have no partner: two similar sets
share tokens in their prefixes under any order, so a class of whose prefix in order of hash too little stands in any other class is
out (see held_heads), and no set of it is ever a row.

A class' signature is the least value of its set under each of rows * bands hash functions; classes that agree in all rows of a
band are candidates, and the intersection of both sets decides. Classes with similarity s meet with probability
1 - (1 - s^rows)^bands: 0.992 at 0.8 with 16 bands of 6 rows.

A band's group is never spread into all its pairs at first: in each round a class outside the largest component of a group
meets one member of that component (the hub), and the links found make components anew. When the pairs across components
that are left are few, or a round links nothing, all of them are compared, so no candidate is dropped.

Banding misses a link by chance now and then. So pairs across the components it made are searched once more, exactly: similar sets
share most of all their tokens, so a class is out as soon as too few of its tokens stand in another component (see apart). Those
left meet, again by hubs, in groups by the tokens of prefixes that put rare tokens first.

Defined results: words are compared with A-Z in lower case; a text with fewer words than a run has them all as its one
run; null and empty texts and those without words have empty sets and link with nothing; rows with equal ids are rows of
their own; a null id never names a class or component unless all its ids are null; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heronq.functions.shingles import bounded, mix, run_sets, small_batches
from heronq.operators.graph import components
from heronq.operators.overlap import bloom_filter, may_hold
from heronq.sources.scratch import settled

#: Rounds of hubs at most, and pairs across components a class at which the rest is compared at once.
HUB_ROUNDS, FEW_PAIRS = 3, 4
#: Greatest size of the filter of rows whose sets are compared.
MAX_FILTER_BYTES = 8 << 20
#: Tokens that a bucket has on average.
BUCKET_TOKENS = 1 << 21
#: Tokens whose least values are found at once, and bits of a set's sketch.
SIGNED_TOKENS, SKETCH_BITS = 1 << 15, 2048


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_NAMED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("x", pa.int64()), ("y", pa.int64())])
_SETS = pa.schema([*_NAMED, ("members", pa.list_(pa.int64()))])


def _named(b: pa.RecordBatch, n: int) -> tuple[list[np.ndarray], list]:
    """Of a batch (doc_id, text) the sets, and columns doc_id, n, and x and y: 128 bits that name a set, null for an empty one."""
    sets = run_sets(b.column(1), n)
    names = [np.frombuffer(hashlib.blake2b(g.tobytes(), digest_size=16).digest(), "<i8").tolist() if len(g) else (None, None) for g in sets]
    return sets, [b.column(0).cast(pa.int64()), [len(g) for g in sets], [x for x, _ in names], [y for _, y in names]]


def set_names(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n, x, y): size and name of the set of each document."""

    def run(batches):
        for b in bounded(batches):
            yield _batch(_NAMED, *_named(b, n)[1])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, x long, y long")


def shingle_sets(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n, x, y, members): the same with the distinct hashes of runs of n words, sorted as unsigned numbers."""

    def run(batches):
        for b in bounded(batches):
            sets, columns = _named(b, n)
            yield _batch(_SETS, *columns, [g.view(np.int64) for g in sets])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, x long, y long, members array<long>")


def least_values(sets: list[np.ndarray], count: int) -> np.ndarray:
    """The least value of each set, none of them empty, under each of count functions of 32 bits: a row a function."""
    out = np.empty((count, len(sets)), np.uint64)
    ends = np.cumsum([len(g) for g in sets])
    seeds = mix(np.arange(1, count + 1, dtype=np.uint64))
    i = 0
    while i < len(sets):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + SIGNED_TOKENS, "right")))
        tokens = np.concatenate(sets[i:j])
        first = np.concatenate([[0], np.cumsum([len(g) for g in sets[i : j - 1]])]).astype(np.int64)
        for k in range(0, count, 2):  # each 64-bit hash gives two functions
            h = (tokens ^ seeds[k]) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
            out[k, i:j] = np.minimum.reduceat(h >> np.uint64(32), first)
            if k + 1 < count:
                h ^= h >> np.uint64(29)
                out[k + 1, i:j] = np.minimum.reduceat(h & np.uint64(0xFFFFFFFF), first)
        i = j
    return out


def signatures(sets: DataFrame, bands: int, rows: int) -> DataFrame:
    """The columns of sets but members, and keys: a hash of the rows of each band; null for empty sets."""
    others = [c for c in sets.columns if c != "members"]

    def run(batches):
        for b in bounded(batches):
            members = b.column(len(others))
            some = [k for k, v in enumerate(members) if v.is_valid and len(v.values)]
            least = least_values([members[k].values.to_numpy().view(np.uint64) for k in some], bands * rows) if some else None
            keys: list = [None] * b.num_rows
            if some:
                band = np.zeros((bands, len(some)), np.uint64)
                for r in range(rows):
                    band = mix(band + least[r::rows] + np.uint64(r + 1))
                for k, own in zip(some, band.T.view(np.int64).tolist()):
                    keys[k] = own
            columns = [b.column(k) for k in range(len(others))] + [pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=[*others, "keys"])

    kinds = dict(sets.dtypes)
    return sets.select(*others, "members").mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in others], "keys array<long>"]))


_POSTINGS = pa.schema([("bucket", pa.int32()), ("owners", pa.binary()), ("homes", pa.binary()), ("sizes", pa.binary()), ("runs", pa.binary()), ("tokens", pa.binary())])
_POSTINGS_DDL = "bucket int, owners binary, homes binary, sizes binary, runs binary, tokens binary"
_PARTS = pa.schema([("part", pa.int32()), ("owners", pa.binary()), ("sizes", pa.binary()), ("runs", pa.binary()), ("tokens", pa.binary()), ("often", pa.binary())])
_PARTS_DDL = "part int, owners binary, sizes binary, runs binary, tokens binary, often binary"
_COUNTS = pa.schema([("rep", pa.int64()), ("held", pa.int64())])
_PREFIXES = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("keys", pa.list_(pa.int64()))])


def _cuts(key: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin, with the end."""
    return np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]]) if len(key) else np.zeros(1, np.int64)


def _column(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(table[name].to_pylist()), kind)


def postings(owners: list[int], homes: list[int], sizes: list[int], tokens: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """Classes, their components, the sizes of their sets and some of their tokens -> a row for each bucket of tokens."""
    if not owners:
        return _batch(_POSTINGS, *[[]] * len(_POSTINGS))
    at, token = np.repeat(np.arange(len(owners)), [len(g) for g in tokens]), np.concatenate(tokens)
    bucket = (token % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((at, bucket))
    at, token, bucket = at[order], token[order].astype("<u8"), bucket[order]
    owner, home, size = np.array(owners, "<i8"), np.array(homes, "<i8"), np.array(sizes, "<u4")
    rows, ends = [], _cuts(bucket)
    for a, z in zip(ends[:-1], ends[1:]):
        cuts = _cuts(at[a:z])
        who = at[a:z][cuts[:-1]]
        rows.append((int(bucket[a]), owner[who].tobytes(), home[who].tobytes(), size[who].tobytes(), np.diff(cuts).astype("<u4").tobytes(), token[a:z].tobytes()))
    return _batch(_POSTINGS, *(zip(*rows) if rows else [[]] * len(_POSTINGS)))


def shared_tokens(table: pa.Table, parts: int, counts: bool) -> pa.Table:
    """The rows of a bucket -> of each class the tokens that another component has too and how many classes have them, packed by parts of
    the classes; or only how many these tokens are."""
    runs = _column(table, "runs", "<u4")
    owner, home, size = (np.repeat(_column(table, c, kind), runs) for c, kind in (("owners", "<i8"), ("homes", "<i8"), ("sizes", "<u4")))
    token = _column(table, "tokens", "<u8")
    order = np.lexsort((owner, token))
    token, owner, home, size = token[order], owner[order], home[order], size[order]
    # copies in other batches sent the same tokens again
    new = np.concatenate([[True], (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])]) if len(token) else np.zeros(0, bool)
    token, owner, home, size = token[new], owner[new], home[new], size[new]
    rows = []
    if len(token):
        ends = _cuts(token)
        often = np.diff(ends)
        live = np.repeat(np.minimum.reduceat(home, ends[:-1]) < np.maximum.reduceat(home, ends[:-1]), often)
        token, owner, size, often = token[live], owner[live], size[live], np.repeat(often, often)[live]
        part = owner % parts
        order = np.lexsort((owner, part))
        token, owner, size, often, part = token[order], owner[order], size[order], often[order], part[order]
        ends = _cuts(part)
        for a, z in zip(ends[:-1], ends[1:]):
            cuts = _cuts(owner[a:z])
            first = cuts[:-1] + a
            sent = (b"", b"") if counts else (token[a:z].astype("<u8").tobytes(), often[a:z].astype("<u4").tobytes())
            rows.append((int(part[a]), owner[first].astype("<i8").tobytes(), size[first].astype("<u4").tobytes(), np.diff(cuts).astype("<u4").tobytes(), *sent))
    return pa.Table.from_batches([_batch(_PARTS, *(zip(*rows) if rows else [[]] * len(_PARTS)))])


def summed(table: pa.Table) -> pa.Table:
    """The rows of a part, from all buckets -> (rep, held: its tokens that others have)."""
    who, at = np.unique(_column(table, "owners", "<i8"), return_inverse=True)
    return pa.Table.from_batches([_batch(_COUNTS, who, np.bincount(at, _column(table, "runs", "<u4"), len(who)).astype(np.int64))])


def prefixes(table: pa.Table, percent: int) -> pa.Table:
    """The rows of a part, from all buckets -> (rep, n, keys: the tokens of its prefix that other components have), of the classes of
    whose n tokens enough are elsewhere. Rare tokens first; those that no other component has stand before them and take their places."""
    runs = _column(table, "runs", "<u4")
    owner, size = np.repeat(_column(table, "owners", "<i8"), runs), np.repeat(_column(table, "sizes", "<u4"), runs).astype(np.int64)
    token, often = _column(table, "tokens", "<u8"), _column(table, "often", "<u4")
    order = np.lexsort((token, often, owner))
    owner, size, token = owner[order], size[order], token[order]
    out, ends = [], _cuts(owner)
    for a, z in zip(ends[:-1].tolist(), ends[1:].tolist()):
        n = int(size[a])
        least = (percent * n + 99) // 100
        if z - a >= least:
            out.append((int(owner[a]), n, token[a : a + n - least + 1 - (n - (z - a))].view(np.int64)))
    return pa.Table.from_batches([_batch(_PREFIXES, *(zip(*out) if out else [[]] * 3))])


def dealt_out(spark: SparkSession, tokens: int) -> tuple[int, int]:
    """Buckets for so many tokens, and parts of classes: fewer, as a part has a row of each bucket at most."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(least, -(-tokens // BUCKET_TOKENS))
    return buckets, max(least, buckets // 16)


def held_heads(docs: DataFrame, n: int, percent: int, tokens: int) -> DataFrame:
    """(rep, held): how many tokens of a class' prefix in order of hash stand in such a prefix of another class. tokens: those of all documents.

    If two sets share c tokens, their prefixes of n - c + k share k. With k a fifth of n, a set shares the k of the smallest
    possible partner.
    """
    buckets, parts = dealt_out(docs.sparkSession, tokens * (120 - percent) // 100)

    def run(batches):
        for b in bounded(batches):
            sets, columns = _named(b, n)
            heads = {x: (len(g), g[: len(g) - (percent * len(g) + 99) // 100 + max(1, len(g) // 5)]) for g, x in zip(sets, columns[2]) if x is not None}
            yield postings([*heads], [*heads], [size for size, _ in heads.values()], [g for _, g in heads.values()], buckets)

    sent = docs.select("doc_id", "text").mapInArrow(run, _POSTINGS_DDL)
    met = sent.groupBy("bucket").applyInArrow(lambda t: shared_tokens(t, parts, True), _PARTS_DDL)
    return met.groupBy("part").applyInArrow(summed, "rep long, held long")


def sets_left(docs: DataFrame, left: DataFrame, n: int) -> DataFrame:
    """(rep, n, members) of the classes left (rep, class_id), made from the texts again. A filter of checked size keeps other texts out."""
    sieve = bloom_filter(left.select(F.xxhash64("class_id").alias("hash")), MAX_FILTER_BYTES)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if sieve is not None:
        texts = texts.where(may_hold(sieve[0].scalar(), F.xxhash64("doc_id"), sieve[1]))
    # rows that share an id can have other sets, so the name decides
    sets = shingle_sets(texts, n).select(F.col("x").alias("rep"), "n", "members")
    return sets.join(left.select("rep"), "rep", "left_semi").dropDuplicates(["rep"])


def sketches(sets: DataFrame) -> DataFrame:
    """(rep, n, sketch): of each of SKETCH_BITS hash buckets, whether the set has an odd number of tokens in it."""
    schema = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary())])

    def run(batches):
        for b in bounded(batches):
            bits = [np.bincount((mix(v.values.to_numpy().view(np.uint64)) % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1 for v in b.column(2)]
            yield _batch(schema, b.column(0), b.column(1), [np.packbits(x.astype(np.uint8)).tobytes() for x in bits])

    return sets.select("rep", "n", "members").mapInArrow(run, "rep long, n long, sketch binary")


def may_be_similar(pairs: DataFrame, drawn: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sketches don't rule it out: each bit in which two of them differ is a token at least that only one set has."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for b in bounded(batches):
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), "<u8").reshape(b.num_rows, -1) for k in (3, 5))
            differ = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
            total = b.column(2).to_numpy() + b.column(4).to_numpy()
            keep = pa.array(np.flatnonzero(differ * (100 + percent) <= total * (100 - percent)), pa.int64())
            yield _batch(schema, b.column(0).take(keep), b.column(1).take(keep))

    for x in "ab":
        pairs = pairs.join(drawn.select(F.col("rep").alias(x), F.col("n").alias("n" + x), F.col("sketch").alias("s" + x)), x)
    return pairs.select("a", "b", "na", "sa", "nb", "sb").mapInArrow(run, "a long, b long")


def similar(pairs: DataFrame, held: DataFrame, drawn: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar enough: by their sketches first, then by their intersection."""
    pairs = settled(may_be_similar(pairs, drawn, percent), "pairs")
    with_a = pairs.join(held.select(F.col("rep").alias("a"), F.col("members").alias("of_a")), "a")
    both = with_a.join(held.select(F.col("rep").alias("b"), F.col("members").alias("of_b")), "b")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    sized = both.select("a", "b", shared.cast("long").alias("shared"), (F.size("of_a") + F.size("of_b")).cast("long").alias("total"))
    return sized.where(F.col("shared") * 100 >= (F.col("total") - F.col("shared")) * percent).select("a", "b")


def hubs(members: DataFrame, turn: int) -> DataFrame:
    """One member of each group, another one each turn."""
    first = members.groupBy("band", "key").agg(F.min_by(F.struct("rep", "n", "component"), F.xxhash64("rep", F.lit(turn))).alias("h"))
    return settled(first.select("band", "key", "h.*"), "hubs")


def of_rows(sets: DataFrame, rows: DataFrame) -> DataFrame:
    """(rep, members) of the sets named in rows. A filter of checked size keeps the others out of the join's shuffle."""
    sieve = bloom_filter(rows.select(F.xxhash64("rep").alias("hash")), MAX_FILTER_BYTES)
    few = sets.select("rep", "members")
    if sieve is not None:
        few = few.where(may_hold(sieve[0].scalar(), F.xxhash64("rep"), sieve[1]))
    return few.join(rows, "rep", "left_semi")


def needed(percent: int, n: Column | None = None) -> Column:
    """Tokens that a set of n shares with any similar one at least."""
    return F.ceil((F.col("n") if n is None else n) * F.lit(percent) / F.lit(100.0)).cast("int")


def fifth(n: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(n / 5).cast("int"))


def apart(sets: DataFrame, classes: DataFrame, tokens: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """sets (rep, n, members) with so many tokens, classes (rep, component) -> groups (band: -1, key, rep, n) in which each similar pair of
    two components meets, and the sets of their classes."""
    buckets, parts = dealt_out(sets.sparkSession, tokens)

    def run(batches):
        for b in bounded(batches):
            rep, home, size = (b.column(k).to_pylist() for k in range(3))
            yield postings(rep, home, size, [v.values.to_numpy().view(np.uint64) for v in b.column(3)], buckets)

    sent = sets.join(classes, "rep").select("rep", "component", "n", "members").mapInArrow(run, _POSTINGS_DDL)
    met = sent.groupBy("bucket").applyInArrow(lambda t: shared_tokens(t, parts, False), _PARTS_DDL)
    first = settled(met.groupBy("part").applyInArrow(lambda t: prefixes(t, percent), "rep long, n long, keys array<long>"), "prefixes")
    groups = first.select(F.lit(-1).alias("band"), F.explode("keys").alias("key"), "rep", "n")
    return settled(groups, "groups"), settled(of_rows(sets, first.select("rep")), "held")


def with_components(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """rows with the component of each rep; roots (rep, root) has those of the classes that link."""
    if roots is None:
        return rows.withColumn("component", F.col("rep"))
    return rows.join(roots, "rep", "left").withColumn("component", F.coalesce("root", "rep")).drop("root")


def joined(roots: DataFrame | None, found: DataFrame) -> DataFrame:
    """(rep, root): roots after more links (a, b) were found. Only the components that they join are searched."""
    if roots is None:
        return settled(components(found), "components").toDF("rep", "root")
    for x in "ab":
        found = found.join(roots.select(F.col("rep").alias(x), F.col("root").alias("r" + x)), x, "left").withColumn(x, F.coalesce("r" + x, x)).drop("r" + x)
    merged = settled(components(found), "merged").toDF("node", "least")
    old = roots.join(merged.withColumnRenamed("node", "root"), "root", "left").select("rep", F.coalesce("least", "root").alias("root"))
    new = merged.join(roots.select(F.col("rep").alias("node")), "node", "left_anti").select(F.col("node").alias("rep"), F.col("least").alias("root"))
    return settled(old.unionByName(new), "components")


def linked(shared: DataFrame, held: DataFrame, drawn: DataFrame, roots: DataFrame | None, total: int, percent: int, rounds: int) -> DataFrame | None:
    """roots after the links found among the members of groups (band, key, rep, n), as far as they join components."""
    close = lambda x, y: (F.col(x) * 100 >= F.col(y) * percent) & (F.col(y) * 100 >= F.col(x) * percent)
    more = True
    for turn in range(rounds + 1):
        now = with_components(shared, roots)
        # of each group all that is open are pairs of members outside its largest component with others
        per = now.groupBy("band", "key", "component").agg(F.count("*").alias("m"))
        left = per.groupBy("band", "key").agg(F.max_by("component", F.struct("m", "component")).alias("main"), F.max("m").alias("most"), F.sum("m").alias("m")).where("m > most")
        left = settled(left, "left")
        todo = left.agg(F.sum((F.col("m") - F.col("most")).cast("double") * F.col("m"))).head()[0] or 0
        if not todo:
            break
        now = settled(now.join(left.select("band", "key", "main"), ["band", "key"]), "now")
        outside = now.where("component <> main")
        whole = turn == rounds or todo <= FEW_PAIRS * max(total, 1000) or not more
        if not whole:  # each class outside meets the hub of one of its groups, another group and hub each turn
            outside = outside.groupBy("rep", "n", "component").agg(F.min_by(F.struct("band", "key"), F.xxhash64("rep", "band", F.lit(turn))).alias("at"))
            outside = outside.select("at.*", "rep", "n", "component")
        other = outside.select("band", "key", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"))
        inside = now if whole else hubs(now.where("component = main"), turn)
        met = inside.join(settled(other, "outside"), ["band", "key"]).where((F.col("component") != F.col("cb")) & close("n", "nb"))
        pairs = met.select(F.least("rep", "b").alias("a"), F.greatest("rep", "b").alias("b")).distinct()
        found = settled(similar(pairs, held, drawn, percent), "links")
        more = bool(found.head(1))
        roots = joined(roots, found) if more else roots
        if whole:
            break
    return roots


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, bands: int = 16, rows: int = 6, rounds: int = HUB_ROUNDS) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_shingles, class_id, component_id), one row a document."""
    with small_batches(docs.sparkSession):
        named = settled(set_names(docs, n), "named")
        classes = named.where("n > 0").groupBy("x", "y").agg(F.min("doc_id").alias("class_id"), F.first("n").alias("n"))
        classes = settled(classes.select(F.col("x").alias("rep"), "y", "n", "class_id"), "classes")
        tokens, total = named.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0], classes.count()
        left = classes.join(held_heads(docs, n, percent, tokens), "rep").where(F.col("held") >= fifth(needed(percent))).select("rep", "class_id")
        sets = settled(sets_left(docs, settled(left, "some"), n), "sets")
        signed, drawn = settled(signatures(sets, bands, rows), "signatures"), settled(sketches(sets), "sketches")
        dealt = signed.select("rep", "n", F.posexplode("keys").alias("band", "key"))
        groups = dealt.groupBy("band", "key").agg(F.count("*").alias("m")).where("m > 1")
        shared = settled(dealt.join(groups.drop("m"), ["band", "key"], "left_semi"), "shared")
        roots = linked(shared, sets, drawn, None, total, percent, rounds)
        left = settled(with_components(signed.select("rep"), roots), "known")
        shared, held = apart(sets, left, signed.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0], percent)
        roots = linked(shared, held, drawn, roots, total, percent, rounds)
    rooted = settled(with_components(classes.select("rep", "y", "class_id"), roots), "rooted")
    least = settled(rooted.groupBy("component").agg(F.min("class_id").alias("component_id")), "names")
    rooted = settled(rooted.join(least, "component").select(F.col("rep").alias("x"), "y", "class_id", "component_id"), "rooted")
    got = named.select("doc_id", F.col("n").alias("n_shingles"), "x", "y").join(rooted, ["x", "y"], "left")
    return got.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))
