"""N-gram Jaccard join by filtering under several global token orders.

A text's set holds the hashes of its distinct n-word shingles (of the whole word sequence if shorter).
Texts with equal sets are folded into one class first, named by 128 bits of the set. For similarity t
the join goes through these filters, each exact in that no similar pair is lost:

1. Held tokens. Only tokens that another set holds too can be shared, so a set of which less than
   t |s| tokens are held elsewhere has no partner. Tokens are counted over all sets (see held).
2. Prefixes under ORDERS global orders of the tokens of the sets left. Two similar sets share a token
   within their first |s| - ceil(t |s|) + 1 tokens under any order, hence under each of several. Every order
   puts rare tokens first: the first by their exact count, the others by its logarithm with ties broken
   by different hashes. Candidates come from the first order's prefixes, where sizes and the places of the shared
   token must leave room for the overlap; they must share prefix tokens under all others too, before
   their sets are intersected.

Links are wanted for their components, so pairs are made sparingly: within a token's group every text is
first compared with one hub, the text whose prefix is shared most. When a round of hubs finds no link any more
(or after HUB_ROUNDS), what is left is joined across components by token and size band, the lesser
set of a pair by its shorter index prefix, so that texts far from each other are not paired however large their
group. No group is gathered in one task, and no pair that could link two components is skipped.

Defined results: null texts and texts without words have empty sets, link with nothing and are
their own component; repeated rows and equal doc_ids fall into one class; rows with a null doc_id take part like
others, but their id names a class or component only where no row of it has another (then it is null); very long
texts have all their shingles; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronq.llm.common import LOWER, arrow_map, batch, discard, mix, ngram_hashes, settle, utf8, word_hashes, word_spans
from heronq.llm.components import connected_components
from heronq.llm.held import buckets_for, held_counts

#: Orders; the first makes candidates, the others filter them.
ORDERS = 3
#: Rounds of hubs at most.
HUB_ROUNDS = 8
#: Size bands a doubling of the size.
BANDS = 16


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    low = LOWER[data]
    starts, ends, first = word_spans(low, offsets)
    words = word_hashes(low, starts, ends)
    grams = ngram_hashes(words, n)
    out = []
    for a, z in zip(first[:-1].tolist(), first[1:].tolist()):
        if z - a >= n:
            g = np.sort(grams[a : z - n + 1])
            out.append(g[np.concatenate([[True], g[1:] != g[:-1]])])
        elif z > a:
            out.append(mix(ngram_hashes(words[a:z], z - a) + np.uint64(z - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_name(g: np.ndarray) -> bytes | None:
    return hashlib.blake2b(g.tobytes(), digest_size=16).digest() if len(g) else None


def owner_of(name: bytes | None) -> int:
    """The 64 bits of a set's name by which it is known in the join."""
    return int.from_bytes(name[:8], "little", signed=True) if name else 0


def prefix_length(n: np.ndarray | int, percent: int):
    """Tokens of which similar sets share one."""
    return n - (percent * n + 99) // 100 + 1


_SETS = pa.schema([("doc_id", pa.int64()), ("text_id", pa.string()), ("n", pa.int64()), ("name", pa.binary()), ("owner", pa.int64())])


def summaries(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, text, text_id) -> (doc_id, text_id, n: set size, name: the set's 128-bit hash, owner: half of it)."""

    def run(batches):
        for b in batches:
            sets = shingle_sets(*utf8(b.column(1)), n)
            names = [set_name(g) for g in sets]
            yield batch(_SETS, b.column(0).cast(pa.int64()), b.column(2), [len(g) for g in sets], names, [owner_of(x) for x in names])

    return arrow_map(docs.select("doc_id", "text", "text_id"), run, "doc_id long, text_id string, n long, name binary, owner long")


_TOKENS = pa.schema([("name", pa.binary()), ("n", pa.int64()), ("tokens", pa.list_(pa.int64()))])


def sets_left(docs: DataFrame, made: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """Settled (owner, n, tokens) of the classes (name, rep, n, owner) of which enough tokens are held by others."""
    def tokens_of(texts: pa.Array):
        return ((owner_of(set_name(g)), g) for g in shingle_sets(*utf8(texts), n))

    counted = held_counts(docs.select("text"), tokens_of, buckets_for(docs, made.agg(F.sum("n")).first()[0] or 0))
    left = settle(classes.join(counted, "owner").where(F.col("c") * 100 >= F.col("n") * percent).select("name", "rep", "owner"), "left")

    def run(batches):
        for b in batches:
            sets = shingle_sets(*utf8(b.column(0)), n)
            yield batch(_TOKENS, [set_name(g) for g in sets], [len(g) for g in sets], [g.view(np.int64) for g in sets])

    rows, ids = docs.select("doc_id", "text"), left.select("rep")
    texts = rows.join(ids, rows["doc_id"].eqNullSafe(ids["rep"]), "left_semi").select("text")
    # rows that share an id can have other sets: the name decides
    named = arrow_map(texts, run, "name binary, n long, tokens array<long>").join(left.select("name", "owner"), "name")
    return settle(named.dropDuplicates(["name"]).select("owner", "n", "tokens"), "sets")


_PREFIXES = pa.schema(
    [("owner", pa.int64()), ("n", pa.int64()), ("c", pa.float64()), ("token", pa.list_(pa.int64())), ("pos", pa.list_(pa.int64())), ("others", pa.list_(pa.list_(pa.int64()))), ("held", pa.list_(pa.int64()))]
)


def shared_prefixes(n: int, token: np.ndarray, m: np.ndarray, percent: int) -> list[np.ndarray]:
    """Indices of the shared tokens in the prefix of a set of n under each order; m: sets that hold each. The others of the n
    stand before them in every order."""
    p = max(0, prefix_length(n, percent) - (n - len(token)))
    level, out = np.log2(m).astype(np.int64), []
    for k in range(ORDERS):
        tie = mix(token ^ np.uint64(0x51ED270B0A1F39D1 * (k + 1) % (1 << 64)))
        out.append(np.lexsort((tie, level if k else m))[:p])
    return out


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """Settled (owner, n, c: how much others share of the prefix, token and pos: shared tokens of the first order's prefix and their
    places in that order, others: those of the other orders, held: all shared tokens, sorted) of the sets that can have partners."""
    each = sets.select("owner", "n", F.explode("tokens").alias("token"))
    common = settle(each.groupBy("token").agg(F.count("*").alias("m")).where("m > 1"), "common")
    held = each.join(common, "token").groupBy("owner", "n").agg(F.collect_list(F.struct("token", "m")).alias("x"))

    def run(batches):
        for b in batches:
            out = [[] for _ in _PREFIXES]
            for owner, n, token, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3)):
                token, m = token.values.to_numpy().view(np.uint64), m.values.to_numpy()
                first, *others = shared_prefixes(n, token, m, percent)
                if not len(first):
                    continue
                alone = n - len(token)
                row = (owner, n, float(np.log2(m[first]).sum() / n), token[first].view(np.int64), alone + np.arange(len(first)), [token[o].view(np.int64) for o in others], np.sort(token.view(np.int64)))
                for x, v in zip(out, row):
                    x.append(v)
            yield batch(_PREFIXES, *out)

    ddl = "owner long, n long, c double, token array<long>, pos array<long>, others array<array<long>>, held array<long>"
    made = settle(arrow_map(held.select("owner", "n", "x.token", "x.m"), run, ddl), "prefixes")
    discard(common)
    return made


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


def verify(pairs: DataFrame, made: DataFrame, percent: int) -> DataFrame:
    """Settled (a, b) of the pairs whose sets are similar; pairs must share prefix tokens under every other order first."""
    pairs = settle(pairs, "pairs")

    def run(batches):
        for b in batches:
            na, nb, oa, ob, ha, hb = (b.column(k) for k in range(2, 8))
            keep = []
            for k, (x, y) in enumerate(zip(na.to_pylist(), nb.to_pylist())):
                left, right = oa[k].values, ob[k].values
                if not all(len(np.intersect1d(left[i].values.to_numpy(), right[i].values.to_numpy(), assume_unique=True)) for i in range(ORDERS - 1)):
                    continue
                both = overlap(ha[k].values.to_numpy(), hb[k].values.to_numpy())
                if 100 * both >= percent * (x + y - both):
                    keep.append(k)
            at = pa.array(keep, pa.int64())
            yield batch(_LINK, b.column(0).take(at), b.column(1).take(at))

    for x in "ab":
        pairs = pairs.join(made.select(F.col("owner").alias(x), F.col("n").alias("n" + x), F.col("others").alias("o" + x), F.col("held").alias("h" + x)), x)
    return settle(arrow_map(pairs.select("a", "b", "na", "nb", "oa", "ob", "ha", "hb"), run, "a long, b long"), "links")


def across(rows: DataFrame, hubs: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) across components that share a prefix token, fit in size, and whose token stands early enough in both.

    With r tokens from the shared one on, the other set of a similar pair has at most r (100 + percent) / percent - n. The greater set
    looks for the lesser by size band; a lesser set whose own size is over that bound is in no pair by this token.
    """
    live = rows.join(hubs.select("token", "c_hub"), "token").withColumn("room", F.expr(f"(n - pos) * {100 + percent} div {percent} - n")).withColumn("main", F.col("component") == F.col("c_hub"))
    band = lambda c: F.floor(F.log2(c) * BANDS).cast("int")
    low = F.expr(f"({percent} * n + 99) div 100")
    great = live.withColumn("low", low).withColumn("high", F.least("n", "room")).where("low <= high")
    great = great.select("token", F.explode(F.sequence(band(F.col("low")), band(F.col("high")))).alias("band"), F.col("owner").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("component").alias("ca"), "main")
    less = live.where("room >= n").select("token", band(F.col("n")).alias("band"), F.col("owner").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("component").alias("cb"), "main")
    fits = f"ca <> cb and (nb < na or (nb = na and b < a)) and least(na - pa, nb - pb) * {100 + percent} >= {percent} * (na + nb)"
    found = [x.drop("main").join(y.drop("main"), ["token", "band"]).where(fits).select("a", "b") for x, y in ((great.where("not main"), less), (great.where("main"), less.where("not main")))]
    return found[0].unionByName(found[1]).distinct()


def find_components(made: DataFrame, percent: int) -> DataFrame | None:
    """prefixes -> (node: owner, component) of the sets that link, or None."""
    rows = made.select("owner", "n", "c", F.explode(F.arrays_zip("token", "pos")).alias("x"), F.col("owner").alias("component"))
    rows = rows.select("x.token", "x.pos", "owner", "n", "c", "component")
    links = named = None
    for k in range(HUB_ROUNDS + 1):
        hubs = rows.groupBy("token").agg(F.max(F.struct("c", "owner", "n", "component")).alias("hub"), F.min("component").alias("low"), F.max("component").alias("high"))
        hubs = settle(hubs.where("low < high").select("token", F.col("hub.owner").alias("hub"), F.col("hub.n").alias("n_hub"), F.col("hub.component").alias("c_hub")), "hubs")
        if not hubs.head(1):
            return named
        live = rows.join(hubs, "token")
        if k == HUB_ROUNDS:
            break
        near = live.where("component <> c_hub").where(f"100 * least(n, n_hub) >= {percent} * greatest(n, n_hub)")
        new = verify(near.select(F.least("owner", "hub").alias("a"), F.greatest("owner", "hub").alias("b")).distinct(), made, percent)
        if not new.head(1):
            break
        links = new if links is None else links.unionByName(new)
        named = settle(connected_components(links), "components")
        # a hub is done with its group: it has met every other text there
        rows = live.where("owner <> hub").select("token", "pos", "owner", "n", "c").join(named.select(F.col("node").alias("owner"), "component"), "owner", "left")
        rows = settle(rows.select("token", "pos", "owner", "n", "c", F.coalesce("component", "owner").alias("component")), "rows")
    new = verify(across(rows, hubs, percent), made, percent)
    if not new.head(1):
        return named
    return settle(connected_components(new if links is None else links.unionByName(new)), "components")


def linked_classes(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text, text_id) -> summaries, settled, and of each set (name, rep: its smallest doc_id, root: its component, component_id: the
    smallest doc_id there)."""
    made = settle(summaries(docs, words), "summaries")
    classes = made.where("name is not null").groupBy("name").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("owner").alias("owner"))
    classes = settle(classes, "classes")
    sets = sets_left(docs, made, classes, words, percent)
    ready = prefixes(sets, percent)
    discard(sets)
    named = find_components(ready, percent)
    reps = classes.select("name", "rep", "owner")
    if named is None:
        return made, reps.select("name", "rep", F.col("owner").alias("root"), F.col("rep").alias("component_id"))
    known = reps.join(named.withColumnRenamed("node", "owner"), "owner").select("owner", "rep", "component")
    least = settle(known.groupBy("component").agg(F.min("rep").alias("component_id")), "least")
    known = settle(known.join(least, "component").select("owner", "component", "component_id"), "known")
    reps = reps.join(known, "owner", "left")
    return made, reps.select("name", "rep", F.coalesce("component", "owner").alias("root"), F.coalesce("component_id", "rep").alias("component_id"))


def join_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_shingles, class_id, component_id): class_id is the smallest doc_id of an equal set,
    component_id the smallest reachable by links of at least percent hundredths of Jaccard similarity."""
    made, reps = linked_classes(docs.select("doc_id", "text", F.lit("").alias("text_id")), words, percent)
    got = made.select("doc_id", "n", "name").join(reps.drop("root"), "name", "left")
    return got.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("class_id"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs, all columns, of each component: that of smallest doc_id, null last, then of least md5 of the text. Of rows
    that agree in both the one of least hash of all columns stays. Texts without words link with nothing, so they all stay."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)  # so that no column can clash with those used here
    at = {c: names[i] for i, c in enumerate(docs.columns)}
    rows = rows.withColumn("text_id", F.md5(F.coalesce(F.col(at["text"]), F.lit("")).cast("binary"))).withColumn("id", F.col(at["doc_id"]).cast("long"))
    made, reps = linked_classes(rows.select(F.col("id").alias("doc_id"), F.col(at["text"]).alias("text"), "text_id"), words, percent)
    members = made.where("name is not null").join(reps.select("name", "root"), "name")
    chosen = members.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("nameless"), "doc_id", "text_id")).alias("x")).select("x.doc_id", "x.text_id")
    wordless = made.where("name is null").select("doc_id", "text_id").distinct()
    keep = settle(chosen.unionByName(wordless), "keep")
    kept = rows.join(keep, rows["id"].eqNullSafe(keep["doc_id"]) & (rows["text_id"] == keep["text_id"]), "left_semi")
    # rows that agree in id and text, for there is one of them to stay
    twice = made.where("name is not null").groupBy("doc_id", "text_id").agg(F.count("*").alias("m")).where("m > 1")
    twice = settle(twice.select("doc_id", F.col("text_id").alias("same_text")), "twice")
    if twice.head(1):
        kept = kept.join(twice, kept["id"].eqNullSafe(twice["doc_id"]) & (kept["text_id"] == twice["same_text"]), "left")
        first = kept.where("same_text is not null").groupBy("id", "text_id").agg(F.min_by(F.struct(*names), F.xxhash64(*names)).alias("x")).select("x.*")
        kept = kept.where("same_text is null").select(*names).unionByName(first)
    return kept.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])
