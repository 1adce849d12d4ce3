"""Queries over documents, benchmark items, conversations and vectors."""

from pyspark.sql import functions as F

from heronq.operators.dialogue import conversation_report, transcripts
from heronq.operators.minhash import near_duplicates
from heronq.operators.neighbours import exact_neighbours
from heronq.operators.overlap import coverage_of_items, overlap_of_documents
from heronq.operators.redaction import ADDRESS, CARD, EMAIL, IBAN, LICENCE, LICENCES, SECRET, SECRET_DIGITS, SECRET_ENTROPY, personal_data
from heronq.plans.catalog import query

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _runs(table: str, key: str, n: int) -> str:
    """SQL for (key, i, run): the n words from each place of each text."""
    return f"""(SELECT {key}, i, run FROM (SELECT {key}, i, n, string_agg(word, ' ') OVER (PARTITION BY {key} ORDER BY i ROWS BETWEEN CURRENT ROW AND {n - 1} FOLLOWING) AS run
  FROM (SELECT {key}, unnest(w) AS word, unnest(range(len(w))) AS i, len(w) AS n FROM (SELECT {key}, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM {table}))) WHERE i <= n - {n})"""


@query(f"""
WITH d AS {_runs("documents", "doc_id", 8)}, b AS (SELECT DISTINCT run, 1 AS hit FROM {_runs("benchmark", "item_id", 8)}),
s AS (SELECT doc_id, count(*) AS n_runs, count(hit) AS n_hits FROM d LEFT JOIN b USING (run) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, coalesce(n_hits, 0) AS n_hits, n_hits / n_runs AS hit_share FROM documents LEFT JOIN s USING (doc_id)
""")
def benchmark_overlap(t):
    return overlap_of_documents(t.documents, t.benchmark, n=8)


@query(f"""
WITH d AS (SELECT DISTINCT run, 1 AS hit FROM {_runs("documents", "doc_id", 8)}), b AS (SELECT DISTINCT item_id, run FROM {_runs("benchmark", "item_id", 8)}),
s AS (SELECT item_id, count(*) AS n_runs, count(hit) AS n_found FROM b LEFT JOIN d USING (run) GROUP BY item_id)
SELECT item_id, coalesce(n_runs, 0) AS n_runs, coalesce(n_found, 0) AS n_found, n_found / n_runs AS covered_share FROM benchmark LEFT JOIN s USING (item_id)
""")
def benchmark_coverage(t):
    return coverage_of_items(t.documents, t.benchmark, n=8)


@query(f"""
WITH RECURSIVE split AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i, len(w) AS n FROM split),
grams AS (SELECT doc_id, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS g FROM words QUALIFY i <= greatest(n - 5, 0)),
sets AS (SELECT doc_id, coalesce(list_sort(list(DISTINCT g) FILTER (g IS NOT NULL)), []) AS s FROM documents LEFT JOIN grams USING (doc_id) GROUP BY doc_id),
classes AS (SELECT min(doc_id) AS rep, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
tokens AS (SELECT rep, n, unnest(s) AS g FROM classes),
links AS (SELECT a.rep AS x, b.rep AS y FROM tokens a JOIN tokens b ON a.g = b.g AND a.rep < b.rep AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
  GROUP BY a.rep, b.rep HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
ends AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(node, root) AS (SELECT DISTINCT x, x FROM ends UNION SELECT b.y, r.root FROM reach r JOIN ends b ON b.x = r.node),
least AS (SELECT node, min(root) AS component FROM reach GROUP BY node)
SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(rep, doc_id) AS class_id, coalesce(component, rep, doc_id) AS component_id
FROM sets LEFT JOIN classes ON sets.s = classes.s LEFT JOIN least ON node = rep
""")
def minhash_near_duplicates(t):
    return near_duplicates(t.documents, n=5, percent=80, bands=16, rows=6)


#: Turns in order with flags: a letter for each turn so far, x where it was left out.
_DIALOGUE = """WITH turns AS (SELECT conv_id, CASE WHEN turn >= 0 THEN turn END AS turn, role, text FROM conversations),
first AS (SELECT conv_id, turn, role, text, count(*) OVER (PARTITION BY conv_id, turn) AS n FROM turns QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY role NULLS LAST, text NULLS LAST) = 1),
known AS (SELECT conv_id, list(turn ORDER BY turn) AS ats, list(coalesce(role, '') ORDER BY turn) AS roles, list(coalesce(text, '') ORDER BY turn) AS texts FROM first WHERE turn IS NOT NULL GROUP BY conv_id),
flags AS (SELECT *, list_reduce(list_prepend('-', roles), lambda a, r: a || CASE right(regexp_replace(a, 'x+$', ''), 1) || r
  WHEN '-system' THEN 's' WHEN '-user' THEN 'u' WHEN 'suser' THEN 'u' WHEN 'uassistant' THEN 'a' WHEN 'auser' THEN 'u' ELSE 'x' END) AS f FROM known),
ends AS (SELECT *, len(replace(f, 'x', '')) - 1 AS kept, right(regexp_replace(f, 'x+$', ''), 1) AS last FROM flags)"""


@query(f"""
{_DIALOGUE},
sums AS (SELECT conv_id, sum(n)::BIGINT AS n_rows, count(turn) AS n_turns, coalesce(max(turn) + 1, 0) - count(turn) AS n_missing,
  coalesce(sum(n - 1) FILTER (turn IS NOT NULL), 0)::BIGINT AS n_repeated, coalesce(sum(n) FILTER (turn IS NULL), 0)::BIGINT AS n_stray FROM first GROUP BY conv_id),
got AS (SELECT s.*, coalesce(n_turns - kept, 0)::BIGINT AS n_out_of_role, CASE last WHEN 's' THEN 'system' WHEN 'u' THEN 'user' WHEN 'a' THEN 'assistant' END AS last_role
  FROM sums s LEFT JOIN ends e ON s.conv_id IS NOT DISTINCT FROM e.conv_id)
SELECT *, n_missing + n_repeated + n_stray + n_out_of_role = 0 AND coalesce(last_role = 'assistant', false) AS complete FROM got
""")
def conversation_assembly(t):
    return conversation_report(t.conversations)


@query(f"""
{_DIALOGUE},
said AS (SELECT conv_id, unnest(ats) AS turn, unnest(roles) AS role, unnest(texts) AS text, unnest(string_split(f[2:], '')) AS flag FROM flags)
SELECT conv_id, turn // 512 AS part, min(turn) AS first_turn, count_if(flag <> 'x')::BIGINT AS n_kept, count_if(flag = 'x')::BIGINT AS n_left_out,
  coalesce(string_agg('<|' || role || '|>' || text, chr(10) ORDER BY turn) FILTER (flag <> 'x'), '') AS transcript FROM said GROUP BY conv_id, turn // 512
""")
def conversation_transcripts(t):
    return transcripts(t.conversations)


def _marks(before: str, after: str, kind: str, pattern: str, valid: str) -> str:
    """One detector: found, then marks for what is valid, then the text put together."""
    return f"""{after}_f AS (SELECT *, regexp_extract_all(r, '{pattern}') AS f FROM {before}),
{after}_m AS (SELECT * EXCLUDE (f), list_transform(f, lambda m: CASE WHEN {valid} THEN '[{kind.upper()}]' END) AS k, f FROM {after}_f),
{after} AS (SELECT * EXCLUDE (f, k, r), len(list_filter(k, lambda x: x IS NOT NULL))::BIGINT AS n_{kind},
  array_to_string(list_transform(list_zip(string_split_regex(r, '{pattern}'), list_transform(list_zip(f, k), lambda x: coalesce(x[2], x[1]))), lambda x: x[1] || coalesce(x[2], '')), '') AS r FROM {after}_m)"""


_DIGITS = "regexp_replace(m, '[ -]', '', 'g')"
_PLAIN = "replace(m, ' ', '')"
_VALID = {
    "email": r"length(m) <= 254 AND NOT contains(m, '..') AND NOT regexp_matches(m, '^\.|\.@|@-|-\.') AND regexp_matches(m, '\.[A-Za-z]{2,}$')",
    "address": "len(list_filter(string_split(m, '.'), lambda o: o::INTEGER > 255 OR (o[1] = '0' AND o <> '0'))) = 0",
    "card": f"""length({_DIGITS}) BETWEEN 13 AND 19 AND len(list_distinct(string_split({_DIGITS}, ''))) > 1
    AND list_sum(list_transform(range(length({_DIGITS})), lambda i: CASE WHEN i % 2 = 0 THEN reverse({_DIGITS})[i + 1]::INTEGER ELSE 2 * reverse({_DIGITS})[i + 1]::INTEGER - CASE WHEN reverse({_DIGITS})[i + 1]::INTEGER > 4 THEN 9 ELSE 0 END END)) % 10 = 0""",
    "iban": f"""length({_PLAIN}) BETWEEN 15 AND 34
    AND list_reduce(list_prepend(0, list_transform(string_split({_PLAIN}[5:] || {_PLAIN}[:4], ''), lambda c: CASE WHEN c >= 'A' THEN ascii(c) - 55 ELSE ascii(c) - 48 END)), lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1""",
    "secret": f"length(m) - length(regexp_replace(m, '[0-9]', '', 'g')) >= {SECRET_DIGITS} AND regexp_matches(m, '[A-Za-z]') AND list_aggregate(string_split(m, ''), 'entropy') >= {SECRET_ENTROPY}",
}
_PATTERNS = {"email": EMAIL, "address": ADDRESS, "card": CARD, "iban": IBAN, "secret": SECRET}
_KIND = " ".join(f"WHEN len(list_filter(l, lambda x: regexp_matches(x, '{p}'))) > 0 THEN '{name}'" for name, p in LICENCES)


@query(
    "WITH t0 AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(text, '') AS r FROM documents),\n"
    + ",\n".join(_marks(f"t{i}", f"t{i + 1}", kind, _PATTERNS[kind], _VALID[kind]) for i, kind in enumerate(_PATTERNS))
    + f""",
lines AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{LICENCE}')) AS l FROM t{len(_PATTERNS)})
SELECT doc_id, n_email, n_address, n_card, n_iban, n_secret, len(l)::BIGINT AS n_licence, CASE {_KIND} WHEN len(l) > 0 THEN 'other' END AS licence, sha256(r) AS redacted_sha256 FROM lines"""
)
def personal_data_redaction(t):
    got = personal_data(t.documents)
    return got.select(*[c for c in got.columns if c != "redacted"], F.sha2("redacted", 256).alias("redacted_sha256"))


@query("""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.e, b.e), 9) AS c FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id)::INTEGER AS rank, vec_id, round(c, 6) AS cosine FROM p QUALIFY rank <= 20
""")
def exact_nearest(t):
    return exact_neighbours(t.embeddings, k=20).withColumn("cosine", F.round("cosine", 6))
