"""DuckDB SQL for the rows of those text queries that SQL can express: no tokenizers, models or files in the answer.

All are plain statements of the contracts, on exact texts instead of hashes, and know nothing of the methods. Ids are
taken as unique and not null, as in the given tables.
"""

from __future__ import annotations

#: Words are runs of what is not white space in ASCII.
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Reachability over the pairs (x, y) of a table links, as reach (node, root).
_REACH = """ends AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(node, root) AS (SELECT DISTINCT x, x FROM ends UNION SELECT b.y, r.root FROM reach r JOIN ends b ON b.x = r.node)"""



def _nibble(c: int) -> int:
    for _ in range(4):
        c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
    return c


#: crc32 of a string, four bits at a time, low ones of each byte first.
_CRC32 = f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(2 * octet_length(encode({{0}}))), lambda i: (instr('0123456789ABCDEF', hex(encode({{0}}))[xor(i, 1) + 1]) - 1)::BIGINT)),
  lambda c, d: xor(c >> 4, {[_nibble(i) for i in range(16)]}[(xor(c, d) & 15) + 1])), 4294967295)"""

ORACLES = {
    "op1_jaccard_join": f"""
WITH RECURSIVE split AS (SELECT doc_id, coalesce({_WORDS.format(_LOWER)}, []) AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i, len(w) AS n FROM split),
grams AS (SELECT doc_id, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS g FROM words QUALIFY i <= greatest(n - 4, 0)),
sets AS (SELECT doc_id, coalesce(list_sort(list(DISTINCT g) FILTER (g IS NOT NULL)), []) AS s FROM documents LEFT JOIN grams USING (doc_id) GROUP BY doc_id),
classes AS (SELECT min(doc_id) AS rep, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
tokens AS (SELECT rep, n, unnest(s) AS g FROM classes),
links AS (SELECT a.rep AS x, b.rep AS y FROM tokens a JOIN tokens b ON a.g = b.g AND a.rep < b.rep AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
  GROUP BY a.rep, b.rep HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
{_REACH},
least AS (SELECT node, min(root) AS component FROM reach GROUP BY node)
SELECT doc_id, len(sets.s)::BIGINT AS n_shingles, coalesce(rep, doc_id) AS class_id, coalesce(component, rep, doc_id) AS component_id
FROM sets LEFT JOIN classes ON sets.s = classes.s LEFT JOIN least ON node = rep""",
    "op4_substring_dedup": f"""
WITH split AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i, len(w) AS n FROM split),
windows AS (SELECT doc_id, i, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS g FROM words QUALIFY i <= n - 20),
again AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
marked AS (SELECT doc_id, i, word, max(again.i IS NOT NULL) OVER (PARTITION BY doc_id ORDER BY i ROWS 19 PRECEDING) AS gone
  FROM words LEFT JOIN again USING (doc_id, i)),
kept AS (SELECT doc_id, count_if(gone)::BIGINT AS n, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS t FROM marked GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM split LEFT JOIN kept USING (doc_id)""",
    "op8_embedding_dedup": f"""
WITH RECURSIVE vectors AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM vectors a JOIN vectors b ON a.vec_id < b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
{_REACH},
least AS (SELECT node, min(root) AS component FROM reach GROUP BY node),
degrees AS (SELECT x, count(*) AS n FROM ends GROUP BY x)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component, vec_id) AS component_id, vec_id = coalesce(component, vec_id) AS kept
FROM embeddings LEFT JOIN least ON node = vec_id LEFT JOIN degrees ON x = vec_id""",
    "op10_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS hex, min(page_id) OVER (PARTITION BY h) AS first FROM p),
five AS (SELECT *, list_transform(range(4), lambda j: ('0x' || hex[10 * j + 1:10 * j + 10])::BIGINT) AS v FROM d)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((v[i // 8 + 1] >> (35 - 5 * (i % 8))) & 31) + 1]), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, nullif(first, page_id) AS refers_to FROM five""",
    "op11_bit_sliced_search": """
WITH v AS (SELECT vec_id, len(embedding) AS dim, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id, coalesce(list_sum(list_transform(range(1, a.dim + 1), lambda i: a.c[i] * b.c[i])), 0)::BIGINT AS score
  FROM v a JOIN v b ON a.dim = b.dim AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM p
QUALIFY rank <= 20""",
    "op12_fill_in_middle": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT *, list_transform(range(4), lambda i: ('0x' || x[8 * i + 1:8 * i + 8])::BIGINT) AS h FROM d),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS lo, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS hi,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substring(t, 1, lo) AS a, substring(t, lo + 1, hi - lo) AS b, substring(t, hi + 1) AS e FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || e || '<M>' || b ELSE '<S>' || e || '<P>' || a || '<M>' || b END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p""",
    "op13_spelling_variants": f"""
WITH RECURSIVE runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all({_LOWER}, '[A-Za-zÀ-ÿ]+')) AS r FROM documents),
hashed AS (SELECT r, n, {_CRC32.format("d || ':' || r")} AS h FROM (SELECT d, r, count(*) AS n FROM runs GROUP BY d, r)),
slipped AS (SELECT n, CASE WHEN h % 97 = 0 THEN substring(r, 1, h % length(r)) || substring(r, h % length(r) + 2) ELSE r END AS word FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
gaps AS (SELECT word, n, substring(word, 1, i) AS a, substring(word, i + 2) AS b FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
less AS (SELECT DISTINCT g.word AS w1, w.word AS w0, g.n AS n1, w.n AS n0 FROM gaps g JOIN words w ON w.word = g.a || g.b),
near AS (SELECT x.word, y.word AS other, y.n AS other_n FROM gaps x JOIN gaps y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION ALL SELECT w1, w0, n0 FROM less UNION ALL SELECT w0, w1, n1 FROM less),
best AS (SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) = 1),
known AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * n THEN other END AS form, CASE WHEN other_n >= 2 * n THEN other_n END AS form_n FROM words LEFT JOIN best USING (word)),
reach(word, leaf) AS (SELECT word, word FROM known UNION ALL SELECT r.word, k.form FROM reach r JOIN known k ON k.word = r.leaf WHERE k.form IS NOT NULL)
SELECT k.word, k.form, r.leaf AS root, k.n, k.n_near, k.form_n FROM known k JOIN reach r ON r.word = k.word JOIN known e ON e.word = r.leaf AND e.form IS NULL""",
}
