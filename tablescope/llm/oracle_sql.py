"""DuckDB SQL for the queries whose rows SQL can give; the others are tested by brute force."""

ORACLES = {}

ORACLES["op2_embedding_near_dedup"] = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
half AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id AND len(a.v) = len(b.v)
         WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach(v, u) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.v, l.b FROM reach r JOIN links l ON l.a = r.u),
c AS (SELECT v, min(u) AS component_id FROM reach GROUP BY v),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON v = vec_id LEFT JOIN n ON n.a = vec_id"""

ORACLES["op4_seekable_warc"] = """
WITH r AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
w AS (SELECT d, n, max(page_id) AS m FROM r WHERE n >= 1000 GROUP BY d, n)
SELECT page_id, CAST(r.n AS BIGINT) AS payload_bytes, r.d AS payload_digest,
       CASE WHEN page_id < m THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < m THEN m END AS refers_to
FROM r LEFT JOIN w ON w.d = r.d AND w.n = r.n"""

ORACLES["op7_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS k FROM x),
m AS (SELECT k, min(doc_id) AS f FROM g GROUP BY k),
p AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM g JOIN m USING (k) WHERE f < doc_id),
h AS (SELECT doc_id, list(p) AS ps FROM p GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda y, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN h USING (doc_id)"""

ORACLES["op9_preference_formatting"] = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE turn IS NOT NULL),
e AS (SELECT conv_id, max(turn) AS z, min(turn) AS a, arg_max(text, turn) AS last, arg_min(text, turn) AS first
      FROM t WHERE role = 'assistant' GROUP BY conv_id),
s AS (SELECT conv_id, z, last, CASE WHEN a < z THEN first ELSE '' END AS other FROM e),
p AS (SELECT s.conv_id, count(*) AS n, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) AS prompt
      FROM s JOIN t ON t.conv_id = s.conv_id AND (turn < z OR (turn = z AND last = other)) GROUP BY s.conv_id)
SELECT s.conv_id AS pair_id, CAST(coalesce(n, 0) AS INTEGER) AS n_common, coalesce(prompt, '') AS prompt,
       CASE WHEN last = other THEN '' ELSE '<|im_start|>assistant' || chr(10) || last || '<|im_end|>' || chr(10) END AS chosen,
       CASE WHEN last = other THEN '' ELSE '<|im_start|>assistant' || chr(10) || other || '<|im_end|>' || chr(10) END AS rejected,
       CASE WHEN last = other THEN '' ELSE '22-' || (22 + length(last) + 10) END AS chosen_mask,
       CASE WHEN last = other THEN '' ELSE '22-' || (22 + length(other) + 10) END AS rejected_mask
FROM s LEFT JOIN p USING (conv_id)"""

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES["op10_benchmark_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS k
         FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM wins),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN wins ON wins.n = dw.n AND wins.k = dw.k),
p AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM m WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN s USING (doc_id)"""

_BREAKS = r"[.,;:!?\x0A-\x0D]"
ORACLES["op11_phrase_collocations"] = rf"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, {_FOLD} AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '{_BREAKS}')) AS p FROM t),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k, count(*) AS a FROM i, range(1, 6) r(k)
      WHERE i + k - 1 <= len(w) GROUP BY lang, phrase, k),
n AS (SELECT lang, sum(a) AS n FROM g WHERE k = 1 GROUP BY lang),
f AS (SELECT * FROM g WHERE a >= 100),
c AS (SELECT lang, phrase, a, k, unnest(range(1, k)) AS cut, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
s AS (SELECT c.lang, c.phrase, c.a, cut, l.a AS l, r.a AS r, n.n,
        CAST(CAST(1000 AS HUGEINT) * c.a * n.n // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
      FROM c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[1:cut], ' ')
      JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[cut + 1:], ' ') JOIN n ON n.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_ AS (SELECT DISTINCT lang, array_to_string(w[x:x + m - 1], ' ') AS phrase, a
           FROM (SELECT lang, w, a, k, m, unnest(range(1, k - m + 2)) AS x FROM (SELECT DISTINCT lang, w, a, k FROM c), range(2, 5) r(m) WHERE m < k)),
longest AS (SELECT lang, phrase, max(a) AS longer FROM inner_ GROUP BY lang, phrase),
o AS (SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank, b.phrase, a, l, r, n, score
      FROM b LEFT JOIN longest x ON x.lang = b.lang AND x.phrase = b.phrase WHERE coalesce(100 * longer < 100 * a, true))
SELECT lang, CAST(rank AS INTEGER) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM o WHERE rank <= 2000"""


def _leaf_sql(text: str) -> str:
    def part(c):
        return f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    return f"sha256({' || '.join(part(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"


# Levels are unrolled up to 8^7 leaves of a language and 8^2 languages.
def _tree_sql(name: str, levels: int) -> str:
    out = []
    for k in range(1, levels + 1):
        out.append(f"""{name}{k} AS (SELECT tree, p // 8 AS p, any_value(m) AS m, CASE WHEN any_value(m) > 1 THEN sha256(string_agg(d, '' ORDER BY p))
          ELSE any_value(d) END AS d FROM (SELECT tree, p, d, count(*) OVER (PARTITION BY tree) AS m FROM {name}{k - 1}) GROUP BY tree, p // 8)""")
    return ", ".join(out)


def _walk_sql(name: str, levels: int, start: str) -> str:
    """Proof and fold of every row of ``start`` (id, tree, p, proof, d) up the tree ``name``."""
    out, before = [], start
    for k in range(levels):
        here = f"walk_{name}{k}"
        out.append(f"""runs_{name}{k} AS (SELECT tree, p // 8 AS up, list(d ORDER BY p) AS ds, any_value(m) AS m
          FROM (SELECT tree, p, d, count(*) OVER (PARTITION BY tree) AS m FROM {name}{k}) GROUP BY tree, p // 8),
        {here} AS (SELECT b.id, b.tree, b.p // 8 AS p,
          b.proof || array_to_string(list_filter(ds, lambda x, i: i <> b.p % 8 + 1), '') AS proof,
          CASE WHEN m > 1 THEN sha256(array_to_string(list_transform(ds, lambda x, i: CASE WHEN i = b.p % 8 + 1 THEN b.d ELSE x END), '')) ELSE b.d END AS d
          FROM {before} b JOIN runs_{name}{k} r ON r.tree = b.tree AND r.up = b.p // 8)""")
        before = here
    return ", ".join(out), before


_LOW_WALK, _LOW_END = _walk_sql("low", 7, "leaf0")
_TOP_WALK, _TOP_END = _walk_sql("top", 2, "leaf1")
# crc32, bit by bit over the bytes of the decimal id.
_BYTES = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ord(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])"
_CRC = (f"xor(list_reduce(list_concat([4294967295], flatten({_BYTES})), "
        "lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295)")
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLES["op12_merkle_manifest"] = f"""
WITH x AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf_sql('text')} AS leaf,
    CASE WHEN {_CRC} % 3 = 0 THEN {_leaf_sql(_LOWERED)} END AS changed FROM documents),
y AS (SELECT *, row_number() OVER (ORDER BY tree, doc_id NULLS FIRST, leaf) AS id,
    row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p FROM x),
low0 AS (SELECT tree, p, leaf AS d FROM y), {_tree_sql("low", 7)},
top0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS p, d, tree AS name FROM low7), {_tree_sql("top", 2)},
leaf0 AS (SELECT id, tree, p, '' AS proof, coalesce(changed, leaf) AS d FROM y), {_LOW_WALK},
leaf1 AS (SELECT w.id, '' AS tree, t.p, w.proof, w.d FROM {_LOW_END} w JOIN top0 t ON t.name = w.tree), {_TOP_WALK}
SELECT doc_id, leaf, low7.d AS subroot, top2.d AS root, sha256(w.proof) AS proof_sha256, w.d AS folded_root, w.d = top2.d AS verified
FROM y JOIN {_TOP_END} w USING (id) JOIN low7 ON low7.tree = y.tree CROSS JOIN top2"""

ORACLES["op13_threshold_top_k"] = """
WITH e AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
