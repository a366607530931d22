"""DuckDB SQL for the queries of this subpackage that SQL can express."""

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {}

SQL["op8_decontamination"] = f"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array({LOWER.format("coalesce(text, '')")}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array({LOWER.format("coalesce(text, '')")}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(list_slice(ws, s, s + least(len(ws), 10) - 1), ' ') AS phrase
       FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS s FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, s, n, array_to_string(list_slice(ws, s, s + n - 1), ' ') AS phrase
       FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM w, sizes WHERE len(ws) >= n)),
m AS (SELECT doc_id, item_id, s, n FROM dw JOIN bw USING (n, phrase)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM m)) GROUP BY doc_id),
i AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(k, ',' ORDER BY k)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM m) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""

SQL["op10_near_duplicates"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({LOWER.format("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, s, s + 4), ' ') AS g
       FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS s FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM sh x JOIN sh y USING (g) WHERE x.doc_id <> y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
reach AS (SELECT a AS doc_id, b AS other FROM link UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.other),
c AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(c.other, w.doc_id)) AS component_id, w.doc_id <= coalesce(c.other, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

SQL["op4_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

SQL["op6_warc"] = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (payload_digest)
"""


def _framed(expression: str) -> str:
    """A value's encoding in the manifest."""
    return f"CASE WHEN {expression} IS NULL THEN '-' ELSE strlen(CAST({expression} AS VARCHAR)) || ':' || {expression} END"


def _levels(name: str, leaves: str, most: int = 8) -> str:
    """CTEs of the trees over leaves (g, pos, d): name_0, name_1, ... with a node's digest d; a group's single node stays as it is. Enough for 8 ** most leaves."""
    found = [f"{name}_0 AS ({leaves})"]
    for k in range(most):
        many = f"(SELECT *, count(*) OVER (PARTITION BY g) > 1 AS many FROM {name}_{k})"
        found.append(
            f"{name}_{k + 1} AS (SELECT g, pos // 8 AS pos, CASE WHEN bool_or(many) THEN sha256(string_agg(d, '' ORDER BY pos)) ELSE min(d) END AS d FROM {many} GROUP BY g, pos // 8)"
        )
    return ",\n".join(found)


def _paths(name: str, rows: str, most: int = 8) -> str:
    """CTEs name_path_k for rows (doc_id, g, pos): siblings so far (path) and the digest that `claimed` leads to (led) below height k."""
    found = [f"{name}_path_0 AS (SELECT doc_id, g, pos AS leaf, '' AS path, claimed AS led FROM {rows})"]
    for k in range(most):
        at = f"p.leaf // {8**k}"
        run = f"SELECT g, pos // 8 AS run, count(*) AS n, list(d ORDER BY pos) AS ds FROM {name}_{k} GROUP BY g, pos // 8"
        size = f"SELECT g, count(*) AS nodes FROM {name}_{k} GROUP BY g"
        own = f"CAST({at} % 8 AS BIGINT) + 1"
        others = f"array_to_string(list_concat(list_slice(ds, 1, {own} - 1), list_slice(ds, {own} + 1, n)), '')"
        led = f"sha256(array_to_string(list_concat(list_concat(list_slice(ds, 1, {own} - 1), [p.led]), list_slice(ds, {own} + 1, n)), ''))"
        found.append(
            f"{name}_path_{k + 1} AS (SELECT p.doc_id, p.g, p.leaf, CASE WHEN nodes > 1 THEN p.path || {others} ELSE p.path END AS path, CASE WHEN nodes > 1 THEN {led} ELSE p.led END AS led\n"
            f"  FROM {name}_path_{k} p JOIN ({run}) r ON r.g = p.g AND r.run = p.leaf // {8 ** (k + 1)} JOIN ({size}) s ON s.g = p.g)"
        )
    return ",\n".join(found)


_CRC = (
    "xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda x, y: "
    "list_reduce(list_prepend(xor(x, y), range(8)), lambda u, v: CASE WHEN u & 1 = 1 THEN xor(u >> 1, CAST(3988292384 AS BIGINT)) ELSE u >> 1 END)), CAST(4294967295 AS BIGINT))"
)
_HEAD = " || ".join(_framed(c) for c in ("doc_id", "source", "lang", "n_chars"))

SQL["op11_merkle_manifest"] = f"""
WITH docs AS (SELECT doc_id, coalesce('+' || lang, '') AS g, sha256({_HEAD} || {_framed("text")}) AS leaf,
  sha256({_HEAD} || {_framed(f"CASE WHEN {_CRC} % 3 = 0 THEN {LOWER.format('text')} ELSE text END")}) AS claimed FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, leaf) - 1 AS pos FROM docs),
{_levels("t", "SELECT g, pos, leaf AS d FROM placed")},
{_paths("t", "placed")},
subs AS (SELECT g, d AS subroot FROM t_8),
tops AS (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS pos, g AS lang_g, subroot FROM subs),
{_levels("u", "SELECT g, pos, subroot AS d FROM tops", 4)},
up AS (SELECT p.doc_id, '' AS g, t.pos, p.led AS claimed, p.path AS below, p.g AS lang_g, p.leaf FROM t_path_8 p JOIN tops t ON t.lang_g = p.g),
keyed AS (SELECT *, row_number() OVER () AS k FROM up),
{_paths("u", "(SELECT k AS doc_id, g, pos, claimed FROM keyed)", 4)}
SELECT y.doc_id, x.leaf, s.subroot, (SELECT d FROM u_4) AS root, sha256(y.below || v.path) AS proof_sha256, v.led AS folded_root, v.led = (SELECT d FROM u_4) AS verified
FROM keyed y JOIN u_path_4 v ON v.doc_id = y.k JOIN placed x ON x.g = y.lang_g AND x.pos = y.leaf JOIN subs s ON s.g = y.lang_g
"""

SQL["op12_collocations"] = f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT lang, k AS words, array_to_string(list_slice(ws, s, s + k - 1), ' ') AS phrase, count(*) AS a
      FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS s FROM w, (VALUES (1), (2), (3), (4)) v(k) WHERE len(ws) >= k) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM g WHERE words = 1 GROUP BY lang),
c AS (SELECT * FROM g WHERE words > 1 AND a >= 30),
cuts AS (SELECT c.lang, c.words, c.phrase, c.a, c.k, x.a AS l, y.a AS r, CAST(CAST(2000000 AS HUGEINT) * c.a // (x.a + y.a) AS BIGINT) AS score
         FROM (SELECT *, unnest(range(1, words)) AS k, string_split(phrase, ' ') AS ws FROM c) c
         JOIN g x ON x.lang = c.lang AND x.phrase = array_to_string(list_slice(c.ws, 1, c.k), ' ') JOIN g y ON y.lang = c.lang AND y.phrase = array_to_string(list_slice(c.ws, c.k + 1, c.words), ' ')),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS i FROM cuts) WHERE i = 1),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.words > b.words AND 100 * c.a >= 80 * b.a AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN n USING (lang) WHERE rank <= 2000
"""
