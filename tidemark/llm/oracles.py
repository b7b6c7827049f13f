"""DuckDB SQL for the queries whose results SQL can say: the same question asked the plain way, by joins over all windows, shingles or pairs."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLDED = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
_BLANK_CUT = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


def _any_case(words: str) -> str:
    """Letters in either case, for an engine whose own case folding knows more letters than A to Z."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in words)


_KINDS = {
    "assign": f"({_any_case('password|passwd|secret|token|api_?key')})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]+",
}

#: Matches between the pieces that splitting leaves, so their places are sums of lengths.
SECRET_BASES = (
    "WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents), "
    + ", ".join(
        f"""{kind}_m AS (SELECT r, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS p{f", regexp_extract_all(text, '{pattern}', 2) AS v" if kind == "assign" else ""} FROM d),
{kind}_s AS (SELECT r, {n} AS kind, '{kind}' AS name, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a, length(m[i]) AS n
FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM {kind}_m) WHERE {"length(v[i]) >= 8" if kind == "assign" else f"length(m[i]) >= {16 if kind == 'access' else 32}"})"""
        for n, (kind, pattern) in enumerate(_KINDS.items())
    )
    + """, s AS (SELECT * FROM assign_s UNION ALL SELECT * FROM access_s UNION ALL SELECT * FROM hex_s),
g AS (SELECT r, COUNT(*) FILTER (kind = 0) AS n_assign, COUNT(*) FILTER (kind = 1) AS n_access, COUNT(*) FILTER (kind = 2) AS n_hex, string_agg(name || ':' || a || ':' || (a + n), ',' ORDER BY a, kind) AS spans FROM s GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN g USING (r)"""
)

SUBSTRINGS = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), {_BLANK_CUT}) AS w FROM documents),
win AS (SELECT r, doc_id, k, array_to_string(w[k:k + 12], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 11)) AS k FROM d)),
first AS (SELECT g, MIN(doc_id) AS least FROM win GROUP BY g),
late AS (SELECT r, k FROM win JOIN first USING (g) WHERE least < doc_id),
gone AS (SELECT DISTINCT r, k + j AS p FROM late, range(0, 13) t(j)),
word AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (r, p) GROUP BY r),
cut AS (SELECT r, COUNT(*) AS n FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN cut USING (r) LEFT JOIN kept USING (r)"""

_REACH = """reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)"""

VECTORS = f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT vec_id, label, e, len(e) AS n FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: abs(x))) > 0),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM good p JOIN good q ON p.label = q.label AND p.n = q.n AND p.vec_id <> q.vec_id WHERE list_cosine_similarity(p.e, q.e) >= 0.98),
{_REACH},
least AS (SELECT a, MIN(b) AS m FROM reach GROUP BY a), number AS (SELECT a, COUNT(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id <= coalesce(m, vec_id) AS kept FROM v LEFT JOIN least ON vec_id = least.a LEFT JOIN number ON vec_id = number.a"""

_ESCAPED = "replace(replace({0}, '[', '[\\'), '<', '<\\')"
CHAT = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
o AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text), '') AS last,
  CASE role WHEN 'system' THEN length('[SYS] ') + length(' [/SYS]') + 1 WHEN 'user' THEN length('[INST] ') + length(' [/INST]') + 1 WHEN 'assistant' THEN length('[ANS] ') + length(' </s>') + 1
  ELSE length('[ROLE]') + length({_ESCAPED.format("role")}) + length('[/ROLE] ') + length(' [END]') + 1 END + length({_ESCAPED.format("text")}) AS size FROM c)
SELECT CAST(conv_id AS BIGINT) AS conv_id, COUNT(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
CAST(coalesce(SUM(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
CAST(SUM(size) AS BIGINT) AS formatted_chars, COUNT(*) FILTER (NOT ((last = '' AND role IN ('system', 'user')) OR (last = 'system' AND role = 'user') OR (last = 'user' AND role = 'assistant') OR (last = 'assistant' AND role = 'user'))) AS n_faults
FROM o GROUP BY conv_id"""

DECONTAMINATE = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_FOLDED}, {_ALNUM}) AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_FOLDED}, {_ALNUM}) AS w FROM benchmark WHERE item_id IS NOT NULL),
iw AS (SELECT DISTINCT item, n, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS k FROM (SELECT *, least(13, len(w)) AS n FROM i WHERE len(w) > 0))),
dw AS (SELECT r, n, k, array_to_string(w[k:k + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw))),
hit AS (SELECT r, k, dw.n AS n, item FROM dw JOIN iw ON dw.n = iw.n AND dw.g = iw.g),
places AS (SELECT r, COUNT(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, COUNT(*) AS n_items, string_agg(item, ',' ORDER BY item) AS t FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(t, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN items USING (r)"""

NEAR_DUPLICATES = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, {_BLANK_CUT}) AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) END)) AS g FROM d),
class AS (SELECT MIN(doc_id) AS c, g FROM s WHERE len(g) > 0 AND doc_id IS NOT NULL GROUP BY g),
one AS (SELECT c, len(g) AS n, unnest(g) AS x FROM class),
pair AS (SELECT p.c AS a, q.c AS b, COUNT(*) AS common, ANY_VALUE(p.n + q.n) AS total FROM one p JOIN one q ON p.x = q.x AND p.c <> q.c GROUP BY p.c, q.c),
links AS (SELECT a, b FROM pair WHERE 100 * common >= 85 * (total - common)),
{_REACH},
least AS (SELECT a, MIN(b) AS m FROM reach GROUP BY a),
own AS (SELECT class.g, least(class.c, coalesce(m, class.c)) AS k FROM class LEFT JOIN least ON class.c = least.a)
SELECT doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, coalesce(k, doc_id) AS component_id, doc_id = coalesce(k, doc_id) AS kept FROM s LEFT JOIN own ON s.g = own.g"""

ORACLES = {"op3_substrings": SUBSTRINGS, "op4_vectors": VECTORS, "op5_chat": CHAT, "op7_decontaminate": DECONTAMINATE, "op9_neardup": NEAR_DUPLICATES, "llm_secret_bases": SECRET_BASES}
