"""Independent SQL (DuckDB) for the registered queries that SQL can express."""

from __future__ import annotations

CHAT_TOOL_LINKS = r"""
WITH calls AS (
  SELECT conv_id, turn, min(text) AS text FROM conversations WHERE role = 'user' AND text IS NOT NULL GROUP BY ALL
), results AS (
  SELECT conv_id, turn, min(text) AS text FROM conversations WHERE role = 'assistant' AND text IS NOT NULL GROUP BY ALL
), both_sides AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.turn, r.turn) AS turn, coalesce(c.turn, r.turn - 1) AS id,
         CASE WHEN c.turn IS NULL THEN 'orphan' WHEN r.turn IS NULL THEN 'unanswered' ELSE 'answered' END AS status,
         c.turn AS call_turn, c.text AS prompt, r.text AS result
  FROM calls c FULL JOIN results r ON c.conv_id = r.conv_id AND c.turn = r.turn - 1
)
SELECT conv_id, turn, 'turn-' || id AS call_id, status, CAST(status = 'orphan' AS BIGINT) AS n_errors,
       lpad(CAST(turn AS VARCHAR), 12, '0') || '.00000000.00000000.' || lpad(CAST(turn AS VARCHAR), 12, '0') || '.00000000' AS order_key,
       CAST(json_object(
         'after', CASE WHEN call_turn IS NULL THEN NULL WHEN call_turn >= 2 THEN ['turn-' || (call_turn - 2)] ELSE CAST([] AS VARCHAR[]) END,
         'arguments', CASE WHEN call_turn IS NOT NULL THEN json_object('prompt', prompt, 'turn', call_turn) END,
         'conv_id', conv_id, 'errors', CASE WHEN status = 'orphan' THEN ['orphan'] ELSE CAST([] AS VARCHAR[]) END, 'id', 'turn-' || id,
         'name', CASE WHEN call_turn IS NOT NULL THEN 'answer' END, 'result', result, 'status', status, 'turn', turn) AS VARCHAR) AS line
FROM both_sides
"""

URL_FILTERS = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), fitting AS (
  SELECT page_id, rule_host || rule_path AS rule, rule_verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host) DESC, length(rule_path) DESC) AS place
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT p.page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fitting f ON f.page_id = p.page_id AND place = 1
"""

NGRAM_JOIN = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, k, k + 4), ' ') AS s
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS k FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)
), both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON b.x = r.y
), least AS (SELECT x, min(y) AS y FROM reach GROUP BY 1)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(y, w.doc_id)) AS component_id
FROM words w LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON least.x = w.doc_id
"""

DECONTAMINATION = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), phrases AS (
  SELECT DISTINCT item_id, array_to_string(list_slice(w, k, k + 12), ' ') AS phrase, least(len(w), 13) AS size
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS k FROM item_words WHERE len(w) > 0)
), doc_words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), sizes AS (SELECT DISTINCT size FROM phrases),
windows AS (
  SELECT doc_id, size, k, array_to_string(list_slice(w, k, k + size - 1), ' ') AS phrase
  FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS k FROM doc_words, sizes WHERE len(w) >= size)
), found AS (
  SELECT doc_id, k, w.size, item_id FROM windows w JOIN phrases p ON p.phrase = w.phrase AND p.size = w.size
), hit AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + size - 1)) AS place FROM found) GROUP BY 1
), runs AS (
  SELECT doc_id, place, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS grp
  FROM (SELECT DISTINCT doc_id, unnest(generate_series(k, k + size - 1)) AS place FROM found)
), spans AS (
  SELECT doc_id, string_agg(a || ':' || b, ',' ORDER BY a) AS removal_spans
  FROM (SELECT doc_id, grp, min(place) - 1 AS a, max(place) AS b FROM runs GROUP BY 1, 2) GROUP BY 1
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY 1
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(joined, '')) AS items_sha256,
       coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated, coalesce(removal_spans, '') AS removal_spans
FROM doc_words d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN spans USING (doc_id)
"""


# CRC-32 of the text t, bit by bit.
_CRC32 = """xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(({t})) + 1), lambda i: ord(({t})[i])::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)))"""

PREFIX_TRIE = f"""
WITH own AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS p,
         coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
), ids AS (
  SELECT c, c - c % 100 AS base, {_CRC32.format(t="c::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT c FROM own)
), turns AS (
  SELECT ids.c, own.p, own.r, own.x FROM ids JOIN own ON own.c = ids.base AND own.p < ids.h
  UNION ALL
  SELECT ids.c, own.p + 1000000, own.r, own.x FROM ids JOIN own ON own.c = ids.c AND own.p >= ids.h
), walked AS (
  SELECT c, 0 AS d, '' AS path, 0 AS chars, count(p) FILTER (p IS NOT NULL) AS size FROM ids LEFT JOIN turns USING (c) GROUP BY c
  UNION ALL
  SELECT c, row_number() OVER w AS d, string_agg(len(r) || ':' || r || len(x) || ':' || x, '' ) OVER w AS path, len(x), count(*) OVER (PARTITION BY c)
  FROM turns WINDOW w AS (PARTITION BY c ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), parented AS (
  SELECT *, lag(path) OVER (PARTITION BY c ORDER BY d) AS above FROM walked
), nodes AS (
  SELECT path, min(above) AS above, min(d) AS d, min(c) AS c, count(*) AS n, min(chars) AS chars,
         string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = size) AS ends FROM parented GROUP BY path
), children AS (SELECT above AS path, count(*) AS k FROM nodes WHERE d > 0 GROUP BY 1),
below AS (
  SELECT a.path, sum((k IS NULL)::INT) AS leaves, sum((b.n - 1) * b.chars) AS saved
  FROM nodes a JOIN nodes b ON b.d >= a.d AND starts_with(b.path, a.path) LEFT JOIN children k ON k.path = b.path GROUP BY 1
)
SELECT n.c AS conv_id, n.d::BIGINT AS depth, p.c AS parent_conv_id, n.n AS n_convs, coalesce(k, 0)::BIGINT AS n_children,
       leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM nodes n JOIN below USING (path) LEFT JOIN children k USING (path) LEFT JOIN nodes p ON p.path = n.above AND n.d > 0
"""

_TREE_LEVELS = 6  # 16 ** 6 rows a source


def _merkle() -> str:
    """Trees level by level; a tree of one node stays as it is."""
    field = "coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(field.format(c=c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [f"""docs AS (
  SELECT row_number() OVER () AS rid, doc_id, source, {leaf('text')} AS leaf,
         CASE WHEN {_CRC32.format(t="doc_id::VARCHAR")} % 5 = 0 THEN {leaf(lowered)} END AS tampered FROM documents
)"""]

    def levels(name: str, start: str) -> None:
        parts.append(f"{name}0 AS ({start})")
        for k in range(_TREE_LEVELS):
            parts.append(f"""{name}r{k} AS MATERIALIZED (
  SELECT tree, i // 16 AS i, list(h ORDER BY i) AS run, max(n) AS n FROM {name}{k} GROUP BY tree, i // 16
), {name}{k + 1} AS MATERIALIZED (
  SELECT tree, i, CASE WHEN n = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS h, count(*) OVER (PARTITION BY tree) AS n FROM {name}r{k}
)""")

    levels("s", """SELECT source AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS i, leaf AS h,
         count(*) OVER (PARTITION BY source) AS n, rid FROM docs""")
    levels("t", f"""SELECT 0 AS tree, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS i, h, count(*) OVER () AS n, tree AS source FROM s{_TREE_LEVELS}""")
    before, previous = "", "w"
    parts.append("""w AS (
  SELECT s0.rid, s0.tree AS source, s0.i AS i, t0.i AS ti, '' AS beside, coalesce(tampered, leaf) AS f FROM s0 JOIN docs USING (rid) JOIN t0 ON t0.source IS NOT DISTINCT FROM s0.tree
)""")
    for name, place, match in (("s", "i", "r.tree IS NOT DISTINCT FROM w.source AND"), ("t", "ti", "")):
        for k in range(_TREE_LEVELS):
            step = f"w{name}{k}"
            left = f"array_to_string(run[1:w.{place} % 16], '')"
            right = f"array_to_string(run[w.{place} % 16 + 2:], '')"
            moved = f"w.i // 16 AS i, ti" if name == "s" else "w.i, ti // 16 AS ti"
            parts.append(f"""{step} AS MATERIALIZED (
  SELECT rid, source, {moved}, CASE WHEN n = 1 THEN beside ELSE beside || {left} || {right} END AS beside,
         CASE WHEN n = 1 THEN f ELSE sha256({left} || f || {right}) END AS f
  FROM {previous} w JOIN {name}r{k} r ON {match} r.i = w.{place} // 16
)""")
            previous = step
    return "WITH " + ",\n".join(parts) + f"""
SELECT doc_id, leaf, s.h AS subroot, t.h AS root, sha256(beside) AS proof_sha256, f AS folded_root, f = t.h AS verified
FROM docs JOIN {previous} w USING (rid) JOIN s{_TREE_LEVELS} s ON s.tree IS NOT DISTINCT FROM docs.source, t{_TREE_LEVELS} t
"""


MERKLE_MANIFEST = _merkle()

LINE_DEDUP = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT rid, doc_id, unnest(l) AS line, unnest(generate_series(1, len(l))) AS place FROM docs),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), shared AS (
  SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT coalesce(doc_id::VARCHAR, 'none')) >= 3
), told AS (
  SELECT k.*, s.key IS NOT NULL AND coalesce(doc_id < top, true) AS gone FROM keyed k LEFT JOIN shared s USING (key)
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM told GROUP BY rid
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_tool_links": CHAT_TOOL_LINKS,
        "op2_ngram_jaccard_join": NGRAM_JOIN,
        "op3_url_filters": URL_FILTERS,
        "op10_decontamination": DECONTAMINATION,
        "op11_conversation_prefix_trie": PREFIX_TRIE,
        "op12_merkle_manifest": MERKLE_MANIFEST,
        "op13_line_dedup": LINE_DEDUP,
    }
