"""SQL, in DuckDB's dialect, of the operators that SQL can express on whole tables."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: Windows of items meet the windows of the same number of words at each place of each document.
CONTAMINATION = f"""
WITH b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS name, {WORDS} AS w FROM benchmark),
pat AS (SELECT DISTINCT name, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win, least(len(w), 10) AS m FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS} AS w FROM documents),
places AS (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d),
hits AS (SELECT rid, i, s.m, name FROM (SELECT rid, i, sz.m, array_to_string(w[i:i + sz.m - 1], ' ') AS win FROM places, (SELECT DISTINCT m FROM pat) sz WHERE i + sz.m - 1 <= len(w)) s JOIN pat ON s.m = pat.m AND s.win = pat.win),
covered AS (SELECT DISTINCT rid, p FROM (SELECT rid, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT rid, i, m FROM hits))),
runs AS (SELECT rid, min(p) - 1 AS lo, max(p) AS hi FROM (SELECT rid, p, p - row_number() OVER (PARTITION BY rid ORDER BY p) AS g FROM covered) GROUP BY rid, g),
cov AS (SELECT rid, CAST(sum(hi - lo) AS BIGINT) AS n, string_agg(concat(lo, '-', hi), ',' ORDER BY lo) AS spans FROM runs GROUP BY rid),
it AS (SELECT rid, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT rid, name FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(cov.n, 0) AS n_hit, coalesce(it.n, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(cov.n, 0) > 0 AS contaminated, coalesce(spans, '') AS word_spans
FROM d LEFT JOIN cov USING (rid) LEFT JOIN it USING (rid)"""

CONTROL = r"\[/?INST\]|<</?SYS>>|</?s>|\[AS |\[/AS\]"
CHAT = f"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN len(text) ELSE 0 END) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn), '')) AS loss_sha256,
  CAST(sum(len(text) + len(regexp_extract_all(text, '{CONTROL}')) + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 17 ELSE 9 END) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""

#: Bytes are pairs of hexadecimal digits; every window of 100 bytes is numbered by (document, start) among those alike.
DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS i FROM d)),
f AS (SELECT k, min((doc_id, i)) AS first, count(*) AS n FROM w GROUP BY k HAVING count(*) > 1),
gone AS (SELECT doc_id, i FROM w JOIN f USING (k) WHERE (doc_id, i) <> first),
runs AS (SELECT doc_id, min(i) AS lo, max(i) + 100 AS hi FROM (SELECT *, sum(CASE WHEN i > p + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM gone)) GROUP BY doc_id, g),
keep AS (SELECT doc_id, list(lo ORDER BY lo) AS los, list(hi ORDER BY lo) AS his, sum(hi - lo) AS removed, count(*) AS n FROM runs GROUP BY doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans,
  sha256(CASE WHEN n IS NULL THEN unhex(h) ELSE unhex(array_to_string(list_transform(range(0, n + 1), lambda j: substr(h, 2 * (CASE WHEN j = 0 THEN 0 ELSE his[j] END) + 1, 2 * ((CASE WHEN j = n THEN len(h) // 2 ELSE los[j + 1] END) - (CASE WHEN j = 0 THEN 0 ELSE his[j] END)))), '')) END) AS kept_sha256
FROM d LEFT JOIN keep USING (doc_id)"""

#: Units are code points, so cuts are plain substrings.
FILL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
h AS (SELECT *, CAST(length(t) AS BIGINT) AS n, CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2, CAST('0x' || s[17:24] AS BIGINT) AS h3, CAST('0x' || s[25:32] AS BIGINT) AS h4 FROM t),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
o AS (SELECT *, substring(t, 1, lo) AS p, substring(t, lo + 1, hi - lo) AS m, substring(t, hi + 1, n - hi) AS x FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN concat('<P>', p, '<S>', x, '<M>', m) WHEN 'spm' THEN concat('<S>', x, '<P>', p, '<M>', m) ELSE t END) AS output_sha256, sha256(t) AS restored_sha256
FROM o"""

EXACT = """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS h FROM documents),
w AS (SELECT *, row_number() OVER r AS k, first_value(doc_id) OVER r AS keep_id, count(*) OVER (PARTITION BY h) AS n FROM d WINDOW r AS (PARTITION BY h ORDER BY chars DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, n AS group_size, k = 1 AS kept, h AS text_sha256 FROM w"""


def _assigned(name: str, book: str) -> str:
    """(vec_id, p, e, d) of the nearest entry of each part, as a table expression; the lower entry on ties."""
    pairs = f"SELECT x.vec_id, x.p, b.e, sum((x.v - b.v) * (x.v - b.v)) AS d FROM x JOIN {book} b ON x.p = b.p AND x.i = b.i GROUP BY ALL"
    return f"{name} AS MATERIALIZED (SELECT vec_id, p, min({{'d': d, 'e': e}}).e AS e, min(d) AS d FROM ({pairs}) GROUP BY ALL)"


def _moved(name: str, book: str, found: str) -> str:
    """The codebook after a round: means rounded down, unused entries as they were."""
    return f"{name} AS MATERIALIZED (SELECT b.p, b.e, b.i, coalesce(m.v, b.v) AS v FROM {book} b LEFT JOIN (SELECT x.p, a.e, x.i, CAST((sum(x.v) - ((sum(x.v) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT) AS v FROM x JOIN {found} a ON x.vec_id = a.vec_id AND x.p = a.p GROUP BY ALL) m ON b.p = m.p AND b.e = m.e AND b.i = m.i)"


CODES = f"""
WITH kept AS (SELECT vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda v: v IS NULL OR NOT isfinite(v)))),
x AS MATERIALIZED (SELECT vec_id, (k - 1) // w AS p, (k - 1) % w AS i, CAST(floor(256 * CAST(v AS DOUBLE)) AS BIGINT) AS v FROM (SELECT vec_id, len(embedding) // 16 AS w, unnest(embedding) AS v, unnest(range(1, len(embedding) + 1)) AS k FROM kept)),
b0 AS MATERIALIZED (SELECT p, e, i, v FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)) USING (vec_id)),
{_assigned("a0", "b0")}, {_moved("b1", "b0", "a0")}, {_assigned("a1", "b1")}, {_moved("b2", "b1", "a1")}, {_assigned("a2", "b2")},
s AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, e, i)) AS h FROM b2),
c AS (SELECT vec_id, string_agg(printf('%02x', CAST(e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM c JOIN kept USING (vec_id) CROSS JOIN s"""

SQL = {
    "op1_fm_index_decontamination": CONTAMINATION, "op3_chat_round_trip": CHAT, "op9_suffix_dedup": DEDUP, "op11_fill_in_middle": FILL, "op12_exact_dedup": EXACT, "op13_hamerly_codes": CODES,
}
