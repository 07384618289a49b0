"""SQL for DuckDB of the pN_ queries that SQL can express."""

from __future__ import annotations

import unicodedata

from siltstone.llm import lookalike
from siltstone.plans.texts import BPE

_BEST = r"""
WITH usable AS (
  SELECT lower(regexp_replace(dataset, '^[\s\x{00a0}]+|[\s\x{00a0}]+$', '', 'g')) AS dataset, test_id, corpus_id, max(score) AS score
  FROM annotation
  WHERE corpus_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) AND score BETWEEN 0 AND 1
  GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY dataset, test_id ORDER BY score DESC, corpus_id) AS rank FROM usable)
"""

_TEXTS = r"""
texts AS (
  SELECT corpus_id, regexp_extract_all(lower(max(corpus_text)), '[\p{L}\p{N}]+') AS ws
  FROM annotation WHERE corpus_id IS NOT NULL AND corpus_text IS NOT NULL GROUP BY corpus_id)
"""


def _run(n: int, at: str = "i") -> str:
    return f"array_to_string(list_slice(ws, {at}, {at} + {n - 1}), ' ')"




def _looks() -> str:
    """(doc_id, form) of each document with a visible character. Composed letters go by a table of their own, since SQL only composes."""
    groups = [[m for m in g if len(m) == 1] for g in lookalike.classes(lookalike.look_alike_pairs())]
    least = {m: g[0] for g in groups for m in g[1:]}
    table = dict(least)
    for ch in map(chr, range(0xC0, 0x2000)):
        apart = unicodedata.normalize("NFD", ch)
        if len(apart) > 1 and apart[0] in least:
            table[ch] = unicodedata.normalize("NFC", least[apart[0]] + apart[1:])
    table = {a: b for a, b in table.items() if len(b) == 1}
    quoted = lambda t: "'" + "".join(t).replace("'", "''") + "'"
    # NUL would end a string here; another control character stands for it
    text = f"regexp_replace(nfc_normalize(replace(text, chr(0), chr(1))), '[\\p{{Cf}}{lookalike.WIDTHLESS}]', '', 'g')"
    for spelled, joined in lookalike.compatible_pairs():
        text = f"replace({text}, {quoted(joined)}, {quoted(spelled)})" if len(spelled) > 1 else text
    form = f"nfc_normalize(translate({text}, {quoted(table)}, {quoted(table.values())}))"
    return f"WITH looks AS MATERIALIZED (SELECT doc_id, text, {form} AS form FROM documents WHERE text IS NOT NULL AND regexp_matches({form}, '[^\\p{{Z}}\\p{{Cc}}]'))"


# Problem 3: the verdicts of each pair, then rounds of leave-one-out accuracies against the others' weighted vote; 400 rounds are far beyond settling.
_YES, _NO = "('true', 't', 'yes', 'y', '1')", "('false', 'f', 'no', 'n', '0')"
_VERDICTS = f"""
WITH RECURSIVE given AS (
  SELECT pair_id, arg_max(is_sd, annotation_id) FILTER (is_sd IS NOT NULL) AS l, arg_max(checker_is_sd, annotation_id) FILTER (checker_is_sd IS NOT NULL) AS c
  FROM annotation WHERE pair_id IS NOT NULL GROUP BY pair_id),
sound AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id, rater_id ORDER BY labelled_at DESC NULLS LAST, label_id DESC) AS k
  FROM rater_label WHERE trim(coalesce(error, '')) = '' AND pair_id IS NOT NULL AND rater_id IS NOT NULL),
rated AS (
  SELECT pair_id, 'rater ' || rater_id AS a, CASE WHEN lower(trim(coalesce(is_sd, ''))) IN {_YES} THEN true WHEN lower(trim(coalesce(is_sd, ''))) IN {_NO} THEN false
    WHEN trim(coalesce(is_sd, '')) = '' AND trim(coalesce(match_type, '')) <> '' THEN lower(trim(match_type)) <> 'unrelated' END AS d
  FROM sound WHERE k = 1),
votes AS MATERIALIZED (
  SELECT pair_id, 'label' AS a, l AS d FROM given WHERE l IS NOT NULL UNION ALL SELECT pair_id, 'checker', c FROM given WHERE c IS NOT NULL UNION ALL FROM rated WHERE d IS NOT NULL),
shape AS (SELECT pair_id, list({{'a': a, 'd': d}} ORDER BY a) AS p FROM votes GROUP BY pair_id HAVING count(*) > 1),
kinds AS (SELECT p, row_number() OVER () AS kind, count(*) AS n FROM shape GROUP BY p),
cast_ AS MATERIALIZED (SELECT kind, n, v.a AS a, v.d AS d FROM (SELECT kind, n, unnest(p) AS v FROM kinds)),
fit AS (
  SELECT DISTINCT a, 0.7::DOUBLE AS acc, 0 AS i FROM cast_
  UNION ALL
  SELECT a, greatest(0.02, least(0.98, (sum(n * slope * (agrees - 1 + q)) + 2.8) / (sum(n * slope * slope) + 4))), any_value(i) + 1
  FROM (
    SELECT *, 2 * q - 1 AS slope FROM (
      SELECT a, n, i, greatest(o1, o0) AS top, 1 / (exp(o1 - greatest(o1, o0)) + exp(o0 - greatest(o1, o0))) AS q, CASE WHEN (o1 > o0) = d THEN 1 ELSE 0 END AS agrees
      FROM (
        SELECT a, n, i, d, sum(CASE WHEN d THEN w ELSE 0 END) OVER (PARTITION BY kind) - CASE WHEN d THEN w ELSE 0 END AS o1,
          sum(CASE WHEN d THEN 0 ELSE w END) OVER (PARTITION BY kind) - CASE WHEN d THEN 0 ELSE w END AS o0
        FROM (SELECT c.*, i, ln(acc / (1 - acc)) AS w FROM cast_ c JOIN fit USING (a) WHERE i < 400))))
  GROUP BY a),
annotators AS (SELECT a, count(*) AS n, coalesce(any_value(acc), 0.7) AS acc FROM votes LEFT JOIN (FROM fit WHERE i = 400) USING (a) GROUP BY a),
items AS (
  SELECT pair_id, count(*) AS n, count_if(d) AS yes, sum(CASE WHEN d THEN ln(acc / (1 - acc)) ELSE 0 END) AS s1, sum(CASE WHEN d THEN 0 ELSE ln(acc / (1 - acc)) END) AS s0
  FROM votes JOIN (SELECT a, acc FROM annotators) USING (a) GROUP BY pair_id),
decided AS (SELECT *, CASE WHEN s1 > s0 THEN 'duplicate' WHEN s0 > s1 THEN 'distinct' END AS label FROM items)
"""

ORACLE = {
    "p1_found": _BEST + "SELECT dataset, test_id, corpus_id FROM ranked WHERE rank <= 10",
    "p1_ranked": _BEST + "SELECT dataset, test_id, corpus_id, score, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 10",
    "p2_found": r"""
SELECT record_id
FROM raw_record r JOIN chunking_config c ON c.dataset_short_name = r.dataset_short_name
  AND c.mode = CASE WHEN coalesce(trim(r.mode), '') = '' THEN 'paragraph' ELSE lower(trim(r.mode)) END
WHERE len(regexp_extract_all(text, '[^ \t\r\n]+')) > max_tokens""",
    "p2_rejoined": r"""
SELECT record_id, CAST(coalesce(len(regexp_extract_all(text, '[^ \t\r\n]+')), 0) AS BIGINT) AS n_tokens, true AS sound, md5(text) AS text_hash
FROM raw_record r JOIN chunking_config c ON c.dataset_short_name = r.dataset_short_name
  AND c.mode = CASE WHEN coalesce(trim(r.mode), '') = '' THEN 'paragraph' ELSE lower(trim(r.mode)) END""",
    "p3_found": _VERDICTS + "SELECT pair_id FROM decided WHERE n >= 3 AND label = 'duplicate' AND pair_id IN (SELECT pair_id FROM rater_label)",
    "p3_consensus": _VERDICTS + "SELECT pair_id, label, n, round(CASE label WHEN 'duplicate' THEN yes WHEN 'distinct' THEN n - yes ELSE 0 END / n::DOUBLE, 6) AS agreement, round(1 / (1 + exp(-abs(s1 - s0))), 6) AS posterior FROM decided",
    "p3_annotators": _VERDICTS + "SELECT a AS annotator, n, round(acc, 4) AS accuracy FROM annotators",
    "p3_agreement": _VERDICTS + """,
rated_items AS (SELECT n, yes, n - yes AS no FROM items WHERE n > 1),
t AS (SELECT count(*) AS items, CAST(coalesce(sum(n), 0) AS BIGINT) AS verdicts, sum((n * (n - 1) - yes * (yes - 1) - no * (no - 1)) / (n - 1)::DOUBLE) AS d, sum(yes)::DOUBLE AS y, sum(no)::DOUBLE AS o FROM rated_items)
SELECT items, verdicts, round(d / verdicts, 9) AS observed, round(2 * y * o / (verdicts::DOUBLE * (verdicts - 1)), 9) AS expected, round(1 - (d / verdicts) / (2 * y * o / (verdicts::DOUBLE * (verdicts - 1))), 9) AS alpha FROM t""",
    "p5_found": f"""
WITH {_TEXTS},
runs AS (SELECT DISTINCT corpus_id, unnest([{_run(3)} FOR i IN range(1, len(ws) - 1)]) AS g FROM texts WHERE len(ws) >= 3),
sizes AS (SELECT corpus_id, count(*) AS n FROM runs GROUP BY corpus_id),
common AS (SELECT a.corpus_id AS x, b.corpus_id AS y, count(*) AS c FROM runs a JOIN runs b USING (g) WHERE a.corpus_id < b.corpus_id GROUP BY 1, 2)
SELECT x AS corpus_id_a, y AS corpus_id_b
FROM common JOIN sizes p ON p.corpus_id = x JOIN sizes q ON q.corpus_id = y, dedup_config
WHERE c::DOUBLE / (p.n + q.n - c) >= minhash_threshold""",
    "p5_groups": f"""
WITH RECURSIVE {_TEXTS},
runs AS MATERIALIZED (SELECT DISTINCT corpus_id, unnest([{_run(3)} FOR i IN range(1, len(ws) - 1)]) AS g FROM texts WHERE len(ws) >= 3),
kinds AS (SELECT corpus_id, md5(array_to_string(list_sort(list(g)), '|')) AS k FROM runs GROUP BY corpus_id),
classes AS (SELECT k, min(corpus_id) AS class_id FROM kinds GROUP BY k),
own AS MATERIALIZED (SELECT corpus_id, g FROM runs WHERE corpus_id IN (SELECT class_id FROM classes)),
sizes AS (SELECT corpus_id, count(*) AS n FROM own GROUP BY corpus_id),
common AS (SELECT a.corpus_id AS x, b.corpus_id AS y, count(*) AS c FROM own a JOIN own b USING (g) WHERE a.corpus_id <> b.corpus_id GROUP BY 1, 2),
linked AS MATERIALIZED (SELECT x, y FROM common JOIN sizes p ON p.corpus_id = x JOIN sizes q ON q.corpus_id = y, dedup_config WHERE c::DOUBLE / (p.n + q.n - c) >= minhash_threshold),
reached AS (SELECT class_id AS a, class_id AS b FROM classes UNION SELECT a, y FROM reached JOIN linked ON b = x),
roots AS (SELECT a AS class_id, min(b) AS group_id FROM reached GROUP BY a),
degrees AS (SELECT x AS class_id, count(*) AS links FROM linked GROUP BY x)
SELECT corpus_id, class_id, group_id, coalesce(links, 0) AS links FROM kinds JOIN classes USING (k) JOIN roots USING (class_id) LEFT JOIN degrees USING (class_id)""",
    "p6_found": rf"""
WITH {_TEXTS},
items AS (SELECT test_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS ws FROM benchmark_item WHERE text IS NOT NULL),
short AS (SELECT test_id, i, {_run(8)} AS g FROM (SELECT test_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM items)),
shared AS (SELECT g FROM short GROUP BY g HAVING count(DISTINCT test_id) > 1),
taken AS (SELECT test_id, i FROM short WHERE g IN (FROM shared)),
wide AS (SELECT test_id, i, {_run(13)} AS g FROM (SELECT test_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM items)),
good AS (SELECT DISTINCT w.test_id, w.g FROM wide w WHERE NOT EXISTS (FROM taken t WHERE t.test_id = w.test_id AND t.i BETWEEN w.i AND w.i + 5)),
windows AS (SELECT DISTINCT corpus_id, {_run(13)} AS g FROM (SELECT corpus_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM texts))
SELECT DISTINCT corpus_id, test_id FROM windows JOIN good USING (g)""",
}

_WIDE = rf"""
items AS MATERIALIZED (SELECT test_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS ws FROM benchmark_item WHERE text IS NOT NULL),
short AS (SELECT test_id, i, {_run(8)} AS g FROM (SELECT test_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM items)),
shared AS (SELECT g FROM short GROUP BY g HAVING count(DISTINCT test_id) > 1),
taken AS (SELECT test_id, i FROM short WHERE g IN (FROM shared)),
wide AS MATERIALIZED (SELECT test_id, i, list_slice(ws, i, i + 12) AS w FROM (SELECT test_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM items) x
  WHERE NOT EXISTS (FROM taken t WHERE t.test_id = x.test_id AND t.i BETWEEN x.i AND x.i + 5))"""
# Of a window's three parts two edits leave one unchanged, at most two words away; then the words, written as letters, are compared by Levenshtein's distance.
ORACLE["p6_exact"] = rf"""
WITH {_TEXTS}, {_WIDE},
parts AS (SELECT test_id, i, a, array_to_string(w[a + 1:a + n], ' ') AS g FROM wide, (VALUES (0, 4), (4, 4), (8, 5)) v(a, n)),
grams AS (SELECT corpus_id, q, array_to_string(ws[q:q + n - 1], ' ') AS g FROM (SELECT corpus_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS q FROM texts, (VALUES (4), (5)) v(n))),
near AS (SELECT DISTINCT corpus_id, q - a - move AS p, test_id, i FROM grams JOIN (SELECT DISTINCT * FROM parts) USING (g), range(-2, 3) m(move)),
spelled AS (
  SELECT corpus_id, p, test_id, w, ws[p:p + 14] AS t, list_distinct(list_concat(w, ws[p:p + 14])) AS alphabet
  FROM near JOIN texts USING (corpus_id) JOIN wide USING (test_id, i) WHERE p >= 1 AND p <= len(ws) - 12),
letters AS (SELECT corpus_id, p, test_id, array_to_string([chr(64 + list_position(alphabet, x)) FOR x IN w], '') AS a, array_to_string([chr(64 + list_position(alphabet, x)) FOR x IN t], '') AS b FROM spelled),
measured AS (SELECT corpus_id, p, test_id, list_min([levenshtein(a, b[1:n]) FOR n IN range(11, 16)]) AS edits FROM letters),
named AS (SELECT corpus_id, min(lower(regexp_replace(dataset, '^[\s\x{{00a0}}]+|[\s\x{{00a0}}]+$', '', 'g'))) AS dataset FROM annotation WHERE corpus_text IS NOT NULL GROUP BY 1)
SELECT corpus_id, test_id, CAST(min(edits) AS INTEGER) AS edits, count(DISTINCT p) AS windows, any_value(dataset) AS dataset
FROM measured JOIN named USING (corpus_id) WHERE edits <= 2 GROUP BY 1, 2"""
ORACLE["p7_digests"] = BPE + "SELECT doc_id, CAST(coalesce(len(ids), 0) AS INTEGER) AS n_tokens, md5(coalesce(array_to_string(ids, ','), '')) AS digest FROM documents LEFT JOIN tokens USING (doc_id)"
# Sources in the order in which the budget fills them up: the first k are full and the rest gets its weight's share of what they leave.
ORACLE["p8_plan"] = BPE + r""",
sizes AS (SELECT replace(lower(regexp_replace(source, '^\s+|\s+$', '', 'g')), '-', '_') AS source, coalesce(len(ids), 0) AS n FROM documents LEFT JOIN tokens USING (doc_id)),
have AS (SELECT source, CAST(sum(n) AS BIGINT) AS n FROM sizes GROUP BY source),
goals AS (
  SELECT mix_name, replace(lower(regexp_replace(t.source, '^\s+|\s+$', '', 'g')), '-', '_') AS source, greatest(coalesce(weight, 0), 0) AS w, greatest(coalesce(max_repeats, 1), 0) AS r, budget_share * (SELECT sum(n) FROM sizes) AS budget
  FROM mixture_target t),
caps AS (SELECT mix_name, g.source, w, budget, coalesce(n, 0) AS n, coalesce(n, 0) * r AS cap FROM goals g LEFT JOIN have h ON h.source = g.source),
filled AS (
  SELECT *, cap / w AS ratio, row_number() OVER o AS k, (budget - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM caps WHERE w > 0 WINDOW o AS (PARTITION BY mix_name ORDER BY cap / w, source)),
levels AS (SELECT mix_name, arg_min(level, k) AS level FROM filled WHERE level < ratio GROUP BY mix_name)
SELECT mix_name, source, n AS available_tokens, round(budget, 3) AS budget_tokens, round(w / nullif(sum(w) OVER (PARTITION BY mix_name), 0) * budget, 3) AS target_tokens,
  round(CASE WHEN w > 0 THEN least(cap, w * coalesce(level, 1e300)) ELSE 0 END, 3) AS allotted_tokens, true AS near, true AS capped
FROM caps LEFT JOIN levels USING (mix_name)"""
ORACLE["p9_found"] = _looks() + " SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM looks a JOIN looks b USING (form) WHERE a.doc_id < b.doc_id AND a.text <> b.text"
ORACLE["p9_classes"] = _looks() + " SELECT doc_id, min(doc_id) OVER w AS class_id, links FROM looks JOIN (SELECT form, count(DISTINCT text) - 1 AS links FROM looks GROUP BY form) USING (form) WINDOW w AS (PARTITION BY form)"


def oracle_sql() -> dict[str, str]:
    return ORACLE
