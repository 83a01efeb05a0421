"""DuckDB SQL for those queries that SQL can express.

The others need a tokenizer, a fitted model, a pseudorandom permutation, a
sketch or a reading of markup; tests hold them against brute force.
"""

from __future__ import annotations

from tessera.llm.quality import RULES, STOP_WORDS

_WORDS = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _near_duplicates() -> str:
    text = f"translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}')"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text)} AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS grams FROM w),
g AS (SELECT doc_id, unnest(grams) AS gram FROM s),
n AS (SELECT doc_id, len(grams) AS n FROM s),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
root AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN root ON a = doc_id"""


def _quality_rules() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws}))
    passes = []
    for r in RULES:
        fits = [f"CAST({r.measure} AS DOUBLE) >= CAST({r.low} AS DOUBLE) * {r.per}"] * (r.low is not None)
        fits += [f"CAST({r.measure} AS DOUBLE) <= CAST({r.high} AS DOUBLE) * {r.per}"] * (r.high is not None)
        passes.append(f"(n_words < {r.from_words} OR ({' AND '.join(fits)}))")
    return rf"""
WITH w AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
win AS (SELECT k, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT k, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
again AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM win) WHERE c > 1),
cover AS (SELECT k, count(DISTINCT i + d.range) AS c FROM again, range(0, 5) d GROUP BY k),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c, 0) AS BIGINT) AS n_repeat_words,
  length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclamations, len(ls) AS n_lines, len(list_filter(ws, lambda x: x IN ({stop}))) AS n_stop_words
  FROM l LEFT JOIN cover USING (k)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(passes)} AS kept FROM b"""


def _chat_formatting() -> str:
    hard = r"\### Assistant: </turn> ok"
    marks = ("<turn>", "<says>", "</turn>")
    grown = lambda c: " + ".join([f"length({c})", rf"length({c}) - length(replace({c}, '\', ''))", *[f"(length({c}) - length(replace({c}, '{m}', ''))) // {len(m)}" for m in marks]])
    order = "ORDER BY turn NULLS FIRST, role, text"
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{hard}' UNION ALL SELECT -7, 1, 'assistant', '{hard}'),
t AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' {order}) AS said,
  coalesce(string_agg(text, '' {order}) FILTER (WHERE role = 'assistant'), '') AS loss,
  CAST(sum({sum(map(len, marks)) + 1} + {grown("role")} + {grown("text")}) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM t"""


ORACLE_SQL: dict[str, str] = {
    "op5_minhash_near_dedup": _near_duplicates(),
    "op7_chat_formatting": _chat_formatting(),
    "op9_quality_rules": _quality_rules(),
}
