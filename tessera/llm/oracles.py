"""SQL for DuckDB of the operators that it can express, over the test table ``documents``."""

from __future__ import annotations

import math

from .quality import ACCURACY, FENCE, LEAST_FACTOR, PRIOR_ROWS

_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_DEDUP = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
ln AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM split),
keyed AS (SELECT *, translate(trim(line, {_SPACES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM ln),
often AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT k.doc_id, k.pos, k.line, o.key IS NOT NULL AND k.doc_id <> o.keeper AS gone FROM keyed k LEFT JOIN often o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

EXACT_DEDUP = """
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS len, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256 FROM documents),
k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY len DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k"""

_WIDTH = math.log((1 + ACCURACY) / (1 - ACCURACY))
_RULES = {
    "mean_word": "word_chars / n_words",
    "symbols": "n_symbols / n_words + 0.2::DOUBLE",
    "dup_lines": "n_dup_lines + 4.0::DOUBLE",
    "repeats": "n_repeat_words / n_words + 0.15::DOUBLE",
}
_VALUES = " UNION ALL ".join(
    f"SELECT doc_id, lang, source, base_failed, '{rule}' AS rule, ln({value}) AS x FROM m WHERE n_words > 0" for rule, value in _RULES.items()
)
_QUARTILES = f"""SELECT {{by}} rule, max(total) AS total, (min(bucket) FILTER (upto >= ceil(0.25 * total)) + 0.5) * {_WIDTH!r}::DOUBLE AS lo,
           (min(bucket) FILTER (upto >= ceil(0.75 * total)) + 0.5) * {_WIDTH!r}::DOUBLE AS hi
    FROM (SELECT *, sum(n) OVER (PARTITION BY {{by}} rule ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {{by}} rule) AS total
          FROM (SELECT {{by}} rule, floor(x / {_WIDTH!r}::DOUBLE) AS bucket, count(*) AS n FROM v WHERE NOT base_failed GROUP BY ALL)) GROUP BY ALL"""

QUALITY = f"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
g2 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM g),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g2 WHERE n > 1) GROUP BY doc_id),
d AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w)
      WHERE length(trim(line, {_SPACES})) > 0 GROUP BY doc_id),
b AS (SELECT w.doc_id, lang, source, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(d.n, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN r USING (doc_id) LEFT JOIN d USING (doc_id)),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
v AS ({_VALUES}),
own AS ({_QUARTILES.format(by="lang, source,")}),
every AS ({_QUARTILES.format(by="")}),
drawn AS (SELECT own.lang, own.source, own.rule, (own.total * own.lo + {PRIOR_ROWS}::DOUBLE * every.lo) / (own.total + {PRIOR_ROWS}::DOUBLE) AS lo,
                 (own.total * own.hi + {PRIOR_ROWS}::DOUBLE * every.hi) / (own.total + {PRIOR_ROWS}::DOUBLE) AS hi FROM own JOIN every USING (rule)),
cut AS (SELECT *, lo - greatest({FENCE}::DOUBLE * (hi - lo), ln({LEAST_FACTOR}::DOUBLE)) AS low, hi + greatest({FENCE}::DOUBLE * (hi - lo), ln({LEAST_FACTOR}::DOUBLE)) AS high FROM drawn),
out AS (SELECT v.doc_id, bool_or((v.rule = 'mean_word' AND x < low) OR x > high) AS far FROM v JOIN cut USING (lang, source, rule) GROUP BY v.doc_id)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(far, false) AS kept
FROM m LEFT JOIN out USING (doc_id)"""
