"""DuckDB SQL of the queries on shingles, rules, repeats and windows."""

from __future__ import annotations

from . import mix, sharding
from . import quality as Q

#: The size in words and the text's md5 of every document.
SIZED = r"sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(coalesce(text, '')) AS digest FROM documents),"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _terms(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"


DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, {_terms("text")} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_terms("text")} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[p:p + least(13, len(w)) - 1], ' ') AS win FROM i, range(1, 100000) r(p) WHERE p <= len(w) - least(13, len(w)) + 1),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT uid, n, p, array_to_string(w[p:p + n - 1], ' ') AS win FROM (SELECT uid, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT uid, p, n, item FROM dw JOIN iw USING (n, win)),
hit AS (SELECT uid, count(DISTINCT q) AS k FROM (SELECT DISTINCT uid, unnest(range(p, p + n)) AS q FROM m) GROUP BY uid),
its AS (SELECT uid, count(DISTINCT item) AS k, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM m GROUP BY uid),
x AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.k, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.k, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256 FROM d LEFT JOIN hit USING (uid) LEFT JOIN its USING (uid))
SELECT *, n_hit > 0 AND 20 * n_hit >= n_words AS contaminated FROM x
"""

_SP = r"[\x20\x09-\x0D]+"


def _classes() -> str:
    """Characters of each class, one after the other, as a list expression over coalesce(text, '')."""
    out, left = [], "t"
    for c in Q.CLASSES:
        pattern = c.replace("'", "''").replace("\\'", "'")
        rest = f"regexp_replace({left}, '{pattern}', '', 'g')"
        out.append(f"length({left}) - length({rest})")
        left = rest
    return f"[{', '.join(out)}, length({left})]"


_COMMON = ", ".join(f"len(list_filter(w, lambda x: x = '{c}'))" for c in Q.COMMON)


def _js(mine: str, ref: str, out: str) -> str:
    return f"""{out} AS (SELECT uid, sqrt(greatest(sum((CASE WHEN a > 0 THEN a * log2(a / ((a + b) / 2)) ELSE 0 END + CASE WHEN b > 0 THEN b * log2(b / ((a + b) / 2)) ELSE 0 END) / 2), 0)) AS js
  FROM (SELECT uid, CAST({mine}[j] AS DOUBLE) / nullif(list_sum({mine}), 0) AS a, CAST({ref}[j] AS DOUBLE) / nullif(list_sum({ref}), 0) AS b FROM c JOIN r USING (k), range(1, 60) g(j) WHERE j <= len({mine})) GROUP BY uid)"""


QUALITY = f"""
WITH s AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS t, coalesce('=' || lang, '') AS k, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
lines AS (SELECT uid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM s),
win AS (SELECT uid, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS x FROM (SELECT uid, w, unnest(range(1, len(w) - 1)) AS p FROM s WHERE len(w) >= 3)),
rep AS (SELECT uid, p FROM win QUALIFY count(*) OVER (PARTITION BY uid, x) > 1),
cov AS (SELECT uid, count(DISTINCT q) AS n FROM (SELECT uid, unnest([p, p + 1, p + 2]) AS q FROM rep) GROUP BY uid),
c0 AS (SELECT uid, k, t, [{_COMMON}] AS listed, len(w) AS n, {_classes()} AS cls FROM s),
c AS (SELECT uid, k, n, cls, list_append(listed, n - list_sum(listed)) AS com FROM c0),
ok AS (SELECT * FROM c WHERE n >= {Q.MIN_WORDS} AND cls[{Q.SYMBOL_CLASS + 1}] <= {Q.MAX_SYMBOLS} * list_sum(cls) AND cls[{Q.CAPITAL_CLASS + 1}] <= {Q.MAX_CAPITALS} * list_sum(cls)),
rc AS (SELECT k, list(v ORDER BY j) AS rcls FROM (SELECT k, j, sum(cls[j]) AS v FROM ok, range(1, {len(Q.CLASSES) + 2}) g(j) GROUP BY k, j) GROUP BY k),
rw AS (SELECT k, list(v ORDER BY j) AS rcom FROM (SELECT k, j, sum(com[j]) AS v FROM ok, range(1, {len(Q.COMMON) + 2}) g(j) GROUP BY k, j) GROUP BY k),
r AS (SELECT * FROM rc JOIN rw USING (k)),
{_js("cls", "rcls", "j1")},
{_js("com", "rcom", "j2")},
b AS (SELECT s.uid, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{_SP}', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '{Q.SYMBOLS}', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, k
  FROM s JOIN lines USING (uid) LEFT JOIN cov USING (uid)),
f AS (SELECT *, n_words < {Q.MIN_WORDS} OR 100 * n_repeat_words > {Q.MAX_REPEATED} * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(n_words >= {Q.MIN_DIVERGENT} AND list_sum(rcom) >= {Q.MIN_REFERENCE} AND (
    coalesce(j1.js, 0) > {Q.MAX_CLASS} + {Q.NOISE} / n_words AND coalesce(j2.js, 0) > {Q.MAX_COMMON}
    OR coalesce(j1.js, 0) > {Q.MAX_CLASS} + {Q.CLASS_ALONE} / n_words + {Q.MIXED} * (rcls[{Q.DIGIT_CLASS + 1}] + rcls[{Q.SYMBOL_CLASS + 1}]) / list_sum(rcls)
    OR coalesce(j2.js, 0) > {Q.MAX_COMMON} + {Q.COMMON_ALONE} / sqrt(n_words)), FALSE) AS kept
FROM f LEFT JOIN r USING (k) LEFT JOIN j1 USING (uid) LEFT JOIN j2 USING (uid)
"""

REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS x FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS p FROM d WHERE n >= 100)),
again AS (SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY x ORDER BY doc_id, p) > 1),
i AS (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS new FROM again),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM i),
s AS (SELECT doc_id, run, min(p) AS a, max(p) + 100 AS b FROM g GROUP BY doc_id, run),
t AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM s),
k AS (SELECT doc_id, count(*) AS spans, sum(b - a) AS removed, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS front, max(b) AS fin FROM t JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(fin, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""

def jaccard(width: int, percent: int) -> str:
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + least({width}, len(w)) - 1], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - {width - 2}))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b USING (x) JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= {percent} * (na.n + nb.n - count(*))),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(least(d.doc_id, coalesce(c.least, d.doc_id)) AS BIGINT) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id
"""


JACCARD = jaccard(3, 90)


def pipeline() -> str:
    """The five stages, each over what the one before kept."""
    over = lambda sql, name: sql.replace("FROM documents", f"FROM {name}")
    mixed = f"WITH {over(SIZED, 's3')}{mix.SQL}SELECT doc_id, times + CAST(extra AS BIGINT) AS copies FROM x{mix.FILLS} WHERE size > 0"
    shard = f"WITH docs AS (SELECT doc_id, text FROM s4), {sharding.SQL}SELECT DISTINCT doc_id, substr(lpad(bin(h), 60, '0'), 1, x.d) AS shard FROM f"
    return f"""
WITH s1 AS MATERIALIZED (SELECT o.* FROM documents o JOIN ({QUALITY}) q USING (doc_id) WHERE q.kept),
s2 AS MATERIALIZED (SELECT o.* FROM s1 o JOIN ({over(jaccard(5, 80), 's1')}) j USING (doc_id) WHERE j.component_id = o.doc_id),
s3 AS MATERIALIZED (SELECT o.* FROM s2 o JOIN ({over(DECONTAMINATION, 's2')}) c USING (doc_id) WHERE NOT c.contaminated),
m AS MATERIALIZED ({mixed}),
s4 AS MATERIALIZED (SELECT o.* FROM s3 o JOIN m USING (doc_id), range(0, 3) n(i) WHERE n.i < m.copies)
SELECT s4.*, shard FROM s4 JOIN ({shard}) USING (doc_id)
"""
