r"""DuckDB SQL of the queries on conversations."""

from __future__ import annotations

from . import chat_format as C
from . import chat_repair as R

_PRICE = R.Costs()


def _crc32(text: str) -> str:
    """crc32 of an ASCII string, bit by bit."""
    bit = "lambda x, j: xor(x >> 1, (x & 1) * 3988292384)"
    byte = f"lambda c, b: list_reduce(range(8), {bit}, xor(c, b))"
    codes = f"list_transform(string_split({text}, ''), lambda h: CAST(unicode(h) AS BIGINT))"
    return f"xor(list_reduce({codes}, {byte}, CAST(4294967295 AS BIGINT)), 4294967295)"


def _escaped(text: str) -> str:
    return rf"regexp_replace(replace({text}, '\', '{C.SLASH}'), '{C.CONTROL}', '\\l\1', 'g')"


def formatting() -> str:
    conv, roles, text = C.PROBE
    probe = " UNION ALL ".join(f"SELECT {conv}, {i}, '{role}', '{text}'" for i, role in enumerate(roles))
    per = "PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text"
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL {probe}),
e AS (SELECT *, {_escaped("text")} AS et, {_escaped("role")} AS er, coalesce(role <> lag(role) OVER ({per}), true) AS fresh FROM c),
s AS (SELECT *, CASE WHEN fresh THEN {len(C.TURN + C.TEXT) + len(C.END) + 1} + length(er) ELSE {len(C.NEXT)} END + length(et) AS n FROM e)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = '{C.LEARNED}'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = '{C.LEARNED}'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars, CAST(count(*) FILTER (role = '{C.LEARNED}') AS BIGINT) AS n_loss_spans
FROM s GROUP BY conv_id"""


def _state(state: str) -> str:
    """The least of (cost, audit, text) that ends in a state after one more row x, from those of all states before it."""
    index = R.STATES.index
    deleted = f"{{'c': z[{index(state) + 1}].c + {_PRICE.delete}, 'a': z[{index(state) + 1}].a || 'D', 't': z[{index(state) + 1}].t}}"
    if not state:
        return deleted
    offers = [deleted]
    for before, puts in R.BETWEEN[state].items():
        z = f"z[{index(before) + 1}]"
        put = "".join(f"{R.ROLES[p]}:\n" for p in puts)
        cost = f"{z}.c + {len(puts) * _PRICE.insert} + CASE WHEN x.i = '{state}' THEN 0 ELSE {_PRICE.rerole if state in R.ROLES else 1 << 50} END + CASE WHEN x.f = {R.CUT} THEN {_PRICE.truncated} ELSE 0 END"
        role = f"CASE WHEN x.i = '{state}' THEN x.role ELSE '{R.ROLES.get(state, '')}' END"
        offers.append(f"{{'c': {cost}, 'a': {z}.a || '{'I' * len(puts)}' || CASE WHEN x.i = '{state}' THEN 'K' ELSE 'R' END, 't': {z}.t || '{put}' || {role} || ':' || x.text || chr(10)}}")
    return f"CASE WHEN x.f IN ({R.BLANK}, {R.REPEATED}) THEN {deleted} ELSE list_min([{', '.join(offers)}]) END"


def repair() -> str:
    space, per = r"\x20\x09-\x0D", "PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text"
    zero = ", ".join(f"{{'c': CAST({0 if not s else 1 << 50} AS BIGINT), 'a': '', 't': ''}}" for s in R.STATES)
    steps = ", ".join(_state(s) for s in R.STATES)
    ends = ", ".join(f"{{'c': last[{i + 1}].c + {len(R.LAST[s]) * _PRICE.insert}, 'a': last[{i + 1}].a || '{'I' * len(R.LAST[s])}', 't': last[{i + 1}].t || '{''.join(R.ROLES[p] + ':' + chr(10) for p in R.LAST[s])}'}}" for i, s in enumerate(R.STATES))
    legal = " OR ".join(f"(p = '{a}' AND i = '{b}')" for a, b in sorted(R.LEGAL))
    key = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    return f"""
WITH k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32(key)} % 20 AS fate FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE fate <> 0),
o AS (SELECT *, row_number() OVER ({per}) AS pos FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS nth, left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS p FROM o),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^{space}]') THEN {R.BLANK} WHEN nth > 1 THEN {R.REPEATED} WHEN NOT regexp_matches(text, '[.!?][{space}]*\\z') THEN {R.CUT} ELSE 0 END AS f FROM n),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = {R.BLANK}) AS blank, count(*) FILTER (f = {R.REPEATED}) AS duplicate, count(*) FILTER (f = {R.CUT}) AS truncated,
  count(*) FILTER (pos > 1 AND NOT coalesce({legal}, false)) AS illegal, list({{'i': i, 'f': f, 'role': role, 'text': text}} ORDER BY pos) AS turns FROM f GROUP BY conv_id),
z AS (SELECT *, list_reduce(turns, lambda z, x: [{steps}], [{zero}]) AS last FROM g),
b AS (SELECT *, list_min([{ends}]) AS b FROM z)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(b.b.c, 0) AS BIGINT) AS cost, coalesce(b.b.a, '') AS audit, sha256(CASE WHEN b.b.t IS NULL OR b.b.t = '' THEN '' ELSE left(b.b.t, length(b.b.t) - 1) END) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN b ON a.conv_id IS NOT DISTINCT FROM b.conv_id"""


TRIE = f"""
WITH o AS (SELECT conv_id, {_crc32("CAST(conv_id AS VARCHAR)")} % 6 AS h, list({{'k': sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 'c': length(coalesce(text, ''))}} ORDER BY turn NULLS FIRST) AS w FROM conversations GROUP BY conv_id),
r AS (SELECT o.conv_id, list_concat(coalesce(p.w[1:o.h], []), o.w[o.h + 1:]) AS w FROM o LEFT JOIN o p ON p.conv_id = o.conv_id - o.conv_id % 100),
m AS (SELECT conv_id, w, unnest(range(0, len(w) + 1)) AS depth FROM r),
n AS (SELECT list_transform(w[1:depth], lambda x: x.k) AS key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN depth = 0 THEN 0 ELSE w[depth].c END) AS chars,
  string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(w) = depth) AS ends FROM m GROUP BY ALL),
k AS (SELECT n.*, (SELECT count(*) FROM n x WHERE x.depth = n.depth + 1 AND x.key[1:n.depth] = n.key) AS n_children FROM n),
t AS (SELECT key[1:d] AS key, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * chars) AS saved FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM k) GROUP BY ALL)
SELECT k.conv_id, CAST(k.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(k.n_convs AS BIGINT) AS n_convs, CAST(k.n_children AS BIGINT) AS n_children, CAST(t.n_leaves AS BIGINT) AS n_leaves, CAST(t.saved AS BIGINT) AS saved_tokens, sha256(coalesce(k.ends, '')) AS ends_sha256
FROM k JOIN t ON t.key = k.key LEFT JOIN n p ON p.depth = k.depth - 1 AND p.key = k.key[1:k.depth - 1]"""
