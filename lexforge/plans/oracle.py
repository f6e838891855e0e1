"""The catalogue's queries as DuckDB SQL."""

from __future__ import annotations

from ..operators import mixture as M

_WORDS = r"unnest(regexp_extract_all({t}, '\p{L}+(?:[''-]\p{L}+)*'))"


def _words(text: str = "text") -> str:
    return _WORDS.replace("{t}", text)


def _counts(source: str = "documents", by: str = "") -> str:
    """word, count over a relation with a column text."""
    cols = f"{by}, " if by else ""
    return f"SELECT {cols}w AS word, CAST(count(*) AS BIGINT) AS count FROM (SELECT {cols}{_words()} AS w FROM {source}) GROUP BY ALL"


_C = f"c AS ({_counts()})"
_LATIN = r"[\x{C0}-\x{FF}]"
_KEY = "replace(replace(lower(word), 'ς', 'σ'), 'ß', 'ss')"
_VOCAB = f"v0 AS ({_counts('benchmark')}), v AS (SELECT word AS token, CAST(row_number() OVER (ORDER BY word) - 1 AS INTEGER) AS id FROM v0)"
_F = f"{_C}, f AS (SELECT word, count FROM (SELECT * FROM c WHERE count >= 5 ORDER BY count DESC, word LIMIT 200000) WHERE length(word) BETWEEN 4 AND 40)"


def _collapse(source: str) -> str:
    best = "first(word ORDER BY CAST(word <> lower(word) AS INTEGER), count DESC, word)"
    return f"SELECT {best} AS word, CAST(sum(count) AS BIGINT) AS count, CAST(count(*) AS BIGINT) AS source_variant_count, string_agg(word || ':' || count, ',' ORDER BY count DESC, word) AS variants FROM {source} GROUP BY {_KEY}"


def _score(source: str, vocab: str = "v") -> str:
    n = f"CASE WHEN word IN (SELECT token FROM {vocab}) THEN 1 ELSE strlen(word) END"
    return f"SELECT *, CAST({n} AS INTEGER) AS base_token_count, CAST(greatest({n} - 1, 0) AS INTEGER) AS base_fragmentation, CAST(count * greatest({n} - 1, 0) AS BIGINT) AS utility_score FROM {source}"


_ENTRIES = "e AS (SELECT CASE WHEN length(token) % 3 = 0 THEN '-' || token ELSE token END AS raw, 'affixes.txt' AS file FROM v UNION ALL SELECT token, 'forced.txt' FROM v WHERE length(token) % 2 = 0)"
_GROUPS = _ENTRIES + ", g AS (SELECT replace(raw, '-', '') AS word, CAST(count(*) AS BIGINT) AS entry_count, string_agg(DISTINCT raw, ',' ORDER BY raw) AS raw_entries, string_agg(DISTINCT file, ',' ORDER BY file) AS source_files, CAST(count(DISTINCT raw) AS BIGINT) AS n_raw FROM e GROUP BY 1)"
_SPACED = "s AS (SELECT CASE WHEN id % 2 = 0 THEN ' ' || token ELSE token END AS decoded, id, token FROM v)"
_EXACT, _SHADOW = "already_present_as_exact_single_token", "would_shadow_existing_leading_space_single_token"
_PARTS = f"""p AS (SELECT n.token, n.position, CASE WHEN a.decoded IS NULL AND b.decoded IS NULL THEN 'add' ELSE 'skip' END AS action,
  CASE WHEN a.decoded IS NOT NULL THEN '{_EXACT}' WHEN b.decoded IS NOT NULL THEN '{_SHADOW}' END AS reason,
  coalesce(a.decoded, b.decoded) AS conflicting_token, CASE WHEN a.decoded IS NOT NULL THEN a.id ELSE b.id END AS conflicting_token_id
  FROM n LEFT JOIN s a ON n.token = a.decoded LEFT JOIN s b ON ' ' || n.token = b.decoded AND n.token NOT LIKE ' %')"""
_SELECTED = f"""WITH {_F}, {_VOCAB}, {_GROUPS}, fg AS ({_collapse('f')}), s AS ({_score('fg')}),
a AS (SELECT 0 AS section, word, ' ' || word AS token, count, 'corpus' AS source_type, '' AS static_source_files, source_variant_count, base_token_count, base_fragmentation, utility_score FROM s WHERE base_token_count >= 3 ORDER BY utility_score DESC, base_token_count DESC, count DESC, word LIMIT 5000),
gc AS (SELECT *, CAST(0 AS BIGINT) AS count FROM g WHERE word NOT IN (SELECT token FROM a)), gs AS ({_score('gc')}),
b AS (SELECT 1 AS section, word, word AS token, count, 'static' AS source_type, source_files AS static_source_files, n_raw AS source_variant_count, base_token_count, base_fragmentation, CAST(0 AS BIGINT) AS utility_score FROM gs)
SELECT *, CAST(row_number() OVER (PARTITION BY section ORDER BY utility_score DESC, base_token_count DESC, count DESC, word) AS INTEGER) AS place FROM (SELECT * FROM a UNION ALL SELECT * FROM b)"""
_NEW = f"n AS (SELECT token, min(section * 1000000 + place) AS position FROM ({_SELECTED}) GROUP BY token)"
_EXT = f"WITH {_VOCAB}, {_NEW}, {_SPACED}, {_PARTS}"


def _lang(lang: str) -> str:
    return f"SELECT DISTINCT w AS token FROM (SELECT {_words()} AS w FROM documents WHERE lang = '{lang}')"


_PAIR = f"a AS ({_lang('fr')}), b AS ({_lang('es')})"
_SCRIPT = f"fa AS ({_lang('fr')}), fb AS ({_lang('es')}), a AS (SELECT * FROM fa WHERE regexp_matches(token, '{_LATIN}')), b AS (SELECT * FROM fb WHERE regexp_matches(token, '{_LATIN}'))"


def _example(kind: str, own: str, other: str, within: bool) -> str:
    words = lambda lang: f"SELECT w AS token, CAST(count(*) AS BIGINT) AS id FROM (SELECT {_words()} AS w FROM documents WHERE lang = '{lang}') GROUP BY 1"
    return f"SELECT * FROM (SELECT '{kind}' AS kind, id, token AS raw, lower(token) AS decoded FROM ({words(own)}) WHERE token {'' if within else 'NOT '}IN (SELECT token FROM ({words(other)})) ORDER BY token LIMIT 100)"


def _pct(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} = 0 THEN 0.0 ELSE round(CAST({part} AS DOUBLE) * 100.0 / CAST({whole} AS DOUBLE), 2) END"


def _cpt(n: str) -> str:
    return f"CASE WHEN {n} = 0 THEN 0.0 ELSE round(CAST(length(text) AS DOUBLE) / CAST({n} AS DOUBLE), 4) END"


_BASE, _REFERENCE, _EXTENDED = "CAST(strlen(text) AS BIGINT)", "CAST(length(text) AS BIGINT)", "CAST(len(string_split(text, ' ')) AS BIGINT)"


def _minus(a: str, b: str, na: str, nb: str) -> str:
    return f"{a} - {b} AS {na}_minus_{nb}, {_pct(f'({a} - {b})', a)} AS {nb}_reduction_vs_{na}"


_TWO = f"{_BASE} AS base_tokens, {_REFERENCE} AS reference_tokens, {_cpt(_BASE)} AS base_chars_per_token, {_cpt(_REFERENCE)} AS reference_chars_per_token, {_minus(_BASE, _REFERENCE, 'base', 'reference')}"
_THREE = f"{_TWO}, {_EXTENDED} AS extended_tokens, {_cpt(_EXTENDED)} AS extended_chars_per_token, {_minus(_BASE, _EXTENDED, 'base', 'extended')}, {_minus(_EXTENDED, _REFERENCE, 'extended', 'reference')}"


def _mixture(stop: str, last: str) -> str:
    return f"""WITH r AS (SELECT doc_id, lang AS source, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k FROM documents WHERE lang IN ('en', 'fr')),
sz AS (SELECT source, count(*) AS n FROM r GROUP BY 1),
i0 AS (SELECT range AS i, CASE WHEN CAST('0x' || substr(md5('42:' || range), 1, 8) AS BIGINT) < {round(0.9 * 2**32)} THEN 'en' ELSE 'fr' END AS source FROM range(400 * (SELECT max(n) FROM sz))),
i1 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY i) AS k FROM i0),
e AS (SELECT {last}(i) AS i FROM i1 JOIN sz USING (source) WHERE k = n)
SELECT i1.i, r.doc_id, r.source FROM i1 JOIN sz USING (source) JOIN r ON r.source = i1.source AND r.k = (i1.k - 1) % n + 1 WHERE i1.i <= (SELECT i FROM e)"""


def _ids(what: str) -> str:
    code = "CAST('0x' || substr(hex(encode(text)), 2 * CAST(i AS INTEGER) - 1, 2) AS INTEGER)"
    n = "least(strlen(text), 256)"
    parts = {
        "input_ids": f"SELECT string_agg(CAST(CASE WHEN i <= {n} THEN {code} ELSE 0 END AS VARCHAR), ' ' ORDER BY i)",
        "attention_mask": f"SELECT string_agg(CASE WHEN i <= {n} THEN '1' ELSE '0' END, ' ' ORDER BY i)",
        "labels": f"SELECT string_agg(CASE WHEN i <= {n} THEN CAST({code} AS VARCHAR) ELSE '-100' END, ' ' ORDER BY i)",
    }
    return f"({parts[what]} FROM range(1, 257) r(i)) AS {what}"


def _plan(steps: dict, batch: tuple[int, int]) -> str:
    rows = []
    for phase, (n, rate, warm) in steps.items():
        log, save = (max(1, min(x, n)) for x in M.INTERVALS)
        rows.append(f"SELECT '{phase}' AS phase, CAST({n} AS BIGINT) AS max_steps, CAST({rate} AS DOUBLE) AS learning_rate, CAST({min(warm, n)} AS BIGINT) AS warmup_steps, CAST({batch[0] * batch[1] * 4} AS BIGINT) AS effective_batch, CAST({log} AS BIGINT) AS logging_steps, CAST({save} AS BIGINT) AS save_steps")
    return " UNION ALL ".join(rows)


def _section(name: str, n: str, pieces: str) -> str:
    return f"'**{name} tokenization**' || chr(10) || '```text' || chr(10) || coalesce(array_to_string(CASE WHEN {n} > 0 THEN {pieces} END, ' | '), '') || chr(10) || '```'"


def _rendered() -> str:
    byte = "CAST('0x' || substr(hex(encode(text)), 2 * CAST(i AS INTEGER) - 1, 2) AS INTEGER)"
    bytes_ = f"list_transform(range(1, strlen(text) + 1), lambda i: CASE WHEN {byte} < 128 THEN chr({byte}) ELSE chr(65533) END)"
    chars = "list_transform(range(1, length(text) + 1), lambda i: substr(text, CAST(i AS INTEGER), 1))"
    line = lambda n: f"'- {n}: ' || {n}_tokens || ' tokens, ' || printf('%.4f', {n}_chars_per_token) || ' characters per token'"
    less = "'- reference against base: ' || base_minus_reference || ' fewer, ' || printf('%.2f', reference_reduction_vs_base) || ' %'"
    parts = ["'### Sample ' || nth", "'> ' || text", line("base"), line("reference"), less, _section("base", "base_tokens", bytes_), _section("reference", "reference_tokens", chars)]
    rows = f"SELECT text, {_TWO}, CAST(row_number() OVER (ORDER BY conv_id, turn) AS INTEGER) AS nth FROM (SELECT * FROM conversations ORDER BY conv_id, turn LIMIT 20)"
    return f"SELECT nth, {' || chr(10) || '.join(parts)} AS markdown FROM ({rows})"


_QUOTED = r"""q AS (SELECT doc_id, list_transform(list_filter(regexp_extract_all(text, '"([^"\n]+)"', 1), lambda x: regexp_matches(x, '\S')), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS s FROM documents)"""
_QW = f"qw AS (SELECT w AS word, CAST(count(*) AS BIGINT) AS count FROM (SELECT {_words('x')} AS w FROM (SELECT unnest(s) AS x FROM q)) GROUP BY 1)"
# the words that get marks, with their places
_MARKED = r"""w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS x, generate_subscripts(regexp_extract_all(text, '[A-Za-z]+'), 1) - 1 AS i FROM documents),
m AS (SELECT doc_id, i, CASE WHEN i % 17 = 0 THEN x || ' ''' || x || ''' ' || x ELSE x END AS segment FROM w WHERE i % 17 = 0 OR i % 13 = 0 OR i % 11 = 0 OR i % 7 = 0)"""
_TALK = "t AS (SELECT conv_id * 1000 + turn AS position, text FROM conversations)"
_SAME_LINES = r"regexp_split_to_array(text, '\r\n|[\n\x0b\f\r\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]')"

_TAKEN = "x AS (SELECT word AS token FROM c WHERE count >= 5 ORDER BY count DESC, word LIMIT 200000)"

def _summary_lines(names: list[str]) -> str:
    label = {"base": "Base", "extended": "Extended", "reference": "Reference"}
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    between = lambda a, b, word: f"{label[a]} -> {label[b]} {word}" if len(names) > 2 else {"delta": "Token delta", "reduction": "Relative reduction"}[word]
    mean = lambda n: f"CASE WHEN samples = 0 THEN 0.0 ELSE round(CAST({n}_total AS DOUBLE) / CAST(samples AS DOUBLE), 4) END"
    lines = ["'Samples: ' || samples", *(f"'{label[n]} total tokens: ' || {n}_total" for n in names), *(f"'{between(a, b, 'delta')}: ' || ({a}_total - {b}_total)" for a, b in pairs)]
    lines += [f"'Avg {label[n]} tokens/sample: ' || {mean(n)}" for n in names]
    lines += [f"'{between(a, b, 'reduction')}: ' || {_pct(f'({a}_total - {b}_total)', f'{a}_total')} || '%'" for a, b in pairs]
    return " || chr(10) || ".join(lines)


def _totals(source: str) -> str:
    return f"SELECT CAST(count(*) AS BIGINT) AS samples, CAST(sum(strlen(text)) AS BIGINT) AS base_total, CAST(sum(length(text)) AS BIGINT) AS reference_total, CAST(sum(len(string_split(text, ' '))) AS BIGINT) AS extended_total FROM {source}"


SQL = {
    "word_count_topk": f"WITH {_C} SELECT * FROM c WHERE count >= 2 ORDER BY count DESC, word LIMIT 1000",
    "word_count_topk_pruned": f"WITH {_C} SELECT * FROM c WHERE count >= 2 ORDER BY count DESC, word LIMIT 1000",
    "word_count_having_pruned": f"WITH {_C} SELECT * FROM c WHERE count >= 5",
    "word_counts_all": _counts(),
    "word_count_by_lang": _counts(by="lang"),
    "word_count_script_filtered": f"WITH {_C} SELECT * FROM c WHERE regexp_matches(word, '{_LATIN}')",
    "word_count_min_length": f"WITH {_C} SELECT * FROM c WHERE length(word) >= 8",
    "word_count_having": f"WITH {_C} SELECT * FROM c WHERE count >= 5",
    "word_count_casefold": f"WITH {_C} SELECT {_KEY} AS word, CAST(sum(count) AS BIGINT) AS count FROM c GROUP BY 1",
    "word_count_strip_accents": f"WITH {_C} SELECT strip_accents(word) AS word, CAST(sum(count) AS BIGINT) AS count FROM c GROUP BY 1",
    "word_count_quality_filtered": _counts("(SELECT text FROM documents JOIN labels USING (doc_id) WHERE quality >= 1)"),
    "word_count_max_documents": _counts("(SELECT text FROM documents ORDER BY doc_id LIMIT 100)"),
    "word_count_stats": r"WITH x AS (SELECT len(list_filter(regexp_extract_all(text, '\p{L}+(?:[''-]\p{L}+)*'), lambda w: length(w) >= 4)) AS n FROM documents) SELECT CAST(count(*) AS BIGINT) AS documents_scanned, CAST(count(*) FILTER (n > 0) AS BIGINT) AS documents_counted, CAST(sum(n) AS BIGINT) AS total_words FROM x",
    "word_count_report": rf"""WITH w AS (SELECT doc_id, strip_accents({_KEY}) AS word FROM (SELECT doc_id, {_words()} AS word FROM documents)), k AS (SELECT * FROM w WHERE length(word) >= 4), n AS (SELECT word, count(*) AS count FROM k GROUP BY 1)
SELECT (SELECT CAST(count(*) AS BIGINT) FROM documents) AS documents_scanned, (SELECT CAST(count(DISTINCT doc_id) AS BIGINT) FROM k) AS documents_counted, CAST(count(*) AS BIGINT) AS unique_words, CAST(count(*) FILTER (count >= 5) AS BIGINT) AS exported_words, CAST(sum(count) AS BIGINT) AS total_words FROM n""",
    "unique_word_stats": f"WITH {_C} SELECT CAST(count(*) AS BIGINT) AS unique_words, CAST(count(*) FILTER (count >= 5) AS BIGINT) AS exported_words, CAST(sum(count) AS BIGINT) AS total_words FROM c",
    "word_count_merge": _counts("(SELECT text FROM documents UNION ALL SELECT text FROM conversations)"),
    "quoted_segments": f"WITH {_QUOTED} SELECT doc_id, CAST(i - 1 AS INTEGER) AS position, s[i] AS segment FROM q, range(1, len(s) + 1) r(i)",
    "quoted_word_topk": f"WITH {_QUOTED}, {_QW} SELECT * FROM qw ORDER BY count DESC, word LIMIT 1000",
    "quoted_word_preview": f"WITH {_QUOTED}, {_QW} SELECT * FROM qw ORDER BY count DESC, word LIMIT 25",
    "quoted_word_stats": f"WITH {_QUOTED} SELECT CAST(count(*) AS BIGINT) AS documents_scanned, CAST(count(*) FILTER (len(s) > 0) AS BIGINT) AS documents_with_quotes, CAST(sum(len(s)) AS BIGINT) AS total_segments, CAST(sum(len(list_filter(flatten(list_transform(s, lambda x: regexp_extract_all(x, '\\p{{L}}+(?:[''-]\\p{{L}}+)*'))), lambda w: true))) AS BIGINT) AS total_words FROM q",
    "quoted_segments_marked": f"WITH {_MARKED} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS position, segment FROM m",
    "quoted_word_stats_marked": f"WITH {_MARKED}, k AS (SELECT {_words('segment')} AS word FROM m) SELECT (SELECT CAST(count(*) AS BIGINT) FROM documents) AS documents_scanned, CAST(count(DISTINCT doc_id) AS BIGINT) AS documents_with_quotes, CAST(count(*) AS BIGINT) AS total_segments, (SELECT CAST(count(*) AS BIGINT) FROM k WHERE length(word) >= 4) AS total_words FROM m",
    "word_count_greek": rf"WITH g AS (SELECT translate(text, 'aeiou', 'αεηιο') AS text FROM documents), c AS ({_counts('g')}), k AS (SELECT strip_accents({_KEY}) AS word, count FROM c) SELECT word, CAST(sum(count) AS BIGINT) AS count FROM k WHERE regexp_matches(word, '[αεηιο]') GROUP BY 1",
    "sql_word_counts": _counts(),
    "sql_language_profile": rf"""WITH d AS (SELECT lang, text, regexp_extract_all(text, '\p{{L}}+(?:[''-]\p{{L}}+)*') AS words FROM documents),
n AS (SELECT lang, CAST(count(*) AS BIGINT) AS documents, CAST(sum(len(words)) AS BIGINT) AS words, CAST(sum(len(list_filter(words, lambda w: regexp_matches(w, '{_LATIN}')))) AS BIGINT) AS accented_words, CAST(count(*) FILTER (regexp_matches(text, '{_LATIN}')) AS BIGINT) AS accented_documents FROM d GROUP BY lang),
{_QUOTED}, s AS (SELECT lang, CAST(sum(len(s)) AS BIGINT) AS segments FROM q JOIN documents USING (doc_id) GROUP BY lang)
SELECT n.*, segments, {_pct("accented_words", "words")} AS accented_percent FROM n JOIN s USING (lang)""",
    "sql_quoted_words": f"WITH {_QUOTED}, {_QW} SELECT * FROM qw",
    "contains_script": rf"SELECT doc_id, regexp_matches(text, '{_LATIN}') AS latin1, regexp_matches(text, '[\x{{370}}-\x{{3FF}}\x{{1F00}}-\x{{1FFF}}]') AS greek, regexp_matches(text, '\S') AS nonblank FROM documents",
    "candidate_filter_reasons": f"WITH {_C} SELECT CASE WHEN length(word) < 4 THEN 'too_short' WHEN length(word) > 40 THEN 'too_long' WHEN NOT regexp_matches(word, '{_LATIN}') THEN 'other_script' ELSE 'kept' END AS reason, CAST(count(*) AS BIGINT) AS words FROM c GROUP BY 1",
    "case_variant_collapse": f"WITH {_C} {_collapse('c')}",
    "case_variant_stats": f"WITH {_C}, g AS ({_collapse('c')}) SELECT CAST(count(*) AS BIGINT) AS groups, CAST(count(*) FILTER (source_variant_count > 1) AS BIGINT) AS groups_with_variants, CAST(sum(source_variant_count - 1) AS BIGINT) AS merged_rows FROM g",
    "candidate_scores": f"WITH {_F}, {_VOCAB} {_score('f')}",
    "candidate_topk": f"WITH {_F}, {_VOCAB}, g AS ({_collapse('f')}), s AS ({_score('g')}) SELECT * EXCLUDE (variants), ' ' || word AS token FROM s WHERE base_token_count >= 3 ORDER BY utility_score DESC, base_token_count DESC, count DESC, word LIMIT 5000",
    "candidate_stats": f"WITH {_F}, {_VOCAB}, g AS ({_collapse('f')}), s AS ({_score('g')}) SELECT CAST(count(*) AS BIGINT) AS scored, CAST(count(*) FILTER (base_token_count < 3) AS BIGINT) AS below_threshold, CAST(count(*) FILTER (base_token_count >= 3) AS BIGINT) AS before_cap, CAST(least(count(*) FILTER (base_token_count >= 3), 5000) AS BIGINT) AS after_cap FROM s",
    "static_token_groups": f"WITH {_VOCAB}, {_GROUPS} SELECT word, entry_count, raw_entries, source_files FROM g",
    "static_token_stats": f"WITH {_VOCAB}, {_GROUPS} SELECT CAST(count(*) AS BIGINT) AS groups, CAST(sum(entry_count - 1) AS BIGINT) AS duplicates FROM g",
    "static_candidates": f"WITH {_C}, {_VOCAB}, {_GROUPS}, {_SPACED}, {_TAKEN} SELECT word, entry_count, CAST(CASE WHEN word IN (SELECT decoded FROM s) THEN 1 ELSE strlen(word) END AS INTEGER) AS base_token_count, CAST(0 AS BIGINT) AS utility_score FROM g WHERE word NOT IN (SELECT token FROM x)",
    "static_candidate_stats": f"WITH {_C}, {_VOCAB}, {_GROUPS}, {_SPACED}, {_TAKEN} SELECT CAST(count(*) AS BIGINT) AS input_groups, CAST(count(*) FILTER (word IN (SELECT decoded FROM s) OR strlen(word) = 1) AS BIGINT) AS exact_single_token_in_base, CAST(count(*) FILTER (word IN (SELECT token FROM x)) AS BIGINT) AS already_selected, CAST(count(*) FILTER (word NOT IN (SELECT token FROM x)) AS BIGINT) AS missing FROM g",
    "selected_tokens": _SELECTED,
    "token_partition": f"{_EXT} SELECT token, action, reason, conflicting_token, conflicting_token_id FROM p",
    "vocab_extension": f"{_EXT} SELECT token, CAST((SELECT max(id) FROM s) + row_number() OVER (ORDER BY position) AS INTEGER) AS id FROM p WHERE action = 'add'",
    "vocab_extension_stats": f"{_EXT}, x AS (SELECT (SELECT CAST(count(*) AS BIGINT) FROM s) AS initial_size, CAST(count(*) FILTER (action = 'add') AS BIGINT) AS added, CAST(count(*) FILTER (reason = '{_EXACT}') AS BIGINT) AS skipped_exact, CAST(count(*) FILTER (reason = '{_SHADOW}') AS BIGINT) AS skipped_shadow FROM p) SELECT *, initial_size + added AS final_size FROM x",
    "vocab_diff_summary": f"WITH {_SCRIPT}, x AS (SELECT (SELECT CAST(count(*) AS BIGINT) FROM fa) AS full_base_size, (SELECT CAST(count(*) AS BIGINT) FROM fb) AS full_reference_size, CAST(count(a.token) AS BIGINT) AS base_size, CAST(count(b.token) AS BIGINT) AS reference_size, CAST(count(*) FILTER (a.token IS NOT NULL AND b.token IS NOT NULL) AS BIGINT) AS common, CAST(count(*) FILTER (b.token IS NULL) AS BIGINT) AS only_base, CAST(count(*) FILTER (a.token IS NULL) AS BIGINT) AS only_reference FROM a FULL JOIN b ON a.token = b.token) SELECT *, {_pct('common', 'base_size')} AS common_percent_of_base, {_pct('common', 'reference_size')} AS common_percent_of_reference FROM x",
    "vocab_diff_examples": f"{_example('common', 'fr', 'es', True)} UNION ALL {_example('only_base', 'fr', 'es', False)} UNION ALL {_example('only_reference', 'es', 'fr', False)}",
    "vocab_common": f"WITH {_PAIR} SELECT token FROM a INTERSECT SELECT token FROM b",
    "vocab_only_base": f"WITH {_PAIR} SELECT token FROM a EXCEPT SELECT token FROM b",
    "vocab_only_reference": f"WITH {_PAIR} SELECT token FROM b EXCEPT SELECT token FROM a ORDER BY token LIMIT 100",
    "vocab_in_script": f"WITH {_VOCAB}, {_SPACED} SELECT token, id, decoded FROM s WHERE regexp_matches(decoded, '{_LATIN}')",
    "readable_vocab": f"WITH {_C}, x AS (SELECT word AS token, lower(word) AS decoded, CAST(count(*) OVER (PARTITION BY lower(word)) AS BIGINT) AS collisions FROM c), y AS (SELECT *, CASE WHEN collisions = 1 THEN decoded ELSE token END AS shown FROM x) SELECT *, count(*) OVER (PARTITION BY shown) > 1 AS clash FROM y",
    "source_length_histogram": f"WITH {_C} SELECT CAST(strlen(word) AS BIGINT) AS pieces, CAST(count(*) AS BIGINT) AS tokens FROM c GROUP BY 1",
    "token_input_stats": r"WITH x AS (SELECT text FROM conversations UNION ALL SELECT text FROM conversations) SELECT CAST(count(*) AS BIGINT) AS input_tokens, CAST(count(DISTINCT text) AS BIGINT) AS unique_tokens, CAST(count(*) - count(DISTINCT text) AS BIGINT) AS duplicate_tokens FROM x WHERE regexp_matches(text, '\S')",
    "embedding_mean_init": """WITH s AS (SELECT vec_id AS token_id, unnest([vec_id, vec_id + 1, vec_id + 3, vec_id + 3]) AS id FROM embeddings),
x AS (SELECT token_id, i - 1 AS dim, CAST(embedding[i] AS DOUBLE) AS v FROM s JOIN embeddings e ON e.vec_id = s.id, range(1, len(embedding) + 1) r(i))
SELECT token_id, CAST(dim AS INTEGER) AS dim, round(avg(v), 6) AS value FROM x GROUP BY 1, 2""",
    "compare_samples_2way": f"SELECT conv_id, turn, {_TWO} FROM conversations",
    "compare_samples_3way": f"SELECT doc_id, {_THREE} FROM documents",
    "compare_summary_rendered": f"SELECT CAST(2 AS INTEGER) AS tokenizers, {_summary_lines(['base', 'reference'])} AS text FROM ({_totals('conversations')}) UNION ALL SELECT CAST(3 AS INTEGER), {_summary_lines(['base', 'extended', 'reference'])} FROM ({_totals('documents')})",
    "compare_summary": f"""WITH x AS (SELECT CAST(count(*) AS BIGINT) AS samples, CAST(sum(strlen(text)) AS BIGINT) AS base_total, CAST(sum(length(text)) AS BIGINT) AS reference_total, CAST(sum(len(string_split(text, ' '))) AS BIGINT) AS extended_total FROM documents)
SELECT *, round(CAST(extended_total AS DOUBLE) / CAST(samples AS DOUBLE), 4) AS extended_mean_tokens, {_minus('base_total', 'extended_total', 'base', 'extended')}, {_minus('extended_total', 'reference_total', 'extended', 'reference')}, round(CAST(base_total AS DOUBLE) / CAST(samples AS DOUBLE), 4) AS base_mean_tokens, round(CAST(reference_total AS DOUBLE) / CAST(samples AS DOUBLE), 4) AS reference_mean_tokens, {_minus('base_total', 'reference_total', 'base', 'reference')} FROM x""",
    "compare_rendered": _rendered(),
    "first_seen_samples": f"WITH {_TALK}, u AS (SELECT * FROM t UNION ALL SELECT position + 1000000000, '  ' || text FROM t) SELECT trim(text, ' \t\n') AS text, min(position) AS position FROM u GROUP BY 1",
    "parsed_samples": rf"WITH x AS (SELECT doc_id, {_SAME_LINES} AS s FROM documents) SELECT doc_id, CAST(i - 1 AS INTEGER) AS position, s[i] AS line FROM x, range(1, len(s) + 1) r(i) WHERE regexp_matches(s[i], '\S')",
    "mixture_interleave_first_exhausted": _mixture("first_exhausted", "min"),
    "mixture_interleave_all_exhausted": _mixture("all_exhausted", "max"),
    "encode_truncate_pad": f"SELECT item_id AS doc_id, {_ids('input_ids')}, {_ids('attention_mask')} FROM benchmark",
    "causal_labels": f"SELECT item_id AS doc_id, {_ids('labels')} FROM benchmark",
    "run_plan_coverage": f"""WITH p AS (SELECT *, 'production' AS run FROM ({_plan(M.STEPS, M.BATCH)}) UNION ALL SELECT *, 'smoke' AS run FROM ({_plan(M.SMOKE_STEPS, M.SMOKE_BATCH)})), n AS (SELECT CAST(count(*) AS BIGINT) AS examples FROM documents WHERE regexp_matches(text, '\\S'))
SELECT p.*, examples, CAST(ceil(examples / effective_batch) AS BIGINT) AS steps_per_epoch, max_steps * effective_batch AS examples_seen, round(CAST(max_steps * effective_batch AS DOUBLE) / examples, 4) AS epochs FROM p, n""",
    "run_plan": _plan(M.STEPS, M.BATCH),
    "run_plan_smoke": _plan(M.SMOKE_STEPS, M.SMOKE_BATCH),
    "streaming_word_count": _counts(),
}
