"""The library's functions for SQL users: temporary functions of a session, written in SQL, and table functions.

``register(spark)`` makes them; afterwards, for instance::

    SELECT lang, w.word, count(*) FROM corpus, LATERAL lex_word_rows(text) w GROUP BY ALL

============================== ============================================================================
lex_words(text)                the words of a text, in order
lex_word_rows(text)            table function: position, word
lex_quoted_segments(text)      the quoted segments, in order; marks of all kinds are folded
lex_quoted_rows(text)          table function: position, segment
lex_contains_<script>(text)    whether a character of the script's blocks occurs
lex_nonblank(text)             whether there is more than white space; false for null
lex_stripped(text)             text without white space around it
lex_static_entry(text)         an entry of a static list without its hyphens
lex_percentage(part, whole)    percent, two digits; 0 for a whole of 0
lex_chars_per_token(text, n)   characters per token, four digits; 0 for no token
============================== ============================================================================

Texts are taken as they are: normal forms (``functions.text.normalized``) are the caller's.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import quotes, text as T


def definitions(prefix: str = "lex_") -> dict[str, str]:
    """The statement that makes each function, by its name."""
    folded = f"translate(text, {quotes.literal(quotes.FOLD[0])}, {quotes.literal(quotes.FOLD[1])})"
    words = f"regexp_extract_all(text, {quotes.literal(T.WORD)}, 0)"
    segments = quotes.let("t", folded, quotes.segments_sql("t"))
    scalar = {
        "words(text STRING) RETURNS ARRAY<STRING>": words,
        "quoted_segments(text STRING) RETURNS ARRAY<STRING>": segments,
        "nonblank(text STRING) RETURNS BOOLEAN": quotes.nonblank_sql("text"),
        "stripped(text STRING) RETURNS STRING": quotes.stripped_sql("text"),
        "static_entry(text STRING) RETURNS STRING": "replace(text, '-', '')",
        "percentage(part DOUBLE, whole DOUBLE) RETURNS DOUBLE": "CASE WHEN whole = 0 THEN 0D ELSE round(part * 100D / whole, 2) END",
        "chars_per_token(text STRING, tokens BIGINT) RETURNS DOUBLE": "CASE WHEN tokens = 0 THEN 0D ELSE round(cast(length(text) AS DOUBLE) / cast(tokens AS DOUBLE), 4) END",
    }
    for script, ranges in T.SCRIPTS.items():
        blocks = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)
        scalar[f"contains_{script}(text STRING) RETURNS BOOLEAN"] = f"text rlike {quotes.literal(f'[{blocks}]')}"
    table = {
        "word_rows(text STRING) RETURNS TABLE(position INT, word STRING)": f"SELECT pos, col FROM posexplode({words})",
        "quoted_rows(text STRING) RETURNS TABLE(position INT, segment STRING)": f"SELECT pos, col FROM posexplode({segments})",
    }
    return {prefix + head.partition("(")[0]: f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{head} RETURN {body}" for head, body in (scalar | table).items()}


def register(spark: SparkSession, prefix: str = "lex_") -> list[str]:
    """Makes the functions in a session; their names."""
    made = definitions(prefix)
    for statement in made.values():
        spark.sql(statement)
    return list(made)
