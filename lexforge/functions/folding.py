"""Case folding and accent stripping as expressions of the engine.

Both are maps of single code points, to none, one or several others, built from the Unicode data that Python carries. What
maps to one or none is a ``translate``; code points that become several are replaced only in texts that hold one. Stripped
letters are composed again: what is left without its marks can compose anew only where conjoining Hangul letters or parts of
Indic vowel signs meet, which is done only in texts that hold such a second part. Non-spacing marks are gone by then,
so their canonical order doesn't matter; of other marks with an order (a handful of musical and tone signs) two in a
row keep theirs.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of Unicode: the ranges of conjoining Hangul letters (first, middle, last) and of the syllables.
_FIRST, _MIDDLE, _FINAL, _SYLLABLES = (0x1100, 19), (0x1161, 21), (0x11A7, 28), 0xAC00


def _bare(text: str) -> str:
    kept = [c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn"]
    return unicodedata.normalize("NFC", "".join(kept))


@cache
def _map(kind: str) -> tuple[str, str, dict[str, str]]:
    """Code points that become one or none, what they become, and those that become several."""
    of = {"case": str.casefold, "accents": _bare}[kind]
    one, none, several = [], [], {}
    for code in range(0x110000):
        if 0xD800 <= code < 0xE000:
            continue
        c = chr(code)
        to = of(c)
        if to == c:
            continue
        if len(to) == 1:
            one.append((c, to))
        elif to:
            several[c] = to
        else:
            none.append(c)
    return "".join(c for c, _ in one) + "".join(none), "".join(to for _, to in one), several


@cache
def _pairs() -> dict[str, str]:
    """Pairs of code points that compose although the second is no non-spacing mark, Hangul apart."""
    out = {}
    for code in range(0x110000):
        parts = unicodedata.decomposition(chr(code)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            pair = "".join(chr(int(p, 16)) for p in parts)
            if unicodedata.category(pair[1]) != "Mn" and unicodedata.category(pair[0]) != "Mn" and unicodedata.normalize("NFC", pair) == chr(code):
                out[pair] = chr(code)
    return out


def _class(characters) -> str:
    """A pattern's class of these characters, by ranges: a class of many single ones is tried one after the other."""
    spans = []
    for code in sorted({ord(c) for c in characters}):
        if spans and code == spans[-1][1] + 1:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in spans) + "]"


def _bound(value: Column, body) -> Column:
    """body(value) with value evaluated once: as an expression named several times it would be evaluated, and its plan be copied, for
    each of them, and once more for each at every further step."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: A text without one of these characters has no accents, and its case is the engine's own.
_OTHER = r"[^\x00-\x7f]"


def _mapped(text: Column, kind: str) -> Column:
    """text is bound: it is named several times."""
    given, to, several = _map(kind)
    mapped = F.translate(text, given, to)
    if several:
        # a text that holds one of these goes through by code points
        table = F.create_map(*[F.lit(x) for pair in several.items() for x in pair])
        each = F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda c: F.coalesce(F.try_element_at(table, c), c))
        mapped = F.when(text.rlike(_class(several)), F.translate(F.array_join(each, ""), given, to)).otherwise(mapped)
    return mapped


def _syllables(text: Column) -> Column:
    """text with its conjoining Hangul letters as syllables."""
    span = lambda r, skip=0: f"[\\x{{{r[0] + skip:X}}}-\\x{{{r[0] + r[1] - 1:X}}}]"
    whole = f"[\\x{{{_SYLLABLES:X}}}-\\x{{{_SYLLABLES + 11171:X}}}]"
    # the last letters' range begins one before its first letter
    parts = F.regexp_extract_all(text, F.lit(f"{span(_FIRST)}{span(_MIDDLE)}{span(_FINAL, 1)}?|{whole}{span(_FINAL, 1)}|(?s)."), F.lit(0))
    letters = F.lit("".join(chr(_SYLLABLES + i) for i in range(11172)))
    code = lambda t, at: F.ascii(F.substring(t, at, 1))
    pick = lambda i: F.substring(letters, i + 1, F.lit(1))

    def composed(t: Column) -> Column:
        final = lambda at: F.when(F.length(t) >= at, code(t, at) - _FINAL[0]).otherwise(0)
        of_letters = pick((code(t, 1) - _FIRST[0]) * (_MIDDLE[1] * _FINAL[1]) + (code(t, 2) - _MIDDLE[0]) * _FINAL[1] + final(3))
        of_syllable = F.when((code(t, 1) - _SYLLABLES) % _FINAL[1] == 0, pick(code(t, 1) - _SYLLABLES + final(2))).otherwise(t)
        return F.when(F.length(t) == 1, t).when(code(t, 1) < _SYLLABLES, of_letters).otherwise(of_syllable)

    return F.array_join(F.transform(parts, composed), "")


def casefold(text: Column) -> Column:
    """Full Unicode case folding."""
    return _bound(text, lambda t: F.when(t.rlike(_OTHER), _mapped(t, "case")).otherwise(F.lower(t)))


def _composed(text: Column) -> Column:
    """Bound text with the pairs composed that stripping can leave."""
    pairs = _pairs()
    # twice, as what a pair composes to can be the first of another
    table = F.array(*[F.struct(F.lit(p).alias("pair"), F.lit(to).alias("one")) for p, to in [*pairs.items(), *pairs.items()]])
    paired = F.aggregate(table, text, lambda t, p: F.replace(t, p["pair"], p["one"]))
    return F.when(text.rlike(_class(p[1] for p in pairs)), paired).otherwise(text)


def strip_accents(text: Column) -> Column:
    """text without its non-spacing marks, composed again."""
    second = f"[\\x{{{_MIDDLE[0]:X}}}-\\x{{{_FINAL[0] + _FINAL[1] - 1:X}}}]"
    syllables = lambda t: F.when(t.rlike(second), _syllables(t)).otherwise(t)
    bare = lambda t: _bound(_bound(_mapped(t, "accents"), _composed), syllables)
    return _bound(text, lambda t: F.when(t.rlike(_OTHER), bare(t)).otherwise(t))
