"""Text functions: normalisation, segmentation into words, script tests, case and accent keys, blank tests."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .folding import casefold, strip_accents  # noqa: F401

#: Runs of letters; one apostrophe or hyphen between letters belongs to the word.
WORD = r"\p{L}+(?:['-]\p{L}+)*"
# The characters that Python's str.strip removes, and the code point ranges of the scripts.
WHITE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SCRIPTS = {"greek": ((0x0370, 0x03FF), (0x1F00, 0x1FFF)), "latin1": ((0x00C0, 0x00FF),)}
FORMS = ("none", "NFC", "NFKC")
#: Texts of these characters only are the same in every normal form.
_PLAIN = r"^[\x00-\x7f\u00c0-\u00ff]*$"
_APOSTROPHES = "’ʼ"


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def normalized(df: DataFrame, text: str, form: str = "NFKC") -> DataFrame:
    """df with its text in a normal form, typographic apostrophes made plain. Only texts that a normal form could change
    are sent to Python: in the column that it gets, all others are null."""
    if form not in FORMS:
        raise ValueError(f"normalization must be one of {', '.join(FORMS)}")
    if form != "none":
        udf = _nfc if form == "NFC" else _nfkc
        df = df.withColumn(text, F.coalesce(udf(F.when(~F.col(text).rlike(_PLAIN), F.col(text))), F.col(text)))
    return df.withColumn(text, F.translate(F.col(text), _APOSTROPHES, "''"))


def words(text: Column) -> Column:
    """The words of a text, in order."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def has_script(text: Column, script: str = "greek") -> Column:
    """Whether a character of the script's blocks occurs."""
    return text.rlike("[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in SCRIPTS[script]) + "]")


def case_key(word: Column) -> Column:
    """Case folding without Python: exact but for letters that fold to several others than sharp s."""
    return F.replace(F.replace(F.lower(word), F.lit("ς"), F.lit("σ")), F.lit("ß"), F.lit("ss"))


def nonblank(text: Column) -> Column:
    """Whether something but white space is there; false for null."""
    return F.coalesce(text.rlike(f"[^{WHITE}]"), F.lit(False))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{WHITE}]+|[{WHITE}]+$", "")


def lines(text: Column) -> Column:
    """The lines of a text at every line boundary that Python knows, without the last empty one."""
    parts = F.split(text, r"\r\n|[\n\x0b\f\r\x1c\x1d\x1e\x85\u2028\u2029]")
    return F.when(F.get(parts, F.size(parts) - 1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def percentage(part: Column, whole: Column) -> Column:
    """part of whole in percent, two digits (halves away from zero); 0 for a whole of 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part.cast("double") * F.lit(100.0) / whole.cast("double"), 2))


def chars_per_token(text: Column, tokens: Column) -> Column:
    return F.when(tokens == 0, F.lit(0.0)).otherwise(F.round(F.length(text).cast("double") / tokens.cast("double"), 4))
