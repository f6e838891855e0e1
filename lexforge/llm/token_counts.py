"""Token counts by prefix dynamic programming over a sentencepiece BPE vocabulary.

The library only reads the model: its pieces and their scores. Texts are never encoded.

Recurrence. The last token of a prefix is the one piece that may stand after the last token of the shorter prefix that it
leaves, and two pieces may stand side by side if merging what they spell, best score first and leftmost of equals, ends
in just these two. So one pass over a text gives the exact token count of every prefix, in constant time for each
character (``Prefixes.inside``). Whether a pair may stand is found once and kept.

No piece of such a vocabulary has a word mark after another character, so no merge crosses the place where a run of word
marks begins. A text is cut there into segments, whose tables are found once for each distinct segment and added up. Where only
a segment's whole count is asked for, the recurrence is asked from its end (``_last``), which leaves out prefixes that no piece needs.

The table of a text (``prefix_table``) answers how many tokens any prefix has (``tokens_of``) and where a budget ends
(``truncated``) in plain SQL, without encoding and without the library.

Cases. Null and empty texts have no tokens, and a table of the one number 0. Repeated documents are counted one by one; no
ties arise, as the last piece is unique. A text of any length is one row: its table takes four bytes a character. Empty
tables give empty results. Columns other than id and text aren't read, so their names don't matter.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

LIMIT = 4096
#: Segments whose tables a worker keeps, those of which it keeps the token count alone, and the longest of both; pairs of pieces that it keeps.
KEPT, SIZES, LONGEST, PAIRS = 100_000, 2_000_000, 64, 500_000
_SEGMENT = re.compile(r" +[^ ]*")


class Prefixes:
    """Exact token counts of prefixes under one sentencepiece BPE model without normalisation rules."""

    def __init__(self, model: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        m = self.model
        ids = [i for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
        self.pieces = {m.id_to_piece(i).replace("▁", " "): m.get_score(i) for i in ids}
        if any(re.search(r"[^ ] ", p) for p in self.pieces):
            raise ValueError("a piece of this model has a word mark after another character; segments can't be cut there")
        self.lines = not any("\n" in p and len(p) > 1 for p in self.pieces)
        # lengths of the pieces that end in two characters, the longest first
        found: dict[str, set] = {}
        for p in self.pieces:
            if len(p) > 1:
                found.setdefault(p[-2:], set()).add(len(p))
        self.widths = {end: sorted(n, reverse=True) for end, n in found.items()}
        self.known: dict[str, list[int]] = {}
        self.sizes: dict[str, int] = {}  # tokens of segments of one space, without it
        self.fits: dict[tuple[str, str], bool] = {}

    @staticmethod
    def segments(text: str) -> list[str]:
        """Runs of spaces with what follows them; the library puts one space before any text."""
        return _SEGMENT.findall(" " + text.replace("▁", " ")) if text else []

    def spelled(self, text: str) -> list[str]:
        """The pieces of a short string, by merging: the best score first, the leftmost of equals."""
        out = list(text)
        while True:
            scores = [(self.pieces[p], -i) for i, p in enumerate(map("".join, zip(out, out[1:]))) if p in self.pieces]
            if not scores:
                return out
            i = -max(scores)[1]
            out[i : i + 2] = [out[i] + out[i + 1]]

    def _follows(self, left: str, right: str) -> bool:
        """Whether the pair of pieces (or the right one alone) stays as it is when what it spells is encoded."""
        ok = self.spelled(left + right) == ([left, right] if left else [right])
        if len(self.fits) >= PAIRS:
            self.fits.clear()
        self.fits[left, right] = ok
        return ok

    def inside(self, segment: str) -> list[int]:
        """Tokens of each prefix of a segment, by its length in characters, from 0 on."""
        if (out := self.known.get(segment)) is not None:
            return out
        count, last = [0], [""]  # last: the last piece of each prefix; none after bytes, which never merge
        pieces, fits, widths = self.pieces, self.fits, self.widths
        for i in range(1, len(segment) + 1):
            for width in (*widths.get(segment[i - 2 : i], ()), 1) if i > 1 else (1,):
                if width > i:
                    continue
                piece = segment[i - width : i]
                if piece in pieces:
                    before = last[i - width]
                    ok = fits.get((before, piece))
                    if self._follows(before, piece) if ok is None else ok:
                        count.append(count[i - width] + 1)
                        last.append(piece)
                        break
            else:  # a character outside the vocabulary: its bytes
                count.append(count[i - 1] + len(segment[i - 1].encode()))
                last.append("")
        if len(segment) <= LONGEST and len(self.known) < KEPT:
            self.known[segment] = count
        return count

    def _last(self, segment: str, i: int, found: dict[int, tuple[str, int]]) -> tuple[str, int]:
        """The last piece of a prefix of a short segment and its tokens: the recurrence asked for one prefix, which asks for those that a
        piece may leave. found: those known."""
        pieces, fits = self.pieces, self.fits
        for width in (*self.widths.get(segment[i - 2 : i], ()), 1) if i > 1 else (1,):
            if width > i:
                continue
            piece = segment[i - width : i]
            if piece in pieces:
                before = found.get(i - width) or self._last(segment, i - width, found)
                ok = fits.get((before[0], piece))
                if self._follows(before[0], piece) if ok is None else ok:
                    out = piece, before[1] + 1
                    break
        else:  # a character outside the vocabulary: its bytes
            before = found.get(i - 1) or self._last(segment, i - 1, found)
            out = "", before[1] + len(segment[i - 1].encode())
        found[i] = out
        return out

    def ends(self, words) -> dict[str, int]:
        """Tokens of each of a set of words (``words``)."""
        out = {}
        for word in words:
            segment = word if word[0] == "\n" else " " + word
            out[word] = self._last(segment, len(segment), {0: ("", 0)})[1] if len(segment) <= LONGEST else self.inside(segment)[-1]
        return out

    def words(self, text: str) -> list[str] | None:
        """The segments of a text without their space, if single spaces part them; where no piece holds a line feed and more, a line
        feed begins a segment of its own."""
        text = text.replace("▁", " ")
        words = (text.replace("\n", " \n") if self.lines else text).split(" ")
        return None if "" in words else words

    def measured(self, texts: list[str], limit: int) -> list[tuple[int, int]]:
        """Tokens of each text, and the characters of its longest prefix with at most limit tokens. Each word of all texts is looked up or
        found once."""
        each = [self.words(t) if t else [] for t in texts]
        here: set[str] = set()
        for words in each:
            here.update(words or ())
        new = self.ends(here.difference(self.sizes))
        # a table of these texts' words alone is small enough to stay near the processor
        known, sizes = self.sizes, {}
        for w in here:
            sizes[w] = n if (n := known.get(w)) is not None else new[w]
        if len(known) + len(new) > SIZES:
            known.clear()  # frequent words are soon back
        known.update((w, n) for w, n in new.items() if len(w) < LONGEST)
        get, out = sizes.__getitem__, []
        for words, text in zip(each, texts, strict=True):
            if words is None:
                segments = self.segments(text)
                counts = self.counts(segments)
            else:
                counts = list(map(get, words))
            n = sum(counts)
            if n > limit and words is not None:
                segments = [w if w[0] == "\n" else " " + w for w in words]
            out.append((n, self._within(segments, counts, limit) if n > limit else len(text)))
        return out

    def total(self, text: str) -> int:
        return self.measured([text], len(text) * 8)[0][0]

    def counts(self, segments: list[str]) -> list[int]:
        """Tokens of each segment: the ends of their tables."""
        known, inside = self.known, self.inside
        return [known[s][-1] if s in known else inside(s)[-1] for s in segments]

    def table(self, text: str) -> np.ndarray:
        """Tokens of each prefix of a text, by its length in characters, from 0 on."""
        out = np.zeros(len(text) + 1, np.int64)
        at = done = 0
        for k, segment in enumerate(self.segments(text)):
            own = self.inside(segment)
            own = own[1:] if k else own[2:]  # the first space of all is not the text's
            out[at + 1 : at + 1 + len(own)] = np.array(own, np.int64) + done
            at += len(own)
            done = int(out[at])
        return out

    def _within(self, segments: list[str], counts: list[int], limit: int) -> int:
        """Characters of the longest prefix with at most limit tokens, of a text that has more."""
        ends = np.cumsum(counts)
        k = int(np.searchsorted(ends, limit, side="right"))
        whole = sum(map(len, segments[:k])) - 1  # the first space of all is not the text's
        left = limit - (int(ends[k - 1]) if k else 0)
        own = self.inside(segments[k])
        return max(0, whole + max(i for i, n in enumerate(own) if n <= left))

    def within(self, text: str, limit: int) -> int:
        """Characters of the longest prefix with at most limit tokens."""
        return self.measured([text], limit)[0][1]


@lru_cache(maxsize=1)
def _model(path: str) -> Prefixes:
    """One for each worker, with all that it has found, whatever the number of its tasks."""
    return Prefixes(path)


def token_counts(docs: DataFrame, model: str, *, doc_id="doc_id", text="text", limit=LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit, and limit_chars, the characters of its longest
    prefix with at most ``limit`` tokens (all of them unless over the limit). A scan without a shuffle."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        prefixes = _model(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                rows = prefixes.measured(texts, limit)
                schema = pa.schema([("doc_id", part.column(0).type), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("limit_chars", pa.int64())])
                yield table(part, schema, doc_id=part.column(0), n_bytes=part.column(2), n_tokens=[n for n, _ in rows], over_limit=[n > limit for n, _ in rows], limit_chars=[c for _, c in rows])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, limit_chars long").withColumnRenamed("doc_id", doc_id)


def prefix_table(docs: DataFrame, model: str, *, doc_id="doc_id", text="text") -> DataFrame:
    """doc_id and tokens: the token count of each prefix of its text, by its length in characters, from 0 on. Written as
    Parquet, rising counts pack to a fraction of the text."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        prefixes = _model(model)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                tables = [prefixes.table(t or "").astype(np.int32) for t in part.column(1).to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in tables])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(tables)))], names=["doc_id", "tokens"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, tokens array<int>").withColumnRenamed("doc_id", doc_id)


def tokens_of(chars: Column, tokens: str = "tokens") -> Column:
    """Tokens of the prefix of so many characters (of the whole text beyond its end), from the table."""
    return F.get(tokens, F.greatest(F.lit(0), F.least(chars.cast("int"), F.size(tokens) - 1)))


def truncated(limit: Column, tokens: str = "tokens") -> Column:
    """Characters of the longest prefix with at most limit tokens, from the table."""
    return F.array_max(F.filter(F.sequence(F.lit(0), F.size(tokens) - 1), lambda i: F.get(tokens, i) <= limit))
