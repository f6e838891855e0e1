"""Memory of tokenizers in tasks: how many texts the library holds at once, and how often a tokenizer is read."""

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexforge.operators import compare, mixture, tokenization

NAMES = ("byte_bpe_50k.json", "word_bpe_49k.json")


def _texts():
    return ["", "a", "Καλημέρα κόσμε, 12 words' worth.\n", "x" * 400_000, *(f"some words and number {i} " * 2_000 for i in range(9))]


def test_few_characters_are_encoded_at_once():
    held = []

    class Counting:
        def encode_batch_fast(self, texts, add_special_tokens):
            held.append(texts)
            return texts

    texts = _texts()
    assert [x for part in tokenization._encoded(Counting(), texts) for x in part] == texts
    assert len(held) > 3 and all(len(part) == 1 or sum(map(len, part)) <= tokenization.SLICE for part in held)


def test_two_tokenizers_stay_read():
    a, b = (tokenization.Subword.load(public_tokenizers.path(n)).document for n in NAMES)
    first = tokenization._cached(a), tokenization._cached(b)
    assert tokenization._cached(a) is first[0] and tokenization._cached(b) is first[1]


def test_slices_give_the_library_s_results(spark):
    texts = _texts()
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(len(texts), None)], "i int, text string").coalesce(1)
    for name in NAMES:
        t, one = tokenization.Subword.load(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
        want = [one.encode(x, add_special_tokens=False) for x in [*texts, ""]]
        cols = [t.encode(F.col("text")).alias("ids"), t.encode(F.col("text"), most=7).alias("some"), t.piece_count(F.col("text")).alias("n"), t.segmented(F.col("text")).alias("s")]
        for r in rows.select("i", *cols).collect():
            w = want[r.i]
            assert (r.ids, r.some, r.n, r.s.token_ids, r.s.tokens, r.s.token_count) == (w.ids, w.ids[:7], len(w.ids), w.ids, w.tokens, len(w.ids))
            assert r.s.decoded_pieces == [one.decode([i], skip_special_tokens=False) for i in w.ids]
        assert rows.limit(0).select(*cols).collect() == []


def test_counts_without_pieces(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(_texts())], "i int, text string")
    names = {k: tokenization.Subword.load(public_tokenizers.path(n)) for k, n in zip(("base", "reference"), NAMES, strict=True)}
    with_, without = (compare.analysed(rows, names, pieces=p) for p in (True, False))
    assert not any(c.endswith("_pieces") for c in without.columns)
    assert compare.summary(with_).collect() == compare.summary(without).collect()


def test_encoded_keeps_only_its_length(spark):
    """Ids beyond the length never leave the tokenizer's task."""

    class Asked:
        def encode(self, text, special=False, most=None):
            assert most == 5
            return F.array_repeat(F.lit(3), 9)

    rows = spark.createDataFrame([(1, "a b c")], "doc_id int, text string")
    assert mixture.encoded(rows, Asked(), length=5).select("input_ids").first()[0] == [3] * 5


def test_common_parts_are_not_shuffled(spark):
    """Whatever is broadcast, every text has the library's count; few distinct parts leave no rows for the join."""
    texts = ["the cat and the dog " * 200, "the cat", "", None, "<|endoftext|> the", "q" * 500 + " the " + "q" * 500, *(f"the odd{i} cat" for i in range(50))]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    t, one = tokenization.Subword.load(public_tokenizers.path(NAMES[0])), Tokenizer.from_file(public_tokenizers.path(NAMES[0]))
    want = {i: len(one.encode(x or "", add_special_tokens=False).ids) for i, x in enumerate(texts)}
    for sent, share in ((1, 10_000), (20, 3), (200_000, 10_000)):
        found = tokenization.corpus_token_counts(rows, t, sent=sent, share=share)
        assert {r.doc_id: r.tokens for r in found.collect()} == want
    plan = tokenization.corpus_token_counts(rows, t)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan  # texts are not cut again for the join
