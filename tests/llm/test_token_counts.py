import random

from lexforge.llm import queries, token_counts


def model():
    return token_counts.Prefixes(queries.tokenizer("piece_bpe_32k.model"))


def test_every_prefix_against_the_library():
    p, rnd = model(), random.Random(1)
    for _ in range(400):
        s = "".join(rnd.choice("ab  the▁ é\n\tﬁ中<s>/0x") for _ in range(rnd.randrange(0, 25)))
        want = [len(p.model.encode(s[:i])) for i in range(len(s) + 1)]
        assert list(p.table(s)) == want and p.total(s) == want[-1]
        limit = rnd.randrange(0, 12)
        assert p.within(s, limit) == max(i for i, n in enumerate(want) if n <= limit)


def test_query(spark, sf):
    p = model()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op4_token_counts(spark, sf).collect()}
    assert set(got) == set(docs)
    for d, r in got.items():
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[d].encode()), n := len(p.model.encode(docs[d])), n > 4096)
        cut = docs[d][: r.limit_chars]
        assert len(p.model.encode(cut)) <= 4096 and (not r.over_limit or len(p.model.encode(docs[d][: r.limit_chars + 1])) > 4096)


def test_odd_rows(spark):
    rows = [(1, None), (None, ""), (2, " "), (2, " "), (3, "x" * 200_000), (4, "<s> </s>")]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "5 n_tokens")
    p = model()
    got = sorted((r.doc_id or -1, r.n_tokens) for r in token_counts.token_counts(d, queries.tokenizer("piece_bpe_32k.model")).collect())
    assert got == sorted((d or -1, len(p.model.encode(t or ""))) for d, t in rows)
    assert token_counts.token_counts(d.limit(0), queries.tokenizer("piece_bpe_32k.model")).count() == 0


def test_table_answers_without_the_library(spark, sf):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 1500").selectExpr("doc_id", "text", "'x' tokens")
    table = token_counts.prefix_table(docs, queries.tokenizer("piece_bpe_32k.model"))
    p = model()
    got = table.select("doc_id", "tokens", token_counts.tokens_of(F.lit(100)).alias("at"), token_counts.truncated(F.lit(64)).alias("cut")).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == len(texts) > 20
    for r in got:
        text = texts[r.doc_id]
        want = [len(p.model.encode(text[:i])) for i in range(min(len(text), 200) + 1)]
        assert r.tokens[: len(want)] == want and len(r.tokens) == len(text) + 1 and r.tokens[-1] == len(p.model.encode(text))
        assert r["at"] == len(p.model.encode(text[:100])) and r.cut == p.within(text, 64)
    odd = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [r.tokens for r in token_counts.prefix_table(odd, queries.tokenizer("piece_bpe_32k.model")).collect()] == [[0], [0]]


def test_all_documents_against_the_library(spark):
    p = model()
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r.n_tokens for r in queries.op4_token_counts(spark, sf).collect()}
    ids = sorted(docs)
    assert [got[d] for d in ids] == [len(x) for x in p.model.encode([docs[d] or "" for d in ids])]
