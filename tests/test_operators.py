import csv
import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from lexforge.operators import candidates, compare, mixture, ordering, tokenization, vocabulary
from lexforge.sources import io
from lexforge.streaming import incremental


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_case_collapse(spark):
    rows = [("Δημιουργία", 7), ("δημιουργία", 5), ("ΣΑΣ", 9), ("σας", 4), ("Σας", 3), ("Αθήνα", 9), ("ΑΘΉΝΑ", 3), ("ΑΘΗΝΑ", 3)]
    groups = candidates.collapsed(frame(spark, rows, "word string, count long"))
    got = {r["word"]: (r["count"], r["source_variant_count"]) for r in groups.collect()}
    assert got == {"δημιουργία": (12, 2), "σας": (16, 3), "Αθήνα": (12, 2), "ΑΘΗΝΑ": (3, 1)}
    assert tuple(candidates.collapse_stats(groups).first()) == (4, 3, 4)
    assert sum(n for _, n in rows) == sum(n for n, _ in got.values())


class Fixed:
    """A tokenizer of given piece counts."""

    def __init__(self, pieces):
        self.pieces = pieces

    def piece_count(self, word):
        out = F.lit(9)
        for w, n in self.pieces.items():
            out = F.when(word == w, n).otherwise(out)
        return out.cast("int")


def test_ranking_and_whole_selection(spark):
    counts = frame(spark, [("aaaa", 10), ("bbbb", 15), ("cccc", 30), ("dd", 99), ("eeee", 4)], "word string, count long")
    t = Fixed({"aaaa": 4, "bbbb": 3, "cccc": 2, "x": 1, " y": 2})
    entries = frame(spark, [("x-", "a.txt"), ("-x", "b.txt"), (" aaaa", "b.txt"), ("bbbb", "b.txt"), (" ", "b.txt")], "raw string, file string")
    rows = candidates.select(counts, t, entries, script=None, max_selected=2).orderBy("section", "place").collect()
    assert [(r.word, r.token, r.utility_score, r.source_type) for r in rows] == [("aaaa", " aaaa", 30, "corpus"), ("bbbb", " bbbb", 30, "corpus"), ("bbbb", "bbbb", 0, "static"), ("x", "x", 0, "static")]
    x = rows[-1]
    assert (x.static_source_files, x.source_variant_count, x.base_token_count) == ("a.txt,b.txt", 2, 1)
    assert {r.reason: r.words for r in candidates.reason_counts(counts, script="greek").collect()} == {"too_short": 1, "other_script": 4}
    with pytest.raises(ValueError):
        candidates.validate(min_length=5, max_length=4)


def test_extension(spark):
    base = frame(spark, [("t0", 0, " από", False)], "token string, id int, decoded string, special boolean")
    lines = frame(spark, list(enumerate([" από", "από", "λέξη", " λέξη", "από", " "])), "position int, token string")
    stats = vocabulary.input_stats(lines).first()
    assert tuple(stats) == (5, 4, 1)
    parts = vocabulary.partition(vocabulary.first_seen(lines), base)
    got = {r.token: (r.action, r.reason, r.conflicting_token_id) for r in parts.collect()}
    assert got == {" από": ("skip", vocabulary.EXACT, 0), "από": ("skip", vocabulary.SHADOW, 0), "λέξη": ("add", None, None), " λέξη": ("add", None, None)}
    assert [(r.token, r.id) for r in vocabulary.extended(parts, base).orderBy("id").collect()] == [("λέξη", 1), (" λέξη", 2)]
    assert [tuple(r) for r in vocabulary.mutual_shadows(parts).collect()] == [("λέξη", " λέξη")]
    with pytest.raises(ValueError):
        vocabulary.aligned(base, base.limit(0))


def test_readable_and_merges(spark):
    v = frame(spark, [("Ġa", " a"), ("b1", "b"), ("b2", "b"), ("c", "b1")], "token string, decoded string")
    shown = vocabulary.readable(v)
    assert {r.token: (r.shown, r.clash) for r in shown.collect()} == {"Ġa": (" a", False), "b1": ("b1", True), "b2": ("b2", False), "c": ("b1", True)}
    merges = frame(spark, [(0, "Ġa", "zz"), (1, "c", "b2")], "rank int, left string, right string")
    assert [tuple(r) for r in vocabulary.relabelled(merges, shown).orderBy("rank").collect()] == [(0, " a", "zz"), (1, "b1", "b2")]


def test_comparison(spark):
    rows = frame(spark, [(0, "abcd", 44, 23), (1, "", 0, 0)], "position int, text string, a int, b int")
    c = compare.compared(compare.counted(rows, {"base": F.col("a"), "reference": F.col("b")}))
    got = [(r.base_minus_reference, r.reference_reduction_vs_base, r.base_chars_per_token) for r in c.orderBy("position").collect()]
    assert got == [(21, 47.73, 0.0909), (0, 0.0, 0.0)]
    s = compare.summary(c).first()
    assert (s.samples, s.base_total, s.reference_reduction_vs_base) == (2, 44, 47.73)
    lines = frame(spark, [(0, " a "), (1, "b"), (2, "a"), (3, " ")], "position int, text string")
    assert [r.text for r in compare.samples(lines, 1).collect()] == ["a"]
    assert "### Sample 1\n> abcd\n- base: 44 tokens" in compare.rendered(c).where("nth = 1").first().markdown


def test_encode_and_labels(spark):
    rows = frame(spark, [(1, [5, 6, 7])], "doc_id long, _ids array<int>")
    r = mixture.padded(rows, length=5).first()
    assert (r.input_ids, r.attention_mask, r.labels) == ([5, 6, 7, 0, 0], [1, 1, 1, 0, 0], [5, 6, 7, -100, -100])
    r = mixture.padded(rows, length=2).first()
    assert (r.input_ids, r.attention_mask) == ([5, 6], [1, 1])


def test_run_plan(spark):
    get = lambda **o: {r.phase: tuple(r)[1:] for r in mixture.run_plan(spark, **o).collect()}
    assert get() == {"warmup": (2000, 1e-4, 0, 256, 10, 1000), "full": (50_000, 2e-5, 1000, 256, 10, 1000)}
    assert get(smoke=True) == {"warmup": (20, 1e-4, 0, 4, 10, 20), "full": (40, 2e-5, 5, 4, 10, 40)}
    assert get(steps={"full": (3, 1.0, 5)})["full"][2] == 3
    config = mixture.run_config(spark, {"b": 1, "a": 2}, vocabulary_size=9, smoke=True)
    assert list(config["arguments"]) == ["a", "b"] and config["effective_batch"] == 4 and config["max_length"] == 1024 and config["phases"]["full"]["max_steps"] == 40
    assert mixture.accumulation(256, 1, 16) == 16 and mixture.effective_length(smoke=True) == 1024
    with pytest.raises(ValueError):
        mixture.accumulation(256, 1, 12)


def test_interleave(spark):
    rows = frame(spark, [(i, "a" if i < 30 else "b") for i in range(40)], "doc_id long, source string")
    first = mixture.interleave(rows, {"a": 0.9, "b": 0.1})
    assert [r.i for r in first.orderBy("i").collect()] == list(range(first.count()))
    every = mixture.interleave(rows, {"a": 0.5, "b": 0.5}, stop="all_exhausted")
    assert every.select("doc_id").distinct().count() == 40
    assert mixture.interleave(rows, {"a": 1.0, "b": 0}).count() == 30
    with pytest.raises(ValueError):
        mixture.interleave(rows, {"a": 0})


def test_numbering(spark):
    rows = frame(spark, [(i * 7 % 1000, "ab"[i % 3 == 0]) for i in range(1000)], "doc_id long, source string").repartition(3)
    got = {}
    for r in ordering.numbered(rows, "source", ["doc_id"]).collect():
        got.setdefault(r.source, []).append((r.doc_id, r.k))
    assert all([k for _, k in sorted(x)] == list(range(1, len(x) + 1)) for x in got.values())
    assert ordering.numbered(rows.limit(0), "source", ["doc_id"]).count() == 0
    words = ordering.numbered(rows.withColumn("doc_id", F.col("doc_id").cast("string")), "source", ["doc_id"])
    assert words.agg(F.max("k")).first()[0] == max(map(len, got.values()))


def toy():
    """A byte-level tokenizer document of single characters and ten merges."""
    from tokenizers import pre_tokenizers

    letters = sorted(pre_tokenizers.ByteLevel.alphabet())
    merges = [("t", "h"), ("th", "e"), ("Ġ", "the"), ("i", "n"), ("e", "r"), ("o", "n"), ("a", "n"), ("an", "d"), ("Ġ", "and"), ("in", "g")]
    vocab = {t: i for i, t in enumerate([*letters, *[a + b for a, b in merges]])}
    model = {"type": "BPE", "vocab": vocab, "merges": [list(m) for m in merges]}
    byte = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    return json.dumps({"version": "1.0", "added_tokens": [], "normalizer": None, "pre_tokenizer": byte, "post_processor": None, "decoder": byte, "model": model})


def test_subword_and_tables(spark, tmp_path):
    pytest.importorskip("tokenizers")
    document = toy()
    t = tokenization.Subword(document)
    df = frame(spark, [(0, "the thing and"), (1, ""), (2, None)], "i int, text string")
    rows = {r.i: r.s for r in df.select("i", t.segmented(F.col("text")).alias("s")).collect()}
    assert rows[0].decoded_pieces == ["the", " ", "th", "ing", " and"] and rows[1].token_count == 0
    ids = df.where("i = 0").select(F.col("i").alias("doc_id"), t.encode(F.col("text")).alias("ids"))
    v = t.vocabulary(spark)
    assert tokenization.decoded(ids, v).first().pieces == rows[0].decoded_pieces
    assert ids.select(t.decode(F.col("ids")).alias("x")).first().x == "the thing and"
    vocab, merges, added = io.tokenizer_tables(spark, document)
    assert vocab.count() == v.count() and merges.count() == 10 and added.count() == 0
    io.save_tokenizer(document, str(tmp_path / "t"), {"eos_token": "e"})
    assert io.tokenizer_config(str(tmp_path / "t"))["pad_token"] == "e"
    assert io.read_tokenizer(str(tmp_path / "t")).document == document
    text, stats = vocabulary.readable_document(spark, t)
    shown = json.loads(text)["model"]
    assert len(shown["vocab"]) == stats["tokens"] - stats["clashes"] // 2 and [" ", "the"] in shown["merges"] and " the" in shown["vocab"]
    assert stats["kept_raw"] > 0  # bytes that are no character of their own all decode to the same sign
    out = mixture.encoded(df, t, key="i", length=4).collect()
    assert len(out) == 1 and out[0].attention_mask == [1, 1, 1, 1]


def test_files(spark, tmp_path):
    counts = frame(spark, [("α", 3), ("b", 5), ("c", 1)], "word string, count long")
    path = str(tmp_path / "c.json")
    assert io.write_counts_json(counts.orderBy(F.desc("count")), path) == 3
    assert [r["word"] for r in json.load(open(path, encoding="utf-8"))] == ["b", "α", "c"]
    assert [tuple(r) for r in io.read_counts_json(spark, path, 2).collect()] == [("b", 5), ("α", 3)]
    with pytest.raises(FileExistsError):
        io.write_counts_json(counts, path)
    (tmp_path / "bad.json").write_text('{"word": "x"}')
    with pytest.raises(ValueError):
        io.read_counts_json(spark, str(tmp_path / "bad.json")).collect()
    (tmp_path / "odd.json").write_text('[{"word": "x", "count": 2}, {"word": "y", "count": "n"}, {"word": null, "count": 1}]')
    assert [r["word"] for r in io.read_counts_json(spark, str(tmp_path / "odd.json")).collect()] == ["x"]
    with sqlite3.connect(tmp_path / "c.db") as db:
        db.execute("CREATE TABLE word_counts (word TEXT PRIMARY KEY, count INTEGER NOT NULL)")
        db.executemany("INSERT INTO word_counts VALUES (?, ?)", [("a", 4), ("b", 2)])
    assert [tuple(r) for r in io.read_counts(spark, str(tmp_path / "c.db"), 1, 1).collect()] == [("a", 4)]
    io.write_counts(counts, str(tmp_path / "table"))
    assert io.read_counts(spark, str(tmp_path / "table"), 3).count() == 2
    assert io.resolve_counts(str(tmp_path / "none"), path) == ("json", path)
    with pytest.raises(FileNotFoundError):
        io.resolve_counts(str(tmp_path / "none"), path, "table")
    (tmp_path / "lists").mkdir()
    (tmp_path / "lists" / "a.txt").write_text(" x\n\n-y\x85z\n", encoding="utf-8")
    assert [(r.file, r.raw) for r in io.read_lines(spark, str(tmp_path / "lists")).orderBy("position").collect()] == [("a.txt", " x"), ("a.txt", "-y"), ("a.txt", "z")]
    (tmp_path / "s.txt").write_text("one\n two \n\none\n")
    lines = io.read_samples(spark, str(tmp_path / "s.txt"), ("two", "three"))
    assert [r.text for r in compare.samples(lines, None).collect()] == ["one", "two", "three"]
    chosen = candidates.select(frame(spark, [("aaaa", 10)], "word string, count long"), Fixed({}), script=None)
    assert io.write_candidates(chosen, str(tmp_path / "c.tsv")) == 1
    raw = (tmp_path / "c.tsv").read_bytes()
    assert raw.startswith(b"word\ttoken\t") and raw.endswith(b"\r\n")
    assert next(csv.DictReader(open(tmp_path / "c.tsv", newline=""), delimiter="\t"))["token"] == " aaaa"
    assert io.write_lines(chosen, "token", str(tmp_path / "t.txt")) == 1 and (tmp_path / "t.txt").read_text() == " aaaa\n"
    assert json.loads(io.write_report(io.report(candidates.collapse_stats(candidates.uncollapsed(counts))), str(tmp_path / "r.json"))) == {"groups": 3, "groups_with_variants": 0, "merged_rows": 0}
    spark.range(2).selectExpr("id doc_id", "'t' text").write.parquet(str(tmp_path / "p"))
    both = io.read_sources(spark, {"a": str(tmp_path / "p"), "b": "/nowhere"}, {"a": 1.0, "b": 0})
    assert both.where("source = 'a'").count() == 2


def test_ordered_sinks(spark, tmp_path, monkeypatch):
    """Many rows as one ordered file or as ordered parts, by a path with a scheme, and no row by way of the driver."""
    monkeypatch.setattr(type(spark.range(1)), "toLocalIterator", None)
    odd = frame(spark, [('q"\\', 10**7), ("é\n\U0001f600", 10**7 - 1), (None, 10**7 - 2)], "word string, count long")
    counts = spark.range(300_000).select(F.concat(F.lit("w"), F.col("id")).alias("word"), ((F.col("id") * 7919) % 300_000).alias("count")).repartition(7).unionByName(odd)
    ordered = counts.orderBy(F.desc("count"), "word")
    where = f"file://{tmp_path}/out"
    assert io.write_counts_json(ordered, f"{where}/c.json") == 300_003
    text = (tmp_path / "out" / "c.json").read_text(encoding="utf-8")
    found = json.loads(text)
    assert text.startswith('[\n{"word": "q\\"\\\\", "count": 10000000},\n{"word": "é\\n\U0001f600", "count": 9999999},\n{"word": null, "count": 9999998},\n') and text.endswith("}\n]\n") and text.count("\n") == 300_005
    assert [r["count"] for r in found] == [10**7, 10**7 - 1, 10**7 - 2, *range(299_999, -1, -1)] and len({r["word"] for r in found}) == 300_003
    assert io.write_counts_json(ordered, f"{where}/parts", parts=True) == 300_003
    files = sorted((tmp_path / "out" / "parts").glob("part-*"))
    assert len(files) > 1 and [json.loads(x) for f in files for x in f.read_text(encoding="utf-8").split("\n")[:-1]] == found
    assert io.write_lines(ordered, "word", f"{where}/w.txt") == 300_003
    assert (tmp_path / "out" / "w.txt").read_text(encoding="utf-8").split("\n")[4:7] == [r["word"] for r in found[3:6]]
    empty = counts.limit(0)
    assert io.write_counts_json(empty, f"{where}/e.json") == 0 and json.loads((tmp_path / "out" / "e.json").read_text()) == []
    assert io.write_lines(empty, "word", f"{where}/e.txt") == 0 and (tmp_path / "out" / "e.txt").read_text() == ""
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["c.json", "e.json", "e.txt", "parts", "w.txt"]  # nothing is left beside


def test_failed_writes_leave_the_old_target(spark, tmp_path):
    good = frame(spark, [("a", 1)], "word string, count long")
    bad = good.withColumn("word", F.when(F.col("count") > 0, F.raise_error(F.lit("no"))).otherwise(F.col("word")))
    writes = {
        "c.json": lambda df, p, o: io.write_counts_json(df, p, o),
        "parts": lambda df, p, o: io.write_counts_json(df, p, o, parts=True),
        "table": lambda df, p, o: io.write_counts(df, p, o),
        "w.txt": lambda df, p, o: io.write_lines(df, "word", p, o),
    }
    for name, write in writes.items():
        path = tmp_path / name
        write(good, str(path), False)
        kept = lambda path=path: {f.name: f.read_bytes() for f in ([path] if path.is_file() else path.iterdir())}
        before = kept()
        with pytest.raises(FileExistsError):
            write(good, str(path), False)
        with pytest.raises(Exception, match="no"):
            write(bad, str(path), True)
        assert kept() == before
        write(good.union(good), str(path), True)
        assert kept() != before
    assert sorted(p.name for p in tmp_path.iterdir()) == sorted(writes)
    # the new one can't take its place: the old one comes back
    from lexforge.sources import files

    rename = files.Place.rename
    for fail in (1, 2):
        calls = []

        def failing(self, to, calls=calls, fail=fail):
            calls.append(1)
            if len(calls) == fail:
                raise OSError("renaming failed")
            rename(self, to)

        files.Place.rename = failing
        try:
            with pytest.raises(OSError, match="renaming"):
                io.write_report({"x": 2}, str(tmp_path / "w.txt"))
        finally:
            files.Place.rename = rename
        assert (tmp_path / "w.txt").read_text() == "a\na\n" and sorted(p.name for p in tmp_path.iterdir()) == sorted(writes)


def database(path, n, rowid):
    with sqlite3.connect(path) as db:
        for name in ("word_counts", "quoted_word_counts"):
            db.execute(f"CREATE TABLE {name} (word TEXT PRIMARY KEY, count INTEGER NOT NULL)" + ("" if rowid else " WITHOUT ROWID"))
            db.executemany(f"INSERT INTO {name} VALUES (?, ?)", ((f"w'é{i}", i % 97) for i in range(n)))
        db.execute("CREATE TABLE odd (a BLOB, b REAL, c INTEGER, d VARCHAR(9))")
        db.execute("INSERT INTO odd VALUES (x'00ff', 1.5, NULL, 'x'), (NULL, NULL, 2, NULL)")
    return str(path)


@pytest.mark.parametrize("rowid", [True, False])
def test_database_tables(spark, tmp_path, rowid):
    path, n = database(tmp_path / "c.db", 5000, rowid), 5000
    rows = io.read_counts(spark, path, 90, partitions=7)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan sqlite_table" in plan and "Filter (" not in plan and "+- Filter" not in plan  # the database filters
    assert [tuple(r) for r in rows.collect()] == sorted(((f"w'é{i}", i % 97) for i in range(n) if i % 97 >= 90), key=lambda x: (-x[1], x[0].encode()))
    from lexforge.sources import database as db

    table = db.read_table(spark, path, "quoted_word_counts", partitions=7)
    assert table.rdd.getNumPartitions() == 7 and table.count() == table.distinct().count() == n
    sizes = [r["n"] for r in table.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 7 and max(sizes) <= 2 * min(sizes)
    for where, want in ((F.col("word") == "w'é7", 1), (F.col("word").isin("w'é7", "w'é8", "no"), 2), ((F.col("count") < 3) & (F.col("word") > "w'é4"), None), (F.length("word") == 4, 10), (F.col("count") == 1.5, 0)):
        got = table.where(where).count()
        assert got == (want if want is not None else sum(i % 97 < 3 and f"w'é{i}".encode() > "w'é4".encode() for i in range(n)))
    odd = db.read_table(spark, path, "odd")
    assert [f.simpleString() for f in odd.schema] == ["a:binary", "b:double", "c:bigint", "d:string"]
    assert {tuple(r) for r in odd.collect()} == {(b"\x00\xff", 1.5, None, "x"), (None, None, 2, None)}
    assert odd.where("d is not null").count() == 1
    # the file goes to the executors
    assert db.read_table(spark, path, "word_counts", ship=True, partitions=2).where("count = 5").count() == sum(i % 97 == 5 for i in range(n))
    with pytest.raises(Exception, match="no table"):
        db.read_table(spark, path, "absent").count()


def test_partition_by_encoding(spark):
    """An entry of the vocabulary that no merge leads to is no exact single token, though its spelling is there."""
    document = json.loads(toy())
    document["model"]["vocab"]["zz"] = len(document["model"]["vocab"])
    t = tokenization.Subword(json.dumps(document))
    lines = frame(spark, [(0, "the"), (1, "and"), (2, "zz"), (3, "ing"), (4, " ing"), (5, " the"), (6, "ther"), (7, "\tthe")], "position int, token string")
    parts = vocabulary.partition_by(lines, t)
    got = {r.token: (r.action, r.reason, r.conflicting_token) for r in parts.collect()}
    assert got["the"] == got["ing"][:2] + ("the",) == ("skip", vocabulary.EXACT, "the")
    assert got["zz"] == got["ther"] == got["\tthe"] == got[" ing"] == ("add", None, None)
    joined = {r.token: r.action for r in vocabulary.partition(lines, t.vocabulary(spark)).collect()}
    assert joined["zz"] == "skip"
    document["model"]["vocab"].pop("and"), document["model"]["merges"].remove(["an", "d"]), document["model"]["merges"].remove(["Ġ", "and"])
    document["model"]["merges"] += [["Ġ", "an"], ["Ġan", "d"]]
    document["model"]["vocab"]["Ġan"], document["model"]["vocab"]["Ġand"] = 900, document["model"]["vocab"]["Ġand"]
    parts = vocabulary.partition_by(lines.where("token = 'and'"), tokenization.Subword(json.dumps(document)))
    assert parts.first().reason == vocabulary.SHADOW and parts.first().conflicting_token == " and"
    t = tokenization.Subword(toy())
    samples = vocabulary.initialisation_samples(vocabulary.partition_by(lines, t), t, 2).collect()
    assert [(r.token, r.source_token_count, r.source_decoded_pieces) for r in samples] == [("zz", 2, ["z", "z"]), (" ing", 2, [" ", "ing"])]
    groups = candidates.static_groups(frame(spark, [("the-", "a"), ("ther", "a"), ("-", "a"), (" -", "a")], "raw string, file string"))
    assert sorted(r.word for r in groups.collect()) == [" ", "the", "ther"]
    stats = candidates.static_candidate_stats(groups, t, frame(spark, [("ther",)], "token string")).first()
    assert tuple(stats) == (3, 2, 1, 2)
    chosen = candidates.select(frame(spark, [("things", 10)], "word string, count long"), t, script=None)
    assert candidates.examples(chosen, tokenizer=t).first().base_decoded_pieces == ["th", "ing", "s"]


def test_initialised(spark):
    matrix = frame(spark, [(i, [float(i), 2.0 * i]) for i in range(5)], "id int, vec array<float>")
    sources = frame(spark, [("a", [1, 3, 3]), ("b", []), ("c", [4])], "token string, source_ids array<int>")
    new, out, n = vocabulary.initialised(sources, matrix, key="token")
    assert {r.token: [round(x, 6) for x in r["mean"]] for r in new.collect()} == {"a": [2.333333, 4.666667], "c": [4.0, 8.0]}
    assert out is None and n["initialized_output_embeddings"] == 0
    same = vocabulary.initialised(sources, matrix, matrix, tied=True, key="token")
    assert same[1] is same[0] and same[2] == {"initialized_input_embeddings": 2, "initialized_output_embeddings": 2, "output_embeddings_share_storage": True}
    other = matrix.withColumn("vec", F.transform("vec", lambda x: -x))
    assert {r.token: r["mean"] for r in vocabulary.initialised(sources, matrix, other, key="token")[1].where("token = 'c'").collect()} == {"c": [-4.0, -8.0]}


def test_a_piece_of_all_tokens(spark, monkeypatch):
    """A piece that all tokens have is dealt out: no task of the join gets more than twice the median."""
    import numpy as np

    rng = np.random.default_rng(1)
    dims, n = 16, 20_000
    vectors = rng.normal(size=(300, dims)).astype(np.float32)
    matrix = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id int, vec array<float>")
    pieces = [[0, int(a), int(b), int(a)] for a, b in rng.integers(1, 300, (n, 2))]
    sources = spark.createDataFrame([(f"t{i}" if i else None, p) for i, p in enumerate(pieces)], "token string, source_ids array<int>").repartition(6)
    for name, value in (("spark.sql.shuffle.partitions", "16"), ("spark.sql.adaptive.enabled", "false"), ("spark.sql.autoBroadcastJoinThreshold", "-1")):
        spark.conf.set(name, value)
    try:

        def counted(batches):
            import pyarrow as pa

            rows = sum(b.num_rows for b in batches)
            yield pa.RecordBatch.from_arrays([pa.array(["n"]), pa.array([[0.0]]), pa.array([rows])], names=["_key", "_sum", "_n"])

        frames = []
        monkeypatch.setattr(type(sources), "mapInArrow", lambda df, f, schema, real_map=type(sources).mapInArrow: frames.append(df) or real_map(df, f, schema))
        found = vocabulary.mean_rows(sources, matrix, "token")
        got = {r.token: r["mean"] for r in found.collect()}
        monkeypatch.undo()
        sizes = [r["_n"] for r in frames[0].mapInArrow(counted, "_key string, _sum array<double>, _n long").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(sizes) >= 2.9 * n and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]
    want = vectors.astype(np.float64)[np.array(pieces)].mean(axis=1)
    assert len(got) == n and all(np.allclose(got[f"t{i}" if i else None], want[i]) for i in range(n))


def test_vocabulary_report(spark):
    a = frame(spark, [("x", 0, "x"), ("é", 1, "é"), ("ñ", 2, "ñ")], "token string, id int, decoded string")
    b = frame(spark, [("é", 7, "é"), ("y", 8, "y")], "token string, id int, decoded string")
    assert tuple(vocabulary.diff(a, b).first()) == (3, 2, 3, 2, 1, 2, 1, 33.33, 50.0)
    assert tuple(vocabulary.diff(a, b, script="latin1").first()) == (3, 2, 2, 1, 1, 1, 0, 50.0, 100.0)
    assert {tuple(r) for r in vocabulary.diff_examples(a, b).collect()} == {("common", 1, "é", "é"), ("only_base", 0, "x", "x"), ("only_base", 2, "ñ", "ñ"), ("only_reference", 8, "y", "y")}


def test_mixture_edges(spark):
    rows = frame(spark, [(i, "a" if i < 500 else "b") for i in range(503)], "doc_id long, source string")
    every = mixture.interleave(rows, {"a": 0.9996, "b": 0.0004}, stop="all_exhausted")
    assert every.select("doc_id").distinct().count() == 503
    with pytest.raises(ValueError):
        mixture.interleave(rows, {"a": 1.0, "b": 1e-12}, stop="all_exhausted")


def plain_mixture(rows, weights, stop, seed=42):
    """The interleaving by plain Python: (i, id) of rows (id, source)."""
    import hashlib

    edges = mixture._edges(weights)
    own = {s: sorted((d for d, x in rows if x == s), key=lambda d: (d is not None, d)) for s in weights}
    used, out = dict.fromkeys(weights, 0), []
    while True:
        u = int(hashlib.md5(f"{seed}:{len(out)}".encode()).hexdigest()[:8], 16)
        s = next((name for name, edge in edges if u < edge), edges[-1][0])
        out.append((len(out), own[s][used[s] % len(own[s])]))
        used[s] += 1
        full = [n >= len(own[x]) for x, n in used.items()]
        if any(full) if stop == "first_exhausted" else all(full):
            return out


@pytest.mark.parametrize("block", [7, 1 << 16])
@pytest.mark.parametrize("stop", ["first_exhausted", "all_exhausted"])
def test_interleaving_by_blocks(spark, monkeypatch, block, stop):
    monkeypatch.setattr(mixture, "BLOCK", block)
    rows = [(f"d{i:03}" if i else None, "abc"[(i > 90) + (i > 130)]) for i in range(150)]
    weights = {"a": 0.5, "b": 0.3, "c": 0.2}
    df = frame(spark, rows, "doc_id string, source string").withColumn("text", F.concat(F.lit("t"), F.col("doc_id"))).repartition(5)
    want = plain_mixture(rows, weights, stop)
    for some in (df, df.drop("text")):
        got = mixture.interleave(some, weights, stop=stop).collect()
        assert sorted((r.i, r.doc_id) for r in got) == want
        assert "text" not in some.columns or all(r.text == (r.doc_id and f"t{r.doc_id}") for r in got)
    # an order that is no key: every row is still one of its own
    twice = df.unionByName(df.withColumn("text", F.lit("again")))
    got = mixture.interleave(twice, weights, stop="all_exhausted").collect()
    assert len({(r.doc_id, r.text) for r in got}) == 300 or {(r.doc_id, r.text) for r in got} == {tuple(r) for r in twice.select("doc_id", "text").collect()}


def test_few_numbers_are_drawn(spark):
    rows = frame(spark, [(i, "a" if i < 1999 else "b") for i in range(2000)], "doc_id long, source string")
    weights, sizes = {"a": 0.9, "b": 0.1}, {"a": 1999, "b": 1}
    assert mixture._bound(sizes, weights, "first_exhausted") < 200
    drawn = []
    before = mixture._draws
    mixture._draws = lambda spark, edges, begin, end, seed: drawn.append(end - begin) or before(spark, edges, begin, end, seed)
    try:
        got = mixture.interleave(rows, weights).collect()
    finally:
        mixture._draws = before
    assert max(drawn) < 200 and len(got) == 11


def test_numbering_is_parallel_for_any_type(spark):
    from pyspark.sql.window import Window

    rows = spark.range(20_000).select(F.format_string("%05d", (F.col("id") * 7919) % 20_000).alias("doc_id"), F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("source"))
    rows = rows.unionByName(frame(spark, [(None, "a"), (None, None), ("x", None)], "doc_id string, source string"))
    found = ordering.numbered(rows, "source", ["doc_id"])
    want = rows.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).cast("long"))
    assert sorted(map(str, found.collect())) == sorted(map(str, want.select(found.columns).collect()))


def test_tokens_by_parts(spark):
    """Counts by parts equal the library's over whole texts, whatever they hold; a hot part is dealt out."""
    import random

    import public_tokenizers

    t = tokenization.Subword.load(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(3)
    odd = ["a", "'s", "'ll", " ", "  ", "\n", "\t", "\xa0", "\u2003", "é", "ß", "١", "Ⅷ", "½", "\U0001f600", "中", "…", "-", "_", "'", "the ", " The", "12", "x'd", "\u0301", "\x1c", "\x85", "<|endoftext|>"]
    texts = ["".join(rng.choices(odd, k=rng.randint(0, 25))) for _ in range(3000)] + ["the " * 500] * 30 + ["", None]
    docs = frame(spark, list(enumerate(texts)), "doc_id int, text string").repartition(5)
    got = {r.doc_id: r.tokens for r in tokenization.corpus_token_counts(docs, t, share=100).collect()}
    model = t.model()
    assert got == {i: len(model.encode(x or "", add_special_tokens=False).ids) for i, x in enumerate(texts)}
    with pytest.raises(ValueError, match="pattern"):
        tokenization.corpus_token_counts(docs, tokenization.Subword.load(public_tokenizers.path("word_bpe_49k.json")))


def test_coverage(spark):
    rows = frame(spark, [("x",)] * 1001 + [(" ",), (None,)], "text string")
    got = {r.phase: r for r in mixture.coverage(mixture.run_plan(spark, smoke=True), rows).collect()}
    assert (got["warmup"].examples, got["warmup"].steps_per_epoch, got["warmup"].examples_seen, got["warmup"].epochs) == (1001, 251, 80, 0.0799)
    assert mixture.coverage(mixture.run_plan(spark), rows.limit(0)).first().epochs == 0.0


def test_places_without_a_cap(spark):
    """All words that the tokenizer parts, numbered by ranges: no window over a section."""
    counts = spark.range(3000).select(F.format_string("word%05d", "id").alias("word"), (5 + F.col("id") % 50).alias("count"))
    entries = frame(spark, [(f"entry{i}", "a.txt") for i in range(50)] + [("word00007", "a.txt"), (" word00007", "a.txt")], "raw string, file string")
    chosen = candidates.select(counts, Fixed({}), entries, script=None, max_selected=0)
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan
    got = [(r.section, r.place, r.word) for r in chosen.orderBy("section", "place").collect()]
    corpus = sorted(((5 + i % 50, f"word{i:05}") for i in range(3000)), key=lambda x: (-x[0], x[1]))
    static = sorted([f"entry{i}" for i in range(50)] + ["word00007"])  # as a corpus token it has a space before it
    assert got == [(0, i + 1, w) for i, (_, w) in enumerate(corpus)] + [(1, i + 1, w) for i, w in enumerate(static)]


def test_rendered_summary(spark):
    rows = spark.range(1).select(F.lit("x" * 40).alias("text"))
    counted = compare.counted(rows, {"base": F.lit(44), "extended": F.lit(30), "reference": F.lit(23)})
    text = compare.rendered_summary(compare.summary(counted)).first().text
    assert text.split("\n") == ["Samples: 1", "Base total tokens: 44", "Reference total tokens: 23", "Token delta: 21", "Avg Base tokens/sample: 44.0", "Avg Reference tokens/sample: 23.0", "Relative reduction: 47.73%"]
    text = compare.rendered_summary(compare.summary(counted, compare.NAMES), compare.NAMES, {"base": "A", "extended": "B", "reference": "C"}).first().text
    assert text.split("\n")[4:7] == ["A -> B delta: 14", "A -> C delta: 21", "B -> C delta: 7"] and text.endswith("A -> B reduction: 31.82%\nA -> C reduction: 47.73%\nB -> C reduction: 23.33%")
    assert compare.rendered_summary(compare.summary(counted.limit(0))).first().text.endswith("Avg Reference tokens/sample: 0.0\nRelative reduction: 0.0%")
    assert frame(spark, [(12345678.5,), (0.1234,)], "x double").select(compare._plain(F.col("x")).alias("x")).collect() == [("12345678.5",), ("0.1234",)]


def test_resume(spark, tmp_path):
    for n in (9, 10, 100):
        (tmp_path / "full" / f"checkpoint-{n}").mkdir(parents=True)
    (tmp_path / "full" / "checkpoint-x").mkdir()
    (tmp_path / "full" / "checkpoint-999").write_text("no folder")
    folders = {"full": str(tmp_path / "full"), "warmup": str(tmp_path / "warmup")}
    assert mixture.latest_checkpoint(folders["full"]).endswith("checkpoint-100") and mixture.latest_checkpoint(folders["full"], overwrite=True) is None
    got = {r.phase: (r.done, r.steps_left) for r in mixture.resumed(mixture.run_plan(spark), folders).collect()}
    assert got == {"full": (100, 49_900), "warmup": (0, 2000)}


def test_sources(spark, tmp_path):
    (tmp_path / "odd.json").write_text('[{"word": "x", "count": 2}, {"word": "q", "count": "7"}, {"word": 5, "count": 5}, {"word": "f", "count": 2.5}, {"word": "t", "count": true}, {"count": 3}, {"word": "z", "count": null}]')
    assert [tuple(r) for r in io.read_counts_json(spark, str(tmp_path / "odd.json")).collect()] == [("x", 2), ("t", 1)]
    with sqlite3.connect(tmp_path / "c.db") as db:
        db.execute("CREATE TABLE another (word TEXT, count INTEGER)")
        db.execute("CREATE TABLE word_counts (word TEXT PRIMARY KEY, count INTEGER NOT NULL)")
        db.executemany("INSERT INTO word_counts VALUES (?, ?)", [(f"w{i}", i % 7) for i in range(1000)])
    got = [tuple(r) for r in io.read_counts(spark, str(tmp_path / "c.db"), 5, 150).collect()]
    assert got == sorted(((f"w{i}", i % 7) for i in range(1000) if i % 7 >= 5), key=lambda x: (-x[1], x[0]))[:150]
    assert io.read_counts(spark, str(tmp_path / "c.db"), 99).count() == 0
    row = lambda i: spark.range(i, i + 1).selectExpr("id doc_id", "'t' text")
    for i, name in enumerate(("train-0", "train-1", "test-0")):
        row(i).toPandas().to_parquet(f"{(tmp_path / 'p' / 'sub').mkdir(parents=True, exist_ok=True) or tmp_path}/p/sub/{name}.parquet")
    both = io.read_sources(spark, {"a": str(tmp_path / "p")}, configs={"a": "sub"}, splits={"a": "train"})
    assert sorted(r.doc_id for r in both.collect()) == [0, 1]
    folder = tmp_path / "tok"
    io.save_tokenizer(toy(), str(folder), {"tokenizer_class": "TokenizersBackend", "eos_token": "e", "odd": 1})
    assert json.load(open(folder / "tokenizer_config.json"))["tokenizer_class"] == io.GENERIC
    io.save_tokenizer(toy(), str(folder), {"tokenizer_class": "Other"}, overwrite=True)
    assert json.load(open(folder / "tokenizer_config.json"))["tokenizer_class"] == "Other"
    with pytest.raises(ValueError):
        io.tokenizer_config(str(folder))
    (folder / "tokenizer_config.json").write_text('{"tokenizer_class": "TokenizersBackend", "eos_token": "e", "odd": 1}')
    (folder / "chat_template.jinja").write_text("{{ x }}")
    assert io.tokenizer_config(str(folder)) == {"tokenizer_class": io.GENERIC, "eos_token": "e", "pad_token": "e", "padding_side": "right", "chat_template": "{{ x }}"}


def test_streaming_equals_batch(spark, tmp_path):
    folder = str(tmp_path / "in")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.where("doc_id < 100").write.parquet(folder)
    go = lambda: {tuple(r) for r in incremental.counted(spark, folder, docs.schema, str(tmp_path / "check"), str(tmp_path / "counts")).collect()}
    from lexforge.operators import counts as C

    assert go() == {tuple(r) for r in C.word_counts(docs.where("doc_id < 100")).collect()}
    docs.where("doc_id >= 100").write.mode("append").parquet(folder)
    assert go() == {tuple(r) for r in C.word_counts(docs).collect()} == go()
    o = C.Options(lowercase=True, min_length=3)
    live = lambda: {tuple(r) for r in incremental.running(spark, folder, docs.schema, str(tmp_path / "check2"), str(tmp_path / "live"), o, files_per_batch=1).collect()}
    assert live() == {tuple(r) for r in C.word_counts(docs, o).collect()} == live()
    for f in (incremental.running, incremental.counted):
        with pytest.raises(ValueError, match="first documents"):
            f(spark, folder, docs.schema, "c", "t", C.Options(max_documents=3))


def test_keyed_counts(spark, tmp_path):
    from collections import Counter

    from lexforge.streaming import keyed

    table = keyed.Counts(spark, f"file://{tmp_path}/t", fan=4)
    with pytest.raises(FileNotFoundError):
        table.read()
    want, most = Counter(), 0
    batch = lambda b: frame(spark, [(f"w{b % 7}", 1), (f"v{b}", 2)], "word string, count int").coalesce(1)
    counts = lambda: {r["word"]: r["count"] for r in table.read().collect()}
    for b in range(40):
        assert table.add(batch(b), b)
        want.update({f"w{b % 7}": 1, f"v{b}": 2})
        most = max(most, len(table.state()[1]))
    assert counts() == want and not table.add(batch(39), 39) and not table.add(batch(3), 3) and counts() == want
    assert most <= 3 * 3 + 1 and [s["level"] for s in table.state()[1]] == [2, 2, 1, 1]
    assert [(s["first"], s["last"]) for s in table.state()[1]] == [(0, 15), (16, 31), (32, 35), (36, 39)]
    assert len(list((tmp_path / "t" / "segments").iterdir())) <= 4 + keyed.KEPT * 5


@pytest.mark.parametrize("step", ["segment", "commit", "merge", "merged", "vacuum"])
def test_keyed_counts_survive_a_crash(spark, tmp_path, monkeypatch, step):
    """Whatever step fails, the batch is added once when it is run again."""
    from lexforge.streaming import keyed

    table = keyed.Counts(spark, str(tmp_path / "t"), fan=2)
    batch = frame(spark, [("a", 1)], "word string, count long").coalesce(1)
    table.add(batch, 0)
    fails = {"segment": ("_segment", 1), "commit": ("_commit", 1), "merge": ("_segment", 2), "merged": ("_commit", 2), "vacuum": ("vacuum", 1)}
    name, nth = fails[step]
    real, calls = getattr(keyed.Counts, name), []

    def failing(self, *args):
        calls.append(1)
        if len(calls) == nth:
            if name == "_segment":
                real(self, *args)  # written, but never named
            raise OSError("lost")
        return real(self, *args)

    monkeypatch.setattr(keyed.Counts, name, failing)
    with pytest.raises(OSError, match="lost"):
        table.add(batch, 1)
    monkeypatch.undo()
    assert table.read().first()["count"] == (1 if step in ("segment", "commit") else 2)
    table.add(batch, 1)
    table.add(batch, 2)
    assert table.read().first()["count"] == 3
    # a second writer that saw an older state takes no number twice
    with pytest.raises(FileExistsError):
        table._commit(table.state()[0] - 1, [])
