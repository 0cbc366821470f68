"""Corpus tools, sinks and incremental forms on files."""

from pyspark.sql import functions as F

from lemmary.operators.corpus import FORMATS, combine, reduce_lines, sentence_ends, split_corpus
from lemmary.operators.relations import fold_triples
from lemmary.runtime import is_small, materialise, maybe_broadcast, shared_dir
from lemmary.sources.sinks import triple_line, write_chunks, write_encoded, write_lines, write_postings, write_store
from lemmary.streaming.triples import append_counts, append_sentences, crawl, merged_counts, running_counts, stream_table

TRIPLE = "rel string, arg1 string, arg2 string, arg3 string, arg4 string, arg5 string, freq bigint"


def test_combine_and_reduce(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, text in (("a.csv", "nn, a, b, 3\nnn, c, d, 1\n"), ("b.csv", "nn, a, b, 4\nbad line\n"), ("x.txt", "nn, a, b, 100\n"), ("sub/c.csv", "nn, a, b, 5\n")):
        (tmp_path / name).write_text(text, encoding="utf-8")
    flat = {x.key: x.freq for x in reduce_lines(combine(spark, str(tmp_path), "*.csv")).collect()}
    assert flat == {"nn, a, b": 7, "nn, c, d": 1}
    deep = {x.key: x.freq for x in reduce_lines(combine(spark, str(tmp_path), "*.csv", recursive=True)).collect()}
    assert deep["nn, a, b"] == 12


def lines(spark, *text):
    return spark.createDataFrame([("f", i, x) for i, x in enumerate(text)], "file string, line_no int, line string")


def test_split_plain(spark):
    df = lines(spark, *["word"] * 4, "", "", *["word"] * 4, "", "", *["word"] * 4)
    got = [(x.line_no, x.chunk) for x in split_corpus(df, 3).orderBy("line_no").collect()]
    assert got == [(i, 1) for i in range(4)] + [(6, 2), (7, 2), (8, 2), (9, 2), (12, 3), (13, 3), (14, 3), (15, 3)]
    whole = split_corpus(df, 1)
    assert {x.chunk for x in whole.collect()} == {1} and whole.count() == 12
    assert split_corpus(df.limit(0), 4).count() == 0


def test_split_tokens(spark):
    token = lambda word, kind="NN", at="2": "\t".join([word, kind, "l", "p", at, "6", "7"])
    df = lines(spark, "<text id=1>", token("a", at="1"), token(".", "SENT"), token("b", at="1"), "</text>")
    ends = [(x.ends, x.out) for x in sentence_ends(df, "ruwac").orderBy("line_no").collect()]
    assert [e for e, _ in ends] == ["before", "before", "after", "before", "before"]
    assert ends[1][1] == "1\ta\tl\tp\tp\tNN\t6\t7\t_\t_" and ends[0][1] is None
    assert split_corpus(df, 2, "ruwac").count() == 3


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("nn", "a", "b", "<->", "<->", "<->", 2), ("nn", "c", "d", "<->", "<->", "<->", 9)], TRIPLE)
    write_lines(df, triple_line(), str(tmp_path / "t"), [F.desc("freq")], one_file=True)
    assert [x.value for x in spark.read.text(str(tmp_path / "t")).collect()] == ["nn, c, d, <->, <->, <->, 9", "nn, a, b, <->, <->, <->, 2"]
    store = spark.createDataFrame([(1, "nn", ["a", None], 3)], "tid bigint, rel string, args array<string>, freq bigint")
    write_store(store, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).first().args == ["a", None]
    write_postings(spark.createDataFrame([("a", 1, 0)], "term string, tid bigint, pos int"), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).where("term = 'a'").count() == 1
    write_encoded(spark.createDataFrame([("ёж",)], "t string"), "t", str(tmp_path / "e"), "UTF-16BE")
    assert "ёж" in "".join(f.read_text(encoding="utf-16-be") for f in (tmp_path / "e").glob("part-*"))  # some parts are empty
    write_chunks(split_corpus(lines(spark, "a", "", "", "b"), 2), str(tmp_path / "c"))
    assert spark.read.text(str(tmp_path / "c")).count() == 2


def test_running_and_appended_counts(spark, tmp_path):
    rows = [("nn", "a", "b", "<->", "<->", "<->", 2), ("nn", "a", "b", "<->", "<->", "<->", None), ("nn", "c", "d", "<->", "<->", "<->", 1)]
    df = spark.createDataFrame(rows, TRIPLE)
    for _ in range(2):
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    running = running_counts(stream_table(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    running.awaitTermination()
    assert sorted((x.arg1, x.freq) for x in spark.table("counted").collect()) == sorted((x.arg1, x.freq) for x in fold_triples(spark.read.parquet(str(tmp_path / "in"))).collect())
    for _ in range(2):  # the second start finds nothing new
        append_counts(stream_table(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted((x.arg1, x.freq) for x in merged_counts(spark, str(tmp_path / "out")).collect()) == [("a", 4), ("c", 2)]
    df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    append_counts(stream_table(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert sorted((x.arg1, x.freq) for x in merged_counts(spark, str(tmp_path / "out")).collect()) == [("a", 6), ("c", 3)]


def test_growing_sentence_index(spark, tmp_path):
    part = lambda f, t: spark.createDataFrame([(f, t)], "file string, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for i in range(2):
        part(f"f{i}", "% t\n[1]:a-nn(e1,x1) & [2]:b-nn(e2,x2)\n[1]:a-nn(e1,x1)")
        append_sentences(stream_table(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out/sentences")).count() == 2 * (i + 1)
        assert spark.read.parquet(str(tmp_path / "out/postings")).where("term = 'a'").count() == 2 * (i + 1)


def test_crawl_and_plug_ins(spark, tmp_path):
    """Batches of a stream are searched for connected words; terms and stored form are given."""
    text = "% t\n[1]:wind-nn(e1,x1) & [2]:carry-vb(e2,x1,x3) & [3]:boat-nn(e3,x3)\n[1]:wind-nn(e1,x1) & [2]:boat-nn(e2,x2)"
    pairs = spark.createDataFrame([("d", "wind", "boat")], "label string, source string, target string")
    for i in range(2):
        spark.createDataFrame([(f"f{i}", text)], "file string, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        crawl(stream_table(spark, str(tmp_path / "in")), pairs, str(tmp_path / "found"), str(tmp_path / "cp")).awaitTermination()
        assert sorted((x.file, x.sid) for x in spark.read.parquet(str(tmp_path / "found")).collect()) == [(f"f{j}", 0) for j in range(i + 1)]
    tagged = lambda preds: F.transform(preds, lambda p: F.concat(p["lemma"], F.lit("/"), p["pos"]))
    append_sentences(stream_table(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp2"), tagged, lambda p: p.select("file", "sid")).awaitTermination()
    assert {x.term for x in spark.read.parquet(str(tmp_path / "out/postings")).collect()} == {"wind/NN", "carry/VB", "boat/NN"}
    assert set(spark.read.parquet(str(tmp_path / "out/sentences")).columns) == {"file", "sid", "batch"}


def test_encoded_lines_are_kept_as_they_are(spark, tmp_path):
    rows = ["", "  blanks  ", 'a "quote", and\\', "tab\tin"]
    write_encoded(spark.createDataFrame([(x,) for x in rows], "t string").coalesce(1), "t", str(tmp_path / "e"))
    assert [f.read_text(encoding="utf-8") for f in (tmp_path / "e").glob("part-*")] == ["".join(x + "\n" for x in rows)]


def test_other_formats_can_be_added(spark, monkeypatch):
    monkeypatch.setitem(FORMATS, "dots", lambda df: df.withColumns({"ends": F.when(F.col("line") == ".", "after"), "out": F.col("line")}))
    assert {x.chunk for x in split_corpus(lines(spark, "aa", "b", ".", "c", "d", "."), 2, "dots").collect()} == {1, 2}


def test_runtime(spark):
    df = spark.range(10)
    assert materialise(df, "x").count() == 10 and is_small(df, 10) and not is_small(df, 9)
    assert shared_dir(spark) == shared_dir(spark)
    assert maybe_broadcast(df, 5) is df
