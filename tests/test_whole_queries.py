"""Queries that read or return everything where an older one stops at a limit."""

import __spark_entry__ as entry

QUERIES = entry.queries()


def test_every_line_is_scanned(spark, tmp_path):
    most = 2**63 - 1
    lines = [
        "nn, a-NN, b-NN, <->, <->, <->, 7",
        "nn, a-NN, b-NN, <->, <->, <->, 7\r",
        '"nn", "a, ""b""-NN", <NONE>, <->, "<->", <->, "8"',
        f"nn, a,b-NN, c-d-NN, <->, <->, <->, {most}",
        "nn, a-NN, b-NN, <->, <->, <->, 0",
        'nn, a"-NN, b-NN, <->, <->, <->, 7',
        "nn, a-NN, 7",
        None,
    ]
    spark.createDataFrame(list(enumerate(lines)), "line_id bigint, line string").write.parquet(f"{tmp_path}/triple_csv.parquet")
    got = {x.line_id: tuple(x)[1:] for x in QUERIES["scan_triples"](spark, str(tmp_path)).collect()}
    unread = {i: (None, None, None, why) for i, why in ((4, "value"), (5, "quoting"), (6, "columns"), (7, "columns"))}
    assert got == {0: ("nn", "a;b", "7", None), 1: ("nn", "a;b", "7", None), 2: ("nn", 'a, "b";NULL', "8", None), 3: ("nn", "a,b;c-d", str(most), None)} | unread


def test_no_small_rank_limits(spark, tmp_path):
    """Of 120 words that share a pattern with a target all or the best hundred come out."""
    words = ["shore", *(f"w{i:03}" for i in range(120))]
    triples = [(w, other) for w in words for other in ("kill", "go", "stay")]
    rows = [(i, "subj_verb", [w, v], f"{w}-NN", f"{v}-VB", "<->", "<->", "<->", 100 - i % 7) for i, (w, v) in enumerate(triples)]
    kind = "tid bigint, rel string, args array<string>, arg1 string, arg2 string, arg3 string, arg4 string, arg5 string, freq bigint"
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/triple.parquet")
    spark.createDataFrame([], "rank int, freq double, lemma string, pos string").write.parquet(f"{tmp_path}/stop_list.parquet")
    n = {name: QUERIES[name](spark, str(tmp_path)).count() for name in ("source_triples", "source_lines", "source_matrix", "similar_sources", "filter_similar", "pattern_matrix")}
    assert n == {"source_triples": 360, "source_lines": 100, "source_matrix": 360, "similar_sources": 120, "filter_similar": 120, "pattern_matrix": 360}
    assert {x.n_terms for x in QUERIES["top_patterns"](spark, str(tmp_path)).collect()} == {100}


def test_counts_that_are_missing_count_nothing(spark, tmp_path):
    rows = [(1, "nn", "a-NN", "b-NN", None), (1, "nn", "a-NN", "b-NN", None), (2, "nn", "a-NN", "b-NN", 3), (3, "nn", "c-NN", "d-NN", None)]
    kind = "tid bigint, rel string, arg1 string, arg2 string, arg3 string, arg4 string, arg5 string, freq bigint"
    spark.createDataFrame([(*r[:4], "<->", "<->", "<->", r[4]) for r in rows], kind).write.parquet(f"{tmp_path}/triple.parquet")
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    assert sorted((x.arg1, x.freq) for x in run("merged_counts")) == [("a-NN", 3), ("c-NN", 0)]
    assert sorted(x.freq for x in run("reduce_files")) == [0, 3]
    assert sorted(x.line for x in run("triple_lines")) == [f"nn, {a}, <->, <->, <->, {n}" for a, n in (("a-NN, b-NN", 0), ("a-NN, b-NN", 3), ("c-NN, d-NN", 0))]
