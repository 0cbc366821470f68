"""Every command on small files, from logical forms to matrices."""

import json

from lemmary.__main__ import COMMANDS, main
from lemmary.operators.sources import HEADER

LF = "% The pain.\nid(1).\n[1]:boat-nn(e1,x1) & [2]:cross-vb(e2,x1,x3) & [3]:lake-nn(e3,x3)\n% Deep.\n[1]:boat-nn(e1,x1) & [2]:deep-adj(e2,x1)\n"


def test_commands(spark, tmp_path, capsys):
    place = lambda name: str(tmp_path / name)
    run = lambda *a: main([str(x) for x in a], spark)
    text = lambda name: [x.value for x in spark.read.text(place(name)).collect()]
    (tmp_path / "lf").mkdir()
    for i in range(8):
        body = LF if i % 2 else LF.replace("boat", "ship")
        (tmp_path / "lf" / f"{i}.lf").write_text(body, encoding="utf-8")

    run("triples", "--input", place("lf"), "--output", place("t1"))
    assert sorted(text("t1")) == sorted(f"{r}, {w}-NN, {rest}, 4" for w in ("boat", "ship") for r, rest in (("subj_verb_dirobj", "cross-VB, lake-NN, <->, <->"), ("noun_adj", "deep-ADJ, <->, <->, <->")))
    run("reduce", "--input", place("t1"), "--output", place("t2"), "--pattern", "*.txt")
    assert len(text("t2")) == 4
    run("index", "--input", place("t2"), "--output", place("store"), "--min-freq", 3)
    query = tmp_path / "q.json"
    query.write_text(json.dumps({"query": [{"label": "l", "source": ["ship", "lake"], "target": ["boat"]}]}), encoding="utf-8")
    (tmp_path / "stop.csv").write_text("1,900,deep,ADJ\n", encoding="utf-8")
    run("sources", "--index", place("store"), "--query", query, "--output", place("s"), "--min-freq", 4, "--stop", place("stop.csv"))
    found = spark.read.parquet(place("s/table")).collect()
    assert [(x.target, x.source, x.n) for x in found] == [("boat", "ship", 1)]
    run("matrix", "--input", place("s"), "--output", place("m"))
    assert spark.read.parquet(place("m/cells")).first().pattern == "{subj_verb_dirobj;NN;cross;lake}"
    assert text("m/rows") == ["0\tship"] and text("m/columns") == ["0\t{subj_verb_dirobj;NN;cross;lake}"] and text("m/dense") == [f"{found[0].norm_source:.16f} "]
    assert [x.split("\t")[0] for x in text("s/text/target=boat")] == ["source", "ship"] and text("s/text")[0] == HEADER
    assert sorted(x.tid for x in spark.read.parquet(place("store/triples")).collect()) == [0, 1, 2, 3]
    run("patterns", "--index", place("store"), "--word", "boat", "--output", place("p"))
    assert {x.pattern for x in spark.read.parquet(place("p/table")).collect()} == {"{subj_verb_dirobj;NN;cross;lake}", "{noun_adj;NN;deep}"}

    run("sentences", "--input", place("lf"), "--output", place("i"))
    run("search", "--index", place("i"), "--words", "boat,ship", "--words", "deep", "--output", place("hits"))
    assert text("hits") == ["Deep."] * 8 and "8 sentences found" in capsys.readouterr().out
    run("top", "--index", place("store"), "--word", "boat", "--relation", "noun_adj")
    assert capsys.readouterr().out == "noun_adj: boat, deep: 4\n"
    run("connected", "--index", place("i"), "--query", query, "--output", place("c1"))
    run("connected", "--input", place("lf"), "--query", query, "--output", place("c2"))
    assert sorted(text("c1")) == sorted(text("c2")) and sum("source:lake, target:boat" in x for x in text("c1")) == 4
    run("combine", "--input", place("lf"), "--output", place("all"))
    assert len(text("all")) == 40
    run("combine", "--input", place("lf"), "--output", place("wide"), "--output-charset", "UTF-16BE")
    assert sum(f.read_text(encoding="utf-16-be").count("The pain.") for f in (tmp_path / "wide").glob("part-*")) == 8
    run("split", "--input", place("lf"), "--output", place("cut"), "--chunks", 2)
    assert len(text("cut")) == 40


def test_lookup(spark, tmp_path, capsys):
    spark.createDataFrame([(7, "boat")], "term_id int, term string").write.parquet(str(tmp_path / "terms"))
    for word in ("boat", "none"):
        main(["lookup", "--index", str(tmp_path), "--word", word], spark)
    assert capsys.readouterr().out == "boat: 7\nnone: not found\n"
    assert all(run.__doc__ for run, _ in COMMANDS.values())
