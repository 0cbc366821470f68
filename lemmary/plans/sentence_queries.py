"""Queries over logical forms: parsing, relations, sentence search, connection.

Two corpora are read: the logical-form files among the documents, and one sentence
built from every triple of the triple table, which holds all relations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmary.operators import metaphor as M
from lemmary.operators import relations as E
from lemmary.operators import search as S
from lemmary.plans.flat import flat_query, flat_sql
from lemmary.sources import logical_form as LF
from lemmary.sources.sinks import match_line
from lemmary.sources.tables import table

#: A sentence for each triple, as an SQL expression both engines read. ``w`` holds
#: the terms, NULL where a slot is empty. Every sentence also has an adverb without
#: verb and a word of unknown part of speech.


def _nn(at: int, x: str) -> str:
    return f"coalesce(concat('[{at}]:', replace({{w{at}}}, '&&', '+'), '-nn(e{at},{x})'), '')"


def _pr(at: int, pos: str, args: str) -> str:
    return f"coalesce(concat('[{at}]:', replace({{w{at}}}, '&&', '+'), '-{pos}(e{at},{args})'), '')"


_FORMS = {
    "subj_verb_dirobj": (_nn(1, "x1"), _pr(2, "vb", "x1,x3,u1"), _nn(3, "x3")),
    "subj_verb_indirobj": (_nn(1, "x1"), _pr(2, "vb", "x1,u1,x3"), _nn(3, "x3")),
    "subj_verb_instr": (_nn(1, "x1"), _pr(2, "vb", "x1,u1,u2"), _nn(3, "x3"), "'instr(e9,e2,x3)'"),
    "subj_verb": (_nn(1, "x1"), _pr(2, "vb", "x1,u1,u2")),
    "subj_verb_prep_compl": (_nn(1, "x1"), _pr(2, "vb", "x1,u1,u2"), _pr(3, "in", "e2,x4"), _nn(4, "x4")),
    "subj_verb_verb_prep_noun": (_nn(1, "x1"), _pr(2, "vb", "x1,e3,u2"), _pr(3, "vb", "x1,u3,u4"), _pr(4, "in", "e3,x5"), _nn(5, "x5")),
    "subj_verb_verb": (_nn(1, "x1"), _pr(2, "vb", "x1,e3,u2"), _pr(3, "vb", "u1,u3,u4")),
    "noun_adj": (_nn(1, "x1"), _pr(2, "adj", "x1"), "'[5]:near-in(e5,x8,x9)'", "'[6]:place-nn(e6,x9)'"),
    "noun_verb_adv": (_nn(1, "x1"), _pr(2, "vb", "x1,u1,u2"), _pr(3, "rb", "e2")),
    "noun_equal_prep_noun": (_nn(1, "x1"), _nn(2, "x2"), "'equal(e9,x1,x2)'", _pr(3, "in", "x2,x4"), _nn(4, "x4")),
    "nn": (_nn(1, "x1"), _nn(2, "x1")),
    "nnn": (_nn(1, "x1"), _nn(2, "x1"), _nn(3, "x1")),
    "noun_equal_noun": (_nn(1, "x1"), _nn(2, "x2"), "'equal(e9,x1,x2)'"),
    "noun_prep_noun": (_nn(1, "x1"), _pr(2, "in", "x1,x3"), _nn(3, "x3")),
    "compl": (_nn(1, "x1"), _pr(2, "vb", "u1,u2,u3"), "'compl(e9,x1,e2)'"),
}


def _form(word: str) -> str:
    """The SQL expression of a line; ``word`` is how the i-th term is read."""
    slots = {f"w{i}": word.format(i=i - 1, j=i) for i in range(1, 6)}
    cases = " ".join(f"WHEN '{rel}' THEN concat_ws(' & ', {', '.join(p.format(**slots) for p in parts)})" for rel, parts in _FORMS.items())
    tail = "concat_ws(' & ', '[7]:so-rb(e7,e8)', '[8]:and-cnj(e8,e9)')"
    return f"replace(replace(concat_ws(' & ', CASE rel {cases} END, {tail}), ' &  & ', ' & '), ' &  & ', ' & ')"


def _built(spark: SparkSession, base: str) -> DataFrame:
    # extraction costs far more than its rows are long: all cores get some, whatever their bytes
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    once = table(spark, base, "triple").select("tid", "rel", "args").repartition(n, "tid").dropDuplicates(["tid"])
    line = F.regexp_replace(F.expr(_form("get(args, {i})")), "^ & ", "")
    lines = once.select(F.col("tid").alias("file"), F.lit(0).cast("bigint").alias("sid"), F.col("rel").alias("raw_text"), line.alias("line"))
    return LF.parse_sentences(lines)


def _documents(spark: SparkSession, base: str) -> DataFrame:
    docs = table(spark, base, "documents").where(F.col("text").contains("\nid("))
    return LF.parse_sentences(LF.scan_sentences(LF.lines_of_texts(docs, "doc_id", "text")))


def scan_lf(spark, base):
    return _documents(spark, base).select("file", "sid", "raw_text", "line")


def parse_lf(spark, base):
    p = LF.predicates(_documents(spark, base))
    return p.select("file", "sid", "ppos", "pid", "lemma", "pos", "extra", "a1", "a2", "a3", "a4")


def norm_args(spark, base):
    """How many arguments each predicate has and how many are present."""
    p = LF.predicates(_documents(spark, base))
    return p.select("file", "sid", "ppos", F.size("args").alias("n"), F.size(F.array_compact("args")).alias("present"))


def map_pos(spark, base):
    return LF.predicates(_documents(spark, base)).groupBy("pos").agg(F.count("*").alias("n"))


def by_pos(spark, base):
    return LF.by_pos(_documents(spark, base), "ADJ").select("file", "sid", "lemma", "a2")


def by_extra(spark, base):
    return LF.by_extra(_built(spark, base), "equal").select("file", "extra", "a2", "a3")


def sentence_lemmas(spark, base):
    return LF.lemmas(_documents(spark, base))


def hooked_nouns(spark, base):
    """Noun sets on the second argument of each verb."""
    rows = _documents(spark, base).select("file", "sid", F.explode(F.transform(E.of_pos(F.col("preds"), "VB"), lambda v: F.struct(v["ppos"].alias("ppos"), E.hook_set(F.col("preds"), v["a2"], 2, "NN").alias("nouns")))).alias("h"))
    return rows.select("file", "sid", "h.ppos", "h.nouns").where("nouns IS NOT NULL")


def extract_documents(spark, base):
    return E.extract_triples(_documents(spark, base))


def fold_documents(spark, base):
    return E.fold_triples(E.extract_triples(_documents(spark, base)))


def extract_built(spark, base):
    return E.extract_triples(_built(spark, base)).drop("sid")


def sentence_postings(spark, base):
    return S.sentence_postings(_documents(spark, base))


def search_sentences(spark, base):
    return S.search_sentences(S.sentence_postings(_documents(spark, base)), [["shore", "берег"], ["carry", "нести", "near"]])


def search_all(spark, base):
    return S.search_sentences(S.sentence_postings(_documents(spark, base)), [["shore", "берег", "miller", "мельник"], ["carry", "нести", "near", "в"]], "and")


def found_text(spark, base):
    hits = search_all(spark, base)
    return hits.join(_documents(spark, base), ["file", "sid"]).select("file", "sid", "raw_text")


def index_size(spark, base):
    return _documents(spark, base).agg(F.count("*").alias("sentences"), F.max("sid").alias("largest_sid"))


_PAIRS = (("a", "miller", "carry"), ("a", "мельник", "нести"), ("b", "wind", "near"), ("b", "берег", "в"), ("c", "miller carry", "near"), ("b", "ветер", "в"))


def _pairs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(_PAIRS), "label string, source string, target string")


def occurrences(spark, base):
    return M.occurrences(_documents(spark, base), _pairs(spark).select("label", F.col("source").alias("term")).distinct())


def find_connected(spark, base):
    return M.find_connected(_documents(spark, base), _pairs(spark))


def match_lines(spark, base):
    found = M.find_connected(_documents(spark, base), _pairs(spark))
    return found.select("file", match_line().alias("line"))


def find_mentions(spark, base):
    return M.find_mentions(_documents(spark, base), _pairs(spark))


def connected_variables(spark, base):
    """Groups of connected variables of each sentence."""
    groups = _documents(spark, base).select("file", "sid", F.explode(M.components(F.col("preds"))).alias("g"))
    return groups.select("file", "sid", F.array_join(F.array_sort("g"), " ").alias("variables"))


def _one(name: str):
    def run(spark: SparkSession, base: str) -> DataFrame:
        return E.extract_relation(_built(spark, base), name).drop("sid", "rel")

    return run


_NAMES = """scan_lf parse_lf norm_args map_pos by_pos by_extra sentence_lemmas hooked_nouns extract_documents fold_documents extract_built
sentence_postings search_sentences search_all found_text index_size occurrences find_connected match_lines find_mentions connected_variables""".split()

QUERIES = {name: globals()[name] for name in _NAMES} | {f"rel_{name}": _one(name) for name in [*E.ACTIVE, *E.INACTIVE]}

# ---------------------------------------------------------------- SQL

_POS = "CASE g.tag " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LF.TAGS.items()) + " END"
#: Each predicate is matched once: a word gives its four parts, a name its arguments.
_PARSE = f"""
ps AS (SELECT file, sid, generate_subscripts(parts, 1) AS i, unnest(parts) AS s FROM (SELECT file, sid, string_split(replace(replace(replace(trim(line), ' & ', '&'), '((', '('), '))', ')'), '&') AS parts FROM sent)),
pg AS (SELECT file, sid, i, s, CASE WHEN s[1] = '[' THEN regexp_extract(s, '^([^:]*):(.*)-([^-(]*)\\(([^-(]*)\\)$', ['pid', 'lemma', 'tag', 'args']) END AS g,
    CASE WHEN s[1] <> '[' THEN regexp_extract(s, '^([^(]+)\\((?:.*\\()?([^(]*)\\)$', ['name', 'args']) END AS e FROM ps),
pa AS MATERIALIZED (SELECT file, sid, i, g.pid AS pid, replace(g.lemma, ':', '') AS lemma, {_POS} AS pos, nullif(e.name, '') AS extra,
    list_transform(string_split(coalesce(g.args, e.args), ','), lambda a: CASE WHEN a = '' OR a[1] = 'u' THEN NULL ELSE a END) AS args FROM pg),
p AS (SELECT file, sid, CAST(row_number() OVER (PARTITION BY file, sid ORDER BY i) - 1 AS INTEGER) AS ppos, pid, nullif(lemma, '') AS lemma, pos, extra, args, args[1] AS a1, args[2] AS a2, args[3] AS a3, args[4] AS a4,
    coalesce(lemma, 'None') || '-' || coalesce(pos, '<NONE-POS>') AS w FROM pa WHERE (lemma <> '' AND pos IS NOT NULL) OR extra IS NOT NULL),
h AS MATERIALIZED (SELECT DISTINCT q.file, q.sid, q.slot, q.x, t.ppos, t.pos, t.lemma, t.w, t.a1, t.a2, t.a3 FROM (
    SELECT file, sid, 1 AS slot, a1 AS x, lemma FROM p UNION ALL SELECT file, sid, 2, a2, lemma FROM p UNION ALL SELECT file, sid, 3, a3, lemma FROM p) q
  JOIN p t ON q.file = t.file AND q.sid = t.sid AND q.lemma = t.lemma WHERE q.x IS NOT NULL),
st AS (SELECT file, sid, slot, x, pos, string_agg(DISTINCT lemma, '&&' ORDER BY lemma) || '-' || pos AS s FROM h GROUP BY file, sid, slot, x, pos HAVING count(*) <= 4)
"""
_DOCS = f"""
WITH ln AS (SELECT doc_id AS file, generate_subscripts(l, 1) AS n, unnest(l) AS line FROM (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM documents WHERE contains(text, chr(10) || 'id('))),
lm AS (SELECT *, CASE WHEN line[1:3] = '%%%' THEN substr(line, 5) WHEN line[1] = '%' THEN substr(line, 3) END AS c,
  line <> '' AND line[1] <> '%' AND NOT starts_with(line, 'id(') AND NOT regexp_matches(line, '^[0-9]') AS ok FROM ln),
lw AS (SELECT *, last_value(c IGNORE NULLS) OVER (PARTITION BY file ORDER BY n ROWS UNBOUNDED PRECEDING) AS raw_text FROM lm),
sent AS (SELECT file, row_number() OVER (PARTITION BY file ORDER BY n) - 1 AS sid, raw_text, line FROM lw WHERE ok),
{_PARSE}
"""
_BUILT = f"""
WITH o AS (SELECT tid, any_value(rel) AS rel, any_value(args) AS args FROM triple GROUP BY tid),
sent AS (SELECT tid AS file, CAST(0 AS BIGINT) AS sid, rel AS raw_text, regexp_replace({_form("args[{j}]")}, '^ & ', '') AS line FROM o),
{_PARSE}
"""


def _slots(*args: str) -> str:
    return ", ".join(f"{a} AS arg{i + 1}" for i, a in enumerate([*args, *["'<->'"] * (5 - len(args))]))


def _set(alias: str, of: str, x: str, slot: int = 2, pos: str = "NN", left: bool = False) -> str:
    return f"{'LEFT ' if left else ''}JOIN st {alias} ON {alias}.file = {of}.file AND {alias}.sid = {of}.sid AND {alias}.slot = {slot} AND {alias}.pos = '{pos}' AND {alias}.x = {x}"


def _hook(alias: str, of: str, x: str, slot: int, pos: str) -> str:
    return f"JOIN h {alias} ON {alias}.file = {of}.file AND {alias}.sid = {of}.sid AND {alias}.slot = {slot} AND {alias}.pos = '{pos}' AND {alias}.x = {x}"


def _none(of: str, x: str, *slots: int) -> str:
    return " AND ".join(f"NOT EXISTS (SELECT 1 FROM h z WHERE z.file = {of}.file AND z.sid = {of}.sid AND z.pos = 'PREP' AND z.slot = {s} AND z.x = {x})" for s in slots)


def _key(*lemmas: str) -> str:
    return f"array_to_string(list_sort([{', '.join(lemmas)}]), '')"


_SUBJ = "coalesce(s.s, '<NONE>')"
_WIN = "SELECT * EXCLUDE (k, o, rn) FROM (SELECT *, row_number() OVER (PARTITION BY file, sid, k ORDER BY o) AS rn FROM ({})) WHERE rn = 1"
_COMPL_SIDE = "SELECT file, sid, x, w AS s FROM h WHERE slot = 1 AND pos IN ('VB', 'RB') UNION ALL SELECT file, sid, x, s FROM st WHERE slot IN (1, 2) AND pos IN ('NN', 'ADJ')"

_RELATION = {
    "subj_verb_dirobj": f"SELECT v.file, v.sid, {_slots(_SUBJ, 'v.w', 'b.s')} FROM p v {_set('b', 'v', 'v.a3')} {_set('s', 'v', 'v.a2', left=True)} WHERE v.pos = 'VB' AND b.s IS DISTINCT FROM s.s",
    "subj_verb_indirobj": f"SELECT v.file, v.sid, {_slots(_SUBJ, 'v.w', 'b.s')} FROM p v {_set('b', 'v', 'v.a4')} {_set('s', 'v', 'v.a2', left=True)} WHERE v.pos = 'VB' AND b.s IS DISTINCT FROM s.s",
    "subj_verb_instr": f"SELECT v.file, v.sid, {_slots(_SUBJ, 'v.w', 'b.s')} FROM p v JOIN p i ON i.file = v.file AND i.sid = v.sid AND i.extra = 'instr' AND i.a2 = v.a1 {_set('b', 'v', 'i.a3')} {_set('s', 'v', 'v.a2', left=True)} WHERE v.pos = 'VB' AND b.s IS DISTINCT FROM s.s",
    "subj_verb": f"SELECT v.file, v.sid, {_slots('s.s', 'v.w')} FROM p v {_set('s', 'v', 'v.a2')} WHERE v.pos = 'VB' AND v.a3 IS NULL AND v.a4 IS NULL",
    "subj_verb_prep_compl": f"SELECT v.file, v.sid, {_slots(_SUBJ, 'v.w', 'q.w', 'b.s')} FROM p v JOIN p q ON q.file = v.file AND q.sid = v.sid AND q.a2 = v.a1 {_set('b', 'v', 'q.a3')} {_set('s', 'v', 'v.a2', left=True)} WHERE v.pos = 'VB' AND v.a2 IS NOT NULL AND b.s IS DISTINCT FROM s.s",
    "subj_verb_verb_prep_noun": "SELECT file, sid, arg1, arg2, arg3, arg4, arg5 FROM (SELECT *, dense_rank() OVER (PARTITION BY file, sid, k ORDER BY o) AS rn FROM ("
    f"SELECT v.file, v.sid, {_key('v.lemma', 'y.lemma')} AS k, [v.ppos, y.ppos] AS o, {_slots(_SUBJ, 'v.w', 'y.w', 'q.w', 'b.s')} FROM p v {_hook('y', 'v', 'v.a3', 1, 'VB')} {_hook('q', 'v', 'y.a1', 2, 'PREP')} {_set('b', 'v', 'q.a3')} {_set('s', 'v', 'v.a2', left=True)} WHERE v.pos = 'VB' AND y.ppos <> v.ppos AND b.s IS DISTINCT FROM s.s)) WHERE rn = 1",
    "subj_verb_verb": _WIN.format(f"SELECT v.file, v.sid, {_key('v.lemma', 'y.lemma')} AS k, [v.ppos, y.ppos] AS o, {_slots('s.s', 'v.w', 'y.w')} FROM p v {_hook('y', 'v', 'v.a3', 1, 'VB')} {_set('s', 'v', 'v.a2')} WHERE v.pos = 'VB' AND y.ppos <> v.ppos AND {_none('v', 'v.a1', 2)}"),
    "noun_adj": f"SELECT v.file, v.sid, {_slots('s.s', 'v.w')} FROM p v {_set('s', 'v', 'v.a2')} WHERE v.pos = 'ADJ' AND {_none('v', 'v.a2', 2, 3)}",
    "noun_verb_adv": f"SELECT r.file, r.sid, {_slots(_SUBJ, 'v.w', 'r.w')} FROM p r {_hook('v', 'r', 'r.a2', 1, 'VB')} {_set('s', 'r', 'v.a2', left=True)} WHERE r.pos = 'RB' AND {_none('r', 'r.a1', 2, 3)}",
    "noun_equal_prep_noun": _WIN.format(
        f"SELECT e.file, e.sid, {_key('n1.lemma', 'n3.lemma')} AS k, [e.ppos, n1.ppos, n2.ppos, q.ppos, n3.ppos] AS o, {_slots('n1.w', 'n2.w', 'q.w', 'n3.w')} FROM p e {_hook('n1', 'e', 'e.a2', 2, 'NN')} {_hook('n2', 'e', 'e.a3', 2, 'NN')} {_hook('q', 'e', 'n2.a2', 2, 'PREP')} {_hook('n3', 'e', 'q.a3', 2, 'NN')} WHERE e.extra = 'equal' AND n1.ppos <> n2.ppos AND n3.ppos <> n1.ppos AND n3.ppos <> n2.ppos"
    ),
    "nn": _WIN.format(
        f"SELECT v.file, v.sid, {_key('v.lemma', 'any_value(z.lemma)')} AS k, v.ppos AS o, {_slots('v.w', 'any_value(z.w)')} FROM p v {_hook('z', 'v', 'v.a2', 2, 'NN')} WHERE v.pos = 'NN' AND z.ppos <> v.ppos AND {_none('v', 'v.a2', 2)} GROUP BY v.file, v.sid, v.ppos, v.lemma, v.w HAVING count(*) = 1 AND any_value(z.lemma) <> v.lemma"
    ),
    "nnn": _WIN.format(
        f"SELECT v.file, v.sid, array_to_string(list_sort(list_concat([v.lemma], list(z.lemma))), '') AS k, v.ppos AS o, {_slots('v.w', 'list(z.w ORDER BY z.ppos)[1]', 'list(z.w ORDER BY z.ppos)[2]')} FROM p v {_hook('z', 'v', 'v.a2', 2, 'NN')} WHERE v.pos = 'NN' AND z.ppos <> v.ppos AND {_none('v', 'v.a2', 2)} GROUP BY v.file, v.sid, v.ppos, v.lemma, v.w HAVING count(*) = 2 AND len(list_distinct(list_concat([v.lemma], list(z.lemma)))) = 3"
    ),
    "noun_equal_noun": f"SELECT e.file, e.sid, {_slots('a.s', 'b.s')} FROM p e {_set('a', 'e', 'e.a2')} {_set('b', 'e', 'e.a3')} WHERE e.extra = 'equal' AND a.s <> b.s AND {_none('e', 'e.a3', 2)}",
    "noun_prep_noun": _WIN.format(f"SELECT q.file, q.sid, {_key('n1.lemma', 'n2.lemma')} AS k, [q.ppos, n1.ppos, n2.ppos] AS o, {_slots('n1.w', 'q.w', 'n2.w')} FROM p q {_hook('n1', 'q', 'q.a2', 2, 'NN')} {_hook('n2', 'q', 'q.a3', 2, 'NN')} WHERE q.pos = 'PREP' AND n1.ppos <> n2.ppos"),
    "compl": f"SELECT c.file, c.sid, {_slots('a.s', 'b.s')} FROM p c JOIN ({_COMPL_SIDE}) a ON a.file = c.file AND a.sid = c.sid AND a.x = c.a2 JOIN ({_COMPL_SIDE}) b ON b.file = c.file AND b.sid = c.sid AND b.x = c.a3 WHERE c.extra = 'compl'",
    "nn_prep": f"SELECT q.file, q.sid, {_slots('a.s', 'q.w', 'b.s')} FROM p q {_set('a', 'q', 'q.a2')} {_set('b', 'q', 'q.a3')} WHERE q.pos = 'PREP' AND a.s <> b.s",
    "noun_adj_prep_noun": f"SELECT v.file, v.sid, {_slots('n1.w', 'v.w', 'q.w', 'n2.w')} FROM p v {_hook('n1', 'v', 'v.a2', 2, 'NN')} JOIN p q ON q.file = v.file AND q.sid = v.sid AND q.pos = 'PREP' {_hook('n2', 'v', 'q.a3', 2, 'NN')} WHERE v.pos = 'ADJ' AND n1.ppos <> n2.ppos",
}
_ALL = " UNION ALL ".join(f"SELECT file, sid, '{r}' AS rel, arg1, arg2, arg3, arg4, arg5 FROM ({_RELATION[r]})" for r in E.ACTIVE)
_OCC = (
    ", q AS (SELECT * FROM (VALUES "
    + ", ".join(str(x) for x in _PAIRS)
    + ") q(label, source, target)), wd AS (SELECT DISTINCT file, sid, lemma FROM p WHERE lemma IS NOT NULL), ls AS (SELECT file, sid, list(lemma) AS l FROM wd GROUP BY ALL)"
)
_CC = """, cc(file, sid, ppos, root) AS (
  SELECT file, sid, ppos, ppos FROM p UNION
  SELECT c.file, c.sid, c.ppos, o.ppos FROM cc c JOIN p m ON m.file = c.file AND m.sid = c.sid AND m.ppos = c.root JOIN p o ON o.file = c.file AND o.sid = c.sid AND list_has_any(list_filter(m.args, lambda x: x IS NOT NULL), list_filter(o.args, lambda x: x IS NOT NULL)))"""
_LINKED = (
    _DOCS.replace("WITH ", "WITH RECURSIVE ", 1)
    + _CC
    + _OCC
    + """, m AS (SELECT DISTINCT ls.file, ls.sid, q.label AS domain, q.source, q.target FROM ls JOIN q ON list_has_all(l, string_split(source, ' ')) AND list_has_all(l, string_split(target, ' '))
  JOIN p a ON a.file = ls.file AND a.sid = ls.sid AND list_contains(string_split(source, ' '), a.lemma) JOIN p b ON b.file = ls.file AND b.sid = ls.sid AND list_contains(string_split(target, ' '), b.lemma)
  JOIN cc ON cc.file = ls.file AND cc.sid = ls.sid AND cc.ppos = a.ppos AND cc.root = b.ppos WHERE len(list_filter(a.args, lambda x: x IS NOT NULL)) > 0 AND len(list_filter(b.args, lambda x: x IS NOT NULL)) > 0),
f AS (SELECT m.*, raw_text FROM m JOIN sent USING (file, sid))
"""
)
_HITS = (
    _DOCS
    + ", w AS (SELECT DISTINCT file, sid, lemma AS term FROM p WHERE pos IS NOT NULL), f AS (SELECT file, sid FROM (SELECT DISTINCT file, sid FROM w WHERE term IN ('shore', 'берег', 'miller', 'мельник')) JOIN (SELECT DISTINCT file, sid FROM w WHERE term IN ('carry', 'нести', 'near', 'в')) USING (file, sid)) "
)

ORACLE = {
    "scan_lf": _DOCS + "SELECT file, sid, raw_text, line FROM sent",
    "parse_lf": _DOCS + "SELECT file, sid, ppos, pid, lemma, pos, extra, a1, a2, a3, a4 FROM p",
    "norm_args": _DOCS + "SELECT file, sid, ppos, CAST(len(args) AS INTEGER) AS n, CAST(len(list_filter(args, lambda x: x IS NOT NULL)) AS INTEGER) AS present FROM p",
    "map_pos": _DOCS + "SELECT pos, count(*) AS n FROM p GROUP BY pos",
    "by_pos": _DOCS + "SELECT file, sid, lemma, a2 FROM p WHERE pos = 'ADJ'",
    "by_extra": _BUILT + "SELECT file, extra, a2, a3 FROM p WHERE extra = 'equal'",
    "sentence_lemmas": _DOCS + "SELECT sent.file, sent.sid, coalesce(list(lemma ORDER BY ppos) FILTER (lemma IS NOT NULL), []) AS lemmas FROM sent LEFT JOIN p ON p.file = sent.file AND p.sid = sent.sid GROUP BY ALL",
    "hooked_nouns": _DOCS + f"SELECT v.file, v.sid, v.ppos, s.s AS nouns FROM p v {_set('s', 'v', 'v.a2')} WHERE v.pos = 'VB'",
    "extract_documents": _DOCS + _ALL,
    "fold_documents": _DOCS + f"SELECT rel, arg1, arg2, arg3, arg4, arg5, count(*) AS freq FROM ({_ALL}) GROUP BY ALL",
    "extract_built": _BUILT + f"SELECT file, rel, arg1, arg2, arg3, arg4, arg5 FROM ({_ALL})",
    "sentence_postings": _DOCS + "SELECT DISTINCT lemma AS term, file, sid FROM p WHERE pos IS NOT NULL",
    "search_sentences": _DOCS
    + ", w AS (SELECT DISTINCT file, sid, lemma AS term FROM p WHERE pos IS NOT NULL) SELECT DISTINCT file, sid FROM w WHERE term IN ('shore', 'берег') UNION ALL SELECT DISTINCT file, sid FROM w WHERE term IN ('carry', 'нести', 'near')",
    "search_all": _HITS + "SELECT file, sid FROM f",
    "found_text": _HITS + "SELECT file, sid, raw_text FROM f JOIN sent USING (file, sid)",
    "index_size": _DOCS + "SELECT count(*) AS sentences, max(sid) AS largest_sid FROM sent",
    "occurrences": _DOCS + _OCC + "SELECT DISTINCT label, source AS term, file, sid FROM ls JOIN q ON list_has_all(l, string_split(source, ' '))",
    "find_connected": _LINKED + "SELECT file, sid, domain, source, target, raw_text FROM f",
    "match_lines": _LINKED + "SELECT file, '[id:' || sid || ', domain:' || domain || ', source:' || source || ', target:' || target || '] ' || chr(10) || ' ' || raw_text || chr(10) AS line FROM f",
    "find_mentions": _DOCS
    + _OCC
    + ", s AS (SELECT file, sid, label, min(source) AS source FROM ls JOIN q ON list_has_all(l, string_split(source, ' ')) GROUP BY ALL), t AS (SELECT file, sid, label, min(target) AS target FROM ls JOIN q ON list_has_all(l, string_split(target, ' ')) GROUP BY ALL) SELECT file, sid, label AS domain, source, target FROM s JOIN t USING (file, sid, label)",
    "connected_variables": _DOCS.replace("WITH ", "WITH RECURSIVE ", 1)
    + _CC
    + ", g AS (SELECT file, sid, ppos, min(root) AS root FROM cc GROUP BY ALL), v AS (SELECT DISTINCT file, sid, root, unnest(args) AS a FROM g JOIN p USING (file, sid, ppos)) SELECT file, sid, string_agg(a, ' ' ORDER BY a) AS variables FROM v WHERE a IS NOT NULL GROUP BY file, sid, root",
} | {f"rel_{r}": _BUILT + f"SELECT file, arg1, arg2, arg3, arg4, arg5 FROM ({sql})" for r, sql in _RELATION.items()}

QUERIES["sentence_lemmas"] = flat_query(QUERIES["sentence_lemmas"], ["lemmas"])
ORACLE["sentence_lemmas"] = flat_sql(ORACLE["sentence_lemmas"], ["lemmas"])
