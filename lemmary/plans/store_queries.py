"""Queries over the triple store."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmary.functions import codecs
from lemmary.functions.text import transliterate
from lemmary.operators import patterns as P
from lemmary.operators import search as S
from lemmary.operators import sources as Q
from lemmary.operators import store as T
from lemmary.operators import topics as L
from lemmary.operators.corpus import reduce_lines
from lemmary.operators.relations import reduce_counts
from lemmary.plans import loading
from lemmary.plans.flat import flat_query, flat_sql
from lemmary.runtime import materialise, shared_dir
from lemmary.sources import resources as R
from lemmary.sources.recovering_reader import parse_triples
from lemmary.sources.sinks import triple_line
from lemmary.sources.tables import table
from lemmary.streaming.triples import append_counts, stream_table
from lemmary.streaming.triples import merged_counts as merged_counts_of_stream

#: The example query and concept net of these checks.
QUERY = json.dumps(
    {
        "query": [
            {"label": "water", "source": ["boat", "лодка"], "target": ["shore", "берег", "orilla"]},
            {"label": "weather", "source": ["wind", "зима"], "target": ["туман", "well"]},
        ]
    },
    ensure_ascii=False,
)
CONCEPTS = ("Synonym;берег;shore/n", "DerivedFrom;лодка;берег", "ConceptuallyRelatedTo;shore;boat/n", "IsA;shore;road", "Synonym;short")


def _counted(spark: SparkSession, base: str) -> DataFrame:
    return T.counted_triples(table(spark, base, "triple"))


def _store(spark: SparkSession, base: str) -> DataFrame:
    """The store as searches find it: written once, then read."""
    return materialise(T.build_store(_counted(spark, base)), "store")


def _domains(spark: SparkSession) -> DataFrame:
    return R.domains(spark.createDataFrame([(QUERY,)], "value string"))


def _targets(spark: SparkSession) -> DataFrame:
    return R.targets(_domains(spark)).select("target").distinct()


def _stop(spark: SparkSession, base: str) -> DataFrame:
    return R.stop_terms(table(spark, base, "stop_list"))


def _concepts(spark: SparkSession) -> DataFrame:
    return R.concept_pairs(spark.createDataFrame([(c,) for c in CONCEPTS], "value string"))


def _topics(spark: SparkSession, base: str) -> DataFrame:
    """Words by relation as a topic table."""
    held = table(spark, base, "triple").dropDuplicates(["tid"]).select("rel", F.explode(F.array_distinct("args")).alias("term")).where("term IS NOT NULL")
    counts = held.groupBy("term", "rel").agg(F.count("*").alias("n"))
    rels = F.array(*map(F.lit, sorted(T.SIGNATURES)))
    return counts.groupBy("term").agg(F.map_from_entries(F.collect_list(F.struct("rel", "n"))).alias("m")).select("term", F.transform(rels, lambda r: F.coalesce(F.try_element_at(F.col("m"), r), F.lit(0)).cast("double")).alias("weights"))


def scan_triples(spark, base):
    """Every line of triple_csv: its triple, or NULL fields and the reason. ``freq`` is
    text here, so that 19 digits beside NULLs compare alike in every engine."""
    read = parse_triples(table(spark, base, "triple_csv"), "line_id", "line")
    slots = F.filter(F.array("arg1", "arg2", "arg3", "arg4", "arg5"), lambda a: a != "<->")
    args = F.when(F.col("reason").isNull(), F.transform(slots, T.strip_pos))
    return read.select("line_id", F.when(F.col("reason").isNull(), F.col("rel")).alias("rel"), args.alias("args"), F.col("freq").cast("string").alias("freq"), "reason")


def scan_query(spark, base):
    return _domains(spark)


def scan_stop(spark, base):
    return _stop(spark, base)


def scan_cnet(spark, base):
    return _concepts(spark)


def domain_pairs(spark, base):
    return R.domain_pairs(_domains(spark))


def target_terms(spark, base):
    return R.targets(_domains(spark))


def build_store(spark, base):
    return _store(spark, base)


def postings(spark, base):
    return T.postings(_store(spark, base))


def posting_lists(spark, base):
    coded = T.posting_lists(_store(spark, base)).select("term", "block", codecs.encode_postings(F.col("plist")).alias("c"))
    return coded.select("term", "block", F.col("c.n").alias("n"), F.col("c.pos").alias("pos"), F.col("c.tid").alias("deltas"))


def posting_round_trip(spark, base):
    coded = T.posting_lists(_store(spark, base)).select("term", codecs.encode_postings(F.col("plist")).alias("c"))
    return coded.select("term", F.inline(codecs.decode_postings(F.col("c"))))


def dictionary(spark, base):
    return T.dictionary(_counted(spark, base))


def dict_lookup(spark, base):
    terms = T.dictionary(_counted(spark, base))
    return T.lookup(terms, "берег").unionByName(T.lookup(terms, "no-such-term"))


def dense_dictionary(spark, base):
    return T.dense_ids(T.dictionary(_counted(spark, base)))


def stamp_round_trip(spark, base):
    store = _store(spark, base)
    ids = T.dense_ids(T.dictionary(_counted(spark, base)))
    return T.decode_args(T.encode_args(store, ids), ids)


def term_stats(spark, base):
    return T.term_stats(_store(spark, base))


def target_stats(spark, base):
    return Q.target_stats(_store(spark, base), _targets(spark))


def term_triples_freq(spark, base):
    return Q.term_triples_freq(_store(spark, base), _targets(spark), _stop(spark, base), 10)


def heavy_triples(spark, base):
    """Triples that are not light."""
    return _store(spark, base).where(~T.is_light(F.col("args"), F.col("rel"), T.StopTerms(_stop(spark, base))))


def stop_triples(spark, base):
    """Triples whose first argument is a stop term."""
    first = _store(spark, base).withColumn("term", F.get("args", F.lit(0)))
    return first.join(_stop(spark, base), "term", "left_semi").select("tid", "rel", "term", "freq")


def term_search(spark, base):
    terms = T.dictionary(_counted(spark, base))
    return S.search_triples(_store(spark, base), terms, [("берег", None), ("no-such-term", None)], "noun_adj")


def position_search(spark, base):
    return S.search_triples(_store(spark, base), T.dictionary(_counted(spark, base)), [("shore", 2)])


def search_many(spark, base):
    asked = spark.createDataFrame([(1, "берег", None), (2, "shore", 0), (3, "boat", None), (3, "near", None)], "qid int, term string, pos int")
    return S.search_many(_store(spark, base), asked)


def siblings(spark, base):
    return S.siblings(_store(spark, base), _targets(spark)).select("target", "tid", "kpos", "sibling_tid", "sibling", "sibling_freq")


def strict_siblings(spark, base):
    """Siblings whose other slots are all equal, empty ones too."""
    return S.siblings(_store(spark, base), _targets(spark), strict=True).select("target", "tid", "kpos", "sibling_tid", "sibling", "sibling_freq")


def stream_counts(spark, base):
    """Triples counted as a stream of files, batch by batch."""
    place = f"{shared_dir(spark).rstrip('/')}/lemmary/stream-{uuid.uuid4().hex}"
    append_counts(stream_table(spark, f"{base}/triple.parquet"), f"{place}/out", f"{place}/checkpoint").awaitTermination()
    return merged_counts_of_stream(spark, f"{place}/out")


def _find(spark, base, **more) -> DataFrame:
    return Q.find_sources(_store(spark, base), _targets(spark), _stop(spark, base), _concepts(spark), **more)


def find_sources(spark, base):
    return _find(spark, base).select("target", "rank", "source", F.round("norm_source", 8).alias("norm_source"), F.round("norm_target", 8).alias("norm_target"), "n", "src_freq", "tgt_freq")


def all_sources(spark, base):
    """All sources, without stop list and concept net, with the lowered total."""
    found = Q.find_sources(_store(spark, base), _targets(spark), k=0, minus_one=True)
    return found.select("target", "source", F.round("norm_source", 8).alias("norm_source"), F.round("norm_target", 8).alias("norm_target"), "n", "src_freq", "tgt_freq")


def source_triples(spark, base):
    """The shared triples of all sources and their shares."""
    t = _find(spark, base, k=0).select("target", "source", F.explode("triples").alias("t"))
    return t.select("target", "source", "t.rel", F.array_join("t.args", ";", "NONE").alias("args"), F.round("t.norm", 8).alias("norm"))


def source_lines(spark, base):
    """The text form of the hundred best sources of each target."""
    return Q.source_line(_find(spark, base))


def source_matrix(spark, base):
    """All sources by pattern."""
    cells = Q.source_matrix(_find(spark, base, k=0))
    return cells.select("target", "row_id", "source", "pattern", F.round("value", 8).alias("value"))


def similar_sources(spark, base):
    pairs = _find(spark, base, k=0).select("target", "source")
    return L.topic_similarity(pairs, _topics(spark, base)).select("target", "source", F.round("similarity", 8).alias("similarity"))


def filter_similar(spark, base):
    pairs = _find(spark, base, k=0).select("target", "source")
    return L.filter_similar(pairs, _topics(spark, base), 0.2).select("target", "source")


def _patterns(spark, base) -> DataFrame:
    return P.find_patterns(_store(spark, base), _targets(spark), _stop(spark, base))


def find_patterns(spark, base):
    return _patterns(spark, base).select("term", "rank", "pattern", "freq", F.round("norm_freq", 8).alias("norm_freq"))


def pattern_terms(spark, base):
    t = _patterns(spark, base).select("term", "pattern", F.explode("terms").alias("t"))
    return t.select("term", "pattern", F.col("t.term").alias("sibling"), F.col("t.freq").alias("freq"), F.col("t.n").alias("n"), F.round("t.norm", 8).alias("norm"))


def top_patterns(spark, base):
    """The hundred best patterns with their hundred best terms."""
    top = P.top_patterns(_patterns(spark, base))
    return top.select("term", "rank", "pattern", F.size("terms").alias("n_terms"))


def pattern_matrix(spark, base):
    """All patterns by term."""
    cells = P.pattern_matrix(_patterns(spark, base))
    return cells.select("term", "row_id", "pattern", "col_term", F.round("value", 8).alias("value"))


def pattern_lines(spark, base):
    """Text form of patterns with five or more terms."""
    return P.pattern_line(_patterns(spark, base))


def _once(spark, base) -> DataFrame:
    """Triples by ``tid``, counted 0 where ``freq`` is NULL."""
    return table(spark, base, "triple").dropDuplicates(["tid"]).withColumn("freq", F.coalesce("freq", F.lit(0)))


def triple_lines(spark, base):
    return _once(spark, base).select("tid", triple_line().alias("line"))


def reduce_files(spark, base):
    """Partial counts of files merged by their text lines."""
    return reduce_lines(triple_lines(spark, base))


def merged_counts(spark, base):
    return reduce_counts(_once(spark, base), ["rel", "arg1", "arg2", "arg3", "arg4", "arg5"])


def base_codes(spark, base):
    coded = table(spark, base, "triple").select("tid").distinct().withColumn("code", codecs.encode_uint(F.col("tid")))
    return coded.withColumn("back", codecs.decode_uint(F.col("code")))


def transliterated(spark, base):
    return _targets(spark).select("target", transliterate(F.col("target")).alias("latin"))


_NAMES = """scan_triples scan_query scan_stop scan_cnet domain_pairs target_terms build_store postings posting_lists posting_round_trip
dictionary dict_lookup dense_dictionary stamp_round_trip term_stats target_stats term_triples_freq heavy_triples stop_triples term_search
position_search search_many siblings strict_siblings stream_counts find_sources all_sources source_triples source_lines source_matrix similar_sources filter_similar
find_patterns pattern_terms top_patterns pattern_matrix pattern_lines triple_lines reduce_files merged_counts base_codes transliterated""".split()

QUERIES = {name: globals()[name] for name in _NAMES}

# ---------------------------------------------------------------- SQL

_BASE = """
WITH once AS (SELECT tid, any_value(rel) AS rel, any_value(args) AS args, coalesce(max(freq), 0) AS f FROM triple GROUP BY tid),
counted AS (SELECT min(tid) AS tid, rel, args, CAST(sum(f) AS BIGINT) AS freq FROM once GROUP BY rel, args),
store AS (SELECT * FROM counted WHERE freq > 5),
slots AS (SELECT tid, rel, args, freq, unnest(args) AS kterm, generate_subscripts(args, 1) - 1 AS kpos FROM store),
dict AS (SELECT DISTINCT term FROM (SELECT unnest(args) AS term FROM counted) WHERE term IS NOT NULL),
stats AS (SELECT term, count(*) AS n, CAST(sum(freq) AS BIGINT) AS freq FROM (SELECT tid, freq, unnest(list_distinct(args)) AS term FROM store) WHERE term IS NOT NULL GROUP BY term),
stop AS (SELECT DISTINCT lemma AS term FROM stop_list WHERE rank < coalesce((SELECT min(rank) FROM stop_list WHERE NOT freq >= 500 OR freq IS NULL), 1000000)),
targets AS (SELECT unnest(['shore', 'берег', 'orilla', 'туман', 'well']) AS target),
cnet AS (SELECT * FROM (VALUES ('берег', 'shore'), ('лодка', 'берег'), ('shore', 'boat')) c(arg1, arg2))
"""
_PREP_AT = "CASE rel WHEN 'subj_verb_prep_compl' THEN 3 WHEN 'subj_verb_verb_prep_noun' THEN 4 WHEN 'noun_equal_prep_noun' THEN 3 WHEN 'noun_prep_noun' THEN 2 ELSE 0 END"


def _heavy(stop: str, table: str = "store") -> str:
    content = " + ".join(f"CASE WHEN args[{i}] IS NOT NULL AND {_PREP_AT} <> {i} AND args[{i}] NOT IN ({stop}) THEN 1 ELSE 0 END" for i in range(1, 6))
    return f"SELECT * FROM {table} WHERE {content} >= 2"


_SAME = " AND ".join(f"(s.kpos = {i - 1} OR s.args[{i}] IS NULL OR s.args[{i}] = c.args[{i}])" for i in range(1, 6))
_STOP = "SELECT term FROM stop"


def _sources(stop: str, related: str, minus: int = 0) -> str:
    return (
        _BASE
        + f""", heavy AS ({_heavy(stop)}),
hs AS (SELECT tid, rel, args, freq, unnest(args) AS kterm, generate_subscripts(args, 1) - 1 AS kpos FROM heavy),
seeds AS (SELECT target, hs.* FROM hs JOIN targets ON kterm = target WHERE freq >= 5),
sib AS (SELECT s.target, s.tid, s.kpos, s.freq AS t, c.rel, c.args AS cargs, c.kterm AS source, c.freq AS s FROM seeds s JOIN hs c ON s.rel = c.rel AND s.kpos = c.kpos AND c.kterm IS DISTINCT FROM s.target AND {_SAME}),
mass AS (SELECT target, tid, kpos, sum(s) AS p FROM sib GROUP BY ALL),
met AS (SELECT sib.*, s / (p + s) AS ns, t / (p + s) AS nt FROM sib JOIN mass USING (target, tid, kpos) WHERE source IS NOT NULL AND source NOT IN ({stop}) AND NOT EXISTS ({related})),
scored AS (SELECT target, source, sum(ns) AS norm_source, sum(nt) AS norm_target, count(*) AS n, CAST(sum(s) AS BIGINT) AS src_freq, CAST(sum(t) - {minus} AS BIGINT) AS tgt_freq FROM met GROUP BY target, source),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY target ORDER BY round(norm_source, 9) DESC, source) AS INTEGER) AS rank FROM scored)
"""
    )


_RELATED = "SELECT 1 FROM cnet WHERE (arg1 = target AND arg2 = source) OR (arg2 = target AND arg1 = source)"
_FOUND = _sources(_STOP, _RELATED)
_PLAIN = _sources("SELECT NULL WHERE false", "SELECT 1 WHERE false", 1)
_SHOWN = ", ".join(f"CASE WHEN kpos = {i - 1} THEN {{pos}} ELSE args[{i}] END" for i in range(1, 6))
_TAG = "CASE WHEN rel = 'compl' THEN 'ANY' ELSE (CASE rel " + " ".join(f"WHEN '{r}' THEN [{', '.join(repr(p) for p in s)}]" for r, s in T.SIGNATURES.items() if r != "compl") + " END)[kpos + 1] END"
_TEXT = "'{' || rel || ';' || array_to_string(list_filter([" + _SHOWN.replace("{pos}", _TAG) + "], lambda x: x IS NOT NULL), ';') || '}'"
_PATTERNS = (
    _BASE
    + f""", seeds AS (SELECT target, slots.* FROM slots JOIN targets ON kterm = target
  WHERE {" + ".join(f"CASE WHEN kpos <> {i - 1} AND args[{i}] IS NOT NULL AND args[{i}] NOT IN ({_STOP}) THEN 1 ELSE 0 END" for i in range(1, 6))} > 0),
sib AS (SELECT s.target, s.tid, s.kpos, c.kterm AS sibling, c.freq AS f FROM seeds s JOIN slots c ON s.rel = c.rel AND s.kpos = c.kpos AND c.kterm <> s.target AND c.freq >= 5 AND {_SAME}),
mass AS (SELECT target, tid, kpos, sum(f) AS m FROM sib GROUP BY ALL),
pat AS (SELECT s.target, s.tid, s.kpos, {_TEXT.replace("rel", "s.rel").replace("args[", "s.args[").replace("kpos", "s.kpos")} AS pattern, s.freq, s.freq / (s.freq + coalesce(m, 0)) AS norm_freq FROM seeds s LEFT JOIN mass USING (target, tid, kpos)),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY target ORDER BY round(norm_freq, 9) DESC, freq DESC, pattern) AS INTEGER) AS rank FROM pat),
terms AS (SELECT r.target, r.rank, r.pattern, r.norm_freq AS pnorm, r.freq AS pfreq, sibling, f, stats.n, f / stats.freq AS norm, row_number() OVER (PARTITION BY r.target, r.rank ORDER BY f / stats.freq DESC, sibling) AS tn
  FROM ranked r JOIN sib USING (target, tid, kpos) JOIN stats ON sibling = term WHERE stats.n >= 3)
"""
)
_TOPICS = (
    ", held AS (SELECT DISTINCT tid, rel, unnest(args) AS term FROM once), tw AS (SELECT term, rel, count(*) AS n FROM held WHERE term IS NOT NULL GROUP BY ALL), tn AS (SELECT term, rel, n / sum(n) OVER (PARTITION BY term) AS w FROM tw), "
    "sim AS (SELECT r.target, r.source, coalesce(sum(a.w * b.w), 0.0) AS similarity FROM ranked r LEFT JOIN tn a ON a.term = r.target LEFT JOIN tn b ON b.term = r.source AND b.rel = a.rel GROUP BY r.target, r.source)"
)

ORACLE = {
    "scan_triples": loading.LINES
    + """SELECT line_id, CASE WHEN sound THEN rel END AS rel,
  CASE WHEN sound THEN list_transform(list_filter([a1, a2, a3, a4, a5], lambda a: a <> '<->'), lambda a: CASE WHEN a IN ('<NONE>', 'None-<NONE-POS>') THEN NULL ELSE regexp_replace(a, '-[^-]*$', '') END) END AS args,
  CASE WHEN sound THEN CAST(TRY_CAST(freq AS BIGINT) AS VARCHAR) END AS freq,
  CASE WHEN sound THEN NULL WHEN line IS NULL THEN 'columns' WHEN NOT quoted THEN 'quoting' WHEN n <> 7 THEN 'columns' ELSE 'value' END AS reason FROM f""",
    "scan_query": "SELECT * FROM (VALUES ('water', ['boat', 'лодка'], ['shore', 'берег', 'orilla']), ('weather', ['wind', 'зима'], ['туман', 'well'])) q(label, source, target)",
    "scan_stop": _BASE + "SELECT term FROM stop",
    "scan_cnet": _BASE + "SELECT arg1, arg2 FROM cnet",
    "domain_pairs": "SELECT label, source, unnest(target) AS target FROM (SELECT label, unnest(source) AS source, target FROM (VALUES ('water', ['boat', 'лодка'], ['shore', 'берег', 'orilla']), ('weather', ['wind', 'зима'], ['туман', 'well'])) q(label, source, target))",
    "target_terms": "SELECT label, unnest(target) AS target FROM (VALUES ('water', ['shore', 'берег', 'orilla']), ('weather', ['туман', 'well'])) q(label, target)",
    "build_store": _BASE + "SELECT tid, rel, args, freq FROM store",
    "postings": _BASE + "SELECT kterm AS term, tid, CAST(kpos AS INTEGER) AS pos FROM slots WHERE kterm IS NOT NULL",
    "posting_lists": _BASE
    + ", o AS (SELECT kterm AS term, tid, kpos, CAST(floor(tid / 65536.0) AS BIGINT) AS block, tid - coalesce(lag(tid) OVER (PARTITION BY kterm, floor(tid / 65536.0) ORDER BY tid, kpos), 0) AS d FROM slots WHERE kterm IS NOT NULL) SELECT term, block, CAST(count(*) AS INTEGER) AS n, list(CAST(kpos AS TINYINT) ORDER BY tid, kpos) AS pos, list(d ORDER BY tid, kpos) AS deltas FROM o GROUP BY term, block",
    "posting_round_trip": _BASE + "SELECT kterm AS term, tid, CAST(kpos AS INTEGER) AS pos FROM slots WHERE kterm IS NOT NULL",
    "dictionary": _BASE + "SELECT term FROM dict",
    "dict_lookup": _BASE + "SELECT word, EXISTS (SELECT 1 FROM dict WHERE term = word) AS found FROM (SELECT unnest(['берег', 'no-such-term']) AS word)",
    "dense_dictionary": _BASE + "SELECT row_number() OVER (ORDER BY term) - 1 AS term_id, term FROM dict",
    "stamp_round_trip": _BASE + "SELECT tid, rel, freq, args FROM store",
    "term_stats": _BASE + "SELECT term, n, freq FROM stats",
    "target_stats": _BASE + "SELECT target, n, freq FROM targets JOIN stats ON target = term",
    "term_triples_freq": _BASE
    + f", heavy AS ({_heavy(_STOP)} AND freq > 10), h AS (SELECT tid, freq, unnest(list_distinct(args)) AS target FROM heavy) SELECT target, count(*) AS n, CAST(sum(freq) AS BIGINT) AS freq FROM h JOIN targets USING (target) GROUP BY target",
    "heavy_triples": _BASE + _heavy(_STOP),
    "stop_triples": _BASE + "SELECT tid, rel, args[1] AS term, freq FROM store WHERE args[1] IN (SELECT term FROM stop)",
    "term_search": _BASE + "SELECT tid, rel, args, freq FROM store WHERE rel = 'noun_adj' AND list_contains(args, 'берег')",
    "position_search": _BASE + "SELECT tid, rel, args, freq FROM store WHERE args[3] = 'shore'",
    "search_many": _BASE
    + "SELECT 1 AS qid, tid, rel, args, freq FROM store WHERE list_contains(args, 'берег') UNION ALL SELECT 2, tid, rel, args, freq FROM store WHERE args[1] = 'shore' UNION ALL SELECT 3, tid, rel, args, freq FROM store WHERE list_contains(args, 'boat') AND list_contains(args, 'near')",
    "siblings": _BASE
    + f", seeds AS (SELECT target, slots.* FROM slots JOIN targets ON kterm = target) SELECT s.target, s.tid, CAST(s.kpos AS INTEGER) AS kpos, c.tid AS sibling_tid, c.kterm AS sibling, c.freq AS sibling_freq FROM seeds s JOIN slots c ON s.rel = c.rel AND s.kpos = c.kpos AND c.kterm IS DISTINCT FROM s.target AND {_SAME}",
    "strict_siblings": _BASE
    + ", seeds AS (SELECT target, slots.* FROM slots JOIN targets ON kterm = target) SELECT s.target, s.tid, CAST(s.kpos AS INTEGER) AS kpos, c.tid AS sibling_tid, c.kterm AS sibling, c.freq AS sibling_freq FROM seeds s JOIN slots c ON s.rel = c.rel AND s.kpos = c.kpos AND c.kterm IS DISTINCT FROM s.target AND len(s.args) = len(c.args) AND "
    + " AND ".join(f"(s.kpos = {i - 1} OR s.args[{i}] IS NOT DISTINCT FROM c.args[{i}])" for i in range(1, 6)),
    "stream_counts": "SELECT rel, arg1, arg2, arg3, arg4, arg5, CAST(sum(coalesce(freq, 0)) AS BIGINT) AS freq FROM triple GROUP BY ALL",
    "find_sources": _FOUND + "SELECT target, rank, source, round(norm_source, 8) AS norm_source, round(norm_target, 8) AS norm_target, n, src_freq, tgt_freq FROM ranked WHERE rank <= 100",
    "all_sources": _PLAIN + "SELECT target, source, round(norm_source, 8) AS norm_source, round(norm_target, 8) AS norm_target, n, src_freq, tgt_freq FROM scored",
    "source_triples": _FOUND
    + "SELECT target, source, rel, array_to_string(list_transform(cargs, lambda x: coalesce(x, 'NONE')), ';') AS args, round(ns, 8) AS norm FROM met",
    "source_lines": _FOUND
    + """, told AS (SELECT target, source, string_agg(printf('{%s;%.6f} ', array_to_string(list_transform(cargs, lambda x: coalesce(x, 'NONE')), ';'), ns), '' ORDER BY ns DESC, rel DESC, cargs DESC) AS t FROM met GROUP BY target, source)
SELECT target, rank, printf('%s\t%.8f\t%.8f\t%d\t%d\t%d\t%s', source, norm_source, norm_target, n, src_freq, tgt_freq, t) AS line FROM ranked JOIN told USING (target, source) WHERE rank <= 100""",
    "source_matrix": _FOUND
    + f""", cells AS (SELECT r.target, r.rank - 1 AS row_id, r.source, m.rel, m.cargs AS args, m.ns, list_position(list_reverse(m.cargs), m.source) AS back FROM met m JOIN ranked r USING (target, source)),
c2 AS (SELECT *, len(args) - back AS kpos FROM cells)
SELECT target, CAST(row_id AS INTEGER) AS row_id, source, {_TEXT} AS pattern, round(min(ns), 8) AS value FROM c2 GROUP BY ALL""",
    "similar_sources": _FOUND + _TOPICS + "SELECT target, source, round(similarity, 8) AS similarity FROM sim",
    "filter_similar": _FOUND + _TOPICS + "SELECT target, source FROM sim WHERE similarity >= 0.2",
    "find_patterns": _PATTERNS + "SELECT target AS term, rank, pattern, freq, round(norm_freq, 8) AS norm_freq FROM ranked",
    "pattern_terms": _PATTERNS + "SELECT target AS term, pattern, sibling, f AS freq, n, round(norm, 8) AS norm FROM terms",
    "top_patterns": _PATTERNS + "SELECT r.target AS term, r.rank, r.pattern, CAST(least(100, (SELECT count(*) FROM terms t WHERE t.target = r.target AND t.rank = r.rank)) AS INTEGER) AS n_terms FROM ranked r WHERE r.rank <= 100",
    "pattern_matrix": _PATTERNS + "SELECT target AS term, CAST(rank - 1 AS INTEGER) AS row_id, pattern, sibling AS col_term, round(norm, 8) AS value FROM terms",
    "pattern_lines": _PATTERNS
    + "SELECT target AS term, rank, printf('%d\t%.8f\t%s\t%d\t%s', rank - 1, any_value(pnorm), any_value(pattern), count(*), string_agg(printf('%s(f=%d,c=%d,nf=%.8f) ', sibling, f, n, norm), '' ORDER BY tn)) AS line FROM terms GROUP BY target, rank HAVING count(*) >= 5",
    "triple_lines": "SELECT DISTINCT tid, concat_ws(', ', rel, arg1, arg2, arg3, arg4, arg5, CAST(coalesce(freq, 0) AS VARCHAR)) AS line FROM triple",
    "reduce_files": "SELECT key, CAST(sum(f) AS BIGINT) AS freq FROM (SELECT DISTINCT tid, concat_ws(', ', rel, arg1, arg2, arg3, arg4, arg5) AS key, coalesce(freq, 0) AS f FROM triple) GROUP BY key",
    "merged_counts": "SELECT rel, arg1, arg2, arg3, arg4, arg5, CAST(sum(freq) AS BIGINT) AS freq FROM (SELECT DISTINCT tid, rel, arg1, arg2, arg3, arg4, arg5, coalesce(freq, 0) AS freq FROM triple) GROUP BY ALL",
    "base_codes": """WITH RECURSIVE d AS (SELECT DISTINCT tid, tid AS rest, '' AS code FROM triple UNION ALL
  SELECT tid, rest // 52, substr('abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(rest % 52 + 1 AS BIGINT), 1) || code FROM d WHERE rest > 0 OR code = '')
SELECT tid, code, tid AS back FROM d WHERE rest = 0 AND code <> ''""",
    "transliterated": "SELECT * FROM (VALUES ('shore', 'shore'), ('берег', 'bereg'), ('orilla', 'orilla'), ('туман', 'tuman'), ('well', 'well')) t(target, latin)",
}

_ARRAYS = {
    "scan_triples": ["args"],
    "scan_query": ["source", "target"],
    "build_store": ["args"],
    "posting_lists": ["pos", "deltas"],
    "stamp_round_trip": ["args"],
    "heavy_triples": ["args"],
    "term_search": ["args"],
    "position_search": ["args"],
    "search_many": ["args"],
}
for _name, _columns in _ARRAYS.items():
    QUERIES[_name] = flat_query(QUERIES[_name], _columns)
    ORACLE[_name] = flat_sql(ORACLE[_name], _columns)
