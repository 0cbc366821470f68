"""Problem 2: lines of triple_csv as typed triples, or apart with a reason."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmary.functions.relations import PARTS_OF_SPEECH, RELATIONS
from lemmary.sources.recovering_reader import parse_triples, sound_triples, unsound_lines
from lemmary.sources.tables import table


def _parsed(spark: SparkSession, base: str) -> DataFrame:
    return parse_triples(table(spark, base, "triple_csv"), "line_id", "line")


def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return unsound_lines(_parsed(spark, base)).select("line_id", "reason")


def p2_errors(spark: SparkSession, base: str) -> DataFrame:
    """Unsound lines with reason, field and column."""
    return unsound_lines(_parsed(spark, base)).drop("line_in_text")


def p2_triples(spark: SparkSession, base: str) -> DataFrame:
    """Sound lines as typed triples."""
    return sound_triples(_parsed(spark, base)).drop("line_in_text")


#: Lines of a file that are read as one text by :func:`p2_texts`.
BLOCK_LINES = 1_000


def p2_texts(spark: SparkSession, base: str) -> DataFrame:
    """Every record of the files, read as texts of up to a thousand lines in which quoted
    fields may run over line ends and reading resumes after broken ones."""
    lines = table(spark, base, "triple_csv").select("file", F.floor((F.col("line_no") - 1) / BLOCK_LINES).alias("block"), F.struct("line_no", F.coalesce("line", F.lit("")).alias("line")).alias("l"))
    texts = lines.groupBy("file", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["line"]), "\n").alias("text"))
    records = parse_triples(texts.select(F.struct("file", "block").alias("at"), "text"), "at", "text", many=True)
    return records.select("at.file", "at.block", *[c for c in records.columns if c != "at"])


QUERIES = {"p2_found": p2_found, "p2_errors": p2_errors, "p2_triples": p2_triples, "p2_texts": p2_texts}

_REL = "|".join(RELATIONS)
_POS = "|".join(PARTS_OF_SPEECH)
_BAD = r"\x00-\x1f\x7f-\x{9f}\x{fffd}"
_BLANK = r" \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_BARE = rf'(?:[^",{_BAD}{_BLANK}]|,[^ ",{_BAD}])(?:[^",{_BAD}]|,+[^ ",{_BAD}])*'
_QUOTED = rf'(?:[^"{_BAD}{_BLANK}]|"")(?:[^"{_BAD}]|"")*'
_NONE = "<NONE>|<->|None-<NONE-POS>"
_ARG = rf'(?:{_NONE}|"(?:{_NONE})"|{_BARE}-(?:{_POS})|"{_QUOTED}-(?:{_POS})")'
_SOUND = rf'(?:{_REL}|"(?:{_REL})")(?:, {_ARG})' + r'{5}, (?:[0-9]+|"[0-9]+")'

_CHECKED = f"""
WITH l AS (SELECT line_id, regexp_replace(line, '\\r$', '') AS line FROM triple_csv),
  c AS (SELECT line_id, line,
    regexp_full_match(line, '(?:"(?:[^"]|"")*"|[^"]*)(?:, (?:"(?:[^"]|"")*"|[^"]*))*') AS quoted,
    len(string_split(regexp_replace(line, '(^|, )"(?:[^"]|"")*"', '\\1x', 'g'), ', ')) AS n,
    regexp_full_match(line, '{_SOUND}') AND coalesce(TRY_CAST(regexp_extract(line, '([0-9]+)"?$', 1) AS HUGEINT) BETWEEN 1 AND 9223372036854775807, false) AS sound
  FROM l)
"""

_FIELD = '"(?:[^"]|"")*"|[^"]*'
_NAMES = ["rel", "a1", "a2", "a3", "a4", "a5", "freq"]
_UNQUOTED = """CASE WHEN g.{0}[1] = '"' THEN replace(g.{0}[2:-2], '""', '"') ELSE g.{0} END"""
_REASON = "CASE WHEN line IS NULL THEN 'columns' WHEN NOT quoted THEN 'quoting' WHEN n <> 7 THEN 'columns' ELSE 'value' END"

#: Lines with their seven fields, unquoted; ``sound`` is never NULL.
LINES = (
    _CHECKED
    + f""", g AS (SELECT c.*, regexp_extract(line, '^{", ".join([f"({_FIELD})"] * 7)}$', {_NAMES}) AS g FROM c),
f AS (SELECT line_id, line, quoted, n, g, coalesce(quoted AND n = 7 AND sound, false) AS sound, {", ".join(f"{_UNQUOTED.format(x)} AS {x}" for x in _NAMES)} FROM g)
"""
)
_WHOLE_FIELDS = r'(?:(?:"(?:[^"]|"")*"|(?:[^",]|,+[^ ",])*,*), )*'
_IS_SOUND = [
    f"regexp_full_match(g.rel, '(?:{_REL}|\"(?:{_REL})\")')",
    *[f"regexp_full_match(g.a{i}, '{_ARG}')" for i in range(1, 6)],
    "regexp_full_match(freq, '[0-9]+') AND coalesce(TRY_CAST(freq AS HUGEINT) BETWEEN 1 AND 9223372036854775807, false)",
]
_FIRST = "CASE " + " ".join(f"WHEN NOT ({test}) THEN {i}" for i, test in enumerate(_IS_SOUND)) + " END"
_BEFORE = "[" + ", ".join(" + ".join(["1", *[f"length(g.{x}) + 2" for x in _NAMES[:i]]]) for i in range(7)) + "]"

ORACLE = {
    "p2_errors": LINES
    + f""", e AS (SELECT line_id, {_REASON} AS reason, regexp_extract(line, '^{_WHOLE_FIELDS}', 0) AS before, {_FIRST} AS bad, {_BEFORE} AS starts FROM f WHERE NOT sound),
k AS (SELECT *, CASE reason WHEN 'quoting' THEN len(string_split(regexp_replace(before, '"(?:[^"]|"")*"', 'x', 'g'), ', ')) - 1 WHEN 'value' THEN bad ELSE 7 END AS place FROM e)
SELECT line_id, reason, coalesce(['rel', 'arg1', 'arg2', 'arg3', 'arg4', 'arg5', 'freq'][place + 1], 'line') AS field, CAST(CASE reason WHEN 'quoting' THEN length(before) + 1 WHEN 'value' THEN starts[bad + 1] ELSE 1 END AS INTEGER) AS "column" FROM k""",
    "p2_triples": LINES + "SELECT line_id, rel, a1 AS arg1, a2 AS arg2, a3 AS arg3, a4 AS arg4, a5 AS arg5, CAST(freq AS BIGINT) AS freq FROM f WHERE sound",
    "p2_found": _CHECKED + "SELECT line_id, " + _REASON + " AS reason FROM c WHERE line IS NULL OR NOT quoted OR n <> 7 OR NOT sound",
}
