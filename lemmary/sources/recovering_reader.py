"""Triple rows from text that may be broken: an error-recovering reader.

A recursive-descent grammar over whole texts (one line or many), a method for each rule:

    text   = record { end record }
    record = field { ", " field }
    field  = quoted | bare
    quoted = '"' { any but '"' | '""' } '"'
    bare   = { any but '"' }
    end    = [ carriage return ] line feed

A record that breaks the grammar gives one error with its place, and reading resumes
at the next validated record start: a line whose first two fields are a relation and a
sound argument. So a quote that was never closed does not swallow the records after it,
and the lines between are part of the broken record. Whole records are then typed
field by field.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmary.functions.arrow import chunks
from lemmary.functions.relations import PARTS_OF_SPEECH, RELATIONS
from lemmary.functions.terms import MARKERS

FIELDS = ("rel", "arg1", "arg2", "arg3", "arg4", "arg5", "freq")
MOST = 2**63 - 1


@dataclass
class Found:
    """A typed record, or an error with its place (line from 1, column from 1)."""

    line: int
    fields: list[str] | None
    freq: int | None = None
    reason: str | None = None
    where: str | None = None
    column: int | None = None


class Broken(Exception):
    """The grammar is broken at field ``field`` (from 0), which starts at ``at``."""

    def __init__(self, field: int, at: int):
        super().__init__(field, at)
        self.field, self.at = field, at


class TripleGrammar:
    """The grammar above; ``many`` allows several records in one text."""

    def __init__(self, many: bool = False, relations: tuple[str, ...] = RELATIONS, parts: tuple[str, ...] = PARTS_OF_SPEECH):
        self.many, self.relations = many, frozenset(relations)
        end = r"\r?(?:\n|\Z)" if many else r"\r?\Z"
        names = "|".join(map(re.escape, relations))
        # tokens: each rule's own characters with the separator or the end that follow
        self._quoted_token = re.compile(rf'"([^"]*(?:""[^"]*)*)"(?:(, )|{end})')
        self._bare_token = re.compile(rf"""({'[^"\n]' if many else '[^"]'}*?)(?:(, )|{end})""")
        self._anchor = re.compile(rf'(?<=\n)"?(?:{names})"?, ')
        self._argument = re.compile(rf"(?s:.+)-(?:{'|'.join(parts)})\Z")
        self._forbidden = re.compile("[\x00-\x1f\x7f-\x9f\ufffd]")
        self._number = re.compile(r"[0-9]+\Z")

    def parse(self, text: str | None) -> Iterator[Found]:
        """All records of a text. NULL is one record that is no line at all."""
        if text is None:
            yield Found(1, None, reason="columns", where="line", column=1)
            return
        at, line = 0, 1
        while True:
            start = at
            try:
                fields, columns, at = self._record(text, start)
                yield self._typed(line, start, fields, columns)
            except Broken as broken:
                yield Found(line, None, reason="quoting", where=self._name(broken.field + 1), column=broken.at - start + 1)
                at = self._resume(text, start)
            if at >= len(text):
                return
            line += text.count("\n", start, at)

    def _record(self, text: str, at: int) -> tuple[list[str], list[int], int]:
        """Fields, where they start, and where the next record does."""
        fields, columns, more = [], [], True
        while more:
            columns.append(at)
            value, more, at = self._field(text, at, len(fields))
            fields.append(value)
        return fields, columns, at

    def _field(self, text: str, at: int, number: int) -> tuple[str, bool, int]:
        """Its value, whether a separator follows, and where that or the record ends."""
        return (self._quoted if text.startswith('"', at) else self._bare)(text, at, number)

    def _quoted(self, text: str, at: int, number: int) -> tuple[str, bool, int]:
        m = self._quoted_token.match(text, at)
        if m is None:
            raise Broken(number, at)
        value = m[1]
        # a record starts inside: the quote was never closed
        if self.many and "\n" in value and self._next_record(text, at, m.end()) is not None:
            raise Broken(number, at)
        return value.replace('""', '"'), m[2] is not None, m.end()

    def _bare(self, text: str, at: int, number: int) -> tuple[str, bool, int]:
        m = self._bare_token.match(text, at)
        if m is None:
            raise Broken(number, at)
        return m[1], m[2] is not None, m.end()

    def _next_record(self, text: str, at: int, end: int) -> int | None:
        """The first validated record start in ``text[at:end]``."""
        for m in self._anchor.finditer(text, at, end):
            if self._starts_record(text, m.start()):
                return m.start()
        return None

    def _starts_record(self, text: str, at: int) -> bool:
        """True if a relation and a sound argument stand there as whole fields of one line."""
        try:
            rel, more, after = self._token(text, at)
            if rel not in self.relations or not more:
                return False
            argument, more, _ = self._token(text, after)
        except Broken:
            return False
        return more and "\n" not in argument and self._is_argument(argument)

    def _token(self, text: str, at: int) -> tuple[str, bool, int]:
        m = (self._quoted_token if text.startswith('"', at) else self._bare_token).match(text, at)
        if m is None:
            raise Broken(0, at)
        return m[1].replace('""', '"'), m[2] is not None, m.end()

    def _resume(self, text: str, start: int) -> int:
        """The next validated record start, else the end."""
        found = self._next_record(text, start + 1, len(text)) if self.many else None
        return len(text) if found is None else found

    def _typed(self, line: int, start: int, fields: list[str], columns: list[int]) -> Found:
        if len(fields) != len(FIELDS):
            return Found(line, None, reason="columns", where="line", column=1)
        for i, value in enumerate(fields):
            if not (value in self.relations if i == 0 else self._is_argument(value) if i < 6 else self._is_count(value)):
                return Found(line, None, reason="value", where=FIELDS[i], column=columns[i] - start + 1)
        return Found(line, fields[:6], int(fields[6]))

    def _is_argument(self, value: str) -> bool:
        if value in MARKERS:
            return True
        return bool(self._argument.match(value)) and value == value.strip() and not self._forbidden.search(value)

    def _is_count(self, value: str) -> bool:
        return bool(self._number.match(value)) and 1 <= int(value.lstrip("0")[:20] or "0") <= MOST

    @staticmethod
    def _name(n: int) -> str:
        return FIELDS[n - 1] if n <= len(FIELDS) else "line"


_OUT = "line_in_text int, rel string, arg1 string, arg2 string, arg3 string, arg4 string, arg5 string, freq bigint, reason string, field string, column int"


def parse_triples(df: DataFrame, id_col: str, text_col: str, many: bool = False) -> DataFrame:
    """Every record of ``text_col``: ``id_col, line_in_text``, the typed ``rel, arg1 ..
    arg5, freq`` and, of unsound records, NULL there and ``reason, field, column``.

    ``reason`` is the first that applies: ``quoting`` (broken quoting), ``columns``
    (not 7 fields; also NULL and empty text), ``value`` (a value that is not sound);
    ``field`` and ``column`` say where. With ``many`` a text holds one record a line,
    quoted fields may run over line ends, and a record with broken quoting reaches to
    the next validated record start; else a text is one record, whatever it holds. Repeated rows give repeated records, empty tables none. Columns besides
    the two are not read.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = TripleGrammar(many)
        for t in chunks(batches, rows=65_536, size=32 << 20):
            found = [(i, f) for i, text in enumerate(t.column("text").to_pylist()) for f in grammar.parse(text)]
            ids = t.column("id").combine_chunks().take(pa.array([i for i, _ in found], pa.int64()))
            values = [pa.array([f.fields[k] if f.fields else None for _, f in found], pa.string()) for k in range(6)]
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array([f.line for _, f in found], pa.int32()),
                    *values,
                    pa.array([f.freq for _, f in found], pa.int64()),
                    pa.array([f.reason for _, f in found], pa.string()),
                    pa.array([f.where for _, f in found], pa.string()),
                    pa.array([f.column for _, f in found], pa.int32()),
                ],
                names=["id", "line_in_text", *FIELDS, "reason", "field", "column"],
            )

    used = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = used.schema["id"].dataType.simpleString()
    return used.mapInArrow(run, f"id {kind}, {_OUT}").withColumnRenamed("id", id_col)


def sound_triples(parsed: DataFrame) -> DataFrame:
    """The typed records of :func:`parse_triples`."""
    return parsed.where("reason IS NULL").drop("reason", "field", "column")


def unsound_lines(parsed: DataFrame) -> DataFrame:
    """The records of :func:`parse_triples` that could not be read, and why."""
    return parsed.where("reason IS NOT NULL").drop(*FIELDS)
