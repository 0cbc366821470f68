"""Texts that break off: hidden storage limits and unfinished endings.

A column that was written into a field of fixed size shows a crowd of texts at one
length, but only in the unit the field was measured in. So each text's length is
recomputed under several encodings, entity and JSON escaping and newline
conversion; lengths are counted by source, and a crowd with almost nothing beyond
it exposes the limit. Then endings are inspected, each in the light of its source's
limit: what is a closing line, an abbreviation, a natural ellipsis or a source that
writes without marks is learned from the whole corpus.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lemmary.functions.arrow import chunks
from lemmary.runtime import materialise, maybe_broadcast

#: Characters around a limit: a cut can remove part of a character, or a closing blank.
SLACK = 4
#: Counters a task holds before it hands them on.
KEYS_HELD = 400_000
#: Characters of last lines a task holds before it hands them on.
LINES_HELD = 16 << 20


#: From plain to unusual: of equally crowded units the first is taken.
UNITS = ("chars", "utf8", "utf16", "crlf_chars", "crlf_utf8", "entity_chars", "entity_utf8", "entity_quote_chars", "entity_quote_utf8", "json_chars", "json_utf8", "json_ascii")


def measure(text: str) -> dict[str, int]:
    """Length of a text in the units a storage limit may be given in: characters,
    UTF-8 bytes and UTF-16 units; after escaping entities, with and without quotes,
    or as JSON, with and without non-ASCII escapes; with two-character newlines. A
    replacement character at the end is what is left of a cut one and not counted."""
    text = text.rstrip("\ufffd")
    chars, octets = len(text), len(text.encode("utf-8", "surrogatepass"))
    wide = 0 if text.isascii() else sum(1 for c in text if c > "\uffff") if max(text) > "\uffff" else 0
    quote, newline = text.count('"'), text.count("\n")
    entity = 4 * text.count("&") + 3 * (text.count("<") + text.count(">"))
    json = quote + newline + text.count("\\") + text.count("\t") + text.count("\r")
    other = 0 if text.isascii() else chars - len(text.encode("ascii", "ignore"))
    return {
        "chars": chars,
        "utf8": octets,
        "utf16": chars + wide,
        "crlf_chars": chars + newline,
        "crlf_utf8": octets + newline,
        "entity_chars": chars + entity,
        "entity_utf8": octets + entity,
        "entity_quote_chars": chars + entity + 5 * quote,
        "entity_quote_utf8": octets + entity + 5 * quote,
        "json_chars": chars + json,
        "json_utf8": octets + json,
        "json_ascii": chars + json + 5 * other + 6 * wide,
    }


_LETTER = r"[^\W\d_]"
_STOP = re.compile(rf"\b({_LETTER}+)\.(?=\s+(\S))")
_ELLIPSIS = re.compile(r"(?:…|\.\.\.)(?=\s+\S)")
_PURE_MARK = re.compile(r"[\W_]+")


def _before_last(text: str, end: int) -> str:
    """The two words before the last word that ends at ``end``."""
    found: list[str] = []
    while end > 0 and len(found) < 3:
        end = _rstrip(text, end)
        start = end
        while start > 0 and not text[start - 1].isspace():
            start -= 1
        if start < end:
            found.append(text[start:end].lower())
        end = start
    return " ".join(reversed(found[1:]))


def _rstrip(text: str, end: int, marks: str | None = None) -> int:
    """Where ``text[:end]`` ends without white space, or without ``marks``."""
    while end > 0 and (text[end - 1].isspace() if marks is None else text[end - 1] in marks):
        end -= 1
    return end


def _survey(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts over whole texts, summed within the task while they fit. ``len``: lengths
    by source and the set of units that have them; ``close``: last lines; ``go`` and ``stop``: words before a full
    stop after which the sentence goes on or ends; ``dots``: words before an ellipsis."""

    def batch(seen: Counter) -> pa.RecordBatch:
        columns = [pa.array([k[i] for k in seen], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))]
        return pa.RecordBatch.from_arrays([*columns, pa.array(list(seen.values()), pa.int64())], names=["kind", "source", "what", "of", "n"])

    seen: Counter[tuple[str, str | None, str, int]] = Counter()
    held = 0
    for t in chunks(batches, rows=8192, size=32 << 20):
        for source, text in zip(t.column("source").to_pylist(), t.column("text").to_pylist(), strict=True):
            same: dict[int, int] = {}  # most units agree on most texts
            for bit, size in enumerate(measure(text).values()):
                same[size] = same.get(size, 0) | 1 << bit
            for size, units in same.items():
                seen["len", source, str(units), size] += 1
            text = text.rstrip()
            head, _, last = text.rpartition("\n")
            if head.strip() and last.strip():
                # of a text under several identifiers, one
                seen["close", None, last.strip(), xxhash.xxh64_intdigest(head) & 0x7FFFFFFFFFFFFFFF] = 1
                held += len(last)
            for word, after in _STOP.findall(text):
                seen["go" if after.islower() or after.isdigit() else "stop", None, word.lower(), 0] += 1
            if "…" in text or "..." in text:
                for m in _ELLIPSIS.finditer(text):
                    if lead := _before_last(text, m.start()):
                        seen["dots", None, lead, 0] += 1
        seen["text", None, "", 0] += t.num_rows
        if len(seen) > KEYS_HELD or held > LINES_HELD:
            yield batch(seen)
            seen, held = Counter(), 0
    if seen:
        yield batch(seen)


def survey(df: DataFrame) -> DataFrame:
    """One pass over ``source, text``: ``kind, source, what, of, n`` of the whole corpus."""
    raw = df.select("source", "text").where("text IS NOT NULL").mapInArrow(_survey, "kind string, source string, what string, of bigint, n bigint")
    return materialise(raw.groupBy("kind", "source", "what", "of").agg(F.sum("n").alias("n")), "survey")


def storage_limits(surveyed: DataFrame, least: int = 5, crowd: float = 10.0, beyond: float = 0.01) -> DataFrame:
    """``source, unit, size, n_at, n``: at most one limit for each source.

    A size is a limit if at least ``least`` texts end within 4 units below it,
    ``crowd`` times as many as lengths from its half on let expect, and at most
    the share ``beyond`` is longer. Of several the one with the largest crowd is
    kept (then the smaller size, then the plainer unit). NULL is a source like any other.
    """
    mask = F.col("what").cast("int")
    units = F.array_compact(F.array(*[F.when(mask.bitwiseAND(1 << i) != 0, unit) for i, unit in enumerate(UNITS)]))
    counts = surveyed.where("kind = 'len'").select("source", F.explode(units).alias("unit"), F.col("of").cast("int").alias("len"), "n")
    counts = materialise(counts.groupBy("source", "unit", "len").agg(F.sum("n").alias("k")), "lengths")
    by_len = Window.partitionBy("source", "unit").orderBy("len")  # distinct lengths of a source
    near = F.sum("k").over(by_len.rangeBetween(-SLACK + 1, 0))
    upto = F.sum("k").over(by_len.rangeBetween(Window.unboundedPreceding, 0))
    whole = F.sum("k").over(Window.partitionBy("source", "unit"))
    seen = counts.select("source", "unit", "len", near.alias("near"), upto.alias("upto"), whole.alias("n"))
    seen = seen.where((F.col("near") >= least) & (F.col("n") - F.col("upto") <= beyond * F.col("n")))
    below = counts.select(F.col("source").alias("s"), F.col("unit").alias("u"), F.col("len").alias("l"), "k")
    body = seen.join(below, F.col("source").eqNullSafe(F.col("s")) & (F.col("unit") == F.col("u")) & (F.col("l") <= F.col("len") - SLACK) & (F.col("l") * 2 >= F.col("len")), "left")
    body = body.groupBy("source", "unit", "len", "near", "n").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("body"))
    spikes = body.where(F.col("near") >= crowd * SLACK * F.col("body") / (F.col("len") / 2 + 1))
    best = spikes.groupBy("source").agg(F.max_by(F.struct("unit", F.col("len").alias("size"), F.col("near").alias("n_at"), "n"), F.struct("near", -F.col("len"), -F.array_position(F.array(*map(F.lit, UNITS)), F.col("unit")))).alias("b"))
    return best.select("source", "b.*")


class Habits:
    """Learned from the whole corpus; bounded, because each set needs a least share."""

    def __init__(self, closings: set[str], abbreviations: set[str], dots: set[str] | None):
        self.closings, self.abbreviations, self.dots = closings, abbreviations, dots


def learn_habits(surveyed: DataFrame, closing_share: float = 0.0003, abbreviation_share: float = 0.0003, dots_share: float = 0.001) -> Habits:
    """Closing lines: last lines of at least 3 different texts and the share
    ``closing_share`` of all, that are not the beginning of other last lines (which
    pieces of lines are, where cuts fall at random); abbreviations: words whose full stop is mostly followed
    by a small letter or digit; ``dots``: the two words before the last word of a
    sentence that ends in an ellipsis, None if those words tell nothing."""
    counted = surveyed.where("kind <> 'len'").groupBy("kind", "what").agg(F.sum(F.when(F.col("kind") == "close", F.lit(1)).otherwise(F.col("n"))).alias("n"))
    counted = materialise(counted, "habits")
    total = {x.kind: x.n for x in counted.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    texts = total.get("text", 0)

    def take(kind: str, least: float) -> dict[str, int]:  # bounded: each has a least share of a total
        return {x.what: x.n for x in counted.where((F.col("kind") == kind) & (F.col("n") >= least)).collect()}

    closings = take("close", max(3, closing_share * texts))
    if closings:
        sizes = F.array(*[F.lit(k) for k in sorted({len(c) for c in closings})])
        starts = F.transform(F.filter(sizes, lambda k: k < F.length("what")), lambda k: F.substring(F.col("what"), F.lit(1), k))
        longer = counted.where("kind = 'close'").select(F.explode(starts).alias("what"), "n").where(F.col("what").isin(list(closings)))
        for x in longer.groupBy("what").agg(F.sum("n").alias("n")).collect():
            if x.n * 2 > closings[x.what]:
                del closings[x.what]
    go = take("go", max(3, abbreviation_share * (total.get("go", 0) + total.get("stop", 0))))
    stop = {x.what: x.n for x in counted.where((F.col("kind") == "stop") & F.col("what").isin(list(go))).collect()} if go else {}
    dots = take("dots", max(3, dots_share * total.get("dots", 0)))
    informative = dots and sum(dots.values()) * 2 >= total.get("dots", 0)
    return Habits(set(closings), {w for w, n in go.items() if n > stop.get(w, 0)}, set(dots) if informative else None)


_TAG = re.compile(r"</?[A-Za-z!][^<>]*>|<br\s*/>")
#: Attributes are taken one by one, without going back: linear in the tag's length.
_OPEN_TAG = re.compile(r"""<(?:[/!]?(?:[A-Za-z][\w-]*(?>\s+[\w:-]+(?:\s*=\s*(?:"[^"<>]*"?|'[^'<>]*'?|[^\s"'<>]*))?)*+\s*/?)?)?\Z""")
_QUOTES = {"»": "«", "”": "“", '"': '"'}
_CLOSERS = "»”\"'’)]}*_"
_ENDS = ".!?…。！？؟"
_PREDICATE = r"(?:\[[^\[\]\s]*\]:)?[^\s()\[\]&]+\([^\s()&]*\)"
_PREDICATES = re.compile(rf"{_PREDICATE}(?:\s*&\s*{_PREDICATE})*\Z")
_IS_PREDICATES = re.compile(r"\[\d+\]:|[^\s()&]+\([^\s()&]*\)\s*&")
_ID = re.compile(r"id\(\d+\)\.\Z")


def _without_tags(text: str, end: int) -> int:
    """Where ``text[:end]`` ends without closing tags and white space."""
    while True:
        end = _rstrip(text, end)
        if not end or text[end - 1] != ">":
            return end
        at = text.rfind("<", 0, end)
        if at < 0 or not _TAG.fullmatch(text, at, end):
            return end
        end = at


def _bracket(text: str, end: int) -> int:
    """Where the bracket opens that ``text[end - 1]`` closes; -1 if it or what is in it is missing."""
    depth = 1
    opens, closes = text.rfind("(", 0, end - 1), text.rfind(")", 0, end - 1)
    while opens >= 0:
        if closes > opens:
            depth += 1
            closes = text.rfind(")", 0, closes)
            continue
        depth -= 1
        if depth == 0:
            return opens if opens < end - 2 else -1
        opens = text.rfind("(", 0, opens)
    return -1


def _quotation(text: str, end: int) -> int:
    """Where the quotation opens that ``text[end - 1]`` closes; -1 if there is none."""
    mark = text[end - 1]
    at = text.rfind(_QUOTES[mark], 0, end - 1)
    if at < 0 or at == end - 2 or (mark != '"' and text.find(mark, at, end - 1) >= 0):
        return -1
    return -1 if mark == '"' and at and not text[at - 1].isspace() else at


def _is_abbreviation(text: str, end: int, habits: Habits) -> bool:
    """True if the letters before ``text[end]``, a full stop, are a known abbreviation."""
    start = end
    while start > 0 and text[start - 1].isalnum() and not text[start - 1].isdecimal():
        start -= 1
    if start == end or (start and (text[start - 1].isalnum() or text[start - 1] == "_")):
        return False
    return text[start:end].lower() in habits.abbreviations


def _sentence(text: str, habits: Habits, at_limit: bool) -> str | None:
    """Why the last sentence of a prose text is unfinished, or None. The text is looked
    at from its end, as far back as a remark or quotation at its end reaches."""
    end = len(text)
    while end := _rstrip(text, end):
        last = text[end - 1]
        if last == ")" and (at := _bracket(text, end)) >= 0:  # a remark in brackets: what stands before it counts
            end = at
            continue
        if last in _QUOTES and (at := _quotation(text, end)) >= 0:
            said = _rstrip(text, end - 1)
            if said <= at + 1 or text[said - 1] not in _ENDS:
                return "sentence"
            before = _rstrip(text, at)
            # "He said: 'Go.'", "he said 'Go.'"; after a sentence it is one of its own
            if not before or text[before - 1] not in _ENDS + _CLOSERS:
                return None
            end = before
            continue
        bare = _rstrip(text, _rstrip(text, end, _CLOSERS))
        if not bare or text[bare - 1] not in _ENDS:
            return "sentence"
        dots = 1 if text[bare - 1] == "…" else 3 if text.endswith("...", 0, bare) else 0
        if dots:
            rest = _rstrip(text, bare - dots)
            if rest and text[rest - 1] in ".!?":  # put after a whole sentence
                end, at_limit = rest, False
                continue
            if at_limit:
                return "mark"
            if habits.dots is not None and _before_last(text, bare - dots) not in habits.dots:
                return "mark"
            return None
        return "abbreviation" if text[bare - 1] == "." and _is_abbreviation(text, bare - 1, habits) else None
    return None


def broken_off(text: str | None, habits: Habits, at_limit: bool = False) -> str | None:
    """Why a text breaks off: ``character``, ``tag``, ``predicate``, ``sentence``,
    ``abbreviation`` or ``mark`` (a mark put after the cut); None if it ends in full."""
    text = (text or "").rstrip()
    if not text:
        return None
    if text.endswith("�"):
        return "character"
    end = len(text)
    while True:
        end = _without_tags(text, end)
        start = text.rfind("\n", 0, end) + 1
        last, head = text[start:end].strip(), _rstrip(text, start)
        if head and (last in habits.closings or (_PURE_MARK.fullmatch(last) and not set(last) & set(_ENDS + "«»“”\"()[]<>&%"))):
            end = head
            continue
        break
    text = text[:end]
    if not text:
        return None
    if (at := text.rfind("<")) >= 0 and _OPEN_TAG.match(text, at):
        return "tag"
    if last.startswith("%"):
        return _sentence(last.lstrip("% "), habits, at_limit) if last.strip("% ") else "sentence"
    if last.startswith("id("):
        return None if _ID.match(last) else "predicate"
    if _IS_PREDICATES.match(last) or (last.startswith("[") and re.search(r"^(?:%|id\(\d+\)\.)", text, re.M)):
        return None if _PREDICATES.match(last) else "predicate"
    return _sentence(html.unescape(text) if "&" in text else text, habits, at_limit)


#: Texts off its limit that a source needs, besides, before its habit is believed.
DOUBT = 30


def truncated_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """Texts that break off, and how often each source has them.

    Returns ``id_col, source, reason, unit, size`` of every broken text (``unit``
    and ``size``: the exposed limit it stands at, else NULL), and ``source, unit,
    size, texts, truncated, share`` of every source. NULL, empty and blank texts do
    not break off but are counted in ``texts``; NULL is a source of its own, for
    which the limits of all sources hold; repeated rows count each. Whole texts are
    read. Columns besides those named are not.

    Exposed limits take part in three ways: an ellipsis at a limit was put after the
    cut, whatever words stand before it; they tell where a text was cut; and
    where most texts of a source end without any mark (titles, lists, verse) that is
    how it writes, so there a missing mark counts at its limit only.
    """
    used = df.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"))
    surveyed = survey(used)
    limits = materialise(storage_limits(surveyed), "limits")
    habits = learn_habits(surveyed)
    known = limits.where("source IS NOT NULL").select(F.col("source").alias("s"), "unit", "size")
    # a text without source may have been cut by the limit of any
    every: dict[str, set[int]] = {}  # at most one limit for each source
    for x in known.select("unit", "size").distinct().collect():
        every.setdefault(x.unit, set()).add(x.size)
    joined = used.join(maybe_broadcast(known, 100_000), F.col("source") == F.col("s"), "left").drop("s")

    def at_limit(text: str | None, source: str | None, unit: str | None, size: int | None) -> bool:
        if not text or (source is not None and unit is None):
            return False
        lengths = measure(text)
        if source is not None:
            return size - SLACK < lengths[unit] <= size
        return any(lengths[u] + k in sizes for u, sizes in every.items() for k in range(SLACK))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches, rows=8192, size=32 << 20):
            texts = t.column("text").to_pylist()
            at = [at_limit(*x) for x in zip(texts, *[t.column(c).to_pylist() for c in ("source", "unit", "size")], strict=True)]
            why = [broken_off(text, habits, hit) for text, hit in zip(texts, at, strict=True)]
            out = t.drop_columns(["text"]).append_column("at", pa.array(at, pa.bool_())).append_column("reason", pa.array(why, pa.string()))
            yield from out.to_batches()

    id_type = used.schema["id"].dataType.simpleString()
    judged = joined.select("id", "source", "unit", "size", "text").mapInArrow(run, f"id {id_type}, source string, unit string, size int, at boolean, reason string")
    judged = materialise(judged, "judged")  # read twice, without its texts
    off = ~F.col("at")
    missing = F.coalesce(F.col("reason") == "sentence", F.lit(False))
    by_source = judged.groupBy("source").agg(
        F.first("unit", True).alias("unit"),
        F.first("size", True).alias("size"),
        F.count("*").alias("texts"),
        F.count("reason").alias("broken"),
        F.count(F.when(off & missing, 1)).alias("unmarked"),
        F.count(F.when(off, 1)).alias("off"),
    )
    by_source = materialise(by_source.withColumn("writes_so", F.col("unmarked") * 2 > F.col("off") + DOUBT), "sources")
    free = by_source.where("writes_so").select(F.col("source").alias("s"))
    found = judged.where("reason IS NOT NULL").join(maybe_broadcast(free, 100_000), F.col("source").eqNullSafe(F.col("s")) & off & missing, "left_anti")
    at_size = lambda c: F.when(F.col("at"), F.col(c)).alias(c)
    truncated = F.col("broken") - F.when(F.col("writes_so"), F.col("unmarked")).otherwise(0)
    by_source = by_source.select("source", "unit", "size", "texts", truncated.alias("truncated"), (truncated / F.col("texts")).alias("share"))
    return found.select(F.col("id").alias(id_col), "source", "reason", at_size("unit"), at_size("size")), by_source
