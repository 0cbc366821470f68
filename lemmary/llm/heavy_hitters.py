"""The k values with the largest summed weight, in bounded memory.

Code-based identification. Every value has a 64-bit identity (a hash of its
columns). For each of a few repetitions it falls into one of ``groups`` groups,
and its identity is written as 24 symbols of 4 bits: two interleaved
Reed-Solomon (12, 8) words over GF(16), each of which corrects two wrong
symbols. A sketch holds the weight per (repetition, group, position, symbol) in
whole numbers, so its size is fixed and its sums are exact; sketches of tasks are added
up in two steps, each as a stream. Where one value holds more than half a group's weight, the
heaviest symbol at each position spells its identity.

Decoded identities are then counted exactly in a second pass. What is left of a
group's weight after its counted values bounds every value that was not decoded:
if that is below the k-th exact sum in some repetition, no such value can belong
to the result. Otherwise the rows of the groups still in doubt are sketched again
with more groups, and what remains in doubt after the last round is grouped
exactly, so the result is exact in every case.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lemmary.functions.arrow import chunks, ints
from lemmary.functions.terms import canonical_term, encode
from lemmary.runtime import fan_in, materialise

POSITIONS, SYMBOLS = 24, 16
DATA, PARITY = 8, 4


def _field() -> tuple[np.ndarray, np.ndarray]:
    """Powers and logarithms of GF(16) with x^4 + x + 1."""
    power, log, x = np.zeros(30, np.int64), np.zeros(16, np.int64), 1
    for i in range(15):
        power[i] = power[i + 15] = x
        log[x] = i
        x <<= 1
        if x & 16:
            x ^= 0b10011
    return power, log


POWER, LOG = _field()


def _mul(a: int, b: int) -> int:
    return int(POWER[LOG[a] + LOG[b]]) if a and b else 0


def _parity_table() -> np.ndarray:
    """Parity of each single data symbol: [position, symbol] -> 4 nibbles packed."""
    generator = [1]
    for i in range(PARITY):
        root = int(POWER[i])
        generator = [a ^ _mul(b, root) for a, b in zip([*generator, 0], [0, *generator], strict=True)]
    table = np.zeros((DATA, SYMBOLS), np.int64)
    for p in range(DATA):
        for s in range(SYMBOLS):
            word = [0] * (DATA + PARITY)
            word[p] = s
            for i in range(DATA):
                if lead := word[i]:
                    for j, g in enumerate(generator):
                        word[i + j] ^= _mul(g, lead)
            table[p, s] = sum(v << (4 * i) for i, v in enumerate(word[DATA:]))
    return table


PARITY_TABLE = _parity_table()


def symbols(identity: np.ndarray) -> np.ndarray:
    """The 24 code symbols of each uint64 identity, [position, value]."""
    out = np.empty((POSITIONS, len(identity)), np.uint8)
    for word in range(2):
        parity = np.zeros(len(identity), np.int64)
        for p in range(DATA):
            s = ((identity >> np.uint64(32 * word + 4 * p)) & np.uint64(15)).astype(np.uint8)
            out[12 * word + p] = s
            parity ^= PARITY_TABLE[p][s]
        for i in range(PARITY):
            out[12 * word + DATA + i] = (parity >> (4 * i)) & 15
    return out


def _correct(word: list[int]) -> list[int] | None:
    """The data symbols of a received word with at most two wrong symbols."""
    n = DATA + PARITY

    def syndromes(w: list[int]) -> list[int]:
        out = []
        for i in range(PARITY):
            s = 0
            for v in w:
                s = _mul(s, int(POWER[i])) ^ v
            out.append(s)
        return out

    s = syndromes(word)
    if not any(s):
        return word[:DATA]
    inverse = lambda a: int(POWER[(15 - LOG[a]) % 15])
    trials: list[tuple[int, ...]] = [(a,) for a in range(n)] + [(a, b) for a in range(n) for b in range(a + 1, n)]
    for places in trials:
        x = [int(POWER[n - 1 - p]) for p in places]
        if len(places) == 1:
            e = [s[0]]
        else:
            d = x[0] ^ x[1]
            second = _mul(s[1] ^ _mul(x[0], s[0]), inverse(d))
            e = [s[0] ^ second, second]
        fixed = list(word)
        for p, v in zip(places, e, strict=True):
            fixed[p] ^= v
        if not any(syndromes(fixed)):
            return fixed[:DATA]
    return None


def _mix(identity: np.ndarray, seed: int) -> np.ndarray:
    """A seeded 64-bit permutation of identities."""
    with np.errstate(over="ignore"):
        x = identity ^ np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def group_of(identity: np.ndarray, seed: int, groups: int) -> np.ndarray:
    return (_mix(identity, seed) % np.uint64(groups)).astype(np.int64)


def _identities(t: pa.Table, width: int, as_term: tuple[bool, ...]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], list[list[str]]]:
    """Identity of each row, which rows have all columns, and the coded columns."""
    out, whole, codes, values = np.zeros(t.num_rows, np.uint64), np.ones(t.num_rows, bool), [], []
    for i in range(width):
        code, names = encode(t.column(i), canonical_term if as_term[i] else lambda v: v)
        whole &= code >= 0
        hashed = np.array([xxhash.xxh64_intdigest(v.encode("utf-8", "surrogatepass"), seed=i) for v in names] + [0], np.uint64)
        out = _mix(out ^ hashed[code], i)
        codes.append(code)
        values.append(names)
    return out, whole, codes, values


class _Doubt:
    """Which identities a round still looks at: those whose groups were in doubt
    in every repetition of every earlier round."""

    def __init__(self, rounds: list[tuple[int, list[tuple[int, np.ndarray]]]]):
        self.rounds = rounds

    def __call__(self, identity: np.ndarray) -> np.ndarray:
        keep = np.ones(len(identity), bool)
        for groups, reps in self.rounds:
            for seed, open_ in reps:
                keep &= open_[group_of(identity, seed, groups)]
        return keep


#: Groups whose cells travel together.
TOGETHER = 64


def _whole_sum(weight: np.ndarray) -> int:
    """The sum of int64 weights as a number of any size."""
    return (int((weight >> 32).sum()) << 32) + int((weight & 0xFFFFFFFF).sum())


def _fits(total: int) -> None:
    if total >= 1 << 63:
        raise OverflowError("weights sum to more than 64 bits")


def _sums(at: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Exact sums of weights by position: halves of them, whose sums a float holds."""
    if not len(weight) or int(weight.max()) * len(weight) < 1 << 53:
        return np.bincount(at, weights=weight, minlength=n).astype(np.int64)
    high, low = (np.bincount(at, weights=w, minlength=n).astype(np.int64) for w in (weight >> 32, weight & 0xFFFFFFFF))
    return (high << 32) + low


def _sketcher(width: int, as_term, groups: int, seeds: list[int], doubt: _Doubt):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros((len(seeds), POSITIONS, groups * SYMBOLS), np.int64)
        total = whole_mass = 0
        for t in chunks(batches):
            identity, whole, _, _ = _identities(t, width, as_term)
            weight = np.maximum(ints(t.column(width)), 0)
            pick = whole & (weight > 0) & doubt(identity)
            identity, weight = identity[pick], weight[pick]
            total += len(identity)
            whole_mass += _whole_sum(weight)
            _fits(whole_mass)
            coded = symbols(identity)
            for r, seed in enumerate(seeds):
                at = group_of(identity, seed, groups) * SYMBOLS
                for p in range(POSITIONS):
                    sketch[r, p] += _sums(at + coded[p], weight, groups * SYMBOLS)
        if total:
            task = TaskContext.get().partitionId() if TaskContext.get() else 0
            cut = np.ascontiguousarray(sketch.reshape(len(seeds), POSITIONS, groups, SYMBOLS).transpose(0, 2, 1, 3))
            for r in range(len(seeds)):
                for g in range(0, groups, TOGETHER):
                    yield _cells(r, g, task, cut[r, g : g + TOGETHER])

    return run


SKETCH = "rep int, first int, task int, cells binary"


def _cells(rep: int, first: int, task: int, cells: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([rep], pa.int32()), pa.array([first], pa.int32()), pa.array([task], pa.int32()), pa.array([cells.tobytes()], pa.binary())],
        names=["rep", "first", "task", "cells"],
    )


def _added(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """Sums of the cells of each (repetition, groups); a task holds one sketch at most."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    least: dict[tuple[int, int], int] = {}
    for b in batches:
        for i in range(b.num_rows):
            key = b.column("rep")[i].as_py(), b.column("first")[i].as_py()
            cells = np.frombuffer(b.column("cells")[i].as_buffer(), np.int64)
            task = b.column("task")[i].as_py()
            if key in sums:
                sums[key] += cells
                least[key] = min(least[key], task)
                if (sums[key] < 0).any():
                    raise OverflowError("weights sum to more than 64 bits")
            else:
                sums[key], least[key] = cells.copy(), task
    for key, cells in sums.items():
        yield *key, least[key], cells


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rep, first, task, cells in _added(batches):
        yield _cells(rep, first, task, cells)


def _decode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum what is left of sketches and spell each group's heaviest symbols."""
    for rep, first, _, cells in _added(batches):
        out = []
        for g, cell in enumerate(cells.reshape(-1, POSITIONS, SYMBOLS)):
            mass = int(cell[0].sum())
            if mass <= 0:
                continue
            word = cell.argmax(axis=1).tolist()
            parts = [_correct(word[:12]), _correct(word[12:])]
            found = None
            if parts[0] is not None and parts[1] is not None:
                found = sum(v << (32 * w + 4 * p) for w in range(2) for p, v in enumerate(parts[w]))
                found = found - (1 << 64) if found >= 1 << 63 else found
            out.append((rep, first + g, mass, found))
        columns = [pa.array([x[i] for x in out], k) for i, k in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["rep", "grp", "mass", "identity"])


def _spelled(sketches: DataFrame, tasks: int) -> DataFrame:
    """``rep, grp, mass, identity`` of the summed sketches. With many tasks about the
    square root of their number is added up at a time."""
    few = math.isqrt(max(tasks, 1))
    if few > 4:
        sketches = sketches.repartition("rep", "first", F.pmod("task", F.lit(few))).mapInArrow(_merge, SKETCH)
    return sketches.repartition("rep", "first").mapInArrow(_decode, "rep int, grp int, mass bigint, identity bigint")


def _picker(width: int, as_term, wanted: np.ndarray | None, doubt: _Doubt | None):
    """Rows of wanted identities (or of identities in doubt), columns spelled."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches):
            identity, whole, codes, values = _identities(t, width, as_term)
            pick = np.flatnonzero(whole & (np.isin(identity, wanted) if wanted is not None else doubt(identity)))
            if len(pick):
                spelled = [pa.array(np.array(v, dtype=object)[c[pick]], pa.string()) for v, c in zip(values, codes, strict=True)]
                rest = [t.column(i).combine_chunks().take(pa.array(pick)) for i in (width, width + 1)]
                yield pa.RecordBatch.from_arrays([*spelled, pa.array(identity[pick].view(np.int64)), *rest], names=[*[f"v{i}" for i in range(width)], "identity", "weight", "id"])

    return run


def _count(rows: DataFrame, width: int) -> DataFrame:
    """Exact sums of spelled rows: a record counts once, its deliveries as mass."""
    keys = [f"v{i}" for i in range(width)]
    once = rows.withColumn("w", F.coalesce("weight", F.lit(0).cast("bigint")))
    once = once.groupBy(*keys, "identity", "id", F.when(F.col("id").isNull(), F.monotonically_increasing_id()).alias("alone"))
    once = once.agg(F.max("w").alias("w"), F.sum(F.greatest("w", F.lit(0).cast("bigint"))).alias("mass"))
    return once.groupBy(*keys, "identity").agg(F.sum("w").alias("total"), F.sum("mass").alias("mass"))


def heaviest_values(
    df: DataFrame,
    cols: list[str],
    weight_col: str,
    id_col: str,
    k: int = 25,
    term_cols: tuple[str, ...] = (),
    groups: int = 1024,
    repetitions: int = 2,
    rounds: int = 3,
) -> DataFrame:
    """The ``k`` combinations of ``cols`` with the largest summed ``weight_col``:
    ``cols`` and ``total``.

    Columns named in ``term_cols`` are spelled canonically first; a row with a
    NULL (or no term) in any of ``cols`` is not counted; weights that sum to more than
    64 bits raise an error. Rows of one ``id_col``
    and one value are deliveries of one record and count once (the largest
    weight); rows without identifier count each. NULL weights add 0, negative
    weights subtract. Ties at the k-th place go to the smaller values in order.
    Fewer than ``k`` values give all of them, an empty table none. Other columns
    are not read. ``groups`` grows fourfold in each of ``rounds`` rounds.
    """
    spark, width = df.sparkSession, len(cols)
    used = df.select(*[F.col(c).cast("string").alias(f"v{i}") for i, c in enumerate(cols)], F.col(weight_col).cast("bigint").alias("weight"), F.col(id_col).alias("id"))
    as_term = tuple(c in term_cols for c in cols)
    kind = T.StructType([*[T.StructField(f"v{i}", T.StringType()) for i in range(width)], T.StructField("identity", T.LongType()), T.StructField("weight", T.LongType()), T.StructField("id", used.schema["id"].dataType)])
    known: dict[int, int] = {}
    counted: list[DataFrame] = []
    sums: list[int] = []
    doubt = _Doubt([])
    for turn in range(rounds):
        seeds = [1 + turn * repetitions + r for r in range(repetitions)]
        sketches = fan_in(used).mapInArrow(_sketcher(width, as_term, groups, seeds, doubt), SKETCH)
        spelled = _spelled(sketches, 2 * spark.sparkContext.defaultParallelism).collect()  # at most repetitions * groups rows
        mass = {(x.rep, x.grp): x.mass for x in spelled}
        fresh = np.array(sorted({x.identity for x in spelled if x.identity is not None} - set(known)), np.int64)
        if len(fresh):
            fresh = fresh[doubt(fresh.view(np.uint64))]
            exact = materialise(_count(used.mapInArrow(_picker(width, as_term, fresh.view(np.uint64), None), kind), width), "heavy")
            counted.append(exact)
            for x in exact.select("identity", "total", "mass").collect():  # at most as many as were decoded
                known[x.identity] = known.get(x.identity, 0) + x.mass
                sums.append(x.total)
        floor = sorted(sums, reverse=True)[k - 1] if len(sums) >= k else 0
        seen = np.array(list(known), np.int64).view(np.uint64)
        seen_mass = np.array(list(known.values()), np.int64)
        seen_in = doubt(seen) if len(seen) else np.array([], bool)
        left = []
        for r, seed in enumerate(seeds):
            rest = np.zeros(groups, np.int64)
            for (rep, g), m in mass.items():
                if rep == r:
                    rest[g] = m
            if len(seen):
                np.subtract.at(rest, group_of(seen[seen_in], seed, groups), seen_mass[seen_in])
            left.append((seed, rest >= max(floor, 1)))
        doubt = _Doubt([*doubt.rounds, (groups, left)])
        if any(not open_.any() for _, open_ in left):
            break
        groups *= 4
    else:
        others = used.mapInArrow(_picker(width, as_term, None, doubt), kind)
        if known:
            others = others.where(~F.col("identity").isin(list(known))) if len(known) < 1000 else others.join(F.broadcast(spark.createDataFrame([(x,) for x in known], "identity bigint")), "identity", "left_anti").select(others.columns)
        counted.append(_count(others, width))
    if len(sums) < k:
        # fewer values of any weight than asked for, or nothing but equal ones: group
        # everything, as an aggregation that spills
        counted = [_count(used.mapInArrow(_picker(width, as_term, None, _Doubt([])), kind), width)]
    if not counted:
        return spark.createDataFrame([], T.StructType([*[T.StructField(c, T.StringType()) for c in cols], T.StructField("total", T.LongType())]))
    every = counted[0]
    for other in counted[1:]:
        every = every.unionByName(other)
    keys = [f"v{i}" for i in range(width)]
    best = every.orderBy(F.desc("total"), *keys).limit(k)
    return best.select(*[F.col(f"v{i}").alias(c) for i, c in enumerate(cols)], "total")

