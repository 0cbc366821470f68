"""How characteristic a term is of a record: hypergeometric enrichment.

Drawing the ``n`` occurrences of a record from the ``N`` of the collection, of
which ``K`` are the term's, the exact probability of at least the ``k`` seen is
summed from log-gamma terms. The score is the negative decimal logarithm of that
probability after false-discovery adjustment (Benjamini-Hochberg) over all
(record, term) pairs of the collection.

Log-gamma values of large counts have no digits left for their differences, so each
is split into its main term and its Stirling error, and main terms are put together as
deviances (Loader's saddle-point form), which keeps full precision at any size.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lemmary.functions.arrow import chunks, ints
from lemmary.operators.grouped_join import join_stats
from lemmary.runtime import materialise, maybe_broadcast

#: Distinct probabilities that are ranked in one bin.
BIN_ROWS = 200_000
#: Tails of more terms than this are integrated.
MOST_TERMS = 4_096
_HALF_LOG_2PI = 0.5 * math.log(2 * math.pi)
_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(96)


def _error_below_16(x: np.ndarray) -> np.ndarray:
    """As :func:`stirling_error` for x < 16: from a larger x by the recurrence."""
    steps = 16 - np.floor(x)
    shift, at = np.zeros_like(x), x.copy()
    while (live := steps > 0).any():
        y = at[live]
        # e(y) - e(y + 1)
        shift[live] += (y + 0.5) * np.log1p(1 / np.maximum(y, 1e-300)) - 1
        at[live] += 1
        steps[live] -= 1
    return shift + stirling_error(at)


def stirling_error(x: np.ndarray) -> np.ndarray:
    """ln Gamma(x + 1) - ((x + 1/2) ln x - x + ln(2 pi) / 2) for x > 0, to full precision."""
    x = np.asarray(x, float)
    z = 1 / (np.maximum(x, 16) ** 2)
    out = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z * (1 / 1188 - z * 691 / 360360))))) / np.maximum(x, 16)
    if (small := x < 16).any():
        out[small] = _error_below_16(x[small])
    return out


def deviance(x: np.ndarray, m: np.ndarray) -> np.ndarray:
    """x ln(x / m) + m - x for x, m > 0, without loss where they are close."""
    d = (x - m) / (x + m)
    # x ln(x/m) = 2x artanh(d)
    z = d * d
    series = np.zeros_like(d)
    for j in range(12, 0, -1):
        series = z * (1 / (2 * j + 1) + series)
    near = (x - m) * d + 2 * x * d * series
    with np.errstate(invalid="ignore", divide="ignore"):
        far = x * np.log(x / m) + m - x
    return np.where(np.abs(d) < 0.1, near, far)


def _log_binomial(x: np.ndarray, n: np.ndarray, mean: np.ndarray, rest: np.ndarray, p: np.ndarray) -> np.ndarray:
    """ln of the binomial probability of ``x`` of ``n``, with ``mean`` = n p and
    ``rest`` = n (1 - p), also between whole numbers."""
    out = np.empty_like(x)
    none, all_ = x <= 0, x >= n
    out[none] = (n * np.log1p(-p))[none]
    out[all_ & ~none] = (n * np.log(p))[all_ & ~none]
    i = ~none & ~all_
    x, n, mean, rest = x[i], n[i], mean[i], rest[i]
    y = n - x
    out[i] = stirling_error(n) - stirling_error(x) - stirling_error(y) - deviance(x, mean) - deviance(y, rest) - _HALF_LOG_2PI - 0.5 * (np.log(x) + np.log(y) - np.log(n))
    return out


def log_probability(k: np.ndarray, n: np.ndarray, K: np.ndarray, N: np.ndarray) -> np.ndarray:
    """ln P(X = k) of the hypergeometric distribution for 0 < n < N, element by element."""
    k, n, K, N = np.broadcast_arrays(*(np.asarray(v, float) for v in (k, n, K, N)))
    p, L = n / N, N - K
    drawn = _log_binomial(k, K, K * p, K * ((N - n) / N), p)
    other = _log_binomial(n - k, L, L * p, L * ((N - n) / N), p)
    whole = _log_binomial(n.copy(), N, n, N - n, p)
    return drawn + other - whole


def _log_rise(k: np.ndarray, n: np.ndarray, K: np.ndarray, N: np.ndarray) -> np.ndarray:
    """ln P(X = k + 1) - ln P(X = k)."""
    with np.errstate(divide="ignore"):
        return np.log(np.maximum(K - k, 0)) + np.log(np.maximum(n - k, 0)) - np.log(k + 1) - np.log(N - K - n + k + 1)


def _above(k: np.ndarray, n: np.ndarray, K: np.ndarray, N: np.ndarray) -> np.ndarray:
    """ln P(X >= k) for k at or above the mean and no larger than n and K."""
    first = log_probability(k, n, K, N)
    rise = np.minimum(_log_rise(k, n, K, N), 0.0)
    spread = np.maximum(n * (K / N) * ((N - K) / N) * ((N - n) / np.maximum(N - 1, 1)), 1e-300)
    fall = np.where(np.isfinite(rise), -rise, 1e300)
    # terms until they no longer count: a parabola of that slope and spread
    with np.errstate(over="ignore"):
        terms = 80 / (fall + np.sqrt(fall * fall + 80 / spread))
    terms = np.minimum(terms, np.minimum(n, K) - k)
    long = terms > MOST_TERMS
    total = np.ones(len(k))

    at = np.flatnonzero(~long)
    term, i = np.ones(len(at)), k[at].copy()
    while len(at):
        x, a, b, c = i, K[at], n[at], N[at]
        term = term * ((a - x) * (b - x) / ((x + 1) * (c - a - b + x + 1)))
        total[at] += term
        live = term > total[at] * 1e-17
        at, term, i = at[live], term[live], i[live] + 1

    at = np.flatnonzero(long)
    for s in range(0, len(at), 4096):
        j = at[s : s + 4096]
        start, half = k[j] - 0.5, np.minimum(1.5 * terms[j], np.minimum(n[j], K[j]) - k[j]) / 2
        x = start[:, None] + half[:, None] * (_NODES + 1)
        wide = lambda v: np.broadcast_to(v[j][:, None], x.shape).ravel()  # noqa: E731, B023
        f = np.exp(log_probability(x.ravel(), wide(n), wide(K), wide(N)).reshape(x.shape) - first[j][:, None])
        # midpoint rule backwards: what the terms hold beyond the integral
        edge = np.exp(log_probability(start, n[j], K[j], N[j]) - first[j])
        total[j] = half * (f @ _WEIGHTS) + edge * _log_rise(k[j] - 1, n[j], K[j], N[j]) / 24
    return np.minimum(first + np.log(total), 0.0)


def log_upper_tail(k: np.ndarray, n: np.ndarray, K: np.ndarray, N: np.ndarray) -> np.ndarray:
    """ln P(X >= k) of the hypergeometric distribution, element by element.

    Above the mean the upper tail is summed, below it the lower one (the upper tail of
    the other items drawn) and subtracted from 1. Terms fall away from the mode, and
    summing stops when one no longer changes the sum; where thousands would count, the
    sum is an integral over them.
    """
    k, n, K, N = (np.asarray(v, float) for v in (k, n, K, N))
    low, high = np.maximum(0.0, n + K - N), np.minimum(n, K)
    out = np.zeros(len(k))
    out[k > high] = -np.inf
    inside = (k > low) & (k <= high)
    with np.errstate(invalid="ignore"):
        up = k >= n * (K / N)  # N may be 0 where nothing is inside
    if (at := np.flatnonzero(inside & up)).size:
        out[at] = _above(k[at], n[at], K[at], N[at])
    if (at := np.flatnonzero(inside & ~up)).size:
        below = _above(n[at] - k[at] + 1, n[at], N[at] - K[at], N[at])
        out[at] = np.log1p(-np.exp(np.minimum(below, -1e-300)))
    return out


def _tails(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in chunks(batches, rows=65_536):
        drawn = np.stack([ints(t.column(c)) for c in ("freq", "record_total", "term_total", "total")])
        each, back = np.unique(drawn, axis=1, return_inverse=True)
        yield from t.append_column("ln_p", pa.array(log_upper_tail(*each)[back.ravel()])).to_batches()


def adjust(scored: DataFrame, bin_rows: int = BIN_ROWS) -> DataFrame:
    """Adds ``q_ln``, the Benjamini-Hochberg adjusted ``ln_p`` over all rows.

    Ranks come from counts of distinct probabilities: these are cut into bins of about
    ``bin_rows`` at quantiles, ranked inside their bin and shifted by the counts of
    lower bins, so no task sees them all, however many there are. A probability that
    many rows share (1 above all) is a heavy key of the join back.
    """
    by_p = materialise(scored.groupBy("ln_p").agg(F.count("*").alias("n")), "tails")
    sizes = by_p.agg(F.count("*").alias("distinct"), F.sum("n").alias("m")).first()
    m, bins = sizes.m or 0, -(-sizes.distinct // bin_rows)
    cuts = np.array([])
    if bins > 1:
        cuts = np.unique(by_p.select(F.percentile_approx("ln_p", [i / bins for i in range(1, bins)], 100 * bins).alias("c")).first().c)

    def into_bins(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.searchsorted(cuts, b.column(0).to_numpy(zero_copy_only=False), side="left")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32())], names=["ln_p", "n", "bin"])

    binned = by_p.mapInArrow(into_bins, "ln_p double, n bigint, bin int") if len(cuts) else by_p.withColumn("bin", F.lit(0))
    inside = Window.partitionBy("bin").orderBy("ln_p")
    binned = binned.withColumn("upto", F.sum("n").over(inside))
    in_order = Window.partitionBy(F.lit(0)).orderBy("bin")  # a row for each bin
    raw = F.col("ln_p") + F.log(F.lit(float(m)) / (F.col("below") + F.col("upto")))
    if len(cuts):
        binned = materialise(binned, "bins")
        lower = binned.groupBy("bin").agg(F.sum("n").alias("k"))
        lower = materialise(lower.select("bin", (F.sum("k").over(in_order) - F.col("k")).alias("below")), "bin-sums")
        ranked = binned.join(maybe_broadcast(lower, 1_000_000), "bin").withColumn("raw", raw)
        least = ranked.groupBy("bin").agg(F.min("raw").alias("low"))
        above = F.coalesce(F.min("low").over(in_order.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0))
        above = materialise(least.select("bin", above.alias("above")), "bin-minima")
        ranked = ranked.join(maybe_broadcast(above, 1_000_000), "bin")
    else:
        ranked = binned.withColumns({"below": F.lit(0), "above": F.lit(0.0)}).withColumn("raw", raw)
    # the least of all larger probabilities, from the largest on
    here = F.min("raw").over(Window.partitionBy("bin").orderBy(F.desc("ln_p")))
    q = materialise(ranked.select("ln_p", "n", F.least(here, "above", F.lit(0.0)).alias("q_ln")), "adjusted")
    return join_stats(scored, q.withColumnRenamed("n", "__n"), ["ln_p"], "__n", m).drop("__n")


def term_enrichment(df: DataFrame, record_cols: list[str], term_col: str, count_col: str) -> DataFrame:
    """One row per (record, term): ``record_cols, term_col, freq, rows`` (terms of the
    record), ``record_total, term_total, total, records`` (of the collection), ``df``
    (records with the term), ``p_value, q_value, score``.

    Repeated (record, term) rows are added up first. Rows with a NULL record column
    or term do not count; NULL and negative counts are 0. A term in all records, or
    one that makes up the whole collection, has p = 1 and score 0. Ties share a
    score. An empty table gives no row. Other columns are not read. Counts are exact
    up to 2^53 occurrences of the collection.
    """
    used = df.select(*record_cols, F.col(term_col).alias("__term"), F.greatest(F.coalesce(F.col(count_col).cast("bigint"), F.lit(0)), F.lit(0)).alias("freq"))
    used = used.dropna(subset=[*record_cols, "__term"]).groupBy(*record_cols, "__term").agg(F.sum("freq").alias("freq"))
    used = materialise(used, "counts")
    records = materialise(used.groupBy(*record_cols).agg(F.count("*").alias("rows"), F.sum("freq").alias("record_total")), "records")
    terms = materialise(used.groupBy("__term").agg(F.count("*").alias("df"), F.sum("freq").alias("term_total")), "term-totals")
    whole = records.agg(F.count("*").alias("records"), F.sum("rows").alias("rows"), F.sum("record_total").alias("total")).first()
    n = whole.rows or 0
    joined = join_stats(join_stats(used, records, record_cols, "rows", n), terms, ["__term"], "df", n)
    joined = joined.withColumns({"total": F.lit(whole.total or 0).cast("bigint"), "records": F.lit(whole.records).cast("bigint")})
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema)
    scored = materialise(joined.mapInArrow(_tails, schema + ", ln_p double"), "enrichment")
    out = adjust(scored)
    score = F.abs(F.col("q_ln") / F.log(F.lit(10.0)))
    columns = [*record_cols, F.col("__term").alias(term_col), "freq", "rows", "record_total", "term_total", "total", "records", "df"]
    return out.select(*columns, F.exp("ln_p").alias("p_value"), F.exp("q_ln").alias("q_value"), score.alias("score"))
