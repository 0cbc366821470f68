"""Codecs of identifiers and posting lists as column expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = string.ascii_letters
BASE = len(ALPHABET)
DIGITS = 12  # enough for 63 bits


def encode_uint(value: Column) -> Column:
    """A non-negative number in base 52, most significant letter first."""
    letters = F.array(*map(F.lit, ALPHABET))
    powers = [BASE**i for i in range(DIGITS) if BASE**i < 2**63]
    digits = F.array(*[F.get(letters, (F.call_function("div", value, F.lit(p)) % BASE).cast("int")) for p in reversed(powers)])
    text = F.regexp_replace(F.array_join(digits, ""), "^a+(?=.)", "")
    return F.when(value.isNotNull(), text)


def decode_uint(text: Column) -> Column:
    """The inverse of :func:`encode_uint`."""
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("bigint"), lambda n, c: n * BASE + (F.position(c, F.lit(ALPHABET)) - 1))


def delta_encode(values: Column) -> Column:
    """First value, then differences."""
    return F.transform(values, lambda x, i: F.when(i == 0, x).otherwise(x - F.get(values, i - 1)))


def delta_decode(values: Column) -> Column:
    """Running sums: the inverse of :func:`delta_encode`."""
    empty = F.slice(values, 1, 0)
    return F.aggregate(values, empty, lambda xs, x: F.concat(xs, F.array(x + F.coalesce(F.try_element_at(xs, F.lit(-1)), x * 0))))


def encode_postings(plist: Column) -> Column:
    """``struct<n, pos, tid>`` of an array of ``struct<tid, pos>``: sizes, slots and
    delta-coded identifiers apart, which compress well in a columnar file."""
    tids = F.transform(plist, lambda p: p["tid"])
    return F.struct(F.size(plist).alias("n"), F.transform(plist, lambda p: p["pos"].cast("tinyint")).alias("pos"), delta_encode(tids).alias("tid"))


def decode_postings(coded: Column) -> Column:
    """The inverse of :func:`encode_postings`."""
    return F.zip_with(delta_decode(coded["tid"]), coded["pos"], lambda t, p: F.struct(t.alias("tid"), p.cast("int").alias("pos")))


def update_postings(coded: Column, more: Column) -> Column:
    """Coded postings with the array ``more`` appended."""
    return encode_postings(F.concat(decode_postings(coded), more))
