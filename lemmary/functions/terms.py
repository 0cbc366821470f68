"""Spelling of terms: ``lemma-POS`` arguments as one canonical string.

Spark has no Unicode composition function. Calling ICU by reflection costs about
6 microseconds a value; encoding an Arrow chunk as a dictionary and spelling only
its distinct values costs less than one, so canonical spelling is done there.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa

#: How an empty or missing slot is written.
MARKERS = ("<NONE>", "None-<NONE-POS>", "<->")


def canonical_term(value: str | None) -> str | None:
    """The term of an argument, or None where the slot holds none.

    Trimmed, composed (NFC), lemma in lower case, part of speech (what follows
    the last hyphen) as it is; without a hyphen all of it is lemma. None and the
    slot markers give None; an empty string is an (empty) term.
    """
    if value is None:
        return None
    value = value.strip()
    if value in MARKERS:
        return None
    lemma, dash, pos = value.rpartition("-")
    return unicodedata.normalize("NFC", lemma.lower() + dash + pos if dash else value.lower())


def encode(values: pa.Array | pa.ChunkedArray, spell=canonical_term) -> tuple[np.ndarray, list[str]]:
    """Codes (-1 for none) into the sorted list of distinct spelled values.

    The list is in code point order, so codes compare as the strings do.
    """
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.ChunkedArray):  # no chunk at all
        values = pa.array([], pa.string())
    coded = values.dictionary_encode()
    spelled = [spell(v) for v in coded.dictionary.to_pylist()]
    distinct = sorted({v for v in spelled if v is not None})
    at = {v: i for i, v in enumerate(distinct)}
    remap = np.array([-1 if v is None else at[v] for v in spelled] + [-1], dtype=np.int64)
    codes = coded.indices.fill_null(len(spelled)).to_numpy(zero_copy_only=False)
    return remap[codes], distinct
