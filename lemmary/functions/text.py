"""Small text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters and what they are written as.
LATIN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "i",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f",
    "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "iu", "я": "ia",
}


def transliterate(text: Column) -> Column:
    """Cyrillic in Latin letters, for file names; other characters stay."""
    single = {k: v for k, v in LATIN.items() if len(v) == 1}
    # translate() drops characters beyond the replacement, which writes "" for signs
    source, target = "".join(single), "".join(single.values())
    signs = "".join(k for k, v in LATIN.items() if not v)
    out = F.translate(F.translate(text, source + source.upper(), target + target.upper()), signs + signs.upper(), "")
    for k, v in LATIN.items():
        if len(v) > 1:
            out = F.replace(F.replace(out, F.lit(k), F.lit(v)), F.lit(k.upper()), F.lit(v.capitalize()))
    return out


def has_words(text: Column, words: list[str]) -> Column:
    """True if all words stand in the text as whole words, also first or last."""
    found = F.lit(True)
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    for w in words:
        found = found & padded.contains(f" {w} ")
    return found
