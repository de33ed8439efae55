"""String cleaning expressions (all JVM-side, no Python UDFs)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference cleaning rules:
# leading characters stripped from product descriptions, in this order, one pass each.
LEAD_CHARS = [">", "#", "-", "*", "«"]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()``: trims Unicode whitespace (Spark ``trim`` only trims spaces)."""
    return F.regexp_replace(_c(c), r"(?U)^\s+|\s+$", "")


def py_title(c) -> Column:
    """Python ``str.title()``: upper-case the first letter of every run of letters.

    Spark ``initcap`` only capitalises after a space; Python also capitalises after
    digits and punctuation (``o'brien's 1st`` -> ``O'Brien'S 1St``). Every letter that
    follows a non-letter gets a sentinel and a space in front of it, ``initcap`` then
    capitalises it, and the sentinel pairs are removed. Three codegen-friendly string
    expressions; no lambda functions in the hot path.
    """
    marked = F.regexp_replace(F.lower(_c(c)), r"(?<=\P{L})(\p{L})", _SENTINEL + " $1")
    return F.replace(F.initcap(marked), F.lit(_SENTINEL + " "), F.lit(""))


_SENTINEL = "\u0001"


def strip_commas(c) -> Column:
    return F.translate(_c(c), ",", "")


def squeeze_ws(c) -> Column:
    """Collapse every whitespace run to one space (after comma removal, so a trailing
    space left by ``' foo ,'`` survives, as in the reference)."""
    return F.regexp_replace(_c(c), r"(?U)\s+", " ")


def clean_attribute(c) -> Column:
    """strip -> title -> remove commas -> squeeze whitespace (reference order)."""
    return squeeze_ws(strip_commas(py_title(py_strip(c))))


def lead_strip(c, chars=tuple(LEAD_CHARS)) -> Column:
    """Sequential ``lstrip(ch)`` for each ch in order == one anchored regex ``^a*b*c*``."""
    import re

    pattern = "^" + "".join(re.escape(ch) + "*" for ch in chars)
    return F.regexp_replace(_c(c), pattern, "")


def _plain_letters() -> tuple[str, str]:
    """(accented letters and then combining marks, the letters' plain forms), by the rule
    of canonical decomposition: a letter of the Latin blocks is folded if what it is made of is
    an ASCII letter and marks. Marks have no counterpart, so ``translate`` deletes them."""
    parts = {chr(i): unicodedata.normalize("NFD", chr(i)) for i in range(0x80, 0x2000)}
    folded = {c: d[0] for c, d in parts.items()
              if len(d) > 1 and d[0].isascii() and d[0].isalpha() and all(unicodedata.category(x) == "Mn" for x in d[1:])}
    marks = "".join(chr(i) for i in range(0x300, 0x370))
    return "".join(folded) + marks, "".join(folded.values())


ACCENTED, PLAIN = _plain_letters()
_FOLD = str.maketrans(ACCENTED[:len(PLAIN)], PLAIN, ACCENTED[len(PLAIN):])


def match_key(c) -> Column:
    """Canonical comparison key: insensitive to case, edge spaces and accents (trap T1), as a
    plain string, so that keys group and join by hash. Text of ASCII only, told by its
    length in bytes, isn't translated."""
    k = F.upper(F.trim(_c(c)))
    return F.when(F.octet_length(k) == F.char_length(k), k).otherwise(F.translate(k, ACCENTED, PLAIN))


def match_text(s: str) -> str:
    """The match key of a Python literal."""
    return s.strip(" ").upper().translate(_FOLD)


def ieq(a, b) -> Column:
    """Equality of match keys; ``b`` may be a Python literal."""
    if isinstance(b, str):
        return match_key(a) == F.lit(match_text(b))
    return match_key(a) == match_key(b)


def ine(a, b: str) -> Column:
    """Inequality of match keys: NULL ``a`` is neither equal nor unequal (excluded)."""
    return match_key(a) != F.lit(match_text(b))
