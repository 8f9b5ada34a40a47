"""Normal forms of text columns."""

from __future__ import annotations

import sys
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(c: Column) -> Column:
    """Trimmed; null if blank."""
    return F.nullif(F.trim(c), F.lit(""))


@cache
def _folds() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """The characters that fold to one other, what those fold to, and the characters that fold to several (sharp s, ligatures, dotted capital i), from Unicode's own table."""
    one, other, more = [], [], []
    for i in range(0x80, sys.maxunicode + 1):
        folded = chr(i).casefold()
        if folded != chr(i):
            if len(folded) == 1:
                one.append(chr(i))
                other.append(folded)
            else:
                more.append((chr(i), folded))
    return "".join(one), "".join(other), tuple(more)


def casefold(c: Column) -> Column:
    """Full case folding, character by character without regard to its neighbours; A to Z alone where a text is ASCII."""
    one, other, more = _folds()
    ascii_, capitals = F.lower(c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    simple = F.translate(c, capitals + one, capitals.lower() + other)
    table = F.create_map(*[F.lit(x) for pair in more for x in pair])
    full = F.array_join(F.transform(F.split(simple, ""), lambda x: F.coalesce(F.try_element_at(table, x), x)), "")
    several = simple.rlike("[" + "".join(x for x, _ in more) + "]")
    return F.when(c.rlike(r"^[\x00-\x7F]*+$"), ascii_).when(several, full).otherwise(simple)


def spaced_lower(c: Column) -> Column:
    """Case-folded with single spaces; null if blank."""
    return F.nullif(casefold(F.trim(F.regexp_replace(c, r"(?U)\s+", " "))), F.lit(""))


def dictionary_form(c: Column) -> Column:
    """Lower case, everything but a-z and 0-9 as single spaces; null if the text is blank."""
    return F.when(clean(c).isNotNull(), F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")))
