"""String queries and packed ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def matches(column: str, query: str) -> Column:
    """``"x"`` equals x, ``x?`` begins with it, ``?x`` ends with it, else the column contains it. The column is in lower case, the query in any."""
    value, text = F.col(column), query.lower()
    if len(text) > 1 and text[0] == text[-1] == '"':
        return value == text[1:-1]
    if text.endswith("?") and not text.startswith("?"):
        return value.startswith(text[:-1])
    if text.startswith("?") and not text.endswith("?"):
        return value.endswith(text[1:])
    return value.contains(text.strip("?"))


#: Marks of a value's begin and end in its trigrams.
BEGIN, END = "\x02", "\x03"


def needed_trigrams(query: str) -> list[str]:
    """Trigrams that each matching value has, with the marks around it; none where the query is too short to need any."""
    text = query.lower()
    if len(text) > 1 and text[0] == text[-1] == '"':
        text = BEGIN + text[1:-1] + END
    elif text.endswith("?") and not text.startswith("?"):
        text = BEGIN + text[:-1]
    elif text.startswith("?") and not text.endswith("?"):
        text = text[1:] + END
    else:
        text = text.strip("?")
    return sorted({text[i : i + 3] for i in range(len(text) - 2)})


def trigrams(column: str) -> Column:
    """The different trigrams of a value, with the marks around it."""
    marked = f"concat(chr(2), {column}, chr(3))"
    return F.expr(f"IF(length({marked}) < 3, array(), array_distinct(transform(sequence(1, greatest(1, length({marked}) - 2)), i -> substr({marked}, i, 3))))")


def packed_id(number: Column, kind: Column) -> Column:
    """Number and kind (0 to 3) in one long."""
    return F.shiftleft(number, 2).bitwiseOR(kind.cast("bigint"))


def packed_number(packed: Column) -> Column:
    return F.shiftright(packed, 2)


def packed_kind(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(3).cast("bigint")).cast("int")
