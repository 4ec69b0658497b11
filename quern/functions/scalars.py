"""String and number functions as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def substring(s: Column, start: Column, length: Column) -> Column:
    """1-based; a start before the text shortens the result, as in standard SQL."""
    return F.when(start >= 1, F.substring(s, start, F.greatest(length, F.lit(0)))).otherwise(F.substring(s, F.lit(1), F.greatest(length + start - 1, F.lit(0))))


def _int(x: Column) -> Column:
    return x.cast("int")


def truncated(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))


def like_regex(pattern: str, escape: str | None) -> str:
    """A regular expression for %, _ and [class], with an escape character."""
    out, i = ["(?s)^"], 0
    quote = lambda c: "\\" + c if not c.isalnum() and c.isascii() and not c.isspace() else c
    while i < len(pattern):
        c = pattern[i]
        if escape and c == escape and i + 1 < len(pattern):
            i += 1
            out.append(quote(pattern[i]))
        elif c == "%":
            out.append(".*")
        elif c == "_":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            inner = pattern[i + 1 : end]
            no = inner.startswith("^")
            out.append("[" + "^" * no + "".join(x if x == "-" else quote(x) for x in inner[no:]) + "]")
            i = end
        else:
            out.append(quote(c))
        i += 1
    return "".join([*out, "$"])


#: name -> (builder, kind of the result)
CALLS = {
    "SUBSTRING": (lambda s, a, n: substring(s, _int(a), _int(n)), "string"),
    "STRINGLENGTH": (F.char_length, "number"),
    "TRIMALL": (F.trim, "string"),
    "TRIML": (F.ltrim, "string"),
    "TRIMR": (F.rtrim, "string"),
    "UPPER": (F.upper, "string"),
    "LOWER": (F.lower, "string"),
    "LEFT": (lambda s, n: F.left(s, _int(n)), "string"),
    "RIGHT": (lambda s, n: F.right(s, _int(n)), "string"),
    "STRFIND": (lambda s, x: F.instr(s, x), "number"),
    "STRREPLACE": (lambda s, a, b: F.replace(s, a, b), "string"),
    "INT": (truncated, "number"),
    "SQRT": (F.sqrt, "number"),
    "EXP": (F.exp, "number"),
    "LOG": (F.ln, "number"),
    "LOG10": (F.log10, "number"),
    "POW": (F.pow, "number"),
    "COS": (F.cos, "number"),
    "SIN": (F.sin, "number"),
    "TAN": (F.tan, "number"),
    "ACOS": (F.acos, "number"),
    "ASIN": (F.asin, "number"),
    "ATAN": (F.atan, "number"),
}
