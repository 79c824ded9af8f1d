"""Option letters: parsing predictions, normalising gold labels. Column functions, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

#: Patterns of an answer, from most to least explicit; the first that hits wins.
EXPLICIT = (
    r"answer\s*is\s*[:\-]?\s*\(?([A-Z])\)?",
    r"answer\s*[:\-]\s*\(?([A-Z])\)?",
    r"\(([A-Z])\)",
    r"^\s*([A-Z])\s*[\.\):,]",
    r"^\s*([A-Z])\s*$",
)
LAST_RESORT = r"(?U)\b([A-Z])\b"


def _hit(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def predicted_letter(prediction: Column) -> Column:
    """The letter chosen in a raw generation; null where none can be found.

    Markers in angle brackets are blanked, then the explicit patterns are tried
    without regard to case, then the first capital that stands alone.
    """
    text = strip(F.regexp_replace(prediction, "<[^>]*>", " "))
    return F.upper(F.coalesce(*(_hit(text, "(?iU)" + p) for p in EXPLICIT), _hit(text, LAST_RESORT)))


def gold_letter(label: Column) -> Column:
    """A gold label as a letter; one that holds no letter comes out trimmed, in capitals."""
    return F.coalesce(predicted_letter(label), F.upper(strip(label)))


def option_letter(answer: Column, choices: Column) -> Column:
    """The letter of an answer that is a letter itself or the text of a choice."""
    bare = strip(answer)
    place = F.array_position(choices, bare)
    return F.when(bare.rlike("^[A-Za-z]$"), F.upper(bare)).when(place > 0, F.char(place + 64)).otherwise(gold_letter(bare))


def bracketed_letter(answer: Column) -> Column:
    """The second character of an answer such as "(B)", the only one of "B"; in capitals."""
    return F.upper(F.substring(answer, F.when(F.length(answer) > 1, 2).otherwise(1), F.lit(1)))
