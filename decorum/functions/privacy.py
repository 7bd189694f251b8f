"""Masking of personal data."""

from pyspark.sql import functions as F

from decorum import lexicon
from decorum.functions.patterns import WORD

# The plain boundary of Java depends on its version; this is the ASCII one.
_ASCII = "[A-Za-z0-9_]"
_BOUNDARY = f"(?:(?<={_ASCII})(?!{_ASCII})|(?<!{_ASCII})(?={_ASCII}))"


def _java(pattern):
    return pattern.replace(r"\b", _BOUNDARY)


def mask_entity(col, name):
    """Replace the matches of one recognizer by ``<NAME>``. A cheap hint spares most
    texts the full pattern."""
    pattern, hint = lexicon.PII_PATTERNS[name], lexicon.PII_HINTS[name]
    return F.when(col.rlike(hint), F.regexp_replace(col, _java(pattern), f"<{name}>")).otherwise(col)


def count_entity(col, name):
    pattern, hint = lexicon.PII_PATTERNS[name], lexicon.PII_HINTS[name]
    return F.when(col.rlike(hint), F.regexp_count(col, F.lit(_java(pattern)))).otherwise(0)


_REST = r"[\p{L}'’-]*"
_NAME = r"\p{Lu}" + _REST


def name_tokens(col):
    """Capitalised words of a text, without repeats."""
    return F.array_distinct(F.regexp_extract_all(col, F.lit(rf"(\p{{Lu}}(?<![{WORD}]\p{{Lu}}){_REST})"), 1))


def mask_names(col, names):
    """Replace runs of capitalised words that begin with one of the array
    ``names`` by ``<PERSON>``. The words of ``names`` hold letters, apostrophes and
    hyphens only, so they can stand in a pattern as they are. A run is taken whole (``*+``), so its length needs
    no stack."""
    run = F.concat(
        F.lit(f"(?<![{WORD}])(?:"), F.array_join(names, "|"),
        F.lit(rf")(?![{WORD}'’-])(?: {_NAME})*+"),
    )
    return F.when(F.size(names) > 0, F.regexp_replace(col, run, F.lit("<PERSON>"))).otherwise(col)
