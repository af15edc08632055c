"""Cleaning and splitting of raw text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python counts as whitespace (Java's \s is ASCII only).
SPACE = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
NOT_SPACE = r"[^\t-\r\x1c-\x20\x{85}\p{Z}]"

# One piece per match: a comment, a whole literal, a run of plain text, or a lone / ' ".
# Possessive quantifiers keep the matcher's stack flat on very long literals.
CODE_PIECE = r"""(?s)//[^\n]*|/\*.*?\*/|'(?:[^\\']++|\\.)*+'|"(?:[^\\"]++|\\.)*+"|[^/'"]+|."""

# Run-name markers and the cleaner each of them selects.
RUNS_ONLY_MARK = "PDBERT"
RAW_MARK = "GraphCodeBERT"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse_ws(c: Column | str) -> Column:
    """Every whitespace run becomes one space; both ends are trimmed."""
    return F.trim(F.regexp_replace(_col(c), SPACE + "+", " "))


def collapse_runs(c: Column | str) -> Column:
    """A run of spaces, or of tabs, becomes one space; newlines stay, mixed runs give two."""
    return F.regexp_replace(_col(c), r" +|\t+", " ")


def strip_ws(c: Column | str) -> Column:
    """Trim whitespace (Unicode) from both ends only."""
    return F.regexp_replace(_col(c), f"^{SPACE}+|{SPACE}+\\z", "")


def strip_comments(c: Column | str) -> Column:
    """C comments become one space (literals stay whole), then blank lines are dropped."""
    pieces = F.regexp_extract_all(_col(c), F.lit(CODE_PIECE), F.lit(0))
    kept = F.transform(
        pieces,
        lambda p: F.when(F.startswith(p, F.lit("//")) | F.startswith(p, F.lit("/*")), F.lit(" ")).otherwise(p),
    )
    lines = F.split(F.array_join(kept, ""), "\n")
    return F.array_join(F.filter(lines, lambda line: line.rlike(NOT_SPACE)), "\n")


def clean_for(run_name: Column | str, c: Column | str) -> Column:
    """Cleaner chosen by a marker inside the run's name."""
    name, text = _col(run_name), _col(c)
    return (
        F.when(name.contains(RUNS_ONLY_MARK), collapse_runs(text))
        .when(name.contains(RAW_MARK), text)
        .otherwise(collapse_ws(text))
    )


def words(c: Column | str) -> Column:
    """Whitespace-separated words."""
    return F.regexp_extract_all(_col(c), F.lit(NOT_SPACE + "+"), F.lit(0))


def spaced_words(c: Column | str) -> Column:
    """Words carrying the whitespace before them, so that joining them gives the text back."""
    return F.regexp_extract_all(_col(c), F.lit(f"{SPACE}*{NOT_SPACE}+|{SPACE}+"), F.lit(0))
