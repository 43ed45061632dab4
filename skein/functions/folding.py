"""Folding of names to index keys, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STANDARD, AGGRESSIVE = "standard", "aggressive"
MODES = (STANDARD, AGGRESSIVE)

# The patterns of decorations that aggressive folding strips.
CATALOGUE_SUFFIX = r"\s*-\s*(?:DS|DC|[GSTMC])\d{3,4}(\.\d{3,4})?\s*\z"
VENDOR_SUFFIX = r"\s*\([^)]*\)\s*\z"
PLATFORM_PREFIX = r"(?i)\A(win|elf|apk|osx|py|js|vbs|jar|symbian|ios)[._\-/]+"
COLLECTIVE_SUFFIX = r"(?i)[._\-/\s]+(group|groups|gang|team|crew|apt|cyberespionage|framework|lair)\s*\z"

_BLANK = r"[\s\x{85}\p{Z}]"


def trim(s: Column) -> Column:
    """Without white space, Unicode's included, at either end."""
    return F.regexp_replace(s, rf"\A{_BLANK}+|{_BLANK}+\z", "")


def fold(s: Column) -> Column:
    """Letters and decimal digits only, in lower case."""
    return F.lower(F.regexp_replace(s, r"[^\p{L}\p{Nd}]+", ""))


def _let(value: Column, use) -> Column:
    """use(value) with value computed once, however often use refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _strip(s: Column, pattern: str) -> Column:
    """Without what matches pattern, unless nothing but blanks would be left."""
    return _let(s, lambda x: _let(F.regexp_replace(x, pattern, ""), lambda out: F.when(trim(out) != "", out).otherwise(x)))


def _without_article(s: Column) -> Column:
    return _let(s, lambda x: F.when(F.lower(x).startswith("the ") & (trim(F.substr(x, F.lit(5))) != ""), F.substr(x, F.lit(5))).otherwise(x))


def fold_aggressive(s: Column) -> Column:
    """Folding after decorations are stripped, where their separators can still be seen.

    In order: a catalogue identifier at the end, a parenthesis at the end,
    a leading "the", a platform prefix, a collective noun at the end. Each
    goes only if a name is left.
    """
    s = _strip(trim(s), CATALOGUE_SUFFIX)
    s = trim(_strip(s, VENDOR_SUFFIX))
    return fold(_strip(_strip(_without_article(s), PLATFORM_PREFIX), COLLECTIVE_SUFFIX))


def fold_by(mode: str, s: Column) -> Column:
    return {STANDARD: fold, AGGRESSIVE: fold_aggressive}[mode](s)


def parse_mode(mode: str | None) -> str:
    """The folding mode of a name; blank means standard."""
    got = (mode or "").strip().lower() or STANDARD
    if got not in MODES:
        raise ValueError(f"unknown normalisation: {mode!r}; use standard or aggressive")
    return got


def tag(namespace: str, galaxy: Column, value: Column) -> Column:
    """namespace:galaxy="value", quotes escaped; empty where either is missing."""
    quoted = F.concat(F.lit(f"{namespace}:"), galaxy, F.lit('="'), F.replace(value, F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when((F.coalesce(galaxy, F.lit("")) == "") | (F.coalesce(value, F.lit("")) == ""), F.lit("")).otherwise(quoted)


def cleaned(names: list[str] | None) -> list[str]:
    """A filter list, trimmed and in lower case; empty means no filter."""
    return sorted({n.strip().lower() for n in names or [] if n and n.strip()})
