"""Codes and names: normalisers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes in the order in which they go, each once; noise words; cost type names.
VENDOR_SUFFIXES = (" incorporated", " inc", " llc", " corp", " corporation", " co", " ltd", " limited", " company", " enterprises", " services", " group", ".", ",")
NOISE = ("division", "div", "work", "general", "project", "total", "subtotal", "sub-total", "summary", "estimate")
TYPE_NAMES = (("LABOR", "L"), ("MATERIAL", "M"), ("SUBCONTRACT", "S"), ("SUB", "S"), ("OTHER", "O"), ("EQUIPMENT", "O"))


def blank(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def code(c: Column) -> Column:
    """The leading ``d-d`` of a code, else the trimmed code."""
    t = F.trim(blank(c))
    return F.when(t.rlike(r"^[0-9]+-[0-9]+"), F.regexp_extract(t, r"^([0-9]+-[0-9]+)", 1)).otherwise(t)


def base_code(c: Column) -> Column:
    return F.regexp_extract(F.trim(blank(c)), r"^([0-9]+(?:-[0-9]+)?)", 1)


def division_key(c: Column) -> Column:
    return F.regexp_extract(F.trim(blank(c)), r"^([0-9]+)", 1)


def invoice(c: Column) -> Column:
    return F.lower(F.regexp_replace(blank(c), "[ -]", ""))


def vendor_clean(c: Column) -> Column:
    return F.lower(F.trim(blank(c)))


def vendor(c: Column) -> Column:
    """Lower-cased, with legal suffixes off one after the other and white space collapsed."""
    out = F.trim(F.lower(blank(c)))
    for suffix in VENDOR_SUFFIXES:
        out = F.trim(F.regexp_replace(out, rf"\Q{suffix}\E$", ""))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def name_prefix(c: Column, n: int = 20) -> Column:
    return F.trim(F.lower(F.substring(blank(c), 1, n)))


def cost_type(c: Column) -> Column:
    """One-letter cost type of ``L - Labor``, ``Labor`` or ``L``."""
    t = F.upper(F.trim(blank(c)))
    named = F.substring(t, 1, 1)
    for name, letter in reversed(TYPE_NAMES):
        named = F.when(t.startswith(name), F.lit(letter)).otherwise(named)
    return F.when(F.length(t) == 1, t).when(t.contains(" - "), F.trim(F.get(F.split(t, " - "), F.lit(0)))).otherwise(named)


def words(c: Column) -> Column:
    """Lower-cased, with all but letters, digits, _ and single spaces gone."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(blank(c)), r"(?U)[^\w\s]", " "), r"\s+", " "))


def for_matching(c: Column) -> Column:
    out = F.trim(F.lower(blank(c)))
    for word in NOISE:
        out = F.regexp_replace(out, rf"\b{word}\b", "")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[^a-z0-9\s]", " "), r"\s+", " "))


def sentinel(c: Column) -> Column:
    """Nulls as <NULL> and blanks as <EMPTY>, for composite keys."""
    return F.when(c.isNull(), "<NULL>").when(F.trim(c) == "", "<EMPTY>").otherwise(F.lower(F.trim(c)))


def composite_key(*columns: Column) -> Column:
    return F.concat_ws("|", *[sentinel(c.cast("string")) for c in columns])


def after_dash(c: Column) -> Column:
    """The part behind the first ' - ', or all of it."""
    return F.when(c.contains(" - "), F.regexp_extract(c, r"(?s)^.*? - (.*)$", 1)).otherwise(c)
