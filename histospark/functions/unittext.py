"""Units in free text: statements about pixel sizes, areas and positions.

All parsing is built of JVM expressions. Texts are compared in lower case with
full-width digits, the micro signs and the superscript two in one spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"([0-9]+(?:[.,][0-9]+)?(?:e[+-]?[0-9]+)?)"
_NM, _UM, _MM = r"nm|nanomet(?:er|re)s?", r"um|microns?|mi[ck]romet(?:er|re)s?", r"mm|millim\.?|millimet(?:er|re)s?"
_CM, _M = r"cm|centimet(?:er|re)s?|zentimeter", r"m|met(?:er|re)s?"
_DOTS = r"(?:px|pixels?|dots)\s*(?:/|per|je)\s*"

#: Pixel size units: pattern and factor to micrometres; densities are divided into it.
LENGTHS = {
    "px/mm": (rf"{_DOTS}(?:{_MM})\b", 1e3),
    "px/cm": (rf"{_DOTS}(?:{_CM})\b", 1e4),
    "px/inch": (rf"{_DOTS}(?:inch(?:es)?|in)\b|\bdpi\b|\bppi\b", 25400.0),
    "nm": (rf"\b(?:{_NM})\b", 1e-3),
    "um": (rf"\b(?:{_UM})\b", 1.0),
    "mm": (rf"\b(?:{_MM})(?:\b|$)", 1e3),
    "cm": (rf"\b(?:{_CM})\b", 1e4),
    "m": (rf"\b(?:{_M})\b", 1e6),
}
DENSITIES = ("px/mm", "px/cm", "px/inch")
DENSITY = "|".join(LENGTHS[k][0] for k in DENSITIES)


def squared(unit: str) -> str:
    return rf"(?:sq\.?|square|quadrat)\s*(?:{unit})\b|\b(?:{unit})\s*(?:\^?2|squared)"


AREAS = {
    "kpx": r"thousand pixels?|(?:px|pixels?)\s*x\s*1000|\bkpx\b|kilopixels?|tsd\.?\s*pixel|10\^3\s*px",
    "um2": squared(_UM),
    "mm2": squared(_MM),
    "nm2": squared(_NM),
}
POSITIONS = {
    "percent": r"percent|prozent|\bpct\b|%",
    "fraction": r"fraction|share of|anteil|relative|\brel\b",
    "nm": rf"\b(?:{_NM})\b",
    "um": rf"\b(?:{_UM})\b",
    "mm": rf"\b(?:{_MM})(?:\b|$|\s)",
}
PIXELS = r"\bpx|\bpix|pixel"


def plain(c: Column) -> Column:
    """Lower case, with one spelling of digits, micro signs, powers and blanks."""
    return F.translate(F.lower(c), "０１２３４５６７８９µμ² ", "0123456789uu2 ")


def first_match(text: Column, table: dict[str, str]) -> Column:
    """Name of the first pattern of ``table`` found in ``text``."""
    return F.coalesce(*[F.when(text.rlike(p), F.lit(name)) for name, p in table.items()])


def length_unit(text: Column) -> Column:
    """Unit of a pixel size in a short plain text."""
    return first_match(text, {k: p for k, (p, _) in LENGTHS.items()})


def statement(text: Column) -> tuple[Column, Column, Column]:
    """Of a plain text about an export: whether it states units, the area's and the position's.

    A quantity that a statement doesn't name is in pixels. Area units carry a square or
    a thousand and so can't be taken for position units."""
    area = first_match(text, AREAS)
    rest = text
    for p in AREAS.values():
        rest = F.regexp_replace(rest, p, " ")
    pos = first_match(rest, POSITIONS)
    states = area.isNotNull() | pos.isNotNull() | text.rlike(PIXELS)
    return F.coalesce(states, F.lit(False)), F.coalesce(area, F.lit("px")), F.coalesce(pos, F.lit("px"))


def number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


def to_um(value: Column, unit: Column) -> Column:
    """A pixel size in micrometres per pixel; NULL for an unknown unit."""
    out = F.lit(None).cast("double")
    for k, (_, f) in LENGTHS.items():
        out = F.when(unit == k, F.lit(f) / value if k in DENSITIES else value * f).otherwise(out)
    return out
