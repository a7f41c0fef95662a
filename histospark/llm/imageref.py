"""Spellings of image references and patient numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDE = ("０１２３４５６７８９", "0123456789")


def digits(c: Column) -> Column:
    return F.translate(c, *_WIDE)


def image_number(ref: Column) -> Column:
    """The image id in a reference such as ``IMG-0001224``, ``1063.tif`` or ``IMG1166_v2.png``.

    It is the first run of digits; NULL where there is none or it is no bigint."""
    return F.regexp_extract(digits(ref), r"([0-9]+)", 1).try_cast("bigint")


def patient_number(text: Column) -> Column:
    """The patient number in ``PT_0000010``, ``pat. no. 0000019`` or `` #22 ``; placeholders and 0 give NULL."""
    n = F.regexp_extract(digits(text), r"^\s*(?:p(?:t|at|atient)?\.?\s*(?:no|nr)?\.?)?[\s\-_.#:]*([0-9]+)\s*$", 1)
    n = F.coalesce(F.when(n != "", n), F.when(F.lower(digits(text)).rlike(r"^[^0-9]*[0-9]+[^0-9]*$"), F.regexp_extract(digits(text), r"([0-9]+)", 1)))
    return F.nullif(n.try_cast("bigint"), F.lit(0).cast("bigint"))
