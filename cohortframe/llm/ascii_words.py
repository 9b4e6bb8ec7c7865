"""Words of a text: runs of ``0-9``, ``a-z`` and characters beyond ASCII, after lower-casing ``A-Z`` alone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_UPPER = "".join(map(chr, range(0x41, 0x5B)))
_BREAKS = "".join(chr(c) for c in range(0x80) if not chr(c).isalnum())


def word_array(text: str | Column) -> Column:
    """The words of a text column as an array; null has none."""
    text = F.coalesce((F.col(text) if isinstance(text, str) else text).cast("string"), F.lit(""))
    plain = F.translate(text, _UPPER + _BREAKS, _UPPER.lower() + " " * len(_BREAKS))
    return F.array_remove(F.split(plain, " "), "")
