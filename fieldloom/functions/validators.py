"""The six validators of a spec as predicates; a null value always fails."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def check(validator: dict, text: Column, number: Column) -> Column:
    """Whether a value passes; ``number`` is null for values that are not numbers."""
    kind = validator["type"]
    if kind == "number":
        ok = number.isNotNull()
        if validator.get("min") is not None:
            ok = ok & (number >= float(validator["min"]))
        if validator.get("max") is not None:
            ok = ok & (number <= float(validator["max"]))
    elif kind == "nonempty":
        ok = F.length(F.trim(text)) > 0
    elif kind == "regex":
        ok = text.rlike(validator["pattern"]) if validator.get("pattern") else F.lit(False)
    elif kind == "enum":
        ok = text.isin(*validator.get("values", [])) if validator.get("values") else F.lit(False)
    elif kind == "max_len":
        ok = F.char_length(text) <= int(validator["max_len"]) if validator.get("max_len") is not None else F.lit(True)
    elif kind == "url":
        ok = text.rlike("^(https?://|/)")
    else:
        ok = F.lit(True)
    return F.coalesce(ok, F.lit(False)) & text.isNotNull()


def first_failing(validators: list[dict], text: Column, number: Column) -> Column:
    """The type of the first validator that a value fails, null if none does."""
    out = F.lit(None).cast("string")
    for v in reversed(validators):
        out = F.when(~check(v, text, number), F.lit(v["type"])).otherwise(out)
    return out
