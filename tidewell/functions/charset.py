"""Byte-order marks and runs of characters."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks in hexadecimal, the longer before those that they begin with.
MARKS = (("utf_32", "FFFE0000"), ("utf_32", "0000FEFF"), ("utf_8", "EFBBBF"), ("utf_7", "2B2F76"), ("gb18030", "84319533"), ("utf_16", "FFFE"), ("utf_16", "FEFF"))


def byte_order_mark(raw: Column) -> Column:
    """struct(name, size) of the mark that bytes begin with; name NULL and size 0 where there is none."""
    found = [(F.hex(F.substring(raw, 1, len(m) // 2)) == m, F.struct(F.lit(n).alias("name"), F.lit(len(m) // 2).alias("size"))) for n, m in MARKS]
    none = F.struct(F.lit(None).cast("string").alias("name"), F.lit(0).alias("size"))
    return F.coalesce(*[F.when(c, s) for c, s in found], none)


def scan_run(text: Column, chars: str, inside: bool = True) -> Column:
    """The run at the text's start of characters in the set, or outside of it."""
    return F.regexp_extract(text, f"^[{'' if inside else '^'}{re.escape(chars)}]*", 0)
