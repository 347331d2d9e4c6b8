"""How method names are compared."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The short names of methods, and all characters that count as white space.
ALIASES = {"fwb": "felzenszwalb", "ws": "watershed"}
SPACE = r"\t\n\x0b\x0c\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def method_name(c: Column) -> Column:
    """Without white space of any kind around it, in lower case, short names spelled out."""
    bare = F.lower(F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", ""))
    named = bare
    for short, full in ALIASES.items():
        named = F.when(bare == short, full).otherwise(named)
    return named


def case_groups(cases):
    """``case_id, method, label``, one row per known case: its latest row, ties by name."""
    rows = cases.select("case_id", method_name(F.col("method")).alias("method"), "label", "created_at").where("case_id IS NOT NULL")
    return rows.groupBy("case_id").agg(F.max(F.struct("created_at", "method", "label")).alias("b")).select("case_id", "b.method", "b.label")
