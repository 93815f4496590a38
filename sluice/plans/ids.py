"""Node ids of the stand-in programs.

Their SQL adds a key to an offset for each kind of node. From a million methods or ten million calls on, the sums of two kinds are the same number, and
an operator, to which an id is one node, would go on from one kind to the other. For the operators the offsets are therefore spread,
and what a query returns has the sums of its SQL again.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

STEP, SPAN = 10**6, 10**12  # offsets are multiples of the one; spread, of the other


def spread(text: str) -> str:
    """The SQL of a program with its offsets spread."""
    return re.sub(r"\b([1-9]\d?)000000\b", lambda m: str(int(m[1]) * SPAN), text)


def summed(c: Column) -> Column:
    """The id as the SQL has it. Keys may be a little below 0: offsets are told by the nearest one."""
    kind = F.floor((c + F.lit(SPAN // 2)) / F.lit(SPAN)).cast("long")
    return c - kind * F.lit(SPAN - STEP)
