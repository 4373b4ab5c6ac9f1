"""How a column is worked out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(c: Column) -> Column:
    """A costly value as a generator of one row, for a column of its own: it is worked out once.

    The optimizer moves filters below a plain column and repeats its expression in each of them; below a generator it moves
    none that needs what is generated.
    """
    return F.explode(F.array(c))
