"""The most frequent rows of a table of counts, without sending them to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts that rows of one count are dealt into.
PARTS = 4096


def most_frequent(counted: DataFrame, n: str, key: str, most: int) -> DataFrame:
    """Rows of the largest ``n``, ``most`` at most: all if they are no more.

    A histogram of counts gives the count from which they fit.  Of the rows with
    the count just below, whole parts by a hash of ``key`` fill up, so the result
    is short of ``most`` by less than a part or so, and it is always the same.
    """
    if counted.count() <= most:
        return counted
    left = most

    def last_that_fits(rows: DataFrame, by):
        """The first group, in the order given, that doesn't fit any more."""
        nonlocal left
        for r in sorted(rows.groupBy(by.alias("g")).agg(F.count("*").alias("c")).collect(), key=lambda r: r["g"]):
            if r["c"] > left:
                return r["g"]
            left -= r["c"]
        return None

    # classes of a sixteenth of a power of two, then exact counts within one class: few rows each
    class_ = -F.floor(16 * F.log2(F.col(n)))
    at = last_that_fits(counted, class_)
    exact = last_that_fits(counted.where(class_ == at), -F.col(n))
    part = F.pmod(F.xxhash64(key), F.lit(PARTS))
    cut = last_that_fits(counted.where(F.col(n) == -exact), part)
    return counted.where((F.col(n) > -exact) | ((F.col(n) == -exact) & (part < cut)))
