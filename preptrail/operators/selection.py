"""Exact medians of many columns by counting: histograms around the middle are refined until one value is left."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Parts into which the values between two known ones are divided in a pass.
PARTS = 4096


@dataclass
class Search:
    """A range of a column's values that holds the middle ranks: how many values lie below it, and its ends."""

    ranks: tuple[int, int]
    below: int
    low: float
    high: float


def _part(value: Column, low: float, high: float) -> Column:
    """Number of the part of ``low`` to ``high`` that a value is in; ascending with the value, and the ends are
    parts of their own, so that each pass leaves a smaller range. Halves keep differences finite."""
    width = high / 2 - low / 2
    even = 0 < width < float("inf")
    inside = F.floor((value / 2 - F.lit(low / 2)) / F.lit(width) * PARTS) if even else F.lit(0)
    within = 1 + F.greatest(F.lit(0), F.least(inside, F.lit(PARTS - 1)))
    return F.when(value == low, 0).when(value == high, PARTS + 1).otherwise(within).cast("int")


def _value(found: Search, rank: int, count: int) -> float | None:
    """The value at a rank of a range, if its ends tell."""
    if found.low == found.high or rank == found.below + 1:
        return found.low
    return found.high if rank == found.below + count else None


def medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Exact median of each column: the middle value, or the mean of the two middle ones.

    All columns are counted in the same passes, combined on the map side; the first finds their ends, each
    other one divides what is left by ``PARTS``. No value is sorted or moved, and the driver reads as many
    rows as there are parts. Nulls and NaN are no values; a column without values has no median.
    """
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns))))
    known = df.select(cells.alias("cell")).select("cell.*").filter(F.col("v").isNotNull() & ~F.isnan("v"))
    out: dict[str, float | None] = dict.fromkeys(columns)
    open_: dict[int, Search] = {}
    for row in known.groupBy("c").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect():
        open_[row["c"]] = Search(((row["n"] + 1) // 2, row["n"] // 2 + 1), 0, row["low"], row["high"])
        values = [_value(open_[row["c"]], rank, row["n"]) for rank in open_[row["c"]].ranks]
        if None not in values:
            out[columns[row["c"]]] = _mean(values)
            del open_[row["c"]]
    while open_:
        mine, part = F.lit(False), F.lit(None).cast("int")
        for c, found in open_.items():
            own = F.col("c") == c
            mine = mine | (own & F.col("v").between(found.low, found.high))
            part = F.when(own, _part(F.col("v"), found.low, found.high)).otherwise(part)
        counted = known.filter(mine).groupBy("c", part.alias("part")).agg(
            F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")
        )
        parts: dict[int, list] = {}
        for row in counted.collect():
            parts.setdefault(row["c"], []).append(row)
        for c, rows in parts.items():
            found, below, values = open_[c], open_[c].below, {}
            for row in sorted(rows, key=lambda r: r["part"]):
                here = Search(found.ranks, below, row["low"], row["high"])
                for rank in found.ranks:
                    if below < rank <= below + row["n"]:
                        values[rank] = _value(here, rank, row["n"])
                        if values[rank] is None:
                            open_[c] = here
                below += row["n"]
            if None not in values.values():
                out[columns[c]] = _mean([values[rank] for rank in found.ranks])
                del open_[c]
    return out


def _mean(values: list[float]) -> float:
    return values[0] if values[0] == values[1] else values[0] / 2 + values[1] / 2
