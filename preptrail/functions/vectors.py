"""Column functions on vectors held as arrays."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values -----------------------------------------------------------
MIN_NORM = 1e-9
# ---------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def squared_distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))
    return F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x)


def l2_normalize(v: Column) -> Column:
    norm = F.greatest(F.sqrt(dot(v, v)), F.lit(MIN_NORM))
    return F.transform(v, lambda x: (x.cast("double") / norm).cast("float"))
