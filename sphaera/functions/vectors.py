"""Dense-vector column functions (M1-M5, T11) on ``ARRAY<FLOAT/DOUBLE>``.

Spark has no vector SQL functions, so these are higher-order array
expressions; they stay in the JVM and inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _unrolled_sum(terms: list[Column]) -> Column:
    acc = terms[0]
    for t in terms[1:]:
        acc = acc + t
    return acc


def dot(a, b, dim: int | None = None) -> Column:
    """M1: sum of element products, accumulated in DOUBLE, left to right.

    With a known ``dim`` the sum is unrolled into element accesses, which
    whole-stage codegen compiles (higher-order array functions are
    interpreted); both forms add in the same order, so they agree bit for
    bit."""
    if dim is not None:
        x, y = _c(a), _c(b)
        return _unrolled_sum([x[j].cast("double") * y[j].cast("double") for j in range(dim)])
    return F.aggregate(
        F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0).cast("double"),
        lambda s, x: s + x,
    )


def norm(a, dim: int | None = None) -> Column:
    """M2: Euclidean length."""
    return F.sqrt(dot(a, a, dim))


def cosine(a, b, dim: int | None = None) -> Column:
    """M3: dot / (|a| |b|); the product keeps cos(a, b) == cos(b, a) bit
    for bit, so tied pairs stay tied for rank statistics."""
    return dot(a, b, dim) / (norm(a, dim) * norm(b, dim))


def euclidean(a, b) -> Column:
    """M4: Euclidean distance."""
    return F.sqrt(
        F.aggregate(
            F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double")) ** 2),
            F.lit(0.0).cast("double"),
            lambda s, x: s + x,
        )
    )


def scale(a, k) -> Column:
    k = k if isinstance(k, Column) else F.lit(k)
    return F.transform(_c(a), lambda x: x * k)


def add(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)




def to_float(a) -> Column:
    return F.transform(_c(a), lambda x: x.cast("float"))


def divide(a, n, dim: int | None = None, as_float: bool = False) -> Column:
    """T11 retraction once the norm ``n`` is known (null for a zero vector)."""
    n = _c(n)
    if dim is not None:
        x = _c(a)
        els = [x[j].cast("double") / n for j in range(dim)]
        if as_float:
            els = [e.cast("float") for e in els]
        return F.when(n > 0, F.array(*els)).otherwise(F.lit(None))
    return F.when(n > 0, F.transform(_c(a), lambda x: (x / n))).otherwise(F.lit(None))


def l2_normalize(df, col: str, out: str | None = None, as_float: bool = True, dim: int | None = None):
    """T11 on a DataFrame: two projections, so the norm is computed once and
    the array expression is not duplicated by projection collapsing."""
    out = out or col
    tmp = f"__norm_{col}"
    if dim is not None:
        return df.withColumn(tmp, norm(col, dim)).withColumn(out, divide(col, tmp, dim, as_float)).drop(tmp)
    res = df.withColumn(tmp, norm(col)).withColumn(out, divide(col, tmp)).drop(tmp)
    if as_float:
        res = res.withColumn(out, to_float(out))
    return res


def element_aggs(col: str, dim: int, fn=F.sum, prefix: str = "_e") -> list[Column]:
    """One aggregate per element of a fixed-length array column: a plain
    hash aggregate with a map-side partial phase, so a hot key costs one
    partial row per task however many arrays it has."""
    return [fn(F.col(col)[j].cast("double")).alias(f"{prefix}{j}") for j in range(dim)]


def element_array(dim: int, prefix: str = "_e") -> Column:
    """Reassemble the columns of :func:`element_aggs` into one array."""
    return F.array(*[F.col(f"{prefix}{j}") for j in range(dim)])
