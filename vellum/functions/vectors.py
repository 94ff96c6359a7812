"""Vector expressions over ARRAY<FLOAT>/ARRAY<DOUBLE> columns.

These are the *expression* forms (higher-order functions, evaluated per row in the JVM). They are
the semantic yardstick and are used for single-vector work; the batch kNN kernel in
``operators.knn`` computes the same distances as a block matrix product over Arrow batches.
All arithmetic is done in DOUBLE.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------------
# Fixed values.
# Layer-norm epsilon and L2-normalisation floor of the embedding post-processing.
LAYER_NORM_EPS = 1e-5
L2_EPS = 1e-12
# Truncation sizes the post-processing accepts by default.
VALID_DIMS = (512, 256, 128, 64)
# Distance metrics: cosine = 1 - cos, l2 = squared euclidean, ip = 1 - dot.
METRICS = ("cosine", "l2", "ip")
# ---------------------------------------------------------------------------------------------


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_double(v: Column | str) -> Column:
    return _col(v).cast("array<double>")


def vsum(v: Column | str) -> Column:
    return F.aggregate(as_double(v), F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x))


def squared_l2(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(
        F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x
    )


def distance(a: Column | str, b: Column | str, metric: str = "cosine") -> Column:
    """Distance in the collection's metric; a zero vector is at cosine distance 1 from all."""
    if metric == "cosine":
        size = norm(a) * norm(b)
        return F.lit(1.0) - F.when(size == 0, F.lit(0.0)).otherwise(F.try_divide(dot(a, b), size))
    if metric == "l2":
        return squared_l2(a, b)
    if metric == "ip":
        return F.lit(1.0) - dot(a, b)
    raise ValueError(f"unknown metric {metric!r}; expected one of {METRICS}")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and bind it for ``body`` (a lambda over the bound value). Without
    this, an aggregate referenced inside a ``transform`` lambda is recomputed for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def l2_normalize(v: Column | str, eps: float = L2_EPS) -> Column:
    return let(as_double(v), lambda d: let(norm(d), lambda n: F.transform(d, lambda x: x / F.greatest(n, F.lit(eps)))))


def check_dim(dim: int, valid_dims: tuple[int, ...] = VALID_DIMS) -> None:
    if dim not in valid_dims:
        raise ValueError(f"dimension must be one of {list(valid_dims)}, got {dim}")


def postprocess(raw: Column | str, dim: int = 512, valid_dims: tuple[int, ...] = VALID_DIMS) -> Column:
    """Layer-norm over the full raw vector (population variance), keep the first ``dim`` values,
    then L2-normalise. Returns ARRAY<DOUBLE>."""
    check_dim(dim, valid_dims)

    def body(d: Column) -> Column:
        return let(vsum(d) / F.size(d), lambda mean: let(
            F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.size(d)
                   + F.lit(LAYER_NORM_EPS)),
            lambda scale: l2_normalize(F.transform(F.slice(d, 1, dim), lambda x: (x - mean) / scale))))

    return let(as_double(raw), body)


def is_valid_vector(v: Column | str, dim: int) -> Column:
    """Present, exactly ``dim`` long, no NULL, NaN or infinite element (E7)."""
    c = _col(v)
    return (
        c.isNotNull()
        & (F.size(c) == dim)
        & F.coalesce(F.forall(c, lambda x: x - x == 0), F.lit(False))  # only of finite numbers; null for null
    )


def invalid_reason(v: Column | str, dim: int) -> Column:
    c = _col(v)
    return (
        F.when(c.isNull(), F.lit("missing_embedding"))
        .when(F.size(c) != dim, F.concat(F.lit("dimension_mismatch:"), F.size(c).cast("string")))
        .when(F.exists(c, lambda x: x.isNull() | F.isnan(x)), F.lit("nan_in_embedding"))
        .when(F.exists(c, lambda x: F.abs(x) == float("inf")), F.lit("infinity_in_embedding"))
    )
