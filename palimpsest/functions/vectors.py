"""Vector expressions and embedders."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKETS = 64


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null for null, zero or differently long vectors."""
    same = F.size(a) == F.size(b)
    return F.when(same, 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))


def usable(v: Column, dims: int) -> Column:
    return v.isNotNull() & (F.size(v) == dims) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)) & F.exists(v, lambda x: x != 0)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: in a lambda an outer expression would be computed at every call."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hashed_embedding(text: Column, buckets: int = BUCKETS) -> Column:
    """Deterministic bag of hashed words, of unit length (all zero without words); no model needed, no meaning implied."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    places = F.transform(words, lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint"), F.lit(buckets)).cast("int"))
    count = lambda p: F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda b: F.size(F.filter(p, lambda x: x == b)).cast("double"))
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    scale = lambda c: let(norm(c), lambda n: F.transform(c, lambda x: F.coalesce(F.try_divide(x, n), F.lit(0.0))))
    return let(places, lambda p: let(count(p), scale))


def model_embedding(model: Callable[[list[str]], list[list[float]]]) -> Callable[[Column], Column]:
    """A column function from a model that embeds a list of texts; texts reach it in Arrow batches."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(list(model(texts.tolist())))

    return embed
