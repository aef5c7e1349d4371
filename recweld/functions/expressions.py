"""Column expressions that recur: guarded arithmetic, bins, hashes, array sets. Undefined values are NULL, never NaN."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_divide(a: str | Column, b: str | Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(col(b) != 0, col(a) / col(b)).otherwise(F.lit(0.0))


def null_if_nan(c: str | Column) -> Column:
    return F.when(~F.isnan(col(c)), col(c))


def strict_least(*cs: str | Column) -> Column:
    """The least of the values, NULL if any is."""
    return F.when(reduce(lambda x, y: x & y, (col(c).isNotNull() for c in cs)), F.least(*map(col, cs)))


def strict_greatest(*cs: str | Column) -> Column:
    return F.when(reduce(lambda x, y: x & y, (col(c).isNotNull() for c in cs)), F.greatest(*map(col, cs)))


def clip(c: str | Column, low: float, high: float) -> Column:
    return F.when(col(c).isNotNull(), F.least(F.greatest(col(c), F.lit(low)), F.lit(high)))


def bin_of(c: str | Column, edges: list[float], left_closed: bool = False) -> Column:
    """The number of the interval, 0 to len(edges): (a, b] by default, [a, b) if left_closed."""
    below = (lambda e: col(c) < e) if left_closed else (lambda e: col(c) <= e)
    out = reduce(lambda chain, ke: chain.when(below(ke[1]), ke[0]), enumerate(edges), F.when(col(c).isNull(), F.lit(None).cast("int")))
    return out.otherwise(len(edges))


def lookup(c: str | Column, mapping: dict) -> Column:
    """The mapped value; a value without one is an error, NULL stays NULL."""
    chain = F.when(col(c).isNull(), F.lit(None))
    for key, value in mapping.items():
        chain = chain.when(col(c) == key, F.lit(value))
    return chain.otherwise(F.raise_error(F.concat(F.lit("no value for "), col(c).cast("string"))))


def crc_split(c: str | Column, share: float = 0.2, parts: int = 1000) -> Column:
    """Whether a row is in the held-out split: crc32 of its id modulo parts below share * parts."""
    return F.pmod(F.crc32(F.encode(col(c).cast("string"), "UTF-8")), F.lit(parts)) < round(share * parts)


def uniform(c: str | Column, seed: int = 0) -> Column:
    """A number in [0, 1) from a seeded hash, the same wherever the row is."""
    return F.pmod(F.xxhash64(col(c), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)


def md5_uniform(c: str | Column) -> Column:
    """As uniform(), by 32 bits of md5: any SQL engine has the same number."""
    return F.conv(F.substring(F.md5(col(c).cast("string")), 1, 8), 16, 10).cast("double") / 4294967296.0


def words(c: str | Column) -> Column:
    """Distinct non-empty words."""
    return F.array_distinct(F.filter(F.split(F.coalesce(col(c), F.lit("")), " "), lambda w: w != ""))


def jaccard(a: str | Column, b: str | Column) -> Column:
    """Of two array sets; NULL if both are empty."""
    union = F.size(F.array_union(col(a), col(b)))
    return F.when(union > 0, F.size(F.array_intersect(col(a), col(b))) / union)
