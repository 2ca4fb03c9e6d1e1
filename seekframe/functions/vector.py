"""Vector arithmetic as Column expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product, summed in double from the first element on."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """v over its Euclidean norm; a norm below 1e-12 gives zeros."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm < 1e-12, F.lit(0.0)).otherwise(x.cast("double") / norm))


def truncate(v: Column, dim: int) -> Column:
    """The first dim elements (dim clamped to the length), normalized again."""
    return l2_normalize(F.slice(v, 1, max(0, dim)))


def _once(c: Column, f) -> Column:
    """f of a column that is computed once, though f names it for each element."""
    return F.element_at(F.transform(F.array(c), f), 1)


def quantize_i8(v: Column, zero_scale: float = 1.0) -> Column:
    """(codes, scale): symmetric 8-bit codes of a row; zeros get the scale zero_scale."""

    def by(v: Column, top: Column) -> Column:
        codes = F.transform(v, lambda x: F.when(top > 0, F.round(x.cast("double") / (top / F.lit(127.0)))).otherwise(F.lit(0.0)).cast("int"))
        return F.struct(codes.alias("codes"), F.when(top > 0, top / F.lit(127.0)).otherwise(F.lit(zero_scale)).alias("scale"))

    return _once(v, lambda v: _once(F.array_max(F.transform(v, lambda x: F.abs(x))).cast("double"), lambda top: by(v, top)))


def dequantize(codes: Column, scale: Column) -> Column:
    return F.transform(codes, lambda c: c.cast("double") * scale)


def int_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("bigint") * y.cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)


def quantize_i4(v: Column, group: int) -> Column:
    """Groups of (codes 1..15, scale): v is about (code - 8) * scale; a group of zeros has scale 1."""
    starts = F.sequence(F.lit(0), F.ceil(F.size(v) / F.lit(group)).cast("int") - 1)

    def one(g: Column) -> Column:
        part = F.slice(v, g * group + 1, F.lit(group))
        top = F.array_max(F.transform(part, lambda x: F.abs(x))).cast("double")
        codes = F.transform(part, lambda x: F.when(top > 0, F.round(x.cast("double") / (top / F.lit(7.0)))).otherwise(F.lit(0.0)).cast("int") + 8)
        return F.struct(codes.alias("codes"), F.when(top > 0, top / F.lit(7.0)).otherwise(F.lit(1.0)).alias("scale"))

    return F.transform(starts, one)


def sign_words(v: Column, center: Column) -> Column:
    """Sign bits of v - center in 64-bit words, the first dimension lowest; zero counts as positive."""
    bits = F.zip_with(v, center, lambda x, c: (F.round(x.cast("double") - c, 9) >= 0).cast("bigint"))
    words = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / F.lit(64)).cast("int"))
    return F.transform(words, lambda w: F.aggregate(F.transform(F.slice(bits, w * 64 + 1, F.lit(64)), lambda b, i: F.call_function("shiftleft", b, i)), F.lit(0).cast("bigint"), lambda s, x: s.bitwiseOR(x)))


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def max_sim(query: Column, doc: Column) -> Column:
    """Sum over the query's vectors of the greatest product with one of doc's; without vectors of doc each counts 0."""
    best = F.transform(query, lambda q: F.coalesce(F.array_max(F.transform(doc, lambda d: dot(q, d))), F.lit(0.0)))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + x)
