"""Column helpers: guarded arithmetic, lookups, arrays of scores, bits, JSON."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_div(num: Column, den: Column) -> Column:
    """num / den, null when den is zero."""
    return F.try_divide(num, den)


def lookup(table: Mapping[str, str], key: Column) -> Column:
    """Value of a literal map, null when the key is missing."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def nan_to_null(x: Column | str) -> Column:
    x = _c(x)
    return F.when(~F.isnan(x), x)


def clip(x: Column, lo: float, hi: float) -> Column:
    """Null stays null; F.greatest and F.least alone would skip it."""
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def sigmoid(x: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(x)))


def softmax(scores: Column | str) -> Column:
    """Softmax of an array, shifted by its maximum."""
    scores = _c(scores)
    e = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def array_sum(a: Column | str) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda s, x: s + x)


def argmax(a: Column | str) -> Column:
    """Zero-based index of the largest element, the first on ties."""
    a = _c(a)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def at(a: Column | str, zero_based: Column) -> Column:
    return F.try_element_at(_c(a), zero_based.cast("int") + 1)


def mean_abs_diff(a: Column | str, b: Column | str) -> Column:
    a = _c(a)
    d = F.zip_with(a, _c(b), lambda x, y: F.abs(x - y))
    return F.try_divide(array_sum(d), F.size(a).cast("double"))


def expand_proba(proba: Column | str, classes: Sequence[int], n_classes: int) -> Column:
    """Probabilities of the seen classes to a vector over all classes, zeros elsewhere."""
    slot = {c: i + 1 for i, c in enumerate(classes)}
    p = _c(proba)
    return F.array(*[F.element_at(p, slot[c]) if c in slot else F.lit(0.0) for c in range(n_classes)])


def two_column_proba(p: Column | str) -> Column:
    p = _c(p)
    return F.array(F.lit(1.0) - p, p)


def bit_width(x: Column | str) -> Column:
    return F.length(F.bin(_c(x)))


def bit(x: Column | str, i: int) -> Column:
    return F.shiftright(_c(x), i).bitwiseAND(F.lit(1)).cast("int")


def timestamp_label(ts: Column | str, style: str = "ymd") -> Column:
    """File-name time stamps, yyyyMMdd_HHmmss or MMddyy_HHmmss."""
    # fixed values: the two file-name formats
    pattern = {"ymd": "yyyyMMdd_HHmmss", "mdy": "MMddyy_HHmmss"}[style]
    return F.date_format(_c(ts), pattern)
