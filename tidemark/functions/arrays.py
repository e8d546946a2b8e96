"""Vector algebra and array reshaping as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column | str, b: Column | str) -> Column:
    """NULL where the lengths differ."""
    return _sum(F.zip_with(_col(a), _col(b), lambda x, y: x.cast("double") * y.cast("double")))


def norm(v: Column | str) -> Column:
    return F.sqrt(_sum(F.transform(_col(v), lambda x: x.cast("double") * x.cast("double"))))


def normalise(v: Column | str) -> Column:
    """A unit vector; a zero vector stays as it is."""
    length = norm(v)
    return F.when(length == 0, F.transform(_col(v), lambda x: x.cast("double"))).otherwise(F.transform(_col(v), lambda x: x.cast("double") / length))


def euclidean(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(_sum(F.zip_with(_col(a), _col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 - cosine; NULL for a zero vector or for lengths that differ."""
    size = norm(a) * norm(b)
    return F.when((size > 0) & (F.size(_col(a)) == F.size(_col(b))), 1 - dot(a, b) / size)


def same(a: Column | str, b: Column | str) -> Column:
    """Equality within the machine's epsilon."""
    return F.abs(_col(a) - _col(b)) < EPSILON


def has_nan(v: Column | str) -> Column:
    """Whether a vector is missing or has a missing element."""
    return _col(v).isNull() | F.exists(_col(v), lambda x: x.isNull() | F.isnan(x.cast("double")))


def nan_to(x: Column | str, value: float = 0.0) -> Column:
    """NULL or NaN to a value."""
    return F.coalesce(F.nanvl(_col(x).cast("double"), F.lit(value)), F.lit(value))


def nonzero(mask: Column | str) -> Column:
    """Indices, from 0, of the elements that are true."""
    m = _col(mask)
    return F.filter(F.transform(m, lambda x, i: F.when(x.cast("boolean"), i)), lambda i: i.isNotNull())


def cumulative(mask: Column | str) -> Column:
    """Running number of true elements."""
    m = _col(mask)
    return F.transform(m, lambda _, i: F.size(F.filter(F.slice(m, F.lit(1), i + 1), lambda x: x.cast("boolean"))))


def argsort(values: Column | str) -> Column:
    """Indices by ascending value, ties by index."""
    keyed = F.transform(_col(values), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    return F.transform(F.array_sort(keyed), lambda s: s["i"])


def argmax(values: Column | str) -> Column:
    """Index of the first maximum; NaN never wins, all NaN gives 0."""
    keyed = F.transform(_col(values), lambda x, i: F.struct(F.coalesce(F.nanvl(x.cast("double"), F.lit(float("-inf"))), F.lit(float("-inf"))).alias("x"), (-i).alias("i")))
    return -F.array_max(keyed)["i"]


def upsample_mask(mask: Column | str, n: int, threshold: float = 0.5) -> Column:
    """Nearest-neighbour stretch of a mask to n elements, thresholded."""
    m = _col(mask)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.element_at(m, F.floor(j * F.size(m) / F.lit(n)).cast("int") + 1).cast("double") > threshold)


def gather_padded(samples: Column | str, mask: Column | str) -> Column:
    """Samples where the mask holds, packed to the left, then zeros to the mask's length."""
    s, m = _col(samples), _col(mask)
    kept = F.filter(F.zip_with(s, m, lambda x, k: F.struct(x.cast("double").alias("x"), k.alias("k"))), lambda e: e["k"])
    return F.concat(F.transform(kept, lambda e: e["x"]), F.array_repeat(F.lit(0.0), F.greatest(F.size(m) - F.size(kept), F.lit(0))))


def crop_padded(samples: Column | str, first: Column | str, n: int) -> Column:
    """n elements from index first, zeros outside."""
    s, f = _col(samples), _col(first)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.coalesce(F.when((f + k >= 0) & (f + k < F.size(s)), F.get(s, (f + k).cast("int")).cast("double")), F.lit(0.0)))


def scale_pcm(samples: Column | str, bits: int = 16) -> Column:
    """Whole samples of a bit depth to [-1, 1)."""
    return F.transform(_col(samples), lambda x: x.cast("double") / float(1 << (bits - 1)))


def split_text(text: Column | str, delimiter: str) -> Column:
    """Parts between a literal delimiter, empty ones too."""
    return F.split(_col(text), "\\Q" + delimiter.replace("\\E", "\\E\\\\E\\Q") + "\\E", -1)


def parse_row(text: Column | str) -> Column:
    """A dumped line, comma after every value, to doubles."""
    parts = F.filter(split_text(text, ","), lambda x: F.trim(x) != "")
    return F.transform(parts, lambda x: F.when(F.lower(F.trim(x)) == "true", 1.0).when(F.lower(F.trim(x)) == "false", 0.0).otherwise(F.trim(x).cast("double")))


def number_text(x: Column | str) -> Column:
    """A dumped value: nan, 0.0 and 1.0 in full, else six significant digits."""
    v = _col(x)
    return F.when(v.isNull() | F.isnan(v), "nan").when(v == 0, "0.0").when(v == 1, "1.0").otherwise(F.format_string("%.6g", v))


def min_cluster_size(n: Column | str, most: int = 15) -> Column:
    """A tenth of n, halves to even, from 1 to most."""
    return F.least(F.lit(most), F.greatest(F.lit(1), F.rint(F.lit(0.1) * _col(n)).cast("int")))


def condensed_index(n: Column | str, i: Column | str, j: Column | str) -> Column:
    """Place of the pair i, j in the condensed distances of n points."""
    a, b = F.least(_col(i), _col(j)), F.greatest(_col(i), _col(j))
    return _col(n) * a - F.floor(a * (a + 1) / 2) + (b - a - 1)
