"""Column expressions on array-valued tiles: per-frame statistics without exploding or shuffling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MAD_TO_SIGMA = 1.4826


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a lambda variable.

    Writing the same array expression several times would evaluate it several times, and inside
    a lambda once per element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def doubles(tile: Column) -> Column:
    return tile.cast("array<double>")


def _median_sorted(s: Column) -> Column:
    n = F.size(s)
    lo = F.floor((n - 1) / 2).cast("int")
    hi = F.floor(n / 2).cast("int")
    return F.when(n > 0, (F.get(s, lo) + F.get(s, hi)) / 2)


def median_of(arr: Column) -> Column:
    """Median of an array (mean of the middle two, null when empty)."""
    return let(F.sort_array(arr), _median_sorted)


def quantile_at(s: Column, p: float) -> Column:
    """Linear-interpolation quantile of a sorted array (null when empty)."""
    h = (F.size(s) - 1) * F.lit(float(p))
    a, b = F.get(s, F.floor(h).cast("int")), F.get(s, F.ceil(h).cast("int"))
    return F.when(F.size(s) > 0, a + (b - a) * (h - F.floor(h)))


def quantile_of(arr: Column, p: float) -> Column:
    """Linear-interpolation quantile of an array (null when empty)."""
    return let(F.sort_array(arr), lambda s: quantile_at(s, p))


def mad_of(arr: Column) -> Column:
    """Median absolute deviation of an array."""
    return let(arr, lambda a: let(median_of(a), lambda m: median_of(F.transform(a, lambda v: F.abs(v - m)))))


def sigma_of(arr: Column) -> Column:
    return mad_of(arr) * MAD_TO_SIGMA


def mean_of(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, v: a + v) / F.size(arr)


def spread_of(arr: Column) -> Column:
    """Population standard deviation of an array (null when empty)."""
    around = lambda a: let(mean_of(a), lambda m: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + (v - m) * (v - m)) / F.size(a)))
    return let(arr, lambda a: F.when(F.size(a) > 0, around(a)))


def correlation_of(a: Column, b: Column) -> Column:
    """Pearson correlation of two arrays of one size; null when one of them is constant."""

    def around(m: Column) -> Column:
        pairs = F.zip_with(a, b, lambda x, y: F.struct((x - m["a"]).alias("x"), (y - m["b"]).alias("y")))
        total = lambda p, u, v: F.aggregate(p, F.lit(0.0), lambda s, z: s + z[u] * z[v]).alias(u + v)
        sums = let(pairs, lambda p: F.struct(total(p, "x", "x"), total(p, "x", "y"), total(p, "y", "y")))
        return let(sums, lambda s: s["xy"] / F.nullif(F.sqrt(s["xx"] * s["yy"]), F.lit(0.0)))

    return let(F.struct(mean_of(a).alias("a"), mean_of(b).alias("b")), around)


def indices(n: Column) -> Column:
    """0 .. n - 1 for n of at least 1."""
    return F.sequence(F.lit(0), (n - 1).cast("int"))


def _div(a: Column, by: int) -> Column:
    return F.floor(a / by).cast("int")


def square_around(tile: Column, width: int, k: Column, h: int) -> Column:
    """Values in the (2h+1)^2 square around pixel ``k``, as far as it lies inside the tile."""
    x = k % width
    cells = []
    for dy in range(-h, h + 1):
        for dx in range(-h, h + 1):
            v = F.get(tile, (k + (dy * width + dx)).cast("int"))  # above and below the tile there is no element
            cells.append(v if dx == 0 else F.when((x + dx >= 0) & (x + dx < width), v))
    return F.array_compact(F.array(*cells))


def n_blocks(tile: Column, width: int, b: int) -> Column:
    return _div(F.size(tile) + width * b - 1, width * b) * -(-width // b)


def block_at(tile: Column, width: int, b: int, k: Column) -> Column:
    """Values of the k-th b x b block, row by row; blocks at the right and lower edge may be smaller."""
    across = -(-width // b)
    y0, x0 = _div(k, across) * b, (k % across) * b

    def cell(i: Column) -> Column:
        v = F.get(tile, ((y0 + _div(i, b)) * width + x0 + i % b).cast("int"))
        return v if width % b == 0 else F.when(x0 + i % b < width, v)

    return F.array_compact(F.transform(indices(F.lit(b * b)), cell))


def rectangle(tile: Column, width: int, y0: int, x0: int, height: int, across: int) -> Column:
    """Values of a rectangle that lies inside the tile."""
    return F.transform(indices(F.lit(height * across)), lambda i: F.get(tile, ((y0 + _div(i, across)) * width + x0 + i % across).cast("int")))
