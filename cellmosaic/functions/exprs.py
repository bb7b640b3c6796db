"""Column expressions that carry the library's numeric conventions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, functions as F

# Fixed values of the scoring rules.
MIN_CELLS = 50
COMPOSITES = {"TC": (1, 3), "WT": (1, 2, 3)}
CLASS_NAMES = {1: "NETC", 2: "SNFH", 3: "ET", 4: "RC"}

ColumnLike = str | Column


def as_column(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def finite(value: ColumnLike) -> Column:
    """The value as a double, with NaN and both infinities turned into NULL."""
    x = as_column(value).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def dice(pred_size: ColumnLike, ref_size: ColumnLike, shared: ColumnLike) -> Column:
    """Overlap ratio; both sides empty is a correct absence (1), one side empty is 0."""
    p, r, s = (F.coalesce(as_column(c).cast("double"), F.lit(0.0)) for c in (pred_size, ref_size, shared))
    return (
        F.when((p == 0) & (r == 0), F.lit(1.0))
        .when((p == 0) | (r == 0), F.lit(0.0))
        .otherwise(2.0 * s / (p + r))
    )


def half_even(value: ColumnLike) -> Column:
    """Nearest integer with ties to even."""
    return F.bround(as_column(value), 0).cast("int")


def seeded_key(seed: int, *columns: ColumnLike) -> Column:
    """A reproducible pseudo-random sort key: the md5 of the columns and the seed."""
    parts = [as_column(c).cast("string") for c in columns]
    return F.md5(F.concat_ws(":", *parts, F.lit(str(seed))))


def break_even(gain_if_kept: ColumnLike, dice_if_real: ColumnLike) -> Column:
    """Posterior at which keeping a marginal region neither gains nor costs: L / (L + d)."""
    big, small = as_column(gain_if_kept), as_column(dice_if_real)
    return big / (big + small)


def entity_of(case_id: ColumnLike) -> Column:
    """Case id without its last ``-part``."""
    return F.regexp_replace(as_column(case_id), "-[^-]*$", "")


def targets_of(value: ColumnLike, targets: Mapping[str, Iterable[int]]) -> Column:
    """Array of the target names whose value set contains ``value``."""
    v = as_column(value)
    hits = [F.when(v.isin([int(x) for x in values]), F.lit(name)) for name, values in targets.items()]
    return F.array_compact(F.array(*hits))


def default_targets(class_names: Mapping[int, str] = CLASS_NAMES) -> dict[str, tuple[int, ...]]:
    """Every class on its own, plus the composites when classes 1, 2 and 3 all exist."""
    out = {name: (value,) for value, name in class_names.items() if value != 0}
    if {1, 2, 3} <= set(class_names):
        out.update(COMPOSITES)
    return out


def cosine(a: ColumnLike, b: ColumnLike) -> Column:
    """Dot product of two arrays; the inputs are expected to be centred unit vectors."""
    products = F.zip_with(as_column(a), as_column(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def struct_max(value: ColumnLike, *tiebreak: Column, fields: Sequence[ColumnLike]) -> Column:
    """Aggregate: the fields of the row with the largest value, ties by ascending tiebreak."""
    entries = [as_column(value).alias("_v")]
    entries += [(-t).alias(f"_t{n}") for n, t in enumerate(tiebreak)]
    entries += [as_column(f) for f in fields]
    return F.max(F.struct(*entries))
