"""168-bit week masks: an array of seven ints, Monday first, bit h of a day for hour h."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_LENGTH = 42


def empty_mask() -> Column:
    return F.array_repeat(F.lit(0), 7)


def set_hour(mask: Column, day: Column, hour: Column) -> Column:
    """``mask`` with one more hour."""
    bit = F.call_function("shiftleft", F.lit(1), hour.cast("int"))
    return F.transform(mask, lambda x, i: F.when(i == day, x.bitwiseOR(bit)).otherwise(x))


def is_active(mask: Column, day: Column, hour: Column) -> Column:
    """Whether the hour is in the mask; null for a null mask."""
    return F.call_function("shiftright", F.element_at(mask, day.cast("int") + 1), hour.cast("int")).bitwiseAND(F.lit(1)) == 1


def mask_or(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseOR(y))


def mask_and(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))


def is_empty(mask: Column) -> Column:
    return F.forall(mask, lambda x: x == 0)


def explains(whole: Column, part: Column) -> Column:
    """Whether every hour of ``part`` is in ``whole``."""
    return F.forall(F.arrays_zip(whole.alias("a"), part.alias("b")), lambda x: x["a"].bitwiseOR(x["b"]) == x["a"])


def to_hex(mask: Column) -> Column:
    """Seven groups of six lower-case hex digits."""
    return F.array_join(F.transform(mask, lambda x: F.lower(F.lpad(F.hex(x), 6, "0"))), "")


def from_hex(text: Column) -> Column:
    """The mask of 42 hex digits; null for anything else."""
    groups = F.transform(
        F.sequence(F.lit(0), F.lit(6)), lambda i: F.conv(F.substring(text, i * 6 + 1, F.lit(6)), 16, 10).cast("int")
    )
    return F.when(text.rlike("^[0-9A-Fa-f]{42}$"), groups)


def collect_mask(day: Column, hour: Column) -> Column:
    """Aggregate: the mask of all (day, hour) rows of a group."""
    bit = F.call_function("shiftleft", F.lit(1), hour.cast("int"))
    return F.array(*[F.coalesce(F.bit_or(F.when(day == d, bit)), F.lit(0)) for d in range(7)])


def merge_masks(mask: Column) -> Column:
    """Aggregate: the union of the masks of a group."""
    return F.array(*[F.coalesce(F.bit_or(F.element_at(mask, d + 1)), F.lit(0)) for d in range(7)])


def common_mask(mask: Column) -> Column:
    """Aggregate: the hours that all masks of a group have."""
    return F.array(*[F.coalesce(F.bit_and(F.element_at(mask, d + 1)), F.lit(0)) for d in range(7)])


def merge_mask_maps(a: Column, b: Column) -> Column:
    """Union of two maps from route to mask, masks of shared routes united."""
    return F.map_zip_with(a, b, lambda _, x, y: F.when(x.isNull(), y).when(y.isNull(), x).otherwise(mask_or(x, y)))


def cell_count(cells: Column) -> Column:
    """Active cells of an array of booleans."""
    return F.size(F.filter(cells, lambda x: x))


def first_cell(cells: Column) -> Column:
    """Index of the first active cell, or the number of cells."""
    at = F.array_position(cells, F.lit(True))
    return F.when(at > 0, at - 1).otherwise(F.size(cells)).cast("int")


def masks_of_cells(cells: Column) -> Column:
    """The mask of 168 booleans."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(6)),
        lambda d: F.aggregate(
            F.sequence(F.lit(0), F.lit(23)),
            F.lit(0),
            lambda acc, h: F.when(F.element_at(cells, d * 24 + h + 1), acc.bitwiseOR(F.call_function("shiftleft", F.lit(1), h))).otherwise(acc),
        ),
    )
