"""Published hexagonal cell ids, decoded by their bit fields.

An id is the lower-case hexadecimal form of 64 bits: a zero, four bits of mode (1 for cells), three zeros, four bits of resolution,
seven of base cell, then fifteen digits of three bits each. Digits beyond the resolution are 7, the others 0 to 6. Twelve
base cells are pentagons, where the first digit that isn't 0 is never 1. Everything is shifts and masks on one long, no step for each digit.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the published layout.
PENTAGONS = (4, 14, 24, 38, 49, 58, 63, 72, 83, 97, 107, 117)
BASE_CELLS, FINEST = 122, 15
FAULTS = ("not_canonical", "mode", "base_cell", "digits", "pentagon", "resolution")
#: The lowest bit of each digit.
LOWEST = sum(1 << 3 * i for i in range(FINEST))


def bits(cell: Column) -> Column:
    """The id as a long; null unless it is in canonical form and below 2 ** 60, as all cells are."""
    return F.when(cell.rlike(r"\A[1-9a-f][0-9a-f]{0,14}\z"), F.conv(cell, 16, 10).cast("long"))


def resolution(value: Column) -> Column:
    return (F.shiftright(value, 52).bitwiseAND(F.lit(15))).cast("int")


def base_cell(value: Column) -> Column:
    return (F.shiftright(value, 45).bitwiseAND(F.lit(127))).cast("int")


def _shifted(name: str, value: Column, by: Column) -> Column:
    return F.call_function(name, value, by.cast("int"))


def _ones(count: Column) -> Column:
    """So many one bits."""
    return _shifted("shiftleft", F.lit(1).cast("long"), count) - F.lit(1)


def digits(value: Column) -> Column:
    """The digits within the resolution as one long, the coarsest in the highest bits."""
    r = resolution(value)
    return _shifted("shiftright", value, 3 * (F.lit(FINEST) - r)).bitwiseAND(_ones(3 * r))


def fault(cell: Column, wanted: Column | int | None = None) -> Column:
    """Why a text is no valid cell id (of the wanted resolution), else null; the first of FAULTS counts. Null isn't canonical."""
    value = bits(cell)
    r, d = resolution(value), digits(value)
    unused = _ones(3 * (F.lit(FINEST) - r))
    seven = d.bitwiseAND(F.shiftright(d, 1)).bitwiseAND(F.shiftright(d, 2)).bitwiseAND(F.lit(LOWEST).cast("long"))
    top = F.floor((F.length(F.bin(d)) - 1) / 3)  # the place of the first digit that isn't 0
    leading = _shifted("shiftright", d, 3 * top)
    canonical = cell.rlike(r"\A[1-9a-f][0-9a-f]{0,15}\z")
    out = (
        F.when(~F.coalesce(canonical, F.lit(False)), F.lit("not_canonical"))
        .when(value.isNull() | (F.shiftright(value, 56) != 8), F.lit("mode"))
        .when(base_cell(value) >= BASE_CELLS, F.lit("base_cell"))
        .when((seven != 0) | (value.bitwiseAND(unused) != unused), F.lit("digits"))
        .when(base_cell(value).isin(*PENTAGONS) & (leading == 1), F.lit("pentagon"))
    )
    if wanted is None:
        return out
    return out.when(r != (F.lit(wanted) if isinstance(wanted, int) else wanted), F.lit("resolution"))


def parent(value: Column, coarser: Column) -> Column:
    """The id, as a long, of the ancestor at a coarser (or the same) resolution; null where it would be finer."""
    kept = value.bitwiseAND(F.lit(~(15 << 52)))
    filled = kept.bitwiseOR(_shifted("shiftleft", coarser.cast("long"), F.lit(52))).bitwiseOR(_ones(3 * (F.lit(FINEST) - coarser)))
    return F.when((coarser >= 0) & (coarser <= resolution(value)), filled)


def text(value: Column) -> Column:
    return F.lower(F.hex(value))


def fault_of(cell: str, wanted: int) -> str | None:
    """The same for one id on the driver, where a tile's few cells are checked."""
    if not cell or cell[0] == "0" or len(cell) > 16 or set(cell) - set("0123456789abcdef"):
        return "not_canonical"
    value = int(cell, 16)
    r, own = value >> 52 & 15, [value >> 3 * (FINEST - i) & 7 for i in range(1, FINEST + 1)]
    if value >> 56 != 8:
        return "mode"
    if value >> 45 & 127 >= BASE_CELLS:
        return "base_cell"
    if 7 in own[:r] or set(own[r:]) - {7}:
        return "digits"
    if value >> 45 & 127 in PENTAGONS and next((d for d in own[:r] if d), 0) == 1:
        return "pentagon"
    return None if r == wanted else "resolution"
