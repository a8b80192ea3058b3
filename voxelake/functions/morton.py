"""Morton codes as BIGINT columns.

A code of level L is a 1 above 3 * L interleaved bits (x lowest), so the root is 1 and codes of different
levels never collide.  Indices wider than the level are masked.  Level 21 uses the sign bit: its codes are equal, shift and
join as others do, and `sort_key` puts codes of any levels in their unsigned order (up to CROSS_LEVEL_MAX signed order is code order).
All functions take and give Columns and stay inside code generation, apart from those that make arrays.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHALLOW_MAX, MEDIUM_MAX, CROSS_LEVEL_MAX = 10, 21, 20
#: (shift, mask) of each step that spreads 10 bits to every third place.
_SPREAD = ((16, 0x030000FF), (8, 0x0300F00F), (4, 0x030C30C3), (2, 0x09249249))


def _long(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v).cast("long")


def _spread10(v: Column) -> Column:
    # a product with 1 + 2^shift is v | v << shift here, and refers to v once, which keeps expressions small
    for shift, mask in _SPREAD:
        v = (v * F.lit(1 + (1 << shift)).cast("long")).bitwiseAND(F.lit(mask).cast("long"))
    return v


def _compact10(v: Column) -> Column:
    v = v.bitwiseAND(F.lit(_SPREAD[-1][1]).cast("long"))
    masks = [m for _, m in reversed(_SPREAD)][1:] + [0x3FF]
    for (shift, _), mask in zip(reversed(_SPREAD), masks):
        v = F.shiftright(v * F.lit(1 + (1 << shift)).cast("long"), shift).bitwiseAND(F.lit(mask).cast("long"))
    return v


def _low(v: Column, bits: int) -> Column:
    return v.bitwiseAND(F.lit((1 << bits) - 1).cast("long"))


def spread3(v: Column, bits: int = MEDIUM_MAX) -> Column:
    """The low `bits` (at most 21) bits of v, each moved to three times its place."""
    v = v.cast("long")
    out = _spread10(_low(v, min(bits, 10)))
    if bits > 10:
        out = out.bitwiseOR(F.shiftleft(_spread10(_low(F.shiftright(v, 10), min(bits - 10, 10))), 30))
    if bits > 20:
        out = out.bitwiseOR(F.shiftleft(_low(F.shiftright(v, 20), 1), 60))
    return out


def compact3(v: Column, bits: int = MEDIUM_MAX) -> Column:
    """The inverse of spread3; other bits of v are ignored."""
    out = _compact10(_low(v, 30))
    if bits > 10:
        out = out.bitwiseOR(F.shiftleft(_compact10(_low(F.shiftrightunsigned(v, 30), 30)), 10))
    if bits > 20:
        out = out.bitwiseOR(F.shiftleft(_low(F.shiftrightunsigned(v, 60), 1), 20))
    return out


def encode(x: Column, y: Column, z: Column, level: int) -> Column:
    if not 0 <= level <= MEDIUM_MAX:
        raise ValueError(f"level {level} is not in 0..{MEDIUM_MAX}")
    if level == 0:
        return F.lit(1).cast("long")
    bits = spread3(x, level).bitwiseOR(F.shiftleft(spread3(y, level), 1)).bitwiseOR(F.shiftleft(spread3(z, level), 2))
    one = 1 << 3 * level
    return bits.bitwiseOR(F.lit(one if one < 1 << 63 else -(1 << 63)).cast("long"))


def level_of(code: Column) -> Column:
    return F.floor((F.length(F.bin(code)) - 1) / 3).cast("int")


def decode(code: Column, level: int | Column | None = None, bits_most: int = MEDIUM_MAX) -> Column:
    """Struct x, y, z of a code of the given level, or of its own; bits_most: a bound of a level column."""
    bits, n = code, bits_most
    if isinstance(level, Column):
        bits = code - F.call_function("shiftleft", F.lit(1).cast("long"), (level * 3).cast("int"))
    elif level is None:
        at = level_of(code)
        bits = code.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), at * 3)))
    else:
        n = level
        bits = code.bitwiseAND(F.lit((1 << 3 * level) - 1).cast("long"))
    return F.struct(*[compact3(F.shiftrightunsigned(bits, k) if k else bits, n).alias(a) for k, a in enumerate("xyz")])


def parent(code: Column) -> Column:
    """Null for the root."""
    return F.when(code != 1, F.shiftrightunsigned(code, 3))


def children(code: Column) -> Column:
    """The eight children; an empty array where they would not fit."""
    full = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long")), lambda i: F.shiftleft(code, 3).bitwiseOR(i))
    return F.when((code > 0) & (code < F.lit(1 << 61)), full).otherwise(F.array().cast("array<bigint>"))


def ancestor(code: Column, own_level, level) -> Column:
    """The ancestor at `level` of a code of `own_level`; both ints or Columns."""
    if isinstance(own_level, int) and isinstance(level, int):
        return F.shiftrightunsigned(code, 3 * (own_level - level))
    return F.call_function("shiftrightunsigned", code, ((_long(own_level) - _long(level)) * 3).cast("int"))


def ancestors(code: Column, own_level: int, first: int = 0) -> Column:
    """The code's own and all ancestors' codes from level `first` on, as an array."""
    return F.array(*[ancestor(code, own_level, lv) for lv in range(first, own_level + 1)])


def first_descendant(code: Column, down: int) -> Column:
    return F.shiftleft(code, 3 * down)


def last_descendant(code: Column, down: int) -> Column:
    return F.shiftleft(code + 1, 3 * down) - 1


def first_child(code: Column) -> Column:
    return first_descendant(code, 1)


def last_child(code: Column) -> Column:
    return F.shiftleft(code, 3).bitwiseOR(F.lit(7))


def child_interval(code: Column) -> Column:
    return F.struct(first_child(code).alias("a"), last_child(code).alias("b"))


def child_index(code: Column) -> Column:
    return code.bitwiseAND(F.lit(7)).cast("int")


def is_child_of(code: Column, other: Column) -> Column:
    return F.shiftrightunsigned(code, 3) == other


def is_descendant_of(code: Column, other: Column) -> Column:
    """True for the code itself; false if it is shallower than the other."""
    down = level_of(code) - level_of(other)
    return (down >= 0) & (F.call_function("shiftrightunsigned", code, F.greatest(down, F.lit(0)) * 3) == other)


def sort_key(code: Column) -> Column:
    """A BIGINT whose signed order is the unsigned order of codes, level 21 included; its own inverse."""
    return code.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


def previous(code: Column) -> Column:
    return code - 1


def following(code: Column) -> Column:
    return code + 1


def preorder(code: Column, deepest: int) -> tuple[Column, Column]:
    """Sort keys that put codes of mixed levels in depth-first order."""
    lv = level_of(code)
    return F.call_function("shiftleft", code, (F.lit(deepest) - lv) * 3), lv


def text_of(code: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(code)))


def path_to_root(code: Column) -> Column:
    """0x...->...->0x1"""
    lv = level_of(code)
    steps = F.transform(F.sequence(F.lit(0), lv), lambda up: F.concat(F.lit("0x"), F.lower(F.hex(F.call_function("shiftrightunsigned", code, up * 3)))))
    return F.array_join(steps, "->")


def level_first(level: int) -> int:
    return 1 << 3 * level


def level_last(level: int) -> int:
    return (1 << 3 * level + 1) - 1


def sql_encode(x: str, y: str, z: str, level: int) -> str:
    """DuckDB text of the same code, bit by bit."""
    bits = [f"((({v}) >> {b}) & 1) << {3 * b + k}" for b in range(level) for k, v in enumerate((x, y, z))]
    return "(" + " | ".join([f"({1 << 3 * level})::BIGINT", *(f"({b})" for b in bits)]) + ")"


def sql_encode_deep(x: str, y: str, z: str) -> str:
    """DuckDB text of level 21, as HUGEINT in the unsigned order."""
    bits = [f"(((({v}) >> {b}) & 1)::HUGEINT * {1 << 3 * b + k}::HUGEINT)" for b in range(21) for k, v in enumerate((x, y, z))]
    return f"({1 << 63}::HUGEINT + " + " + ".join(bits) + ")"


def sql_decode(code: str, axis: int, level: int) -> str:
    return "(" + " | ".join(f"(((({code}) >> {3 * b + axis}) & 1) << {b})" for b in range(level)) + ")"


def sql_level(code: str) -> str:
    return f"((length(bin({code})) - 1) // 3)::INTEGER"
