"""Random numbers by counting: a draw depends on its keys alone, not on partitions, order or engine; each function has its DuckDB SQL."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_MASK = (1 << 32) - 1
#: Shifts and odd multipliers below 2**31 of a 32-bit mixing function, so that products stay within signed 64 bits.
_ROUNDS = [(16, 0x21F0AAAD), (15, 0x735A2D97), (15, 1)]
_PACKED = [s << 32 | m for s, m in _ROUNDS]
_START, _STEP = 0x1234567, 0x3C6EF372


def mix(x: Column) -> Column:
    """A bijection of 32-bit numbers that spreads every bit."""
    rounds = F.array(*[F.lit(r) for r in _PACKED])
    return F.aggregate(rounds, x.cast("long"), lambda h, r: (h.bitwiseXOR(F.call_function("shiftrightunsigned", h, F.shiftright(r, 32).cast("int"))) * r.bitwiseAND(_MASK)).bitwiseAND(_MASK))


def bits(*keys: Column) -> Column:
    """32 bits that depend on all keys and their order; keys are integers."""
    h = F.lit(_START).cast("long")
    for k in keys:
        k = k.cast("long")
        h = mix(h.bitwiseXOR(mix((k.bitwiseXOR(F.shiftright(k, 32)) + _STEP).bitwiseAND(_MASK))))
    return h


def extended(h: Column, key: int) -> Column:
    """``bits`` of the keys whose bits are ``h`` and one fixed number more."""
    return mix(h.bitwiseXOR(F.lit(_inner(key))))


def normals(first: Column, keys: Sequence[int]) -> Column:
    """An array: for each of the fixed keys, ``normal`` of the keys whose bits are ``first`` and that one.

    What the draws have in common is mixed once, and the fixed keys are mixed beforehand.
    """
    inner = F.array(*[F.lit(_inner(k)) for k in keys])
    each = F.flatten(F.transform(F.array(first), lambda f: F.transform(inner, lambda k: mix(f.bitwiseXOR(k)))))  # a lambda's argument is computed once
    return F.transform(each, lambda h: _normal((extended(h, 0) + 0.5) / 2.0**32, (extended(h, 1) + 0.5) / 2.0**32))


def uniform(*keys: Column) -> Column:
    """A number in (0, 1)."""
    return (bits(*keys) + 0.5) / 2.0**32


def below(n: Column, *keys: Column) -> Column:
    """An integer from 0 to n - 1, for n below 2**31; no value is likelier than another by more than n / 2**32."""
    return F.shiftright(bits(*keys) * n, 32)


def normal(*keys: Column) -> Column:
    """A draw of the standard normal distribution."""
    return _normal(uniform(*keys, F.lit(0)), uniform(*keys, F.lit(1)))


def _normal(u: Column, v: Column) -> Column:
    return F.sqrt(-2 * F.ln(u)) * F.cos(2 * math.pi * v)


def mix_sql(x: str) -> str:
    return f"list_reduce([({x})::BIGINT, {', '.join(map(str, _PACKED))}], lambda h, r: (xor(h, h >> (r >> 32)) * (r & {_MASK})) & {_MASK})"


def bits_sql(*keys: str) -> str:
    h = str(_START)
    for k in keys:
        inner = mix_sql(f"(xor(({k})::BIGINT, ({k})::BIGINT >> 32) + {_STEP}) & {_MASK}")
        h = mix_sql(f"xor({h}::BIGINT, {inner})")
    return h


def below_sql(n: str, *keys: str) -> str:
    return f"(({bits_sql(*keys)} * {n}) >> 32)"


def normal_sql(*keys: str) -> str:
    u, v = (f"(({bits_sql(*keys, str(i))} + 0.5::DOUBLE) / 4294967296)" for i in (0, 1))
    return f"(sqrt(-2 * ln({u})) * cos(2 * pi() * {v}))"


def _mixed(h: int) -> int:
    for shift, by in _ROUNDS:
        h = ((h ^ h >> shift) * by) & _MASK
    return h


def _inner(key: int) -> int:
    return _mixed((key ^ key >> 32) + _STEP & _MASK)


def python_bits(keys: Sequence[int]) -> int:
    """``bits`` of plain integers."""
    h = _START
    for k in keys:
        h = _mixed(h ^ _inner(k))
    return h
