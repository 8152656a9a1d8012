"""Amounts as parts that add up exactly, in any order and under any partitioning.

* Doubles: a number is cut into ``LIMBS`` balanced digits of ``LIMB_BITS`` bits, from 2^``LOWEST`` up, each a long.
  Digits add up as longs; the total is put together once, by a compensated sum of the digits. From 2^-68 to 2^120
  (about 10^-20 to 10^36) no bit of a number is lost. What lies beyond is added as a double in a
  further column, so it is never dropped; only its last bits may depend on the order.
* Decimals of up to 18 digits: whole units and the rest, as longs, which costs far less than wide decimals.
* Other types are added as they are.

A digit is below 2^24, so 2^39 of them fit a long. ``tidied`` carries what is above into the next
digit after a first reduction, before amounts of cells are added further.
"""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import DataFrame

from tidemark.spec import MetricSpec

LIMB_BITS, LIMBS, LOWEST = 24, 10, -120
BEYOND = LOWEST + LIMB_BITS * LIMBS


def sum_alias(i: int) -> str:
    return f"_sum{i}"


def power(n: int) -> str:
    """2^n as a double literal."""
    return f"{2.0**n!r}D"


def exact_scale(spec: MetricSpec) -> int | None:
    """Scale of a decimal amount that is added up as two whole numbers; None for others."""
    found = re.fullmatch(r"decimal\((\d+),\s*(\d+)\)", spec.sum_type)
    if found and int(found.group(1)) <= 18 and int(found.group(2)) <= 6:
        return int(found.group(2))
    return None


def digits_of(name: str) -> list[str]:
    return [f"{name}_d{j}" for j in range(LIMBS)]


def part_names(spec: MetricSpec) -> list[str]:
    names = [sum_alias(i) for i in range(len(spec.sums))]
    if spec.sum_type == "double":
        return [part for n in names for part in (*digits_of(n), f"{n}_far")]
    return names if exact_scale(spec) is None else [f"{n}_{part}" for n in names for part in ("units", "rest")]


def double_parts(value: str, name: str) -> dict[str, str]:
    """The digits of a double expression, lowest first, and what no digit holds."""
    near = f"CASE WHEN abs({value}) < {power(BEYOND)} THEN {value} WHEN {value} IS NOT NULL THEN 0D END"
    lows = [f"rint({near} * {power(-(LOWEST + LIMB_BITS * j))})" for j in range(LIMBS)]
    parts = {d: f"cast({low} - {power(LIMB_BITS)} * {high} as bigint)" for d, low, high in zip(digits_of(name), lows, lows[1:])}
    parts[digits_of(name)[-1]] = f"cast({lows[-1]} as bigint)"
    parts[f"{name}_far"] = f"if(abs({value}) < {power(BEYOND)}, {value} - {lows[0]} * {power(LOWEST)}, {value})"
    return parts


def amount_parts(spec: MetricSpec) -> dict[str, str]:
    """Part name to SQL over the prepared amount columns."""
    if spec.sum_type == "double":
        return {k: v for i in range(len(spec.sums)) for k, v in double_parts(sum_alias(i), sum_alias(i)).items()}
    scale = exact_scale(spec)
    if scale is None:
        return {n: n for n in part_names(spec)}
    parts = {}
    for i in range(len(spec.sums)):
        digits = f"cast({sum_alias(i)} * {10**scale} AS bigint)"
        parts[f"{sum_alias(i)}_units"] = f"{digits} div {10**scale}"
        parts[f"{sum_alias(i)}_rest"] = f"{digits} % {10**scale}"
    return parts


def tidied(df: DataFrame, spec: MetricSpec) -> DataFrame:
    """Added digits brought below 2^25 again; the same totals."""
    if spec.sum_type != "double":
        return df
    half = 1 << (LIMB_BITS - 1)
    changed = {}
    for i in range(len(spec.sums)):
        names = digits_of(sum_alias(i))
        over = [f"shiftright({d} + {half}L, {LIMB_BITS})" for d in names]
        for j, d in enumerate(names):
            own = d if j == LIMBS - 1 else f"{d} - shiftleft({over[j]}, {LIMB_BITS})"
            changed[d] = own if j == 0 else f"{own} + {over[j - 1]}"
    for _ in range(2):
        df = df.selectExpr(*[f"{changed[c]} AS {c}" if c in changed else f"`{c}`" for c in df.columns])
    return df


def double_total(name: str) -> str:
    """The double next to the exact sum of digits and rest (a compensated sum from the highest digit down)."""
    terms = [f"{d} * {power(LOWEST + LIMB_BITS * j)}" for j, d in enumerate(digits_of(name))][::-1]
    up, back = "(a.s + t)", "((a.s + t) - a.s)"
    step = f"(a, t) -> named_struct('s', a.s + t, 'e', a.e + ((a.s - ({up} - {back})) + (t - {back})))"
    finish = "a -> if(abs(a.s) < double('Infinity'), a.s + a.e, a.s)"
    return f"aggregate(array({name}_far, {', '.join(terms)}), named_struct('s', 0D, 'e', 0D), {step}, {finish})"


def totals(spec: MetricSpec) -> dict[str, str]:
    """Output name to SQL over added parts; decimals come out as ``decimal(38, scale)``."""
    scale, out = exact_scale(spec), {}
    for i, name in enumerate(spec.sums.values()):
        own = sum_alias(i)
        if spec.sum_type == "double":
            out[name] = f"coalesce({double_total(own)}, 0D)"
        elif scale is not None:
            kind, last_place = f"decimal(38,{scale})", f"{Decimal(1).scaleb(-scale):f}"
            out[name] = f"coalesce(cast(cast({own}_units AS {kind}) + {own}_rest * {last_place} AS {kind}), 0)"
        else:
            out[name] = f"coalesce({own}, 0)"
    return out
