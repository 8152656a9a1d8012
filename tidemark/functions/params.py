"""Expressions over an event's ``params`` map and its ids."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labels, codes and patterns that results must carry.
YES, NO = "是", "否"
HOME_COUNTRY = 10184
HOME_AREA, OTHER_AREA = "China", "Overseas"
SCM_END = "$$$"
MODULE_OF_LEVEL1: Mapping[str, str] = {
    "相机": "camera",
    "图片美化": "mh",
    "美化": "mh",
    "人像美容": "mr",
    "美容": "mr",
    "视频剪辑": "spmh",
    "视频美容": "spmr",
    "首页垂类": "homeicon",
    "拼图": "pt",
}
GATED_EVENTS = ("tool_material_show", "tool_material_click", "tool_material_yes")
GATE_PARAM = "一级ID"
GATE_VALUES: Mapping[str, tuple[str, ...]] = {
    "camera": ("04",),
    "mh": ("01",),
    "mr": ("02",),
    "spmh": ("05",),
    "spmr": ("05",),
    "pt": ("03", "01"),
}


@dataclass(frozen=True)
class Alias:
    """Rename an event when a param has one of the values, or when it came before a day."""

    event_id: str
    new_id: str
    param: str | None = None
    values: Sequence[str] = ()
    before: dt.date | None = None


# Renames in the order they are tried.
DEFAULT_ALIASES = (
    Alias("mhmr_homesave", "mr_homesave", "source_type", ("mr", "sharephoto")),
    Alias("mhmr_homesave", "mh_homesave", "source_type", ("mh", "batch")),
    Alias("blend_tab_click", "blend_tab_click_", before=dt.date(2025, 5, 9)),
)


def _col(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def param(params: Column | str, key: str) -> Column:
    """A param's value; null when absent."""
    return F.try_element_at(_col(params), F.lit(key))


def local_day(millis: Column | str, zone: str) -> Column:
    """Calendar day of an epoch-millisecond stamp in a named zone, whatever the session zone."""
    whole = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), (_col(millis) / 1000).cast("decimal(18,6)")
    )
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), whole).cast("date")


def alias_event(
    event_id: Column | str,
    params: Column | str,
    aliases: Sequence[Alias] = DEFAULT_ALIASES,
    day: Column | str | None = None,
) -> Column:
    """The event's id after renaming; the first alias that applies wins."""
    source = _col(event_id)
    renamed = None
    for a in aliases:
        applies = source == a.event_id
        if a.param is not None:
            applies = applies & param(params, a.param).isin(*a.values)
        if a.before is not None:
            if day is None:
                raise ValueError(f"alias of {a.event_id} needs the event's day")
            applies = applies & (_col(day) < F.lit(a.before))
        renamed = F.when(applies, a.new_id) if renamed is None else renamed.when(applies, a.new_id)
    return source if renamed is None else renamed.otherwise(source)


def gate_passes(
    event_id: Column | str,
    params: Column | str,
    ids: Sequence[str] = GATED_EVENTS,
    key: str = GATE_PARAM,
    values: Sequence[str] | None = None,
) -> Column:
    """Listed events pass only with a listed param value; an absent param fails.

    Without ``values`` everything passes.
    """
    if values is None:
        return F.lit(True)
    return ~_col(event_id).isin(*ids) | F.coalesce(param(params, key).isin(*values), F.lit(False))


def fingerprint(columns: Sequence[Column | str], compat: bool = False, null_token: str = "\\N") -> Column:
    """MD5 over the ``#``-joined fields.

    ``compat=True`` skips nulls as the joined text of existing tables does, so a null can
    shift fields and two records can collide; the default writes a token for a null.
    """
    texts = [_col(c).cast("string") for c in columns]
    if not compat:
        texts = [F.coalesce(t, F.lit(null_token)) for t in texts]
    return F.md5(F.concat_ws("#", *texts))


def params_json(params: Column | str) -> Column:
    """Params as JSON text with sorted keys, so equal maps give equal fingerprints."""
    entries = F.array_sort(F.map_entries(_col(params)))
    return F.to_json(F.map_from_entries(entries))


def cut_scm(scm: Column | str) -> Column:
    """The part of an scm value before its end mark."""
    return F.substring_index(_col(scm), SCM_END, 1)


def blank_to_null(col: Column | str) -> Column:
    """An empty level becomes null."""
    return F.nullif(_col(col), F.lit(""))


def depth_of(levels: Sequence[str]) -> Column:
    """How many levels are filled in."""
    total = F.lit(0)
    for level in levels:
        total = total + F.when(F.length(_col(level)) == 0, 0).otherwise(1)
    return total


def module_of(level1: Column | str, mapping: Mapping[str, str] = MODULE_OF_LEVEL1) -> Column:
    """Module code of a first level; null when it has none."""
    out = None
    for name, code in mapping.items():
        hit = _col(level1) == name
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return out if out is not None else F.lit(None).cast("string")


def area_of(country: Column | str, home: int = HOME_COUNTRY) -> Column:
    """The home country or none given is one area, all else the other."""
    country = _col(country)
    return F.when(country.isNull() | (country == home), HOME_AREA).otherwise(OTHER_AREA)


def first_number(text: Column | str) -> Column:
    """The number before the first ``.`` or ``&``; null when there is none."""
    return F.regexp_extract(_col(text), r"^([^.&]*)", 1).try_cast("bigint")


def explode_ids(df: DataFrame, column: str, out: str) -> DataFrame:
    """One row per id of a list text such as ``[a;b,c]``; a null list gives none."""
    listed = F.regexp_replace(F.replace(F.col(column), F.lit(";"), F.lit(",")), r"[\[\]]", "")
    return df.withColumn(out, F.explode(F.split(listed, ","))).filter(F.col(out).isNotNull())
