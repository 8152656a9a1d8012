"""Rule tables and their evaluation on events."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.params import NO, YES, blank_to_null, cut_scm, depth_of, module_of
from tidemark.functions.text import strip_space

# The rule table's columns, its words, and its patterns.
LEVELS = ("level1", "level2", "level3", "level4", "level5")
PARAM_COLUMNS = ("scm", "tab_id", "posi_id", "material_id")
RULE_COLUMNS = (
    "material_id",
    *LEVELS,
    "event_id",
    "record_type",
    "media_type",
    "sharephone",
    "second_icon",
    "deal_mode",
    "event_type",
    "camera_mode",
    "vip_func_id",
    "scm",
    "tab_id",
    "posi_id",
    "filter_condition",
)
IDENTITY = ("event_id", *LEVELS, "record_type", "media_type", "event_type")
NO_PARAMETER = "无参数"
MATERIAL_RECORD = "素材"
CAMERA_MODES = ("经典", "生图")
VERTICAL_SINCE = dt.date(2022, 10, 9)
EVENT_ID_PATTERN = r"^[a-zA-Z]([a-zA-Z]+_)*[&a-zA-Z]+$"
_NAME = r"@*\w*(?:[(（]*\d*\.\d*[一-龥]*[)）]*)*"
_ONE = rf"params\['({_NAME})'\]"
ONE_PARAM = rf"(?iU)^{_ONE}\s*$"
TWO_PARAMS = rf"(?iU)^nvl\(\s*{_ONE}\s*,\s*{_ONE}\s*\)\s*$"


def clean_rules(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rules, and rejected ones with the reason.

    Values are trimmed and curly quotes made straight. Full-width parentheses become
    plain ones where the text is evaluated (param columns but ``material_id``, and the
    condition); names keep theirs. A param column that reads no param says so.
    ``rule_no`` gives the order in which rules are tried.
    """
    missing = [c for c in (*RULE_COLUMNS, "rule_no") if c not in rules.columns]
    if missing:
        raise ValueError(f"rule columns missing: {missing}")
    cleaned = {}
    for c in RULE_COLUMNS:
        value = F.translate(strip_space(F.coalesce(c, F.lit(""))), "‘’", "''")
        if c in ("scm", "tab_id", "posi_id", "filter_condition"):
            value = F.translate(value, "（）", "()")
        if c in PARAM_COLUMNS:
            value = F.when(value.rlike(ONE_PARAM) | value.rlike(TWO_PARAMS), value).otherwise(NO_PARAMETER)
        cleaned[c] = value
    reason = F.when(F.col("level1") == "", "level1 is blank").when(
        ~F.col("event_id").rlike(EVENT_ID_PATTERN), "event_id is not a name"
    )
    checked = rules.withColumns(cleaned).withColumn("reason", reason)
    return checked.filter(F.col("reason").isNull()).drop("reason"), checked.filter(F.col("reason").isNotNull())


def rules_for(rules: DataFrame, material: bool, level1: str | None = None) -> DataFrame:
    """The rules of one job: material or behaviour records, of one first level or all."""
    kind = F.col("record_type") == MATERIAL_RECORD
    chosen = rules.filter(kind if material else ~kind).filter(F.length(F.trim("level1")) > 1)
    return chosen if level1 is None else chosen.filter(F.col("level1") == level1)


def param_keys(text: Column | str) -> Column:
    """The one or two param names a rule column reads, in the order they are tried."""
    text = F.col(text) if isinstance(text, str) else text
    one = F.regexp_extract(text, ONE_PARAM, 1)
    two = [F.regexp_extract(text, TWO_PARAMS, i) for i in (1, 2)]
    return (
        F.when(text.rlike(TWO_PARAMS), F.array(*two))
        .when(text.rlike(ONE_PARAM), F.array(one))
        .otherwise(F.array().cast("array<string>"))
    )


def predicates_hold(params: Column | str, predicates: Column | str) -> Column:
    """E5, structured form: all of ``array<struct<key, op, values>>`` hold, none is an
    unconditional yes. Comparing with ``<`` or ``>`` is numeric."""
    params = F.col(params) if isinstance(params, str) else params
    predicates = F.col(predicates) if isinstance(predicates, str) else predicates

    def one(p: Column) -> Column:
        value = F.try_element_at(params, p["key"])
        listed = F.array_contains(p["values"], value)
        number, bound = value.try_cast("double"), F.get(p["values"], F.lit(0)).try_cast("double")
        return F.coalesce(
            F.when(p["op"].isin("=", "in"), listed)
            .when(p["op"].isin("!=", "not in"), ~listed)
            .when(p["op"] == "is null", value.isNull())
            .when(p["op"] == "is not null", value.isNotNull())
            .when(p["op"] == "<", number < bound)
            .when(p["op"] == "<=", number <= bound)
            .when(p["op"] == ">", number > bound)
            .when(p["op"] == ">=", number >= bound),
            F.lit(False),
        )

    return F.coalesce(F.forall(predicates, one), F.lit(True))


@dataclass
class RuleSet:
    """Rules ready for the join: a small frame, and condition texts by number."""

    frame: DataFrame
    conditions: dict[int, tuple[str, str]] = field(default_factory=dict)
    values: dict[int, str] = field(default_factory=dict)
    alternatives: int = 1
    event_ids: tuple[str, ...] = ()
    structured: bool = False

    @property
    def fields(self) -> dict[str, str]:
        """Columns of one alternative."""
        return {**ALTERNATIVE, "predicates": PREDICATES} if self.structured else ALTERNATIVE


def compile_rules(rules: DataFrame) -> RuleSet:
    """Number the conditions and put rules of one identity side by side.

    Condition texts are SQL that only trusted configuration may supply; they become
    columns of the plan, which is why this one table is read on the driver, whatever its
    size: it is configuration, and a plan cannot hold more conditions than the driver. An optional column ``predicates`` holds structured conditions
    (see :func:`predicates_hold`), which stay data and are evaluated for all rules alike.
    """
    structured = "predicates" in rules.columns
    keyed = rules.select(
        "rule_no",
        *RULE_COLUMNS,
        *[param_keys(c).alias(f"{c}_keys") for c in (*PARAM_COLUMNS, "camera_mode")],
        *(["predicates"] if structured else []),
    )
    rows = keyed.collect()
    if not rows:
        raise ValueError("no usable rule")
    rows.sort(key=lambda r: r["rule_no"])
    compiled = RuleSet(frame=rules, event_ids=tuple(sorted({r["event_id"] for r in rows})), structured=structured)
    known: dict[tuple[str, str], int] = {}
    known_values: dict[str, int] = {}

    def condition(event_id: str, text: str) -> int:
        return known.setdefault((event_id, text), len(known))

    groups: dict[tuple, list] = {}
    for r in rows:
        text = r["filter_condition"]
        camera_keys, camera_fixed, camera_text = list(r["camera_mode_keys"]), None, None
        if r["camera_mode"] in CAMERA_MODES:
            camera_fixed = r["camera_mode"]
        elif not camera_keys and len(r["camera_mode"]) > 2:
            camera_text = known_values.setdefault(r["camera_mode"], len(known_values))
        keys = [r[f"{c}_keys"] for c in PARAM_COLUMNS] + [camera_keys]
        alternative = (
            True,
            condition(r["event_id"], text) if "params" in text else None,
            *[name for k in keys for name in (*k, None, None)[:2]],
            camera_fixed,
            camera_text,
            condition(r["event_id"], r["sharephone"]) if len(r["sharephone"]) > 2 else None,
            *([r["predicates"]] if structured else []),
        )
        groups.setdefault(tuple(r[c] for c in IDENTITY), []).append(alternative)

    most = max(len(g) for g in groups.values())
    out = []
    numbers: dict[tuple, int] = {}
    for r in rows:
        icon = r["second_icon"]
        said = tuple(r[c] for c in (*FIXED.values(), "material_id"))
        first, number = said not in numbers, numbers.setdefault(said, len(numbers))
        group = groups[tuple(r[c] for c in IDENTITY)]
        absent = (False, *[None] * (len(compiled.fields) - 1))
        out.append(
            (
                *[r[c] for c in ("rule_no", "event_id", *LEVELS, "record_type", "media_type", "deal_mode")],
                *[r[c] for c in ("event_type", "vip_func_id", "material_id")],
                number,
                first,
                icon if icon in (YES, NO) else None,
                condition(r["event_id"], icon) if len(icon) > 2 else None,
                *[value for i in range(most) for value in (group[i] if i < len(group) else absent)],
            )
        )
    compiled.conditions = {number: key for key, number in known.items()}
    compiled.values = {number: text for text, number in known_values.items()}
    compiled.alternatives = most
    flat = [f"_{name}{i} {kind}" for i in range(most) for name, kind in compiled.fields.items()]
    compiled.frame = rules.sparkSession.createDataFrame(out, ", ".join([RULE_FRAME, *flat]))
    return compiled


RULE_FRAME = (
    "rule_no bigint, event_id string, level1 string, level2 string, level3 string, level4 string, level5 string,"
    " record_type string, media_type string, deal_mode string, event_type string, vip_func_id string,"
    " params_key string, fixed_no int, fixed_first boolean, icon_fixed string, icon_condition int"
)
# One rule of an identity: up to two param names per value, and numbers of conditions.
ALTERNATIVE = {
    "present": "boolean",
    "condition": "int",
    **{f"{c}_{n}": "string" for c in (*PARAM_COLUMNS, "camera") for n in ("key", "other")},
    "camera_fixed": "string",
    "camera_text": "int",
    "share": "int",
}
PREDICATES = "array<struct<key:string,op:string,values:array<string>>>"
# What a rule says regardless of the event, by output name.
FIXED = {
    "main_func_name": "level1",
    **{f"sub_func_level{i}_name": f"level{i}" for i in range(2, 6)},
    "record_type": "record_type",
    "media_type": "media_type",
    "deal_mode": "deal_mode",
    "event_type": "event_type",
    "vip_func_id": "vip_func_id",
}


def fixed_columns() -> list[Column]:
    return [
        *[blank_to_null(c).alias(out) for out, c in FIXED.items()],
        depth_of(LEVELS).alias("tool_level"),
        module_of("level1").alias("model_p"),
        F.col("params_key"),
    ]


def fixed_attributes(compiled: RuleSet) -> DataFrame:
    """What rules say regardless of the event, one row per ``fixed_no``; at most one per rule."""
    return compiled.frame.filter("fixed_first").select("fixed_no", *fixed_columns())


def held_conditions(compiled: RuleSet) -> Column:
    """Numbers of the conditions that hold for an event; only its own kind's are tried."""
    by_event: dict[str, list[Column]] = {}
    for number, (event_id, text) in compiled.conditions.items():
        by_event.setdefault(event_id, []).append(F.when(F.expr(f"({text})"), F.lit(number)))
    none = F.array().cast("array<int>")
    out = None
    for event_id, tests in by_event.items():
        held = F.array_compact(F.array(*tests))
        hit = F.col("event_id") == event_id
        out = F.when(hit, held) if out is None else out.when(hit, held)
    return none if out is None else out.otherwise(none)


def first_of(cases: Sequence[tuple[Column, Column]], default: Column) -> Column:
    out = None
    for test, value in cases:
        out = F.when(test, value) if out is None else out.when(test, value)
    return default if out is None else out.otherwise(default)


def attribute(events: DataFrame, compiled: RuleSet, day: str | None = None) -> DataFrame:
    """Each event with every rule it satisfies, and what the rule reads from it.

    ``events`` has ``event_id`` and a ``params`` map. Conditions run once per event, before
    the join. Rules that share an identity back each other up: the event counts for all of
    them when one holds, and the first that holds and names a param supplies the value.
    """
    ready = events.filter(F.col("event_id").isin(*compiled.event_ids)).withColumn("_held", held_conditions(compiled))
    order = range(compiled.alternatives)
    flat = [f"_{name}{i}" for i in order for name in compiled.fields]
    small = compiled.frame.select(
        "event_id", "rule_no", "fixed_no", *fixed_columns(), "icon_fixed", "icon_condition", *flat
    )
    carried = [c for c in events.columns if c not in small.columns or c == "event_id"]
    # the frame was built from the compiled rules, which the driver holds
    joined = ready.select(*carried, "_held").join(F.broadcast(small), "event_id")

    def holds(number: Column) -> Column:
        return number.isNotNull() & F.array_contains("_held", number)

    def at(name: str, i: int) -> Column:
        return F.col(f"_{name}{i}")

    hits = {
        f"_hit{i}": at("present", i) & (at("condition", i).isNull() | holds(at("condition", i))) for i in order
    }
    if compiled.structured:
        hits = {n: hit & predicates_hold("params", at("predicates", i)) for i, (n, hit) in enumerate(hits.items())}
    any_hit = reduce(lambda a, b: a | b, map(F.col, hits))
    matched = joined.withColumns(hits).filter(any_hit)

    nothing = F.lit(None).cast("string")

    def value(name: str, i: int) -> Column:
        return F.coalesce(param_of(at(f"{name}_key", i)), param_of(at(f"{name}_other", i)))

    def param_of(key: Column) -> Column:
        return F.try_element_at(F.col("params"), key)

    def read(name: str) -> Column:
        return first_of([(F.col(f"_hit{i}") & at(f"{name}_key", i).isNotNull(), value(name, i)) for i in order], nothing)

    camera = []
    for i in order:
        camera.append((at("camera_fixed", i).isNotNull(), at("camera_fixed", i)))
        camera.append((at("camera_key", i).isNotNull(), value("camera", i)))
        for number, text in compiled.values.items():
            camera.append((at("camera_text", i) == number, F.expr(f"({text})").cast("string")))
    vertical = holds(F.col("icon_condition"))
    if day is not None:
        vertical = vertical & (F.col(day) >= F.lit(VERTICAL_SINCE))
    return matched.select(
        *carried,
        "rule_no",
        "fixed_no",
        *FIXED,
        first_of([(holds(at("share", i)), F.lit(YES)) for i in order], F.lit(NO)).alias("sharephone"),
        F.coalesce("icon_fixed", F.when(vertical, YES).otherwise(NO)).alias("second_icon"),
        first_of(camera, nothing).alias("camera_mode"),
        cut_scm(read("scm")).alias("scm"),
        read("tab_id").alias("tab_id"),
        read("posi_id").alias("posi_id"),
        read("material_id").alias("material_id"),
        "tool_level",
        "model_p",
        "params_key",
        F.lit(1).cast("bigint").alias("cnt"),
    )
