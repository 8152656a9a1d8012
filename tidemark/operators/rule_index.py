"""Structured rules through an inverted index (E5, E6), for rule tables of any size.

Rules stay rows: nothing is read on the driver, and the plan is the same for five rules and for a
million. A rule is posted under one of its conditions only, so an event meets it at most once:

* Conditions that name values (``=``, ``in``) are the narrowest: one posting per event, key and value.
* Else a condition that needs a key to be there: one posting per event and key.
* Else (no condition, or ``is null`` only) one posting per event.

Of several conditions of one kind the one with the fewest postings is taken, counted over the whole
rule table. An event sends out one row per value, key and itself; what meets a posting is checked on
all conditions of the rule. No grouping is needed to find the rules of an event.

All joins are by shuffle (``BY_SHUFFLE``): events and rules are exploded into many rows, which the planner takes for as
few bytes as their compressed files have, and a broadcast of them gathers the table on the driver. Adaptive
execution splits hot values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.params import cut_scm
from tidemark.operators.rules import IDENTITY, param_keys, predicates_hold

#: What rules read from the event.
READ = ("scm", "tab_id", "posi_id", "material_id")
TOKEN = ("event_id", "_tier", "_key", "_value")
OWN, KEY, VALUE = 0, 1, 2
BY_SHUFFLE = "merge"


def _token(tier: int, key: Column, value: Column) -> Column:
    return F.struct(F.lit(tier).alias("_tier"), key.alias("_key"), value.alias("_value"))


def _nothing() -> Column:
    return F.array(_token(OWN, F.lit(""), F.lit("")))


def rule_index(rules: DataFrame) -> DataFrame:
    """The postings: ``event_id, _tier, _key, _value, rule_no``, one condition's per rule.

    ``rules`` has ``rule_no`` (unique), ``event_id`` and ``predicates``
    (see :func:`tidemark.operators.rules.predicates_hold`).
    """

    def tokens(p: Column) -> Column:
        named = F.array_distinct(F.array_compact(p["values"]))
        exact = p["op"].isin("=", "in") & (F.size(named) > 0)
        needs_key = ~p["op"].isin("=", "in", "is null")
        return (
            F.when(exact, F.transform(named, lambda v: _token(VALUE, p["key"], v)))
            .when(needs_key, F.array(_token(KEY, p["key"], F.lit(""))))
            .otherwise(F.array().cast("array<struct<_tier:int,_key:string,_value:string>>"))
        )

    choices = F.concat(
        F.array(F.struct(F.lit(-1).alias("at"), _nothing().alias("tokens"))),
        F.coalesce(F.transform("predicates", lambda p, i: F.struct(i.alias("at"), tokens(p).alias("tokens"))), F.array()),
    )
    options = rules.select("event_id", "rule_no", F.explode(choices).alias("c"))
    posted = options.select("event_id", "rule_no", "c.at", F.explode("c.tokens").alias("t")).select("event_id", "rule_no", "at", "t.*")
    counts = posted.groupBy(*TOKEN).agg(F.count(F.lit(1)).alias("_n"))
    cost = F.struct((-F.col("_tier")).alias("tier"), F.col("n"), F.col("at"))
    costs = posted.join(counts.hint(BY_SHUFFLE), list(TOKEN)).groupBy("rule_no", "at", "_tier").agg(F.sum("_n").alias("n"))
    best = costs.groupBy("rule_no").agg(F.min(cost).alias("best")).select("rule_no", F.col("best.at").alias("at"))
    return posted.join(best.hint(BY_SHUFFLE), ["rule_no", "at"]).select(*TOKEN, "rule_no")


def holding_rules(events: DataFrame, rules: DataFrame, key: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``key, rule_no, params, keep``: every event with every rule whose own conditions all hold.

    ``events`` has ``event_id`` and a ``params`` map; ``key`` names its rows. ``keep`` are columns of the rules.
    """
    entries = F.map_entries(F.coalesce("params", F.create_map().cast("map<string,string>")))
    there = F.filter(entries, lambda e: e["value"].isNotNull())
    sent = F.concat(
        _nothing(),
        F.transform(there, lambda e: _token(KEY, e["key"], F.lit(""))),
        F.transform(there, lambda e: _token(VALUE, e["key"], e["value"])),
    )
    rows = events.select(*key, "event_id", "params", F.explode(sent).alias("t")).select(*key, "event_id", "params", "t.*")
    conditions = rules.select("rule_no", "predicates", *keep)
    postings = rule_index(rules).join(conditions.hint(BY_SHUFFLE), "rule_no")
    met = rows.join(postings.hint(BY_SHUFFLE), list(TOKEN))
    return met.filter(predicates_hold("params", "predicates")).select(*key, "rule_no", "params", *keep)


def attribute_indexed(events: DataFrame, rules: DataFrame, key: Sequence[str], identity: Sequence[str] = IDENTITY) -> DataFrame:
    """``key, rule_no, scm, tab_id, posi_id, material_id``: as :func:`tidemark.operators.rules.attribute`, for
    rules of ``clean_rules`` whose conditions are all structured.

    Rules that share an identity back each other up: the event counts for all of them when one
    holds, and the first by ``rule_no`` that holds and names a param supplies the value. Alternatives are rows and
    meet in one reduction per event and identity, combined before its shuffle.

    A rule whose ``filter_condition`` is text ends the job with an error that names it: its text is never run here.
    """
    group = "_identity"
    text = F.concat(F.lit("rule with a condition as text: "), F.col("rule_no").cast("string"))
    checked = F.when(F.col("filter_condition").contains("params"), F.raise_error(text).cast("bigint")).otherwise(F.col("rule_no"))
    keyed = rules.select(
        checked.alias("rule_no"),
        "event_id",
        "predicates",
        F.min("rule_no").over(Window.partitionBy(*identity)).alias(group),
        *[param_keys(c).alias(f"{c}_keys") for c in READ],
    )
    held = holding_rules(events, keyed, key, [group, *[f"{c}_keys" for c in READ]])

    def read(c: str) -> Column:
        keys = F.col(f"{c}_keys")
        value = F.coalesce(*[F.try_element_at("params", F.get(keys, F.lit(i))) for i in (0, 1)])
        return F.min(F.when(F.size(keys) > 0, F.struct("rule_no", value.alias("value")))).alias(c)

    found = held.groupBy(*key, group).agg(*[read(c) for c in READ])
    said = found.select(*key, group, *[F.col(f"{c}.value").alias(c) for c in READ])
    members = keyed.select(group, "rule_no")
    values = {c: cut_scm(F.col(c)) if c == "scm" else F.col(c) for c in READ}
    return said.join(members.hint(BY_SHUFFLE), group).select(*key, "rule_no", *[v.alias(c) for c, v in values.items()])
