"""The inverted index of structured rules, against the join of compiled rules and by hand."""

from __future__ import annotations

import random

import pytest
from conftest import records
from pyspark.sql import functions as F

from tidemark.operators import rule_index, rules

BLANK = {c: "" for c in rules.RULE_COLUMNS}
SCHEMA = ", ".join(["rule_no bigint", *[f"{c} string" for c in rules.RULE_COLUMNS], f"predicates {rules.PREDICATES}"])
EVENTS = "record bigint, event_id string, params map<string,string>"
VALUES = ["rule_no", "record", "scm", "tab_id", "posi_id", "material_id"]


def rule_frame(spark, rows):
    """rows: (rule_no, changed columns, predicates)."""
    full = [(n, *[{**BLANK, "event_id": "aa", "level1": f"l{n}", **more}[c] for c in rules.RULE_COLUMNS], p) for n, more, p in rows]
    accepted, _ = rules.clean_rules(spark.createDataFrame(full, SCHEMA))
    return accepted


def drawn(seed):
    """Random rules and events: few keys and values, nulls, empty lists, shared identities."""
    rng = random.Random(seed)
    keys, values = ["x", "y", "z", ""], ["1", "2", "10", "", "t", None]

    def predicate():
        op = rng.choice(["=", "in", "!=", "not in", "is null", "is not null", "<", "<=", ">", ">="])
        return (rng.choice(keys), op, [rng.choice(values) for _ in range(rng.choice([0, 1, 1, 2, 3]))])

    texts = ["", "params['x']", "params['y']", "nvl(params['z'],params['x'])"]
    given = []
    for n in range(60):
        more = {"event_id": rng.choice(["aa", "bb"]), "level1": f"l{rng.randrange(25)}", **{c: rng.choice(texts) for c in rule_index.READ}}
        given.append((n, more, rng.choice([None, [], [predicate()], [predicate(), predicate()], [predicate(), predicate(), predicate()]])))
    events = [(i, rng.choice(["aa", "bb", "cc"]), rng.choice([None, *[{k: rng.choice(values) for k in rng.sample(keys, rng.randrange(5))}] * 9])) for i in range(150)]
    return given, events


@pytest.mark.parametrize("seed", range(4))
def test_index_equals_compiled_rules(spark, seed):
    given, events = drawn(seed)
    frame, log = rule_frame(spark, given), spark.createDataFrame(events, EVENTS)
    wanted = records(rules.attribute(log, rules.compile_rules(frame)).select(*VALUES), "record", "rule_no")
    found = records(rule_index.attribute_indexed(log, frame, ["record"]).select(*VALUES), "record", "rule_no")
    assert found == wanted and wanted


def test_a_rule_is_posted_under_its_rarest_condition(spark):
    common, rare = ("x", "=", ["1"]), ("y", "in", ["7", "7", None])
    frame = rule_frame(spark, [*[(n, {}, [common]) for n in range(5)], (5, {}, [common, rare]), (6, {}, [("z", ">", ["3"])]), (7, {}, None)])
    posted = {r["rule_no"]: (r["_tier"], r["_key"], r["_value"]) for r in rule_index.rule_index(frame).collect()}
    assert posted[5] == (rule_index.VALUE, "y", "7")
    assert posted[6] == (rule_index.KEY, "z", "") and posted[7] == (rule_index.OWN, "", "") and posted[0][1] == "x"
    assert rule_index.rule_index(frame).count() == 8


def test_one_identity_of_many_alternatives(spark):
    """One that holds stands for all 300; the first that names a param gives the value."""
    given = [(n, {"level1": "same", "tab_id": "params['t']" if n != 7 else ""}, [("u", "=", [str(n)])]) for n in range(300)]
    log = spark.createDataFrame([(1, "aa", {"u": "7", "t": "seen"}), (2, "aa", {"u": "8", "t": "seen"}), (3, "aa", {"u": "x"})], EVENTS)
    found = rule_index.attribute_indexed(log, rule_frame(spark, given), ["record"]).groupBy("record", "tab_id").count()
    assert records(found, "record") == [{"record": 1, "tab_id": None, "count": 300}, {"record": 2, "tab_id": "seen", "count": 300}]


def test_plan_does_not_grow_with_rules(spark):
    log = spark.createDataFrame([(1, "aa", {"u": "7"})], EVENTS)

    def plan(n):
        frame = rule_frame(spark, [(i, {"level1": "same"}, [("u", "=", [str(i)])]) for i in range(n)])
        found = rule_index.attribute_indexed(log, frame, ["record"])
        return found._jdf.queryExecution().analyzed().toString().count("\n"), len(found.columns)

    assert plan(3) == plan(2000)


def test_empty_tables(spark):
    log, frame = spark.createDataFrame([(1, "aa", {"u": "7"})], EVENTS), rule_frame(spark, [(1, {}, None)])
    assert rule_index.attribute_indexed(log.limit(0), frame, ["record"]).count() == 0
    assert rule_index.attribute_indexed(log, frame.filter("false"), ["record"]).count() == 0
    assert rule_index.attribute_indexed(log, frame, ["record"]).count() == 1


def test_conditions_as_text_are_refused(spark):
    log = spark.createDataFrame([(1, "aa", {"u": "7"})], EVENTS)
    frame = rule_frame(spark, [(1, {"filter_condition": "params['u'] = 7"}, None)])
    with pytest.raises(Exception, match="condition as text: 1"):
        rule_index.attribute_indexed(log, frame, ["record"]).select(F.max("rule_no")).collect()


def test_no_side_of_a_lookup_is_gathered_on_the_driver(spark, tmp_path):
    """Files say little of how many rows an explode makes: a small estimate must not send a table to the driver."""
    path = str(tmp_path / "rules")
    rule_frame(spark, [(n, {"level1": "same"}, [("u", "in", [str(n), "x"]), ("v", ">", ["1"])]) for n in range(20)]).write.parquet(path)
    spark.createDataFrame([(i, "aa", {"u": str(i), "v": "2"}) for i in range(30)], EVENTS).write.parquet(f"{path}-log")
    found = rule_index.attribute_indexed(spark.read.parquet(f"{path}-log"), spark.read.parquet(path), ["record"])
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 20 * 20
