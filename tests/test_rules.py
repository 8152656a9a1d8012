"""Rule clean-up, evaluation and the facts built from it."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import params
from tidemark.operators import joins, rules
from tidemark.plans.attribution import behaviour_detail, material_detail

BLANK = {c: "" for c in rules.RULE_COLUMNS}


def table(spark, *given):
    rows = [(i, *[{**BLANK, **r}[c] for c in rules.RULE_COLUMNS]) for i, r in enumerate(given)]
    return spark.createDataFrame(rows, "rule_no bigint, " + ", ".join(f"{c} string" for c in rules.RULE_COLUMNS))


def log(spark, *events):
    """Events as (record, event_id, params, day)."""
    return spark.createDataFrame(
        [(r, e, p, d) for r, e, p, d in events], "record int, event_id string, params map<string,string>, day date"
    )


DAY = dt.date(2024, 1, 1)


def test_cleaning_and_rejection(spark):
    accepted, rejected = rules.clean_rules(
        table(
            spark,
            {"level1": " 相机 ", "event_id": "cam_shot", "scm": "params[‘scm’]", "tab_id": "something"},
            {"level1": "名（一）", "event_id": "a&b", "filter_condition": "params[‘x’] in （‘1’）"},
            {"level1": "", "event_id": "cam_shot"},
            {"level1": "x", "event_id": "1shot"},
            {"level1": "x", "event_id": ""},
            {"level1": "x", "event_id": "ok", "posi_id": "NVL( params['a'] , params['b(6.0后)'] )", "material_id": "params['a（6.0后）']"},
        )
    )
    kept = {r.rule_no: r for r in accepted.collect()}
    assert sorted(kept) == [0, 1, 5]
    assert (kept[0].level1, kept[0].scm, kept[0].tab_id) == ("相机", "params['scm']", "无参数")
    assert kept[1].level1 == "名（一）" and kept[1].filter_condition == "params['x'] in ('1')"
    assert kept[5].material_id == "params['a（6.0后）']"
    keys = accepted.filter("rule_no = 5").select(rules.param_keys("posi_id"), rules.param_keys("material_id")).first()
    assert list(keys) == [["a", "b(6.0后)"], ["a（6.0后）"]]
    assert {r.rule_no: r.reason for r in rejected.collect()} == {
        2: "level1 is blank",
        3: "event_id is not a name",
        4: "event_id is not a name",
    }
    with pytest.raises(ValueError, match="no usable rule"):
        rules.compile_rules(accepted.filter("false"))


def evaluate(spark, events, *given, day=None):
    accepted, _ = rules.clean_rules(table(spark, *given))
    found = rules.attribute(log(spark, *events), rules.compile_rules(accepted), day).collect()
    return sorted(found, key=lambda r: (r.record, r.rule_no))


def test_conditions_decide(spark):
    given = [
        {"level1": "aa", "event_id": "tap", "filter_condition": "params['x'] = '1'"},
        {"level1": "bb", "event_id": "tap"},
        {"level1": "cc", "event_id": "tap", "filter_condition": "1 = 2"},
        {"level1": "dd", "event_id": "other"},
    ]
    events = [(1, "tap", {"x": "1"}, DAY), (2, "tap", {"x": "2"}, DAY), (3, "tap", {}, DAY), (4, "none", {}, DAY)]
    got = [(r.record, r.main_func_name) for r in evaluate(spark, events, *given)]
    # a condition that reads no param is not applied
    assert got == [(1, "aa"), (1, "bb"), (1, "cc"), (2, "bb"), (2, "cc"), (3, "bb"), (3, "cc")]


def test_rules_of_one_identity_back_each_other_up(spark):
    same = {"level1": "aa", "event_id": "tap"}
    given = [
        {**same, "filter_condition": "params['x'] = '1'", "scm": "params['s']", "deal_mode": "one"},
        {**same, "filter_condition": "params['x'] = '2'", "scm": "nvl(params['none'],params['s'])", "tab_id": "params['t']", "deal_mode": "two"},
    ]
    events = [(1, "tap", {"x": "1", "s": "a$$$b", "t": "t"}, DAY), (2, "tap", {"x": "2", "s": "c", "t": "t"}, DAY)]
    got = [(r.record, r.deal_mode, r.scm, r.tab_id) for r in evaluate(spark, events, *given)]
    assert got == [(1, "one", "a", None), (1, "two", "a", None), (2, "one", "c", "t"), (2, "two", "c", "t")]


def test_flags_of_each_rule_are_its_own(spark):
    given = [
        {"level1": "aa", "event_id": "tap", "second_icon": "是", "camera_mode": "生图"},
        {"level1": "bb", "event_id": "tap", "second_icon": "否", "camera_mode": "params['m']"},
        {"level1": "cc", "event_id": "tap", "second_icon": "params['i'] = '1'", "sharephone": "params['p'] is not null"},
        {"level1": "dd", "event_id": "tap", "camera_mode": "concat('m-', params['m'])"},
    ]
    old = dt.date(2022, 10, 8)
    events = [(1, "tap", {"i": "1", "m": "z", "p": "1"}, DAY), (2, "tap", {"i": "1"}, old)]
    got = [(r.record, r.second_icon, r.camera_mode, r.sharephone) for r in evaluate(spark, events, *given, day="day")]
    assert got == [
        (1, "是", "生图", "否"), (1, "否", "z", "否"), (1, "是", None, "是"), (1, "否", "m-z", "否"),
        (2, "是", "生图", "否"), (2, "否", None, "否"), (2, "否", None, "否"), (2, "否", None, "否"),
    ]


def test_levels_and_modules(spark):
    given = [
        {"level1": "视频美容", "level2": "b", "level4": "d", "event_id": "tap"},
        {"level1": "unknown", "event_id": "tap"},
    ]
    got = evaluate(spark, [(1, "tap", {}, DAY)], *given)
    assert [(r.tool_level, r.model_p, r.sub_func_level3_name, r.sub_func_level4_name) for r in got] == [
        (3, "spmr", None, "d"),
        (1, None, None, None),
    ]


def test_structured_predicates(spark):
    rows = spark.createDataFrame([({"x": "1", "n": "12"},), ({"x": "2"},), ({},)], "params map<string,string>")

    def holds(*predicates):
        listed = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(o).alias("op"), F.array(*map(F.lit, v)).cast("array<string>").alias("values")) for k, o, v in predicates])
        return [r[0] for r in rows.select(rules.predicates_hold("params", listed)).collect()]

    assert holds(("x", "in", ["1", "3"])) == [True, False, False]
    assert holds(("x", "!=", ["1"])) == [False, True, False]
    assert holds(("x", "is null", [])) == [False, False, True]
    assert holds(("n", ">", ["9"])) == [True, False, False]
    assert holds(("x", "is not null", []), ("n", "is null", [])) == [False, True, False]
    none = F.lit(None).cast("array<struct<key:string,op:string,values:array<string>>>")
    assert [r[0] for r in rows.select(rules.predicates_hold("params", none)).collect()] == [True] * 3


def test_aliases_and_gate(spark):
    events = log(
        spark,
        (1, "mhmr_homesave", {"source_type": "batch"}, DAY),
        (2, "mhmr_homesave", {"source_type": "sharephoto"}, DAY),
        (3, "mhmr_homesave", {}, DAY),
        (4, "blend_tab_click", {}, dt.date(2025, 5, 8)),
        (5, "blend_tab_click", {}, dt.date(2025, 5, 9)),
        (6, "tool_material_show", {"一级ID": "04"}, DAY),
        (7, "tool_material_show", {}, DAY),
    )
    named = events.select("record", params.alias_event("event_id", "params", day="day").alias("e"))
    assert [r.e for r in named.orderBy("record").collect()] == [
        "mh_homesave", "mr_homesave", "mhmr_homesave", "blend_tab_click_", "blend_tab_click",
        "tool_material_show", "tool_material_show",
    ]
    passed = events.filter(params.gate_passes("event_id", "params", values=params.GATE_VALUES["camera"]))
    assert sorted(r.record for r in passed.collect()) == [1, 2, 3, 4, 5, 6]
    assert events.filter(params.gate_passes("event_id", "params")).count() == 7


def test_fingerprints(spark):
    rows = spark.createDataFrame([("a", None, "b"), ("a", "b", None)], "x string, y string, z string")
    old = rows.select(params.fingerprint(["x", "y", "z"], compat=True)).distinct()
    new = rows.select(params.fingerprint(["x", "y", "z"])).distinct()
    assert (old.count(), new.count()) == (1, 2)
    maps = spark.sql("SELECT map('b', '1', 'a', '2') AS m UNION ALL SELECT map('a', '2', 'b', '1')")
    assert [r[0] for r in maps.select(params.params_json("m")).distinct().collect()] == ['{"a":"2","b":"1"}']


def test_local_day_ignores_the_session_zone(spark, zone):
    rows = spark.createDataFrame([(1704038400000,), (1704038399999,)], "t bigint")
    got = [r[0] for r in rows.select(params.local_day("t", "Asia/Shanghai")).collect()]
    assert got == [dt.date(2024, 1, 1), dt.date(2023, 12, 31)]


def test_ids_and_numbers(spark):
    rows = spark.createDataFrame([("[1;2,3]",), (None,), ("4",)], "ids string")
    exploded = params.explode_ids(rows, "ids", "id")
    assert [r.id for r in exploded.collect()] == ["1", "2", "3", "4"]
    texts = spark.createDataFrame([("12.5",), ("7&x",), ("x",), ("99999999999999999999",), ("",)], "t string")
    assert [r[0] for r in texts.select(params.first_number("t")).collect()] == [12, 7, None, None, None]


def test_lookup_join_gives_the_same_either_way(spark):
    facts = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(90)], "n int, gid string")
    lookup = spark.createDataFrame([("hot",), ("hot",), ("k0",), (None,)], "gid string")
    small = joins.exists_flag(facts, lookup, "gid", "flag")
    assert small.count() == 90 and small.agg(F.sum("flag")).first()[0] == 61
    rows = sorted(small.collect())
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    large = joins.exists_flag(facts, lookup, "gid", "flag")
    assert rows == sorted(large.collect())
    assert "SortMergeJoin" in large._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_lookups_run_nothing_while_the_plan_is_built(spark):
    facts = spark.createDataFrame([("a",)], "gid string")
    failing = spark.range(3).select(F.expr("raise_error('read')").cast("string").alias("gid"))
    flagged = joins.exists_flag(facts, failing, "gid", "flag")
    assert flagged.columns == ["gid", "flag"]


def test_facts_add_up_copies(spark):
    given = [
        {"level1": "拼图", "event_id": "tap", "record_type": "功能"},
        {"level1": "拼图", "event_id": "tap", "record_type": "素材", "material_id": "params['ids']"},
    ]
    accepted, _ = rules.clean_rules(table(spark, *given))
    events = log(spark, *[(1, "tap", {"ids": "[5.1;6,0]"}, DAY)] * 3, (2, "tap", {}, DAY)).withColumn("gid", F.col("record"))
    new = spark.createDataFrame([(1,)], "gid int")
    paid = spark.createDataFrame([(6,), (6,)], "material_id bigint")
    behaviour = behaviour_detail(events, rules.compile_rules(rules.rules_for(accepted, False)), new, carry=["gid"])
    assert sorted((r.gid, r.cnt, r.is_new_user) for r in behaviour.collect()) == [(1, 3, 1), (2, 1, 0)]
    material = material_detail(events, rules.compile_rules(rules.rules_for(accepted, True)), new, paid, carry=["gid"])
    assert sorted((r.material_id_new, r.cnt, r.is_vip_material) for r in material.collect()) == [("5.1", 3, 0), ("6", 3, 1)]


def test_structured_conditions_join_text_conditions(spark):
    given = table(spark, {"level1": "aa", "event_id": "tap", "filter_condition": "params['x'] = '1'"}, {"level1": "bb", "event_id": "tap"})
    listed = F.array(F.struct(F.lit("y").alias("key"), F.lit("=").alias("op"), F.array(F.lit("2")).alias("values")))
    both = given.withColumn("predicates", F.when(F.col("rule_no") == 0, listed).cast(rules.PREDICATES))
    accepted, _ = rules.clean_rules(both)
    events = log(spark, (1, "tap", {"x": "1", "y": "2"}, DAY), (2, "tap", {"x": "1"}, DAY), (3, "tap", {"y": "2"}, DAY))
    found = rules.attribute(events, rules.compile_rules(accepted)).collect()
    assert sorted((r.record, r.rule_no) for r in found) == [(1, 0), (1, 1), (2, 1), (3, 1)]


def test_a_text_behind_the_param_is_not_cut_off(spark):
    one, two = "params['a']", "nvl(params['a'], params['b'])"
    texts = [one, two, f"{one} || params['b']", f"{two} + 1", f"{one}  "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.k for r in df.select("i", rules.param_keys("t").alias("k")).collect()}
    assert got == {0: ["a"], 1: ["a", "b"], 2: [], 3: [], 4: ["a"]}
