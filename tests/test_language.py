"""Parser, frames, schema and text generation."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from starloom.plans.dsl import Call, ParseError, Token, parse_line, parse_program
from starloom.plans.frames import UNLIMITED, Frame, FrameError, candidate_windows, from_config, parse_frame, seconds
from starloom.plans.planner import OPERATORS, PlanError, UnknownOperator, compile_program, split_stages, strict_filter
from starloom.plans.schema import SchemaError, load_schema
from starloom.plans.sqltext import to_sql
from starloom.sources.tables import create_table
from tests_support import CONFIG

_names = st.text("abcxyz_019.", min_size=1, max_size=8)
_calls = st.recursive(_names.map(Token), lambda inner: st.builds(Call, _names, st.lists(inner, min_size=1, max_size=3).map(tuple)), max_leaves=8).filter(lambda x: isinstance(x, Call))


@given(_calls)
@settings(max_examples=200)
def test_parse_prints_back(call):
    assert parse_line(str(call)) == call
    assert parse_line(str(call).replace(",", " , ").replace("(", "( ")) == call


@pytest.mark.parametrize("bad", ["", "f", "f(", "f)", "f(a", "f(,)", "f(a))", "f()", "(a)", "f(a)g(b)", "f(a,)"])
def test_malformed_lines_raise(bad):
    with pytest.raises(ParseError):
        parse_line(bad)


def test_program_skips_blanks_and_comments():
    assert [str(c) for c in parse_program("\n f( a.b ) \n// g(x)\n\nh(f(a),2d:3:0s)\n")] == ["f(a.b)", "h(f(a),2d:3:0s)"]


def test_frames():
    day = 86_400_000_000
    assert parse_frame("32d:100:0s") == Frame("range", 32 * day, 0, 100)
    assert parse_frame("10:0") == Frame("rows", 10, 0)
    assert parse_frame("2d:1d") == Frame("range", 2 * day, day)
    assert parse_frame("1d,1000:0s") == Frame("range", day, 0, 1000)
    assert parse_frame("2147483645:0").kind == "rows"
    assert from_config("32d,100:0s") == "32d:100:0s" and from_config("10") == "10:0" and from_config("7d") == f"7d:{UNLIMITED}:0s"
    assert [seconds(x) for x in ("5", "2m", "3h", "1d", "1w", "1y")] == [5, 120, 10800, 86400, 604800, 31536000]
    for bad in ("", "x", "1d:0", "5:1d", "1d:2d", "1d:0:0s", "1:2:3:4", "d:1"):
        with pytest.raises(FrameError):
            parse_frame(bad)


def test_candidate_windows():
    assert candidate_windows(60, 40 * 86400) == ["2764800s,1000:0s", "1209600s,1000:0s"]
    assert candidate_windows(60, 40 * 86400, binary=False) == ["7200s,1000:0s", "36000s,1000:0s"]
    assert candidate_windows(60, 10) == ["10000d,1000:0s"]


def test_schema():
    s = load_schema(json.dumps({"app": {"feature_info": CONFIG}}))
    assert s.target == "t1" and s.index == "c1" and [r.type for r in s.relations] == ["1-1", "SLICE", "1-M"]
    assert s.column("t2", "c2").is_numeric and s.column("t1", "c2").kind == "time"
    with pytest.raises(SchemaError):
        load_schema({"target_entity": "x"})
    with pytest.raises(SchemaError):
        s.column("t1", "nope")
    broken = json.loads(json.dumps(CONFIG))
    broken["entity_detail"]["t1"]["features"][0]["feature_type"] = "decimal"
    with pytest.raises(SchemaError):
        load_schema(broken)
    broken = json.loads(json.dumps(CONFIG))
    broken["relations"][0]["from_entity"] = "t2"
    with pytest.raises(SchemaError):
        load_schema(broken)


def test_separators():
    f = lambda kind: {"id": "t.x", "feature_type": "String", "data_type": kind}
    s = load_schema({"target_entity": "t", "entity_detail": {"t": {"features": [f("ArrayString(,)"), f("KVString(,)[:]"), f("SplitID")]}}})
    assert [c.separators for c in s.tables["t"]] == [(",",), (",", ":"), ()] and [c.kind for c in s.tables["t"]] == ["multi", "multi", "ignore"]


def test_strict_filter_and_stages():
    s = load_schema(CONFIG)
    program = parse_program("window_sum(t1.c2,t1.c1,10:0,t1.c1)\nwindow_sum(t1.c2,t1.c1,10:0,t1.c3)\nadd(window_sum(t1.c2,t1.c1,10:0,t1.c3),multi_sum(t1,t2.c2,1d:9:0s))\ndayofweek(multi_direct(t1,t2.c3))\nmulti_direct(t1,t2.c2)")
    assert [str(x) for x in strict_filter(program, s)] == ["window_sum(t1.c2,t1.c1,10:0,t1.c3)", "multi_direct(t1,t2.c2)"]
    columns, signs = split_stages(program)
    assert len(signs) == 5 and "multi_direct(t1,t2.c3)" in map(str, columns)


def test_errors(spark):
    df = spark.createDataFrame([], "c1 string, c2 timestamp, c3 double")
    tables = {"t1": df, "t2": spark.createDataFrame([], "c1 string, c2 double, c3 timestamp, ordinal int")}
    with pytest.raises(UnknownOperator):
        compile_program(CONFIG, "nope(t1.c1)", tables)
    for bad in ("window_sum(t1.c2,t1.c1,10:0,t1.c1)", "multi_direct(t2,t2.c2)", "add(t1.c3)", "split(t1.c1)", "original(t2.c2)"):
        with pytest.raises(PlanError):
            compile_program(CONFIG, bad, tables)
    with pytest.raises(SchemaError):
        compile_program(CONFIG, "original(t1.c1)", {"t1": df.drop("c3")})


def test_feature_sql_and_ddl():
    s = load_schema(CONFIG)
    text = to_sql(s, "original(t1.c1)\nwindow_count(t1.c2,t1.c1,7d:100:0s,t1.c3)\nmulti_sum(t1,t2.c2,32d:100:0s)\nmulti_last_value(t1,t2.c2,2147483645:0)\nmulti_direct(t1,t2.c2)")
    assert "rows_range between 604800s preceding and 0s preceding maxsize 100" in text and "union `t2`" in text and "instance_not_in_window" in text and text.count("last join") == 2
    assert create_table(s, "t2", 8) == "CREATE TABLE `t2` (`c1` STRING, `c2` DOUBLE, `c3` TIMESTAMP) USING parquet CLUSTERED BY (`c1`) INTO 8 BUCKETS TBLPROPERTIES ('ts' = 'c3', 'ttl_rows' = '2147483645')"


def test_every_language_operator_is_known():
    named = "original multi_direct multi_last_value multi_sum multi_avg multi_min multi_max multi_std multi_count multi_unique_count multi_top3frequency window_sum window_avg window_min window_max window_count window_unique_count window_top1_ratio window_ratio add subtract multiply divide log dayofweek isweekday hourofday timediff isin combine split split_key split_value binary_label regression_label"
    assert set(named.split()) <= OPERATORS
