"""Golden parity on the star of t1 and t2: expected values per main row."""

import pytest

from starloom.plans.planner import compile_program
from tests_support import CONFIG, T1, T2

#: The expected results, in the order of T1.
EXPECTED = {
    "window_sum(t1.c2,t1.c1,10:0,t1.c3)": [6666, 15554, 24442, 25688, 5555, 8888, 12221, 3032, 6064],
    "window_avg(t1.c2,t1.c1,10:0,t1.c3)": [6666, 7777, 8147.333333, 6422, 5555, 4444, 4073.666667, 3032, 3032],
    "window_max(t1.c2,t1.c1,10:0,t1.c3)": [6666, 8888, 8888, 8888, 5555, 5555, 5555, 3032, 3032],
    "window_min(t1.c2,t1.c1,10:0,t1.c3)": [6666, 6666, 6666, 1246, 5555, 3333, 3333, 3032, 3032],
    "window_count(t1.c2,t1.c1,604801s:100:0s,t1.c3)": [1, 1, 2, 1, 1, 1, 2, 1, 2],
    "window_unique_count(t1.c2,t1.c1,604801s:100:0s,t1.c3)": [1, 1, 1, 1, 1, 2, 2, 1, 1],
    "window_top1_ratio(t1.c2,t1.c1,10:0,t1.c3)": [1, 0.5, 0.666667, 0.5, 1, 0.5, 0.666667, 1, 1],
    "multi_direct(t1,t2.c2)": [8888] * 4 + [4044] * 3 + [3033] * 2,
    "multi_last_value(t1,t2.c2,2147483645:0)": [3333, 6666, 6666, 6666, None, 4044, 2022, None, None],
    "multi_sum(t1,t2.c2,32d:100:0s)": [0, 0, 0, 0, 0, 4044, 6066, 0, 0],
    "multi_avg(t1,t2.c2,32d:100:0s)": [0, 0, 0, 0, 0, 2022, 2022, 0, 0],
    "multi_min(t1,t2.c2,32d:100:0s)": [0] * 9,
    "multi_max(t1,t2.c2,32d:100:0s)": [0, 0, 0, 0, 0, 4044, 4044, 0, 0],
    "multi_count(t1,t2.c2,32d:100:0s)": [None] * 5 + [2, 3, None, None],
    "multi_unique_count(t1,t2.c2,32d:100:0s)": [1, 1, 1, 1, 1, 2, 3, 1, 1],
    "multi_top3frequency(t1,t2.c2,32d:100:0s)": ["0.000000,NULL,NULL"] * 5 + ["0.000000,4044.000000,NULL", "0.000000,2022.000000,4044.000000"] + ["0.000000,NULL,NULL"] * 2,
    "multiply(multi_last_value(t1,t2.c2,2147483645:0),multi_direct(t1,t2.c2))": [3333 * 8888.0, 6666 * 8888.0, 6666 * 8888.0, 6666 * 8888.0, None, 4044 * 4044.0, 2022 * 4044.0, None, None],
    "original(t1.c3)": [r[2] for r in T1],
}


@pytest.fixture(scope="module")
def tables(spark):
    t1 = spark.createDataFrame(T1, "c1 string, c2 string, c3 double").selectExpr("c1", "cast(c2 as timestamp) c2", "c3")
    t2 = spark.createDataFrame([(*r, i) for i, r in enumerate(T2)], "c1 string, c2 double, c3 string, ordinal int").selectExpr("c1", "c2", "cast(c3 as timestamp) c3", "ordinal")
    return {"t1": t1, "t2": t2}


def test_all_goldens_in_one_plan(tables):
    names = [f"f{i}" for i in range(len(EXPECTED))]
    df = compile_program(CONFIG, "\n".join(EXPECTED), tables, names=names, keep=["c1", "c2"])
    got = {(r.c1, str(r.c2)): r for r in df.collect()}
    assert len(got) == len(T1)
    for (op, values), name in zip(EXPECTED.items(), names):
        for row, want in zip(T1, values):
            have = got[(row[0], row[1])][name]
            assert have == (pytest.approx(want, abs=1e-6) if isinstance(want, (int, float)) else want), (op, row)


@pytest.mark.parametrize("op", list(EXPECTED))
def test_golden_alone(tables, op):
    df = compile_program(CONFIG, op, tables, names=["f"], keep=["c1", "c2"])
    got = {(r.c1, str(r.c2)): r.f for r in df.collect()}
    for row, want in zip(T1, EXPECTED[op]):
        assert got[(row[0], row[1])] == (pytest.approx(want, abs=1e-6) if isinstance(want, (int, float)) else want)
