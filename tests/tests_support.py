"""The star of t1 and t2 that several tests share."""

T1 = [("1", "1970-10-01 11:00:00", 6666.0), ("1", "1999-01-01 16:00:00", 8888.0), ("1", "1999-01-01 23:00:00", 8888.0), ("1", "2022-03-01 23:28:55", 1246.0), ("2", "2021-03-01 17:00:00", 5555.0), ("2", "2021-03-01 20:02:33", 3333.0), ("2", "2021-03-01 23:00:00", 3333.0), ("3", "2021-03-03 08:08:08", 3032.0), ("3", "2021-03-03 17:09:11", 3032.0)]
T2 = [("1", 1111.0, "1970-01-01 10:00:00"), ("1", 3333.0, "1970-01-01 23:00:00"), ("1", 6666.0, "1996-11-07 10:00:00"), ("1", 1246.0, "2022-03-01 23:28:55"), ("1", 8888.0, "2022-03-01 23:28:55"), ("2", 2022.0, "2021-03-01 20:02:33"), ("2", 4044.0, "2021-03-01 17:00:00"), ("3", 3033.0, "2021-03-03 17:09:11"), ("4", 9999.0, "2021-03-03 11:24:11")]
KINDS = {"string": "SingleString", "timestamp": "Timestamp", "double": "ContinueNum"}


def feature(table, name, kind):
    return {"id": f"{table}.{name}", "data_type": KINDS[kind], "skip": "false", "feature_type": kind.capitalize()}


def relation(kind, **more):
    return {"type": kind, "from_entity": "t1", "from_entity_keys": ["c1"], "to_entity": "t2", "to_entity_keys": ["c1"], "from_entity_time_col": "c2", "to_entity_time_col": "c3", **more}


CONFIG = {
    "target_entity": "t1", "target_entity_index": "c1", "target_label": "c3", "target_pivot_timestamp": "c2",
    "entity_detail": {
        "t1": {"features": [feature("t1", "c1", "string"), feature("t1", "c2", "timestamp"), feature("t1", "c3", "double")]},
        "t2": {"features": [feature("t2", "c1", "string"), feature("t2", "c2", "double"), feature("t2", "c3", "timestamp")]},
    },
    "relations": [relation("1-1", order_by=["ordinal"]), relation("SLICE", time_windows=["2147483645:0"], order_by=["ordinal"]), relation("1-M", order_by=["ordinal"])],
}
