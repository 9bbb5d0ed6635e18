"""Null and edge matrix, properties, plan shapes, preparation, sources and learning."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.functions import scalars as S
from starloom.ml.gbm import GBM, TreeConfig
from starloom.ml.linear import LinearConfig, LinearModel, choose_link, drop_rare, fit_until_worse
from starloom.ml.metrics import auc, binary_metrics
from starloom.ml.predict import batch_predict
from starloom.ml.scorer import slotwise_scores
from starloom.ml.search import FeatureSearch, SearchConfig, combinations, limits
from starloom.ml.tune import Range, random_search
from starloom.operators import joins, prep
from starloom.operators.joins import LastFeature, MultiFeature, union_windows
from starloom.operators.windows import WindowFeature, window_features
from starloom.plans.frames import parse_frame
from starloom.plans.planner import compile_program
from starloom.plans.schema import load_schema
from starloom.queries import COMPOSITE, EVENT_STAR, ORACLES, QUERIES, SHOP, trade_program
from starloom.sources import tables as sources
from tests_support import CONFIG

MAIN = [(1, "a", 100, 1.0), (2, "a", 100, None), (3, "a", 200, 3.0), (4, None, 100, 4.0), (5, "b", None, 5.0), (6, "b", 300, 6.0), (7, "c", 50, 7.0), (8, None, 150, 8.0)]
SIDE = [("a", 100, 10.0, "x"), ("a", 90, None, "y"), ("a", 40, 30.0, None), ("a", 40, 30.0, "x"), (None, 90, 50.0, "n"), ("b", None, 60.0, "b"), ("b", 290, 70.0, "b"), ("d", 10, 80.0, "d")]


@pytest.fixture(scope="module")
def star(spark):
    at = F.timestamp_seconds("t").alias("t")
    main = spark.createDataFrame(MAIN, "id int, k string, t int, v double").select("id", "k", at, "v")
    side = spark.createDataFrame(SIDE, "k string, t int, v double, s string").select("k", at, "v", "s")
    return main, side


@pytest.mark.parametrize("mode", ["golden", "runtime"])
@pytest.mark.parametrize("low", [0, 20])
def test_union_windows_on_nulls_match_plain_python(star, mode, low):
    main, side = star
    frames = {"d": f"60s:2147483647:{low}s", "c": f"60s:2:{low}s"}
    features = [MultiFeature(f"{n}_{a}", a, "v", parse_frame(w)) for n, w in frames.items() for a in ("sum", "avg", "min", "max", "count", "unique_count")]
    features.append(LastFeature("last", "v"))
    got = {r.id: r for r in union_windows(main, side, [("k", "k")], ("t", "t"), features, ["v", "s"], mode, low * 1_000_000).collect()}
    assert sorted(got) == [m[0] for m in MAIN]
    for i, k, t, _ in MAIN:
        for n in frames:
            cap = 10**9 if n == "d" else 2 if mode == "golden" else 1
            inside = []
            if k is not None and t is not None:
                for sk, st, sv, ss in SIDE:
                    if sk == k and st is not None and (st <= t - max(low, 1e-6) and st >= t - 60 if mode == "golden" else st <= t - low and st > t - 60):
                        inside.append((st, sv is not None, sv or 0, ss is not None, ss or "", sv))
            values = [x[-1] for x in sorted(inside, key=lambda x: x[:5])[-cap:] if x[-1] is not None]
            g = mode == "golden"
            want = {
                "sum": sum(values), "avg": sum(values) / (len(values) + 1) if g else (sum(values) / len(values) if values else None), "min": min([*values, 0]) if g else min(values, default=None), "max": max([*values, 0]) if g else max(values, default=None),
                "count": (len(values) + 1 if values else None) if g else len(values), "unique_count": len({*values, 0.0}) if g else len(set(values)),
            }
            for a, w in want.items():
                assert got[i][f"{n}_{a}"] == (pytest.approx(w) if w is not None else None), (i, n, a)


@pytest.mark.parametrize("mode", ["golden", "runtime"])
def test_slices_change_nothing(star, spark, sf, mode):
    main, side = star
    features = [MultiFeature(f"{n}{a}", a, "v", parse_frame(w)) for n, w in {"d": "60s:2147483647:20s", "c": "50s:2:20s"}.items() for a in ("sum", "count", "unique_count", "top3frequency")]
    features.append(LastFeature("last", "v", parse_frame("80s:0s")))
    plain, sliced = (sorted(map(str, union_windows(main, side, [("k", "k")], ("t", "t"), features, ["v", "s"], mode, 20_000_000, s).collect())) for s in (False, True))
    assert plain == sliced
    e = spark.read.parquet(f"{sf}/events.parquet")
    features = [WindowFeature(f"{a}{i}", a, "value", parse_frame(w)) for i, w in enumerate(("3d:2147483647:0s", "2d:7:0s", "4d:9:1d")) for a in ("min", "max", "count")]
    plain, sliced = (sorted(map(str, window_features(e, ["event_type"], "ts", features, ("event_id",), mode, s).collect())) for s in (False, True))
    assert plain == sliced


def test_windows_on_nulls(star):
    main, _ = star
    features = [WindowFeature("s", "sum", "v", parse_frame("100s:2147483647:0s")), WindowFeature("n", "count", "v", parse_frame("100s:5:0s")), WindowFeature("r", "ratio", "v", parse_frame("10:0"))]
    got = {r.id: r for r in window_features(main, ["k"], "t", features, ("id",)).collect()}
    assert len(got) == len(MAIN)
    assert (got[1].s, got[2].s, got[3].s) == (1.0, 1.0, 4.0) and got[2].n is None and got[3].n == 1 and got[3].r == 0.5


def test_direct_join_never_multiplies(star, spark):
    main, side = star
    out = joins.direct_join(main, side, [("k", "k")], ["v", "s"], "p_", ["t", "v", "s"]).collect()
    by = {r.id: r for r in out}
    assert len(out) == len(MAIN) and by[1].p_v == 10.0 and by[4].p_v is None and by[6].p_v == 70.0 and by[7].p_s is None
    assert joins.direct_join(main, side.limit(0), [("k", "k")], ["v"], "p_").count() == len(MAIN)


def test_row_count_is_kept_on_duplicate_index(spark, star):
    main, side = star
    doubled = main.unionByName(main)
    assert union_windows(doubled, side, [("k", "k")], ("t", "t"), [MultiFeature("n", "count", "v", parse_frame("9:0"))]).count() == 2 * len(MAIN)


def test_infinite_window_is_the_group_total(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    df = compile_program(EVENT_STAR, "window_sum(events.ts,events.user_id,100000:0,events.value)", {"events": e}, names=["s"], keep=["user_id", "ts"], order=("event_id",))
    last = df.groupBy("user_id").agg(F.max_by("s", "ts").alias("s"))
    total = e.groupBy("user_id").agg(F.sum("value").alias("t"))
    assert last.join(total, "user_id").where(F.abs(F.col("s") - F.col("t")) > 1e-6).count() == 0


def test_partitions_do_not_change_results(spark, sf):
    def run(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            return sorted(map(str, QUERIES["composite"](spark, sf).collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")

    assert run(1) == run(7)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_have_one_shuffle_for_each_scope_and_no_python(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    ops = "\n".join(f"window_{a}(events.ts,events.user_id,{w},events.value)" for a in ("sum", "avg", "max") for w in ("10:0", "1d:100:0s", "7d:2147483647:0s"))
    text = plan(compile_program(EVENT_STAR, ops, {"events": e}, names=[f"f{i}" for i in range(9)], order=("event_id",)))
    assert text.count("Exchange hashpartitioning") == 1 and "Python" not in text and "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,value:double>" in text
    main, side = e.where("event_type = 'purchase'"), e.where("event_type = 'view'")
    features = [MultiFeature(f"f{i}", a, "value", parse_frame("7d:5:0s")) for i, a in enumerate(("sum", "avg", "top3frequency"))] + [LastFeature("l", "value")]
    text = plan(union_windows(main, side, [("user_id", "user_id")], ("ts", "ts"), features, ["event_id"]))
    assert text.count("Exchange hashpartitioning") == 1 and "Python" not in text and "EqualTo(event_type,view)" in text
    wide = main.withColumn("unused", F.lit(1))
    text = plan(compile_program(SHOP, "multi_sum(purchases,views.value,7d:5:0s)", {"purchases": wide, "views": side.withColumn("tags", F.lit(""))}, names=["x"]))
    assert "unused" not in text and text.count("props") == 0
    text = plan(trade_program(spark, sf, "\n".join(p for _, p in COMPOSITE), [n for n, _ in COMPOSITE]))
    assert "Cartesian" not in text and "Python" not in text and "BroadcastNestedLoop" not in text


def test_scalars(spark):
    df = spark.createDataFrame([(6.0, 0.0, "a:1,b,c:3", None), (None, 2.0, "", "x")], "a double, b double, kv string, s string")
    r = df.select(S.divide(F.col("a"), F.col("b")).alias("d"), S.log(F.col("b")).alias("l"), S.split_key(F.col("kv"), ",", ":").alias("k"), S.split_value(F.col("kv"), ",", ":").alias("v"), S.combine([F.col("s"), F.col("kv")], [False, False]).alias("c"), S.isin(F.col("s"), S.split(F.col("kv"), ",")).alias("i"), S.join_window(F.array("a", "b")).alias("j")).collect()
    assert r[0].d is None and r[0].l is None and r[0].k == ["a", "b", "c"] and r[0].v == ["1", None, "3"] and r[0].c == "a:1,b,c:3" and r[0].i is None and r[1].i == 0 and r[1].j == "NULL,2.0"
    piped = spark.createDataFrame([("a|b.c|*",)], "x string").select(S.split(F.col("x"), "|").alias("p"), S.split(F.col("x"), ".").alias("d"), S.split(F.col("x"), "*").alias("s")).first()
    assert (piped.p, piped.d, piped.s) == (["a", "b.c", "*"], ["a|b", "c|*"], ["a|b.c|", ""])


def test_splits_cover_each_row_once(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    n = o.count()
    for a, b in (prep.temporal_split(o, "o_orderdate", 0.8, "o_orderkey"), prep.validation_split(o, "o_orderdate"), prep.random_split(o, 0.3, "o_orderkey"), prep.old_new_split(o, "o_orderdate", 820454400_000_000, 0.5, "o_orderkey")):
        assert a.count() + b.count() == n and a.join(b, "o_orderkey").count() == 0
    same = spark.range(1000).select("id", F.lit("2020-01-01").cast("timestamp").alias("t"))
    train, test = prep.temporal_split(same, "t", 0.8, "id")
    assert 740 < train.count() < 860 and train.count() + test.count() == 1000
    assert prep.recent_rows(o, "o_orderdate", 500).count() <= 500 and prep.recent_rows(o, "o_orderdate", 10**9).count() == n
    assert prep.temporal_split(o.limit(0), "o_orderdate")[0].count() == 0


def test_sources(spark, tmp_path, star):
    main, _ = star
    f = lambda n, t, d="SingleString": {"id": f"m.{n}", "feature_type": t, "data_type": d}
    s = load_schema({"target_entity": "m", "entity_detail": {"m": {"features": [f("a", "Int", "ContinueNum"), f("b", "String", "ArrayString(,)"), f("c", "String", "KVNum(,)[:]"), f("d", "String", "SplitID")]}}})
    (tmp_path / "x.tsv").write_text("1\tp,q\tu:1,v:2\tz\n")
    raw = sources.read_table(spark, str(tmp_path / "x.tsv"), "tsv", s, "m")
    r = sources.encode(raw, s, "m").first()
    assert r.a == 1 and r.b == ["p", "q"] and [(x.key, x.value) for x in r.c] == [("u", 1.0), ("v", 2.0)] and "d" not in r
    (tmp_path / "x.libsvm").write_text("1 1:0.5 3:2\n0 2:1\n")
    assert sources.read_table(spark, str(tmp_path / "x.libsvm"), "libsvm").count() == 2
    kept = sources.cache(main, f"file://{tmp_path}/cache?format=archive")
    assert kept.count() == len(MAIN) and sources.cached_bytes(kept) > 0
    sources.write_split(main.where("id < 4"), main.where("id >= 4"), f"file://{tmp_path}/s")
    assert spark.read.parquet(f"file://{tmp_path}/s/test").count() == 5
    sources.write_artifacts(spark, f"file://{tmp_path}/art", CONFIG, "original(t1.c1)\nmulti_sum(t1,t2.c2,32d:100:0s)")
    assert "column_stage" in spark.read.text(f"file://{tmp_path}/art").first()[0]
    spark.sql(f"CREATE TABLE created (x INT) USING parquet LOCATION '{tmp_path}/created'")
    spark.sql("DROP TABLE created")


def test_streaming_serves_micro_batches(spark, tmp_path, star):
    from starloom.streaming import serve

    config = {"target_entity": "m", "target_entity_index": "id", "entity_detail": {"m": {"features": [{"id": "m.id", "feature_type": "int"}, {"id": "m.k", "feature_type": "string"}, {"id": "m.v", "feature_type": "double", "data_type": "ContinueNum"}]}}}
    main = star[0].select("id", "k", "v")
    main.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(main.schema).parquet(f"{tmp_path}/in")
    serve(stream, config, "add(m.v,m.v)", dict, "m", f"{tmp_path}/out", f"{tmp_path}/check", names=["x"]).awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(MAIN)


@pytest.fixture(scope="module")
def learn(spark):
    rng = random.Random(1)
    data = []
    for i in range(3000):
        x, c, noise = rng.random(), rng.choice("abc"), rng.random()
        data.append((i, x if rng.random() > 0.05 else None, c, noise, int(x + (c == "a") * 0.6 + rng.gauss(0, 0.15) > 0.8), float(np.exp(3 * x))))
    return spark.createDataFrame(data, "id int, x double, c string, noise double, y int, z double").repartition(4).persist()


def test_auc_is_exact(spark):
    rng = random.Random(2)
    data = [(round(rng.random(), 2), rng.randrange(2)) for _ in range(400)]
    want = np.mean([(p > n) + 0.5 * (p == n) for p, y in data if y for n, z in data if not z])
    assert auc(spark.createDataFrame(data, "s double, y int"), "s", "y") == pytest.approx(want)
    assert auc(spark.createDataFrame([(0.5, 1)], "s double, y int"), "s", "y") is None


def test_gbm_first_tree_matches_numpy_and_round_trips(spark, learn, tmp_path):
    config = TreeConfig("y", ["x", "noise"], ["c"], trees=4, max_depth=3, max_bins=20)
    model = GBM.fit(learn, config, f"file://{tmp_path}/g")
    root = model.trees[0][0]
    rows = [(r.x, r.noise, r.c, r.y) for r in learn.collect()]
    share = np.mean([r[3] for r in rows])
    best = 0
    for left in [[r[0] is None or r[0] <= c for r in rows] for c in model.cuts["x"]] + [[r[0] is not None and r[0] <= c for r in rows] for c in model.cuts["x"]] + [[r[2] != c for r in rows] for c in "abc"]:
        g, h = np.array([share - r[3] for r in rows]), share * (1 - share)
        left = np.array(left)
        parts = [(g[m].sum(), h * m.sum()) for m in (left, ~left, left | True)]
        gain = sum(s * a * a / (b + 1e-6) for s, (a, b) in zip((1, 1, -1), parts))
        best = max(best, gain)
    assert root.gain == pytest.approx(best, rel=1e-9) and root.n == len(rows)
    one = GBM(config, model.cuts, model.categories, model.trees[:1], model.bias)
    first, last = (binary_metrics(m.predict(learn), "prediction", "y") for m in (one, model))
    assert last["logloss"] < first["logloss"] and last["auc"] > 0.9
    again = GBM.loads(model.dumps())
    both = model.predict(learn).select("id", F.col("prediction").alias("p")).join(again.predict(learn).select("id", "prediction"), "id")
    assert both.where("p <> prediction").count() == 0
    model.save(spark, f"file://{tmp_path}/m")
    batch_predict(spark, f"file://{tmp_path}/m", "gbm", learn, f"file://{tmp_path}/p", ["id"])
    assert spark.read.text(f"file://{tmp_path}/p").count() == 3000


def test_linear_models(spark, learn, tmp_path):
    config = LinearConfig("y", ["x", "noise"], ["c"], max_iter=10)
    model = LinearModel.fit(learn, config)
    assert model.evaluate(learn)["auc"] > 0.9 and model.effective_features() > 0
    model.save(f"file://{tmp_path}/l")
    again = LinearModel.load(f"file://{tmp_path}/l")
    assert again.evaluate(learn)["auc"] == pytest.approx(model.evaluate(learn)["auc"])
    linked = choose_link(learn, learn, LinearConfig("z", ["x"], [], "regression", buckets=(), max_iter=10))
    assert linked.config.link == "log1p"
    assert fit_until_worse(learn, learn, config, (1, 4)).config.max_iter in (1, 4)
    found = random_search(learn, learn, config, {"lambda_2": Range(1e-4, 10, "log")}, 3)
    assert len(found) == 3 and found[0]["score"] >= found[-1]["score"]
    assert drop_rare(learn, ["c"], 10**6).where("c IS NOT NULL").count() == 0


def test_slotwise_scores_rank_the_signal(learn):
    base = learn.withColumn("base", F.lit(0.0))
    got = {r.feature: r.score for r in slotwise_scores(base, base, ["x", "noise"], ["c"], "base", "y", buckets=20).collect()}
    assert got["x"] > got["c"] > got["noise"] and got["x"] > 0.75
    got = {r.feature: r.score for r in slotwise_scores(base, base, ["x", "noise"], [], "base", "z", "regression", buckets=20).collect()}
    assert got["x"] > got["noise"]


def test_search_finds_a_planted_product(spark):
    rng = random.Random(3)
    data = []
    for i in range(1500):
        a, b = rng.uniform(-1, 1), rng.uniform(-1, 1)
        data.append((i, rng.choice("uvw"), i, a, b, int(a * b > 0)))
    df = spark.createDataFrame(data, "id int, k string, t int, a double, b double, y int").withColumn("t", F.timestamp_seconds("t"))
    f = lambda n, t, d: {"id": f"m.{n}", "feature_type": t, "data_type": d}
    schema = load_schema({"target_entity": "m", "target_entity_index": "id", "target_pivot_timestamp": "t", "target_label": "y", "entity_detail": {"m": {"features": [f("id", "int", "SplitID"), f("k", "string", "SingleString"), f("t", "timestamp", "Timestamp"), f("a", "double", "ContinueNum"), f("b", "double", "ContinueNum"), f("y", "int", "DiscreteLabel")]}}})
    search = FeatureSearch(schema, {"m": df}, SearchConfig("y", windows=["10:0"], rebase_rounds=1, select=(1, 4), hot_share=0.6))
    assert "multiply(m.a,m.b)" in [c.op for c in search.run()][:3]
    assert limits(10) == 5000 and limits(10**8) == 100 and len(combinations(["a", "b"], ["c", "d", "e"], ["t"], 3)) == 1


def test_queries_and_oracles_share_names():
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 80


def test_ftrl_learns_stops_and_erases(spark):
    import math
    import random

    from starloom.ml.ftrl import FTRL, FTRLConfig

    rng = random.Random(4)
    rows = []
    for i in range(6000):
        x, c = rng.uniform(0, 10), rng.choice("abcd")
        p = 1 / (1 + math.exp(-(x - 5 + {"a": 2, "b": 1, "c": -1, "d": -2}[c])))
        rows.append((i, x if i % 50 else None, c, f"rare{i}", int(rng.random() < p)))
    df = spark.createDataFrame(rows, "id long, x double, c string, r string, y int").repartition(4, "id")
    train, valid = df.where("id % 5 > 0"), df.where("id % 5 = 0")
    config = FTRLConfig("y", ["x"], ["c", "r"], max_iter=6, least_show=5.0, decay=0.5, buckets=(10,))
    model = FTRL.fit(train, valid, config)
    assert model.evaluate(valid)["auc"] > 0.85 and 1 <= len(model.history) <= 6
    assert model.effective_features() < 40  # rare values are erased
    again = FTRL.loads(model.dumps())
    a, b = ({r.id: r.prediction for r in m.predict(valid).collect()} for m in (model, again))
    assert a == b and all(0 < p < 1 for p in a.values())
    sparse = FTRL.fit(train, valid, FTRLConfig("y", ["x"], ["c"], lambda_1=30.0, max_iter=4, buckets=(10,)))
    assert sparse.effective_features() < FTRL.fit(train, valid, FTRLConfig("y", ["x"], ["c"], max_iter=4, buckets=(10,))).effective_features()
    line = FTRL.fit(train, valid, FTRLConfig("x", [], ["c"], "regression", alpha=1.0, max_iter=8))
    assert line.evaluate(valid)["mse"] < 12


def test_search_context_and_windows():
    from starloom.ml.search import Candidate, Context, best_windows, limits, list_candidates, several
    from starloom.plans.schema import load_schema

    x = Context({None: 0.5, "a": 0.5, "b": 0.8, "c": 0.6, "d": 0.8}, {"many": 30, "few": 5})
    assert x.useless("a") and x.useless("unknown") and not x.useless("c") and x.rank("b") == x.rank("d") == 0.8 and x.rank("c") == 0.4
    assert x.combinable("b", "few") and not x.combinable("b", "many") and not x.combinable("few", "few")
    scored = [Candidate(f"multi_avg(m,s.v,{w})", True, v) for w, v in (("1d:1:0s", 0.7), ("2d:1:0s", 0.9), ("3d:1:0s", 0.9), ("4d:1:0s", 0.8))] + [Candidate("multi_max(m,s.v,1d:1:0s)", True, 0.1), Candidate("multi_direct(m,t.x)", True, 0.2), Candidate("multi_direct(m,t.y)", True, 0.2)]
    assert [c.op for c in best_windows(scored, 2)] == ["multi_avg(m,s.v,2d:1:0s)", "multi_avg(m,s.v,4d:1:0s)", "multi_direct(m,t.x)", "multi_direct(m,t.y)", "multi_max(m,s.v,1d:1:0s)"]
    f = lambda n, k: {"id": f"m.{n}", "feature_type": "string", "data_type": k}
    schema = load_schema({"target_entity": "m", "entity_detail": {"m": {"features": [f("c", "SingleString"), f("few", "ArrayString(,)"), f("many", "KVString(,)[:]")]}}})
    assert several(schema) == {"few": "split(m.few,44)", "many": "split_key(m.many,44,58)"}
    assert [c.op for c in list_candidates(["c"], several(schema), "m", x)] == ["isin(m.c,split(m.few,44))", "combine(split(m.few,44),m.c)", "isin(m.c,split_key(m.many,44,58))"]
    assert [limits(n) for n in (1e6, 5e6, 2e7, 1e8)] == [5000, 1000, 500, 100]


def test_row_index_and_shuffle(spark):
    from starloom.operators import prep

    df = spark.createDataFrame([(i % 7, "x") for i in range(500)], "k long, v string")
    got = sorted((r.k, r.row_index) for r in prep.assign_index(df).collect())
    assert [i for _, i in got] == list(range(500))
    dealt = prep.shuffled(spark.range(4000), 8, "id")
    parts = [len(p) for p in dealt.rdd.glom().collect()]
    assert len(parts) == 8 and max(parts) < 2 * min(parts) and sorted(r.id for r in dealt.collect()) == list(range(4000))


def test_scratch_folders_are_shared_on_clusters(spark):
    from starloom.sources.tables import shared_folder

    class Cluster:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"

    import pytest

    with pytest.raises(RuntimeError):
        shared_folder(Cluster)
    assert shared_folder(spark)


def test_resources_of_large_tables_are_not_cut(spark, monkeypatch):
    """Four waves of four cores work off all partitions, as in the query's SQL, however many executors that takes."""
    from starloom import queries_more

    rows = {"orders": 20_000_000, "customer": 2_000_000, "lineitem": 80_000_000}
    monkeypatch.setattr(queries_more, "read", lambda spark, sf_dir, table: spark.range(rows[table]))
    r = QUERIES["resources"](spark, "").first()
    assert r.executors == -(-r.shuffle_partitions // 16) > 1000


def _odd_rows(spark):
    rng = random.Random(5)
    data = [(i, rng.choice([None, "a", "b", "b"]), None if rng.random() < 0.05 else rng.randrange(200), rng.choice([None, "x", "y", "z", "y"]), None if rng.random() < 0.1 else rng.choice([1e300, float("nan"), 0.1, 2.5, -7.0])) for i in range(400)]
    return data, spark.createDataFrame(data, "id int, k string, s int, c string, v double").withColumn("t", F.timestamp_seconds("s"))


@pytest.mark.parametrize("sliced", [False, True])
def test_equal_values_are_counted_without_lists(spark, sliced):
    """F5-F8: count and ratio make no lists, so none travel through sorts, and are right where caps and bounds both bind."""
    data, df = _odd_rows(spark)
    frames = {"cap": ("50s:7:0s", 50, 0, 7), "late": ("60s:5:20s", 60, 20, 5), "open": ("60s:2147483647:20s", 60, 20, 10**9)}
    out = window_features(df, ["k"], "t", [WindowFeature(f"{n}_{a}", a, "c", parse_frame(w[0])) for n, w in frames.items() for a in ("count", "ratio")], ("id",), "golden", sliced)
    assert "collect_list" not in plan(out)
    got = {r.id: r for r in out.collect()}
    assert len(got) == len(data)
    for i, k, s, c, _ in data:
        if s is None:
            continue
        rows = sorted((x for x in data if x[1] == k and x[2] is not None), key=lambda x: (x[2], x[0]))
        for n, (_, high, low, cap) in frames.items():
            seen = [x for x in rows if ((x[2], x[0]) <= (s, i) if low == 0 else x[2] <= s - low)]
            inside = [x[3] for x in seen[-cap:] if x[2] >= s - high and x[3] is not None]
            want = None if c is None else inside.count(c)
            assert got[i][f"{n}_count"] == want, (i, n)
            assert got[i][f"{n}_ratio"] == (want / len(inside) if c is not None and inside else None), (i, n)


def test_sliced_frames_take_linear_time_and_lose_nothing(spark):
    """no frame with a moving start, whose time is the square of a dense slice, and no cancellation; a row without a time counts once."""
    data, df = _odd_rows(spark)
    frames = {"now": ("60s:2147483647:0s", 60, 0), "late": ("60s:2147483647:20s", 60, 20)}
    out = window_features(df, ["k"], "t", [WindowFeature(f"{n}_{a}", a, "v", parse_frame(w[0])) for n, w in frames.items() for a in ("sum", "avg", "min", "max")], ("id",), "golden", True)
    assert plan(out).count("RangeFrame, unboundedpreceding$(), currentrow$()") == plan(out).count("specifiedwindowframe(")
    order = lambda x: (x != x, 0.0 if x != x else x)  # noqa: E731  NaN is over all numbers
    for r in out.collect():
        _, k, s, _, _ = data[r.id]
        for n, (_, high, low) in frames.items():
            inside = [x[4] for x in data if x[1] == k and x[4] is not None and (x[2] is None if s is None else x[2] is not None and s - high <= x[2] <= s - low)]
            want = (sum(inside), sum(inside) / len(inside), min(inside, key=order), max(inside, key=order)) if inside else (None,) * 4
            for a, w in zip(("sum", "avg", "min", "max"), want):
                assert r[f"{n}_{a}"] == (w if w is None else pytest.approx(w, rel=1e-12, abs=1e-9, nan_ok=True)), (r.id, n, a)


def test_bins_by_search_are_those_of_counting(spark):
    """bins come from a binary search, with no loop over the cuts in the plan, and are those counted plainly."""
    from starloom.ml.linear import with_bins

    values = [None, float("nan"), float("inf"), float("-inf"), -0.0, 0.0, 1.0, 1.5, 2.0, 2.5, -7.0, 1e300]
    cuts = {"a": [-1.0, 0.0, 1.0, 2.0], "b": [], "c": [-0.0], "d": [float("-inf"), 2.0, float("inf")]}
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    out = with_bins(df, {k: ("v", c) for k, c in cuts.items()})
    want = lambda v, c: None if v is None else len(c) if v != v else sum(x < v for x in c)
    for r in out.collect():
        assert [r[k] for k in cuts] == [want(values[r.i], c) for k, c in cuts.items()], r
    assert out.columns == ["i", "v", *cuts] and "aggregate" not in plan(with_bins(df, {"a": ("v", cuts["a"])})).lower()


def test_a_capped_frame_is_listed_once(spark, sf):
    """all features of a capped frame share one list, which the search's many candidates would each collect again."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    features = [WindowFeature(f"{a}{c}", a, c, parse_frame("7d:20:0s")) for c in ("value", "user_id") for a in ("sum", "avg", "min", "max", "unique_count")]
    assert plan(window_features(e, ["event_type"], "ts", features, ("event_id",))).count("collect_list(") == 1
