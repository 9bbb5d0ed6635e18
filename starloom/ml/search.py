"""Feature search: candidate programs for windows, joins and combinations, scored slot by slot against a base model.

Stages: base model; scores of the single columns (a context: which are useless, which may be combined); joined side values, of
which the best windows of each column are kept; windows over the main table; one, two and three-way combinations; rebasing (the
remaining candidates are scored again on top of the selected ones). Each round is one program, so its candidates share scans.
"""

from __future__ import annotations

import itertools
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import split
from ..operators.prep import hot_keys, max_lengths, time_gaps, validation_split
from ..plans.frames import candidate_windows, from_config, seconds
from ..plans.planner import compile_program
from ..plans.schema import Column, Schema
from ..sources.tables import cache, shared_folder
from .linear import LinearConfig, LinearModel
from .scorer import slotwise_scores


@dataclass
class SearchConfig:
    label: str
    task: str = "binary"
    test_ratio: float = 0.2
    windows: list[str] = field(default_factory=list)
    window_candidates: tuple[str, ...] = ("2h", "10h", "2d", "7d", "14d", "32d", "64d", "366d")
    default_windows: tuple[str, ...] = ()
    delay: str = "0s"
    #: None: by the table's rows, see limits().
    temporal_limit: int | None = None
    combine_limit: int | None = None
    joined_per_column: int = 2
    batch: int = 300
    rebase_limit: int = 500
    rebase_rounds: int = 2
    top: int = 30
    select: tuple[int, int] = (6, 18)
    hot_share: float = 0.1
    disabled: tuple[str, ...] = ()


@dataclass
class Candidate:
    op: str
    numeric: bool
    score: float = 0.0


def limits(rows: int) -> int:
    """How many temporal, and how many combined, candidates a table of that many rows is searched for."""
    return 5000 if rows < 2e6 else 1000 if rows < 1e7 else 500 if rows < 5e7 else 100


@dataclass
class Context:
    """What the single columns are worth. scores: raw, with the score of a constant under None; lengths: most values a row has."""

    scores: dict[str | None, float]
    lengths: dict[str, int]

    def __post_init__(self):
        place = {v: i / len(self.scores) for i, v in enumerate(sorted(self.scores.values()))}
        self.ranks = {k: place[v] for k, v in self.scores.items()}

    def rank(self, name: str) -> float:
        """From 0 to 1 (exclusive): the share of scores below the column's; equal scores share the highest of their ranks."""
        return self.ranks.get(name, 0.0)

    def useless(self, name: str) -> bool:
        """Whether a column tells as much as a constant."""
        return name not in self.scores or self.ranks[name] == self.ranks[None]

    def combinable(self, a: str, b: str) -> bool:
        """Whether the pairs of two columns' values are some, but not many."""
        return 1 <= self.lengths.get(a, 1) * self.lengths.get(b, 1) <= 20


def best_windows(candidates: list[Candidate], most: int) -> list[Candidate]:
    """Of the candidates that differ in their window only, those with the best scores; equal scores count once."""
    out, seen = [], {}
    for c in sorted(candidates, key=lambda c: (-c.score, c.op)):
        scores = seen.setdefault(c.op.rpartition(",")[0] if c.op.startswith("multi_") and c.op.count(",") > 1 else c.op, [])
        if c.score not in scores and len(scores) < most:
            scores.append(c.score)
            out.append(c)
    return out


def several(schema: Schema) -> dict[str, str]:
    """Multi-valued main columns, each with the program of its list of values."""
    out, t = {}, schema.target
    for c in schema.tables[t]:
        if c.kind == "multi":
            codes = ",".join(str(ord(x)) for x in c.separators)
            out[c.name] = f"{'split' if len(c.separators) == 1 else 'split_key'}({t}.{c.name},{codes})"
    return out


def list_candidates(categories: list[str], lists: dict[str, str], target: str, context: Context, disabled: tuple[str, ...] = ()) -> list[Candidate]:
    """Membership of a category in a list, and its combinations with the list's values where these are few."""
    out = []
    for a, (name, values) in itertools.product(categories, lists.items()):
        out.append(Candidate(f"isin({target}.{a},{values})", True))
        if context.combinable(a, name):
            out.append(Candidate(f"combine({values},{target}.{a})", False))
    return [c for c in out if c.op.partition("(")[0] not in disabled]


def temporal_candidates(schema: Schema, keys: list[str], windows: list[str], disabled: tuple[str, ...] = ()) -> list[Candidate]:
    out = []
    for key, w in itertools.product(keys, windows):
        for c in schema.tables[schema.target]:
            if c.name == key:
                continue
            aggs = ("sum", "avg", "max", "min") if c.kind == "numeric" else ("top1_ratio", "count", "unique_count") if c.kind == "category" else ()
            t = schema.target
            out += [Candidate(f"window_{a}({t}.{schema.pivot_time},{t}.{key},{from_config(w)},{t}.{c.name})", True) for a in aggs if f"window_{a}" not in disabled]
    return out


def join_candidates(schema: Schema) -> list[Candidate]:
    out, t = [], schema.target
    for r in schema.relations:
        for c in schema.tables[r.to_entity]:
            if c.kind not in ("numeric", "category", "time") or c.name in r.to_keys:
                continue
            if r.type == "1-1":
                out.append(Candidate(f"multi_direct({t},{r.to_entity}.{c.name})", c.kind == "numeric"))
            elif r.type == "SLICE":
                out += [Candidate(f"multi_last_value({t},{r.to_entity}.{c.name},{from_config(w)})", c.kind == "numeric") for w in r.windows or ("2147483645:0",)]
            else:
                aggs = ("avg", "max", "min") if c.kind == "numeric" else ("unique_count", "top3frequency") if c.kind == "category" else ()
                out += [Candidate(f"multi_{a}({t},{r.to_entity}.{c.name},{from_config(w)})", a != "top3frequency") for w in r.windows for a in aggs]
    return out


def combinations(numbers: list[str], categories: list[str], times: list[str], ways: int, top: int = 30, disabled: tuple[str, ...] = ()) -> list[Candidate]:
    """Candidates of one, two or three arguments (which are themselves programs)."""
    out: list[Candidate] = []
    if ways == 1:
        out += [Candidate(f"log({x})", True) for x in numbers]
        out += [Candidate(f"{f}({x})", False) for x in times for f in ("isweekday", "dayofweek", "hourofday")]
    if ways == 2:
        for a, b in itertools.combinations(numbers, 2):
            out += [Candidate(f"{f}({a},{b})", True) for f in ("add", "subtract", "multiply", "divide")]
            out += [Candidate(f"{f}({b},{a})", True) for f in ("subtract", "divide")]
        out += [Candidate(f"combine({a},{b})", False) for a, b in itertools.combinations(categories, 2)]
    if ways == 3:
        for x in itertools.combinations(numbers[:top], 3):
            out += [Candidate(f"{f}({','.join(x)})", True) for f in ("add", "multiply")]
        out += [Candidate(f"combine({','.join(x)})", False) for x in itertools.combinations(categories[:top], 3)]
    return [c for c in out if c.op.partition("(")[0] not in disabled]


def partition_keys(df: DataFrame, schema: Schema, hot_share: float) -> list[str]:
    """Single categories that are neither constant nor unique and have no value with more than hot_share of the rows."""
    columns = [c.name for c in schema.tables[schema.target] if c.kind == "category"]
    if not columns:
        return []
    n = df.count()
    r = df.agg(*(F.approx_count_distinct(c).alias(c) for c in columns)).first()
    return [c for c in columns if 1 < r[c] < 0.95 * n and not hot_keys(df.where(F.col(c).isNotNull()), c, hot_share).head(1)]


class FeatureSearch:
    def __init__(self, schema: Schema, tables: dict[str, DataFrame], config: SearchConfig):
        self.schema, self.tables, self.config = schema, tables, config
        self.selected: list[Candidate] = []
        self.tried: list[Candidate] = []

    def _frame(self, candidates: list[Candidate], base: LinearModel | None, extra: list[str]) -> DataFrame:
        t, s = self.schema.target, self.schema
        program = [c.op for c in candidates] + [f"original({t}.{c.name})" for c in s.tables[t] if c.kind in ("numeric", "category")]
        names = [f"c{i}" for i in range(len(candidates))] + [c.name for c in s.tables[t] if c.kind in ("numeric", "category")]
        keep = [x for x in dict.fromkeys([s.index, s.pivot_time, self.config.label, *extra]) if x and x not in names]
        return compile_program(s, "\n".join(program), self.tables, names=names, keep=keep)

    def _kept(self, df: DataFrame) -> DataFrame:
        """df written once, as fitting and scoring read it several times."""
        return cache(df, f"{shared_folder(df.sparkSession)}/search-{uuid.uuid4().hex[:12]}")

    def _columns(self) -> tuple[list[Column], list[Column]]:
        own = [c for c in self.schema.tables[self.schema.target] if c.name not in (self.schema.index, self.config.label)]
        return [c for c in own if c.kind == "numeric"], [c for c in own if c.kind == "category"]

    def _score(self, candidates: list[Candidate], base: LinearModel, selected: list[Candidate]) -> list[Candidate]:
        out = []
        for at in range(0, len(candidates), self.config.batch):
            part = candidates[at : at + self.config.batch]
            df = self._frame(part + selected, base, [])
            df = self._kept(base.predict(df.withColumnsRenamed({f"c{len(part) + i}": f"s{i}" for i in range(len(selected))})))
            train, valid = validation_split(df, self.schema.pivot_time, self.config.test_ratio)
            numbers = [f"c{i}" for i, c in enumerate(part) if c.numeric]
            others = [f"c{i}" for i, c in enumerate(part) if not c.numeric]
            scores = {r.feature: r.score for r in slotwise_scores(train, valid, numbers, others, "logit", self.config.label, self.config.task).collect()}
            out += [Candidate(c.op, c.numeric, scores[f"c{i}"]) for i, c in enumerate(part) if scores.get(f"c{i}") is not None]
        return sorted(out, key=lambda c: (-c.score, c.op))

    def _base(self, selected: list[Candidate]) -> LinearModel:
        numbers, categories = self._columns()
        df = self._kept(self._frame(selected, None, []).withColumnsRenamed({f"c{i}": f"s{i}" for i in range(len(selected))}))
        train, _ = validation_split(df, self.schema.pivot_time, self.config.test_ratio)
        config = LinearConfig(self.config.label, [c.name for c in numbers] + [f"s{i}" for i, c in enumerate(selected) if c.numeric], [c.name for c in categories] + [f"s{i}" for i, c in enumerate(selected) if not c.numeric], "binary" if self.config.task == "binary" else "regression", lambda_2=1e-3, max_iter=8)
        return LinearModel.fit(train, config)

    def context(self, base: LinearModel) -> Context:
        numbers, categories = self._columns()
        df = self._kept(base.predict(self._frame([], None, [])).withColumn("__constant", F.lit("1")))
        train, valid = validation_split(df, self.schema.pivot_time, self.config.test_ratio)
        own = [c.name for c in numbers], [c.name for c in categories]
        scores = {r.feature: r.score for r in slotwise_scores(train, valid, own[0], [*own[1], "__constant"], "logit", self.config.label, self.config.task).collect() if r.score is not None}
        lists = {c.name: c.separators for c in self.schema.tables[self.schema.target] if c.kind == "multi"}
        lengths = {}
        if lists:
            main = self.tables[self.schema.target]
            lengths = {r.feature: r.n for r in max_lengths(main.select(*(split(F.col(n), x[0]).alias(n) for n, x in lists.items())), list(lists)).collect()}
        return Context({None: scores.pop("__constant", 0.0), **scores}, lengths)

    def run(self) -> list[Candidate]:
        c, s = self.config, self.schema
        main = self.tables[s.target]
        base = self._base([])
        context = self.context(base)
        most = limits(main.count())
        joined = best_windows(self._score(join_candidates(s), base, []), c.joined_per_column) if s.relations else []
        windows = c.windows
        if not windows:
            gaps = time_gaps(main, s.pivot_time).first()
            if gaps.first is not None:
                windows = candidate_windows((gaps.least_gap or 0) / 1e6, (gaps.last - gaps.first) / 1e6, c.delay, c.window_candidates, binary=c.task == "binary")
                windows = windows if seconds(c.delay) else [*c.default_windows, *windows]
        keys = sorted((k for k in partition_keys(main, s, c.hot_share) if not context.useless(k)), key=lambda k: (-context.rank(k), k))
        temporal = self._score(temporal_candidates(s, keys, windows, c.disabled)[: c.temporal_limit or most], base, [])
        numbers, categories = self._columns()
        t = s.target
        names = [f"{t}.{x.name}" for x in numbers] + [x.op for x in joined if x.numeric][: c.top]
        groups = [f"{t}.{x.name}" for x in categories] + [x.op for x in joined if not x.numeric][: c.top]
        times = [f"{t}.{x.name}" for x in s.tables[t] if x.kind == "time"]
        good = [x.name for x in sorted(categories, key=lambda x: (-context.rank(x.name), x.name)) if not context.useless(x.name)]
        mixed = combinations(names, groups, times, 1, c.top, c.disabled) + list_candidates(good, several(s), t, context, c.disabled)
        useful = [f"{t}.{x}" for x in good] + groups[len(categories) :]
        mixed = (mixed + [x for ways in (2, 3) for x in combinations(names, useful, times, ways, c.top, c.disabled)])[: c.combine_limit or most]
        combined = self._score(mixed, base, [])
        self.tried = sorted(joined + temporal + combined, key=lambda x: (-x.score, x.op))
        pool = list({x.score: x for x in reversed(self.tried)}.values())[: c.rebase_limit]
        pool.sort(key=lambda x: (-x.score, x.op))
        for k in range(c.rebase_rounds + 1):
            take = max(1, c.select[1] // (c.rebase_rounds + 1))
            have = {x.op for x in self.selected}
            self.selected += [x for x in pool if x.op not in have][:take]
            if k == c.rebase_rounds:
                break
            base = self._base(self.selected)
            pool = self._score([x for x in pool if x.op not in {y.op for y in self.selected}], base, self.selected)
        return self.selected[: c.select[1]]
