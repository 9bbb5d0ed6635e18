"""The pipeline's stages against plain Python, one after another."""

import math
import re
import zlib
from collections import Counter

import corpus_pipeline as pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import DOC, EDGE, brute_links, plain_tiles

from starloom.llm import kernels, mixing


def words_of(text):
    return re.findall(r"[0-9a-z_ªµºÀ-ÖØ-öø-￿]+", re.sub("[\u0080-©«-´¶-¹»-¿×÷ -⁯₠-⃏←-⯿　-〿︰-﹯＀-／]", " ", (text or "").lower()))


def plain_language(data, order=4):
    """Ids of the documents whose best language has a posterior of one half at least."""
    seen = {}
    for r in data:
        if r.lang is not None and r.text and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            tree, raw = seen.setdefault(r.lang, {}), b"\n" * order + r.text.encode()
            for i in range(order, len(raw)):
                for k in range(order + 1):
                    tree.setdefault(raw[i - k : i], Counter())[raw[i]] += 1
    costs = {lang: {} for lang in seen}

    def cost(lang, context, byte):
        known = costs[lang].get((context, byte))
        if known is not None:
            return known
        bits, tried = 0.0, set()
        for k in range(order, -1, -1):
            here = {c: n for c, n in seen[lang].get(context[order - k :], {}).items() if c not in tried}
            if here:
                whole = sum(here.values()) + len(here)
                if byte in here:
                    bits -= math.log2(here[byte] / whole)
                    break
                bits -= math.log2(len(here) / whole)
                tried |= set(here)
        else:
            bits += math.log2(256 - len(tried))
        costs[lang][context, byte] = bits
        return bits

    kept = set()
    for r in data:
        if not re.search(r"[^\W\d_]", r.text or ""):
            continue
        raw = b"\n" * order + r.text.encode()
        bits = [sum(cost(lang, raw[i - order : i], raw[i]) for i in range(order, len(raw))) for lang in sorted(seen)]
        if 1 / sum(2.0 ** max(min(bits) - x, -1000) for x in bits) >= 0.5:
            kept.add(r.doc_id)
    return kept


def plain_lines(data):
    """{doc_id: text} after line dedup, without documents of which only blank lines are left."""
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    holds = {}
    for r in data:
        for x in r.text.split("\n"):
            if len(key(x)) >= 10:
                holds.setdefault(key(x), set()).add(r.doc_id)
    out = {}
    for r in data:
        lines = r.text.split("\n")
        left = [x for x in lines if len(holds.get(key(x), ())) < 2 or r.doc_id == min(holds[key(x)])]
        if len(left) == len(lines) or "\n".join(left).strip(" \t\n\x0b\x0c\r"):
            out[r.doc_id] = "\n".join(left)
    return out


def plain_clean(data, items):
    """Ids of the documents that hold less than half of every item."""
    kept = set()
    for r in data:
        text = words_of(r.text)
        grams = {tuple(text[i : i + k]) for k in range(1, 6) for i in range(len(text) - k + 1)}
        for item in items:
            w = words_of(item)
            k = min(5, len(w))
            if k and sum(tuple(w[i : i + k]) in grams for i in range(len(w) - k + 1)) * k >= len(w) / 2 and plain_tiles(w, text, k) / len(w) >= 0.5:
                break
        else:
            kept.add(r.doc_id)
    return kept


def plain_mix(data):
    """{doc_id: probability} of raking to tempered margins, cell by cell."""
    cells, of = Counter(), {}
    for r in data:
        w = words_of(r.text)
        long = Counter(x for x in w if len(x.encode()) >= 5)
        codes = {x: int(kernels.words([x])[0][0]) for x in long}
        topic = min(long, key=lambda x: (-long[x], codes[x])) if long else None
        of[r.doc_id] = (r.source, r.lang, codes[topic] % 8 if topic else -1)
        cells[of[r.doc_id]] += len(w)
    total, targets = sum(cells.values()), []
    for m in range(3):
        have = Counter()
        for c, n in cells.items():
            have[c[m]] += n
        lo, hi = 0.0, max(n**0.5 for n in have.values())
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(min(n, mid * n**0.5) for n in have.values()) < 0.5 * total else (lo, mid)
        targets.append({k: min(n, hi * n**0.5) for k, n in have.items()})
    factors = [dict.fromkeys(t, 1.0) for t in targets]
    weight = lambda c: min(1.0, math.prod(f[x] for f, x in zip(factors, c)))
    for _ in range(500):
        worst = 0.0
        for m, target in enumerate(targets):
            got = Counter()
            for c, n in cells.items():
                got[c[m]] += n * weight(c)
            for k, x in target.items():
                worst = max(worst, abs(x / got[k] - 1))
                factors[m][k] *= x / got[k]
        if worst < 1e-9:
            break
    return {d: weight(c) if cells[c] else 1.0 for d, c in of.items()}


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    names = docs.columns
    frames = [docs]
    for name, stage in pipeline.STAGES:
        frames.append(stage(spark, frames[-1], sf).cache())
        if name != "source_mix":
            assert frames[-1].columns == names
    a, b, c, d, e, f = (x.collect() for x in frames)
    assert {r.doc_id for r in b} == plain_language(a) and len(b) >= 0.95 * len(a)
    assert {r.doc_id: r.text for r in c} == plain_lines(b)
    links, group = brute_links([(r.doc_id, r.text) for r in c])
    keep = {}
    for r, g in zip(c, group):
        keep[g] = min(r.doc_id, keep.get(g, r.doc_id))
    assert sorted(r.doc_id for r in d) == sorted(keep.values())
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert {r.doc_id for r in e} == plain_clean(d, items) and len(e) < len(d)
    chance = plain_mix(e)
    uniform = {r.doc_id: r.u for r in frames[4].select("doc_id", mixing.uniform(F.col("doc_id"), 17).alias("u")).collect()}
    assert all(r.probability == pytest.approx(chance[r.doc_id], rel=1e-6) for r in f)
    assert {r.doc_id for r in f} == {k for k, p in chance.items() if uniform[k] < p} and 0 < len(f) < len(e)
    assert {r.doc_id for r in pipeline.run(spark, sf).collect()} == {r.doc_id for r in f}


def test_one_document_of_each_group_stays(spark, sf):
    rng = np.random.default_rng(2)
    word = lambda: f"w{rng.integers(5000)}"
    base = [word() for _ in range(120)]
    near = [*base[:-1], "changed"]
    other = [word() for _ in range(120)]
    data = [(7, base), (7, near), (7, other), (7, base), (7, base), (9, near), (None, base), (None, other), (11, [word() for _ in range(50)]), (12, [])]
    df = spark.createDataFrame([(i, " ".join(t), "en", "s", 1) for i, t in data], DOC).repartition(3)
    kept = pipeline.near_duplicates(spark, df, sf).collect()
    texts = [set(map(tuple, [base, near])), {tuple(other)}]
    assert [sum(tuple(r.text.split()) in t for r in kept) for t in texts] == [1, 1]
    assert Counter(r.doc_id for r in kept)[None] == 2 and {r.doc_id for r in kept} == {None, 11, 12} and len(kept) == 4


def test_pipeline_edges(spark, sf):
    left = {}
    for data in (EDGE, []):
        docs = spark.createDataFrame(data, DOC).withColumn("size", F.lit(1)).withColumn("cell", F.lit(2))
        for name, stage in pipeline.STAGES:
            docs = stage(spark, docs, sf)
            docs = spark.createDataFrame(docs.collect(), docs.schema)
            left.setdefault(name, []).append([r.doc_id for r in docs.collect()])
            assert {"size", "cell"} <= set(docs.columns)
    assert all(not x[1] for x in left.values())
    key = lambda x: (x is not None, x or 0)
    first = left["language_id"][0]
    assert not {1, 2, 7} & set(first) and len(first) <= len(EDGE) - 3  # null, empty, and without letters
    lines, groups = left["line_dedup"][0], left["near_duplicates"][0]
    assert not Counter(lines) - Counter(first) and not Counter(groups) - Counter(lines)
    assert not {5, 6} <= set(groups) and not {8, 9} <= set(groups)
    assert sorted(left["decontamination"][0], key=key) == sorted(groups, key=key)
    assert not Counter(left["source_mix"][0]) - Counter(groups)
