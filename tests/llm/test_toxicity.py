"""Toxicity severity against plain arithmetic, and on rows that the fit never saw."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelag.llm import queries, toxicity


def corpus(seed, n):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        w = r.choices([f"plain{k}" for k in range(200)], k=30) + r.choices(["vile", "scum", "filth"], k=r.randint(1, 6) if bad else 0)
        r.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return rows, labels


def test_op1_equals_plain_arithmetic(spark, tmp_path):
    rows, labels = corpus(3, 240)
    rows += [(900, None), (901, ""), (902, "123 456"), (903, "VILE vile " * 2000), (903, "VILE vile " * 2000), (None, "scum")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries.op1_toxicity(spark, str(tmp_path)).collect()
    model = toxicity.train(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    texts = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        counts = Counter(zlib.crc32(w.encode()) % toxicity.BUCKETS for w in re.findall(r"[^\W\d_]+", (texts[r["doc_id"]] or "").lower()))
        s = sum(math.log1p(n) * model.weights[b] for b, n in counts.items())
        above = [1 / (1 + math.exp(t - s)) for t in model.thresholds]
        shares = [1 - above[0], above[0] - above[1], above[1]]
        assert r["expected_severity"] == pytest.approx(sum(above)) and r["grade"] == int(np.argmax(shares)) and r["toxic"] == (bool(counts) and above[0] > model.cutoff)
    flags = {r["doc_id"]: r["toxic"] for r in got}
    assert not flags[900] and not flags[902] and flags[903]


def test_held_out_rows_and_repeats(spark):
    rows, labels = corpus(4, 400)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame(labels[:300], "doc_id long, toxic int"))
    again = toxicity.train(docs.repartition(7), spark.createDataFrame(labels[:300], "doc_id long, toxic int"))
    assert np.array_equal(model.weights, again.weights) and np.all(np.diff(model.thresholds) > 0)
    flagged = {r[0] for r in docs.where("doc_id >= 300").select("doc_id", toxicity.severity(F.col("text"), model).alias("s")).where("s.toxic").select("doc_id").collect()}
    assert flagged == {i for i, bad in labels[300:] if bad}


def test_the_fit_is_a_maximum_of_the_likelihood():
    r = np.random.default_rng(1)
    texts = [(np.sort(r.choice(12, size=5, replace=False)).astype(np.int64), np.log1p(r.integers(1, 4, size=5))) for _ in range(200)]
    y = r.integers(0, 3, size=200)
    rows = toxicity.Rows.of(texts)
    model = toxicity.fit(rows, y, steps=600)
    scale = toxicity.association(rows.col, rows.row, 12, y > 0)

    def loss(w, t):
        s = np.array([sum(x * w[b] for b, x in zip(at, v, strict=True)) for at, v in texts])
        below = 1 / (1 + np.exp(s[:, None] - np.array([-np.inf, *t, np.inf])[None, :]))
        w = np.where(scale > 0, w / np.maximum(scale, 1e-12), 0)
        return -np.log((below[np.arange(200), y + 1] - below[np.arange(200), y])).mean() + 5e-4 * (w**2).sum()

    w, t = model.weights[:12], model.thresholds
    best = loss(w, t)
    for i in range(12):
        for d in (-0.05, 0.05):
            step = np.zeros(12)
            step[i] = d * max(scale[i], 0.05)
            assert loss(w + step, t) > best - 1e-5
    assert loss(w, t + 0.05) > best and loss(w, t - 0.05) > best
