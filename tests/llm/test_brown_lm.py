"""The class-based model's scores against plain arithmetic, and its exchange against recounting."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelag.llm import brown_lm

SCHEMA = "doc_id long, text string"


def corpus(n=150):
    r = random.Random(8)
    nouns, verbs = [f"noun{i}" for i in range(400)], [f"verb{i}" for i in range(300)]
    return [(i, " ".join(w for _ in range(r.randint(0, 25)) for w in (r.choice(nouns), r.choice(verbs)))) for i in range(n)]


@pytest.mark.parametrize("sent", [300_000, 300])
def test_scores_equal_plain_arithmetic(spark, monkeypatch, sent):
    rows = [*corpus(), (500, None), (501, "Noun1 NEVER seen"), (502, ""), (3, "a repeated key"), (None, "noun1 verb1"), (503, "long " * 4000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    taken, cut = [], brown_lm.frequent_words
    train = brown_lm.train
    monkeypatch.setattr(brown_lm, "frequent_words", lambda counts: cut(counts, sent))
    monkeypatch.setattr(brown_lm, "train", lambda counts, coded, frequent, types: taken.append((train(counts, coded, frequent, types), frequent.value)) or taken[-1][0])
    got = brown_lm.score(docs).collect()
    (model, frequent), = taken
    assert len(got) == len(rows) and (sent == 300) == (len(frequent.place) < 400)
    tokens = [(i, re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())) for i, t in rows]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter(w for i, t in tokens if not out(i) for w in t)
    classes = {w: int(model.classes[frequent.ids([w.encode()])[0]]) for _, t in tokens for w in t}
    end = int(model.classes[-1])
    size, kinds, pairs = Counter(), Counter(), Counter()
    for w, c in count.items():
        size[classes[w]] += c
        kinds[classes[w]] += 1
    for i, t in tokens:
        if not out(i):
            row = [end, *[classes[w] for w in t], end]
            pairs.update(zip(row, row[1:], strict=False))
    k, total = len(model.bigram), sum(pairs.values())
    into, left = Counter(), Counter()
    for (a, b), n in pairs.items():
        into[b] += n
        left[a] += n

    def move(a, b):
        base = (into[b] + 1) / (total + k)
        if not left[a]:
            return base
        spared = sum(min(n, brown_lm.DISCOUNT) for (x, _), n in pairs.items() if x == a) / left[a]
        return max(pairs[a, b] - brown_lm.DISCOUNT, 0) / left[a] + spared * base

    def emit(w):
        c = classes[w]
        if count[w]:
            return (count[w] - brown_lm.DISCOUNT) / size[c]
        return brown_lm.DISCOUNT * kinds[c] / size[c] if size[c] else 1.0

    want = []
    for i, t in tokens:
        row = [end, *[classes[w] for w in t], end]
        s = sum(math.log10(move(a, b)) for a, b in zip(row, row[1:], strict=False)) + sum(math.log10(emit(w)) for w in t)
        want.append((i, out(i), len(t) + 1, round(s, 6)))
    key = lambda r: (r[0] is None, r[0] or 0, r[3])
    assert sorted(((r["doc_id"], bool(r["held_out"]), r["n_tokens"], round(r["score"], 6)) for r in got), key=key) == sorted(((i, bool(o), n, pytest.approx(s, abs=1e-5)) for i, o, n, s in want), key=lambda r: (r[0] is None, r[0] or 0, r[3].expected))


def test_words_move_to_the_class_of_their_kind(spark):
    rows = corpus(400)
    docs = spark.createDataFrame(rows, SCHEMA)
    counts = brown_lm.word_counts(docs, "text").cache()
    frequent = spark.sparkContext.broadcast(brown_lm.frequent_words(counts))
    coded = brown_lm.encoded(docs, "doc_id", "text", frequent).withColumn("learned", F.lit(True)).cache()
    r = np.random.default_rng(2)
    words = list(frequent.value.place)
    before = np.array([(0 if w.startswith(b"noun") else 1) if r.random() < 0.8 else 2 for w in words] + [3] * brown_lm.SPELLINGS + [3])
    of = spark.sparkContext.broadcast(before)
    g = brown_lm.neighbours(coded, of, frequent.value.end, 4)
    assert g.sum() == sum(len((t or "").split()) + 1 for _, t in rows)
    after = brown_lm.exchange_words(coded, frequent, of, g.astype(float))
    right = [c == (0 if w.startswith(b"noun") else 1) for w, c in zip(words, after, strict=False)]
    assert np.mean(right) > 0.97 and after[-1] == 3


@pytest.mark.parametrize("gathered", [50, 4_000_000])
def test_words_move_at_once_as_one_by_one(monkeypatch, gathered):
    monkeypatch.setattr(brown_lm, "GATHERED", gathered)
    r = np.random.default_rng(5)
    k, words = 9, 120
    p = 1 / np.arange(1, words + 1)
    row = np.repeat(r.choice(words, 4000, p=p / p.sum()), r.integers(1, 3, 4000))  # some follow themselves
    of = np.array([*r.integers(0, k - 1, words - 1), k - 1, 0])  # the last word is the end, one more never occurs
    g, table = np.zeros((k, k)), np.zeros((words + 1, 2 * k + 1), dtype=np.int64)
    np.add.at(g, (of[row[:-1]], of[row[1:]]), 1)
    np.add.at(table, (row[:-1], of[row[1:]]), 1)
    np.add.at(table, (row[1:], k + of[row[:-1]]), 1)
    np.add.at(table, (row[:-1][row[:-1] == row[1:]], 2 * k), 1)
    want = []
    for t, a in zip(table.astype(float), of.tolist(), strict=True):
        to, fro, own, left = t[:k].copy(), t[k : 2 * k].copy(), t[-1], g.copy()
        to[a] -= own
        fro[a] -= own
        left[a] -= to
        left[:, a] -= fro
        left[a, a] -= own
        gain = brown_lm.gains(left, to, fro, own, to.sum() + own, fro.sum() + own)
        gain[k - 1] = -np.inf
        want.append(int(np.argmax(gain)) if gain.max() > gain[a] + 1e-9 else a)
    got = brown_lm.best_classes(table, of, g)
    assert got.tolist() == want and (got != of).sum() > 60


def test_blocks_of_words_move_in_one_job(spark, monkeypatch):
    monkeypatch.setattr(brown_lm, "CONTEXT_WORDS", 32)
    docs = spark.createDataFrame(corpus(), SCHEMA)
    frequent = spark.sparkContext.broadcast(brown_lm.frequent_words(brown_lm.word_counts(docs, "text")))
    coded = brown_lm.encoded(docs, "doc_id", "text", frequent).withColumn("learned", F.lit(True)).cache()
    of = spark.sparkContext.broadcast(np.array([i % 3 for i in range(len(frequent.value.place) + brown_lm.SPELLINGS)] + [3]))
    g = brown_lm.neighbours(coded, of, frequent.value.end, 4)
    assert len(frequent.value.place) > 20 * 32
    try:
        spark.sparkContext.setJobGroup("moves", "moves")
        brown_lm.exchange_words(coded, frequent, of, g.astype(float))
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("moves")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 3  # the shuffle's stages, not one a block
