"""Line dedup against brute force on whole texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidelag.llm import line_dedup

SCHEMA = "doc_id long, text string"


def brute(rows, min_lines=line_dedup.MIN_LINES, min_words=line_dedup.MIN_WORDS):
    """Text, n_lines, n_removed, n_runs and longest run of each document, by comparing every pair of lines."""
    at = {i: [k for k, x in enumerate(t.split("\n")) if re.search(r"[^\x20\x09-\x0D]", x)] for i, t in rows}
    lines = {i: [t.split("\n")[k] for k in at[i]] for i, t in rows}
    out = {}
    for i, t in rows:
        own, most = lines[i], []
        for j in range(len(own)):
            best = 0
            for o, other in lines.items():
                for k in range(len(other) if o < i else j if o == i else 0):
                    n = 0
                    while j + n < len(own) and k + n < len(other) and own[j + n] == other[k + n] and (o < i or k + n < j):
                        n += 1
                    best = max(best, n)
            most.append(best)
        runs = [(j, n) for j, n in enumerate(most) if n and (j == 0 or most[j - 1] <= n)]
        runs = [(j, n) for j, n in runs if n >= min_lines or sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in own[j : j + n]) >= min_words]
        gone = {at[i][j + k] for j, n in runs for k in range(n)}
        out[i] = ("\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone), len(own), len(gone), len(runs), max((n for _, n in runs), default=0))
    return out


def found(spark, rows, **kw):
    d = line_dedup.dedupe(spark.createDataFrame(rows, SCHEMA), **kw)
    return {r["doc_id"]: (r["text"], *r["__d"]) for r in d.collect()}


def test_runs_of_many_lengths(spark):
    r = random.Random(5)
    pool = [f"line {i}" for i in range(12)]
    source = [f"unlike {i}" for i in range(40)]
    rows = [(0, "\n".join(source))]
    for i in range(1, 25):
        text = r.choices(pool, k=r.randint(0, 6))
        for n in r.choices((1, 2, 3, 5, 7, 11), k=r.randint(0, 3)):
            a = r.randrange(len(source) - n)
            text += source[a : a + n] + r.choices([*pool, "", "  "], k=r.randint(0, 3))
        rows.append((i, "\n".join(text)))
    rows.append((30, "\n".join(["again and again"] * 9)))
    want = brute(rows)
    assert found(spark, rows) == want
    assert {w[4] for w in want.values()} >= {3, 5, 7}
    assert found(spark, rows, min_lines=5, min_words=6) == brute(rows, 5, 6)


def test_the_first_copy_stays_whole(spark):
    rows = [(1, "\n".join("ABABA")), (2, "x\nA\nB\nA\ny"), (3, "\n".join("QQQQQQ"))]
    got = found(spark, rows)
    assert got == brute(rows)
    assert got[1][0] == "\n".join("ABABA") and got[2][0] == "x\ny" and got[3][0] == "Q\nQ\nQ"


def test_a_copied_long_line_is_a_run_of_its_own(spark):
    passage, edge = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("p", 50), ("e", 49)))
    texts = ["own a\n" + passage + "\n" + edge, "own b\n" + passage + "\nown c\n" + edge, passage, "own d\nshort\n" + passage, "own e\nshort\nown f", edge]
    d = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_copies(d).collect()}
    assert got == {0: texts[0], 1: "own b\nown c\n" + edge, 3: "own d\nshort", 4: texts[4], 5: edge}


def test_nulls_ties_repeated_rows_and_clashing_columns(spark):
    run = "one\ntwo\nthree"
    rows = [(None, run), (1, None), (2, ""), (3, " \n"), (4, run + "\nown"), (4, run + "\nown"), (5, "é" * 50_000 + "\n" + run)]
    d = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(c) for c in ("__k", "__w", "__l", "__runs", "__d", "k", "j", "name", "salt", "__lines", "__kept", "__row")})
    got = line_dedup.drop_copies(d)
    assert got.columns == d.columns
    rest = sorted(((r["doc_id"], r["text"], r["__d"], r["__w"]) for r in got.collect()), key=repr)
    want = [(None, run), (1, None), (2, ""), (3, " \n"), (4, "own"), (4, "own"), (5, "é" * 50_000)]
    assert rest == sorted(((i, t, "__d", "__w") for i, t in want), key=repr)
    assert line_dedup.drop_copies(d.limit(0)).count() == 0


@pytest.mark.parametrize("n", [64])
def test_a_very_common_line(spark, n):
    rows = [(i, f"own {i}\ncommon\nother {i}\nleft {i % 2}\nright\nend") for i in range(n)]
    assert found(spark, rows) == brute(rows)
