"""Vector codes, circulant MinHash and ranked search against brute force, SQL and awkward tables."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelag.llm import circulant_minhash, queries, ranked_search, vector_codes
from tidelag.llm.common import stage

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# ---- vector codes


def test_tree_finds_the_nearest_and_the_lowest_of_ties():
    r = np.random.default_rng(5)
    for size, width, span in ((1, 3, 5), (40, 1, 3), (200, 2, 4), (256, 16, 300), (256, 5, 1)):
        entries, x = r.integers(-span, span + 1, (size, width)), r.integers(-span - 1, span + 2, (500, width))
        entries[size // 2] = entries[0]
        found, far = vector_codes.Tree(entries).nearest(x)
        d = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
        assert (far == d.min(axis=1)).all() and (found == d.argmin(axis=1)).all()
    found, far = vector_codes.Tree(np.zeros((256, 4), dtype=np.int64)).nearest(np.ones((3, 4), dtype=np.int64))
    assert found.tolist() == [0, 0, 0] and far.tolist() == [4, 4, 4]


def brute_codes(rows, parts=4, entries=256, rounds=4):
    kept = [(i, v, l) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ints = [[math.floor(Fraction(x) * 1024) for x in v] for _, v, _ in kept]
    width = len(ints[0]) // parts
    first = sorted(range(len(kept)), key=lambda k: kept[k][0])[:entries]
    books = [[ints[k][p * width : (p + 1) * width] for k in first] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    def assign():
        return [[min((dist(v[p * width : (p + 1) * width], e), k) for k, e in enumerate(books[p])) for p in range(parts)] for v in ints]

    for _ in range(rounds):
        near = assign()
        for p in range(parts):
            groups = defaultdict(list)
            for v, n in zip(ints, near, strict=True):
                groups[n[p][1]].append(v[p * width : (p + 1) * width])
            for e, g in groups.items():
                books[p][e] = [sum(c) // len(g) for c in zip(*g, strict=True)]
    near, sums = assign(), Counter()
    for (_, _, l), n in zip(kept, near, strict=True):
        sums[l] += sum(d for d, _ in n)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return {i: ("".join(f"{e:02x}" for _, e in n), sum(d for d, _ in n), sums[l], sha) for (i, _, l), n in zip(kept, near, strict=True)}


def test_op11_against_brute_force(spark, tmp_path):
    r = random.Random(3)
    middles = [[r.gauss(0, 0.3) for _ in range(8)] for _ in range(5)]
    rows = []
    for i in range(700):
        m = r.choice(middles)
        rows.append((i * 3 + 1, [float(np.float32(x + r.gauss(0, 0.1))) for x in m], r.choice([None, 1, 2])))
    rows[5] = (rows[5][0], None, 1)
    rows[6] = (rows[6][0], [None, *rows[6][1][1:]], 1)
    rows[7] = (rows[7][0], [math.nan, *rows[7][1][1:]], 1)
    rows[8] = (rows[8][0], [-math.inf, *rows[8][1][1:]], 1)
    for k in range(9, 60):
        rows[k] = (rows[k][0], rows[9][1], 2)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op11_vector_codes(spark, str(tmp_path)).collect()
    assert {x["vec_id"]: (x["code"], x["error"], x["label_error"], x["codebooks_sha256"]) for x in got} == brute_codes(rows) and len(got) == 696


def test_vector_codes_on_awkward_tables(spark):
    schema = "vec_id long, embedding array<float>, label int, code string, __label int"
    rows = [(1, [0.5] * 4, None, "c", 7), (1, [0.25] * 4, 2, "c", 7), (None, [-0.5] * 4, 2, "c", 7), (2, [0.5] * 3, 2, "c", 7), (3, [1e30] * 4, 2, "c", 7), (4, [], 1, "c", 7), (5, None, 1, "c", 7)]
    got = {(r["vec_id"], r["error"]): r for r in vector_codes.compressed(spark.createDataFrame(rows, schema), entries=2).collect()}
    assert set(got) == {(1, 4 * 427**2), (1, 4 * 171**2), (None, 4 * 597**2), (2, None), (3, None), (4, None)}
    assert all((r["code"] is None) == (r["error"] is None) for r in got.values())
    assert got[2, None]["label_error"] == got[3, None]["label_error"]
    empty = spark.createDataFrame([], schema)
    assert vector_codes.compressed(empty).count() == 0 and vector_codes.compressed(spark.createDataFrame([(5, None, 1, "c", 7)], schema)).count() == 0
    with pytest.raises(ValueError):
        vector_codes.compressed(spark.createDataFrame([(1, [1.0] * 6, 1, "c", 7)], schema))
    with pytest.raises(ValueError):
        vector_codes.with_codes(empty.withColumn("__code", F.lit(1)), None)


# ---- circulant MinHash


def near_corpus(seed, groups, copies):
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdé", k=r.randint(1, 7))) for _ in range(400)]
    out = []
    for _ in range(groups):
        base = [r.choice(vocabulary) for _ in range(r.randint(2, 160))]
        for _ in range(r.randint(1, copies)):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            out.append(" ".join(x.upper() if r.random() < 0.1 else x for x in w))
    r.shuffle(out)
    return list(enumerate(out))


def brute_components(rows, words, percent):
    sets = {}
    for i, t in rows:
        w = WORD.findall(fold(t))
        sets[i] = {tuple(w)} if 0 < len(w) < words else {tuple(w[k : k + words]) for k in range(len(w) - words + 1)}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("seed,groups,copies", [(1, 60, 8), (2, 3, 90)])
def test_op12_against_brute_force(spark, tmp_path, seed, groups, copies):
    rows = [*near_corpus(seed, groups, copies), (9000, None), (9001, ""), (9002, " \n"), (9003, "two Words"), (9004, "TWO\twords"), (9005, "two words more")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_circulant_minhash(spark, str(tmp_path)).collect()
    want = brute_components(rows, 4, 80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want and len(got) == len(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert len({c for _, c in want.values()}) < len(rows)


def test_signatures_are_one_permutation_shifted_around():
    r = np.random.default_rng(1)
    a, b = (np.unique(r.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2)) for n in (50, 1))
    s = circulant_minhash.signatures(np.concatenate([a, b]), np.array([0, 50]), 7)
    one = lambda x, k: circulant_minhash.permuted(circulant_minhash.permuted((x >> np.uint64(32)).astype(np.uint32), 0x3C6EF372) - np.uint32(k), 0xA54FF53A)
    assert s.T.tolist() == [[int(one(x, k).min()) for k in range(7)] for x in (a, b)]
    every = np.arange(1 << 16, dtype=np.uint32) * np.uint32(65521)
    assert len(np.unique(circulant_minhash.permuted(every, 3))) == 1 << 16
    # agreement of coordinates estimates the similarity, here 600 of 1000
    x = r.integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2)
    s = circulant_minhash.signatures(np.concatenate([x[:800], x[200:]]), np.array([0, 800]), 2000)
    assert abs((s[:, 0] == s[:, 1]).mean() - 0.6) < 0.05


def test_near_groups_on_awkward_tables(spark):
    long = " ".join(f"w{i % 997}" for i in range(40_000))
    rows = [(1, long, 1), (2, long + " end", 1), (None, long, 1), (3, None, 1), (4, "", 1), (4, "a b c d e", 1), (4, "x y z", 1), (5, "X y Z", 1), (6, "a b c d e", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").withColumns({c: F.lit("own") for c in ("rep", "token", "bands", "id", "g")})
    got = sorted(((r["doc_id"] or 0, r["component_id"]) for r in circulant_minhash.near_groups(docs).collect()), key=repr)
    assert got == sorted([(1, 1), (2, 1), (0, 1), (3, 3), (4, 4), (4, 4), (4, 4), (5, 4), (6, 4)], key=repr)
    assert circulant_minhash.near_groups(docs.limit(0)).count() == 0


# ---- ranked search


def test_packed_numbers():
    r = random.Random(1)
    values = np.array([r.getrandbits(r.randint(1, 62)) for _ in range(500)] + [0, 127, 128, 2**62])
    got = ranked_search.packed(values, np.array([0, 0, 10, len(values)])).to_pylist()
    assert got[0] == b"" and [ranked_search.unpacked(x).tolist() for x in got] == [[], values[:10].tolist(), values[10:].tolist()]


def brute_ranks(docs, items, k=50):
    terms = [(i, Counter(TERM.findall(fold(t)))) for i, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in terms), sum(sum(c.values()) for _, c in terms)
    df = Counter(t for _, c in terms for t in c)
    out = {}
    for item, text in items:
        scores = []
        for i, c in terms:
            n, s = sum(c.values()), 0
            for t in set(TERM.findall(fold(text))) & set(c):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                s += w * (1000000000 * c[t] // (1000 * c[t] + 20 * (50 + 50 * n * n_docs // n_terms)))
            if s > 0:
                scores.append((-s, i is None, i, s))
        for rank, (_, _, i, s) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1):
            out[item, rank] = (i, s)
    return out


def ranks(df):
    return {(r["item_id"], r["rank"]): (r["doc_id"], r["score"]) for r in df.collect()}


@pytest.mark.parametrize("shard_postings", [40, 3_000_000])
def test_search_against_brute_force(spark, shard_postings):
    r = random.Random(9)
    vocabulary = [f"{a}{b}" for a in "abcdefgh" for b in ("", "é", "1", "B", "🙂")]
    text = lambda n: "".join(r.choice(vocabulary[: r.choice([3, 12, 40])]) + r.choice([" ", "-", "\n", "_", "  "]) for _ in range(n))
    docs = [(i, text(r.randint(1, 60))) for i in r.sample(range(-50, 2000), 400)]
    docs += [(5000 + i, docs[0][1]) for i in range(80)] + [(7000, None), (7001, ""), (7002, "--- ..."), (None, docs[1][1])]
    items = [(i, text(r.randint(1, 25))) for i in range(30)] + [(100, docs[0][1]), (101, None), (102, "??"), (103, "unheard words"), (None, docs[1][1])]
    index = stage(ranked_search.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), shard_postings=shard_postings), "index")
    assert index.where("term IS NULL").count() > (20 if shard_postings == 40 else 2)
    found = ranks(ranked_search.search(index, spark.createDataFrame(items, "item_id long, text string")))
    assert found == brute_ranks(docs, items) and len(found) > 600
    assert ranks(ranked_search.search(index, spark.createDataFrame(items[:3], "item_id long, text string"), k=2)) == brute_ranks(docs, items[:3], 2)


def test_search_on_awkward_tables(spark):
    docs = spark.createDataFrame([(1, "alpha " * 50_000 + "beta", 1), (2, "beta gamma", 1), (2, "beta gamma", 1), (None, "gamma", 1)], "doc_id long, text string, shard int").withColumns({c: F.lit("own") for c in ("term", "postings", "items", "rank")})
    items = spark.createDataFrame([("a", "Beta"), ("a", "GAMMA gamma"), ("b", "alpha")], "item_id string, text string").withColumn("score", F.lit(1))
    index = stage(ranked_search.build_index(docs), "index")
    found = ranks(ranked_search.search(index, items))
    assert found == brute_ranks([(1, "alpha " * 50_000 + "beta"), (2, "beta gamma"), (2, "beta gamma"), (None, "gamma")], [("a", "beta gamma"), ("b", "alpha")])
    assert ranked_search.search(index, items.limit(0)).count() == 0
    empty = stage(ranked_search.build_index(docs.limit(0)), "index")
    assert ranked_search.search(empty, items).count() == 0
    with pytest.raises(ValueError):
        ranked_search.build_index(docs.withColumn("doc_id", F.lit("x")))


@pytest.mark.parametrize("name", ["op7_jaccard_join", "op12_circulant_minhash", "op13_ranked_search"])
def test_sql_says_the_same(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    want = con.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001").select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
