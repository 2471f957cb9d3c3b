"""The text operators against brute force, round trips and awkward tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidelag.llm import brown_lm, jaccard_join, line_dedup, media, mixing, pieces, pii, quality_rules, queries, token_counts, toxicity, webp

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
KEY = b"a test key"


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def corpus(seed=1, n=60):
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdeéxyzß", k=r.randint(1, 8))) for _ in range(150)]
    texts = []
    for _ in range(n):
        if texts and r.random() < 0.35:
            w = r.choice(texts).split(" ")
            w[r.randrange(len(w))] = r.choice(vocabulary)
            texts.append(" ".join(w))
        else:
            texts.append("\n".join(" ".join(r.choices(vocabulary, k=r.randint(3, 25))) for _ in range(r.randint(1, 6))))
    return [(i, t, r.choice(["en", "de"]), r.choice(["a", "b", None]), len(t)) for i, t in enumerate(texts)]


AWKWARD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n ", "en", "b", 4), (4, "word", None, "a", 4), (5, "Word wORD 4111 1111 1111 1111", "en", None, 1),
    (6, "same line here\nsecond line here\nsame line here\nsecond line here", "en", "a", 1), (6, "same line here\nsecond line here\nsame line here\nsecond line here", "en", "a", 1),
    (7, "é🙂ß " * 30_000, "de", "a", 1), (None, "a row without an id", "en", "b", 1), (8, "a  b   c \r\n d e ▁f", "en", "b", 1),
]


def awkward(spark):
    d = spark.createDataFrame(AWKWARD, SCHEMA)
    return d.withColumns({c: F.lit(1) for c in ("size", "word", "token", "n", "k", "rep", "__x")})


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80), (1, 50)])
def test_jaccard_join(spark, words, percent):
    rows = corpus(3, 120) + [(200, None, None, None, 0), (201, "one two", None, None, 0), (202, "One  two", None, None, 0)]
    sets = {}
    for i, t, *_ in rows:
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
    got = jaccard_join.near_groups(spark.createDataFrame(rows, SCHEMA), words=words, percent=percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(s), root(i)) for i, s in sets.items()}
    assert len({root(i) for i in sets}) < len(sets)


def test_line_dedup_and_mixing_against_sql(spark, tmp_path):
    spark.createDataFrame(corpus(5, 80), SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("op2_line_dedup", "op5_mix_sources", "op9_quality_rules"):
        got = queries.QUERIES[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLES[name]})").fetchall()
        key = lambda r: repr([round(x, 6) if isinstance(x, float) else x for x in r])
        assert sorted(map(key, map(tuple, got.collect()))) == sorted(map(key, want)), name


def test_mixing_meets_its_targets(spark):
    rows = [(i, "w " * (1 + i % 9), "en", s, 1) for i, s in enumerate(["big"] * 3000 + ["mid"] * 900 + [None] * 300)]
    d = spark.createDataFrame(rows, SCHEMA)
    got = mixing.with_copies(d).groupBy("source").agg(F.sum("__mix.taken").alias("taken"), F.first("__mix.target").alias("target"), F.max(F.col("__mix.taken") / F.col("__mix.size")).alias("most")).collect()
    for r in got:
        assert r["taken"] == pytest.approx(r["target"], rel=0.08) and r["most"] <= 3
    a, b = (sorted(r["doc_id"] for r in mixing.mix(x).collect()) for x in (d, d.repartition(7)))
    assert a == b


def test_quality_measures(spark):
    rows = corpus(7, 40) + [(900, "a b c a b c a b", "en", "a", 1), (901, "# $x\n# $x\n|", "en", "a", 1)]
    got = {r["doc_id"]: r["__q"] for r in quality_rules.verdicts(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, t, *_ in rows:
        w = WORD.findall(t)
        windows = defaultdict(list)
        for k in range(len(w) - 2):
            windows[tuple(w[k : k + 3])].append(k)
        repeated = {k + j for at in windows.values() if len(at) > 1 for k in at for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        q = got[i]
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeated))
        assert q["base_failed"] == (len(w) < 50 or 100 * len(repeated) > 50 * len(w)) and not (q["base_failed"] and q["kept"])


def test_every_language_has_a_reference(spark, tmp_path):
    plain = " ".join(f"some{chr(97 + i % 26)}{chr(97 + i // 26)} the" for i in range(60))
    capitals = " ".join(f"X{i}Y{i * 7}Z" for i in range(150))
    rows = [(2 * i + k, plain, f"l{i:02d}", "a", 1) for i in range(70) for k in range(2)] + [(900, capitals, "zz", "a", 1), (901, plain, None, "a", 1)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op9_quality_rules(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.OP9_SQL})").fetchall()
    found = sorted(map(tuple, got.collect()))
    assert found == sorted(want) and all(r[-1] for r in found)
    assert quality_rules.keep_good(spark.read.parquet(f"{tmp_path}/documents.parquet")).count() == len(rows)


def test_brown_lm(spark):
    rows = corpus(11, 80) + [(500, None, None, None, 0), (501, "zzzznever seen", None, None, 0)]
    got = {r["doc_id"]: r for r in brown_lm.score(spark.createDataFrame(rows, SCHEMA)).collect()}
    tokens = {i: [*WORD.findall(fold(t)), None] for i, t, *_ in rows}
    out = {i for i in tokens if zlib.crc32(str(i).encode()) % 7 == 2}
    c = Counter(w for i, t in tokens.items() if i not in out for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i in out, len(t), sum(c[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + 1 * (v + 1))) for w in t))
        assert r["score"] < 0


def test_exchange_finds_alternating_classes():
    n = np.zeros((9, 9), dtype=np.int64)
    for a in range(4):
        for b in range(4, 8):
            n[a, b] = n[b, a] = 50
    n[8, 0] = n[5, 8] = 10
    place = brown_lm.exchange(n, 3)
    assert len(set(place[:4])) == 1 and len(set(place[4:8])) == 1 and place[0] != place[4]


def test_media_round_trip(spark):
    r = random.Random(2)
    for payload in (bytes(64), bytes(range(256)) * 4, r.randbytes(64 * 40), b"abcd" * 1600, ("Übung macht den Meister. " * 400).encode()):
        payload += bytes(-len(payload) % 64)
        back, pixels = media.unpack(media.pack(payload))
        assert back == payload and pixels.shape[2] == 4
    d = spark.createDataFrame([(b"no image",), (media.pack(bytes(128)),), (None,)], "media binary").select(media.pixel_arrays(F.col("media")).alias("p")).collect()
    assert [x["p"]["width"] for x in d] == [None, 16, None]
    with pytest.raises(webp.WebPError):
        webp.decode(b"RIFF")


def test_pseudonyms():
    out, spans = pii.replace_all("card 4111 1111 1111 1111, again 4111 1111 1111 1111, born 1980-02-29, id 4111 1111 1111 1112", KEY)
    values = [out[a:b] for _, a, b in spans]
    assert [k for k, *_ in spans] == ["card", "card", "iso"] and values[0] == values[1] != "4111 1111 1111 1111"
    assert pii.luhn(values[0].replace(" ", "")) == 0 and re.fullmatch(r"\d{4} \d{4} \d{4} \d{4}", values[0]) and out.endswith("4111 1111 1111 1112")
    for size in (2, 10, 97, 1000):
        image = [pii.permute(i, size, KEY, "t") for i in range(size)]
        assert sorted(image) == list(range(size)) and [pii.invert(x, size, KEY, "t") for x in image] == list(range(size))
    assert pii.replace_all(None, KEY) == (None, []) and pii.replace_all("", KEY) == ("", [])


def test_pseudonyms_inside_longer_matches():
    card, iban = "4111 1111 1111 1111", "ES9121000418450200051332"
    for text, value, kind in (
        (f"{card} 123", card, "card"), ("4111111111111111 12 27", "4111111111111111", "card"), (f"12 {card}", card, "card"), (f"12 34 {card} 56", card, "card"), ("12-4111-1111-1111-1111", "4111-1111-1111-1111", "card"),
        (f"{iban} THEN", iban, "iban"), (f"{iban} BIC", iban, "iban"), ("ES91 2100 0418 4502 0005 1332 BIC", "ES91 2100 0418 4502 0005 1332", "iban"), (f"AB12 {iban}", iban, "iban"),
    ):
        out, spans = pii.replace_all(f"pay {text} now", KEY)
        (found, a, b), = spans
        assert found == kind and len(out) == len(f"pay {text} now") and value not in out, text
        assert out[:a] + value + out[b:] == f"pay {text} now" and pii.pseudonym(kind, value, KEY) == out[a:b], text
    out, spans = pii.replace_all(f"{card} 123 555 123 4567", KEY)
    assert [k for k, *_ in spans] == ["card", "phone"]
    assert pii.replace_all("1234 5678 9012 3456 or AB12 THEN MORE WORD", KEY) == ("1234 5678 9012 3456 or AB12 THEN MORE WORD", [])


def test_token_tree_after_edits():
    count = token_counts.token_counter(token_counts.Vocabulary.read())
    r = random.Random(4)
    text = "Hello  world, it's 2024!\n\n  Déjà vu   again " * 40
    tree = token_counts.TokenTree(text, count)
    for _ in range(150):
        a = r.randrange(len(text) + 1)
        b = min(len(text), a + r.randrange(12))
        new = "".join(r.choices(" \n'sé1a.", k=r.randrange(9)))
        text = text[:a] + new + text[b:]
        tree.edit(a, b, new)
        assert tree.text() == text and tree.tokens == token_counts.TokenTree(text, count).tokens


def test_pieces_equal_the_library(spark):
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    e = pieces.Encoder(pieces.Pieces.read())
    texts = [t for _, t, *_ in corpus(13, 40)] + ["", "  two  spaces ", "Hello, world! 🙂\n\ttab", "naïve façade — “quotes”", "a" * 500, "   "]
    for t, ids in zip(texts, e.encode(texts), strict=True):
        assert ids.tolist() == p.encode(t), t
        assert e.decode(ids) == t


def test_toxicity_ranks_severity(spark):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        w = r.choices(["tree", "river", "stone", "cloud", "light"], k=30) + r.choices(["vile", "scum"], k=(1 + i % 8) if bad else 0)
        r.shuffle(w)
        rows.append((i, " ".join(w), "en", "a", 1))
        labels.append((i, 1, int(bad)))
    d = spark.createDataFrame(rows, SCHEMA)
    model = toxicity.train(d.where("doc_id < 240"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {x["doc_id"]: x["s"] for x in d.where("doc_id >= 240").select("doc_id", toxicity.severity(F.col("text"), model).alias("s")).collect()}
    assert all(s["toxic"] == (i % 3 == 0) for i, s in got.items())
    assert np.all(np.diff(model.thresholds) > 0)


def test_awkward_and_empty_tables(spark):
    labels = spark.createDataFrame([(1, None, None), (2, 1, 0), (5, 0, 1), (None, 0, 1)], "doc_id long, quality int, toxic int")
    vocabulary = token_counts.Vocabulary.read()
    for d in (awkward(spark), awkward(spark).limit(0)):
        n = d.count()
        model = toxicity.train(d, labels)
        for column in (toxicity.severity(F.col("text"), model), pii.pseudonymised(F.col("text"), KEY), token_counts.edited_counts(F.col("text"), vocabulary), media.stored(F.col("text")), pieces.digest(F.col("text"), pieces.Pieces.read())):
            assert len(d.select(column.alias("o")).collect()) == n
        assert len(jaccard_join.near_groups(d).collect()) == n
        assert len(brown_lm.score(d).collect()) == n
        assert len(quality_rules.verdicts(d).collect()) == n
        assert len(mixing.with_copies(d).collect()) == n
        assert len(line_dedup.dedupe(d).collect()) == n
        for name, f in corpus_pipeline.STAGES[:-1]:
            out = f(spark, d, "")
            assert out.columns == d.columns and out.count() >= 0, name
        out = corpus_pipeline.STAGES[-1][1](spark, d, "")
        assert out.columns == [*d.columns, "token_ids", "n_tokens"] and out.count() == n
