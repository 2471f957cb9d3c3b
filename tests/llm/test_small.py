"""Clashing columns, nulls, ties and repeats of the smaller operators; links of pseudonyms; the pipeline against its stages."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidelag.llm import common, jaccard_join, line_dedup, mixing, pieces, pii, quality_rules, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("__q", "__mix", "__size", "__source", "__found", "__copy", "__t", "__w", "__f", "__n", "__h", "__p", "__l", "__row", "__nth", "size", "target", "q", "c", "k", "a", "b", "id", "rep", "n", "text_", "token")


def test_stages_keep_clashing_columns(spark):
    text = " ".join(f"word{i} the of" for i in range(60))
    rows = [(1, text, "en", "a", 1), (2, None, None, None, None), (3, "", "en", "b", 0), (3, "", "en", "b", 0), (4, text + " end", "en", "a", 1), (None, text, "en", "a", 1), (5, "x" * 100_000, "xx", "b", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(f"own {c}") for c in CLASH})
    for f in (quality_rules.keep_good, line_dedup.drop_copies, jaccard_join.keep_one, mixing.mix):
        out = f(docs)
        assert out.columns == docs.columns
        for r in out.collect():
            assert all(r[c] == f"own {c}" for c in CLASH), f
        assert f(docs.limit(0)).count() == 0
    assert {r["doc_id"] for r in quality_rules.keep_good(docs).collect()} == {1, 4, None}
    assert sorted(r["doc_id"] or 0 for r in jaccard_join.keep_one(docs).collect()) == [0, 1, 2, 3, 5]


def test_rows_of_one_key(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    docs = spark.createDataFrame([(1, a), (1, b), (1, a), (2, b), (3, "else"), (None, a), (None, a)], "doc_id long, text string")
    first = sorted(map(tuple, jaccard_join.keep_one(docs).collect()), key=repr)
    assert first == sorted([(1, a), (1, b), (3, "else"), (None, a), (None, a)], key=repr)
    assert first == sorted(map(tuple, jaccard_join.keep_one(docs.repartition(5)).collect()), key=repr)


def test_links_across_formats():
    key = b"k"
    new = lambda t: pii.replace_all(t, key)[0]
    iso, dotted, slashed = new("1980-02-29"), new("29.02.1980"), new("29/02/1980")
    assert iso != "1980-02-29" and iso == "-".join(reversed(dotted.split("."))) == "-".join(reversed(slashed.split("/")))
    assert re.sub(r"\D", "", new("+1 212 555 0100"))[1:] == re.sub(r"\D", "", new("212-555-0100")) == re.sub(r"\D", "", new("(212) 555-0100"))


def test_op3_against_one_call_a_text(spark, tmp_path):
    texts = ["Pay 4111 1111 1111 1111 or DE89 3704 0044 0532 0130 00, born 1980-02-29.", None, "", "nothing here", "a.b@example.org at 192.168.0.1, 078-05-1120", "4111 1111 1111 1112 is no card", "call (212) 555-0100 " * 500]
    spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op3_pseudonyms(spark, str(tmp_path)).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        text, spans = pii.replace_all(texts[r["doc_id"]], queries.PII_KEY)
        assert r["text"] == text and r["n_replaced"] == len(spans) and [tuple(s) for s in r["spans"]] == spans
        for kind, a, b in spans:
            assert kind != "card" or pii.luhn(re.sub(r"\D", "", text[a:b])) == 0
            assert kind != "iban" or pii._iban_mod(text[a:b].replace(" ", "")) == 1
    assert [len(pii.replace_all(t, b"x")[1]) for t in texts] == [3, 0, 0, 0, 3, 0, 500]


def test_pipeline_is_its_stages_and_their_decisions(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got.setdefault(r["doc_id"], []).append((r["text"], tuple(r["token_ids"] or ()), r["n_tokens"]))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({queries.OP9_SQL}) WHERE kept").fetchall()}
    con.execute("CREATE TABLE first AS SELECT * FROM documents WHERE doc_id IN (SELECT unnest(?))", [sorted(kept)])
    con.execute("DROP VIEW documents; CREATE VIEW documents AS SELECT * FROM first")
    lines = {r[0]: r[1] for r in con.execute(f"SELECT doc_id, text FROM ({queries.OP2_SQL}) WHERE n_removed = 0 OR n_removed < n_lines").fetchall()}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) for i, t in lines.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)} for i, w in words.items() if w}
    up = {i: i for i in lines}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    alone = {i: t for i, t in lines.items() if root(i) == i}
    con.execute("CREATE TABLE third AS SELECT * FROM first WHERE doc_id IN (SELECT unnest(?))", [sorted(alone)])
    for i, t in alone.items():
        con.execute("UPDATE third SET text = ? WHERE doc_id = ?", [t, i])
    con.execute("DROP VIEW documents; CREATE VIEW documents AS SELECT * FROM third")
    times = {i: n // s for i, s, n in con.execute(f"SELECT doc_id, size, taken FROM ({queries.OP5_SQL}) WHERE size > 0").fetchall()}
    e = pieces.Encoder(pieces.Pieces.read())
    want = {i: [(alone[i], tuple(e.encode([alone[i]])[0].tolist()))] * n for i, n in times.items() if n}
    assert {i: [(t, ids) for t, ids, _ in rows] for i, rows in got.items() if i in times} == want and 0 < len(want) < docs.count()
    assert all(n == len(ids) for rows in got.values() for _, ids, n in rows)


def test_no_shared_folder_on_a_cluster_is_an_error(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(RuntimeError):
        common.shared_dir(Session())
