"""Token counts and pieces against the tokenizers' libraries, over whole queries and long inputs."""

import base64
import random
import time
import zlib
from pathlib import Path

import numpy as np
import pytest
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from tidelag.llm import pieces, queries, token_counts

SCHEMA = "doc_id long, text string"
TEXTS = ["Hello, world! It's 2024.", None, "", "   ", "\n\n  two\t\ttabs \u2581 mark", "na\u00efve fa\u00e7ade \u2014 \u201cquotes\u201d \U0001f642", "word " * 3000, "x" * 5000, "Hello, world! It's 2024.", " " * 300 + "end"]


def documents(spark, folder):
    spark.createDataFrame(list(enumerate(TEXTS)), SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(token_counts.VOCABULARY).read_bytes().splitlines())}
    return tiktoken.Encoding("whole", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_op4_counts_equal_whole_encodings(spark, tmp_path):
    lib = library()
    got = {r["doc_id"]: r for r in queries.op4_token_counts(spark, documents(spark, tmp_path)).collect()}
    for i, t in enumerate(TEXTS):
        before = after = t or ""
        for a, b, new in token_counts.thirds(before):
            after = after[:a] + new + after[b:]
        want = (len(lib.encode_ordinary(before)), len(lib.encode_ordinary(after)), len(after))
        assert (got[i]["n_tokens"], got[i]["n_tokens_after"], got[i]["n_chars_after"]) == want, i


def test_leaves_split_and_stay_small():
    count = token_counts.token_counter(token_counts.Vocabulary.read())
    tree = token_counts.TokenTree("a few words", count)
    tree.edit(5, 5, " inserted words" * 20_000)
    assert max(len(x) for x, _ in tree.leaves()) <= 2 * token_counts.LEAF
    tree.encoded = 0
    tree.edit(100_000, 100_003, "x")
    assert tree.encoded < 50 and tree.tokens == token_counts.TokenTree(tree.text(), count).tokens


def test_kept_trees_after_an_edits_table(spark):
    lib, vocabulary = library(), token_counts.Vocabulary.read()
    docs = spark.createDataFrame(list(enumerate(TEXTS)), SCHEMA)
    edits = [(0, 1, 0, 5, "Bye"), (0, 2, 3, 3, " now"), (1, 1, 0, 0, "from nothing"), (6, 5, 40, 10_000, None), (6, 9, 7, 9, "edge's"), (77, 1, 0, 0, "nobody"), (9, 1, 299, 301, "")]
    table = spark.createDataFrame(edits, "doc_id long, seq int, start int, stop int, new string")
    kept = token_counts.leaf_table(docs, vocabulary)
    after = token_counts.apply_edits(kept, table, vocabulary)
    got = {}
    for r in after.orderBy("doc_id", "leaf").collect():
        text, n = got.get(r["doc_id"], ("", 0))
        got[r["doc_id"]] = (text + "".join(r["pieces"]), n + r["tokens"])
    want = {i: t or "" for i, t in enumerate(TEXTS)}
    for i, _, a, b, new in edits:
        if i in want:
            want[i] = want[i][:a] + (new or "") + want[i][b:]
    assert got == {i: (t, len(lib.encode_ordinary(t))) for i, t in want.items()}


def test_op10_equals_the_library(spark, tmp_path):
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    folder = documents(spark, tmp_path)
    got = {r["doc_id"]: r for r in queries.op10_sentencepiece(spark, folder).collect()}
    v = pieces.Pieces.read()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = {r["doc_id"]: r for r in pieces.with_token_ids(docs, v).withColumn("back", pieces.text_of(F.col("token_ids"), v)).collect()}
    for i, t in enumerate(TEXTS):
        want = lib.encode(t or "")
        r = got[i]
        n_bytes = sum(lib.is_byte(x) for x in want)
        assert (r["n_tokens"], r["n_byte_tokens"], r["ids_crc32"]) == (len(want), n_bytes, zlib.crc32(np.array(want, dtype="<i4").tobytes())), i
        assert r["round_trip"] and ids[i]["token_ids"] == (None if t is None else want) and ids[i]["n_tokens"] == len(want)
        assert ids[i]["back"] == (None if t is None else t.replace(pieces.SPACE, " "))


@pytest.mark.parametrize("text", [" " * 100_000, "a" + " " * 5001 + "b", "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyz", k=300_000)), "".join(random.Random(2).choices("etaoin sh\u00e9\U0001f642\u00df", k=20_000))])
def test_long_inputs(text):
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    e = pieces.Encoder(pieces.Pieces.read())
    began = time.perf_counter()
    ids = e.encode([text])[0]
    assert time.perf_counter() - began < 20 and ids.tolist() == lib.encode(text) and e.decode(ids) == text


def test_words_behind_runs_of_spaces_are_found_together():
    r = random.Random(4)
    words = ["".join(r.choices("abcdefghijklmnopé", k=r.randint(2, 9))) for _ in range(16_000)]
    e, began = pieces.Encoder(pieces.Pieces.read()), time.process_time()
    long = e.encode(["  ".join(words)])[0]
    assert time.process_time() - began < 10  # one by one they took over half a minute
    texts = ["  ".join(words[:300]), "a   b  c d", "   lead  and trail   ", "x" * 300 + "  " + "y" * 50 + "   z", "é  🙂  🙂x   ▁  ▁▁ a", "  ", "a  "]
    library = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    assert [x.tolist() for x in e.encode(texts)] == [library.encode(t) for t in texts] and long.tolist() == library.encode("  ".join(words))
