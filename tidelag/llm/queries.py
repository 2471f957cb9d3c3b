"""Queries over the driver's tables, one per operator, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelag.llm import brown_lm, circulant_minhash, jaccard_join, line_dedup, media, mixing, pieces, pii, quality_rules, ranked_search, token_counts, toxicity, vector_codes
from tidelag.llm.common import documents, stage


#: The pseudonym key of the demonstration query; production passes a secret of up to 64 bytes.
PII_KEY = b"demonstration key, not a secret"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity, likeliest grade and toxic flag of every document, from a model fitted on labels."""
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = docs.select("doc_id", toxicity.severity(F.col("text"), model).alias("__s"))
    return scored.select("doc_id", F.col("__s.expected_severity"), F.col("__s.grade"), F.col("__s.toxic"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without later copies of long enough maximal runs of lines, and what was deleted."""
    d = line_dedup.dedupe(documents(spark, sf_dir).select("doc_id", "text"))
    return d.select("doc_id", "text", *[F.col(f"__d.{c}").alias(c) for c in ("n_lines", "n_removed", "n_runs", "longest_run")])


# Pairs of equal lines, the earlier one second; unbroken stretches of a diagonal are common prefixes.
OP2_SQL = rf"""
WITH a AS (SELECT doc_id, unnest(str_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(str_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
w AS (SELECT doc_id, line, i, len(regexp_extract_all(line, '[^ 	-
]+')) AS words, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j FROM a WHERE regexp_matches(line, '[^ 	-
]')),
e AS (SELECT x.doc_id, x.j, y.doc_id AS other, y.j AS there FROM w x JOIN w y ON x.line = y.line AND (y.doc_id < x.doc_id OR y.doc_id = x.doc_id AND y.j < x.j)),
g AS (SELECT *, j - row_number() OVER (PARTITION BY doc_id, other, j - there ORDER BY j) AS stretch FROM e),
l AS (SELECT doc_id, j, other, there, max(j) OVER (PARTITION BY doc_id, other, j - there, stretch) - j + 1 AS same FROM g),
f AS (SELECT doc_id, j, max(CASE WHEN doc_id = other THEN least(same, j - there) ELSE same END) AS lines FROM l GROUP BY doc_id, j),
m AS (SELECT f.doc_id, f.j, f.lines FROM f LEFT JOIN f b ON b.doc_id = f.doc_id AND b.j = f.j - 1 WHERE coalesce(b.lines, 0) <= f.lines),
r AS (SELECT m.doc_id, m.j, m.lines FROM m JOIN w ON w.doc_id = m.doc_id AND w.j BETWEEN m.j AND m.j + m.lines - 1 GROUP BY ALL HAVING m.lines >= {line_dedup.MIN_LINES} OR sum(w.words) >= {line_dedup.MIN_WORDS}),
x AS (SELECT DISTINCT doc_id, unnest(range(j, j + lines)) AS j FROM r),
n AS (SELECT doc_id, count(*) AS n_runs, max(lines) AS longest_run FROM r GROUP BY doc_id),
c AS (SELECT a.doc_id, string_agg(CASE WHEN x.j IS NULL THEN a.line END, chr(10) ORDER BY a.i) AS text, count(w.j) AS n_lines, count(x.j) AS n_removed
      FROM a LEFT JOIN w ON a.doc_id = w.doc_id AND a.i = w.i LEFT JOIN x ON w.doc_id = x.doc_id AND w.j = x.j GROUP BY a.doc_id)
SELECT c.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(c.text, '') END AS text, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_removed AS BIGINT) AS n_removed, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(coalesce(longest_run, 0) AS BIGINT) AS longest_run
FROM c JOIN documents d ON d.doc_id = c.doc_id LEFT JOIN n ON c.doc_id = n.doc_id
"""


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with validated numbers, dates and mail names replaced, and where they stand."""
    docs = documents(spark, sf_dir).select("doc_id", pii.pseudonymised(F.col("text"), PII_KEY).alias("__p"))
    return docs.select("doc_id", F.col("__p.text"), F.size("__p.spans").cast("long").alias("n_replaced"), F.col("__p.spans"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after three edits, and how much was encoded again."""
    vocabulary = token_counts.Vocabulary.read()
    docs = documents(spark, sf_dir).select("doc_id", token_counts.edited_counts(F.col("text"), vocabulary).alias("__c"))
    return docs.select("doc_id", "__c.*")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its source's target and the words that the mix takes of it."""
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    return mixing.with_copies(docs).select("doc_id", *[F.col(f"__mix.{c}").alias(c) for c in ("size", "source_size", "target", "taken")])


def op6_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class-based score and unigram base of every document."""
    return brown_lm.score(documents(spark, sf_dir))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document: 3-word shingles, similarity of 0.9 or more."""
    return jaccard_join.near_groups(documents(spark, sf_dir))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document's text reads back as from a lossless image."""
    docs = documents(spark, sf_dir).select("doc_id", media.stored(F.col("text"), with_media=False).alias("__m"))
    return docs.select("doc_id", "__m.*")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    found = quality_rules.verdicts(documents(spark, sf_dir))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return found.select("doc_id", *[F.col(f"__q.{c}").alias(c) for c in names])


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts, a digest of the ids and the round trip of every document."""
    docs = documents(spark, sf_dir).select("doc_id", pieces.digest(F.col("text"), pieces.Pieces.read()).alias("__d"))
    return docs.select("doc_id", "__d.*")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code, squared error and its label's error of every vector of finite components."""
    return vector_codes.compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size, component and whether it is kept of every document: 4-word shingles, similarity of 0.8 or more."""
    found = circulant_minhash.near_groups(documents(spark, sf_dir))
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 highest-scoring documents of every benchmark item."""
    index = stage(ranked_search.build_index(documents(spark, sf_dir)), "index")
    return ranked_search.search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 3 * source_size AS cap, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s),
l AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
        CAST(coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS full_,
        sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight FROM w),
v AS (SELECT *, CAST(total - full_ AS DOUBLE) / open_weight AS own FROM l),
t AS (SELECT source, source_size, least(weight * (max(CASE WHEN own * weight <= cap THEN own END) OVER ()), CAST(cap AS DOUBLE)) AS target FROM v),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
        CAST(('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT)::DOUBLE / 4503599627370496.0 AS draw
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST((floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) * size AS taken FROM r
"""

OP13_SQL = r"""
WITH folded AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
sized AS (SELECT doc_id, terms, len(terms) AS n FROM folded WHERE len(terms) > 0),
totals AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sized),
wanted AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
postings AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM sized) WHERE term IN (SELECT term FROM wanted) GROUP BY doc_id, n, term),
weights AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, totals GROUP BY term, n_docs),
scores AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
           FROM wanted JOIN weights USING (term) JOIN postings USING (term), totals GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 50
"""



def _jaccard_sql(words: int, percent: int, more: str = "") -> str:
    """doc_id, n_shingles, component_id and what `more` selects, from all pairs that share a shingle."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {words} + 1, 1) + 1)) AS i FROM w WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {words} - 1], ' ') AS s FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT p.a, p.b FROM p JOIN n x ON p.a = x.doc_id JOIN n y ON p.b = y.doc_id WHERE 100 * p.c >= {percent} * (x.n + y.n - p.c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS reached FROM n UNION SELECT r.node, e.b FROM r JOIN e ON r.reached = e.a),
c AS (SELECT node, min(reached) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id{more}
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN c ON d.doc_id = c.node
"""


OP7_SQL = _jaccard_sql(jaccard_join.WORDS, jaccard_join.PERCENT)
OP12_SQL = _jaccard_sql(circulant_minhash.WORDS, circulant_minhash.PERCENT, ", d.doc_id = coalesce(c.component_id, d.doc_id) AS kept")
OP9_SQL = quality_rules.duckdb_sql("documents")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_toxicity, op2_line_dedup, op3_pseudonyms, op4_token_counts, op5_mix_sources, op6_brown_lm, op7_jaccard_join, op8_media, op9_quality_rules, op10_sentencepiece, op11_vector_codes, op12_circulant_minhash, op13_ranked_search)}
ORACLES: dict[str, str] = {"op2_line_dedup": OP2_SQL, "op5_mix_sources": OP5_SQL, "op7_jaccard_join": OP7_SQL, "op9_quality_rules": OP9_SQL, "op12_circulant_minhash": OP12_SQL, "op13_ranked_search": OP13_SQL}
