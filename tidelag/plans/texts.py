"""Signals from text and events: rules, names, pages, decay, density, feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelag.functions.scalars import decay, fixed, normal_name, piecewise_multiplier, ratio
from tidelag.operators.joins import fuzzy_by_token
from tidelag.plans.inputs import query
from tidelag.sources.tables import table

_AGE = "date_diff('microsecond', ts, TIMESTAMP '2024-01-06') / 3600000000.0"


def _age() -> F.Column:
    return (F.lit("2024-01-06").cast("timestamp").cast("double") - F.col("ts").cast("timestamp").cast("double")) / 3600


@query(f"""WITH a AS (SELECT user_id, value, {_AGE} AS age FROM events), w AS (SELECT *, CASE WHEN age > 72 THEN 0 ELSE pow(0.5, greatest(age, 0) / 24.0) END AS wt FROM a),
s AS (SELECT user_id, CASE WHEN sum(wt) > 0 THEN sum(wt * value) / sum(wt) END AS v, sum(wt) AS total FROM w GROUP BY user_id)
SELECT user_id, round(v + 1e-9, 6) AS signal, round(total + 1e-9, 6) AS weight, round(CASE WHEN v / 100 - 0.2 >= 0 THEN 1 + (v / 100 - 0.2) * 0.15 ELSE 1 + (v / 100 - 0.2) * 0.3 END + 1e-9, 6) AS multiplier FROM s""")
def staleness_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean weighted by age, nothing beyond the cutoff, and the multiplier made of it."""
    w = table(spark, sf_dir, "events").select("user_id", "value", decay(_age(), 24.0, 72.0).alias("wt"))
    s = w.groupBy("user_id").agg(ratio(F.sum(F.col("wt") * F.col("value")), F.sum("wt")).alias("v"), F.sum("wt").alias("total"))
    return s.select("user_id", fixed("v").alias("signal"), fixed("total").alias("weight"), fixed(piecewise_multiplier(F.col("v") / 100 - 0.2, 1.15, 0.70)).alias("multiplier"))


@query("""SELECT user_id, bool_or(event_type = 'error') AS any_error, bool_or(event_type = 'purchase' AND value > 50) AS big_purchase, bool_or(value < 0.5) AS tiny, CAST(count_if(event_type = 'click') AS BIGINT) AS clicks FROM events GROUP BY user_id""")
def bool_or_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags that hold where any row of the group has them."""
    t, v = F.col("event_type"), F.col("value")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.bool_or(t == "error").alias("any_error"), F.bool_or((t == "purchase") & (v > 50)).alias("big_purchase"), F.bool_or(v < 0.5).alias("tiny"), F.count_if(t == "click").alias("clicks"))


# Ordered rules, the first that matches gives category and sentiment.
RULES = ((r"(?i)(^|[^a-z])(ruled out|injur[a-z]*|kill[a-z]*)([^a-z]|$)", "injury", -0.8), (r"(?i)(^|[^a-z])(return[a-z]*|back|und)([^a-z]|$)", "return", 0.5), (r"(?i)(^|[^a-z])(the|start[a-z]*)([^a-z]|$)", "role", 0.2), (r"(?i)(^|[^a-z])(le|der|el)([^a-z]|$)", "news", 0.0))
_CASE = lambda i: "CASE " + " ".join(f"WHEN regexp_matches(t, '{r[0]}') THEN {repr(r[i]) if i == 1 else r[i]}" for r in RULES) + " END"


@query(f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents) SELECT doc_id, {_CASE(1)} AS category, CAST({_CASE(2)} AS DOUBLE) AS sentiment, regexp_matches(t, '{RULES[0][0]}') AS injury_flag FROM d")
def rule_text_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered patterns over whole texts: category, sentiment and a flag."""
    t = F.coalesce("text", F.lit(""))
    category, sentiment = F.lit(None).cast("string"), F.lit(None).cast("double")
    for pattern, name, s in reversed(RULES):
        hit = t.rlike(pattern)
        category, sentiment = F.when(hit, name).otherwise(category), F.when(hit, s).otherwise(sentiment)
    return table(spark, sf_dir, "documents").select("doc_id", category.alias("category"), sentiment.alias("sentiment"), t.rlike(RULES[0][0]).alias("injury_flag"))


_NAME = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '-', ' ', 'g'), '\\b(jr|sr|ii|iii|iv|v)\\b\\.?\\s*$', ''), '[^a-z ]', '', 'g'), ' +', ' ', 'g'))"


@query("WITH n AS (SELECT p_partkey AS id, p_name || CASE p_partkey % 4 WHEN 0 THEN ' Jr.' WHEN 1 THEN '-Smith III' WHEN 2 THEN '''s  O.' ELSE '' END AS raw FROM part) SELECT id, raw, " + _NAME.format("raw") + " AS name FROM n")
def name_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without suffix, hyphens and marks."""
    k = F.col("p_partkey") % 4
    raw = F.concat("p_name", F.when(k == 0, " Jr.").when(k == 1, "-Smith III").when(k == 2, "'s  O.").otherwise(""))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), raw.alias("raw"), normal_name(raw).alias("name"))


@query("""WITH b AS (SELECT item_id AS id, list_distinct(list_filter(str_split_regex(lower(text), '[^a-z]+'), lambda w: len(w) > 1)) AS t FROM benchmark), p AS (SELECT a.id AS ida, b.id AS idb, len(list_intersect(a.t, b.t)) AS c, len(list_distinct(list_concat(a.t, b.t))) AS u FROM b a JOIN b ON a.id < b.id)
SELECT ida, idb, round(c / u + 1e-9, 6) AS similarity FROM p WHERE u > 0 AND c / u >= 0.2""")
def jaccard_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of items with like sets of words, by shared rare words."""
    t = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) > 1))
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), t.alias("tokens"))
    return fuzzy_by_token(b, b, "tokens", 0.2).where("ida < idb").select("ida", "idb", fixed("similarity").alias("similarity"))


@query(r"""SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '<a\s+href="([^"]*)"', 1)) AS BIGINT) AS links, regexp_extract(url, '^https?://([^/]+)', 1) AS host, CAST(length(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '(?s)<[^>]*>', '', 'g')) AS BIGINT) AS text_chars FROM pages""")
def html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title, links, host and the length of the text of raw pages."""
    plain = F.regexp_replace(F.regexp_replace("html", r"(?s)<(script|style)[^>]*>.*?</(script|style)>", ""), r"(?s)<[^>]*>", "")
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit(r'<a\s+href="([^"]*)"'), 1)).cast("long").alias("links"),
        F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"), F.length(plain).cast("long").alias("text_chars"),
    )


@query("""WITH f AS (SELECT user_id, CASE event_type WHEN 'error' THEN 0.85 WHEN 'purchase' THEN 1.08 WHEN 'click' THEN 0.95 ELSE 1 END AS m FROM (SELECT DISTINCT user_id, event_type FROM events WHERE value > 30)) SELECT user_id, round(least(greatest(exp(sum(ln(m))), 0), 1.1) + 1e-9, 6) AS multiplier FROM f GROUP BY user_id""")
def event_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product of the factors of all active flags, within limits."""
    f = table(spark, sf_dir, "events").where("value > 30").select("user_id", "event_type").distinct()
    m = F.when(F.col("event_type") == "error", 0.85).when(F.col("event_type") == "purchase", 1.08).when(F.col("event_type") == "click", 0.95).otherwise(1.0)
    return f.groupBy("user_id").agg(fixed(F.least(F.greatest(F.exp(F.sum(F.log(m))), F.lit(0.0)), F.lit(1.1))).alias("multiplier"))


@query("""WITH s AS (SELECT unnest(range(0, (SELECT max(user_id) + 1 FROM events))) AS team), e AS (SELECT user_id AS team, count_if(event_type = 'error') AS neg, count_if(event_type = 'purchase') AS pos, count(*) AS n FROM events GROUP BY ALL)
SELECT team, CAST(coalesce(neg, 0) AS BIGINT) AS neg, CAST(coalesce(pos, 0) AS BIGINT) AS pos, CAST(coalesce(n, 0) - coalesce(neg, 0) - coalesce(pos, 0) AS BIGINT) AS neutral, CASE WHEN coalesce(pos, 0) > coalesce(neg, 0) THEN 'bullish' WHEN coalesce(pos, 0) < coalesce(neg, 0) THEN 'bearish' ELSE 'neutral' END AS label FROM s LEFT JOIN e USING (team)""")
def full_spine_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by tone for every team of a spine, silent ones too."""
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("team")).agg(F.count_if(F.col("event_type") == "error").alias("neg"), F.count_if(F.col("event_type") == "purchase").alias("pos"), F.count("*").alias("n"))
    d = e.agg(F.max("team").alias("most")).select(F.explode(F.sequence(F.lit(0).cast("long"), "most")).alias("team")).join(e, "team", "left").fillna(0)
    label = F.when(F.col("pos") > F.col("neg"), "bullish").when(F.col("pos") < F.col("neg"), "bearish").otherwise("neutral")
    return d.select("team", "neg", "pos", (F.col("n") - F.col("neg") - F.col("pos")).alias("neutral"), label.alias("label"))


@query("""WITH n AS (SELECT doc_id AS id, 'doc' AS kind, n_chars AS score FROM documents UNION ALL SELECT page_id, 'page', length(html) FROM pages) SELECT id, kind, score FROM n ORDER BY score DESC, kind, id LIMIT 20 OFFSET 20""")
def news_feed_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second page of a merged feed."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("doc").alias("kind"), F.col("n_chars").alias("score"))
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lit("page").alias("kind"), F.length("html").cast("long").alias("score"))
    return d.unionByName(p).orderBy(F.desc("score"), "kind", "id").offset(20).limit(20)


@query("""WITH t AS (SELECT doc_id, text FROM documents), k AS (SELECT doc_id, list_filter(['France', 'Berlin', 'Madrid', 'the', 'und', 'les', 'los'], lambda w: regexp_matches(coalesce(text, ''), '(^|[^A-Za-z])' || w || '([^A-Za-z]|$)')) AS teams FROM t) SELECT doc_id, teams, CAST(len(teams) AS BIGINT) AS n FROM k""")
def team_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of a fixed list of names a text mentions."""
    names = ("France", "Berlin", "Madrid", "the", "und", "les", "los")
    teams = F.array_compact(F.array(*[F.when(F.coalesce("text", F.lit("")).rlike(f"(^|[^A-Za-z]){n}([^A-Za-z]|$)"), n) for n in names]))
    return table(spark, sf_dir, "documents").select("doc_id", teams.alias("teams"), F.size(teams).cast("long").alias("n"))


@query(r"""WITH l AS (SELECT conv_id, turn, role, unnest(str_split(text, chr(10))) AS line FROM conversations), p AS (SELECT conv_id, turn, role, regexp_extract(line, '^(\w+) (.*?)[.,]', 1) AS first_word, line FROM l WHERE trim(line) <> '') SELECT conv_id, role, CAST(count(*) AS BIGINT) AS lines, CAST(count_if(first_word <> '') AS BIGINT) AS parsed, max(length(line)) AS longest FROM p GROUP BY ALL""")
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pasted log to lines, parsed by a pattern."""
    l = table(spark, sf_dir, "conversations").select("conv_id", "role", F.explode(F.split("text", "\n")).alias("line")).where(F.trim("line") != "")
    first = F.regexp_extract("line", r"^(\w+) (.*?)[.,]", 1)
    return l.groupBy("conv_id", "role").agg(F.count("*").alias("lines"), F.count_if(first != "").alias("parsed"), F.max(F.length("line")).cast("long").alias("longest"))


@query("""WITH e AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value FROM events) SELECT k, CAST(count(*) AS BIGINT) AS n, round(avg(value) + 1e-9, 6) AS mean FROM e WHERE k IS NOT NULL GROUP BY k""")
def explode_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON field as a typed column."""
    e = table(spark, sf_dir, "events").select(F.from_json("props", "k bigint")["k"].alias("k"), "value").where("k IS NOT NULL")
    return e.groupBy("k").agg(F.count("*").alias("n"), fixed(F.avg("value")).alias("mean"))


@query("""WITH e AS (SELECT user_id, event_id, event_type, value, ts FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-08'), b AS (SELECT user_id, round(sum(value * (event_id % 10 + 1)) / sum(event_id % 10 + 1) + 1e-9, 6) AS score, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY user_id) SELECT user_id, score, n FROM b ORDER BY score DESC, user_id LIMIT 25""")
def top_stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking of a trailing week by confidence-weighted means: a top-25 report."""
    w = F.col("event_id") % 10 + 1
    e = table(spark, sf_dir, "events").where("ts >= TIMESTAMP_NTZ '2024-01-01 00:00:00' AND ts < TIMESTAMP_NTZ '2024-01-08 00:00:00'")
    b = e.groupBy("user_id").agg(fixed(F.sum(F.col("value") * w) / F.sum(w)).alias("score"), F.count("*").alias("n"))
    return b.orderBy(F.desc("score"), "user_id").limit(25)
