"""Mentions of players in rosters and texts: names to ids, ordered rules by sentence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelag.operators import names, rules
from tidelag.plans.inputs import query
from tidelag.sources.tables import table

_PLAYER = """players AS (SELECT p_partkey AS id, chr(CAST(65 + p_partkey % 26 AS INTEGER)) || '.' || chr(CAST(65 + p_partkey // 26 % 26 AS INTEGER)) || '. ' || p_name || ' ' || lower(p_type) AS plain,
  CASE p_partkey % 3 WHEN 0 THEN ' Jr.' WHEN 1 THEN ' III' ELSE '' END AS suffix, p_brand AS team, p_type AS position, 1995 + p_partkey % 7 AS season FROM part)"""
_NORMAL = r"regexp_replace(regexp_replace(replace(lower(trim(regexp_replace(strip_accents({0}), '[^\x00-\x7F]', '', 'g'))), '.', ''), '\s+(jr|sr|ii|iii|iv|v)$', ''), '\s+', ' ', 'g')"


@query(f"""WITH {_PLAYER},
idx AS (SELECT id, {_NORMAL.format("replace(replace(plain, 'e', 'é'), 'o', 'ô') || suffix")} AS name, upper(team) AS team, upper(position) AS position, season FROM players),
m AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, CASE l_linenumber % 5 WHEN 0 THEN upper(plain) WHEN 1 THEN replace(plain, 'a', 'ä') || ' Sr' WHEN 2 THEN 'the ' || plain WHEN 3 THEN replace(plain, 'widget', 'gadget') ELSE plain || '  IV' END AS raw,
  CASE WHEN l_orderkey % 3 < 2 THEN p.team END AS team, CASE l_orderkey % 4 WHEN 0 THEN p.position WHEN 1 THEN 'PROMO' END AS position FROM lineitem JOIN players p ON l_partkey = p.id),
n AS (SELECT *, {_NORMAL.format("raw")} AS name FROM m), k AS (SELECT DISTINCT name FROM n), o AS (SELECT DISTINCT name FROM idx),
x AS (SELECT k.name, k.name AS other FROM k JOIN o ON k.name = o.name),
t AS (SELECT name, list_distinct(list_filter(str_split(name, ' '), lambda w: w <> '')) AS t FROM k WHERE name NOT IN (SELECT name FROM o)), u AS (SELECT name, list_distinct(list_filter(str_split(name, ' '), lambda w: w <> '')) AS t FROM o),
z AS (SELECT * FROM x UNION ALL SELECT t.name, u.name FROM t, u WHERE len(list_intersect(t.t, u.t)) >= 0.8 * (len(t.t) + len(u.t) - len(list_intersect(t.t, u.t)))),
a AS (SELECT DISTINCT n.name, n.team, n.position FROM n),
c AS (SELECT a.name, a.team, a.position, idx.id, idx.season, 2 * CAST(coalesce(a.team = idx.team, false) AS INTEGER) + CAST(coalesce(a.position = idx.position, false) AS INTEGER) AS fit FROM (SELECT name, upper(team) AS team, upper(position) AS position FROM a) a JOIN z ON z.name = a.name JOIN idx ON idx.name = z.other),
b AS (SELECT *, max(fit) OVER (PARTITION BY name, team, position) AS best FROM c), s AS (SELECT *, max(season) OVER (PARTITION BY name, team, position) AS latest FROM b WHERE fit = best),
r AS (SELECT name, team, position, CASE WHEN count(*) = 1 THEN min(id) END AS id FROM s WHERE season = latest GROUP BY name, team, position)
SELECT n.l_orderkey AS mention, n.line, n.raw, r.id AS player_id FROM n LEFT JOIN r ON r.name = n.name AND r.team IS NOT DISTINCT FROM upper(n.team) AND r.position IS NOT DISTINCT FROM upper(n.position)""")
def name_resolver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whom each mention means: accents, initials, suffixes, an extra word, hints of team and position."""
    k = F.col("p_partkey")
    initial = lambda x: F.chr(65 + x % 26)
    plain = F.concat(initial(k), F.lit("."), initial(F.floor(k / 26)), F.lit(". "), "p_name", F.lit(" "), F.lower("p_type"))
    suffix = F.when(k % 3 == 0, " Jr.").when(k % 3 == 1, " III").otherwise("")
    players = table(spark, sf_dir, "part").select(k.alias("id"), plain.alias("plain"), suffix.alias("suffix"), F.col("p_brand").alias("team"), F.col("p_type").alias("position"), (1995 + k % 7).alias("season"))
    roster = players.withColumn("full_name", F.concat(F.translate("plain", "eo", "éô"), "suffix"))
    index = names.player_index(roster, key="id")
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("mention"), F.col("l_linenumber").cast("long").alias("line"), F.col("l_partkey").alias("id")).join(players, "id")
    way, hint = F.col("line") % 5, F.col("mention")
    raw = F.when(way == 0, F.upper("plain")).when(way == 1, F.concat(F.translate("plain", "a", "ä"), F.lit(" Sr"))).when(way == 2, F.concat(F.lit("the "), "plain")).when(way == 3, F.replace("plain", F.lit("widget"), F.lit("gadget"))).otherwise(F.concat("plain", F.lit("  IV")))
    mentions = l.select("mention", "line", raw.alias("raw"), F.when(hint % 3 < 2, F.col("team")).alias("team"), F.when(hint % 4 == 0, F.col("position")).when(hint % 4 == 1, F.lit("PROMO")).alias("position"))
    return names.resolve(mentions, index, "raw").select("mention", "line", "raw", "player_id")


# Sentences that stand in for news, one of them behind each document's own text.
NEWS = (
    "Josh Allen was activated  from injured reserve. Travis Kelce is questionable!",
    "Amon-Ra St. Brown signed a two-year deal; A.J. Brown sat out\nSam Darnold is robust",
    "Coach Smith: Derrick Henry suspended 12 games. Derrick Henry was drafted by the Titans",
    "Justin Jefferson limited to 30 snaps, sustained gusts of 45mph in Green Bay",
    "Patrick Mahomes could land in Miami. Rumored to be traded. Joe Mixon is a salary cap cut",
    "Nothing to see. RELEASED by nobody. Davante Adams Jr. agrees to terms, ruled out for the season",
    "Marvin Harrison Jr. HOLDING OUT; Cooper Kupp earned starting job and DNP. Bo Nix inactive",
    "no names here: waived, benched, blizzard",
)


def _news(key: str, text: str) -> F.Column:
    return F.concat(F.coalesce(text, F.lit("")), F.lit("\n"), F.element_at(F.array(*[F.lit(n) for n in NEWS]), (F.col(key) % len(NEWS) + 1).cast("int")))


_MARKS = {" ": r"\s+", "##": r"[0-9]{2,}", "#": r"[0-9]{1,2}", "<": r"\b", ">": r"\b", "@": r"\w{3,20}\b"}


def _sql_pattern(rule: rules.Rule) -> str:
    """A rule as one plain pattern, for the SQL to match rule by rule."""
    phrases = [p.replace(" ?", r"\s*") for p in rule.phrases]
    for mark in ("##", "#", " ", "<", ">", "@"):
        phrases = [p.replace(mark, _MARKS[mark]) if mark != "#" else p.replace("#", _MARKS["#"]) for p in phrases]
    return "(?i)" + "|".join(f"(?:{p})" for p in phrases)


_QUOTED = lambda s: "'" + s.replace("'", "''") + "'"
_WAYS = " ".join(f"WHEN len(list_filter(w, lambda x: regexp_matches(x, {_QUOTED(_sql_pattern(r))}))) > 0 THEN {i}" for i, r in enumerate(rules.RULES))
_ANY = "(?i)" + "|".join(_sql_pattern(r).removeprefix("(?i)") for r in rules.RULES)
_SAID = ", ".join(f"({i}, '{r.category}', CAST({r.sentiment} AS DOUBLE), CAST({rules.DRAFT_CONFIDENCE if r.flags and set(r.flags) <= set(rules.DRAFT_FLAGS) else rules.CONFIDENCE} AS DOUBLE), '{';'.join(r.flags)}')" for i, r in enumerate(rules.RULES))


@query(rf"""WITH d AS (SELECT doc_id, coalesce(text, '') || chr(10) || [{', '.join(n.replace(chr(10), "' || chr(10) || '") for n in map(_QUOTED, NEWS))}][CAST(doc_id % {len(NEWS)} + 1 AS INTEGER)] AS t FROM documents),
m AS (SELECT doc_id, t, list_filter(str_split_regex(t, '[.!?\n]'), lambda x: regexp_matches(x, {_QUOTED(_ANY)})) AS told FROM d),
e AS (SELECT doc_id, t, told, unnest(list_distinct(regexp_extract_all(t, {_QUOTED(rules.NAME)}, 1))) AS player_name FROM m WHERE len(told) > 0),
n AS (SELECT * FROM e WHERE len(list_filter(told, lambda x: len(list_filter(str_split_regex(player_name, '\s'), lambda y: contains(x, y))) > 0)) > 0),
q AS (SELECT doc_id, player_name, str_split(t, player_name) AS p FROM n),
s AS (SELECT doc_id, player_name, list_transform(range(1, len(p)), lambda i: regexp_extract(right(p[i], {rules.REACH}), '[^.!?\n]*$') || player_name || regexp_extract(p[i + 1], '^[^.!?\n]{{0,{rules.REACH}}}')) AS w FROM q),
h AS (SELECT doc_id, player_name, CASE {_WAYS} END AS rule FROM s), r(rule, category, sentiment, confidence, flags) AS (VALUES {_SAID})
SELECT doc_id, player_name, category, sentiment, confidence, flags FROM h JOIN r USING (rule)""")
def rule_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What news behind the documents say about the players that they name, by sentence."""
    docs = table(spark, sf_dir, "documents").select("doc_id", _news("doc_id", "text").alias("text"))
    return rules.signals(docs).withColumn("flags", F.array_join("flags", ";"))
