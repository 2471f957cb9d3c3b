"""Names to ids and ordered rules, by answers worked out by hand."""

import re
import unicodedata

from pyspark.sql import functions as F

from tidelag.operators import names, rules


def test_folding_is_compatibility_decomposition(spark):
    words = ["José", "Ångström", "ﬁeld", "Łukasz", "Ｆｕｌｌ", "㎏", "½", "naïve", "éa", "日本", "", "plain", "ǅ", "Ⅷ", "straße"]
    d = spark.createDataFrame([(w,) for w in words] + [(None,)], "w string")
    want = {w: unicodedata.normalize("NFKD", w).encode("ascii", "ignore").decode() for w in words} | {None: None}
    assert {r["w"]: r["f"] for r in d.select("w", names.ascii_folded(F.col("w")).alias("f")).collect()} == want


def test_normal_names(spark):
    cases = {"A.J. Brown Jr.": "aj brown", "DK Metcalf": "dk metcalf", "  Amon-Ra  St. Brown ": "amon-ra st brown", "Odell Beckham III": "odell beckham", "José Ramírez Sr": "jose ramirez", "Ivy": "ivy", "V": "v", "": ""}
    d = spark.createDataFrame(list(cases.items()), "raw string, want string")
    assert all(r["got"] == r["want"] for r in d.select("want", names.resolver_name(F.col("raw")).alias("got")).collect())


ROSTER = [
    ("p1", "Josh Allen", "Josh", "BUF", "QB", 2024), ("p2", "Josh Allen", None, "JAX", "DE", 2023), ("p2", "Josh Allen", None, "JAX", "LB", 2022),
    ("p3", "Kenneth Walker III", None, "SEA", "RB", 2024), ("p4", "José Núñez", None, "NYG", "WR", 2024), ("p5", "Jaime Jaquez Miller Smith Ortiz", None, "KC", "TE", 2024),
    ("p6", "Mike Williams", None, "NYJ", "WR", 2024), ("p7", "Mike Williams", None, "PIT", "WR", 2024), ("p8", "Robert Griffin", "RG Three", "WAS", "QB", 2013),
    ("p9", "Christian McCaffrey", None, "SF", "RB", None), (None, "Nobody", None, "SF", "RB", 2024), ("p10", None, None, "SF", "RB", 2024),
]


def test_resolver_chain(spark):
    roster = spark.createDataFrame(ROSTER, "player_id string, full_name string, football_name string, team string, position string, season int")
    index = names.player_index(roster, display="football_name")
    assert index.count() == 9 and index.where("id = 'p2'").first()["position"] == "DE"
    cases = [
        ("Josh Allen", "BUF", None, "p1"), ("josh allen", "jax", "de", "p2"), ("Josh Allen", None, "DE", "p2"), ("Josh Allen", None, None, "p1"), ("Josh Allen", "BUF", "DE", "p1"),
        ("Kenneth Walker", None, None, "p3"), ("Jose Nunez Jr.", None, None, "p4"), ("Jaime Miller Smith Ortiz", None, None, "p5"), ("Jaime Smith", None, None, None),
        ("Mike Williams", None, "WR", None), ("Mike Williams", "PIT", None, "p7"), ("Mike Williams", "SF", "WR", None), ("rg three", None, None, "p8"), ("Robert Griffin", None, None, None),
        ("CMac", None, None, "p9"), ("", None, None, None), ("  ", "BUF", None, None), (None, "BUF", "QB", None), ("Mike Williams", "", None, None),
    ]
    mentions = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)] + [(99, *cases[0])] * 2, "i int, name string, team string, position string, want string")
    got = names.resolve(mentions, index).collect()
    assert len(got) == len(cases) + 2
    assert [r for r in got if r["player_id"] != r["want"]] == []
    assert names.resolve(mentions.limit(0), index).count() == 0 and names.resolve(mentions, index.limit(0)).where("player_id IS NOT NULL").count() == 0
    assert names.resolve(mentions.select("i", "name"), index, team=None, position=None).where("i = 0").first()["player_id"] == "p1"


def test_phrases_are_spelled_out():
    join = lambda p: {"".join(w) for w in rules.spelled_out(p)}
    assert join("out for (the )?(season|week)") == {"out for season", "out for the season", "out for week", "out for the week"}
    assert join("winds? (over|of) ##") == {"wind over ##", "winds over ##", "wind of ##", "winds of ##"}


def test_first_rule_by_sentence(spark):
    texts = {
        "Travis Kelce activated from injured reserve": [("Travis Kelce", "trade", 0.4, 0.7, ("is_activated", "is_returning"))],
        "Patrick Mahomes is questionable. Travis Kelce has been RULED  out.": [("Patrick Mahomes", "injury", -0.3, 0.7, ("is_questionable",)), ("Travis Kelce", "injury", -0.9, 0.7, ("is_ruled_out",))],
        "Joe Mixon rumored to be traded. Joe Mixon waived": [("Joe Mixon", "trade", -0.5, 0.7, ("is_released",))],
        "Caleb Downs drafted by the Bears": [("Caleb Downs", "general", 0.4, 0.5, ("is_drafted",))],
        "Caleb Downs drafted by the AB": [],
        "Zay Flowers unsigned with no team": [], "ruled out": [], "Zay Flowers is fine": [], "": [],
        "Zay Flowers suspended 123 games": [], "Zay Flowers suspended 12 games": [("Zay Flowers", "injury", -0.8, 0.7, ("is_suspended",))],
        "Zay Flowers is a salary cap cut by rule": [("Zay Flowers", "trade", -0.5, 0.7, ("is_released",))],
        "Zay Flowers " + "x" * 510 + " benched": [],
        "gusts of 45 mph for Zay Flowers": [("Zay Flowers", "weather", -0.3, 0.7, ("is_weather_risk",))],
    }
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, None)]
    got = {}
    for r in rules.signals(spark.createDataFrame(rows, "doc_id int, text string")).collect():
        got.setdefault(r["doc_id"], []).append((r["player_name"], r["category"], r["sentiment"], r["confidence"], tuple(r["flags"])))
    assert {i: sorted(got.get(i, [])) for i in range(len(texts))} == {i: sorted(want) for i, want in enumerate(texts.values())} and 100 not in got


def test_a_text_is_read_once_however_many_rules():
    many = [rules.Rule("general", 0.0, (), (f"{a}{b} word",)) for a in "abcdefghij" for b in "klmnopqrst"]
    pattern = rules.RuleBook(many).pattern
    assert len(pattern) < 2000 and re.search(pattern.replace("(?i)", ""), "it is cp word").group(1) == "cp word"


def test_rules_read_windows_not_whole_texts(spark, tmp_path):
    spark.createDataFrame([(1, "Zay Flowers is benched. Nobody was waived")], "doc_id int, text string").write.parquet(str(tmp_path / "docs"))
    plan = rules.signals(spark.read.parquet(str(tmp_path / "docs")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("w(?:orkhorse") == 2  # once for windows, once for sentences with a word of the name


def test_a_mention_is_made_normal_once(spark, tmp_path):
    spark.createDataFrame([(1, "Mike Williams", "SF", "WR")], "i int, name string, team string, position string").write.parquet(str(tmp_path / "m"))
    spark.createDataFrame([("p1", "mike williams", "SF", "WR", 2024)], "id string, name string, team string, position string, season long").write.parquet(str(tmp_path / "x"))
    resolved = names.resolve(spark.read.parquet(str(tmp_path / "m")), spark.read.parquet(str(tmp_path / "x")))
    assert resolved._jdf.queryExecution().executedPlan().toString().count("(jr|sr|ii|iii|iv|v)$") == 1
