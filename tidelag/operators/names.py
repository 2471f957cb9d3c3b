"""Names to ids: accent folding, normal forms, blocked fuzzy candidates and a chain of tie-breaks."""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelag.operators.joins import fuzzy_by_token
from tidelag.sources.sinks import stored

#: Generational suffixes, as they stand behind a name.
SUFFIXES = ("jr.", "jr", "sr.", "sr", "ii", "iii", "iv", "v")
#: Short names and the names that they stand for.
NICKNAMES = {
    "cmac": "christian mccaffrey",
    "aj brown": "a.j. brown",
    "dj moore": "d.j. moore",
    "dj chark": "d.j. chark",
    "tk": "travis kelce",
    "deebo": "deebo samuel",
    "hollywood": "marquise brown",
    "metcalf": "dk metcalf",
    "dk": "dk metcalf",
}


@lru_cache(1)
def _foldings() -> tuple[dict[str, str], dict[str, str]]:
    """What ASCII is left of every other character's compatibility decomposition: one letter, or several."""
    one, several = {}, {}
    for c in map(chr, range(128, 0x20000)):
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if x < "\x80")
        if plain:
            (one if len(plain) == 1 else several)[c] = plain
    return one, several


def ascii_folded(text: Column) -> Column:
    """text with accents off and compatibility forms spelled out; what has no ASCII form goes.

    Only texts that hold such characters take more than a look: single letters go through one translate, the few
    characters that stand for several letters one by one.
    """
    one, several = _foldings()
    plain = F.translate(text, "".join(one), "".join(one.values()))
    spelled = F.from_json(F.lit(json.dumps(several)), "map<string, string>")  # one literal, made once
    letters = F.transform(F.split(plain, ""), lambda c: F.when(c < "\x80", c).otherwise(F.coalesce(F.element_at(spelled, c), F.lit(""))))
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.array_join(letters, "")).otherwise(text)


def resolver_name(name: Column) -> Column:
    """ASCII, lower case, no dots, one suffix off, single spaces; null for null."""
    n = F.replace(F.lower(F.btrim(ascii_folded(name), F.lit(" \t\n\r\f\v"))), F.lit("."), F.lit(""))
    ending = "|".join(s.replace(".", "") for s in SUFFIXES if s.endswith(".") or s + "." not in SUFFIXES)
    return F.regexp_replace(F.regexp_replace(n, rf"\s+({ending})$", ""), r"\s+", " ")


def player_index(rosters: DataFrame, key: str = "player_id", full: str = "full_name", display: str | None = None, team: str = "team", position: str = "position", season: str = "season") -> DataFrame:
    """id, name, team, position, season of each player's latest row; rows without an id or a full name are left out.

    A display name counts where it is more than the full name's first word. Ties of a season go to the least of the
    other columns; a null season is 0.
    """
    name = F.col(full)
    if display is not None:
        d = F.trim(display)
        real = d.isNotNull() & (d != "") & (F.lower(d) != F.lower(F.element_at(F.split(F.trim(full), r"\s+"), 1)))
        name = F.when(real, d).otherwise(name)
    rows = rosters.where(F.col(key).isNotNull() & (F.trim(F.col(key).cast("string")) != "") & F.col(full).isNotNull())
    code = lambda c: F.coalesce(F.upper(F.trim(c)), F.lit(""))
    rows = rows.select(F.col(key).alias("id"), resolver_name(name).alias("name"), code(team).alias("team"), code(position).alias("position"), F.coalesce(F.col(season).cast("long"), F.lit(0)).alias("season"))
    return rows.groupBy("id").agg(F.min(F.struct((-F.col("season")).alias("s"), "name", "team", "position")).alias("r")).select("id", "r.name", "r.team", "r.position", (-F.col("r.s")).alias("season"))


def _nicknamed(name: Column, nicknames: dict[str, str]) -> Column:
    """The name that a nickname stands for; the array of one holds name, which costs several patterns, to one evaluation."""
    known = F.from_json(F.lit(json.dumps(nicknames)), "map<string, string>")
    return F.element_at(F.transform(F.array(name), lambda n: F.coalesce(F.element_at(known, n), n)), 1)


def resolve(mentions: DataFrame, index: DataFrame, name: str = "name", team: str | None = "team", position: str | None = "position", least: float = 0.8, nicknames: dict[str, str] = NICKNAMES, into: str = "player_id") -> DataFrame:
    """mentions with `into`, the id that a name means, null where none or several could be meant.

    Candidates have the same normal name; only a name that nobody has is looked up by its tokens, where
    a Jaccard similarity of `least` makes a candidate, found through rare tokens. Of several candidates those count
    that fit the team and the position, else the team, else the position, else all; of these the one of the
    latest season, if it is alone. Each different name with its hints is resolved once, and candidates are
    counted by how well they fit before they are shuffled, so a name that many rows mention or many
    players have is no large group. Null and blank names mean nobody.
    """
    normal = _nicknamed(resolver_name(F.col(name)), nicknames)
    hint = lambda c: F.upper(F.col(c)) if c is not None else F.lit(None).cast("string")
    blank_to_null = lambda c: F.nullif(c, F.lit(""))
    # Normal names cost several patterns: the explode of an array of one keeps filters from writing them a second time, and
    # what is asked is stored, as five steps read it.
    marked = mentions.select("*", F.explode(F.array(F.when(F.length(F.trim(name)) > 0, normal))).alias("__n"), blank_to_null(hint(team)).alias("__t"), blank_to_null(hint(position)).alias("__p"))
    asked = stored(marked.where("__n IS NOT NULL").select("__n", "__t", "__p").distinct(), "asked")
    names, known = asked.select(F.col("__n").alias("name")).distinct(), index.select("name").distinct()
    exact = names.join(known, "name", "left_semi").select("name", F.col("name").alias("as"))
    tokens = F.filter(F.split("name", " "), lambda t: t != "")
    sided = lambda d: d.select(F.col("name").alias("id"), tokens.alias("tokens"))
    fuzzy = fuzzy_by_token(sided(names.join(known, "name", "left_anti")), sided(known), "tokens", least).select(F.col("ida").alias("name"), F.col("idb").alias("as"))
    candidates = exact.union(fuzzy).join(index.withColumnRenamed("name", "as"), "as").drop("as").withColumnRenamed("name", "__n")
    fits = lambda hint, own: F.coalesce(F.col(hint) == F.col(own), F.lit(False))
    fit = 2 * fits("__t", "team").cast("int") + fits("__p", "position").cast("int")
    placed = asked.join(candidates, "__n").groupBy("__n", "__t", "__p", fit.alias("fit"), "season").agg(F.count("*").alias("c"), F.min("id").alias("id"))
    best = placed.groupBy("__n", "__t", "__p").agg(F.max(F.struct("fit", "season", "c", "id")).alias("b"))
    found = best.select(*[F.col(c).alias(f"{c}k") for c in ("__n", "__t", "__p")], F.when(F.col("b.c") == 1, F.col("b.id")).alias(into))
    on = [F.col("__n") == F.col("__nk"), F.col("__t").eqNullSafe(F.col("__tk")), F.col("__p").eqNullSafe(F.col("__pk"))]
    return marked.join(found, on, "left").select(*[marked[c] for c in mentions.columns], into)
