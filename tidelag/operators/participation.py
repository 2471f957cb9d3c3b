"""Who is on the field: lists of players of a play, taken apart, with shares, trends, and who met whom."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelag.functions import windows as W
from tidelag.functions.scalars import ratio

# Windows of weeks and the least number of values in them.
TRAIL, LEAST_MEAN, LEAST_SLOPE = 4, 2, 3
# Positions of corner backs and of the offensive line, the line's places from left to right.
CORNERS = ("CB", "DB")
LINE, LINE_PLACES = ("T", "G", "C", "OT", "OG", "OL"), ("LT", "LG", "C", "RG", "RT")
# Defenders of a light and of a heavy box, air yards below which a pass is short.
LIGHT_BOX, HEAVY_BOX, SHORT_PASS = 6, 7, 5.0


def players_of(column: str) -> Column:
    """The ids of a list such as "a; b;c": trimmed, blanks left out, repeats kept; empty for null."""
    return F.filter(F.transform(F.split(F.coalesce(column, F.lit("")), ";"), lambda p: F.trim(p)), lambda p: p != "")


def on_field(plays: DataFrame, sides: dict[str, str], keys: Sequence[str], rosters: DataFrame | None = None) -> DataFrame:
    """keys, player_id, side, position: a row for each player of each play, by one scan of plays.

    sides maps a list column to its side's name. rosters has player_id, position and season: the position of
    the latest season counts, the greatest of ties; players that it lacks are UNK. The join is by player; adaptive execution
    splits players who are in many plays.
    """
    sided = lambda side: lambda p: F.struct(p.alias("player_id"), F.lit(side).alias("side"))
    each = F.flatten(F.array(*[F.transform(players_of(c), sided(s)) for c, s in sides.items()]))
    out = plays.select(*keys, F.explode(each).alias("__p")).select(*keys, "__p.*")
    if rosters is None:
        return out.withColumn("position", F.lit("UNK"))
    latest = rosters.where("player_id IS NOT NULL").groupBy(F.col("player_id").cast("string").alias("player_id")).agg(F.max(F.struct("season", "position")).alias("__r"))
    return out.join(latest, "player_id", "left").select(*keys, "player_id", "side", F.coalesce("__r.position", F.lit("UNK")).alias("position"))


def line_roles(field: DataFrame, depth: DataFrame) -> DataFrame:
    """Rows of field that are offensive linemen, with ol_label and is_starter of a depth chart (player_id, position, depth_team, season).

    A chart's row counts if its position is one of the line; of several the latest, then the greatest place. Without one the
    label is the position and nobody starts.
    """
    charted = depth.where(F.col("position").isin(*LINE, *LINE_PLACES)).groupBy(F.col("player_id").cast("string").alias("player_id")).agg(F.max(F.struct("season", "position", (F.col("depth_team") == 1).alias("first"))).alias("__d"))
    line = field.where((F.col("side") == "offense") & F.col("position").isin(*LINE))
    return line.join(charted, "player_id", "left").select(*field.columns, F.coalesce("__d.position", "position").alias("ol_label"), F.coalesce("__d.first", F.lit(False)).alias("is_starter"))


def route_participation(plays: DataFrame, players: str = "offense_players", team: str = "posteam", dropback: str = "qb_dropback") -> DataFrame:
    """Per player, team, season and week: share of the team's dropbacks with the player on the field, and its trend in earlier weeks.

    The team's dropbacks are those with a list of players. Counts are aggregated before they are shuffled; weeks of a season in which the player
    did not play are no rows, so windows count games. Null where fewer than LEAST_MEAN earlier games, for the slope LEAST_SLOPE.
    """
    backs = plays.where((F.col(dropback) == 1) & F.col(players).isNotNull())
    week = [team, "season", "week"]
    total = backs.groupBy(*week).agg(F.count("*").alias("team_dropbacks"))
    own = backs.select(*week, F.explode(players_of(players)).alias("player_id")).groupBy("player_id", *week).agg(F.count("*").alias("dropbacks_on_field"))
    r = own.join(total, week).withColumn("route_rate", F.col("dropbacks_on_field") / F.col("team_dropbacks"))
    w = W.by(("player_id", "season"), ("week", team))
    r = r.withColumn("route_rate_trail4", W.lagged_mean("route_rate", w, TRAIL, LEAST_MEAN))
    return r.withColumns({"route_rate_delta": F.col("route_rate_trail4") - F.lag("route_rate_trail4").over(w), "route_rate_slope": W.lagged_slope("route_rate", w, TRAIL, LEAST_SLOPE)}).withColumnRenamed(team, "recent_team")


def target_rates(routes: DataFrame, targets: DataFrame) -> DataFrame:
    """routes with tprr (targets a dropback on the field), its trend in earlier games, and the product of both trends.

    targets has player_id, season, week and targets; a player without a row had none.
    """
    t = routes.join(targets.select("player_id", "season", "week", "targets"), ["player_id", "season", "week"], "left")
    t = t.withColumn("tprr", ratio(F.coalesce("targets", F.lit(0)), "dropbacks_on_field")).drop("targets")
    w = W.by(("player_id", "season"), ("week", "recent_team"))
    t = t.withColumns({"tprr_trail4": W.lagged_mean("tprr", w, TRAIL, LEAST_MEAN), "tprr_trail4_slope": W.lagged_slope("tprr", w, TRAIL, LEAST_SLOPE)})
    return t.withColumn("tprr_x_route_slope", F.col("tprr_trail4") * F.col("route_rate_slope"))


def receiver_matchups(passes: DataFrame) -> DataFrame:
    """Nine measures of each receiver against each defence in a week, by one aggregation beside the team's targets.

    passes: one row a pass with receiver, posteam, defteam, season, week, complete, air_yards, yac, epa, box and
    location. These are outcomes of the same game; a model takes them lagged.
    """
    keys = ["receiver", "defteam", "season", "week"]
    thrown = passes.where(F.col("receiver").isNotNull() & (F.col("receiver") != ""))
    short, middle = F.col("air_yards") < SHORT_PASS, F.col("location") == "middle"
    within = lambda of, cond: F.sum(F.when(cond, F.col(of)))
    count = lambda cond: F.count_if(cond)
    light, heavy = F.col("box") <= LIGHT_BOX, F.col("box") >= HEAVY_BOX
    a = thrown.groupBy(*keys).agg(
        F.count("*").alias("targets"), F.sum("complete").alias("catches"), F.coalesce(F.sum("air_yards"), F.lit(0)).alias("air"), F.coalesce(F.sum(F.col("air_yards") * F.col("complete")), F.lit(0)).alias("done"), F.coalesce(F.sum("yac"), F.lit(0)).alias("yac"),
        within("epa", light).alias("light"), count(light).alias("n_light"), within("epa", heavy).alias("heavy"), count(heavy).alias("n_heavy"), within("complete", short).alias("short"), count(short).alias("n_short"),
        within("epa", middle).alias("middle"), count(middle).alias("n_middle"), F.max("posteam").alias("posteam"),
    )
    team = thrown.groupBy("posteam", "defteam", "season", "week").agg(F.count("*").alias("team_targets"))
    named = lambda name, x, y: ratio(x, y).alias(f"wr_matchup_{name}")
    return a.join(team, ["posteam", "defteam", "season", "week"]).select(
        *keys, named("target_concentration", "targets", "team_targets"), named("air_yards_per_target", "air", "targets"), named("completed_air_yards_per_target", "done", "targets"), named("yac_per_catch", "yac", "catches"),
        named("light_box_epa", "light", "n_light"), named("heavy_box_epa", "heavy", "n_heavy"), named("short_pass_completion_rate", "short", "n_short"), named("middle_target_rate", "n_middle", "targets"), named("middle_epa", "middle", "n_middle"),
    )


def met_corners(passes: DataFrame, rosters: DataFrame, players: str = "defense_players") -> DataFrame:
    """receiver, corner, season, week: plays together and yards, and what they had together in earlier weeks of all seasons.

    A play's list of defenders is taken apart in its own row, so no pair reaches beyond a play; a defender
    who is listed twice counts twice. Pairs are aggregated by week before the history is laid over them.
    """
    thrown = passes.where(F.col("receiver").isNotNull() & (F.col("receiver") != ""))
    cbs = on_field(thrown, {players: "defense"}, ["receiver", "season", "week", "yards"], rosters).where(F.col("position").isin(*CORNERS))
    pairs = cbs.groupBy("receiver", F.col("player_id").alias("corner"), "season", "week").agg(F.count("*").alias("plays"), F.sum(F.coalesce("yards", F.lit(0))).alias("yards"))
    w = W.by(("receiver", "corner"), ("season", "week"))
    before = lambda c: F.coalesce(W.lagged_sum(c, w), F.lit(0)).alias(f"{c}_before")
    return pairs.select("*", before("plays"), before("yards"))
