"""Deduplication of line runs by prefix doubling over line ids, in DataFrame functions only.

Every line that holds a word starts a suffix of its document's sequence of such lines. Suffixes with the
same first m lines form an interval of the suffix array whose longest common prefix is m or more; its rank
is its earliest suffix, by document and line. Joining each suffix's rank with that of the suffix m lines
on gives the intervals of length 2m. Suffixes alone in their interval drop out on the way, so only what
repeats moves on, until nothing repeats at the next length.

The longest prefix that a suffix shares with an earlier one lies between two such lengths. It is found
exactly by halving steps: the interval of p + s lines, s < p, is that of the ranks of the suffix and of
the one s lines on, both p lines long. A suffix whose shared prefix is not the rest of the one a line
before starts a maximal repeated run; runs that are long enough are deleted, but for their first copy.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelag.llm.common import GAP, drop_staged, stage, unused, where_made

#: A run is deleted if it has at least so many lines that hold a word, or at least so many words.
MIN_LINES = 3
MIN_WORDS = 50
#: Groups with more than this part of the rows, so at most as many of them, are broadcast and their rows dealt over SALTS.
HOT_GROUPS = 1000
SALTS = 64
#: The documents' runs are broadcast up to about so many bytes, joined by a shuffle beyond.
BROADCAST_BYTES = 32_000_000
_RUN_BYTES, _DOC_BYTES = 40, 100


def _has_word(line: Column) -> Column:
    return line.rlike(f"[^{GAP[1:-2]}]")


def _identity(key: str, text: str) -> Column:
    """A document's place in the order: its key, nulls first, then its text's hash."""
    return F.struct(F.col(key).alias("key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"))


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """k, j, a, b (128 bits of hash), w (words) of every line that holds a word.

    Words are counted between single spaces, which is cheaper than a pattern.
    """
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), _has_word)
    words = F.filter(F.split(F.translate("line", "\t\v\f\r", "    "), " "), lambda w: w != "")
    each = docs.select(_identity(key, text).alias("k"), F.posexplode(lines).alias("j", "line"))
    return each.select("k", "j", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), F.col("line")).alias("b"), F.size(words).alias("w"))


def _regroup(suffixes: DataFrame, by: list[str]) -> DataFrame:
    """The suffixes whose columns `by` occur more than once, with the earliest such suffix as name.

    Groups are counted by pre-aggregation. Rows of hot groups, of which there are HOT_GROUPS at most, are
    dealt over SALTS tasks of the join.
    """
    groups = stage(suffixes.groupBy(*by).agg(F.count("*").alias("n"), F.min(F.struct("k", "j")).alias("name")).where("n > 1"), "groups")
    total = groups.agg(F.sum("n")).first()[0] or 0
    hot = groups.where(F.col("n") * HOT_GROUPS > total).select(*by, F.lit(True).alias("hot"))
    deal = F.when(F.col("hot"), F.pmod(F.xxhash64("k", "j"), F.lit(SALTS))).otherwise(0).cast("int")
    salts = F.when(F.col("n") * HOT_GROUPS > total, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    dealt = suffixes.join(F.broadcast(hot), by, "left").withColumn("salt", deal).drop("hot")
    return dealt.join(groups.select(*by, "name", F.explode(salts).alias("salt")), [*by, "salt"]).drop(*by, "salt")


def _longer(suffixes: DataFrame, offset: int) -> DataFrame:
    """Groups by a suffix's name and the name of the suffix `offset` lines on in the same document."""
    ahead = Window.partitionBy("k").orderBy("j").rangeBetween(offset, offset)
    both = suffixes.select("k", "j", F.col("name").alias("one"), F.first("name").over(ahead).alias("next")).where("next IS NOT NULL")
    return _regroup(stage(both, "pairs"), ["one", "next"])


def _is_later(lines: Column) -> Column:
    """Whether a suffix's first lines stand earlier, at name, and do not overlap themselves there."""
    k, j, name = F.col("k"), F.col("j"), F.col("name")
    return (name["k"] < k) | ((name["k"] == k) & (j - name["j"] >= lines))


def suffix_ranks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """m, k, j, name, w, upto for m = 1, 2, 4, ...: suffixes whose first m lines occur more than once, and where first.

    w and upto, of m = 1 only, are the words of the suffix's first line, and of that and all such lines before
    it. Repeated rows are one document. Every round is written and read again, and ends when nothing repeats at the next length.
    """
    upto = F.sum("w").over(Window.partitionBy("k").orderBy("j"))
    lines = stage(_lines(docs, key, text), "lines")
    now = stage(_regroup(lines, ["a", "b"]).repartition("k").distinct().withColumn("upto", upto), "suffixes")
    m, rounds, tables = 1, [], [lines, now]
    while not rounds or now.limit(1).count():
        rounds.append(now.withColumn("m", F.lit(m)))
        now, m = stage(_longer(now, m), "suffixes"), 2 * m
        tables.append(now)
    out = stage(reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), rounds), "ranks")
    for t in tables:
        drop_staged(t)
    return out


def later_copies(ranks: DataFrame) -> DataFrame:
    """k, j, lines, name: every suffix of suffix_ranks() with the most lines that stand earlier, at name, without overlap."""
    later = ranks.where(_is_later(F.col("m")))
    now = later.groupBy("k", "j").agg(F.max("m").alias("p"), F.max_by("name", "m").alias("name"))
    now = stage(now.select("k", "j", "p", F.col("name").alias("rank"), F.lit(0).alias("s"), "name"), "copies")
    step = (now.agg(F.max("p")).first()[0] or 1) // 2
    while step:
        of_length = ranks.where(F.col("m") > step).select(F.col("m").alias("p"), "k", "j", F.col("name").alias("rank"))
        tried = now.where(F.col("p") > step).select("p", "rank", (F.col("s") + step).alias("s")).distinct()
        on = of_length.select("p", "k", (F.col("j")).alias("at"), F.col("rank").alias("next"))
        pairs = of_length.join(tried, ["p", "rank"]).withColumn("at", F.col("j") + F.col("s")).join(on, ["p", "k", "at"]).drop("at")
        pairs = stage(pairs, "tried")
        first = pairs.groupBy("p", "rank", "s", "next").agg(F.min(F.struct("k", "j")).alias("name"))
        found = pairs.join(first, ["p", "rank", "s", "next"]).where(_is_later(F.col("p") + F.col("s"))).select("k", "j", "p", (F.col("s") - step).alias("s"), F.col("name").alias("farther"))
        after = now.join(found, ["k", "j", "p", "s"], "left").withColumn("s", F.col("s") + F.when(F.col("farther").isNotNull(), step).otherwise(0))
        after = stage(after.withColumn("name", F.coalesce("farther", "name")).drop("farther"), "copies")
        drop_staged(now)
        drop_staged(pairs)
        now, step = after, step // 2
    return now.select("k", "j", (F.col("p") + F.col("s")).alias("lines"), "name")


def repeated_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """k, start, lines, source: the maximal runs that stand earlier, at source, and are long enough.

    Lines that hold a word count, from 0. A run is maximal if it is not the rest of the one that starts a
    line before; runs may overlap each other. It is long enough with min_lines lines or min_words words.
    """
    ranks = suffix_ranks(docs, key, text)
    before = Window.partitionBy("k").orderBy("j").rangeBetween(-1, -1)
    maximal = later_copies(ranks).withColumn("before", F.first("lines").over(before)).where(F.coalesce("before", F.lit(0)) <= F.col("lines"))
    first = ranks.where("m = 1").select("k", "j", "w", "upto")
    last = first.select("k", (F.col("j") + 1).alias("end"), "upto")
    sized = maximal.drop("before").join(first.select("k", "j", (F.col("upto") - F.col("w")).alias("before")), ["k", "j"]).withColumn("end", F.col("j") + F.col("lines")).join(last, ["k", "end"])
    enough = (F.col("lines") >= min_lines) | (F.col("upto") - F.col("before") >= min_words)
    return sized.where(enough).select("k", F.col("j").alias("start"), "lines", F.struct(F.col("name.k.key").alias("key"), F.col("name.j").alias("line")).alias("source"))


def dedupe(docs: DataFrame, key: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, into: str = "__d") -> DataFrame:
    """docs with the runs' lines deleted from text, and struct column `into`: n_lines, n_removed, n_runs, longest_run.

    The runs are those of repeated_runs(); n_runs counts them and longest_run is the most lines of one.
    n_lines counts lines that hold a word; other lines are passed over and stay. The first copy of a run by
    key, then line, stays whole: a run never overlaps the copy that it is held against. Null text stays null,
    with zeros; null keys come first in the order. Rows of equal key and text are one document and get equal
    results; equal texts of other keys are copies. Texts of any length are read whole, one row of an array of lines each.
    """
    runs = repeated_runs(docs, key, text, min_lines, min_words).groupBy("k").agg(F.collect_list(F.struct("start", "lines")).alias("runs"))
    runs = stage(runs, "runs")
    size = runs.agg(F.count("*").alias("docs"), F.sum(F.size("runs")).alias("runs")).first()
    few = _DOC_BYTES * size["docs"] + _RUN_BYTES * (size["runs"] or 0) <= BROADCAST_BYTES
    k, r, lines, words, kept = (unused(docs, c) for c in ("k", "runs", "lines", "words", "kept"))
    runs = runs.select(F.col("k").alias(k), F.col("runs").alias(r))
    d = docs.withColumn(k, _identity(key, text)).join(F.broadcast(runs) if few else runs, k, "left")
    d = d.withColumn(lines, F.split(F.coalesce(F.col(text), F.lit("")), "\n"))
    d = d.withColumn(words, F.filter(F.transform(lines, lambda x, i: F.when(_has_word(x), i)), lambda i: i.isNotNull()))
    gone = F.flatten(F.transform(r, lambda x: F.slice(F.col(words), x["start"] + 1, x["lines"])))
    d = d.withColumn(kept, F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone))
    rest = F.array_join(F.transform(kept, lambda i: F.get(F.col(lines), i)), "\n")
    has = F.col(r).isNotNull()
    n = lambda x: F.when(has, x.cast("long")).otherwise(F.lit(0).cast("long"))
    counts = F.struct(
        F.size(words).cast("long").alias("n_lines"), n(F.size(lines) - F.size(kept)).alias("n_removed"),
        n(F.size(r)).alias("n_runs"), n(F.array_max(F.transform(r, lambda x: x["lines"]))).alias("longest_run"),
    )
    return d.select(*[F.when(has, rest).otherwise(F.col(text)).alias(c) if c == text else F.col(c) for c in docs.columns], counts.alias(into))


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """docs after dedupe(), columns unchanged, without documents of which no word is left by the deletion."""
    into = unused(docs, "d")
    d = dedupe(docs, key, text, min_lines, min_words, into)
    return where_made(d, (F.col(f"{into}.n_removed") == 0) | (F.col(f"{into}.n_removed") < F.col(f"{into}.n_lines"))).drop(into)
