"""Ordered text rules matched in one pass: all phrases of all rules are one trie, looked for at each place of a text.

A rule is a list of phrases. In a phrase ( | ) are choices and ? makes what stands before it optional; a blank stands for
any white space, # for one or two digits, ## for two or more, < and > for a word's edge, @ for the start of
a word of 3 to 20 letters. The number of rules does not change how often a text is read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """What the first of a list of rules that a text matches says: category, sentiment, flags."""

    category: str
    sentiment: float
    flags: tuple[str, ...]
    phrases: tuple[str, ...]


# Rules in order of priority.
RULES = (
    Rule("trade", 0.4, ("is_activated", "is_returning"), ("activated from (ir|injured reserve|pup|suspension)",)),
    Rule("trade", -0.5, ("is_released",), ("released", "waived", "cut by", "designated for release")),
    Rule("trade", 0.2, ("is_signed",), ("<signed with", "<signed a (one|two|three|four|five)( |-)year", "agrees? to terms", "contract extension", "inked a deal", "claimed off waivers")),
    Rule("trade", -0.2, ("is_traded",), ("traded to", "deal sends", "acquired (via|in) trade", "dealt to", "trade (sends|acquires)")),
    Rule("injury", -0.9, ("is_ruled_out",), ("ruled out", "will not play", "out for (the )?(season|game|week)")),
    Rule("injury", -0.9, ("is_ruled_out",), ("placed on ir", "injured reserve", "out for season")),
    Rule("injury", -0.7, ("is_inactive",), ("inactive",)),
    Rule("injury", -0.6, (), ("doubtful", "unlikely to play")),
    Rule("injury", -0.4, (), ("did not practice", "dnp", "sat out")),
    Rule("injury", -0.3, ("is_questionable",), ("questionable", "game( |-)time decision", "50( |-)50")),
    Rule("injury", -0.1, (), ("limited participant", "limited practice", "limited in")),
    Rule("injury", -0.8, ("is_suspended",), ("suspended by the (league|team)", "suspended # game", "suspended (one|two|three|four|five|six|eight|ten|twelve) game", "suspended indefinitely", "serving a suspension")),
    Rule("injury", 0.4, ("is_returning",), ("return(ed)? to practice", "coming back")),
    Rule("injury", 0.3, ("is_returning",), ("full participant", "full practice", "fully healthy")),
    Rule("usage", 0.5, ("is_usage_boost",), ("named starter", "earned starting", "expected to start", "will start", "workhorse", "lead back", "primary target", "bell( |-)cow")),
    Rule("usage", 0.3, ("is_usage_boost",), ("increased role", "expanded role", "more touches", "promoted")),
    Rule("usage", -0.3, ("is_usage_drop",), ("splitting carries", "timeshare", "committee back", "limited snaps", "limited to # snaps", "saw only", "rotational")),
    Rule("usage", -0.6, ("is_usage_drop",), ("benched", "demoted", "losing (starting )?(job|snaps)", "losing starting", "decreased role", "reduced workload")),
    Rule("weather", -0.4, ("is_weather_risk",), ("blizzard", "ice storm", "snowstorm", "white( |-)out conditions")),
    Rule("weather", -0.3, ("is_weather_risk",), ("high winds", "wind gusts", "(sustained|gusts?) (of |up to )?## ?mph", "winds? (over|above|of) ##")),
    Rule("weather", -0.3, ("is_weather_risk",), ("game (in doubt|could be postponed|may be moved)", "weather delay")),
    Rule("weather", -0.2, ("is_weather_risk",), ("heavy rain", "monsoon", "torrential", "freezing rain")),
    Rule("general", 0.4, ("is_drafted",), ("<drafted (by|to) the @",)),
    Rule("trade", 0.0, ("is_rumored_destination",), ("<rumored to land>", "<rumored destination>", "<could land in>")),
    Rule("general", -0.1, ("is_coaching_change",), ("<hired as>", "<fired>", "<new (head coach|coordinator)>", "<coaching change>")),
    Rule("trade", -0.1, ("is_trade_buzz",), ("<trade rumor>", "<rumored to be (traded|dealt|moved)>", "<trade speculation>")),
    Rule("trade", -0.3, ("is_holdout",), ("<hold(ing )?out>",)),
    Rule("trade", -0.4, ("is_cap_cut",), ("<cap (cut|casualty)>", "<salary( |-)?cap (cut|release)>")),
    Rule("motivation", 0.4, ("is_rookie_buzz",), ("<rookie buzz>", "<first( |-)round (hype|prospect)>", "<sleeper rookie>")),
    Rule("general", 0.5, (), ("game( |-)changing", "monster game")),
    Rule("general", 0.4, (), ("breakout", "career game", "dominant", "elite", "explosive")),
    Rule("general", -0.4, (), ("fumble issues", "drop problems")),
    Rule("general", -0.3, (), ("struggling", "ineffective", "concern", "disappointing", "bust", "droppable")),
)
# Flags whose rules alone are believed less, and how much rules are believed.
DRAFT_FLAGS = ("is_drafted", "is_rumored_destination", "is_coaching_change", "is_trade_buzz", "is_holdout", "is_cap_cut", "is_rookie_buzz")
CONFIDENCE, DRAFT_CONFIDENCE = 0.7, 0.5
# A name of two title-case words, and how far a sentence is followed around it.
NAME = r"\b([A-Z][a-z']{1,15}(?:[.-][A-Z][a-z']{0,15})*(?:\.[A-Z]\.?)?\s(?:St\.\s)?(?:Mc|Mac)?[A-Z][a-z']{1,20}(?:-[A-Z][a-z']{1,15})?(?:\s(?:Jr|Sr|II|III|IV|V)\.?)?)\b"
SENTENCE_END, REACH = r".!?\n", 500

_EDGES = {" ": r"\s+", "##": "[0-9]{2,}", "#": "[0-9]{1,2}", "<": r"\b", ">": r"\b", "@": r"(?=\w{3,20}\b)"}
_SILENT = "<>@"


def spelled_out(phrase: str) -> Iterator[tuple[str, ...]]:
    """Every sequence of marks and letters that a phrase stands for."""

    def read(i: int) -> tuple[list[list[tuple[str, ...]]], int]:
        """The choices from place i up to the bracket that closes them."""
        ways, done = [()], []
        while i < len(phrase) and phrase[i] != ")":
            if phrase[i] == "|":
                done, ways, i = done + ways, [()], i + 1
                continue
            if phrase[i] == "(":
                part, i = read(i + 1)
                i += 1
            else:
                n = 2 if phrase.startswith("##", i) else 1
                part, i = [(phrase[i : i + n],)], i + n
            if i < len(phrase) and phrase[i] == "?":
                part, i = [*part, ()], i + 1
            ways = [w + p for w in ways for p in part]
        return done + ways, i

    yield from read(0)[0]


def _trie_pattern(phrases: set[tuple[str, ...]]) -> str:
    """A pattern that matches the longest of the phrases; beginnings that phrases share are tried once."""
    ends = () in phrases
    heads: dict[str, set[tuple[str, ...]]] = {}
    for p in phrases:
        if p:
            heads.setdefault(p[0], set()).add(p[1:])
    ways = [_EDGES.get(h, re.escape(h)) + _trie_pattern(rest) for h, rest in sorted(heads.items(), key=lambda x: (len(x[0]), x[0]), reverse=True)]
    if not ways:
        return ""
    return f"(?:{'|'.join(ways)}){'?' if ends else ''}" if len(ways) > 1 or ends else ways[0]


class RuleBook:
    """The rules as one pattern and a table of what each phrase, and each phrase that begins another, says."""

    def __init__(self, rules: Sequence[Rule] = RULES) -> None:
        self.rules = tuple(rules)
        of: dict[tuple[str, ...], int] = {}
        for i, r in enumerate(self.rules):
            for p in r.phrases:
                for way in spelled_out(p):
                    of[way] = min(i, of.get(way, i))
        self.pattern = f"(?i)(?=({_trie_pattern(set(of))}))"
        self.least: dict[str, int] = {}
        for way in of:
            found = [of[way[:k]] for k in range(1, len(way) + 1) if way[:k] in of]
            key = "".join("#" if m == "##" else m for m in way if m not in _SILENT)
            self.least[key] = min([*found, *([self.least[key]] if key in self.least else [])])

    def matches(self, text: Column) -> Column:
        """Whether any rule matches; null text: false."""
        return F.coalesce(text.rlike(self.pattern), F.lit(False))

    def first(self, text: Column) -> Column:
        """Number of the first rule that matches somewhere in text, or null. Overlapping phrases are all found."""
        hits = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(self.pattern), 1), lambda h: F.regexp_replace(F.regexp_replace(F.lower(h), r"\s+", " "), "[0-9]+", "#")))
        return F.array_min(F.transform(hits, self._rule_of))

    def _rule_of(self, hit: Column) -> Column:
        by_hit = {re.sub("[0-9]+", "#", k): v for k, v in self.least.items()}  # hits have their digits as #, too
        return F.element_at(F.from_json(F.lit(json.dumps(by_hit)), "map<string, int>"), hit)


def signals(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """key, player_name, category, sentiment, confidence, flags: what the first matching rule says about each name of a document.

    A name counts once a document, by the sentences that it stands in: from the last . ! ? or line end before it to
    the next one after it, REACH characters at most on each side. Documents without names or rules give no rows.
    Null and empty texts give none; repeated rows give repeated signals.
    """
    book = RuleBook(rules)
    t = F.col(text)
    # A filter is pushed through a select and its patterns run a second time; it stays above the explode of an array of one.
    once = lambda c, name: F.explode(F.array(c)).alias(name)
    named = docs.select(key, t.alias("__t")).select(key, "__t", F.explode(F.array_distinct(F.regexp_extract_all("__t", F.lit(NAME), 1))).alias("player_name"))
    # What lies between the places of the name: the end of one part, the name and the beginning of the next are a window.
    named = named.select(key, "__t", "player_name", once(F.split("__t", F.concat(F.lit(r"\Q"), "player_name", F.lit(r"\E"))), "__parts"))
    part = lambda i: F.get("__parts", i)
    before = lambda p: F.reverse(F.regexp_extract(F.reverse(F.right(p, F.lit(REACH))), f"^[^{SENTENCE_END}]*", 0))
    after = lambda p: F.regexp_extract(p, f"^[^{SENTENCE_END}]{{0,{REACH}}}", 0)
    places = F.slice(F.sequence(F.lit(0), F.size("__parts")), 1, F.size("__parts") - 1)
    windows = F.array_distinct(F.transform(places, lambda i: F.concat(before(part(i)), F.col("player_name"), after(part(i + 1)))))
    found = named.select(key, "__t", "player_name", once(F.array_min(F.transform(windows, book.first)), "__r")).where("__r IS NOT NULL")
    # A sentence that a rule matches stands behind every signal, and the first or last word of the name in it. Rules are
    # what takes the time: they read windows and sentences with such words, not whole texts.
    found = found.select("*", once(F.split("player_name", r"\s"), "__ends"))
    holds = lambda s: s.contains(F.get("__ends", 0)) | s.contains(F.element_at("__ends", -1)) | s.contains(F.get("__ends", 1))
    found = found.where(F.exists(F.split("__t", f"[{SENTENCE_END}]"), lambda s: holds(s) & book.matches(s)))
    said = F.element_at(F.array(*[F.struct(F.lit(r.category).alias("category"), F.lit(r.sentiment).alias("sentiment"), F.lit(DRAFT_CONFIDENCE if r.flags and set(r.flags) <= set(DRAFT_FLAGS) else CONFIDENCE).alias("confidence"), F.array(*[F.lit(f) for f in r.flags]).cast("array<string>").alias("flags")) for r in book.rules]), F.col("__r") + 1)
    return found.select(key, "player_name", said.alias("__s")).select(key, "player_name", "__s.*")
