"""Edit-aware token counts: a segment tree over a document's pre-tokens, re-encoded only around edits."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The pre-token pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokens in a leaf of a new tree.
LEAF = 64
#: A pre-token's match looks at so many characters beyond its end, a run of gaps aside.
LOOKAHEAD = 2
#: Pre-tokens whose counts a worker remembers at most.
REMEMBERED = 300_000

_split = regex.compile(PATTERN)


@dataclass(frozen=True)
class Vocabulary:
    """The lines of a rank file, read once on the driver and sent to tasks; about 1 MB."""

    lines: bytes

    @classmethod
    def read(cls, path: str = VOCABULARY) -> Vocabulary:
        return cls(Path(path).read_bytes())


_counters: dict[int, Callable[[str], int]] = {}


def token_counter(vocabulary: Vocabulary) -> Callable[[str], int]:
    """Function from a pre-token to its number of tokens; one for each vocabulary and worker."""
    if (k := hash(vocabulary.lines)) not in _counters:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.lines.splitlines())}
        encode = tiktoken.Encoding("own", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary  # the pre-token as one
        known: dict[str, int] = {}

        def count(piece: str) -> int:
            if (n := known.get(piece)) is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                n = known[piece] = len(encode(piece))
            return n

        _counters[k] = count
    return _counters[k]


class TokenTree:
    """Sums of characters and tokens over leaves of consecutive pre-tokens.

    edit() finds the leaf by descending along the character sums, splits and counts pre-tokens from a
    boundary before the edit until a new boundary meets an old one behind it, and updates the sums on
    the paths above the leaves it changed; a leaf that has grown to more than twice LEAF is split. From a shared boundary on, the pre-tokens depend on the same
    text, so the rest of the document stays as it is.
    """

    def __init__(self, text: str, count: Callable[[str], int]):
        pieces = _split.findall(text)
        leaves = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)]
        self._count, self.encoded = count, 0
        self._build(leaves, [sum(map(count, x)) for x in leaves])

    @classmethod
    def of_leaves(cls, leaves: list[list[str]], tokens: list[int], count: Callable[[str], int]) -> TokenTree:
        """A tree from leaves that were kept, with their token counts: nothing is encoded."""
        tree = cls.__new__(cls)
        tree._count, tree.encoded = count, 0
        tree._build(leaves, tokens)
        return tree

    def leaves(self) -> list[tuple[list[str], int]]:
        """The leaves that hold pre-tokens, and their token counts."""
        return [(x, self._tokens[self._size + i]) for i, x in enumerate(self._leaves) if x]

    def _build(self, leaves: list[list[str]], tokens: list[int]) -> None:
        self._leaves = leaves or [[]]
        self._size = 1
        while self._size < len(self._leaves):
            self._size *= 2
        fill = [0] * (self._size - len(leaves))
        self._chars = [0] * self._size + [sum(map(len, x)) for x in leaves] + fill
        self._tokens = [0] * self._size + list(tokens) + fill
        for i in range(self._size - 1, 0, -1):
            self._chars[i], self._tokens[i] = self._chars[2 * i] + self._chars[2 * i + 1], self._tokens[2 * i] + self._tokens[2 * i + 1]

    tokens = property(lambda self: self._tokens[1])
    chars = property(lambda self: self._chars[1])
    pieces = property(lambda self: sum(map(len, self._leaves)))

    def text(self) -> str:
        return "".join("".join(x) for x in self._leaves)

    def _leaf_at(self, at: int) -> tuple[int, int]:
        """The leaf that holds character `at`, or the last one that holds any, and its first character's place."""
        i, start = 1, 0
        while i < self._size:
            i *= 2
            if at >= start + self._chars[i] and self._chars[i + 1]:
                start += self._chars[i]
                i += 1
        return i - self._size, start

    def _put(self, leaf: int, pieces: list[str]) -> None:
        self._leaves[leaf] = pieces
        i = self._size + leaf
        self._chars[i], self._tokens[i] = sum(map(len, pieces)), sum(map(self._count, pieces))
        while i > 1:
            i //= 2
            self._chars[i], self._tokens[i] = self._chars[2 * i] + self._chars[2 * i + 1], self._tokens[2 * i] + self._tokens[2 * i + 1]

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replace characters start to stop, clipped to the text, by new."""
        stop = min(max(stop, 0), self.chars)
        start = min(max(start, 0), stop)
        first, place = self._leaf_at(max(0, start - LOOKAHEAD - 1))
        keep, begin = 0, place  # pre-tokens of the leaf before the one where splitting starts
        for p in self._leaves[first]:
            if begin + len(p) > max(0, start - LOOKAHEAD - 1):
                break
            keep, begin = keep + 1, begin + len(p)
        last, _ = self._leaf_at(stop)
        while True:
            old = [p for i in range(first, last + 1) for p in (self._leaves[i] if i > first else self._leaves[first][keep:])]
            text = "".join(old)
            whole = last + 1 >= len(self._leaves)
            bounds, at = {}, begin
            for i, p in enumerate(old):
                bounds[at] = i
                at += len(p)
            bounds[at] = len(old)
            region = text[: start - begin] + new + text[stop - begin :]
            shift = len(new) - (stop - start)
            made, met = [], None
            for m in _split.finditer(region):
                if m.end() + LOOKAHEAD >= len(region) and not whole:
                    break
                made.append(m[0])
                if m.end() >= start - begin + len(new) and (met := bounds.get(begin + m.end() - shift)) is not None and begin + m.end() - shift >= stop:
                    break
                met = None
            if met is None and (whole and len("".join(made)) == len(region)):
                met = len(old)
            if met is not None:
                break
            last += 1
        self.encoded += len(made)
        changed = [*self._leaves[first][:keep], *made, *old[met:]]
        last = min(last, len(self._leaves) - 1)
        if len(changed) <= 2 * LEAF:
            self._put(first, changed)
            for i in range(first + 1, last + 1):
                self._put(i, [])
            return
        cut = [changed[i : i + LEAF] for i in range(0, len(changed), LEAF)]  # a leaf that has grown is split
        sums = self._tokens[self._size : self._size + len(self._leaves)]
        self._build([*self._leaves[:first], *cut, *self._leaves[last + 1 :]], [*sums[:first], *[sum(map(self._count, x)) for x in cut], *sums[last + 1 :]])


_LEAVES = "array<struct<leaf:int,pieces:array<string>,chars:long,tokens:long>>"


def leaf_table(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The trees of docs as a table to keep: key, leaf, pieces, chars, tokens; null and empty texts have one empty leaf.

    Keys are to be unique and not null; no row is shuffled.
    """

    @F.pandas_udf(_LEAVES)
    def run(texts: pd.Series) -> pd.Series:
        count = token_counter(vocabulary)
        return pd.Series([_leaf_rows(TokenTree(t or "", count)) for t in texts], dtype=object)

    return docs.select(key, F.explode(run(F.col(text))).alias("l")).select(key, "l.*")


def _leaf_rows(tree: TokenTree) -> list[dict]:
    found = tree.leaves() or [([], 0)]
    return [{"leaf": i, "pieces": x, "chars": sum(map(len, x)), "tokens": n} for i, (x, n) in enumerate(found)]


def apply_edits(leaves: DataFrame, edits: DataFrame, vocabulary: Vocabulary, key: str = "doc_id") -> DataFrame:
    """leaf_table() after edits (key, seq, start, stop, new), applied to each document in the order of seq.

    Only the trees of documents with edits are shuffled; they are put together from their kept counts, and
    only what an edit touches is encoded. All other leaves pass through. Edits of unknown keys add nothing;
    a null `new` deletes, and null places are 0.
    """
    touched = edits.select(key).distinct()
    schema = StructType([leaves.schema[key], *[f for f in leaves.schema if f.name != key]])

    def run(kept: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
        if not len(kept):
            return pd.DataFrame(columns=schema.names)
        kept = kept.sort_values("leaf")
        tree = TokenTree.of_leaves([list(x) for x in kept["pieces"] if len(x)], [n for n, x in zip(kept["tokens"], kept["pieces"], strict=True) if len(x)], token_counter(vocabulary))
        for a, b, new in changes.sort_values("seq", kind="stable")[["start", "stop", "new"]].itertuples(index=False):
            tree.edit(0 if pd.isna(a) else int(a), 0 if pd.isna(b) else int(b), "" if new is None or pd.isna(new) else new)
        return pd.DataFrame(_leaf_rows(tree)).assign(**{key: kept[key].iloc[0]})[schema.names]

    edited = leaves.join(touched, key, "left_semi").groupBy(key).cogroup(edits.groupBy(key)).applyInPandas(run, schema)
    return leaves.join(touched, key, "left_anti").select(*schema.names).unionByName(edited)


def thirds(text: str) -> list[tuple[int, int, str]]:
    """The edits of the demonstration query: replace, insert and delete around the quarters of a text."""
    n = len(text)
    return [(3 * n // 4, 3 * n // 4 + 7, ""), (n // 2, n // 2, " an inserted remark,"), (n // 4, n // 4 + 5, "Edited 2")]


def edited_counts(text: Column, vocabulary: Vocabulary, edits: Callable[[str], Iterable[tuple[int, int, str]]] = thirds) -> Column:
    """Struct of a text's tokens before and after its edits, its pre-tokens, those encoded again, and the new text's length.

    edits gives (start, stop, new) in code points, applied in turn to the text as it then is. Null counts as
    empty. A tree lives while its document's row is worked on.
    """

    @F.pandas_udf("n_tokens long, n_tokens_after long, n_pretokens long, n_encoded_again long, n_chars_after long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        count = token_counter(vocabulary)
        for texts in batches:
            rows = []
            for t in texts:
                tree = TokenTree(t or "", count)
                before, pieces = tree.tokens, tree.pieces
                for e in edits(t or ""):
                    tree.edit(*e)
                rows.append((before, tree.tokens, pieces, tree.encoded, tree.chars))
            yield pd.DataFrame(np.array(rows, dtype="int64").reshape(-1, 5), columns=["n_tokens", "n_tokens_after", "n_pretokens", "n_encoded_again", "n_chars_after"])

    return run(text)
