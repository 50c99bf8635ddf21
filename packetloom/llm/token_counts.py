"""Token counts that follow edits: a segment tree of pre-tokens a document; an edit encodes again only what it touches."""

from __future__ import annotations

import base64
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import in_batches, texts

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokens of byte-level BPE. Fixed value of the public vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 64
#: Distinct pre-tokens whose counts a worker remembers.
REMEMBERED = 400_000
NUMBER = regex.compile("[0-9]{4,}")


class PreTokens(dict):
    """Number of tokens by pre-token, encoded when first asked for."""

    def __init__(self, ranks: str, pattern: str = PATTERN):
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.split = regex.compile(pattern).findall
        self.match = regex.compile(pattern).match

    def __missing__(self, token: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        n = self[token] = len(self.encoding.encode_ordinary(token))
        return n

    def counts(self, tokens: list[str]) -> int:
        return sum(map(self.__getitem__, tokens))


@lru_cache(maxsize=2)
def pre_tokens(ranks: str) -> PreTokens:
    return PreTokens(ranks)


class TokenTree:
    """Leaves of LEAF pre-tokens, and above them sums of characters and tokens, two children a node."""

    def __init__(self, text: str, known: PreTokens):
        self.known, self.encoded = known, 0
        tokens = known.split(text)
        self._build([tokens[i : i + LEAF] for i in range(0, len(tokens), LEAF)] or [[]])

    def _build(self, leaves: list[list[str]]) -> None:
        self.leaves, size = leaves, 1
        while size < len(leaves):
            size *= 2
        self.size = size
        self.chars, self.tokens = [0] * (2 * size), [0] * (2 * size)
        for i, leaf in enumerate(leaves):
            self.chars[size + i], self.tokens[size + i] = sum(map(len, leaf)), self.known.counts(leaf)
        for i in range(size - 1, 0, -1):
            self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    def __len__(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join("".join(x) for x in self.leaves)

    def _leaf_at(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last one that has any for the end), and where it begins."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if at >= before + self.chars[node] and self.chars[node + 1]:
                before += self.chars[node]
                node += 1
        return min(node - self.size, len(self.leaves) - 1), before

    def _set(self, leaf: int, tokens: list[str]) -> None:
        self.leaves[leaf] = tokens
        node = self.size + leaf
        self.chars[node], self.tokens[node] = sum(map(len, tokens)), self.known.counts(tokens)
        while node > 1:
            node //= 2
            self.chars[node], self.tokens[node] = self.chars[2 * node] + self.chars[2 * node + 1], self.tokens[2 * node] + self.tokens[2 * node + 1]

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces characters start to end. A pre-token depends on two characters behind its end at most, so encoding starts two pre-tokens before the
        edit; at an old boundary behind the edit the rest is as it was, and encoding stops there."""
        first = max(0, self._leaf_at(max(0, start - 1))[0] - 1)
        last = min(len(self.leaves) - 1, self._leaf_at(end)[0] + 1)
        begin = self._before(first)
        while True:
            old = [t for leaf in self.leaves[first : last + 1] for t in leaf]
            ends = list(accumulate(map(len, old), initial=begin))[1:]
            touched = bisect_left(ends, start)
            keep = max(0, touched - 2)
            if keep == 0 and first > 0:
                first -= 1
                begin = self._before(first)
                continue
            origin = ends[keep - 1] if keep else begin
            raw = "".join(old[keep:])
            fresh = raw[: start - origin] + new + raw[end - origin :]
            shift = len(new) - (end - start) - origin
            resume = {e + shift: i + 1 for i, e in enumerate(ends) if e >= end}
            done: list[str] = []
            at, least = 0, start - origin + len(new)
            while at < len(fresh) and not (at >= least and at in resume):
                done.append(self.known.match(fresh, at)[0])
                at += len(done[-1])
            if at == len(fresh) and last + 1 < len(self.leaves):  # what follows may change the last pre-token
                last += 1
                continue
            break
        self.encoded += len(done)
        merged = old[:keep] + done + (old[resume[at] :] if at < len(fresh) else [])
        if len(merged) > 4 * LEAF * (last - first + 1):
            cut = [merged[i : i + LEAF] for i in range(0, len(merged), LEAF)]
            self._build([*self.leaves[:first], *cut, *self.leaves[last + 1 :]])
            return
        share = -(-len(merged) // (last - first + 1)) or 1
        for i in range(first, last + 1):
            self._set(i, merged[(i - first) * share : (i - first + 1) * share])

    def _before(self, leaf: int) -> int:
        node, before = self.size + leaf, 0
        while node > 1:
            if node % 2:
                before += self.chars[node - 1]
            node //= 2
        return before


def masked_numbers(text: str) -> list[tuple[int, int, str]]:
    """The edits of the query: every run of four digits or more becomes <num>."""
    return [(*m.span(), "<num>") for m in NUMBER.finditer(text)]


def count_tokens(docs: DataFrame, edits=masked_numbers, ranks: str = RANKS) -> DataFrame:
    """doc_id, n_tokens, n_edits, n_tokens_edited, n_encoded_again (pre-tokens) of every document; edits maps a text to (start, end, new) in order.

    Null text is empty and has no tokens. Rows are independent."""

    def run(batch: pa.RecordBatch) -> dict:
        known = pre_tokens(ranks)
        out: dict[str, list] = {k: [] for k in ("n_tokens", "n_edits", "n_tokens_edited", "n_encoded_again")}
        for text in texts(batch):
            changes = edits(text)
            if not changes:
                n = known.counts(known.split(text))
                row = (n, 0, n, 0)
            else:
                tree = TokenTree(text, known)
                n = len(tree)
                for start, end, new in reversed(changes):
                    tree.edit(start, end, new)
                row = (n, len(changes), len(tree), tree.encoded)
            for column, v in zip(out.values(), row):
                column.append(v)
        return {"doc_id": batch.column(0)} | out

    return in_batches(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, n_edits long, n_tokens_edited long, n_encoded_again long")


def op6_token_counts(docs: DataFrame) -> DataFrame:
    return count_tokens(docs)
