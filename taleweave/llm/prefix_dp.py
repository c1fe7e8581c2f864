"""Byte-pair segmentation of every prefix of a word by dynamic programming.

A sequence of tokens is what greedy pair merging gives for its text exactly if every two neighbours are: merging the
text of the two alone gives the two back. So the last token of a prefix is the one token, among those that end there,
that stands this test with the last token of what comes before it, and one pass over a word segments all its prefixes.
"""

from __future__ import annotations

from collections.abc import Callable


class PrefixSegmenter:
    """vocabulary: the tokens that merging can give. rank(a, b): the priority at which a and b merge (lowest first, then
    leftmost), or None. alone: symbols that are not in the vocabulary stand for themselves and never merge."""

    PAIRS = 1_000_000

    def __init__(self, vocabulary: set[str], rank: Callable[[str, str], float | None]) -> None:
        self.vocabulary, self.rank = vocabulary, rank
        self.trie: dict = {}
        for token in vocabulary:
            node = self.trie
            for letter in token:
                node = node.setdefault(letter, {})
            node[""] = token
        self.fits: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}

    def merged(self, word: str) -> list[str]:
        """Greedy merging, step by step; for short words."""
        parts = list(word)
        while len(parts) > 1:
            found = [(r, i) for i in range(len(parts) - 1) if (r := self.rank(parts[i], parts[i + 1])) is not None]
            if not found:
                break
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def stand_together(self, a: str, b: str) -> bool:
        """Whether merging the text of both gives both back."""
        key = (a, b)
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= self.PAIRS:
                self.fits.clear()
            known = self.fits[key] = self.merged(a + b) == [a, b]
        return known

    def stands(self, token: str) -> bool:
        """Whether merging the token's text gives the token."""
        known = self.whole.get(token)
        if known is None:
            known = self.whole[token] = self.merged(token) == [token]
        return known

    def lasts(self, word: str) -> list[str]:
        """The last token of every prefix, shortest prefix first."""
        size, root, known = len(word), self.trie, self.fits.get
        ending: list[list[str]] = [[] for _ in range(size)]
        out: list[str] = []
        for start, letter in enumerate(word):  # the tokens that end in each place, longest first
            node, end = root.get(letter), start
            if node is None or "" not in node:
                ending[start].append(letter)
            while node is not None:
                token = node.get("")
                if token is not None:
                    ending[end].append(token)
                end += 1
                node = node.get(word[end]) if end < size else None
        for end, tokens in enumerate(ending, 1):
            for token in tokens:
                before = end - len(token)
                if before:
                    good = known((out[before - 1], token))
                    if good is None:
                        good = self.stand_together(out[before - 1], token)
                else:
                    good = end == 1 or self.stands(token)
                if good:
                    out.append(token)
                    break
            else:
                raise ValueError(f"no token ends at {end} of {word!r}: the merges do not fit the vocabulary")
        return out

    def counts(self, word: str) -> list[int]:
        """Tokens of every prefix."""
        out: list[int] = []
        for end, token in enumerate(self.lasts(word), 1):
            before = end - len(token)
            out.append(1 + (out[before - 1] if before else 0))
        return out
