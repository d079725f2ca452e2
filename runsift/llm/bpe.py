"""Byte-pair merging by rank: which tokens may stand side by side.

A sequence of tokens is the encoding of its text exactly when every token encodes to itself and every
neighbouring pair encodes to just that pair. Both the prefix table and the transducer rest on this.
"""

from __future__ import annotations


class PairRule:
    """``rank`` maps a token (str or bytes) to its merge rank; lower merges first, ties go left."""

    def __init__(self, rank: dict, most: int = 500_000, ties=lambda left, right: False):
        """``ties`` tells pairs of tokens among whose merges several share a rank."""
        self.rank, self.most, self.ties = rank, most, ties
        self.longest = max(map(len, rank), default=1)
        self._whole: dict = {}
        self._fits: dict = {}
        self._halves: dict = {}

    def merge(self, text, stop: int = 1) -> list:
        """Encode a short text by repeated merging of the best pair, down to ``stop`` tokens."""
        rank = self.rank
        parts = [text[i:i + 1] for i in range(len(text))]
        while len(parts) > stop:
            ranks = [rank.get(a + b) for a, b in zip(parts, parts[1:], strict=False)]
            best = min((r for r in ranks if r is not None), default=None)
            if best is None:
                break
            at = ranks.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def whole(self, token) -> bool:
        """The token is in the vocabulary and merging yields it."""
        known = self._whole.get(token)
        if known is None:
            if token not in self.rank:
                return False
            known = len(token) == 1 or self.merge(token) == [token]
            self._whole[token] = known
        return known

    def halves(self, token) -> tuple:
        """The two tokens whose merge completes ``token``."""
        known = self._halves.get(token)
        if known is None:
            known = self._halves[token] = tuple(self.merge(token, stop=2))
        return known

    def fits(self, left, right) -> bool:
        """``right`` may follow ``left``: merging their text gives these two back. Both must be ``whole``."""
        known = self._fits.get((left, right))
        if known is None:
            known = self.merge(left + right) == [left, right] if self.ties(left, right) else self._undo(left, right)
            if len(self._fits) >= self.most:
                self._fits.clear()
            self._fits[left, right] = known
        return known

    def _undo(self, left, right) -> bool:
        """Undo the merges of both tokens, latest first; at no time may the two parts that meet have merged before the next step.

        A merge across the border goes before one of the same rank in the right token, and after one in the left.
        """
        rank = self.rank
        limit = len(rank) + 1
        while True:
            across = rank.get(left + right)
            if across is not None and across < limit:
                return False
            made_left = rank[left] if len(left) > 1 else -1
            made_right = rank[right] if len(right) > 1 else -1
            if made_left < 0 and made_right < 0:
                return True
            if made_left > made_right:
                limit, left = made_left, self.halves(left)[1]
            else:
                limit, right = made_right + 1, self.halves(right)[0]
