"""The ratio of difflib.SequenceMatcher(None, a, b), digit for digit, without its scans of whole texts.

difflib looks for the longest run of characters that are not popular in b (over a hundredth of 200 or more characters), the first of
equals, lengthens it by any equal characters on both sides, and goes on left and right of it; where no such run is, what both
sides begin with is a block. Here the places of unpopular characters are kept by text. Runs of two or more are found once, from adjacent
places; where a rectangle holds none, its single characters are taken in one sweep, as the first of them leaves nothing on its left but a beginning.
"""

from __future__ import annotations

from bisect import bisect_left

#: From so many characters on, difflib calls a character popular that is more than a hundredth of b.
POPULAR_FROM = 200


class Indexed:
    """What all comparisons with a text share."""

    __slots__ = ("text", "every", "places", "pairs")

    def __init__(self, text: str):
        self.text = text
        self.every: dict[str, list[int]] = {}
        for j, c in enumerate(text):
            self.every.setdefault(c, []).append(j)
        most = len(text) // 100 + 1 if len(text) >= POPULAR_FROM else len(text)
        #: of the unpopular characters
        self.places = {c: js for c, js in self.every.items() if len(js) <= most}
        #: two unpopular characters -> where they stand side by side
        self.pairs: dict[str, list[int]] = {}
        at = sorted(j for js in self.places.values() for j in js)
        for j, k in zip(at, at[1:]):
            if k == j + 1:
                self.pairs.setdefault(text[j : k + 1], []).append(j)


def _runs(s: str, at: list[int], b: Indexed) -> list[tuple[int, int, int]]:
    """Place in s, place in b and length of all longest runs of two or more unpopular characters."""
    t, places, out = b.text, b.places, []
    for i, k in zip(at, at[1:]):
        if k == i + 1:
            for j in b.pairs.get(s[i : k + 1], ()):
                if i and j and s[i - 1] == t[j - 1] and s[i - 1] in places:
                    continue
                n = 2
                while i + n < len(s) and j + n < len(t) and s[i + n] == t[j + n] and s[i + n] in places:
                    n += 1
                out.append((i, j, n))
    return out


def matched(a: Indexed, b: Indexed) -> int:
    """How many characters difflib's blocks hold."""
    s, t, places = a.text, b.text, b.places
    at = sorted(i for c in places if c in a.every for i in a.every[c])
    total, todo = 0, [(0, len(s), 0, len(t), _runs(s, at, b) if b.pairs else [])]
    while todo:
        alo, ahi, blo, bhi, runs = todo.pop()
        best, bi, bj, inside = 1, 0, 0, []
        for run in runs:
            i, j, k = run
            cut = max(alo - i, blo - j, 0)
            k = min(k, ahi - i, bhi - j) - cut
            if k >= 2:
                inside.append(run)
                if k > best or k == best and (i + cut, j + cut) < (bi, bj):
                    best, bi, bj = k, i + cut, j + cut
        if best > 1:
            i, j, e, f = bi, bj, bi + best, bj + best
            while i > alo and j > blo and s[i - 1] == t[j - 1]:
                i, j = i - 1, j - 1
            while e < ahi and f < bhi and s[e] == t[f]:
                e, f = e + 1, f + 1
            total += e - i
            if alo < i and blo < j:
                todo.append((alo, i, blo, j, inside))
            if e < ahi and f < bhi:
                todo.append((e, ahi, f, bhi, inside))
            continue
        for p in range(bisect_left(at, alo), bisect_left(at, ahi)):
            i = at[p]
            if i < alo:
                continue
            js = places[s[i]]
            if js[-1] < blo:
                continue
            j = js[bisect_left(js, blo)]
            if j >= bhi:
                continue
            e, f = i + 1, j + 1
            while i > alo and j > blo and s[i - 1] == t[j - 1]:
                i, j = i - 1, j - 1
            while e < ahi and f < bhi and s[e] == t[f]:
                e, f = e + 1, f + 1
            total += e - i
            while alo < i and blo < j and s[alo] == t[blo]:
                alo, blo, total = alo + 1, blo + 1, total + 1
            alo, blo = e, f
        while alo < ahi and blo < bhi and s[alo] == t[blo]:
            alo, blo, total = alo + 1, blo + 1, total + 1
    return total


def ratio(a: Indexed, b: Indexed) -> float:
    n = len(a.text) + len(b.text)
    return 2.0 * matched(a, b) / n if n else 1.0


class Known:
    """Indexed texts by text, forgotten when they hold more than so many characters."""

    def __init__(self, most: int = 1_000_000):
        self.most, self.held, self.texts = most, 0, {}

    def __call__(self, text: str) -> Indexed:
        found = self.texts.get(text)
        if found is None:
            if self.held > self.most:
                self.held, self.texts = 0, {}
            found = self.texts[text] = Indexed(text)
            self.held += len(text)
        return found
