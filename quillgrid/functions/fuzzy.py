"""How alike two short texts are, 0 to 100: plain, by parts, by tokens, and the weighted best of these.

The plain ratio counts insertions and deletions alone, so it rests on the
longest common subsequence. That is found with one machine number a text, a
bit a character; as column expressions (folds over arrays of characters) the
same took some half a second a text and list of phrases, so best_weighted() is
a pandas function. It is meant for the distinct texts of a column.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of token and part scores, and the shares of lengths from which parts count, and count less.
TOKENS, PARTS, FEW_PARTS = 0.95, 0.9, 0.6
LONGER, MUCH_LONGER = 1.5, 8.0


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence: bits of a fall where b's characters lengthen it."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = rest = (1 << len(a)) - 1
    for c in b:
        met = rest & places.get(c, 0)
        rest = (rest + met | rest - met) & full
    return len(a) - rest.bit_count()


def distance(a: str, b: str) -> int:
    """Insertions and deletions that make one text the other."""
    return len(a) + len(b) - 2 * common(a, b)


def _share(apart: int, whole: int) -> float:
    return 100.0 - 100.0 * apart / whole if whole else 100.0


def ratio(a: str, b: str) -> float:
    return _share(distance(a, b), len(a) + len(b))


def part_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text and a part of the longer one of its length, or shorter at either end."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    n = len(short)
    if not n:
        return 0.0 if long else 100.0
    return max(ratio(short, part) for part in {long[max(0, i) : i + n] for i in range(1 - n, len(long))})


def token_ratio(a: str, b: str) -> float:
    """The better of two ratios: of the sorted tokens, and of what the sets of tokens have apart beside what they share."""
    x, y = a.split(), b.split()
    shared, own_x, own_y = (" ".join(sorted(s)) for s in (set(x) & set(y), set(x) - set(y), set(y) - set(x)))
    if not x or not y:
        sets = 0.0
    elif shared and not (own_x and own_y):
        sets = 100.0
    else:
        front = len(shared) + bool(shared)
        sets = _share(distance(own_x, own_y), 2 * front + len(own_x) + len(own_y))
        if shared:
            sets = max(sets, *(_share(1 + len(own), len(shared) + front + len(own)) for own in (own_x, own_y)))
    return max(sets, ratio(" ".join(sorted(x)), " ".join(sorted(y))))


def token_part_ratio(a: str, b: str) -> float:
    """100 where a token is shared, else the better of the part ratios of all tokens and of each once."""
    x, y = a.split(), b.split()
    if set(x) & set(y):
        return 100.0
    return max(part_ratio(" ".join(sorted(f(x))), " ".join(sorted(f(y)))) for f in (list, set))


@lru_cache(maxsize=100_000)
def weighted(a: str, b: str) -> float:
    """The best of the plain ratio and, by how much one text is longer, the weighted token ratio or the weighted part ratios; 0 if a text is empty."""
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    if longer < LONGER:
        return max(ratio(a, b), TOKENS * token_ratio(a, b))
    scale = PARTS if longer <= MUCH_LONGER else FEW_PARTS
    return max(ratio(a, b), scale * part_ratio(a, b), TOKENS * scale * token_part_ratio(a, b))


def best_weighted(text: Column, phrases: tuple[str, ...]) -> Column:
    """The best weighted ratio of a text with any of the phrases."""

    @F.pandas_udf("double")
    def best(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: max(weighted(t, p) for p in phrases))

    return best(text)
