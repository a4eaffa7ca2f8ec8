"""String similarities, batched through Arrow.

Built-in ``levenshtein`` prices substitutions at one and cannot stand in for the
insert-delete ratio, so the longest common subsequence is computed here, bit-parallel
on Python integers: one big-integer step per character.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def _masks(a: str) -> dict[str, int]:
    found: dict[str, int] = {}
    for i, c in enumerate(a):
        found[c] = found.get(c, 0) | 1 << i
    return found


def _common(masks: dict[str, int], size: int, b: str) -> int:
    """Length of the longest common subsequence of the masked string and ``b``."""
    full = state = (1 << size) - 1
    for c in b:
        hit = state & masks.get(c, 0)
        state = (state + hit | state - hit) & full
    return size - state.bit_count()


def indel(a: str, b: str) -> float:
    """Share of characters in a longest common subsequence, counted in both strings."""
    total = len(a) + len(b)
    return 2 * _common(_masks(a), len(a), b) / total if total else 1.0


def token_sort(a: str, b: str) -> float:
    return indel(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def _slide(short: str, long: str) -> float:
    masks, n, m = _masks(short), len(short), len(long)
    best = 0.0
    for end in range(1, m + n):
        start, stop = max(0, end - n), min(end, m)
        # A window that ends (or, past the end, begins) with a foreign letter is beaten by its neighbour.
        if (long[stop - 1] if end <= m else long[start]) in masks:
            best = max(best, 2 * _common(masks, n, long[start:stop]) / (n + stop - start))
            if best == 1.0:
                break
    return best


def partial(a: str, b: str) -> float:
    """Best ratio of the shorter string with a window of the longer one."""
    if not a or not b:
        return float(a == b)
    if len(a) == len(b):
        return max(_slide(a, b), _slide(b, a))
    return _slide(*sorted((a, b), key=len))


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity with a bonus of a tenth per common leading letter, up to four, above 0.7."""
    if not a or not b:
        return float(a == b)
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free, left = [True] * len(b), []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if free[j] and b[j] == c), None)
        if j is not None:
            free[j] = False
            left.append(c)
    if not left:
        return 0.0
    m = len(left)
    swapped = sum(x != y for x, y in zip(left, (c for c, f in zip(b, free) if not f))) // 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    if jaro <= 0.7:
        return jaro
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return jaro + 0.1 * prefix * (1 - jaro)


_FEATURES = StructType([StructField(c, DoubleType()) for c in ("name_token_sort", "name_partial", "name_jaro_winkler", "address_token_sort", "city_ratio")])


@F.pandas_udf(_FEATURES)
def string_features(name_a: pd.Series, name_b: pd.Series, address_a: pd.Series, address_b: pd.Series, city_a: pd.Series, city_b: pd.Series) -> pd.DataFrame:
    names = list(zip(name_a, name_b))
    return pd.DataFrame({
        "name_token_sort": [token_sort(a, b) for a, b in names],
        "name_partial": [partial(a, b) for a, b in names],
        "name_jaro_winkler": [jaro_winkler(a, b) for a, b in names],
        "address_token_sort": [token_sort(a, b) for a, b in zip(address_a, address_b)],
        "city_ratio": [indel(a, b) for a, b in zip(city_a, city_b)],
    })
