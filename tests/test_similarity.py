import random

from hypothesis import given, settings
from hypothesis import strategies as st

from lodestitch.functions import similarity as S


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def ratio(a, b):
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


@settings(max_examples=300, deadline=None)
@given(st.text("abcé ", max_size=80), st.text("abcé ", max_size=80))
def test_indel(a, b):
    assert S.indel(a, b) == ratio(a, b) == S.indel(b, a)


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=9), st.text("abc", min_size=1, max_size=14))
def test_partial(a, b):
    short, long = sorted((a, b), key=len)
    n = len(short)
    windows = [long[max(0, e - n) : e] for e in range(1, len(long) + 1)] + [long[s:] for s in range(len(long) - n, len(long))]
    best = max(ratio(short, w) for w in windows)
    if len(a) == len(b):
        best = max(best, max(ratio(long, short[:k]) for k in range(1, n + 1)), max(ratio(long, short[k:]) for k in range(n)))
    assert abs(S.partial(a, b) - best) < 1e-12


def test_known_values():
    assert round(S.jaro_winkler("martha", "marhta"), 4) == 0.9611
    assert round(S.jaro_winkler("dixon", "dicksonx"), 4) == 0.8133
    assert S.jaro_winkler("abc", "xyz") == 0.0 and S.jaro_winkler("", "") == 1.0 and S.jaro_winkler("", "a") == 0.0
    assert S.token_sort("b a", "a b") == 1.0 and S.partial("", "") == 1.0 and S.partial("", "a") == 0.0


def test_long_strings():
    rng = random.Random(2)
    a, b = ("".join(rng.choice("abcdef") for _ in range(400)) for _ in range(2))
    assert S.indel(a, b) == ratio(a, b)
