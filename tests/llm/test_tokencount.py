import os
import random

import pytest

from lodestitch.llm import tokencount

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


def greedy(word, initial, inner):
    at, n = 0, 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in (inner if at else initial)), None)
        if end is None:
            return 1
        at, n = end, n + 1
    return n


def test_automaton_against_greedy_search():
    rng = random.Random(9)
    for _ in range(150):
        pieces = [bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 25))]
        cut = rng.randrange(len(pieces) + 1)
        initial, inner = set(pieces[:cut]), set(pieces[cut:])
        automaton = tokencount.Automaton(initial, inner)
        for _ in range(60):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, 14)))
            assert automaton.count(word) == greedy(word, initial, inner)


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")
def test_documents(spark):
    initial, inner = tokencount.byte_level_pieces(VOCABULARY)
    automaton = tokencount.Automaton(initial, inner)
    rows = [(1, "The quick brown fox, naïve 東京 zzqx"), (2, None), (3, " \t\n"), (None, "a"), (4, "w" * 100_000), (1, "The quick brown fox, naïve 東京 zzqx")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_tokens) for r in tokencount.count_tokens(df, automaton).collect()]
    a, b = set(initial), set(inner)
    want = [(d, len((t or "").split()), sum(greedy(b" " + w.encode(), a, b) if len(w) < 1000 else automaton.count(b" " + w.encode()) for w in (t or "").split())) for d, t in rows]
    assert got == want
    assert tokencount.count_tokens(df.limit(0), automaton).count() == 0
