import random

import numpy as np
import xxhash

from lodestitch.llm import simhash


def brute_fingerprint(text, k=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius=4):
    parent = {d: d for d in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if bin(prints[a] ^ prints[b]).count("1") <= radius:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: root(d) for d in ids}


def test_fingerprint_matches_definition():
    rng = random.Random(1)
    for n in (0, 1, 3, 4, 5, 40, 300):
        text = " ".join(rng.choice(["A", "bé", "C c", "\td", "e\n"]) for _ in range(n))
        assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)
    assert simhash.fingerprint(None) == 0


def test_links_against_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    prints = {}
    for d in range(600):
        base = rng.getrandbits(64) if d % 3 or not prints else prints[rng.choice(list(prints))]
        for _ in range(rng.randrange(0, 6)):
            base ^= 1 << rng.randrange(64)
        prints[d] = base
    rows = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in prints.values()], "fp long").distinct().cache()
    for radius, blocks, limit in ((4, 3, 6_144), (4, 5, 6_144), (3, 2, 6_144), (0, 1, 6_144), (4, 3, 40)):
        monkeypatch.setattr(simhash, "LEAF_LIMIT", limit)
        monkeypatch.setattr(simhash, "LEAF_POINTS", 30)
        found = {r.fp: r.component for r in simhash.groups(rows, simhash.Scratch(spark, "t"), radius, blocks).collect()}
        want = components(prints, radius)
        signed = {d: int(np.uint64(v).astype(np.int64)) for d, v in prints.items()}
        least = {}
        for d in prints:
            least[want[d]] = min(least.get(want[d], signed[d]), signed[d])
        assert {d: found[signed[d]] for d in prints} == {d: least[want[d]] for d in prints}


def test_trees_part_the_points_and_lose_no_pair():
    rng = np.random.default_rng(3)
    fp = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    fp[1500:] = fp[:1500] ^ (np.uint64(1) << rng.integers(0, 64, 1500).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 1500).astype(np.uint64))
    fp[:40] = fp[0]
    mask = (1 << 24) - 1
    for budget in (0, 1, 2):
        tree = simhash.grow(fp[::4], mask, budget, 8)
        point, leaf, home = tree.places(fp)
        assert np.array_equal(np.sort(point[home]), np.arange(len(fp))) and (tree.radius[leaf] == -1).all()
        assert len(set(leaf.tolist())) > 60 and len(point) < (1, 4, 15)[budget] * len(fp) + 1
        lives = dict(zip(point[home].tolist(), leaf[home].tolist()))
        seen = set(zip(point.tolist(), leaf.tolist()))
        away = np.bitwise_count((fp[:, None] ^ fp[None, :]) & np.uint64(mask))
        for a, b in zip(*np.nonzero(away <= budget)):
            assert (a, lives[b]) in seen or (b, lives[a]) in seen
    assert len(simhash.grow(np.zeros(50, np.uint64), mask, 1, 8).radius) == 1 == len(simhash.grow(fp[:0], mask, 1, 8).radius)


def test_near_duplicates_edges(spark):
    df = spark.createDataFrame([(5, "a b c d e", "z"), (3, "A b  c d e", "z"), (9, None, "z"), (8, "", "z"), (None, "a b c d e", "z"), (5, "a b c d e", "z"), (7, "x" * 200_000, "z")], "doc_id long, text string, fp string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 3), (3, 3), (9, 8), (8, 8), (None, 3), (5, 3), (7, 7)], key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    clash = spark.createDataFrame([(1, "a b", 2, 3, "x", "y", None)], "doc_id long, text string, key int, fp int, component string, tree string, least long")
    assert simhash.near_duplicates(clash).collect()[0].component_id == 1
