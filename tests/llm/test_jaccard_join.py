import random
import string
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import jaccard_join as J
from strandloom.llm.common import LOWER

NAMES = ("g", "n", "d1", "d2", "h", "df", "a", "b", "items", "sketch", "label", "least", "text_hash", "component_id")


def table(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("x") for c in NAMES}).repartition(3)


def plain(texts, size=5, percent=80):
    """(set size, least index reachable) of every text, from all pairs with a common shingle."""
    sets = []
    for text in texts:
        words = (text or "").encode().translate(LOWER).split()
        k = min(size, len(words))
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set())
    shared, lists, root = defaultdict(int), defaultdict(list), list(range(len(sets)))
    for i, s in enumerate(sets):
        for shingle in s:
            lists[shingle].append(i)
    for members in lists.values():
        for pair in combinations(members, 2):
            shared[pair] += 1

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for (a, b), k in shared.items():
        if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
            low, high = sorted((top(a), top(b)))
            root[high] = low
    return [(len(s), top(i)) for i, s in enumerate(sets)]


def words(rng, count, letters=3):
    return ["".join(rng.choices(string.ascii_letters, k=letters)) for _ in range(count)]


def families(seed, groups=40):
    """Texts with copies that lost, gained or changed some words, and passages that many share."""
    rng = random.Random(seed)
    passage, out = words(rng, 60), []
    for _ in range(groups):
        base = words(rng, rng.choice([1, 3, 4, 5, 6, 8, 9, 10, 15, 30, 80, 300]))
        if rng.random() < 0.3:
            base[len(base) // 2 : len(base) // 2] = passage
        for _ in range(rng.choice([1, 1, 2, 5])):
            text = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 6])):
                at = rng.randrange(len(text) + 1)
                if rng.random() < 0.5:
                    text[at : at + 1] = words(rng, 1)
                else:
                    del text[at : at + 1]
            out.append(" \n".join(text).swapcase() if rng.random() < 0.2 else " ".join(text))
    return out


def check(spark, texts, **options):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(table(spark, texts), **options).collect()}
    assert got == dict(enumerate(plain(texts, **options)))
    return got


def test_equals_all_pairs(spark):
    got = check(spark, families(1, 120))
    assert len({c for _, c in got.values()}) < len(got)


def test_other_size_and_similarity(spark):
    check(spark, families(4), size=2, percent=60)
    with pytest.raises(ValueError, match="above 50"):
        J.jaccard_components(table(spark, []), percent=50)


@pytest.mark.parametrize("small", [0, 10**6])
def test_any_boundary_gives_the_same_links(spark, monkeypatch, small):
    monkeypatch.setattr(J, "boundary", lambda ranked: small)
    check(spark, families(5))


@pytest.mark.parametrize("rounds", [0, 1])
def test_large_groups_in_blocks(spark, monkeypatch, rounds):
    """A chain of near copies, each near only to some others, in buckets of several blocks."""
    monkeypatch.setattr(J, "BLOCK", 7)
    monkeypatch.setattr(J, "ROUNDS", rounds)
    monkeypatch.setattr(J, "PAIRS", 20)
    monkeypatch.setattr(J, "COMMON", 5)
    monkeypatch.setattr(J, "FEW", 0)
    rng = random.Random(6)
    base = words(rng, 200)
    texts = []
    for k in range(60):
        base[k * 3] = words(rng, 1)[0]
        texts.append(" ".join(base))
    got = check(spark, texts + families(7, 10))
    assert got[59][1] == 0


def test_odd_rows(spark):
    texts = [None, "", " \t\n", "one", "ONE", "one two", None, "a b c d e", "a b c d e f", "a b c d"]
    assert check(spark, texts)[4] == (1, 3)
    rows = J.jaccard_components(table(spark, ["x y z"] * 3 + ["x", None], [5, None, 5, None, None])).collect()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str)
    assert got == sorted([(5, 1, 5), (5, 1, 5), (None, 1, 5), (None, 1, None), (None, 0, None)], key=str)
    assert J.jaccard_components(table(spark, [])).collect() == []


def test_very_long_text(spark):
    rng = random.Random(8)
    long = words(rng, 60_000, 5)
    check(spark, [" ".join(long), " ".join(long[:55_000]), " ".join(long[:40_000]), "short text"])


def test_sketch_never_exceeds_the_difference():
    rng = np.random.default_rng(9)
    for n, m in ((5, 5), (50, 45), (2000, 1900)):
        pool = rng.integers(0, 2**64, 2 * n, np.uint64)
        a, b = np.unique(pool[:n]), np.unique(pool[n - m : 2 * n - m])
        bits = [np.bincount((s % J._SKETCH).astype(int), minlength=J._SKETCH) & 1 for s in (a, b)]
        assert (bits[0] != bits[1]).sum() <= len(np.setxor1d(a, b))
