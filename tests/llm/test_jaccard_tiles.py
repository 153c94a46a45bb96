"""The similarity join against all pairs, and the bounds that prune it."""
import random
import re

import numpy as np
import pytest

from strainlens.llm import jaccard_tiles

WORD = re.compile(r"[^\x20\t-\r]+")


def plain_groups(rows, size, percent):
    sets = []
    for _, text in rows:
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(words[i:i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set()))
    group = {d: d for d, _ in rows if d is not None}

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(rows[:i]):
            both = len(sets[i] & sets[j])
            if a is not None and b is not None and sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                low, high = sorted((top(a), top(b)))
                group[high] = low
    return sorted(((d, len(s), None if d is None else top(d)) for (d, _), s in zip(rows, sets, strict=True)), key=str)


def corpus(seed):
    r = random.Random(seed)
    texts = []
    for n in (3, 8, 11, 12, 13, 20, 29, 40, 90, 200, 420):
        base = [f"W{r.randrange(500)}" for _ in range(n)]
        texts.append(" ".join(base))
        for k in range(8):
            other = list(base)
            for _ in range(1 + n // 40 if k % 2 else 1):
                spot = r.randrange(len(other))
                other[spot:spot + r.randrange(2)] = [f"x{r.randrange(9)}"] * r.randrange(2)
            texts += [" ".join(other), "\n".join(base[: n - r.randrange(2)]) + " tail" * (k % 2)]
    phrase = " ".join(f"common{i}" for i in range(14))
    texts += [f"{phrase} own{i}" for i in range(30)] + [f"lead{i} {phrase} {i}" for i in range(30)]
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80), (2, 60)])
def test_groups_agree_with_all_pairs(frame, size, percent):
    rows = [*enumerate(corpus(size)), (900, None), (901, ""), (902, " \n"), (903, "one word"), (904, "ONE  word"), (905, "x " * 20_000), (906, "x " * 9), (None, "one word"), (7, "of a repeated id " * 3), (7, "of a repeated id " * 3)]
    got = jaccard_tiles.similar_groups(frame(rows), size=size, percent=percent).collect()
    assert sorted(map(tuple, got), key=str) == plain_groups(rows, size, percent)


def test_no_rows(frame):
    assert jaccard_tiles.similar_groups(frame([(1, "x")]).where("false")).count() == 0


@pytest.mark.parametrize("percent", [90, 80, 50])
def test_linked_sets_share_a_tile(percent):
    r = np.random.default_rng(percent)
    for n in [*range(1, 60), *r.integers(60, 4000, 40)]:
        for _ in range(12 if n < 60 else 2):
            spare = r.integers(0, 1 << 63, 2 * n + 4).astype(np.uint64)
            whole = np.sort(spare[:n])
            # as many shingles less or more as a link allows
            size = int(r.integers(max(1, -(-n * percent // 100)), n * 100 // percent + 1))
            least = -(-percent * (n + size) // (100 + percent))
            other = np.sort(np.concatenate((r.permutation(whole)[:least], spare[n:n + size - least])))
            both = len(np.intersect1d(whole, other))
            assert 100 * both >= percent * (n + size - both)
            hashes, owner = np.concatenate((whole, other)), np.repeat([0, 1], [n, size])
            text, key = jaccard_tiles.tiles(hashes, owner, np.array([n, size]), percent)
            equal = n == size == both
            assert equal or len(np.intersect1d(key[text == 0], key[text == 1])), (n, size, both)


def test_bitmaps_never_exclude_a_link(spark):
    names = ["n_shingles", *(f"bits_{i}" for i in range(16))]
    x = spark.createDataFrame([(20, *[0] * 15, 3)], " long, ".join(names) + " long").alias("x")
    y = spark.createDataFrame([(20, *[0] * 15, 1), (19, *[0] * 15, 3), (20, *[7] * 15, 3), (17, *[0] * 15, 3)], " long, ".join(names) + " long").alias("y")
    # one cell differs: at most 19 of 20 are shared
    assert [r[0] for r in x.join(y).select(jaccard_tiles.may_link("x", "y", 90)).collect()] == [True, True, False, False]
