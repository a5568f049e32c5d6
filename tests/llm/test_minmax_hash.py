"""Near duplicates by min-max hashing against all pairs, and the estimator itself."""

import random
import re

import numpy as np
import pytest

from runlens.llm import minmax_hash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, s string, n long, key string, least int, component_id int"


def plain(rows, percent=85):
    sets = []
    for d, t, *_ in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    up[root(i)] = root(j)
    out = []
    for i, (d, *_) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None] if sets[i] else [d]
        least = min(ids, default=None)
        out.append((d, len(sets[i]), least, d == least))
    return out


def cases():
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "One TWO"), (6, "a b c d e"), (7, "a b c d e f"), (None, "one two"), (None, "lone row of null"), (9, "x y " * 60_000), (8, "X Y " * 60_000), (10, "İ é One two")]
    base = [[rng.choice(vocabulary) for _ in range(rng.choice([30, 120, 400]))] for _ in range(6)]
    k = 20
    for words in base:
        for _ in range(25):  # from nearly equal to clearly different, around the limit too
            w = list(words)
            for _ in range(rng.randint(0, max(1, len(w) // 18))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((k, " ".join(w)))
            k += 1
    chain = [f"c{j}" for j in range(400)]
    rows += [(1000 - j, " ".join(chain[8 * j : 8 * j + 200])) for j in range(20)]  # a chain of shifted windows
    rows += [rows[20], rows[21], (20, "another text of a repeated identifier here")]
    return [(d, t, "s", 5, "k", 1, 2) for d, t in rows]


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize("percent, hot", [(85, 1024), (85, 4), (80, 1024)])
def test_against_all_pairs(spark, percent, hot):
    docs = spark.createDataFrame(cases(), SCHEMA).repartition(5)
    got = minmax_hash.near_duplicates(docs, percent=percent, hot=hot).collect()
    assert order(got) == order(plain(cases(), percent))


def test_empty_and_all_alone(spark):
    assert minmax_hash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(k, f"only {k}", "s", 1, "k", 1, 1) for k in range(5)], SCHEMA)
    groups = minmax_hash.near_duplicates(docs)
    assert all(r.kept and r.component_id == r.doc_id for r in groups.collect())
    assert minmax_hash.keep_representatives(docs, groups).count() == 5


def test_estimates_are_unbiased_and_vary_less(spark):
    """Over many pairs of sets of one similarity: the mean share of equal values, and its variance against 128 minima."""
    rng = np.random.default_rng(7)
    shared, own = 120, 20
    got = []
    for _ in range(300):
        x = rng.integers(0, 1 << 64, shared + 2 * own, np.uint64)
        a, b = minmax_hash.signature(x[: shared + own]), minmax_hash.signature(np.concatenate([x[:shared], x[shared + own :]]))
        got.append((np.concatenate(a) == np.concatenate(b)).mean())
    s = shared / (shared + 2 * own)
    assert abs(np.mean(got) - s) < 4 * np.sqrt(s * (1 - s) / 128 / 300)
    assert np.var(got) < 1.1 * s * (1 - s) / 128


def test_limit_of_agreement(spark):
    assert 60 < minmax_hash.least_agreement(85) < 90
    assert minmax_hash.least_agreement(85, 1e-3) > minmax_hash.least_agreement(85, 1e-9) > minmax_hash.least_agreement(70, 1e-9)


def test_overlaps(spark):
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(30)] + [np.array([1 << 60], np.uint64)]
    got = minmax_hash.overlaps(sets, columns=7)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(31) for j in range(31) if i != j)


def test_wide_group_of_edited_copies(spark):
    """Copies of one text with few to many edits: most pairs lie below the limit, chains of near ones connect some of them."""
    rng = random.Random(9)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for k in range(300):
        w = list(base)
        for at in rng.sample(range(150), rng.randint(1, 6)):
            w[at] = f"e{rng.randrange(10**9)}"
        rows.append((k, " ".join(w), "s", 5, "k", 1, 2))
    for hot in (1024, 40):
        got = minmax_hash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4), hot=hot).collect()
        assert order(got) == order(plain(rows))
