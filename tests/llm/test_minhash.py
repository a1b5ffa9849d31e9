"""SuperMinHash near-dedup against brute force over full shingle sets."""
import random

import numpy as np
import pytest

from baitline.llm import minhash

from .conftest import SCHEMA, some_words


def naive(rows, percent=85):
    """(doc_id, n, component, kept) by comparing every pair of rows."""
    sets = []
    for _, text in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for c in "\t\n\r\x0b\x0c":
            lower = lower.replace(c, " ")
        words = [w for w in lower.split(" ") if w]
        width = min(5, len(words))
        sets.append({tuple(words[i:i + width]) for i in range(len(words) - width + 1)} if words else set())
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    out = []
    for (doc, _), mine, g in zip(rows, sets, group):
        ids = [d for (d, _), h in zip(rows, group) if h == g and d is not None]
        first = min(ids) if ids else None
        out.append((doc, len(mine), first, doc == first))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_matches_brute_force(spark, corpus, docs, wide):
    expected = naive(corpus)
    assert found(minhash.near_duplicates(docs)) == expected
    assert found(minhash.near_duplicates(wide)) == expected


def edited(rng, words, share):
    words = list(words)
    for i in rng.sample(range(len(words)), max(1, int(share * len(words)))):
        words[i] = f"e{rng.randrange(10**9)}"
    return " ".join(words)


@pytest.mark.parametrize("share", [0.01, 0.02, 0.04])
def test_groups_of_edited_copies(spark, share):
    """Copies around the threshold: linked through each other, stragglers, and two groups that share text."""
    rng = random.Random(int(share * 1000))
    base = some_words(rng, 200, 5000)
    second = base[:120] + some_words(rng, 80, 5000)
    rows = [(i, edited(rng, base, rng.choice([0.005, share]))) for i in range(60)]
    rows += [(100 + i, edited(rng, second, rng.choice([0.005, share]))) for i in range(40)]
    assert found(minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == naive(rows)


def test_chain_is_one_component(spark):
    """Each text differs from the next by a little, the ends by much."""
    rng = random.Random(3)
    words = some_words(rng, 150, 5000)
    rows = []
    for i in range(30):
        words = words[2:] + some_words(rng, 2, 5000)
        rows.append((50 - i, " ".join(words)))
    out = found(minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)))
    assert out == naive(rows)
    assert {r[2] for r in out} == {21}


def test_candidates_do_not_grow_with_the_square_of_a_group(spark):
    def pairs(n):  # n members of the same four buckets, and one that meets others too
        rows = [(k, i, n) for i in range(n) for k in range(4)] + [(9, 5, 50)]
        found = minhash._pivot_pairs(spark.createDataFrame(rows, "key bigint, name bigint, k bigint")).collect()
        assert sum(5 in (r.a, r.b) for r in found) == n - 1          # the most central member meets all
        return len(found)

    assert pairs(400) <= 2 * 400 and pairs(800) <= 2 * 800


def test_prefix_join_is_complete(spark):
    """Every pair of different components at the threshold is among the candidates; no pair within one."""
    rng = np.random.default_rng(7)
    rows, sets = [], []
    for i in range(40):
        own = set(range(60)) if i < 30 else set(range(20, 90))
        mine = {int(x) for x in own if rng.random() > 0.07} | {int(x) for x in rng.integers(1000, 10**6, 3)}
        sets.append(mine)
        rows.append((i, i % 3, len(mine), sorted(mine)))
    df = spark.createDataFrame(rows, "name bigint, component bigint, n bigint, elements array<bigint>")
    got = {tuple(r) for r in minhash._prefix_pairs(df, 85).collect()}
    true = {(i, j) for j in range(40) for i in range(j)
            if i % 3 != j % 3 and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])}
    assert true and true <= got
    assert all(a % 3 != b % 3 for a, b in got)


def test_signatures_estimate_similarity_with_less_variance():
    rng = np.random.default_rng(1)
    errors = []
    for _ in range(150):
        pool = rng.integers(0, 2**63, 200, dtype=np.uint64)
        a, b = np.sort(pool[:150]), np.sort(pool[50:])  # 100 of 200 in common
        x, y = minhash.signatures([a, b])
        errors.append((x == y).mean() - 0.5)
    assert abs(np.mean(errors)) < 0.01
    assert np.std(errors) < (0.25 / minhash.SLOTS) ** 0.5  # below that of independent permutations


def test_long_sets_and_batches_give_the_same_signature(monkeypatch):
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (1, 3, 40, 0, 700, 5000)]
    together = minhash.signatures(sets)
    assert all((minhash.signatures([s])[0] == row).all() for s, row in zip(sets, together))
    monkeypatch.setattr(minhash, "_ELEMENTS", 64)
    assert (minhash.signatures(sets) == together).all()


def test_empty_table_and_rows_without_words(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "one two"), (4, None)]
    assert found(minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == naive(rows)
