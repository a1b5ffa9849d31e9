import hashlib
import random
import re

import pytest

from baitline.llm import decontaminate

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(rows, items, window=10):
    wins = []
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            wins.append((item, w[i:i + window]))
    out = []
    for d, text in rows:
        w = words(text)
        hit, found = set(), set()
        for item, x in wins:
            for s in range(len(w) - len(x) + 1):
                if w[s:s + len(x)] == x:
                    hit.update(range(s, s + len(x)))
                    found.add(str(item))
        ids = ",".join(sorted(found))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def measured(docs, items):
    got = decontaminate.contamination(docs, items).select("doc_id", *decontaminate.OUTPUTS)
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(8)
    items = [(i, " ".join(f"q{rng.randrange(60)}" for _ in range(n)))
             for i, n in enumerate([30, 12, 10, 9, 5, 4, 3, 2, 1, 1])]
    items += [(20, None), (21, " ,.; "), (22, "Éa b"), (23, items[0][1]), (None, items[2][1]), (9, items[1][1])]
    rows = []
    for k in range(60):
        w = [f"q{rng.randrange(60)}" if rng.random() < 0.3 else f"z{rng.randrange(40)}" for _ in range(rng.randrange(60))]
        if k % 3 == 0:
            src = (items[rng.randrange(8)][1] or "").split()
            cut = src[rng.randrange(3):][:rng.randrange(8, 25)]
            w[rng.randrange(len(w) + 1):0] = cut
        rows.append((k, ", ".join(w).title() if k % 5 == 0 else "  ".join(w)))
    rows += [(100, None), (101, ""), (102, items[0][1] + " x " + items[0][1]), (103, items[0][1][:-1]),
             (102, "another text of a repeated id " + items[1][1]), (None, items[2][1]), (None, "nothing"),
             (104, items[0][1]), (104, items[0][1]), (105, "éA B éa b")]
    return rows, items


def test_against_brute_force(spark, cases):
    rows, items = cases
    want = brute(rows, items)
    assert sum(r[-1] for r in want) > 10
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    # a null item id marks words but names no item
    named = [(i, t) for i, t in items if i is not None]
    got = measured(docs, bench)
    assert [r[:3] + r[5:] for r in got] == [r[:3] + r[5:] for r in want]
    assert measured(docs, bench.where("item_id IS NOT NULL")) == brute(rows, named)


def test_empty_sides_and_clashes(spark, docs, wide, corpus, cases):
    bench = spark.createDataFrame(cases[1], "item_id bigint, text string")
    assert measured(docs.limit(0), bench) == []
    assert measured(docs, bench.limit(0)) == brute(corpus, [])
    assert measured(docs, bench.where("item_id IN (20, 21)")) == brute(corpus, [])
    out = decontaminate.contamination(wide, bench)
    assert out.count() == len(corpus)
    assert set(out.columns) == (set(wide.columns) - {"n_words"}) | set(decontaminate.OUTPUTS)


def test_native_plan(spark, docs, cases):
    bench = spark.createDataFrame(cases[1], "item_id bigint, text string")
    plan = decontaminate.contamination(docs, bench)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|CartesianProduct|NestedLoop", plan)
