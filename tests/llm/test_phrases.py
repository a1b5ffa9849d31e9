"""Phrase mining against a count of every n-gram."""
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from baitline.llm import phrases

SCHEMA = "doc_id bigint, lang string, text string"


def naive(rows, least=30, top=2000):
    freq, total = defaultdict(Counter), Counter()
    for _, lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            words = [w for w in re.split("[ \t]", piece) if w]
            total[lang] += len(words)
            for size in range(1, 5):
                freq[lang].update(tuple(words[i:i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, f in freq.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in cand.items():
            if any(100 * b >= 80 * a and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q)))
                   for q, b in cand.items()):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


def corpus(seed=1, n=300):
    rng = random.Random(seed)
    stock = ["New York City", "in New York", "as soon as possible", "soon as", "ça et là", "the the the", "x y"]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(1, 30)):
            parts.append(rng.choice(stock) if rng.random() < 0.5 else f"w{rng.randrange(40)}")
            parts.append(rng.choice([" ", " ", "\t ", ", ", "\n", ".", "\x0b", "! "]))
        rows.append((i, rng.choice(["en", "fr", None, "und"]), "".join(parts)))
    return rows + [(900, "en", None), (901, "de", ""), (902, None, " \n ,.. "), (903, "fr", "solo")] + rows[:20]


def found(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def test_matches_a_count_of_every_phrase(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    expected = naive(rows)
    assert len(expected) > 20
    assert found(phrases.phrases(df)) == expected
    wide = df.selectExpr("*", "'own' AS w1", "1 AS pair", "'c' AS phrase", "2 AS a", "3 AS size")
    assert found(phrases.phrases(wide.repartition(5))) == expected


@pytest.mark.parametrize("least, top", [(2, 2000), (5, 7)])
def test_ties_limits_and_the_joined_form(spark, monkeypatch, least, top):
    """Many ties; filters of one block, whose false hits trim less."""
    rows = corpus(2, 60)
    monkeypatch.setattr(phrases, "MAX_BITS", 1 << 15)
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(phrases.phrases(df, min_count=least, top=top)) == naive(rows, least, top)


def test_long_piece_and_empty_table(spark):
    rows = [(1, "en", "a b c d " * 5000), (2, "en", "x" * 100_000)]
    assert found(phrases.phrases(spark.createDataFrame(rows, SCHEMA))) == naive(rows)
    assert found(phrases.phrases(spark.createDataFrame([], SCHEMA))) == []


def test_only_the_longest_windows_are_exploded(spark):
    df = spark.createDataFrame([(1, "en", "A b c. d")], SCHEMA)
    rows = sorted(tuple(r) for r in phrases.windows(df).collect())
    assert rows == [("en", "a", "b", "c", None), ("en", "b", "c", None, None), ("en", "c", None, None, None),
                    ("en", "d", None, None, None)]
    plan = phrases.trimmed(df, 1)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    plan = phrases.frequencies(df)._jdf.queryExecution().executedPlan().toString()
    assert "Expand" in plan and "Window" not in plan


@pytest.mark.parametrize("bits", [1 << 15, 1 << 20])
def test_a_filter_has_every_frequent_hash(spark, monkeypatch, bits):
    """No frequent hash is missed; a large filter has few others."""
    monkeypatch.setattr(phrases, "MAX_BITS", bits)
    rng = random.Random(3)
    frequent = [rng.randrange(-2**63, 2**63) for _ in range(3000)]
    rare = [rng.randrange(-2**63, 2**63) for _ in range(3000)]
    hashes = spark.createDataFrame([(h,) for h in frequent * 3 + rare * 2], "h bigint")
    held = phrases.Filter(hashes, 3)
    asked = spark.createDataFrame([(h, h in set(frequent)) for h in frequent + rare], "h bigint, wanted boolean")
    got = held.mark(asked, F.col("h"), "hit").collect()
    assert all(r.hit for r in got if r.wanted)
    assert bits < 1 << 20 or sum(r.hit for r in got if not r.wanted) < 150
