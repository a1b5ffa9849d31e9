"""The pipeline against the brute-force versions of its stages."""
import corpus_pipeline
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_line_dedup import LOWER, WHITE
from tests.llm.test_simhash import brute_components
from collections import defaultdict

import base64
import hashlib

import public_tokenizers as P
import tiktoken


def drop_lines(rows):
    key = lambda x: x.strip(WHITE).translate(LOWER)
    holders = defaultdict(list)
    for d, t in rows.items():
        for k in {key(x) for x in t.split("\n")}:
            if len(k) >= 20:
                holders[k].append(d)
    gone = {k: max(v) for k, v in holders.items() if len(v) >= 3}
    return {d: "\n".join(x for x in t.split("\n") if gone.get(key(x), d) == d) for d, t in rows.items()}


def test_stages_and_run(spark, sf):
    source = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "byte_bpe"]
    kept = corpus_pipeline.drop_toxic(spark, source, sf)
    assert kept.columns == source.columns
    rows = {r.doc_id: r.text or "" for r in kept.collect()}
    rows = drop_lines(rows)
    rows = {d: rows[d] for d, _, c in brute_components(list(rows.items())) if d == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {r[0] for r in contaminated(list(rows.items()), items) if not r[-1]}
    ranks = {base64.b64decode(a): int(b) for a, b in
             map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    codec = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for d in clean:
        ids = codec.encode_ordinary(rows[d])
        want[d] = (len(rows[d]), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    out = corpus_pipeline.run(spark, sf)
    assert {r.doc_id: (r.n_chars, r.n_tokens, r.ids_sha256) for r in out.collect()} == want


def test_stages_keep_the_columns_and_take_empty_tables(spark, sf):
    source = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(9_001, None, None, None, None), (9_002, "", "en", "s", 0), (9_002, "", "en", "s", 0)],
                                source.schema)
    for docs, least in ((source.limit(0), 0), (source.limit(20).unionAll(odd), 1)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == source.columns and out.count() >= least


def test_a_run_leaves_one_table(spark, sf):
    """Intermediate tables go once their stage is written; the result can still be read."""
    from baitline.session import checkpoint_dir
    from baitline.sources.folders import Folder
    made = lambda: {n for n in Folder(spark, checkpoint_dir(spark)).names() if n.startswith("llm-")}
    before = made()
    out = corpus_pipeline.run(spark, sf)
    left = made() - before
    assert len(left) == 1 and next(iter(left)).startswith("llm-byte_bpe-")
    assert out.count() > 0
