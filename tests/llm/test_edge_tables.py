"""Clashing columns, repeated ids and empty tables, for what other tests leave out."""

import random

from test_llm import SCHEMA, docs_of, prose

CLASHES = {"n_tokens": "long", "ids_sha256": "string", "start": "int", "item_id": "string", "edits": "long", "text_hash": "int", "class_id": "long", "n_words": "string", "drops": "int"}


def clashing(spark, rows):
    schema = SCHEMA + "".join(f", {k} {v}" for k, v in CLASHES.items())
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *("c" if v == "string" else 1 for v in CLASHES.values())) for i, t in rows], schema)


def test_tokens_and_leaks_of_tables_with_clashing_columns(spark):
    import public_tokenizers as P

    from tilewave.llm.bpe import bpe_digests
    from tilewave.llm.decontam import drop_leaks, find_leaks

    rng = random.Random(41)
    item = prose(rng, 12)
    rows = [(1, prose(rng, 30)), (2, prose(rng, 20) + " " + item), (None, item), (2, None), (1, prose(rng, 5))]
    docs, plain = clashing(spark, rows), docs_of(spark, [t for _, t in rows], [i for i, _ in rows])
    key = lambda r: tuple((x is None, x) for x in r)
    path = P.path("byte_bpe_50k.tiktoken")
    assert sorted(map(tuple, bpe_digests(docs, path, P.PATTERN).collect()), key=key) == sorted(map(tuple, bpe_digests(plain, path, P.PATTERN).collect()), key=key)
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert sorted((r.doc_id or 0, r.item_id) for r in find_leaks(docs, bench).collect()) == [(0, 7), (2, 7)]
    for block in (8 << 20, 10):
        kept = drop_leaks(docs, bench.unionAll(spark.createDataFrame([(8, "not in any of the texts at all")], bench.schema)), block_bytes=block)
        assert kept.columns == docs.columns and kept.count() == 3


def test_leaks_of_five_blocks_of_items(spark):
    from tilewave.llm.decontam import find_leaks

    rng = random.Random(42)
    items = [prose(rng, 12) for _ in range(5)]
    docs = docs_of(spark, [prose(rng, 9) + " " + items[k % 5] for k in range(20)])
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    most = max(len(t) for t in items)
    assert sorted((r.doc_id, r.item_id) for r in find_leaks(docs, bench, block_bytes=most).collect()) == [(k, k % 5) for k in range(20)]


def test_pipeline_of_empty_tables_and_repeated_ids(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(43)
    texts = [prose(rng, 80) for _ in range(3)]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[0] + " more"), (None, texts[2]), (None, texts[2]), (3, None)]
    for name, docs in (("full", clashing(spark, rows)), ("empty", clashing(spark, rows[:0]))):
        at = str(tmp_path / name)
        docs.write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        got = corpus_pipeline.run(spark, at).collect()
        # two texts of one id both stay, a near copy of one of them goes, and rows without an id aren't merged
        assert sorted(r.doc_id or 0 for r in got) == ([0, 0, 1, 1] if name == "full" else [])
