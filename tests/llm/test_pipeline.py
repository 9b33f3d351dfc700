"""The pipeline against the stages' rules restated in plain Python."""

import base64

import public_tokenizers
import tiktoken

import corpus_pipeline
from graphloom.llm import langid, pii
from tests.llm.test_operators import brute_classes, brute_contamination, texts_of

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_and_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "pii", "byte_bpe"]
    at = docs
    results = []
    for _, stage in corpus_pipeline.STAGES:
        before = at
        at = stage(spark, at, SF)
        at = spark.createDataFrame(at.collect(), at.schema)
        results.append((before, at))
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    assert all(out.columns == columns for _, out in results[:-1])
    model = langid.learn(docs)
    assert ids(results[0][1]) == {r["doc_id"] for r in langid.identify(docs, model).where("not rejected").collect()}
    classes = brute_classes(texts_of(results[1][0]), 5, 8, 10)
    assert ids(results[1][1]) == {d for d, (_, c) in classes.items() if d == c}
    dirty = {r[0] for r in brute_contamination(texts_of(results[2][0]), bench) if r[5]}
    assert dirty and ids(results[2][1]) == ids(results[2][0]) - dirty
    assert ids(results[3][1]) == ids(results[3][0])
    assert pii.detect(results[3][1]).selectExpr("sum(size(email)) + sum(size(card)) as n").first()["n"] == 0
    assert any("[EMAIL]" in t for _, t in texts_of(results[3][1]))
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in results[4][1].collect():
        assert library.decode([int.from_bytes(r["ids"][i : i + 4], "little") for i in range(0, len(r["ids"]), 4)]) == r["text"]
    whole = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"]: bytes(r["ids"]) for r in whole.collect()} == {r["doc_id"]: bytes(r["ids"]) for r in results[4][1].collect()}
