"""The pipeline's stages against brute force, each on what its predecessor kept."""

from collections import Counter

from llmkit import SF
from test_native import brute_lines
from test_text import brute_groups, distance, encoding

import corpus_pipeline
from aquila.llm import decontamination, quality_classifier
from aquila.llm.text import words_of


def test_stages(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "byte_level_bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    seen = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        out = stage(spark, docs, SF)
        assert i == 4 or out.columns == before.columns
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        seen.append({r["doc_id"]: r for r in docs.collect()})
    start = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    classified, cut, unique, clean, encoded = seen
    scores = {r["doc_id"]: r["predicted"] for r in quality_classifier.score_quality(spark.read.parquet(f"{SF}/documents.parquet"), labels).collect()}
    assert classified == {i: r for i, r in start.items() if scores[i]} and 0 < len(classified) < len(start)
    want = brute_lines([(i, r["text"]) for i, r in classified.items()])
    assert Counter((i, r["text"]) for i, r in cut.items()) == Counter((i, t) for i, t, _, _ in want) and all(r["n_chars"] == len(r["text"]) for r in cut.values())
    groups = brute_groups([(i, r["text"]) for i, r in cut.items()], 5, 80, 100)
    assert unique == {i: cut[i] for i, _, g in groups if i == g} and len(unique) < len(cut)
    items = [words_of(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaky = {i for i, r in unique.items() if any(distance(x, words_of(r["text"])) <= decontamination.EDITS * len(x) for x in items)}
    assert clean == {i: r for i, r in unique.items() if i not in leaky} and leaky
    _, library = encoding()
    assert {i: r["n_tokens"] for i, r in encoded.items()} == {i: len(library.encode_ordinary(r["text"])) for i, r in clean.items()}
    assert Counter(map(tuple, corpus_pipeline.run(spark, SF).collect())) == Counter(map(tuple, encoded.values()))
