"""The pipeline's stages, each on its predecessor's output, against brute force."""

import numpy as np
import pytest

import corpus_pipeline
from barloom.llm import linededup, queries
from barloom.llm.common import materialize
from barloom.llm.tokens import TextEncoder

from .test_exact import groups, slow_distance, slow_fingerprint


@pytest.fixture(scope="module")
def outputs(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf), name.replace(" ", "-"))
        out.append(docs)
    return out


def texts(frame):
    return {r.doc_id: r.text for r in frame.collect()}


def test_names_and_columns(outputs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "simhash near-dedup", "benchmark decontamination", "packing"]
    assert all(o.schema == outputs[0].schema for o in outputs[1:-1])


def test_classifier_keeps_good_documents(spark, sf, outputs):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept, every = texts(outputs[1]), texts(outputs[0])
    assert all(every[k] == t for k, t in kept.items())
    good = [k for k, q in labels.items() if q == 1]
    assert sum(k in kept for k in good) >= 0.97 * len(good)
    assert sum(k not in kept for k, q in labels.items() if q == 0) >= 0.8 * sum(q == 0 for q in labels.values())


def test_lines(outputs):
    before, first = texts(outputs[1]), {}
    for d in sorted(before):
        for n, line in enumerate(before[d].split("\n")):
            if line.strip(" \t\v\f\r"):
                first.setdefault(line, (d, n))
    order, later = sorted(first.items(), key=lambda x: x[1]), set()
    by_size = {}
    for line, _ in order:
        if len(line) < linededup.MIN_CHARS:
            continue
        near = [x for size in (len(line) - 1, len(line), len(line) + 1) for x in by_size.get(size, []) if x[:8] == line[:8] or x[-8:] == line[-8:]]
        if any(slow_distance(x, line) <= linededup.MAX_EDITS for x in near):
            later.add(line)
        by_size.setdefault(len(line), []).append(line)
    want = {}
    for d, t in before.items():
        kept = [line for n, line in enumerate(t.split("\n")) if line not in first or (first[line] == (d, n) and line not in later)]
        if len(kept) == len(t.split("\n")) or "".join(kept).strip():
            want[d] = "\n".join(kept)
    assert texts(outputs[2]) == want
    assert all(r.n_chars == len(r.text) for r in outputs[2].collect() if r.text != before[r.doc_id])


def test_one_of_each_group(outputs):
    before = texts(outputs[2])
    ids = sorted(before)
    root = groups([slow_fingerprint(before[k]) for k in ids], lambda a, b: (a ^ b).bit_count() <= 2)
    assert texts(outputs[3]) == {k: before[k] for n, k in enumerate(ids) if root[n] == n}


def test_no_benchmark_passage_is_left(spark, sf, outputs):
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    before = texts(outputs[3])
    assert texts(outputs[4]) == {k: t for k, t in before.items() if not any(i in t for i in items)}


def test_every_id_is_packed(outputs):
    enc, want = TextEncoder(queries.tokenizer_path("word_bpe_49k.json")), texts(outputs[4])
    got = {}
    for r in outputs[5].collect():
        got.setdefault(r.doc_id, []).append((r.start, np.frombuffer(bytes(r.ids), "<u4").tolist()))
    assert {k: sum((x for _, x in sorted(p)), []) for k, p in got.items()} == {k: [*enc.ids(t).tolist(), 2] for k, t in want.items()}


def test_texts_with_the_common_start_of_many_items_go(spark, tmp_path):
    start = "Choose the right answer to the following question about the old town and its river"
    items = [(k, f"{start} where word{k} stands by other{k}") for k in range(300)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(0, f"and {start} only"), (1, "Choose the right answer to the following question"), (2, items[3][1]), (None, start)], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.without_benchmarks(spark, docs, str(tmp_path)).collect()} == {1, None}
