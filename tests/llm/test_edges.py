"""Every operator and stage on nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import decontam, licenses, linededup, packing, pseudo, quality, queries, rules, simhash, simple8b, surrogates
from barloom.llm.common import scratch_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, score double, fp long, label int, part int, lines int, n_links int, `open` boolean, h1 long, words string"


def _long_text() -> str:
    r = random.Random(3)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 9))) for _ in range(30_000))


@pytest.fixture(scope="module")
def nasty(spark):
    plain = "The quick brown fox jumps over the lazy dog again and again.\nSecond line of some twenty bytes.\n"
    texts = [(1, plain), (1, plain), (2, plain), (3, None), (None, "no key but a text of some words here"), (None, None), (4, ""), (5, " \t\n \x0b"), (6, "x"), (7, "é " * 60), (8, _long_text()), (9, plain.replace("lazy", "lary")), (10, "\x00 nul <|endoftext|>   中文 𝒳"), (11, "a  b   c\n\n\n")]
    rows = [(k, t, None if k == 2 else "en", None, None if t is None else len(t), "k", 0.5, 1, 1, 2, 3, 4, True, 5, "w") for k, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(nasty):
    return nasty.where("doc_id = -1")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (7, None, 0), (None, 1, 0), (8, 0, 1), (9, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog again and again"), (2, None), (3, ""), (None, "x y z"), (4, "one two")], "item_id long, text string")


def test_quality(nasty, none, labels):
    model = quality.train(nasty, labels)
    rows = quality.score(nasty, model).collect()
    assert len(rows) == 14 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    assert quality.score(none, model).count() == 0
    assert quality.keep_good(nasty, model, threshold=0.0).count() == 14
    assert quality.keep_good(nasty, model).schema == nasty.schema
    empty = quality.train(nasty, labels.where("doc_id = -1"))
    assert {r.score for r in quality.score(nasty, empty).collect()} == {0.5}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_tokens(spark, nasty, none, name):
    path = scratch_path(spark, "edge")
    simple8b.write_tokens(nasty, path, queries.tokenizer_path(name), 0)
    rows = sorted(simple8b.read_tokens(spark, path).collect(), key=lambda r: r.start)
    assert len(rows) == 14 and [r.doc_id for r in rows] == sorted([r.doc_id for r in rows], key=lambda x: (x is not None, x))
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(14)]
    assert {r.n_tokens for r in rows if r.doc_id in (3, 4)} == {1}
    path = scratch_path(spark, "edge")
    simple8b.write_tokens(none, path, queries.tokenizer_path(name), 0)
    assert simple8b.read_tokens(spark, path).count() == 0


def test_packing(nasty, none):
    rows = packing.pack(nasty, queries.tokenizer_path("word_bpe_49k.json"), 2).collect()
    assert {r.doc_id for r in rows} == {None, *range(1, 12)}
    assert sum(r.length for r in rows if r.doc_id == 1) == 2 * next(r.doc_tokens for r in rows if r.doc_id == 2)
    assert all(r.length == len(r.ids) // 4 for r in rows)
    assert packing.pack(none, queries.tokenizer_path("word_bpe_49k.json"), 2).count() == 0


def test_decontamination(nasty, none, items):
    rows = decontam.leaks(nasty, items).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(1, 1), (2, 1)}
    assert decontam.leaks(none, items).count() == 0
    assert decontam.leaks(nasty, items.where("item_id = -1")).count() == 0
    assert decontam.drop_leaks(nasty, items).count() == 11


def test_pseudo_likelihood(nasty, none):
    rows = {r.doc_id: r for r in pseudo.pseudo_likelihood(nasty).collect()}
    assert rows[4].n_words == rows[5].n_words == 0 and rows[4].log_likelihood == 0 and rows[4].per_word is None
    assert rows[1].log_likelihood < 0 and rows[8].n_words == 30_000
    assert pseudo.pseudo_likelihood(none).count() == 0


def test_rules(nasty, none):
    rows = {r.doc_id: r for r in rules.ledger(nasty).collect()}
    assert rows[3].n_words == 0 and rows[5].n_lines == 0 and rows[7].n_repeat_words == 60 and rows[8].n_words == 30_000
    assert rules.ledger(none).count() == 0


def test_surrogates(nasty, none):
    found = surrogates.pseudonymize(nasty, "k")
    before = {(r.doc_id, r.text) for r in nasty.collect()}
    assert {(r.doc_id, r.text) for r in found.collect()} == before
    assert surrogates.pseudonymize(none, "k").count() == 0
    assert surrogates.collisions(found).count() == 0


def test_line_dedup(nasty, none):
    run = linededup.dedup_lines(nasty)
    rows = {r.doc_id: r for r in run.report().collect()}
    assert (rows[1].n_dropped, rows[2].n_dropped, rows[9].n_dropped, rows[9].n_links) == (0, 2, 2, 1)
    assert rows[3].n_lines == 0 and rows[None].n_dropped == 0
    out = run.apply()
    assert out.schema == nasty.schema and out.count() == 12 and {2, 9}.isdisjoint({r.doc_id for r in out.collect()})
    assert linededup.dedup_lines(none).report().count() == 0
    assert linededup.dedup_lines(none).apply().count() == 0


def test_licenses(nasty, none):
    files = nasty.select("*", F.concat_ws("/", "lang", "doc_id").alias("path"))
    assert licenses.scan(files).where("licence IS NOT NULL").count() == 0
    assert licenses.scan(files).count() == 14
    assert licenses.scan(files.where("doc_id = -1")).count() == 0


def test_simhash(nasty, none):
    rows = simhash.near_duplicates(nasty).collect()
    of = {r.doc_id: r.component_id for r in rows}
    assert len(rows) == 14 and of[2] == 1 and of[4] == of[5] == of[3] == 3
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.drop_near_duplicates(nasty)
    assert kept.schema == nasty.schema and sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect())[:3] == [1, 1, 3]


def test_stages_keep_columns(spark, nasty, none, tmp_path, labels, items):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, nasty, str(tmp_path)).schema == nasty.schema, name
        assert stage(spark, none, str(tmp_path)).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, none, str(tmp_path)).count() == 0
