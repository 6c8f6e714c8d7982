"""Each stage of the pipeline against brute force, and the awkward cases at every stage."""

import random
import re

import pytest

import corpus_pipeline
from strandloom.llm import common, quality, secret_scan, tokens

R = random.Random(11)
VOCAB = ["".join(R.choice("abcdefghijklm") for _ in range(5)) for _ in range(500)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, spans string, id long, k1 long, n string, copies int"
LABELS = "doc_id long, quality int, toxic int"


def body(k):
    r = random.Random(k)
    return " ".join(r.choice(VOCAB) for _ in range(r.randrange(60, 120)))


def table():
    texts = [body(k) for k in range(12)] + [None, "", " \n", body(0), body(1) + " tail", "x " * 3000, " ".join(body(k) for k in range(100, 160)), body(30) + ' password = "' + "ab12" * 6 + '"']
    rows = [(i, t, "en", ["a", "b", None][i % 3], len(t or ""), "r", "s", 7, 8, "n", 2) for i, t in enumerate(texts)]
    # A repeated row, a doc_id with two texts, null doc_ids that repeat each other.
    return [*rows, rows[3], (4, body(40), "en", "a", 1, "r", "s", 7, 8, "n", 2), *[(None, body(41), None, "b", 1, None, None, None, None, None, None)] * 2]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(table(), SCHEMA).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, int(i < 8), 0) for i in range(20)] + [(None, 1, 0)], LABELS).write.parquet(f"{where}/labels.parquet")
    return where


def test_quality_stage_drops_what_the_query_rejects(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.quality_rules(spark, docs, sf)
    kept = {r.doc_id: r.kept for r in quality.query(spark, sf).collect() if r.doc_id not in (4,)}
    assert out.columns == docs.columns
    got = [r.doc_id for r in out.collect() if r.doc_id != 4]
    assert sorted(got, key=str) == sorted((r[0] for r in table() if r[0] != 4 and kept[r[0]]), key=str)
    assert not {12, 13, 14, 17} & set(got)


def test_join_stage_keeps_one_of_each_class(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect()), key=str)
    want = {(r[0], r[1]) for r in table() if r[0] not in (15, 16)}
    # Null doc_ids stay as often as they occur.
    assert got == sorted([*want, (None, body(41))], key=str)


def test_secret_stage_masks_each_span(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.secrets(spark, docs, sf)
    got = out.collect()
    assert out.columns == docs.columns and len(got) == len(table())
    for r in got:
        assert not secret_scan.base_spans(r.text or "")[0] and (r.doc_id == 19) == (corpus_pipeline.MASK in (r.text or ""))
        if r.doc_id == 19:
            assert r.text == re.sub('password = "[a-z0-9]+', corpus_pipeline.MASK, dict((x[0], x[1]) for x in table())[19]) and r.n_chars == len(r.text)


def test_mixing_stage_copies_by_the_mix_whatever_the_layout(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus_pipeline.mixing_weights(spark, docs, sf)
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert out.columns == docs.columns and all(t and t.split() for _, t in got)
    assert got == sorted(((r.doc_id, r.text) for r in corpus_pipeline.mixing_weights(spark, docs.repartition(5, "text"), sf).collect()), key=str)
    assert max(got.count(x) / [(r[0], r[1]) for r in table()].count(x) for x in set(got)) <= 3
    words = {s: sum(len((r[1] or "").split()) for r in table() if r[3] == s) for s in ("a", "b", None)}
    total = sum(words.values())
    source = {(r[0], r[1]): r[3] for r in table()}
    for s, share in (("a", 1 / 6), ("b", 2 / 6)):
        want = min(3 * words[s], total * share)
        assert abs(sum(len(t.split()) for d, t in got if source[d, t] == s) - want) <= max(3000, 0.2 * want)


def test_packing_stage_holds_every_id_once(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = corpus_pipeline.best_fit_packing(spark, docs, sf).collect()
    e = tokens.Encoder(tokens.vocabulary("word_bpe_49k.json"))
    assert sum(r.length for r in rows) == sum(len(e.whole(r[1] or "")) + 1 for r in table())


def test_run_and_empty_tables(spark, sf, tmp_path):
    assert corpus_pipeline.run(spark, sf).count() > 0
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    docs = common.documents(spark, str(tmp_path))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0, name
