"""Language identification and the pipeline where little or nothing can be learned."""

import random
import zlib

import pytest

import corpus_pipeline
from runlens.llm import exact_dedup, language, pitman_yor

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fold int, share double"
EN = "the quick brown fox jumps over the lazy dog and then it sleeps under a tall tree near the old stone bridge "
DE = "der schnelle braune fuchs springt ueber den faulen hund und schlaeft dann unter einem hohen baum am fluss "


def made(rows):
    return [(d, t, lang, "s", 1, 0.5, 3, 0.1) for d, t, lang in rows]


def predicted(spark, rows):
    df = spark.createDataFrame(made(rows), SCHEMA).repartition(3)
    got = language.identify_language(df).collect()
    assert len(got) == len(rows)
    assert language.keep_accepted(df).count() == (sum(r.accepted for r in got) if any(r.lang_pred != "und" for r in got) else len(rows))
    return got


@pytest.mark.parametrize("labelled", [[(1, None, "en"), (2, "", "de"), (3, None, "en"), (4, None, "fr")], []])
def test_nothing_to_learn(spark, labelled):
    got = predicted(spark, [*labelled, (50, EN, None), (51, DE, None), (52, None, None)])
    assert {(r.lang_pred, r.score, r.accepted) for r in got} == {("und", 0.0, False)}


def test_language_without_text_is_not_learned(spark):
    rows = [(k, EN * (1 + k % 3), "en") for k in range(1, 30)] + [(k, None, "de") for k in range(30, 50)] + [(60, DE, None)]
    assert {r.lang_pred for r in predicted(spark, rows)} == {"en", "und"}


@pytest.mark.parametrize("copies", [1, 40])
def test_one_labelled_row_and_copies_of_it(spark, copies):
    """All labelled text lies in one calibration fold: the language is learned, and accepts what is not worse than chance."""
    own = next(k for k in range(1, 50) if zlib.crc32(str(k).encode()) % 5)
    got = predicted(spark, [(own, EN, "en")] * copies + [(100 + k, EN[k:] + EN, None) for k in range(5)] + [(200, "12 34", None)])
    assert {r.lang_pred for r in got if r.doc_id != 200} == {"en"}
    assert all(r.accepted for r in got if r.doc_id != 200)


def test_very_long_and_repeated_rows(spark):
    rng = random.Random(3)
    words = {"en": EN.split(), "de": DE.split()}
    rows = [(k, " ".join(rng.choice(words[x]) for _ in range(60)), x) for k in range(200) for x in [("en", "de")[k % 2]]]
    rows += [(1000, " ".join(rng.choice(words["de"]) for _ in range(300_000)), None), (1001, rows[0][1], None), (1001, rows[0][1], None)]
    got = {r.doc_id: r for r in predicted(spark, rows)}
    assert got[1000].lang_pred == "de" and got[1000].accepted and got[1001].lang_pred == "en"


@pytest.mark.parametrize("labels", [1, 0])
def test_pipeline_with_one_label_or_none(spark, tmp_path, labels):
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice(EN.split()) + rng.choice("abc") for _ in range(80)), "en" if k == 1 and labels else None) for k in range(1, 20)]
    spark.createDataFrame(made(rows), SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == set(range(1, 20))


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_own_columns_outlive_dedup(spark):
    rows = [(1, "a b", 1, "x", 5), (2, "ab", 2, "y", 6), (None, "c", 3, "z", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _n int, _sha string, nth int")
    kept = exact_dedup.keep_first(df)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect()), key=lambda r: r[2]) == [rows[0], rows[2]]


def test_scores_leave_no_tables_behind(spark):
    docs = spark.createDataFrame([(k, EN if k % 2 else DE) for k in range(20)], "doc_id long, text string")
    before = {t.name for t in spark.catalog.listTables()}
    assert pitman_yor.score_texts(docs, sweeps=2, burn_in=1).count() == 20
    assert {t.name for t in spark.catalog.listTables()} == before
