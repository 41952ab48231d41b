import numpy as np
import pyarrow as pa
import pytest

from evidencelake.llm import common, language, quality

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")


def test_quality_on_held_out_rows(docs, labels):
    found = quality.held_out_scores(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    assert len(found) == labels.count()
    held = found[found.held_out]
    good, bad = held[held.quality == 1].score, held[held.quality == 0].score
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.97
    assert (held[held.quality == 1].predicted == 1).mean() > 0.97


def test_shapes():
    assert [quality.shape(w) for w in ("THE!!", "Thing,", "ab12", "of***", "|")] == ["A!", "Aa,", "a0", "a*", "|"]


def test_quality_of_odd_rows(spark, docs, labels, odd, none):
    weights = quality.fit(docs, labels)
    found = quality.score(odd, weights, *odd.columns).toPandas()
    assert len(found) == odd.count() and found.iloc[:, -1].between(0, 1).all()
    kept = quality.keep_good(odd, labels)
    assert kept.columns == odd.columns
    nothing = quality.held_out_scores(odd, labels.limit(0)).toPandas()
    assert (nothing.score == 0.5).all() and not nothing.held_out[nothing.doc_id.isna()].any()
    assert quality.held_out_scores(none, labels).count() == 0


def test_language_on_held_out_rows(docs):
    found = language.held_out_languages(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = found[found.held_out]
    assert len(held) and (held.lang_pred == held.lang).mean() > 0.97 and found.score.between(0, 1).all()


def test_language_of_odd_rows(odd, none):
    found = language.held_out_languages(odd.withColumn("doc_id", odd.doc_id)).toPandas()
    letterless = [i for i, r in enumerate(odd.collect()) if not any(c.isalpha() for c in r["text"] or "")]
    assert len(found) == odd.count() and (found.lang_pred == "und").sum() == len(letterless)
    assert (found[found.lang_pred == "und"].score == 0).all()
    assert language.held_out_languages(none).count() == 0
    unknown = language.held_out_languages(odd.withColumn("lang", odd.lang.substr(9, 9))).toPandas()
    assert unknown.lang_pred.notna().all()


def test_temperature_flattens_overconfident_logits():
    draw = np.random.default_rng(0)
    labels = draw.integers(0, 2, 4000)
    wrong = draw.random(4000) < 0.2
    logits = np.zeros((4000, 2))
    logits[np.arange(4000), np.where(wrong, 1 - labels, labels)] = 20.0
    calibrated = language._temperature(logits, labels)
    assert abs(1 / (1 + np.exp(-20 / calibrated)) - 0.8) < 0.02


def test_scores_do_not_depend_on_the_slices():
    texts = pa.array([f"word{i % 7} and {i} others! " * (1 + i % 40) for i in range(300)] + [None, ""])
    batch = pa.record_batch({"text": texts})
    pieces = list(common.slices(iter([batch]), size=2_000))
    assert len(pieces) > 20 and sum(p.num_rows for p in pieces) == len(texts)
    weights = np.random.default_rng(3).normal(size=quality.BUCKETS + 1).astype(np.float32)
    assert np.concatenate([quality.scores(weights, p["text"]) for p in pieces]).tolist() == quality.scores(weights, texts).tolist()
