import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from priorkit.llm import language, quality, toxicity
from priorkit.llm.common import remainder, table

SF = "/root/testdata/sf0.01"
def never():
    return F.lit(False)



def f1_of(rows, column):
    p, y = rows["predicted"] == 1, rows[column] == 1
    return (p & y).sum() / max(1, p.sum()), (p & y).sum() / max(1, y.sum())


@pytest.fixture(scope="module")
def labels():
    return pd.read_parquet(f"{SF}/labels.parquet")


def test_toxicity_held_out(spark, labels):
    out = toxicity.op1_toxicity(spark, "/root/testdata/sf0.1").toPandas()
    assert len(out) == 10_000 and out["score"].between(0, 1).all() and ((out["score"] >= 0.3) == (out["predicted"] == 1)).all()
    held = out[out["held_out"]].merge(pd.read_parquet("/root/testdata/sf0.1/labels.parquet"), on="doc_id")
    precision, recall = f1_of(held, "toxic")
    assert precision > 0.7 and recall > 0.85, (precision, recall)


def test_quality_held_out(spark):
    out = quality.op6_quality(spark, "/root/testdata/sf0.1").toPandas()
    assert len(out) == 10_000 and out["score"].between(0, 1).all()
    held = out[out["held_out"]].merge(pd.read_parquet("/root/testdata/sf0.1/labels.parquet"), on="doc_id")
    assert ((held["predicted"] == held["quality"]).mean()) > 0.93


def test_language_held_out_and_sparse(spark):
    docs = table(spark, SF, "documents")
    held = remainder("doc_id", 3) == 1
    model = language.train_model(docs, held)
    assert (model.weights == 0).mean() > 0.3 and model.temperature > 0
    out = language.predict(docs, model).toPandas().merge(docs.select("doc_id", "lang", held.alias("held")).toPandas(), on="doc_id")
    assert (out[out["held"]]["lang"] == out[out["held"]]["lang_pred"]).mean() > 0.97


def test_odd_rows(make, odd, spark):
    docs = make(odd)
    labels = spark.createDataFrame([(1, 1, None), (1, 1, 0), (4, 0, 1), (None, 1, 1), (2, None, 0)], "doc_id long, quality int, toxic int")
    t = toxicity.score_documents(docs, toxicity.train(docs, labels, never())).toPandas()
    q = quality.score_documents(docs, quality.train(docs, labels, never())).toPandas()
    g = language.predict(docs, language.train_model(docs, never())).toPandas()
    for out in (t, q, g):
        assert len(out) == len(odd) and out["score"].between(0, 1).all() and out["doc_id"].isna().sum() == 1
    named = dict(zip(g["doc_id"], g["lang_pred"]))
    assert named[2] == named[3] == named[5] == named[7] == "und" and named[4] in ("en", "de")


def test_empty_tables(make, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = make([])
    assert toxicity.score_documents(docs, toxicity.train(docs, none, never())).count() == 0
    assert quality.score_documents(docs, quality.train(docs, none, never())).count() == 0
    assert language.train_model(docs, never()) is None and language.predict(docs, None).count() == 0
    assert set(language.predict(make([(1, "hello")]), None).toPandas()["lang_pred"]) == {"und"}


def test_toxicity_without_signal_keeps_all_rows(make, spark, tmp_path):
    """No usable label, or none that a unit tells apart: one score below the threshold, and no row goes."""
    texts = [(i, ("a short one", "a good deal longer than the others " * 20)[i % 2]) for i in range(1, 9)]
    make(texts).write.parquet(str(tmp_path / "documents.parquet"))
    docs = table(spark, str(tmp_path), "documents")
    schema = "doc_id long, quality int, toxic int"
    held_ids = [r.doc_id for r in docs.where(toxicity.held(4, 2)).collect()]
    learned = [(i, 0, i % 2) for i, _ in texts if i not in held_ids]
    cases = [([], 0.0), ([(1, 1, None)], 0.0), ([(i, 0, 1) for i in held_ids], 0.0), ([(99, 0, 1)], 0.0), (learned, None), ([(i, 0, 1) for i, _, _ in learned], None)]
    for i, (rows, score) in enumerate(cases):
        folder = tmp_path / str(i)
        make(texts).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame(rows, schema).write.parquet(str(folder / "labels.parquet"))
        out = toxicity.op1_toxicity(spark, str(folder)).toPandas()
        assert len(out) == len(texts) and out["score"].nunique() == 1 and (out["predicted"] == 0).all(), rows
        assert score is None and 0 < out["score"].iat[0] < toxicity.THRESHOLD or out["score"].iat[0] == score, rows
        assert toxicity.drop_toxic(spark, docs, str(folder)).count() == len(texts)
    clean = [(i, 0, 0) for i, _, _ in learned]
    model = toxicity.train(docs, spark.createDataFrame(clean, schema), never())
    assert model.constant == 0.5 / (len(clean) + 1)


def test_folded_kernel_equals_pairwise_kernel():
    """The weights folded over landmarks give what kernels with each landmark give."""
    def explicit(u):
        symbols = [toxicity.FIRST, *map(toxicity.symbol, u), toxicity.LAST]
        out = {}
        for i in range(len(symbols)):
            for combo in toxicity._COMBOS:
                if i + combo[-1] < len(symbols):
                    picked = tuple(symbols[i + k] for k in (0, *combo))
                    if toxicity.GAP not in picked:
                        out.setdefault(picked, []).append(toxicity.DECAY ** (combo[-1] + 1))
        scale = sum(w * w for ws in out.values() for w in ws) ** 0.5 or 1
        return {k: sum(ws) / scale for k, ws in out.items()}

    units = ["idiot", "i-d-i-o-t", "scum", "the", "worthless", "a", "réeux", "house", "trash"]
    columns = toxicity.subsequences(units)
    rows = toxicity.rows_of(units, columns)
    kernel = rows @ rows.T
    for i, a in enumerate(units):
        for j, b in enumerate(units):
            x, y = explicit(a), explicit(b)
            assert abs(kernel[i, j] - sum(w * y.get(k, 0) for k, w in x.items())) < 1e-4
    model = toxicity.fit_svm(["idiot", "scum", "trash"] * 1, ["the", "house", "tree", "stone", "water", "river"])
    folded = toxicity.dot(units, model.weights)
    full = np.zeros(toxicity.SYMBOLS**toxicity.LENGTH, np.float32)
    full[columns] = 1
    assert np.allclose(folded, rows @ model.weights[columns], atol=1e-4)
    m = dict(zip(["idiot", "id-iot", "idi0t", "iidiot", "scu.m", "house", "water"], model.margins(["idiot", "id-iot", "idi0t", "iidiot", "scu.m", "house", "water"])))
    assert min(m["idiot"], m["id-iot"], m["idi0t"], m["iidiot"], m["scu.m"]) > 0 > max(m["house"], m["water"])


def test_units_join_letters_written_apart():
    assert "idiot" in toxicity.units_of("you i d i o t there")
    assert toxicity.units_of("") == []


def test_buckets_do_not_depend_on_the_batch():
    words = [w.encode() for w in ("the", "Ünïcode", "a", "house###", "THE")]
    alone = [sorted(quality.buckets_of([w])[0].tolist()) for w in words]
    at, owner = quality.buckets_of(words)
    assert [sorted(at[owner == i].tolist()) for i in range(len(words))] == alone
    assert alone[0] != alone[4]


def test_ftrl_is_sparse_and_calibrated():
    rng = random.Random(1)
    v, y = [], []
    for i in range(300):
        y.append(i % 3)
        at = np.unique([rng.randrange(200) for _ in range(10)] + [1000 + i % 3])
        v.append((at, np.full(len(at), len(at) ** -0.5)))
    w, b = language.ftrl(v, np.array(y), 3)
    assert (w == 0).mean() > 0.99 and (w[1000:1003].argmax(axis=1) == [0, 1, 2]).all()
    z = np.array([[5.0, 0.0]] * 80 + [[0.0, 5.0]] * 20)
    t = language.best_temperature(z, np.zeros(100, int))
    assert abs(language.softmax(z[:1] / t)[0, 0] - 0.8) < 0.02


CLASHES = ("score", "label", "x", "at", "share", "unit", "units", "th", "word", "n", "part", "lang_pred", "predicted", "kept")


def test_clashing_columns_change_nothing(make, odd, spark):
    """Input columns with the names of results and intermediate columns are not read, and survive a filter."""
    docs = make(odd)
    wide = docs
    for c in CLASHES:
        wide = wide.withColumn(c, F.lit("clash"))
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (6, 1, 1)], "doc_id long, quality int, toxic int")

    def rows(df):
        return sorted(map(str, df.collect()))

    for module in (toxicity, quality):
        assert rows(module.score_documents(docs, module.train(docs, labels, never()))) == rows(module.score_documents(wide, module.train(wide, labels, never())))
    assert rows(language.predict(docs, language.train_model(docs, never()))) == rows(language.predict(wide, language.train_model(wide, never())))


def test_drop_toxic_keeps_columns_of_any_type(make, odd, spark, tmp_path):
    make(odd).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    wide = make(odd).withColumn("tags", F.array(F.lit("a"), F.lit(None))).withColumn("more", F.create_map(F.lit("k"), F.col("doc_id"))).withColumn("score", F.lit(2.5)).withColumn("day", F.lit("2024-01-01").cast("date"))
    out = toxicity.drop_toxic(spark, wide, str(tmp_path))
    assert out.schema == wide.schema and sorted(map(str, out.collect())) == sorted(map(str, wide.collect()))
    assert toxicity.drop_toxic(spark, wide.limit(0), str(tmp_path)).count() == 0


def test_sentence_margins_equal_explicit_kernels():
    """A sentence's margin is the sum of its units' answers over the root of its length, and a unit's answer its kernel with the landmarks."""
    toxic = [["you", "idiot"], ["such", "scum", "here"], ["trash"]]
    clean = [["the", "house", "tree"], ["stone", "water"], ["river", "such", "here"], ["you", "the"]]
    model = toxicity.fit_svm(toxic, clean)
    sentences = [*toxic, *clean, ["1d10t"], ["the", "id-iot", "of", "river"]]
    margins, answers = model.sentence_margins(sentences, {})
    units = [u for s in sentences for u in s]
    assert np.allclose(answers, toxicity.dot(units, model.weights))
    at = 0
    for s, m in zip(sentences, margins):
        assert abs(m - (answers[at : at + len(s)].sum() / len(s) ** 0.5 + model.bias)) < 1e-6
        at += len(s)
    by = dict(zip(map(tuple, sentences), margins))
    assert min(by["you", "idiot"], by["trash",], by["1d10t",]) > max(by["the", "house", "tree"], by["stone", "water"], by["you", "the"])
    assert toxicity.sentences_of("One two. Three!\n\n four") == [["one", "two"], ["three"], ["four"]]
    assert [len(s) for s in toxicity.sentences_of("wo " * 60)] == [24, 24, 12]
    assert toxicity.sentences_of("you i d i o t") == [["you", "i", "d", "i", "o", "t", "idiot"]]


def test_quality_scores_equal_plain_averages():
    """A text's score is the softmax of the average over its words' and character n-grams' vectors, counted plainly."""
    rng = np.random.default_rng(5)
    model = quality.Model(rng.normal(size=quality.BUCKETS), 0.3)
    texts = ["the häuser 日本 of", "", " \n", "a", "the the THE x" * 3]
    got = model.scores(texts, {})
    for t, g in zip(texts, got):
        total, n = 0.0, 0
        for w in t.encode().split():
            at, _ = quality.buckets_of([w])
            word = "<" + w.decode() + ">"
            assert len(at) == 1 + sum(max(0, len(word) - k + 1) for k in quality.GRAMS)
            total += model.by_bucket[at].sum()
            n += len(at)
        assert abs(g - 1 / (1 + np.exp(-(total / n if n else 0) - 0.3))) < 1e-9


def test_language_vectors_and_steps_equal_plain_ones():
    """TF-IDF of a text and one step of the regularised leader, written out."""
    idf = np.linspace(1, 2, language.BUCKETS)
    model = language.Model([], idf, np.zeros((language.BUCKETS, 0)), np.zeros(0))
    counts = language.counts_of("aBa")
    assert counts.sum() == 5 + 4 + 3  # one, two and three characters of " aba "
    at, x = model.vector("aBa")
    plain = np.log1p(counts[at]) * idf[at]
    assert np.allclose(x, plain / np.sqrt((plain**2).sum())) and (counts[at] > 0).all()
    v = [(np.array([3]), np.array([1.0])), (np.array([5]), np.array([1.0]))]
    before = language.EPOCHS
    language.EPOCHS = 1
    try:
        w, _ = language.ftrl(v, np.array([0, 1]), 2)
    finally:
        language.EPOCHS = before
    g = 0.5  # both classes start at one half; the gradient is one half less the outcome
    z = -g if g > language.L1 else 0.0
    want = (abs(z) - language.L1) / ((language.BETA + g) / language.ALPHA + language.L2)
    assert abs(w[3, 0] - want) < 1e-9 and abs(w[3, 1] + want) < 1e-9 and abs(w[5, 1] - want) < 1e-9 and w[4, 0] == 0


def test_many_languages_are_all_learned(make, spark):
    """No cap on languages: each of 230 is predicted for its own text."""
    rows = [(i, f"{chr(0x4E00 + 7 * k)}{chr(0x5000 + 11 * k)} " * 20, f"l{k:03}", None) for k in range(230) for i in (k, 1000 + k)]
    docs = make(rows)
    model = language.train_model(docs, never())
    assert len(model.languages) == 230
    out = {r.doc_id: r.lang_pred for r in language.predict(docs, model).collect()}
    assert sum(out[i] == lang for i, _, lang, _ in rows) / len(rows) > 0.5
