"""Language identification: held-out accuracy, the code's correction of single errors, and the odd cases."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.llm import language_id as li
from docquarry.llm import queries as q

from .test_registered import odd_dir, texts  # noqa: F401


def test_held_out_accuracy(spark):
    """The commonest language has 0.6 of the rows; the four each are found."""
    folder = "/root/testdata/sf0.1"
    rows = q.op13_language_id(spark, folder).where("held_out").join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = {r.lang: r.right for r in rows.groupBy("lang").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right")).collect()}
    assert len(right) == 4 and min(right.values()) > 0.99


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6, 7, 12, 40])
def test_codewords_stand_apart(n):
    code = li.codewords(n)
    assert set(np.unique(code)) == {-1, 1} and not any(abs(int(c.sum())) == n for c in code.T)
    least = min(int((a != b).sum()) for a, b in itertools.combinations(code, 2))
    assert least >= (1 if n == 2 else 2 if n == 3 else 4)  # with four or more, any one wrong bit is corrected


def test_a_wrong_bit_is_corrected_and_even_bits_are_ambiguous():
    code = li.codewords(5)
    bits = code.shape[1]
    model = li.Model(list("abcde"), code, np.zeros((bits, 1 << li.SLOTS), np.float32), np.full(bits, 5.0), np.zeros(bits), np.ones(bits))
    said = np.repeat(code.astype(float), bits, 0)
    said[np.arange(len(said)), np.tile(np.arange(bits), 5)] *= -1
    best, score, lead, off = li.decode(model, said)
    assert best.tolist() == np.repeat(np.arange(5), bits).tolist() and set(off) == {1} and score.min() > 0.5 and lead.min() > li.NEAR
    _, _, lead, _ = li.decode(model, (code[:1] + code[1:2]) / 2.0)
    assert lead[0] < li.NEAR
    # a bit whose classifier is no better than chance has no say
    model.reliability[0] = 0
    said = code[:1].astype(float)
    said[0, 0] *= -100
    assert li.decode(model, said)[0][0] == 0


def fitted(spark, rows):
    return li.fit(spark.createDataFrame(rows, "text string, lang string"))


LEARNT = [(t, k) for k, ts in {"aa": ["la casa de la gente", "una casa de campo"], "bb": ["das haus und der hund", "ein haus und garten"], "cc": ["这是 一个 房子", "这 房子 是"]}.items() for t in ts]


def test_texts_of_all_kinds(spark):
    model = fitted(spark, LEARNT + [(None, "aa"), ("123", "bb"), ("nothing to learn", None), ("", "dd")])
    assert model.languages == ["aa", "bb", "cc"]
    asked = [(None,), ("",), ("12 ?!",), ("casa",), ("HAUS UND",), ("房子",), ("x" * 3_000_000,), ("é",)]
    rows = li.identify(spark.createDataFrame([(*a, i) for i, a in enumerate(asked)], "text string, lang int"), model).orderBy("lang").collect()
    assert [r.lang_pred for r in rows[:6]] == ["und"] * 3 + ["aa", "bb", "cc"] and [r.score for r in rows[:3]] == [0.0] * 3
    assert all(0 <= r.score <= 1 for r in rows) and rows[6].lang_pred in model.languages
    with pytest.raises(ValueError, match="score"):
        li.identify(spark.createDataFrame([("a", 1.0)], "text string, score double"), model)


def test_few_languages_and_no_rows(spark):
    asked = spark.createDataFrame([("words",), (None,)], "text string")
    for rows, want in (([("x", None)], ["und", "und"]), ([("some words", "aa")], ["aa", "und"])):
        assert [r.lang_pred for r in li.identify(asked, fitted(spark, rows)).collect()] == want
    assert li.identify(asked.limit(0), fitted(spark, LEARNT)).collect() == []


def test_partitions_and_neighbours_dont_matter(spark):
    """Each text's n-grams are its own, and a model is the same over any partitions."""
    frame = spark.createDataFrame(LEARNT, "text string, lang string")
    models = [li.fit(frame.coalesce(1)), li.fit(frame.repartition(4))]
    assert np.array_equal(models[0].weights, models[1].weights) and np.array_equal(models[0].slope, models[1].slope)
    many, begins = li._grams([t.encode() for t, _ in LEARNT] + [b"", b"  a  "])
    alone = [li._grams([t])[0] for t in [*(t.encode() for t, _ in LEARNT), b"", b"  a  "]]
    assert begins.tolist() == np.cumsum([0, *(a.shape[1] for a in alone)])[:-1].tolist() and np.array_equal(many, np.concatenate(alone, 1))


def test_registered_query(spark, odd_dir):  # noqa: F811
    rows = {r.doc_id: r for r in q.op13_language_id(spark, odd_dir[0]).collect()}
    assert {i: r.lang_pred for i, r in rows.items()} == {i: "en" if any(ch.isalpha() for ch in t) else "und" for i, t in odd_dir[1].items()}
