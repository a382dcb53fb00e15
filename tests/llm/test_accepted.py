import random

from quillon.llm import langid
from tests.llm.test_text_operators import LANGS, texts


def test_mixtures_of_three_languages_stay(spark):
    rng = random.Random(2)
    mixed = " ".join(w for lang, n in (("aa", 80), ("bb", 60), ("cc", 60)) for w in rng.choices(LANGS[lang].split(), k=n))
    df = spark.createDataFrame([*texts(rng, 90), (900, mixed, None), (901, "12 34", "aa")], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.predict(df, *langid.fit(df)).collect()}
    assert set(got[900].shares) == set(LANGS) and got[900].score < 0.5
    left = {r.doc_id for r in langid.accepted(df).collect()}
    assert 900 in left and 901 not in left


def test_nothing_is_dropped_where_nothing_could_be_learned(spark):
    df = spark.createDataFrame([(1, "some words", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {r.doc_id for r in langid.accepted(df).collect()} == {1, 2}
