import pytest

from binlens.llm.langid import shares, train_language


def test_a_rare_language_is_a_class(spark):
    rows = [(i, f"the words of row {i}", "en") for i in range(400)] + [(i, f"les mots de {i}", "fr") for i in range(400, 900)]
    rows += [(9000, "die wörter", "de"), (9001, "ett ord", "sv"), (9002, None, "fi"), (9003, "x", None)]
    model = train_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_rows=20, steps=2)
    assert model.classes == ["de", "en", "fr", "sv"]


def test_a_language_of_one_repeated_id_is_a_class(spark):
    rows = [(7, "les mots", "fr")] * 300 + [(None, "die", "de")] * 200 + [(i, f"words {i}", "en") for i in range(500)]
    model = train_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_rows=30, steps=2)
    assert model.classes == ["de", "en", "fr"]


def test_more_languages_than_rows_are_refused(spark):
    rows = [(i, "x", f"l{i}") for i in range(6)]
    with pytest.raises(ValueError, match="6 languages"):
        train_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_rows=5, steps=2)


def test_shares():
    assert shares({"a": 1, "b": 1000, "c": 1000}, 21) == {"a": 1, "b": 10, "c": 10}
    assert shares({"a": 5, "b": 5}, 100) == {"a": 5, "b": 5} and shares({}, 5) == {}
    assert shares({x: 3 for x in "abc"}, 2) == {x: 1 for x in "abc"}
