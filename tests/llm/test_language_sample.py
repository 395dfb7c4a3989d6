from tallyfield.llm import language


def test_copies_do_not_thin_the_learning_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language, "fit_texts", lambda texts, langs, count: seen.append(sorted(zip(langs.tolist(), texts))) or (None, None))
    plain = [(f"word{i}", lang) for lang in ("a", "b") for i in range(50)]
    for rows in (plain, [*plain, *[("word7", "a")] * 20_000]):
        language.fit(spark.createDataFrame(rows, "text string, lang string"), per_language=20)
    assert seen[0] == seen[1] and [sum(k == j for k, _ in seen[1]) for j in (0, 1)] == [20, 20]


def test_all_of_many_languages_are_learned_and_too_many_are_an_error(spark, monkeypatch):
    import pytest

    word = lambda i: "".join(chr(97 + x % 26) for x in (i, i // 26, 7 * i + 3)) * 2
    rows = [(word(i), f"l{i:03}") for i in range(260)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    model = language.fit(docs)
    assert len(model.languages) == 260
    got = language.identify(docs, model).where("lang_pred = lang").count()
    assert got > 0.9 * len(rows)
    monkeypatch.setattr(language, "LANGUAGES", 259)
    with pytest.raises(ValueError, match="260 languages"):
        language.fit(docs)


def test_texts_beyond_the_bound_of_characters_are_left_out(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language, "fit_texts", lambda texts, langs, count: seen.append(sorted(texts)) or (None, None))
    monkeypatch.setattr(language, "MAX_CHARS", 100)
    rows = [("a" * 30 + f" {k}", "x") for k in range(9)] + [("b" * 30 + f" {k}", "y") for k in range(9)]
    language.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert len(seen[0]) == 3 and {t[0] for t in seen[0]} == {"a", "b"}
