"""What the training-data operators once left out."""

from __future__ import annotations

import pytest

from searchlift.llm import decontamination, near_dedup

WINDOW = "eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf {}"


@pytest.mark.parametrize("bound", [1, 200_000])
@pytest.mark.parametrize("word", ["a\u00a0b", "a\u00adb", "a\u0085b", "a\u200bb", "a\ufeffb", "ΑΣ'Α"])
def test_decontamination_of_any_word_character(spark, monkeypatch, bound, word):
    monkeypatch.setattr(decontamination, "MAX_WINDOWS", bound)
    docs = spark.createDataFrame([(1, WINDOW.format(word)), (2, WINDOW.format("ab"))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, WINDOW.format(word))], "item_id long, text string")
    out = {r.doc_id: r for r in decontamination.scan(docs, bench).collect()}
    assert out[1].n_hit == out[1].n_words and out[1].contaminated and out[2].n_hit == 0
    assert [r.doc_id for r in decontamination.decontaminate(docs, bench).collect()] == [2]


def test_decontamination_keeps_repeated_rows(spark):
    text = WINDOW.format("dreizehn")
    docs = spark.createDataFrame([(1, text), (1, text), (1, "anderes"), (None, text), (None, text)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, text), (8, text)], "item_id long, text string")
    out = decontamination.with_items(decontamination.scan(docs, bench)).collect()
    assert sorted((r.doc_id or 0, r.n_hit, r.n_items) for r in out) == [(0, 13, 2), (0, 13, 2), (1, 0, 0), (1, 13, 2), (1, 13, 2)]


@pytest.mark.parametrize("run", [near_dedup.near_duplicates, near_dedup.one_of_each])
def test_near_duplicates_refuse_thresholds_that_lose_links(spark, run):
    docs = spark.createDataFrame([(1, "a b c d e f g h i"), (2, "a b c d e f g h j")], "doc_id long, text string")
    with pytest.raises(ValueError):
        run(docs, threshold=60)
    assert run(docs, threshold=90).count() == 2
