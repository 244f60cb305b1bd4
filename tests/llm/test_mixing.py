"""Mixes that repeat scarce sources, and mixes that can't be had."""

import pytest

from pagelens.llm import mixing

SCHEMA = "doc_id bigint, text string, lang string, source string"


@pytest.fixture(scope="module")
def scarce(spark):
    """202 texts of 100 words, 2 of them of a rare source."""
    return spark.createDataFrame([(i, "w " * 100, "en", "rare" if i < 2 else "web") for i in range(202)], SCHEMA)


@pytest.fixture(scope="module")
def halves(spark):
    return {"source": spark.createDataFrame([("rare", 0.5), ("web", 0.5)], "key string, share double")}


def test_a_scarce_source_is_repeated(scarce, halves):
    once = mixing.mix_documents(scarce, ["doc_id"], mixing.Mix(), halves).toPandas()
    assert once.wanted[0] == pytest.approx(380) and once.copies.max() == 1
    many = mixing.mix_documents(scarce, ["doc_id"], mixing.Mix(most_copies=50), halves).toPandas()
    assert many.wanted[0] == pytest.approx(0.8 * 20200) and many.residual[0] <= 0.001
    rare = many[many.source == "rare"]
    assert rare.probability.tolist() == pytest.approx([40.4, 40.4], rel=0.01) and set(rare.copies) <= {40, 41}
    assert 0.3 < many[many.source == "web"].copies.mean() < 0.5 and (many.kept == (many.copies > 0)).all()


def test_copies_are_rows(scarce):
    mix = mixing.Mix(rate=2.5, most_copies=3)
    counts = mixing.sample_documents(scarce, mix).groupBy("doc_id").count().toPandas()
    drawn = mixing.mix_documents(scarce, ["doc_id"], mix).where("kept").selectExpr("doc.doc_id", "copies").toPandas()
    assert dict(counts.values) == dict(drawn.values) and 2 <= drawn.copies.min() and drawn.copies.max() <= 3
    assert mixing.sample_documents(scarce, mix).columns == scarce.columns


def test_targets_that_cannot_be_met(spark, halves):
    """A source that has a language of its own can't have another share than the language."""
    cells = spark.createDataFrame([("rare", "fr", "prose", 100), ("web", "en", "prose", 900)], "source string, lang string, topic string, tokens bigint")
    mix = {"lowered": 2, "patience": 1}
    out = mixing.rake(cells, mixing.Mix(**mix), halves).toPandas()
    assert (out.residual > 0.3).all()
    with pytest.raises(ValueError, match="can't be met"):
        mixing.rake(cells, mixing.Mix(**mix, strict=True), halves)
