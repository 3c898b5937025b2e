"""Operators take a batch of texts in portions, so that a task's memory doesn't follow the batch."""

import pyarrow as pa

from corpusloom.llm import tokens, toxicity, training_order


def _texts(n: int) -> list[str]:
    return [f"word{i % 97} other{i % 89} " + "filler " * 40 for i in range(n)]


def test_words_of_portions(monkeypatch, spark):
    """No more than a portion's texts are cut into words at a time, and the counts are the same."""
    docs = spark.createDataFrame([(x, i % 2) for i, x in enumerate(_texts(400))], "text string, toxic int").coalesce(1)
    whole = {tuple(r) for r in toxicity.counted_words(docs).collect()}
    monkeypatch.setattr(toxicity, "PORTION", 4_000)
    assert {tuple(r) for r in toxicity.counted_words(docs).collect()} == whole
    texts = pa.array(_texts(400))
    sizes = [len(x) for x in tokens.portions(texts, texts, toxicity.PORTION)]
    assert sum(sizes) == 400 and max(sizes) < 20


def test_sequences_of_portions(monkeypatch, spark, tmp_path):
    docs = spark.createDataFrame(list(enumerate(_texts(300))), "doc_id long, text string").coalesce(1)
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")

    def records(folder):
        n = training_order.write(docs, folder, length=16)
        got = {tuple(r) for r in training_order.read(spark, folder, length=16, with_ids=False).collect()}
        assert len(got) == n
        return got

    whole = records(f"{tmp_path}/whole")
    monkeypatch.setattr(training_order, "PORTION", 3_000)
    assert records(f"{tmp_path}/cut") == whole
