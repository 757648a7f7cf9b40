"""Column names with dots and quotes go through the stages as they are."""

import random

import pytest

from tallymark.llm import mixing, repetition, secrets, shingle_join

NAMES = ["doc_id", "text", "source", "n_chars", "a.b", "text.source", "x`y", "row", "mix_key", "held out"]


@pytest.fixture(scope="module")
def docs(spark):
    draw = random.Random(21)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(draw.choice(words) for _ in range(40)) for _ in range(40)]
    rows = [(i, t, f"s{i % 3}", len(t), i * 2, "x", 1.5, i, "k", None) for i, t in enumerate(texts)]
    # A copy, and a repeated id.
    rows += [(90, texts[0], "s0", len(texts[0]), 180, "x", 1.5, 90, "k", None), (5, texts[5], "s2", len(texts[5]), 10, "x", 1.5, 5, "k", None)]
    kinds = "long string string long long string double long string string".split()
    schema = ", ".join("`" + n.replace("`", "``") + f"` {k}" for n, k in zip(NAMES, kinds))
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("stage", [repetition.keep_documents, shingle_join.keep_one, secrets.mask_documents, mixing.mix_documents])
def test_all_columns_stay(docs, stage):
    found = stage(docs)
    assert found.columns == NAMES
    rows = found.collect()
    assert rows and all(r["a.b"] == 2 * r["doc_id"] and r["x`y"] == 1.5 and r["text.source"] == "x" and r["row"] == r["doc_id"] for r in rows)
