"""Mixing against a draw made in plain Python, and what the order of a mix must be."""

import itertools
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from tallymark.llm import mixing


def _hash(*parts):
    """The engine's 64-bit hash of several values, as an unsigned number."""
    seed = 42
    for part in parts:
        data = part.encode() if isinstance(part, str) else struct.pack("<i" if isinstance(part, Int) else "<q", part)
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed


class Int(int):
    """A whole number of 32 bits."""


def _signed(value):
    return value - (1 << 64) if value >> 63 else value


def _unit(*parts):
    return (_hash(*parts) >> 11) / (1 << 53)


def _rank(seed, key, epoch, block):
    left, right = block >> 5, block & 31
    shuffled = _signed(_hash(Int(seed), "block", key, epoch))
    for turn in range(4):
        left, right = right, left ^ (_hash(shuffled, Int(turn), Int(right)) & 31)
    return left * 32 + right


def _plain_draw(rows, budgets, seed):
    """(doc_id, epoch, block) of every draw: whole epochs, then documents in order until the budget is met."""
    out = []
    for source, budget in budgets.items():
        mine = [(i, len(t.split()), _signed(_hash(i, t))) for i, s, t in rows if s == source]
        mine = [(i, n, order, _signed(_hash(Int(seed), order)) % 1024) for i, n, order in mine if n]
        left = budget
        for epoch in itertools.count():
            if left <= 0:
                break
            for i, n, order, block in sorted(mine, key=lambda d: (_rank(seed, "=" + source, epoch, d[3]), _unit(Int(seed), "row", d[2], epoch))):
                if left <= 0:
                    break
                left -= n
                out.append((i, epoch, block))
    return sorted(out)


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, "big" if i % 3 else "mid", " ".join(["w"] * (1 + i % 23))) for i in range(6000)]
    rows += [(6000 + i, "few", "a b c d e") for i in range(7)] + [(7000, "one", "x y")]
    return rows, spark.createDataFrame(rows, "doc_id bigint, source string, text string").repartition(5)


@pytest.mark.parametrize("mix", [mixing.Mix(), mixing.Mix(entropy_share=0.9, seed=4), mixing.Mix(budget=1500), mixing.Mix(repeat_limit=1.25)])
def test_the_draw_equals_a_plain_one(corpus, mix):
    rows, docs = corpus
    drawn = mixing.draw(docs, mix).select("row.doc_id", "row.source", "mix_epoch", "mix_block", "mix_repeat").collect()
    sizes = {}
    for _, source, text in rows:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    budgets = {r.source: round(r.mix_repeat * sizes[r.source]) for r in drawn}
    assert sorted((r.doc_id, r.mix_epoch, r.mix_block) for r in drawn) == _plain_draw(rows, budgets, mix.seed)


def test_blocks_follow_one_another(corpus):
    _, docs = corpus
    drawn = mixing.draw(docs, mixing.Mix(entropy_share=0.8)).select("row.source", "mix_epoch", "mix_block", "mix_at").collect()
    orders = []
    for source in ("big", "mid", "few"):
        mine = sorted((r for r in drawn if r.source == source), key=lambda r: r.mix_at)
        runs = [k for k, _ in itertools.groupby((r.mix_epoch, r.mix_block) for r in mine)]
        assert len(runs) == len(set(runs)) and [e for e, _ in runs] == sorted(e for e, _ in runs)
        assert 0 <= mine[0].mix_at and mine[-1].mix_at <= 1
        orders.append([b for e, b in runs if e == 0])
    repeated = sorted((r for r in drawn if r.source == "mid"), key=lambda r: r.mix_at)
    second = [b for b, _ in itertools.groupby(r.mix_block for r in repeated if r.mix_epoch == 1)]
    assert second and second != orders[1][: len(second)]


def test_every_rank_is_taken_once(spark):
    ranks = spark.range(mixing.BLOCKS).select(mixing._rank(17, F.lit("=s"), F.lit(3).cast("long"), F.col("id").cast("int")).alias("rank"))
    assert sorted(r.rank for r in ranks.collect()) == list(range(mixing.BLOCKS))


def test_a_small_source_drawn_very_often(spark, monkeypatch):
    monkeypatch.setattr(mixing, "EPOCHS_AT_ONCE", 8)
    rows = [(i, "large", "w " * 10) for i in range(1000)] + [(5000, "small", "a b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    drawn = mixing.draw(docs, mixing.Mix(entropy_share=1.0)).select("row.doc_id", "mix_epoch").collect()
    epochs = sorted(r.mix_epoch for r in drawn if r.doc_id == 5000)
    assert epochs == list(range(2501))


def test_documents_come_in_the_order_of_the_mix(corpus):
    _, docs = corpus
    ordered = [r.doc_id for r in mixing.mix_documents(docs).select("doc_id").collect()]
    wanted = mixing.draw(docs).select("row.doc_id", "mix_at").collect()
    assert ordered == [r.doc_id for r in sorted(wanted, key=lambda r: r.mix_at)]
