from random import Random

import pytest

from schemaloom.llm import packing as pk
from schemaloom.llm.tokens import VOCABULARY, counter, encoder


def test_counts_equal_whole_encodings():
    rng = Random(1)
    bits = ["a", " ", "  ", "\n", "\t", "word", "it's", "é", "数", "_x", "9", ".", " ", "\x1c", "Ünï", "<|endoftext|>", " don't ", "\r\n"]
    count, encode = counter(VOCABULARY), encoder(VOCABULARY).encode_ordinary
    for _ in range(400):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(40)))
        assert count(t) == len(encode(t)), repr(t)
    assert count(None) == count("") == 0
    long = "some text " * 30_000
    assert count(long) == len(encode(long))


def test_crossover_keeps_every_item():
    rng = Random(2)
    sizes = [rng.randrange(1, 100) for _ in range(150)]
    a, b = (pk.first_fit_random(150, sizes, 100, rng) for _ in range(2))
    for _ in range(20):
        a, b = pk.crossover(a, b, sizes, 100, rng), pk.mutate(b, sizes, 100, rng)
        for p in (a, b):
            assert sorted(i for x in p.bins for i in x) == list(range(150)) and max(p.fill) <= 100


def test_evolution_improves():
    rng = Random(3)
    sizes = [rng.randrange(26, 60) for _ in range(120)]
    start = [pk.first_fit_random(120, sizes, 100, rng).numbers(120) for _ in range(4)]
    best, _ = pk.evolve(sizes, start, 100, 1, generations=30)
    assert max(best[0]) <= min(max(s) for s in start)


COLS = "doc_id bigint, text string, row string, size int"


@pytest.mark.parametrize("shard", [20, 1000])
def test_documents(spark, shard, monkeypatch):
    monkeypatch.setattr(pk, "SHARD", shard)
    monkeypatch.setattr(pk.pack, "__kwdefaults__", {"shard": shard})
    rng = Random(4)
    texts = ["word " * rng.randrange(1, 90) for _ in range(150)] + [None, "", "x " * 700, "same text"] + ["same text"] * 3
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)] + [(5, texts[5], "x", 1)], COLS)
    rows = pk.pack_documents(df, capacity=128).collect()
    count = counter(VOCABULARY)
    per, bins = {}, {}
    for r in rows:
        per.setdefault(r.doc_id, []).append(r)
        if r.container_id is not None:
            bins.setdefault(r.container_id, []).append(r)
        else:
            assert r.n_tokens == 0
    for i, t in enumerate(texts):
        assert sum(r.n_tokens for r in per[i]) == count(t) * (2 if i == 5 else 1)
        assert len(per[i]) == max(1, -(-count(t) // 128)) * (2 if i == 5 else 1)
    for rs in bins.values():
        used = sum(r.n_tokens for r in rs)
        assert used <= 128 and {r.unused_tokens for r in rs} == {128 - used}
    total = sum(r.n_tokens for r in rows)
    assert len(bins) <= -(-total // 128) + 3
    rep = pk.container_report(spark.createDataFrame(rows), 128).first()
    assert rep.containers == len(bins) and rep.tokens == total and rep.unused_tokens == len(bins) * 128 - total


def test_empty(spark):
    assert pk.pack_documents(spark.createDataFrame([], COLS)).count() == 0
    assert pk.pack_documents(spark.createDataFrame([(1, None, "", 0)], COLS)).first().container_id is None


def test_items_that_never_fill_a_container(spark):
    items = spark.range(4000).selectExpr("id as row", "300 as size")
    rows = pk.pack(items, 1000, shard=250).collect()
    assert len({r.row for r in rows}) == len(rows) == 4000
    fill = {}
    for r in rows:
        fill[r.container_id] = fill.get(r.container_id, 0) + r.size
    assert max(fill.values()) <= 1000 and len(fill) <= 1334 + 1
    assert all(fill[r.container_id] == r.fill for r in rows)
