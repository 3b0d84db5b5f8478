from fractions import Fraction
from random import Random

from schemaloom.llm import mixing as mx

DOCS = "doc_id bigint, source string, text string, at int, slot string"
TARGETS = "source string, target_share double, max_repeats int"


def test_a_frame_keeps_every_source_within_a_block():
    for weights in ([15, 15, 20, 12, 10, 10, 10, 5], [1], [1, 99], [3, 3, 3, 1], [7, 5, 1, 1, 1], [0, 4, 1]):
        total = sum(weights)
        order = mx.pfair_order(tuple(weights))
        assert len(order) == total
        done = [0] * len(weights)
        for slot, (source, block) in enumerate(order):
            assert block == done[source]
            done[source] += 1
            for s, w in enumerate(weights):
                assert abs(done[s] - Fraction(w * (slot + 1), total)) < 1


def test_weights_are_exact():
    assert mx.exact_weights([0.15, 0.2, 0.05]) == [Fraction(3, 8), Fraction(1, 2), Fraction(1, 8)]
    assert mx.frame_slots(mx.exact_weights([0.15, 0.2, 0.05])) == 8
    assert mx.exact_weights([0.00001, 0.99999]) == [Fraction(1, 100_000), Fraction(99_999, 100_000)]


def test_frames_follow_shares_that_no_period_holds(spark, monkeypatch):
    monkeypatch.setattr(mx, "FRAME", 50)
    shares = [0.00123, 0.31415926, 0.6, 0.08461074]
    weights = mx.exact_weights(shares)
    monkeypatch.setattr(mx, "frame_slots", lambda w, most=50: 50)
    slots = 50
    before = [mx.blocks_before(weights, k, slots) for k in range(60)]
    assert all(x <= y for one, two in zip(before, before[1:], strict=False) for x, y in zip(one, two, strict=True))
    done, slot = [0] * 4, 0
    for k in range(59):
        assert sum(before[k]) == slot and done == before[k]
        for s, i in mx.pfair_order(tuple(b - a for a, b in zip(before[k], before[k + 1], strict=True))):
            assert before[k][s] + i == done[s]
            done[s] += 1
            slot += 1
            assert all(abs(d - w * slot) <= Fraction(3, 2) + w * 2 for d, w in zip(done, weights, strict=True))
    rows = mx.schedule(spark, list("abcd"), weights, 7).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows))) and len({(r.source, r.block) for r in rows}) == len(rows)


def frames(spark, seed=1):
    rng = Random(seed)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", "none", None]), rng.choice([None, "", "x " * rng.randrange(1, 60)]), 1, "z") for i in range(600)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.1, 2), ("gone", 0.1, 2), ("zero", 0.0, 2), (None, 0.1, 1)], TARGETS)


def test_draws_reach_their_shares(spark, monkeypatch):
    monkeypatch.setattr(mx, "BUCKET", 20)
    docs, targets = frames(spark)
    rows = mx.mix(docs, targets, block_tokens=50).collect()
    cap = {"a": 1, "b": 3, "c": 2}
    assert {r.source for r in rows} == set(cap)
    assert all(r.repeat_no < cap[r.source] and r.n_tokens > 0 for r in rows)
    assert len({(r.doc_id, r.repeat_no) for r in rows}) == len(rows)
    for s in cap:
        own = sorted((r.place, r.n_tokens) for r in rows if r.source == s)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False))
        slots = [r.slot for r in sorted((r for r in rows if r.source == s), key=lambda r: r.place)]
        assert slots == sorted(slots)
    total = sum(r.n_tokens for r in rows)
    longest = max(r.n_tokens for r in rows)
    for s, w in (("a", 5 / 9), ("b", 3 / 9), ("c", 1 / 9)):
        assert abs(sum(r.n_tokens for r in rows if r.source == s) - w * total) <= 3 * longest
    # at every slot each source is within a block, and what a document hangs over, of its share
    for slot in range(0, max(r.slot for r in rows), 5):
        for s, w in (("a", 5 / 9), ("b", 3 / 9), ("c", 1 / 9)):
            assert abs(sum(r.n_tokens for r in rows if r.source == s and r.slot <= slot) - w * 50 * (slot + 1)) <= 2 * (50 + longest)


def test_report(spark):
    docs, targets = frames(spark)
    rows = {r.source: r for r in mx.shares(docs, targets, block_tokens=50).collect()}
    assert set(rows) == {"a", "b", "c", "gone", "zero"}
    assert rows["gone"].actual_share == 0 == rows["gone"].draws
    assert abs(sum(r.actual_share for r in rows.values()) - 1) < 1e-9 and abs(rows["a"].actual_share - 5 / 9) < 0.02


def test_nothing_usable(spark):
    docs, targets = frames(spark)
    assert mx.mix(docs.limit(0), targets).count() == 0
    assert mx.mix(docs, targets.limit(0)).count() == 0
    assert mx.shares(docs.limit(0), targets).filter("actual_share > 0").count() == 0
