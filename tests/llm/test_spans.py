from random import Random

import numpy as np
import pytest

from schemaloom.llm import spans as sp

COLS = "doc_id bigint, text string, doc string, anchor int, units string"
L = 160


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in texts], COLS)


def brute(texts, length=L):
    L = length  # noqa: N806
    seen, several = {}, set()
    for i, t in texts:
        for j in range(len(t or "") - L + 1):
            w = t[j : j + L]
            if seen.setdefault(w, i) != i:
                several.add(w)
    out = {}
    for i, t in texts:
        hit = np.zeros(len(t or ""), bool)
        for j in range(len(t or "") - L + 1):
            if t[j : j + L] in several:
                hit[j : j + L] = True
        if hit.any():
            out[i] = int(hit.sum())
    return out


def corpus(seed=1, n=60):
    rng = Random(seed)
    word = lambda: rng.choice(["é", "ab", "数据", "xyz", "q", "🙂", "table", "row"]) + str(rng.randrange(50))
    text = lambda k: " ".join(word() for _ in range(k))
    shared = [text(rng.randrange(20, 120)) for _ in range(8)]
    out = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            parts.append(text(rng.randrange(1, 60)))
            if rng.random() < 0.6:
                s = rng.choice(shared)
                a = rng.randrange(0, 30)
                parts.append(s[a : a + rng.choice([150, 159, 160, 161, 300, 900])])
        out.append((i + 1, "".join(parts)))
    return out


DIRTY = [(100, None), (101, ""), (102, "a" * 500), (103, "a" * 400), (104, "b" * 159), (105, "b" * 159), (106, "ab" * 300), (107, "xy" * 300 + "xy" * 300)]


@pytest.mark.parametrize("hot", [20_000, 1])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(sp, "HOT", hot)
    texts = corpus() + DIRTY
    texts += [(200 + i, texts[3][1]) for i in range(20)]
    got = {r.doc_id: r.shared_chars for r in sp.shared_characters(frame(spark, texts)).collect()}
    assert got == brute(texts)


@pytest.mark.parametrize("length", [8, 50, 400, 700])
def test_other_lengths(spark, length):
    texts = corpus(3, 30) + DIRTY + [(300, "x" * 10 + "p" * 350 + "q" * 350 + "y"), (301, "zz" + "p" * 350 + "q" * 350)]
    texts = [(i, t[:1500] if t else t) for i, t in texts]
    got = {r.doc_id: r.shared_chars for r in sp.shared_characters(frame(spark, texts), length=length).collect()}
    assert got == brute(texts, length) and got[301] == 700


def test_lengths_out_of_range(spark):
    for length in (7, 60_001):
        with pytest.raises(ValueError):
            sp.shared_characters(frame(spark, []), length=length)


def test_equal_digests_of_different_texts_are_told_apart(spark, monkeypatch):
    import pandas as pd

    real = sp._digest
    monkeypatch.setattr(sp, "_digest", lambda *a: real(*a) % 3)
    rng = Random(9)
    gram = "".join(rng.choice("abc") for _ in range(64))
    texts = ["".join(rng.choice("xyz") for _ in range(60)) + gram + "".join(rng.choice("xyz") for _ in range(60)) for _ in range(12)]
    texts += [texts[0][:140] + "?" * 44, "!" * 30 + texts[1][30:]]
    rows = pd.DataFrame({"anchor": 5, "seg": range(len(texts)), "low": range(len(texts)), "high": range(len(texts)), "n": 184 - 100 + 1, "off": 60, "text": texts})
    found = sp._shared_windows(rows, 100)
    seen = {}
    for i, t in enumerate(texts):
        for j in range(85):
            seen.setdefault((j, t[j : j + 100]), set()).add(i)
    want = {(i, j) for (j, _), who in seen.items() if len(who) > 1 for i in who}
    assert {(a, b) for a, b in zip(found["seg"], found["j"], strict=True)} == want and want

    kinds = spark.createDataFrame([(1, 7, 1, 0, "a", 1, 2), (1, 7, 1, 0, "b", 3, 3), (2, 8, 1, 0, "c", 1, 4)], "anchor bigint, seg bigint, n int, off int, text string, low bigint, high bigint")
    found = spark.createDataFrame([(1, 7, d, t) for d, t in ((1, "a"), (2, "a"), (3, "b"))] + [(2, 8, 1, "c"), (2, 8, 4, "c")], "anchor bigint, seg bigint, doc bigint, text string")
    found, kinds = sp._told_apart(found, kinds)
    assert kinds.select("seg").distinct().count() == 3
    assert sorted((r.doc, r.text) for r in found.join(kinds.select("anchor", "seg"), ["anchor", "seg"]).collect()) == [(1, "a"), (1, "c"), (2, "a"), (3, "b"), (4, "c")]


def test_long_texts_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(sp, "STRETCH", 700)
    texts = corpus(2, 12)
    whole = "".join(t for _, t in texts)
    texts.append((50, whole[::-1] + whole + whole[:300]))
    want = brute(texts)
    pieces = [x for batch in sp.units([t for _, t in texts], L) for x in zip(*batch, strict=True)]
    covered = {}
    for k, start, n, _, _ in pieces:
        covered.setdefault(k, []).extend(range(start, start + n))
    for k, (_, t) in enumerate(texts):
        assert sorted(covered.get(k, [])) == list(range(max(0, len(t) - L + 1)))
    assert want[50] == {r.doc_id: r.shared_chars for r in sp.shared_characters(frame(spark, texts)).collect()}.get(50, want[50])


def test_empty(spark):
    assert sp.shared_characters(frame(spark, [])).count() == 0
    assert sp.shared_characters(frame(spark, [(1, "x" * 1000)])).count() == 0


def test_repeated_lines(spark):
    line = "This line is long enough to be counted as a unit."
    texts = [(1, f"{line}\nshort\n{line.upper()}"), (2, f"intro\n  {line}  "), (3, None), (4, "")]
    rows = sorted(map(tuple, sp.repeated_lines(frame(spark, texts)).collect()))
    assert rows == [(1, 2, len(line) + 7, 2 * len(line) + 7, 1, 0), (2, 1, 6, 6 + len(line) + 4, 1, 0)]
    assert texts[0][1][rows[0][2] : rows[0][3]] == line.upper()
