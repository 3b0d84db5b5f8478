import numpy as np

from schemaloom.llm import neighbours as nb

COLS = "vec_id bigint, embedding array<float>, id int, cell int, raw string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2, "z") for i, v in rows], COLS)


def brute(rows, k, d=64):
    ok = [(i, np.asarray(v, np.float32).astype(float)) for i, v in rows if v is not None and len(v) == d and None not in list(v) and np.isfinite(np.asarray(v, float)).all() and np.any(np.asarray(v, np.float32))]
    ids = np.array([i for i, _ in ok])
    x = np.array([v / np.linalg.norm(v) for _, v in ok])
    s = np.round(x @ x.T, 9)
    out = set()
    for a in range(len(ids)):
        order = sorted((-s[a, b], ids[b]) for b in range(len(ids)) if b != a)[:k]
        out |= {(ids[a], j) for _, j in order}
    return out


def clustered(n, rng, d=64):
    centres = rng.normal(size=(12, d))
    return [(int(i) + 1, centres[rng.integers(12)] * rng.uniform(0.5, 4) + rng.normal(size=d) * 0.5) for i in range(n)]


def got(spark, rows, k=5):
    return {(r.id, r.other) for r in nb.nearest(frame(spark, rows), "vec_id", "embedding", k=k).collect()}


def test_small_and_dirty(spark):
    rng = np.random.default_rng(1)
    rows = clustered(30, rng)
    rows += [(100, None), (101, np.zeros(64)), (102, [float("nan")] + [1.0] * 63), (103, [1.0] * 32), (104, [None] + [1.0] * 63), (105, [float("inf")] + [1.0] * 63)]
    rows += [(200 + i, rows[0][1]) for i in range(8)] + [(300 + i, np.asarray(rows[1][1]) * 2.0**i) for i in range(3)]
    assert got(spark, rows) == brute(rows, 5)


def test_few_or_none(spark):
    v = list(np.eye(64)[0])
    assert got(spark, []) == set() and got(spark, [(1, v)]) == set()
    assert got(spark, [(1, v), (2, v), (3, None)]) == {(1, 2), (2, 1)}


def test_recall_with_many_cells_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(nb, "CELL_ROWS", 40)
    monkeypatch.setattr(nb, "BLOCK", 64)
    rng = np.random.default_rng(2)
    rows = clustered(1500, rng)
    hot = rows[7][1]
    rows += [(5000 + i, hot) for i in range(700)]
    want, found = brute(rows, 5), got(spark, rows)
    assert len(found) == len(want)
    assert len(found & want) / len(want) >= 0.9


def test_codes_round_trip_and_decode():
    rng = np.random.default_rng(3)
    for m in (32, 7):
        codes = rng.integers(0, 16, size=(20, m))
        assert (nb.unpack_codes(nb.pack_codes(codes), m) == codes).all()
    words = rng.normal(size=(32, 16, 2))
    codes, centre, q = rng.integers(0, 16, size=(20, 32)), rng.normal(size=64), rng.normal(size=64)
    table = np.einsum("ms,mcs->mc", q.reshape(32, 2), words)
    assert np.allclose(nb.decode(codes, centre, words) @ q, q @ centre + table[np.arange(32), codes].sum(1))


def test_scan_rules_out_most_and_loses_little():
    rng = np.random.default_rng(8)
    x = np.array([v for _, v in clustered(3000, rng)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centre = np.zeros(64)
    words = nb.fit_words(x, x, rng)
    coded = nb.decode(nb.assign_codes(x, x, words), centre, words)
    i, j = nb.candidates(x[:200], x, coded, 5, np.arange(200)[:, None] == np.arange(3000))
    exact = x[:200] @ x.T
    exact[np.arange(200), np.arange(200)] = -4
    want = {(a, b) for a in range(200) for b in np.argsort(-exact[a])[:5]}
    assert len(want & set(zip(i.tolist(), j.tolist(), strict=True))) >= 0.97 * len(want)
    assert len(i) < 0.3 * exact.size


def test_cells_grow_with_the_collection():
    assert nb.cell_count(100, 64) == 1 and nb.cell_count(1_000_000, 64) == 6250 and nb.cell_count(40_000_000, 64) == 250_000
    assert nb.cell_count(10**10, 64) * 64 * 4 == nb.CENTRE_BYTES
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert 350 <= len(nb.fit(x, 400)) <= 450 and len(nb.fit(x[:5], 400)) == 1


def test_recall_row(spark):
    rows = clustered(300, np.random.default_rng(9))
    from pyspark.sql import functions as F

    r = nb.recall(frame(spark, rows), "vec_id", "embedding", F.pmod("id", F.lit(50)) == 0).first()
    assert (r.queries, r.wanted) == (6, 30) and r.found >= 29
    exact = nb.exact_nearest(frame(spark, rows), "vec_id", "embedding", F.lit(True)).collect()
    assert {(x.id, x.other) for x in exact} == brute(rows, 5)


def test_codes_minimise_the_anisotropic_loss():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    words = nb.fit_words(x, x, rng)
    m = 64 // nb.SUB

    def loss(codes):
        e = x - words[np.arange(m), codes].reshape(len(x), 64)
        return (e**2).sum() + (nb.ETA - 1) * ((e * x).sum(1) ** 2).sum()

    near = np.stack([((x.reshape(-1, m, nb.SUB)[:, j, None] - words[j]) ** 2).sum(2).argmin(1) for j in range(m)], 1)
    assert loss(nb.assign_codes(x, x, words)) <= loss(near)
    assert loss(near) < (x**2).sum()


def test_scaled_copies_and_near_duplicates(spark):
    rng = np.random.default_rng(6)
    rows = clustered(400, rng)
    one, two = rng.normal(size=64), rng.normal(size=64)
    ids = rng.permutation(2000) + 1000
    rows += [(int(i), (one * rng.uniform(0.01, 100)).astype(np.float32)) for i in ids[:1000]]
    rows += [(int(i), two + rng.normal(size=64) * 1e-4) for i in ids[1000:]]
    want, found = brute(rows, 5), got(spark, rows)
    assert len(found) == len(want)
    copies = {int(i) for i in ids[:1000]}
    assert {p for p in found if p[0] in copies} == {p for p in want if p[0] in copies}
    near = {int(i) for i in ids[1000:]}
    assert len({p for p in found & want if p[0] in near}) / 5000 >= 0.99
