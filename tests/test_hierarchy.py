import datetime as dt
import random

import pytest

from schemaloom.operators.hierarchy import department_descendants, department_tree, descendants, hierarchy, latest_links

COLS = "department_id string, parent_department_id string, created_at timestamp, path string, size int"


def frame(spark, rows):
    return spark.createDataFrame([(a, b, dt.datetime(2024, 1, t or 1), "x", 1) for a, b, t in rows], COLS)


def brute(links):
    out = {}
    for n in links:
        seen, x = [], n
        while x is not None and x not in seen:
            seen.append(x)
            x = links[x]
        out[n] = seen, x
    res = {}
    for n, (seen, end) in out.items():
        below = sum(n in s for m, (s, _) in out.items() if m != n)
        if end is not None:
            circle = seen[seen.index(end) :]
            res[n] = (min(circle), -1, "", below)
        else:
            res[n] = (seen[-1], len(seen) - 1, "/".join(reversed(seen)), below)
    return res


def answers(df):
    return {r.department_id: (r.root_department_id, r.node_depth, r.full_path, r.n_descendants) for r in df.collect()}


@pytest.mark.parametrize("least_share", [0, 0.25, 2])
def test_trees_and_circles(spark, least_share):
    rng = random.Random(5)
    ids = [f"D{i:02d}" for i in range(30)]
    links = {n: rng.choice([None, *ids[:i]]) if i else None for i, n in enumerate(ids)}
    links |= {"C1": "C2", "C2": "C3", "C3": "C1", "H1": "C2", "H2": "H1", "S": "S"} | {f"K{i}": f"K{i - 1}" if i else None for i in range(6)}
    links |= {f"W{i}": "D00" for i in range(30)}
    df = frame(spark, [(n, p, 1) for n, p in links.items()])
    assert answers(department_tree(df, least_share=least_share)) == brute(links)


def test_untidy_rows(spark):
    rows = [(" d1 ", None, 1), ("D2", "d1 ", 2), ("D2", "D1", 2), ("D2", "D9", 1), ("d3", "  ", 1), ("D4", "unknown", 1), (None, "D1", 1), ("", "D1", 1), ("D5", "D3", 2), ("d5", "D2", 3)]
    df = frame(spark, rows)
    got = answers(department_tree(df))
    assert got == brute({"D1": None, "D2": "D1", "D3": None, "D4": None, "D5": "D2"})
    assert latest_links(df, "department_id", "parent_department_id", "created_at").count() == 5


def test_descendants_and_empty(spark):
    df = frame(spark, [("A", None, 1), ("B", "A", 1), ("C", "B", 1)])
    placed = hierarchy(latest_links(df, "department_id", "parent_department_id", "created_at"))
    assert sorted(map(tuple, descendants(placed).collect())) == [("A", "B", 1), ("A", "C", 2), ("B", "C", 1)]
    assert department_tree(frame(spark, [])).count() == 0


@pytest.mark.parametrize("least_share", [0, 0.25, 2])
def test_descendants_of_circles_and_slashes(spark, least_share):
    links = {"A": "B", "B": "A", "C": "B", "D": "C", "S": "S", "T": "S", "X": None, "X/Y": "X", "Z": "X/Y", "Q": "Z", "C1": "C2", "C2": "C3", "C3": "C1", "H": "C2", "H/2": "H"}
    want = set()
    for n in links:
        x, steps, seen = links[n], 1, {n}
        while x is not None and x not in seen:
            want.add((x, n, steps))
            seen.add(x)
            x, steps = links[x], steps + 1
    df = frame(spark, [(n, p, 1) for n, p in links.items()])
    pairs = [tuple(r) for r in department_descendants(df, least_share=least_share).collect()]
    assert sorted(pairs) == sorted(want)
    assert {("C", "D", 1), ("A", "C", 2), ("B", "A", 1), ("X/Y", "Q", 2)} <= want
    counts = {r.department_id: r.n_descendants for r in department_tree(df, least_share=least_share).collect()}
    assert counts == {n: sum(a == n for a, _, _ in pairs) for n in links}


def test_a_deep_chain_takes_few_rounds(spark, monkeypatch):
    from schemaloom.operators import hierarchy as module

    written = []
    real, both = module.materialize, module.counted
    monkeypatch.setattr(module, "materialize", lambda df, name="step": written.append(name) or real(df, name))
    monkeypatch.setattr(module, "counted", lambda df, name="step": written.append(name) or both(df, name))
    n = 700
    links = {f"N{i:03d}": f"N{i - 1:03d}" if i else None for i in range(n)}
    got = answers(department_tree(frame(spark, [(k, p, 1) for k, p in links.items()])))
    assert got == {f"N{i:03d}": ("N000", i, "/".join(f"N{j:03d}" for j in range(i + 1)), n - 1 - i) for i in range(n)}
    assert len(written) < 40


def test_half_of_all_nodes_below_one_parent(spark):
    links = {"R": None, "A": "R"} | {f"L{i}": "R" for i in range(300)} | {f"M{i}": "A" for i in range(300)}
    got = answers(department_tree(frame(spark, [(k, p, 1) for k, p in links.items()]), least_share=2))
    assert got["R"] == ("R", 0, "R", 601) and got["A"] == ("R", 1, "R/A", 300) and got["M7"] == ("R", 2, "R/A/M7", 0)
