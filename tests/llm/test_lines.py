import random

import pytest

from tests.llm.fixtures import AWKWARD, long_text, table
from weirgate.llm import lines


def brute(rows, least):
    texts = [(k, (t or "").split("\n")) for k, t, *_ in rows]
    first = {}
    for k, ls in texts:
        for i in range(len(ls) - least + 1) if k is not None else ():
            run = tuple(ls[i:i + least])
            first[run] = min(first.get(run, (k, i)), (k, i))
    out = []
    for k, ls in texts:
        gone = set()
        for i in range(len(ls) - least + 1) if k is not None else ():
            if first[tuple(ls[i:i + least])] < (k, i):
                gone |= set(range(i, i + least))
        runs = sum(i - 1 not in gone for i in gone)
        out.append((k, len(ls), len(gone), runs, "\n".join(x for i, x in enumerate(ls) if i not in gone)))
    return sorted(out, key=str)


def rows():
    rng = random.Random(2)
    blocks = [[f"block {b} line {i}" for i in range(n)] for b, n in enumerate((2, 3, 4, 9, 30))]
    made = []
    for d in range(60):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            b = rng.choice(blocks)
            low = rng.randrange(len(b))
            parts += rng.choice([[f"own {d} {rng.random()}"], b[low:low + rng.randrange(2, 12)], ["", "", ""], ["same"] * 5])
        made.append((rng.randrange(1000), "\n".join(parts)))
    return made + [made[0], (made[1][0], made[2][1])] + AWKWARD


@pytest.mark.parametrize("least", [1, 2, 3, 5])
def test_matches_brute_force(spark, least):
    made = rows()
    got = lines.remove_line_runs(table(spark, made, clash=True).repartition(3), least).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(made, least)


def test_long_and_empty(spark):
    text = long_text().replace(" w7 ", "\n")
    made = [(1, text), (2, text[:900_000])]
    got = lines.remove_line_runs(table(spark, made)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(made, 3)
    assert lines.remove_line_runs(table(spark, [])).collect() == []


def brute_content(rows, least, floor):
    texts = [(k, (t or "").split("\n")) for k, t, *_ in rows]

    def runs(ls):
        for n in range(1, least + 1):
            for i in range(len(ls) - n + 1):
                if n == least or len("".join("".join(ls[i:i + n]).split()).encode()) >= floor:
                    yield i, tuple(ls[i:i + n])

    first = {}
    for k, ls in texts:
        for i, run in runs(ls) if k is not None else ():
            first[run] = min(first.get(run, (k, i)), (k, i))
    out = []
    for k, ls in texts:
        gone = set()
        for i, run in runs(ls) if k is not None else ():
            if first[run] < (k, i):
                gone |= set(range(i, i + len(run)))
        out.append((k, len(ls), len(gone), sum(i - 1 not in gone for i in gone),
                    "\n".join(x for i, x in enumerate(ls) if i not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("least, floor", [(3, 16), (3, 8), (5, 30), (1, 16)])
def test_content_floor_matches_brute_force(spark, least, floor):
    made = rows()
    got = lines.remove_line_runs(table(spark, made, clash=True).repartition(3), least, floor=floor).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_content(made, least, floor)


def test_one_repeated_line_goes_and_trivial_ones_stay(spark):
    line = "a whole paragraph that stands on one line of several documents"
    made = [(i, f"own {i} words\n{line}\nend {i} words\n}}\n") for i in range(5)]
    plain, got = ({r.doc_id: r.kept for r in lines.remove_line_runs(table(spark, made), **floor).collect()}
                  for floor in ({}, {"floor": lines.FLOOR}))
    assert all(line in kept for kept in plain.values())
    assert got == {i: f"own {i} words\n" + (f"{line}\n" if i == 0 else "") + f"end {i} words\n}}\n" for i in range(5)}
