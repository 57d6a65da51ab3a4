from __future__ import annotations

import math
import random

import pytest

from tallyweave.functions import similarity
from tallyweave.operators import items

ITEM = "case_id int, idx int, box struct<x1:double,y1:double,x2:double,y2:double>, text string, score double"
WORDS = ("Rated", "Voltage", "Net Weight", "Serial No.", "Colour", "Color", "Noise Level", "Refrigerent")


class Counted(tuple):
    reads = 0

    def __getitem__(self, i):
        Counted.reads += 1
        return super().__getitem__(i)


def placed(rng: random.Random, n: int, kind: str) -> list[tuple]:
    out = []
    for i in range(n):
        if kind == "rows":
            x, y = 18.0 * rng.randint(1, 50), rng.randint(0, 999) / 10
            b = (x, y, x + 6 * rng.randint(7, 12), y + 12)
        elif kind == "heights":
            x, y = rng.uniform(0, 300), rng.uniform(0, 100)
            b = (x, y, x + rng.uniform(0, 60), y + math.exp(rng.uniform(-2, 5)))
        else:
            x, y = float(rng.randint(0, 30)), float(rng.randint(0, 6))
            b = (x, y, x + rng.randint(-3, 8), y + rng.randint(-2, 9))
        out.append((i * 7, b))
    return out


def in_line(held: list[tuple]) -> list[tuple]:
    return sorted(held, key=lambda it: (it[1][0], it[1][1] + it[1][3]))


@pytest.mark.parametrize("kind", ["rows", "heights", "tiny"])
def test_runs_looked_up_are_those_of_a_walk(kind):
    rng = random.Random(5)
    for n in (1, 2, 7, 60, 400):
        line = in_line(placed(rng, n, kind))
        for longest in (1, 2, 4, 6):
            assert items._looked_up(line, longest) == items._walked(line, longest)


def test_items_between_are_not_passed_one_by_one():
    n = 2000
    held = [(i, Counted((18.0 * (i % 3), (i * 37 % 1000) / 10, 18.0 * (i % 3) + 60, (i * 37 % 1000) / 10 + 12))) for i in range(n)]
    Counted.reads = 0
    assert len(items.chains(held)) == n
    assert Counted.reads <= 50 * n


def test_a_box_without_an_end_stands_alone():
    held = [(0, (0.0, 0.0, 30.0, 10.0)), (1, (35.0, 0.0, math.nan, 10.0)), (2, (40.0, 0.0, 70.0, 10.0)), (3, (45.0, -math.inf, 75.0, math.inf))]
    assert items.chains(held) == [(0,), (1,), (2,), (3,), (0, 2)]


def test_captions_of_a_dense_case(spark):
    rng = random.Random(9)
    held = {i: (b, rng.choice(WORDS), rng.choice([0.25, 0.5, 0.5, None, math.nan])) for i, b in placed(rng, 700, "rows")}
    want = {}
    for n, run in enumerate([(i,) for i in held] + items._walked(in_line([(i, b) for i, (b, _, _) in held.items()]), 4)):
        raw, sure = " ".join(held[i][1] for i in run), min(s if (s := held[i][2]) and s == s else 0.0 for i in run)
        letters = lambda t: sum(c.isascii() and c.isalnum() for c in t)
        for field in similarity.CAPTION_PATTERNS:
            if found := similarity.find_caption(field, raw):
                rank = (found[1], found[2], letters(found[0]), letters(found[0]) - letters(raw), sure, -n)
                want[field] = max(want.get(field, (rank, found[0], list(run))), (rank, found[0], list(run)))
    rows = spark.createDataFrame([(1, i, b, t, s) for i, (b, t, s) in held.items()], ITEM)
    got = {r["field"]: (r["caption"], r["idxs"]) for r in items.captions(rows, ["case_id"]).collect()}
    assert got == {f: (c, run) for f, (_, c, run) in want.items()} and len(got) >= 5


def test_names_that_are_too_long_or_short_change_no_caption():
    near = {(f, n[:k] + x + n[k:]) for f, names in similarity.CAPTION_NAMES.items() for n in names for k in (0, len(n) // 2, len(n)) for x in ("", "q", "qq", " abc ")}
    for field, raw in near:
        found, key = similarity.find_caption(field, raw), raw.replace(" ", "").lower()
        best = max((similarity.ratio(key, n), -k) for k, n in enumerate(similarity.CAPTION_NAMES[field]))
        name = similarity.CAPTION_NAMES[field][-best[1]]
        if found is None:
            assert len(key) < 3 or best[0] < similarity.LEAST_RATIO or abs(len(key) - len(name)) > max(2, int(len(name) * 0.35))
        else:
            assert found[1] == 1 or found == (raw.strip(), 0, best[0])
