import random

import pytest

from tipline.operators import joins as J


def distance(a: str, b: str) -> int:
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return d[-1]


def brute(left: list, right: list, cutoff: float) -> dict:
    out = {}
    for x in left:
        near = [(-(1 - distance(x, y) / max(len(x), len(y), 1)), y) for y in right] if x is not None else []
        best = min((p for p in near if -p[0] >= cutoff), default=None)
        out[x] = best and (best[1], round(-best[0], 9))
    return out


@pytest.mark.parametrize("cutoff", [1.0, 0.92, 0.9, 0.75, 0.5])
def test_edits_at_all_places_against_brute_force(spark, cutoff):
    rng = random.Random(5)
    right = ["".join(rng.choices("abcdé ", k=rng.choice([1, 3, 8, 10, 13, 20, 27]))) for _ in range(40)] + [""]
    left = {None, "", *right[:3]}
    for name in right[:14]:
        for k in range(len(name) + 1):
            left |= {name[:k] + "x" + name[k:], name[:k] + "x" + name[k + 1 :], name[:k] + name[k + 1 :]}
    for _ in range(150):
        name = list(rng.choice(right) or "ab")
        for _ in range(rng.choice([1, 2, 3])):
            k = rng.randrange(len(name) + 1)
            name[k : k + rng.choice([0, 1])] = rng.choice(["", "y", "z"])
        left.add("".join(name))
    got = J.closest_names(spark.createDataFrame([(x,) for x in left], "n string"), spark.createDataFrame([(x,) for x in [*right, None]], "n string"), "n", cutoff).collect()
    assert len(got) == len(left)
    assert {r.left_name: r.right_name if r.right_name is None else (r.right_name, round(r.similarity, 9)) for r in got} == brute(list(left), right, cutoff)
