import random

import pytest
import regex
from pyspark.sql import functions as F

from tipline.llm import line_dedup

SCHEMA = "doc_id long, text string, place string, row string"


def within_one(a: list, b: list) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
    return d[-1] <= 1


def brute(rows: list[tuple]) -> list[tuple]:
    seen, out = [], []
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        kept = []
        for line in text.split("\n"):
            apart = regex.sub(r"[\p{Han}\p{Hiragana}\p{Katakana}\u30FC\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}]", r" \g<0> ", line.lower())
            words = [w.decode() for w in apart.encode().split()]
            if not words:
                kept.append(line)
                continue
            if not any(words == s or (min(len(words), len(s)) >= 10 and within_one(words, s)) for s in seen):
                kept.append(line)
            seen.append(words)
        out.append((doc_id, "\n".join(kept), len(text.split("\n")), len(text.split("\n")) - len(kept)))
    return out


def edited_lines(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)]
    bases = [rng.choices(vocabulary, k=rng.choice([4, 5, 9, 10, 11, 14, 30])) for _ in range(14)]
    rows = []
    for d in range(40):
        lines = []
        for _ in range(6):
            line = list(rng.choice(bases))
            for _ in range(rng.choice([0, 1, 1, 2])):
                k = rng.randrange(len(line))
                match rng.randrange(3):
                    case 0:
                        line[k] = rng.choice(vocabulary)
                    case 1:
                        line.insert(k, rng.choice(vocabulary))
                    case _:
                        line.pop(k)
            lines.append(" ".join(line).upper() if rng.random() < 0.2 else "  ".join(line))
        rows.append((d, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = edited_lines(seed)
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(tuple(r) for r in got.select("row.doc_id", "text", "n_lines", "n_dropped").collect()) == brute(rows)


def test_edge_cases(spark):
    long_line = " ".join(f"w{i}" for i in range(20_000))
    rows = [(1, None, "p", "r"), (2, "", "p", "r"), (3, "a b c d e\n\nx", "p", "r"), (3, "a b c d e\n\nx", "p", "r"), (4, "A  b c d e\ny", "p", None), (5, long_line, "p", "r"), (6, long_line.replace("w777 ", ""), "p", "r"), (None, "a b c d e", "p", "r")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, SCHEMA)).select("row.*", F.col("text").alias("kept_text"), "n_dropped").collect()
    assert sorted([(r.doc_id, r.kept_text, r.n_dropped, r.place) for r in got], key=str) == sorted(
        [(1, None, 0, "p"), (2, "", 0, "p"), (3, "a b c d e\n\nx", 0, "p"), (3, "a b c d e\n\nx", 0, "p"), (4, "y", 1, "p"), (5, long_line, 0, "p"), (6, "", 1, "p"), (None, "", 1, "p")], key=str
    )
    assert line_dedup.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


