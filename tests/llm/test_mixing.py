import math
import random

import brute

from quillspark.llm import mixing


def targets(sizes):
    """Reshare the excess until no source is above three times its size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in capped]
        if not rest:
            return {s: float(v) for s, v in capped.items()}
        level = (total - sum(capped.values())) / sum(weight[s] for s in rest)
        over = [s for s in rest if level * weight[s] > 3 * sizes[s]]
        if not over:
            return capped | {s: level * weight[s] for s in rest}
        capped |= {s: 3 * sizes[s] for s in over}


def make(seed):
    rnd = random.Random(seed)
    names = ["a", "b", "é", "B", None, "", "zz"]
    return [(i, rnd.choice(names[: rnd.choice([3, 7])]), None if rnd.random() < 0.05 else "w " * int(rnd.paretovariate(0.8)) if rnd.random() < 0.9 else " \n") for i in range(300)] + [(5, "a", "x y z"), (5, "a", "x y z"), (None, None, "n n"), (901, "tiny", "one")]


def run(spark, rows, parts=4):
    return mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(parts)).collect()


def test_targets_budgets_and_epochs(spark):
    for seed in (1, 2):
        rows = make(seed)
        got = run(spark, rows)
        sizes, taken = {}, {}
        for _, s, t in rows:
            sizes[s] = sizes.get(s, 0) + len(brute.WORD.findall(t or ""))
        want = targets(sizes)
        assert len(got) == len(rows)
        for r in got:
            assert math.isclose(r["target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-9) and r["source_size"] == sizes[r["source"]]
            assert 0 <= r["taken"] <= 3 * r["size"]
            taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert all(abs(taken[s] - want[s]) <= 0.5 for s in want)


def test_reruns_agree_whatever_the_partitions(spark):
    rows = make(3)
    one, two = (sorted(map(str, run(spark, rows, p))) for p in (1, 7))
    assert one == two


def test_empty_and_wordless(spark):
    assert run(spark, [], 1) == []
    assert [(r["size"], r["target"], r["taken"]) for r in run(spark, [(1, "a", None), (2, "b", " ")], 1)] == [(0, 0.0, 0)] * 2
