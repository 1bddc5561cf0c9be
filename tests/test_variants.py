import random

import pytest

from siltstone.operators import variants


@pytest.fixture(scope="module")
def case(spark):
    r = random.Random(2)
    ranking = [(q, k, q * 100 + k, r.choice(["a", "b", "c", "d", None]), r.randint(100, 5000)) for q in range(30) for k in range(1, r.randint(5, 50))]
    gold = [(q, f) for q in range(32) for f in r.sample("abcdz", r.randint(0, 3))] + [(3, None)]
    return ranking, gold, spark.createDataFrame(ranking, "question_id long, rank int, chunk_id long, file string, chars long"), spark.createDataFrame(gold, "question_id long, file string")


def plain(ranking, gold):
    out = {}
    for q in {q for q, f in gold if f}:
        wanted = {f for x, f in gold if x == q and f}
        for v in variants.GATE:
            used, files, blocks, held = 0, set(), 0, {}
            for _, k, c, f, n in sorted(x for x in ranking if x[0] == q and x[1] <= v.depth):
                key = f or c
                held[key] = held.get(key, 0) + 1
                if v.per_file and held[key] > v.per_file:
                    continue
                if used + n <= v.budget:
                    used, blocks = used + n, blocks + 1
                    files.add(f)
            out[q, v.name] = (len(wanted), len(wanted & files), blocks, used)
    return out


def test_coverage_equals_a_plain_fold(spark, case):
    ranking, gold, r, g = case
    units = variants.coverage(r, g).collect()
    assert {(u["question_id"], u["variant"]): (u["gold"], u["found"], u["blocks"], u["total_chars"]) for u in units} == plain(ranking, gold)
    assert all(u["coverage"] == u["found"] / u["gold"] for u in units)
    s = {x["variant"]: x for x in variants.summary(variants.coverage(r, g)).collect()}
    assert len(s) == 8 and s["wide"]["mean_coverage"] >= s["control"]["mean_coverage"]


def test_differences_are_paired(spark, case):
    _, _, r, g = case
    units = variants.coverage(r, g)
    got = {x["variant"]: x for x in variants.differences(units, "control", resamples=500).collect()}
    assert set(got) == {v.name for v in variants.GATE[1:]} and all(x["ci_low"] <= x["difference"] <= x["ci_high"] for x in got.values())
    # A variant like the control differs by nothing in every resample.
    twins = (variants.GATE[0], variants.Variant("twin", 10, 0, 6000))
    same = variants.differences(variants.coverage(r, g, twins), "control", twins, 200).first()
    assert (same["difference"], same["ci_low"], same["ci_high"], same["better"]) == (0, 0, 0, False)
