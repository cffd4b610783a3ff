"""Batches by token budget."""

import random

import pytest
from pyspark.sql import functions as F

from callflow.operators import rules


def test_no_batch_is_above_its_budget():
    rng = random.Random(3)
    for _ in range(200):
        lengths = [rng.choice([0, 1, rng.randint(0, 40)]) for _ in range(rng.randint(0, 60))]
        batches = rules.token_batches(lengths, 40)
        assert sorted(i for b in batches for i in b) == list(range(len(lengths)))
        assert all(max(lengths[i] for i in b) * len(b) <= 40 for b in batches)
        if lengths:  # no two neighbours in length could have shared a batch
            assert all(max(1, lengths[a[0]]) * (len(a) + 1) > 40 for a in batches[:-1])


def test_answers_do_not_depend_on_the_order(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("w" * rng.randint(1, 4) for _ in range(rng.randint(0, 300)))) for i in range(300)] + [(900, None), (901, "boom"), (902, "x " * 9000)]

    def scorer(prompts):
        longest = max(len(rules.word_ends(p)) for p in prompts)
        assert longest * len(prompts) <= 8192
        if any("boom" in p for p in prompts):
            raise ValueError("bad prompt")
        return [str(len(p)) for p in prompts]

    df = spark.createDataFrame(rows, "id long, prompt string")
    got = [{r.id: tuple(r) for r in rules.score_by_tokens(d, scorer, budget=8192).collect()} for d in (df, df.orderBy(F.desc("id")).coalesce(1), df.repartition(7))]
    assert got[0] == got[1] == got[2]
    assert got[0][901][2:4] == (None, "bad prompt") and got[0][900][2:] == ("0", None, 0, False)
    assert got[0][902][2:] == (str(2 * 7292 - 1), None, 7292, True)  # 8192 - 800 - 100 tokens are left
    assert sum(r[3] is not None for r in got[0].values()) == 1


def test_a_budget_below_the_longest_prompt_is_refused(spark):
    with pytest.raises(ValueError):
        rules.score_by_tokens(spark.range(1).selectExpr("'x' AS prompt"), rules.stub_scorer, budget=100)
