import random

import pytest

from alertloom.operators.containment import contained
from helpers import plan_text


@pytest.mark.parametrize("size, step", [(12, 8), (5, 1), (3, 50)])
def test_contained_equals_the_nested_loop(spark, size, step):
    rng = random.Random(size)
    made = lambda n: "".join(rng.choice("abcé \n😀") for _ in range(n))
    texts = [(k, made(rng.choice([0, 1, 8, 60, 400]))) for k in range(60)] + [(60, None), (None, "abc" * 9), (61, "hot passage here"), (62, "a hot passage here."), (62, "a hot passage here.")]
    cut = lambda t: t[(a := rng.randrange(len(t))) : a + rng.choice([1, 2, 4, 11, 12, 13, 40])]
    needles = [(k, cut(rng.choice([t for _, t in texts[:60] if t]))) for k in range(50)] + [(50, ""), (51, None), (None, "a"), (52, "not in any of them"), (53, "hot passage here"), (54, "hot passage here")]
    got = contained(spark.createDataFrame(needles, "needle_id long, needle string"), spark.createDataFrame(texts, "text_id long, text string"), size=size, step=step)
    assert "NestedLoop" not in plan_text(got) and "Cartesian" not in plan_text(got)
    want = {(n, t) for n, needle in needles for t, text in texts if needle and text and n is not None and t is not None and needle in text}
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_nothing_is_contained_in_nothing(spark):
    none_n, none_t = spark.createDataFrame([], "needle_id long, needle string"), spark.createDataFrame([], "text_id long, text string")
    assert contained(none_n, none_t).count() == 0
    assert contained(spark.createDataFrame([(1, "a")], none_n.schema), none_t).count() == 0
    assert contained(none_n, spark.createDataFrame([(1, "a")], none_t.schema)).count() == 0
