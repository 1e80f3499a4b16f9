"""Linear learners: penalty chosen by the validation rows; closed forms."""

import math
import random

import pytest

from hydroseries.config import TrainConfig
from hydroseries.operators import learn


def rows(spark, seed, noise):
    r = random.Random(seed)
    out = []
    for i in range(400):
        x = [float(r.randrange(2)), *[r.gauss(0, 1) for _ in range(3)]]
        y = int(r.random() < (0.8 if x[0] else 0.25))
        out.append((*x, y, x[0] * 2 + r.gauss(0, noise), i % 4 == 0))
    return out, spark.createDataFrame(out, "a double, b double, c double, d double, label int, level double, _is_val boolean")


def test_logistic_equals_group_shares(spark):
    data, df = rows(spark, 1, 1.0)
    model = learn.train_classifier(df, ["a"], "label", TrainConfig(max_iter=200, tolerance=1e-12), "linear")
    got = {r["a"]: r["prediction_score"] for r in learn.score(df, model, "classification").collect()}
    for a in (0.0, 1.0):
        part = [x[4] for x in data if x[0] == a and not x[6]]  # fitted on the training rows only
        assert got[a] == pytest.approx(sum(part) / len(part), abs=1e-6)


@pytest.mark.parametrize("kind", ["classification", "regression"])
def test_validation_rows_choose_the_penalty(spark, kind):
    _, df = rows(spark, 2, 3.0)
    names, regs = ["a", "b", "c", "d"], (0.0, 0.1, 100.0)
    train = learn.train_classifier if kind == "classification" else learn.train_regressor
    label = "label" if kind == "classification" else "level"

    def loss(model):
        out = learn.score(df.filter("_is_val"), model, kind).collect()
        if kind == "regression":
            return sum((r["predicted_water_level_m"] - r["level"]) ** 2 for r in out)
        return -sum(math.log(r["prediction_score"] if r["label"] else 1 - r["prediction_score"]) for r in out)
    single = {reg: loss(train(df, names, label, TrainConfig(reg_params=(reg,)), "linear")) for reg in regs}
    best = loss(train(df, names, label, TrainConfig(reg_params=regs), "linear"))
    assert best == pytest.approx(min(single.values())) and min(single.values()) < max(single.values())
