"""Joint training: gradients, exact sums, checkpoints, resumption, storage."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textlens.operators import metrics as M
from textlens.operators import models as MD
from textlens.operators import training as TR
from textlens.session import scratch_dir

WEIGHTS = {"a": 2.0, "b": 0.3}
LABELS = {"a": "ya", "b": "yb"}


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = np.random.default_rng(0)
    words = np.array([f"w{i}" for i in range(40)] + ["Straße", "naïve", "x_1"])
    rows = []
    for i in range(400):
        t = rnd.choice(words, rnd.integers(0, 12))
        text = None if i % 97 == 0 else " ".join(t)
        good = sum(w in ("w1", "w2", "Straße") for w in t)
        rows.append((i, text, int(good > 0), None if i % 11 == 0 else int("w7" in t), float(len(t)), i % 5 == 0))
    return spark.createDataFrame(rows, "doc_id long, text string, ya int, yb int, n double, held boolean").cache()


def split(corpus):
    return corpus.where(~F.col("held")), corpus.where("held")


def fit(corpus, folder, steps=12, eval_every=4, **options):
    train, test = split(corpus)
    return TR.train_joint(train, test, LABELS, folder, weights=WEIGHTS, extra_cols=["n"], n_words=64, hidden=3, steps=steps,
                          eval_every=eval_every, **options)


def test_gradient_equals_numeric_differences(spark, corpus):
    train, _ = split(corpus)
    net = TR.TextNet.start(TR.Features.fit(train, "text", ["n"], 64), list(LABELS), 3, 1)
    rows = TR._rows(net.features, train, "text", list(LABELS.values()), "t-rows")
    objective = TR._Objective(net, rows, WEIGHTS, 0.01)
    theta = net.theta + np.random.default_rng(2).normal(0, 0.1, len(net.theta))
    _, grad = objective(theta)
    for i in np.random.default_rng(3).choice(len(theta), 12, replace=False).tolist() + [len(theta) - 1, len(theta) - 3]:
        step = np.zeros_like(theta)
        step[i] = 1e-3
        numeric = (objective(theta + step)[0] - objective(theta - step)[0]) / 2e-3
        assert abs(numeric - grad[i]) < 1e-5


def test_loss_is_that_of_the_metric(spark, corpus):
    run = fit(corpus, scratch_dir(spark, "t-loss"), 8)
    pred = run.best().predict(split(corpus)[1], "doc_id", label_cols=LABELS)
    want = M.multitask_loss(pred.where(F.col("y").isNotNull()), WEIGHTS).where("task = 'total'").first()["loss"]
    got = min(r.eval_loss for r in run.log().collect())
    assert abs(want - got) < 1e-7
    assert sorted(pred.groupBy("task").count().collect()) == [("a", 80), ("b", 80)]


def test_loss_falls_and_beats_chance(spark, corpus):
    run = fit(corpus, scratch_dir(spark, "t-fall"), 24, 6)
    log = sorted((r.step, r.eval_loss) for r in run.log().collect())
    assert log[-1][1] < 0.5 * 2.3 * np.log(2) and log[-1][1] <= log[0][1]
    pred = run.best().predict(split(corpus)[1], "doc_id", label_cols=LABELS)
    assert pred.where("task = 'a'").agg(F.avg((F.col("y") == F.col("yhat")).cast("int"))).first()[0] > 0.9


class Lost(Exception):
    pass


@pytest.mark.parametrize("at", [4, 8])
def test_a_lost_run_goes_on_to_the_same_model(spark, corpus, at):
    whole = fit(corpus, scratch_dir(spark, "t-whole"))
    folder = scratch_dir(spark, "t-lost")

    def lost(step):
        if step == at:
            raise Lost

    with pytest.raises(Lost):
        fit(corpus, folder, after_checkpoint=lost)
    resumed = fit(corpus, folder)
    assert np.array_equal(whole.best().theta, resumed.best().theta)
    assert [tuple(r) for r in whole.log().orderBy("step").collect()] == [tuple(r) for r in resumed.log().orderBy("step").collect()]
    again = fit(corpus, folder)  # a run that has ended does nothing
    assert np.array_equal(again.best().theta, whole.best().theta)


def test_a_checkpoint_lost_in_the_middle_of_its_writing(spark, corpus):
    whole = fit(corpus, scratch_dir(spark, "t-w2"))
    folder = scratch_dir(spark, "t-torn")
    run = fit(corpus, folder, 8)
    last = max(run.log().collect(), key=lambda r: r.step)
    other = min(run.log().collect(), key=lambda r: r.step)
    assert {last.place, other.place} == {0, 1}
    spark.createDataFrame([], "meta STRING, arrays BINARY").write.mode("overwrite").parquet(run.place(last.place))
    assert run.last()[0]["step"] == other.step
    assert np.array_equal(fit(corpus, folder).best().theta, whole.best().theta)


def test_two_checkpoints_are_kept_and_the_best_stays(spark):
    run = TR.Run(spark, scratch_dir(spark, "t-keep"))
    f = TR.Features(2, (), np.ones(2), np.zeros(0), np.zeros(0) + 1)
    for step, loss in enumerate([0.5, 0.2, 0.4, 0.3, 0.2, 0.1, 0.7], 1):
        net = TR.TextNet(f, ("a",), 1, np.full(5, float(step)))
        run.keep(step, loss, *net.state())
        log = run.log().where(F.col("step") <= step).collect()
        best = min(log, key=lambda r: (r.eval_loss, r.step))
        assert run.best().theta[0] == best.step and run.last()[0]["step"] == step
    assert run.best().theta[0] == 6


def test_saved_and_reloaded_models_predict_alike(spark, corpus):
    train, test = split(corpus)
    net = fit(corpus, scratch_dir(spark, "t-s"), 4).best()
    path = scratch_dir(spark, "t-net")
    net.save(spark, path)
    back = TR.TextNet.load(spark, path)
    one, two = (sorted(map(tuple, n.predict(test, "doc_id").collect()), key=repr) for n in (net, back))
    assert one == two and len(one) == 160
    data = train.where("text is not null").select("doc_id", "text", "ya", "n")
    model = MD.train_classifier(data, label_col="ya", extra_cols=["n"], max_iter=5, num_features=64)
    path = scratch_dir(spark, "t-pipe")
    MD.save_model(model, path)
    MD.save_model(model, path)
    a, b = (sorted(map(tuple, MD.predict(m, data, ["doc_id"]).collect())) for m in (model, MD.load_model(path)))
    assert a == b and len(a) > 300


def test_sums_are_exact_in_a_tree(spark):
    rows = spark.range(0, 1000, 1, 70).select(F.col("id").cast("double").alias("v"))
    got = TR.task_sums(rows, lambda b: np.array([b.column("v").to_numpy().sum(), b.num_rows]), 2)
    assert got.tolist() == [999 * 500, 1000]
    assert TR.task_sums(rows.where("v < 0"), lambda b: np.ones(1), 1).tolist() == [0]


def test_rows_without_words_or_labels(spark):
    f = TR.Features(4, (), np.ones(4), np.zeros(0), np.zeros(0))
    net = TR.TextNet.start(f, ["a"], 2, 0)
    batch = pa.RecordBatch.from_pydict({"words": pa.array([[], [1, 1, 3]], pa.list_(pa.int32())), "extra": pa.array([[], []], pa.list_(pa.float64()))})
    loss, grad = net.loss_and_gradient(batch, np.array([[np.nan], [np.nan]]), np.ones(1))
    assert loss == 0 and not grad.any() and np.isfinite(net.probabilities(batch)).all()


def test_separate_heads_predict_in_one_pass(spark, corpus):
    train, test = (d.where("text is not null and yb is not null") for d in split(corpus))
    feats, heads = MD.train_multitask(train, LABELS, extra_cols=["n"], max_iter=5, num_features=64)
    out = MD.predict_multitask(feats, heads, test, LABELS, "doc_id")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert out.columns == ["doc_id", "task", "y", "p", "yhat"] and out.count() == 2 * test.count() and "Union" not in plan
