"""Models fitted by several tasks together, beside the fit of one."""

import datetime as dt
import pickle

import numpy as np

from pyspark.sql import functions as F

from newsloom.functions import tape
from newsloom.operators import bootstrap, features, lambdamart, list_features, neural, together
from newsloom.operators.history import recent_history


def test_ranker_uses_every_row_in_several_tasks(spark, monkeypatch):
    """Four tasks grow the trees that one grows; the last impressions count as the first do."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        x = rng.integers(0, 40, size=5)
        rows += [(f"i{i}", k, int(x[k] == x.max()), float(x[k]), float(rng.integers(0, 9))) for k in range(5)]
    df = spark.createDataFrame(rows, "impression_id string, pos int, label int, signal double, noise double")
    monkeypatch.setattr(lambdamart, "PER_TASK", 100)
    many = lambdamart.train(df, ["signal", "noise"], trees=5, leaves=7)
    monkeypatch.setattr(lambdamart, "PER_TASK", 10**9)
    one = lambdamart.train(df, ["signal", "noise"], trees=5, leaves=7)
    assert [t.feature for t in many.trees] == [t.feature for t in one.trees]
    assert np.allclose([v for t in many.trees for v in t.value], [v for t in one.trees for v in t.value])
    half = lambdamart.train(df, ["signal", "noise"], 700, trees=5, leaves=7)
    assert [t.value for t in half.trees] != [t.value for t in one.trees]


def test_the_fit_has_no_row_limit(spark, monkeypatch):
    seen = []
    real = lambdamart.fit_together
    monkeypatch.setattr(lambdamart, "fit_together", lambda rows, key, n, *a: seen.append((n, rows.count())) or real(rows, key, n, *a))
    df = spark.range(600_000).selectExpr("cast(id div 4 as string) as impression_id", "cast(id % 4 = 0 as int) as label", "cast(id % 7 as double) as x")
    lambdamart.train(df, ["x"], trees=1, leaves=2)
    assert seen == [(600_000, 600_000)]


def test_an_interval_takes_any_number_of_values(monkeypatch):
    values = np.arange(300.0)
    whole = bootstrap.ci(values, 20)
    monkeypatch.setattr(bootstrap, "MAX_VALUES", 100)
    assert np.allclose(bootstrap.ci(values, 20), whole)


def _clicks(n):
    rng = np.random.default_rng(8)
    vec = {f"A{i}": [float(y) for y in rng.normal(size=6) + (2 if i % 2 else -2)] for i in range(20)}
    rows = []
    for i in range(n):
        side = int(rng.integers(2))
        hist = [f"A{2 * rng.integers(10) + side}" for _ in range(rng.integers(1, 4))]
        rows.append((f"i{i}", hist, [f"A{2 * rng.integers(10) + side}", *(f"A{2 * rng.integers(10) + 1 - side}" for _ in range(3)), "missing"], [1, 0, 0, 0, 0]))
    return vec, rows


def _frames(spark, n):
    vec, rows = _clicks(n)
    return spark.createDataFrame(list(vec.items()), "article_id string, vec array<double>"), spark.createDataFrame(rows, "impression_id string, h array<string>, c array<string>, l array<int>")


def test_neural_weights_do_not_depend_on_the_tasks(spark, monkeypatch):
    vectors, shown = _frames(spark, 400)
    got = []
    for per_task in (100, 10**9):
        monkeypatch.setattr(neural, "PER_TASK", per_task)
        got.append(neural.fit(shown, vectors, 6, size=8, heads=2, epochs=1, rate=1e-2))
    assert all(np.allclose(a, b, atol=1e-3) for a, b in zip(got[0].arrays(), got[1].arrays(), strict=True))
    _, rows = _clicks(400)
    auc = [np.mean([r["s"][0] > x for x in r["s"][1:4]]) for r in neural.score_lists(shown, vectors, got[0]).collect()]
    assert len(auc) == len(rows) and np.mean(auc) > 0.9


def test_neural_fit_takes_every_impression(spark, monkeypatch):
    """More than the 20,000 that were taken once; the held-out tenth and the rest are all of them."""
    vectors, few = _frames(spark, 300)
    shown = few.crossJoin(spark.range(100).select(F.col("id").alias("k"))).withColumn("impression_id", F.concat_ws("-", "impression_id", "k")).drop("k")
    monkeypatch.setattr(neural, "PER_TASK", 10**9)
    monkeypatch.setattr(neural, "learn", lambda x, held, **how: ((len(x.key), len(held.key), len(set(x.key) | set(held.key))), None))
    assert neural.fit(shown, vectors, 6) == (30_000, 0, 30_000)
    rest, held, both = neural.fit(shown, vectors, 6, 10)
    assert rest + held == both == 30_000 and 2_500 < held < 3_500


def test_list_features_equal_the_joined_ones(spark, tmp_path):
    """The same rows as the joins over single candidates give, without any of them shuffled."""
    t0 = dt.datetime(2024, 1, 1)
    at = lambda h: t0 + dt.timedelta(hours=h)
    articles = spark.createDataFrame([("a", "x", at(0)), ("b", "x", None), ("c", None, at(2)), ("d", "y", at(30))], "article_id string, category string, published_time timestamp_ntz")
    imps = spark.createDataFrame(
        [("i1", "u", at(40), ["a", "b", "c", "d", "none", None, "a"], ["a", "none"], "s"), ("i2", "u", at(41), ["d"], ["d"], "s"), ("i3", None, at(42), ["a", "b"], ["a"], None), ("i4", "v", at(43), [], [], "s"), ("i5", "v", at(44), ["gone", "c"], ["c"], None)],
        "impression_id string, user_id string, ts timestamp_ntz, cands array<string>, clicked array<string>, session_id string",
    )
    clicks = spark.createDataFrame([("u", at(1), "a", 3.0), ("u", at(2), "b", None), ("u", at(3), "c", 5.0), ("u", at(9), "none", 1.0), ("v", at(4), "d", None)], "user_id string, ts timestamp_ntz, article_id string, read_time double")
    h = recent_history(imps, clicks)
    popular = spark.createDataFrame([("a", 3), ("none", 7)], "article_id string, clicks long")
    scores = spark.createDataFrame([("i1", [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0], None), ("i2", None, [0.5]), ("i3", None, None), ("i4", None, None), ("i5", [0.1, 0.2], [0.3, 0.4])], "impression_id string, bm25 array<double>, emb array<double>")
    lists = imps.join(scores, "impression_id")
    cands = lists.select("impression_id", "ts", "clicked", "bm25", "emb", F.posexplode("cands").alias("pos", "article_id")).withColumn("label", F.array_contains("clicked", F.col("article_id")).cast("int"))
    cands = cands.withColumns({"bm25_score": F.get("bm25", F.col("pos")), "embedding_score": F.get("emb", F.col("pos"))})
    want = features.feature_table(cands, imps, h, articles, popular)
    got = list_features.feature_table(lists, imps, h, articles, popular)
    assert dict(got.dtypes) == dict(want.dtypes)
    key = lambda r: (r["impression_id"], r["pos"])
    one, two = (sorted(x.select(*want.columns).collect(), key=key) for x in (want, got))
    assert len(one) == len(two) == 10
    for x, y in zip(one, two, strict=True):
        assert [v if isinstance(v, str | None) else round(v, 9) for v in x] == [v if isinstance(v, str | None) else round(v, 9) for v in y]
    assert {r["impression_id"] for r in list_features.feature_table(lists, imps, h, articles, popular, mixed=True).collect()} == {"i1", "i5"}
    assert "posexplode" in want._jdf.queryExecution().optimizedPlan().toString() and "posexplode" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_long_arrays_are_added_up_in_parts(spark):
    """The same sums as those of short ones, 4-byte numbers as such."""
    shapes = [(n, kind) for n in (3, together.LONG + 3) for kind in (float, np.float32)]

    def fit(batches, t):
        for _ in batches:
            pass
        return pickle.dumps((t.n, [t.sum(((t.me + 1) * np.arange(n) / 7).astype(kind)) for n, kind in shapes]))

    n, got = pickle.loads(together.fit_together(spark.range(400).withColumnRenamed("id", "key"), "key", 400, 100, fit))
    assert n > 1
    for x, (size, kind) in zip(got, shapes, strict=True):
        assert x.dtype == kind and np.allclose(x, n * (n + 1) / 2 * np.arange(size) / 7)


def test_neural_gradient_of_a_batch_is_the_sum_of_its_impressions():
    """Of histories of any length; what they share is encoded once, and the absent items of the shorter ones count for nothing."""
    rng = np.random.default_rng(5)
    vecs = rng.normal(size=(9, 6))
    hists, cands = [[0, 1, 0, 2], [3], [2, 4]], [[5, 1, 6], [7, 8, 3], [0, 2, 5]]
    sizes = np.array([len(h) for h in hists])
    x = neural.Samples(vecs, sizes, np.concatenate(hists), np.full(3, 3), np.concatenate(cands), np.tile([1, 0, 0], 3))
    for improved, positions in ((False, True), (True, False)):
        w = neural.initial(6, 8, 2, improved=improved, positions=positions)
        loss, grads = neural.batch_gradient(w, x.batch(np.arange(3), 0, 2, 1))
        each = [neural.loss_and_gradient(w, vecs[h], vecs[c], 0) for h, c in zip(hists, cands, strict=True)]
        assert np.isclose(loss, sum(a for a, _ in each))
        assert all(np.allclose(g, sum(parts)) for g, parts in zip(grads, zip(*(b for _, b in each), strict=True), strict=True))
        scores = np.concatenate([neural.encode_news(w, vecs[c]) @ neural.encode_user(w, neural.encode_news(w, vecs[h])) for h, c in zip(hists, cands, strict=True)])
        assert np.allclose(x.scores(w, np.arange(3)), scores)


def test_neural_fit_sends_the_driver_one_row_and_keeps_equal_vectors_once(spark, monkeypatch):
    vectors, shown = _frames(spark, 300)
    same = vectors.union(vectors.select(F.concat(F.lit("B"), "article_id"), "vec"))
    shown = shown.withColumn("h", F.concat("h", F.transform("h", lambda x: F.concat(F.lit("B"), x))))
    frame, rows = type(shown), []
    real = frame.collect
    monkeypatch.setattr(frame, "collect", lambda df: rows.append(len(got := real(df))) or got)
    monkeypatch.setattr(neural, "PER_TASK", 10**9)
    monkeypatch.setattr(neural, "learn", lambda x, held, **how: ((x.vecs.shape, len(x.key), len(held.key)), None))
    (n, dims), learned, held = neural.fit(shown, same, 6, 10)
    assert (n, dims, learned + held) == (20, 6, 300)
    assert max(rows) == 1


def test_neural_fit_learns_from_those_that_tell_when_to_stop_too(spark, monkeypatch):
    """One epoch of one is the best, so the weights are those of a fit on all impressions; the held-out tenth was left out of them once."""
    vectors, shown = _frames(spark, 400)
    for per_task in (100, 10**9):
        monkeypatch.setattr(neural, "PER_TASK", per_task)
        held, whole = (neural.fit(shown, vectors, 6, n, size=8, heads=2, epochs=1, rate=1e-2) for n in (10, None))
        assert all(np.allclose(a, b, atol=1e-3) for a, b in zip(held.arrays(), whole.arrays(), strict=True))


def test_neural_weights_are_learned_of_all_samples_for_as_many_epochs_as_were_best(monkeypatch):
    rng = np.random.default_rng(6)
    noise = [(rng.normal(size=(3, 4)), rng.normal(size=(5, 4)), np.array([1, 0, 0, 0, 0])) for _ in range(30)]
    sizes, real = [], neural.Samples.batch
    monkeypatch.setattr(neural.Samples, "batch", lambda x, rows, *how: sizes.append((len(x.key), len(rows))) or real(x, rows, *how))
    how = {"size": 8, "heads": 2, "epochs": 40, "rate": 1e-2, "patience": 2, "batch": 5}
    w, losses = neural.train(noise[:20], 4, held_out=noise[20:], **how)
    seen = [sum(n for all_, n in sizes if all_ == size) for size in (20, 30)]
    assert seen == [20 * (len(losses) + 2), 30 * len(losses)]
    again, _ = neural.train(noise[:20] + noise[20:], 4, **how | {"epochs": len(losses)})
    assert len(w.arrays()) == len(again.arrays()) and neural.sample_auc(w, noise) > 0.5


def test_gradients_of_repeated_rows_are_added_up():
    """Of rows taken never, a few times and often; `at` may have any shape."""
    rng = np.random.default_rng(2)
    at = np.concatenate([np.zeros(3 * tape.FEW, int), np.full(tape.FEW, 4), rng.integers(2, 7, 12), [1, 8, 8, 8]]).reshape(4, -1)
    rows = tape.Var(rng.normal(size=(10, 3)))
    g = rng.normal(size=(*at.shape, 3))
    want = np.zeros((10, 3))
    np.add.at(want, at, g)
    tape.backward(tape.take(rows, at), g)
    assert np.allclose(rows.grad, want) and not rows.grad[[7, 9]].any()
