import datetime as dt

import numpy as np
import pandas as pd
import pytest

from newsloom.operators import lambdamart, neural
from newsloom.operators.metrics import impression_auc
from newsloom.streaming.history import answer, session_counts, streaming_history

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(60):
        signal = rng.normal(size=6)
        label = (signal >= np.sort(signal)[-2]).astype(int)
        rows += [(f"i{i}", k, int(label[k]), float(signal[k]), float(rng.normal())) for k in range(6)]
    rows += [("zeros", k, 0, 0.0, 0.0) for k in range(3)] + [("ones", 0, 1, 0.0, 0.0)]
    return spark.createDataFrame(rows, "impression_id string, pos int, label int, signal double, noise double")


def test_training_frame_keeps_mixed_impressions(planted):
    assert lambdamart.training_frame(planted).where("impression_id in ('zeros', 'ones')").count() == 0


def test_ranker_finds_the_signal(planted):
    m = lambdamart.train(planted, ["signal", "noise"], trees=30)
    auc = [r["auc"] for r in impression_auc(lambdamart.score(planted, m, ["impression_id", "pos", "label"]), ["impression_id"]).where("auc is not null").collect()]
    assert np.mean(auc) > 0.95
    assert m.importance()[0][0] == "signal"
    assert len(m.trees[0].feature) <= 2 * 31 - 1


def test_lambdas_pull_clicked_candidates_up():
    g, h = lambdamart.lambdas(np.array([[0.0, 1.0, 0.5], [1.0, 2.0, 3.0]]), np.array([[1.0, 0.0, 0.0], [1.0, 1.0, 1.0]]))
    assert g[0, 0] > 0 > g[0, 1] and abs(g[0].sum()) < 1e-12 and (h >= 0).all() and not g[1].any()
    # the one pair (clicked at rank 3, other at rank 1): sigmoid of the wrong order times the change of NDCG
    assert -g[0, 1] == pytest.approx(1 / (1 + np.exp(-1.0)) * (1 - 0.5))


def test_blocks_cover_every_row():
    at = np.concatenate([b.ravel() for b in lambdamart._by_size(np.array([3, 1, 3, 2]))])
    assert sorted(at) == list(range(9))


def test_search_draws_are_seeded(planted):
    assert lambdamart.draws(3) == lambdamart.draws(3) and len(lambdamart.draws()) == 12
    best = lambdamart.random_search(planted, planted, ["signal", "noise"], lambdamart.draws(2, grid={"trees": [2, 5], "leaves": [3]}))
    assert best[0][1] >= best[1][1]


def test_neural_gradient_is_right():
    rng = np.random.default_rng(2)
    w = neural.initial(5, 8, 2, seed=3)
    hist, cands = rng.normal(size=(4, 5)), rng.normal(size=(3, 5))
    _, grads = neural.loss_and_gradient(w, hist, cands, 1)
    for x, g in zip(w.arrays(), grads, strict=True):
        flat, gf = x.reshape(-1), g.reshape(-1)
        for i in rng.integers(0, flat.size, 6):
            old = flat[i]
            flat[i] = old + 1e-6
            up, _ = neural.loss_and_gradient(w, hist, cands, 1)
            flat[i] = old - 1e-6
            down, _ = neural.loss_and_gradient(w, hist, cands, 1)
            flat[i] = old
            assert gf[i] == pytest.approx((up - down) / 2e-6, abs=1e-5)


@pytest.mark.parametrize(("improved", "positions"), [(False, True), (True, False), (True, True)])
def test_gradients_of_every_form(improved, positions):
    rng = np.random.default_rng(5)
    w = neural.initial(5, 8, 2, seed=4, improved=improved, positions=positions)
    hist, cands = rng.normal(size=(4, 5)), rng.normal(size=(3, 5))
    _, grads = neural.loss_and_gradient(w, hist, cands, 2)
    assert len(grads) == (13 if improved else 9)
    for x, g in zip(w.arrays(), grads, strict=True):
        for i in rng.integers(0, x.size, 4):
            old, at = x.reshape(-1)[i], x.reshape(-1)
            at[i] = old + 1e-6
            up, _ = neural.loss_and_gradient(w, hist, cands, 2)
            at[i] = old - 1e-6
            down, _ = neural.loss_and_gradient(w, hist, cands, 2)
            at[i] = old
            assert g.reshape(-1)[i] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_rate_and_early_stop():
    rates = [neural.rate_at(k, 100, 1.0, 0.1) for k in range(1, 101)]
    assert max(rates) == rates[9] == 1.0 and rates[4] == 0.5 and rates[-1] < 1e-3 and rates[10:] == sorted(rates[10:], reverse=True)
    rng = np.random.default_rng(6)
    noise = [(rng.normal(size=(3, 4)), rng.normal(size=(5, 4)), np.array([1, 0, 0, 0, 0])) for _ in range(30)]
    w, losses = neural.train(noise[:20], 4, 8, 2, epochs=40, rate=1e-2, held_out=noise[20:], patience=2, warmup=0.1, decay=0.01)
    assert len(losses) < 40
    assert neural.sample_auc(w, noise[20:]) >= neural.sample_auc(neural.train(noise[:20], 4, 8, 2, epochs=len(losses), rate=1e-2, warmup=0.1, decay=0.01)[0], noise[20:]) - 0.2
    assert np.allclose(neural.places(3, 4)[0], [0, 1, 0, 1])


def test_neural_learns_and_scores(spark):
    rng = np.random.default_rng(4)
    vec = {f"A{i}": rng.normal(size=6) + (3 if i % 2 else -3) for i in range(20)}
    samples = []
    for _ in range(80):
        side = rng.integers(2)
        hist = [f"A{2 * rng.integers(10) + side}" for _ in range(3)]
        cands = [f"A{2 * rng.integers(10) + side}"] + [f"A{2 * rng.integers(10) + 1 - side}" for _ in range(3)]
        samples.append((np.array([vec[a] for a in hist]), np.array([vec[a] for a in cands]), np.array([1, 0, 0, 0])))
    w, losses = neural.train(samples, 6, 16, 2, epochs=4, rate=1e-2)
    assert losses[-1] < losses[0] / 2
    v = spark.createDataFrame([(a, [float(y) for y in x]) for a, x in vec.items()], "article_id string, vec array<double>")
    h = spark.createDataFrame([("i", [("A1",), ("A3",)]), ("none", [])], "impression_id string, hist array<struct<article_id:string>>")
    c = spark.createDataFrame([("i", 0, "A5"), ("i", 1, "A4"), ("i", 2, "missing"), ("none", 0, "A5")], "impression_id string, pos int, article_id string")
    got = {(r["impression_id"], r["pos"]): r["score"] for r in neural.score(c, h, v, w).collect()}
    assert got["i", 0] > got["i", 1] and got["i", 2] == got["none", 0] == 0.0
    one = neural.encode_user(w, neural.encode_news(w, np.array([vec["A1"], vec["A3"]]))) @ neural.encode_news(w, vec["A5"][None])[0]
    assert got["i", 0] == pytest.approx(one)


def test_answers_wait_for_the_watermark():
    t = [pd.Timestamp(T0) + pd.Timedelta(minutes=m) for m in range(9)]
    clicks, asked, done = answer([(t[1], "A"), (t[3], "B"), (t[5], "C")], [(t[3], "i"), (t[7], "j")], t[4], 2)
    assert done == [("i", ["A"])] and asked == [(t[7], "j")] and len(clicks) == 3


def _stream(spark, tmp_path, frames, schema, build):
    src = tmp_path / "in"
    src.mkdir()
    q = build(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))).writeStream.format("memory").queryName("out").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        for k, f in enumerate(frames):
            f.coalesce(1).write.parquet(str(tmp_path / f"w{k}"))
            next((tmp_path / f"w{k}").glob("part-*")).rename(src / f"{k}.parquet")
            q.processAllAvailable()
        return spark.table("out").collect()
    finally:
        q.stop()


def test_streams_give_the_batch_result(spark, tmp_path):
    schema = "user_id string, ts timestamp, article_id string, impression_id string"
    at = lambda m: T0 + dt.timedelta(minutes=m)
    frames = [
        spark.createDataFrame([("u", at(0), "A", None), ("u", at(30), None, "i1"), ("u", at(20), "B", None)], schema),
        spark.createDataFrame([("u", at(25), "C", None), ("u", at(30), "D", None), ("v", at(40), None, "i2")], schema),
        spark.createDataFrame([("z", at(600), "Z", None)], schema),
        spark.createDataFrame([("z", at(900), "Z", None)], schema),
    ]
    got = {r["impression_id"]: r["items"] for r in _stream(spark, tmp_path, frames, schema, lambda s: streaming_history(s, 2))}
    assert got == {"i1": "C B", "i2": ""}


def test_stream_sessions(spark, tmp_path):
    at = lambda m: T0 + dt.timedelta(minutes=m)
    frames = [spark.createDataFrame([("u", at(0)), ("u", at(10)), ("u", at(100))], "user_id string, ts timestamp"), spark.createDataFrame([("u", at(900))], "user_id string, ts timestamp"), spark.createDataFrame([("u", at(1900))], "user_id string, ts timestamp")]
    got = _stream(spark, tmp_path, frames, "user_id string, ts timestamp", session_counts)
    assert sorted(r["n"] for r in got if r["start_ts"] < at(200)) == [1, 2]
