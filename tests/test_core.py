"""Contracts of frames, transforms, predictors, folds and tuning; numpy is the oracle."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from coordspark.frame import VALUE, LabeledFrame
from coordspark.functions import scoring, signal
from coordspark.operators import align, compose, linear, normalize, predict, reduce, reshape, sampling, select, spatial, spectral, weights
from coordspark.operators.base import TransformError
from coordspark.plans import cv, tune
from coordspark.plans.cache import ResultCache
from coordspark.sources import tables


@pytest.fixture(scope="module")
def toy(spark):
    f = tables.toy(spark, 60)
    return LabeledFrame(f.cells.cache(), f.dims, f.coords, f.attrs)


@pytest.fixture(scope="module")
def array(toy):
    return to_array(toy)


def to_array(frame):
    """Values as an array in label order."""
    pdf = frame.cells.select(*frame.dims, VALUE).toPandas()
    labels = [sorted(pdf[d].unique()) for d in frame.dims]
    out = np.full([len(x) for x in labels], np.nan)
    places = [pdf[d].map({x: i for i, x in enumerate(ls)}) for d, ls in zip(frame.dims, labels, strict=True)]
    out[tuple(places)] = pdf[VALUE]
    return out


# -- frames and selection ------------------------------------------------------------------------------------

def test_layouts_round_trip(spark, toy, array):
    dense = toy.dense("trial").orderBy("trial").collect()
    assert np.allclose([r.features for r in dense], array.reshape(60, -1))
    assert {r.stimulus for r in dense} == {"a", "b", "c"}
    holes = LabeledFrame.from_table(spark.createDataFrame([(1, "x", float("nan")), (1, "y", 2.0), (2, "x", 3.0)], "trial long, channel string, v double"), ["trial", "channel"], "v")
    assert sorted((r.trial, r.channel, r.value) for r in holes.cells.where("value is not null").collect()) == [(1, "y", 2.0), (2, "x", 3.0)]
    assert holes.complete("trial").cells.count() == 4


def test_selection_contract(toy):
    one = toy.sel({"time": 3})
    assert one.dims == ("trial", "channel") and one.cells.count() == 240
    assert toy.sel({"channel": [0, 2], "time": slice(5, 9)}).cells.count() == 60 * 2 * 5
    assert toy.drop_sel({"channel": [0]}).label_list("channel") == [1, 2, 3]
    with pytest.raises(KeyError):
        toy.sel({"channel": 99})
    with pytest.raises(KeyError):
        toy.sel({"depth": 1})
    with pytest.raises(ValueError):
        select.by_conditions(toy, {"session": {"==": "s0"}})
    assert toy.targets("s*") == ["session", "stimulus"]
    with pytest.raises(KeyError):
        toy.targets("q*")


def test_transform_sel_keeps_the_rest(toy, array):
    out = to_array(select.Function(lambda c: c * 2, transform_sel={"channel": [1]}).transform(toy))
    want = array.copy()
    want[:, 1] *= 2
    assert np.allclose(out, want)
    part = normalize.Demean("channel", use_fit=True, transform_drop_sel={"channel": [0]})
    out = to_array(part.fit_transform(toy))
    assert np.allclose(out[:, 0], array[:, 0]) and np.allclose(out[:, 1:].mean(axis=(0, 2)), 0)
    with pytest.raises(ValueError):
        reduce.Average("time", transform_sel={"channel": [1]})
    with pytest.raises(ValueError):
        select.Identity(transform_sel={"time": 1}, transform_drop_sel={"time": 1})


def test_helpers():
    assert select.freq_band_indices([1, 2, 3, 4, 5], 2, 4) == (1, 4)
    assert list(select.remaining_freq_ranges({"a": (0, 1), "b": (1, 2), "c": (2, 3)}, 1)) == ["a", "b"]
    assert list(select.remaining_freq_ranges({"a": (0, 1), "b": (1, 2)}, 1, remove_high=False)) == ["b"]


def test_parameters_clone_and_history(toy):
    p = compose.Pipeline("p", [("z", normalize.ZScore("trial")), ("w", weights.SampleWeight("stimulus", weight_map={"a": 2.0}))])
    p.set_params(z__per_dim="channel", w__weight_map__a=3.0)
    q = p.clone()
    assert q.steps[0].transform.per_dim == "channel" and q.steps[1].transform.weight_map == {"a": 3.0}
    assert q.steps[0].transform is not p.steps[0].transform
    with pytest.raises(ValueError):
        p.set_params(z__nothing=1)
    out = p.transform(toy)
    assert [h["class"] for h in out.history] == ["ZScore", "SampleWeight"] and toy.history == ()
    tuned = predict.Ridge().set_params(alpha=7.0).clone()
    assert tuned.alpha == 7.0  # survives the clone that a fold makes


# -- reductions, reshaping, normalisation --------------------------------------------------------------------

def test_average_and_shapes(toy, array):
    out = reduce.Average(["time"]).transform(toy)
    assert np.allclose(to_array(out), array.mean(axis=2)) and out.coords == toy.coords
    assert reduce.Average(["trial"]).transform(toy).coords == {}
    flat = reshape.Flatten(["channel", "time"]).transform(toy)
    assert flat.dims == ("trial", "flat_channel__time")
    assert np.allclose(to_array(reshape.Unflatten("flat_channel__time").transform(flat)), array)
    assert np.allclose(to_array(reshape.Transpose(["time", "trial", "channel"]).transform(toy)), array.transpose(2, 0, 1))
    renamed = reshape.RenameDims({"channel": "sensor"}).transform(toy)
    assert renamed.dims == ("trial", "sensor", "time")
    with pytest.raises(KeyError):
        reshape.Flatten(["channel", "depth"]).transform(toy)
    with pytest.raises(ValueError):
        reshape.Flatten(["channel"])


@pytest.mark.parametrize("per_dim, axes", [("channel", (0, 2)), ("trial", (1, 2)), (["trial", "channel"], (2,))])
def test_normalisers(toy, array, per_dim, axes):
    mean, std = array.mean(axis=axes, keepdims=True), array.std(axis=axes, keepdims=True)
    assert np.allclose(to_array(normalize.Demean(per_dim).transform(toy)), array - mean)
    assert np.allclose(to_array(normalize.ZScore(per_dim).transform(toy)), (array - mean) / std)
    assert np.allclose(to_array(normalize.RemoveOutliers(per_dim, 1.0).transform(toy)), np.clip(array, mean - std, mean + std))


def test_fitted_normaliser_and_zero_spread(spark, toy, array):
    train = toy.where(F.col("trial") < 30)
    z = normalize.ZScore("channel", fit_sel={"stimulus": "a"})
    assert z.is_stateful
    with pytest.raises(TransformError):
        z.transform(toy)
    rows = np.arange(30) % 3 == 0
    m, s = array[:30][rows].mean(axis=(0, 2), keepdims=True), array[:30][rows].std(axis=(0, 2), keepdims=True)
    assert np.allclose(to_array(z.fit(train).transform(toy)), (array - m) / s)
    flat = LabeledFrame.from_table(spark.createDataFrame([(1, 0, 2.0), (1, 1, 2.0)], "trial long, channel int, value double"), ["trial", "channel"])
    assert [r.value for r in normalize.ZScore("trial").transform(flat).cells.collect()] == [None, None]


def test_references(toy, array):
    car = to_array(normalize.CommonAverage(excluded_channels=[3]).transform(toy))
    assert np.allclose(car[:, :3], array[:, :3] - array[:, :3].mean(axis=1, keepdims=True)) and np.allclose(car[:, 3], array[:, 3])
    out = to_array(normalize.RegressOutReference(0, excluded_channels=[3]).transform(toy))
    x = array[:, 0].ravel()
    for c in (1, 2):
        b, a = np.polyfit(x, array[:, c].ravel(), 1)
        assert np.allclose(out[:, c].ravel(), array[:, c].ravel() - (a + b * x))
    assert np.allclose(out[:, [0, 3]], array[:, [0, 3]])
    with pytest.raises(ValueError):
        normalize.CommonAverage("median")


# -- composition ---------------------------------------------------------------------------------------------

def test_union(toy, array):
    out = compose.Union([("m", reduce.Average("time")), ("x", select.Identity(sel={"time": 0}))], ["channel", "channel"]).transform(toy)
    assert out.dims == ("trial", "feature") and out.label_list("feature")[0] == "m_0" and out.cells.count() == 480
    with pytest.raises(TransformError):
        compose.Union([("m", reduce.Average("time")), ("i", select.Identity())], ["channel", "channel"]).transform(toy)
    with pytest.raises(TransformError):
        compose.Union([("a", select.Identity(sel={"trial": [1, 2]})), ("b", select.Identity(sel={"trial": [2, 3]}))], ["channel", "channel"]).transform(toy)
    both = compose.UnionWithInput(normalize.Demean("channel"), "channel").transform(toy)
    assert both.dims == toy.dims and both.cells.count() == 2 * toy.cells.count()


def test_switch_and_pipeline_errors(toy):
    s = compose.Switch([("z", normalize.ZScore("trial")), ("i", select.Identity())])
    with pytest.raises(TransformError):
        s.transform(toy)
    assert s.transform(toy, choose="i").cells.count() == toy.cells.count()
    undecided = compose.Switch([("a", predict.LDA()), ("b", predict.NearestMean())])
    assert undecided.is_predictor and compose.Pipeline("p", [undecided]).is_predictor
    with pytest.raises(TransformError, match="crop"):
        compose.Pipeline("p", [("crop", select.CropTime(0, 1, time_dim="when"))]).transform(toy)
    with pytest.raises(ValueError):
        compose.Pipeline("p", [("a", select.Identity()), ("a", select.Identity())])
    assert compose.Optional(normalize.ZScore("trial"), use=False).chosen().__class__ is select.Identity


def test_group_apply(toy, array):
    out = to_array(compose.GroupApply("session", normalize.Demean("channel")).transform(toy))
    for s in (0, 1):
        own = array[s::2]
        assert np.allclose(out[s::2], own - own.mean(axis=(0, 2), keepdims=True))
    g = compose.GroupApply("session", normalize.Demean("channel", use_fit=True)).fit(toy.where(F.col("session") == "s0"))
    with pytest.raises(TransformError):
        g.transform(toy)
    pipe = compose.GroupApply("session", compose.Pipeline("p", [normalize.ZScore("trial"), predict.NearestMean()]))
    assert pipe.fit(toy).predict(toy).count() == 60


def test_ensembles(spark, toy):
    members = [("a", predict.LDA(shrinkage=0.5)), ("b", predict.LDA(shrinkage=0.9), 3.0)]
    frame = reduce.Average("time").transform(toy)
    e = compose.Ensemble(members).fit(frame)
    assert e.weights == [0.25, 0.75]
    p = e.predict(frame).collect()
    assert len(p) == 60 and all(abs(sum(r.probability) - 1) < 1e-9 for r in p)
    u = e.predict_with_uncertainty(frame).collect()
    assert all(r.epistemic > -1e-6 and r.aleatoric > -1e-6 for r in u)
    assert e.predict_with_std(frame).count() == 180
    piped = compose.Pipeline("p", [normalize.ZScore("trial"), compose.Ensemble([("m", predict.NearestMean()), ("n", predict.NearestMean())])])
    assert piped.fit(frame).predict(frame).count() == 60  # an ensemble may end a pipeline
    scored = compose.Ensemble(members, weighting="score_based", scoring=scoring.scorer("accuracy")).fit(frame)
    assert abs(sum(scored.weights) - 1) < 1e-9
    with pytest.raises(ValueError):
        compose.Ensemble([("a", predict.LDA(), 0.0)])
    ties = spark.createDataFrame([(1, 0.5, "b"), (1, 0.5, "a")], "trial long, weight double, prediction string")
    assert compose.combine(ties, ["trial"]).first().prediction == "a"


# -- projections and predictors ------------------------------------------------------------------------------

def test_pca_and_whitening(toy, array):
    x = array.transpose(0, 2, 1).reshape(-1, 4)
    cov = np.cov(x.T)
    pca = linear.FeaturePCA(n_components=2).fit(toy)
    assert np.allclose(pca.explained_variance, np.sort(np.linalg.eigvalsh(cov))[::-1][:2])
    out = to_array(pca.transform(toy)).transpose(0, 2, 1).reshape(-1, 2)
    assert np.allclose(np.cov(out.T), np.diag(pca.explained_variance), atol=1e-8)
    white = to_array(linear.GlobalZCA(pca_frac_to_keep=1.0).fit_transform(toy)).transpose(0, 2, 1).reshape(-1, 4)
    assert np.allclose(np.cov(white.T), np.eye(4), atol=1e-3)
    assert linear.FeaturePCA(n_components=0.999).fit(toy).matrix.shape[1] == 4
    whole = to_array(linear.ReconstructionPCA(n_components=4).fit_transform(toy))
    assert np.allclose(whole, array)
    with pytest.raises(ValueError):
        linear.kept_components(np.ones(3), None, None)
    colour = linear.GlobalColoring(n_components=4).fit(toy)
    assert np.allclose(colour.matrix @ colour.matrix, cov, atol=1e-3)


def test_lda_and_ridge(toy, array):
    frame = reduce.Average("time").transform(toy)
    x, y = array.mean(axis=2), np.arange(60) % 3
    model = predict.LDA(shrinkage=0.1).fit(frame)
    means = np.array([x[y == k].mean(axis=0) for k in range(3)])
    s = sum((x[y == k] - means[k]).T @ (x[y == k] - means[k]) for k in range(3)) / 60
    s = 0.9 * s + 0.1 * np.trace(s) / 4 * np.eye(4)
    z = x @ np.linalg.solve(s, means.T) - 0.5 * np.einsum("ij,ij->i", means, np.linalg.solve(s, means.T).T) + np.log(1 / 3)
    rows = model.predict(frame).orderBy("trial").collect()
    assert [r.prediction for r in rows] == ["abc"[i] for i in z.argmax(axis=1)]
    e = np.exp(z - z.max(axis=1, keepdims=True))
    assert np.allclose([r.probability for r in rows], e / e.sum(axis=1, keepdims=True), atol=1e-6)
    proj = linear.LDAProjection().fit_transform(frame)
    assert proj.dims == ("trial", "component") and proj.label_list("component") == [0, 1]

    target = LabeledFrame(frame.cells.withColumn("t", F.col("trial").cast("double")), frame.dims, {**frame.coords, "t": "trial"})
    ridge = predict.Ridge(target_coord="t", alpha=2.0).fit(target)
    xc, t = x - x.mean(axis=0), np.arange(60.0)
    coef = np.linalg.solve(xc.T @ xc + 2 * np.eye(4), xc.T @ (t - t.mean()))
    got = [r.prediction for r in ridge.predict(target).orderBy("trial").collect()]
    assert np.allclose(got, t.mean() + xc @ coef)
    unseen = predict.LDA(classes=["a", "b", "c", "zz"]).fit(frame).predict(frame).first()
    assert len(unseen.probability) == 4 and unseen.probability[3] == 0.0


def test_spark_estimators(toy):
    from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
    from pyspark.ml.feature import PCA

    frame = weights.SampleWeight(default_weight=2.0).transform(reduce.Average("time").transform(toy))
    for estimator in (LogisticRegression, DecisionTreeClassifier):
        out = predict.SparkPredictor(estimator).fit(frame).predict(frame).collect()
        assert {r.prediction for r in out} <= {"a", "b", "c"} and all(abs(sum(r.probability) - 1) < 1e-6 for r in out)
    comp = predict.SparkTransformer(PCA, {"k": 2}).fit_transform(frame)
    assert comp.dims == ("trial", "component") and comp.cells.count() == 120
    boosted = predict.BoostedTrees({"maxIter": 3, "maxDepth": 2}).fit(frame)
    assert len(boosted.models) == 3 and boosted.predict(frame).count() == 60
    assert boosted.clone().params == {"maxIter": 3, "maxDepth": 2}


def test_weights(toy):
    with pytest.raises(ValueError):
        weights.SampleWeight("a", weight_map={1: 2}, weight_func=lambda c: c)
    out = weights.BalanceClassWeight("stimulus", weight_normalize="sum").transform(toy)
    w = weights.sample_weights(out, "trial")
    assert abs(w.agg(F.sum("sample_weight")).first()[0] - 1) < 1e-9
    assert weights.sample_weights(toy, "trial") is None
    off = weights.SampleWeight(default_weight=3.0).prepare_for_inference()
    assert "sample_weight" not in off.transform(toy).coords


# -- signals and grids ---------------------------------------------------------------------------------------

def test_filters():
    fs, t = 500.0, np.arange(600) / 500.0
    inside, outside = np.sin(2 * np.pi * 10 * t), np.sin(2 * np.pi * 90 * t)
    b, a = signal.butterworth(4, 5, 20, fs)
    w = np.exp(-2j * np.pi * np.array([10.0, 5.0, 90.0]) / fs)
    gain = abs(np.polyval(b[::-1], w) / np.polyval(a[::-1], w))
    assert abs(gain[0] - 1) < 0.02 and abs(gain[1] - 2**-0.5) < 1e-6 and gain[2] < 1e-3
    out = signal.bandpass((inside + outside)[None], 5, 20, fs)[0]
    assert abs(out[200:400] - inside[200:400]).max() < 0.02  # no phase shift
    with pytest.raises(ValueError):
        signal.bandpass(inside[:20], 5, 20, fs)
    with pytest.raises(ValueError):
        spectral.Bandpass(5, 250, fs=500)
    z = signal.analytic(np.cos(2 * np.pi * 10 * np.arange(500) / 500))
    assert np.allclose(abs(z), 1, atol=1e-9)


def test_tapers_and_spectrum():
    v = signal.slepian(128, 3.5, 6)
    assert np.allclose(v @ v.T, np.eye(6), atol=1e-9)
    f = np.fft.fft(v[0], 4096)
    inside = np.abs(np.fft.fftfreq(4096)) <= 3.5 / 128
    assert (abs(f[inside]) ** 2).sum() / (abs(f) ** 2).sum() > 0.9999
    x = np.sin(2 * np.pi * 40 * np.arange(500) / 500)[None]
    power, freqs, centres = signal.multitaper(x, 500, nw=2.5, windows=3, n_fft=512)
    assert power.shape == (1, 3, 4, 256) and abs(freqs[power.mean(axis=(0, 1, 2)).argmax()] - 40) < 6
    with pytest.raises(ValueError):
        signal.band_means(power, freqs, {"none": (300, 400)})


def test_spectral_transforms(toy):
    mt = spectral.MultiTaper(100, time_halfbandwidth_product=1.5, num_time_windows=2, n_fft=32, avg_within_freq_bands=True, freq_ranges={"low": (0, 20), "high": (20, 50)})
    out = mt.transform(toy)
    assert out.dims == ("trial", "channel", "freq_band", "time_window") and out.cells.count() == 60 * 4 * 2 * 2
    ph = spectral.HilbertPhase(100, step_ms=10, order=1, bands={"a": (5, 20), "b": (20, 45)}, remove_high=1)
    out = ph.transform(toy)
    assert out.dims == ("trial", "channel", "freq_band", "time") and out.cells.agg(F.max(F.abs("value"))).first()[0] <= np.pi
    rel = spectral.HilbertPhase(100, mode="relative_average", start_ms=900, end_ms=950, order=1, bands={"a": (5, 20)}, remove_high=0)
    assert rel.transform(toy).cells.where("value is not null").count() == 0
    with pytest.raises(ValueError):
        spectral.HilbertPhase(100)


def test_grid_operators(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(5, 16))
    f = LabeledFrame.from_dense(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "trial long, x array<double>"), "trial", "x", "channel")
    layout, g = spatial.square_layout(4, 4), x.reshape(5, 4, 4)
    padded = np.pad(g, ((0, 0), (1, 1), (1, 1)), mode="symmetric")
    lap = (padded[:, :-2, 1:-1] + padded[:, 2:, 1:-1] + padded[:, 1:-1, :-2] + padded[:, 1:-1, 2:]) / 4 - g
    assert np.allclose(to_array(spatial.LaplacianCSD(layout).transform(f)).reshape(5, 4, 4), -lap)
    mean = lambda a: (a[:, :-1, :-1] + a[:, 1:, :-1] + a[:, :-1, 1:] + a[:, 1:, 1:]) / 4
    both = to_array(spatial.WindowMeanPyramid(layout, levels=2, keep_only_top=False).transform(f))
    assert np.allclose(both, np.hstack([mean(g).reshape(5, -1), mean(mean(g)).reshape(5, -1)]))
    k = spatial.gaussian_kernel(0.5)
    smooth = lambda a, ax: sum(w * np.take(a, [spatial.reflected(i + o, 4) for i in range(4)], axis=ax) for o, w in k.items())
    want = smooth(smooth(g, 1), 2)[:, ::2, ::2].reshape(5, -1)
    assert np.allclose(to_array(spatial.GaussianPyramid(layout, sigma=0.5).transform(f)), want)
    holed = f.map_value(lambda v: F.when(F.col("channel") != 5, v))
    filled = to_array(spatial.FillNeighbours(layout).transform(holed))
    near = [0, 1, 2, 4, 6, 8, 9, 10]
    assert np.allclose(filled[:, 5], x[:, near].mean(axis=1))
    with pytest.raises(ValueError):
        spatial.laplacian_kernel(0.5)


def test_local_whitening(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4))
    f = LabeledFrame.from_dense(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "trial long, x array<double>"), "trial", "x", "channel")
    out = to_array(spatial.LocalZCA(spatial.square_layout(2, 2), radius=2).fit_transform(f))  # all are neighbours
    assert np.allclose(np.cov(out.T), np.eye(4), atol=1e-3)


# -- alignment -----------------------------------------------------------------------------------------------

def test_alignment(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(6, 3)) * 3
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    rows = []
    for i in range(120):
        k, moved = i % 6, i >= 60
        v = base[k] + rng.normal(size=3) * 0.01
        rows.append((i, "s" if moved else "t", k, ((v @ q) * 2 + 5 if moved else v).tolist()))
    f = LabeledFrame.from_dense(spark.createDataFrame(rows, "trial long, session string, label int, x array<double>"), "trial", "x", "feature", ["session", "label"])
    out = to_array(align.Procrustes(target_group="t", target_coord="label").fit_transform(f))
    assert abs(out[60:66] - out[:6]).max() < 0.2  # the turn, scale and shift are undone
    coral = to_array(align.Coral(target_group="t").fit_transform(f))
    assert np.allclose(np.cov(coral[60:].T), np.cov(coral[:60].T), atol=0.01)
    for make in (align.CCA, align.MCCA, align.GCCA):
        a = to_array(make(target_coord="label", n_components=2).fit_transform(f))
        assert all(abs(np.corrcoef(a[:60, k], a[60:, k])[0, 1]) > 0.95 for k in range(2)), make
    for t in (align.KCCA(target_coord="label", n_components=2), align.JDA(target_coord="label", n_components=2), align.SubspaceAlignment(target_group="t", n_components=2), align.NoAlignment()):
        assert t.fit_transform(f).cells.count() in (240, 360)
    fitted = align.Coral(target_group="t").fit(f)
    strange = fitted.transform(LabeledFrame(f.cells.withColumn("session", F.lit("new")), f.dims, f.coords))
    with pytest.raises(Exception, match="was not fitted"):
        strange.cells.collect()  # no action before, so that streams can be aligned
    with pytest.raises(TransformError):
        align.CCA(target_coord="label").fit(f.where(F.col("session") == "t"))


# -- folds, scores, tuning -----------------------------------------------------------------------------------

def test_folds_part_the_samples(toy):
    for v in (cv.KFold(4), cv.KFold(4, stratify_coord="stimulus"), cv.GroupedKFold("session", n_splits=4, stratify_coord="stimulus"), cv.LeaveSessionOut()):
        f = v.folds(toy).toPandas()
        assert sorted(f.trial) == list(range(60)) and f.fold.nunique() in (2, 4)
        assert f.groupby("fold").size().max() - f.groupby("fold").size().min() <= 1
    held = cv.KFold(3, stratify_coord="stimulus", test_size=0.25).folds(toy).toPandas()
    assert (held.fold == cv.HOLDOUT).sum() == 15
    with pytest.raises(ValueError):
        cv.KFold(1)
    with pytest.raises(ValueError):
        cv.LeaveGroupOut("session", test_group_ids=["s0"], validation_group_ids=["s0"])
    with pytest.raises(ValueError):
        cv.KFold(30, stratify_coord="stimulus").folds(toy)


def test_repeats_stay_together(toy):
    f = LabeledFrame(toy.cells.withColumn("orig_trial", F.expr("trial div 3")), toy.dims, {**toy.coords, "orig_trial": "trial"})
    got = cv.KFold(4).folds(f).toPandas()
    got["unit"] = got.trial // 3 * 10 + got.trial % 2
    assert (got.groupby("unit").fold.nunique() == 1).all()


def test_cross_validation_does_not_leak(toy):
    p = compose.Pipeline("p", [("mean", reduce.Average("time")), ("z", normalize.ZScore("channel", use_fit=True)), ("m", predict.NearestMean())])
    runner = cv.CrossValidator(cv.KFold(3, stratify_coord="stimulus", test_size=0.2), "f1_macro")
    result = runner.cross_validate(p, toy)
    rows = result.predictions.toPandas()
    assert len(rows) == 48 and rows.trial.is_unique and set(result.cv_scores) == {0, 1, 2} and result.score > 0.8
    assert 0 <= runner.score_on_holdout(p, toy) <= 1
    changed = LabeledFrame(toy.cells.withColumn(VALUE, F.when(F.col("trial").isin([int(t) for t in rows.trial[rows.fold == 0]]), F.col(VALUE) * 50).otherwise(F.col(VALUE))), toy.dims, toy.coords)
    again = cv.CrossValidator(cv.KFold(3, stratify_coord="stimulus", test_size=0.2), "f1_macro")
    again.cross_validate(p, changed)
    first, second = (r.suffix.clone() for r in (runner, again))
    for c, r in ((first, runner), (second, again)):
        c.fit(r.ready.where(r.validator.train(0)))
    stats = [{r.channel: (round(r["mean"], 9), round(r["std"], 9)) for r in c.steps[0].transform.stats.collect()} for c in (first, second)]
    assert stats[0] == stats[1]  # what fold 0 validates on does not reach its statistics
    final = runner.finalize(p, toy)
    assert final.predict(toy).count() == 60
    with pytest.raises(ValueError):
        runner.cross_validate(compose.Pipeline("n", [select.Identity()]), toy)


def test_one_scan_folds_equal_refits(toy):
    frame = reduce.Average("time").transform(toy)
    folds = cv.KFold(4, stratify_coord="stimulus").folds(frame)
    marked = LabeledFrame(frame.cells.join(folds, "trial"), frame.dims, {**frame.coords, "fold": "trial"})
    fast = {r.trial: r.prediction for r in cv.nearest_mean_oof(marked, "stimulus").collect()}
    slow = cv.CrossValidator(cv.KFold(4, stratify_coord="stimulus")).cross_validate(compose.Pipeline("p", [predict.NearestMean()]), frame)
    assert fast == {r.trial: r.prediction for r in slow.predictions.collect()}


def test_scores(spark):
    rows = spark.createDataFrame([(0, 0, 1.0, 1.5), (0, 1, 2.0, 1.0), (1, 1, 3.0, 3.0), (2, 1, 4.0, 5.0)], "truth int, prediction int, t double, p double")
    c = scoring.classification(rows, "truth").first()
    assert np.isclose(c.accuracy, 0.5) and np.isclose(c.f1_macro, (2 / 3 + 2 / 4 + 0) / 3) and np.isclose(c.f1_weighted, (2 * 2 / 3 + 1 / 2) / 4)
    r = scoring.regression(rows, "t", predicted="p").first()
    assert np.isclose(r.neg_rmse**2, -r.neg_mse) and np.isclose(r.neg_mse, -(0.25 + 1 + 0 + 1) / 4)
    ap = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (1, 0.7), (0, 0.1)], "y int, s double")
    assert np.isclose(scoring.average_precision(ap, "y", "s").first().ap, 1 / 3 + 2 / 3 * 3 / 4)
    share = scoring.normalised(scoring.confusion(rows, "truth")).groupBy("truth").agg(F.sum("share").alias("s")).collect()
    assert all(np.isclose(x.s, 1) for x in share)
    with pytest.raises(ValueError):
        scoring.score_table("nothing", rows, "truth")


def test_sampling(toy):
    a = sampling.TrialSampler(10).transform(toy).label_list("trial")
    assert a == sampling.TrialSampler(10).transform(toy).label_list("trial") and len(a) == 10
    assert sampling.TrialSampler(5, shuffle=False).transform(toy).label_list("trial") == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        sampling.TrialSampler(61).transform(toy)
    train, test = sampling.train_test_split(toy, "stimulus", 0.25)
    assert len(test.label_list("trial")) == 15 and not set(train.label_list("trial")) & set(test.label_list("trial"))


def test_tuning(spark, toy):
    frame = reduce.Average("time").transform(toy)
    lda = compose.Pipeline("lda", [("z", normalize.ZScore("trial")), ("opt", compose.Optional(normalize.Demean("channel"))), ("m", predict.LDA())])
    t = tune.Tuner({"lda": lda}, cv.KFold(2, stratify_coord="stimulus"), {"m": {"shrinkage": [0.1, 0.5]}}, frame, "accuracy", sampler="grid", enqueue_initial=False)
    best = t.tune(4)
    assert len(t.trials) == 4 and best.score == max(x.score for x in t.trials) and {"opt__choose", "m__shrinkage"} == set(best.params)
    assert t.best_pipeline().steps[-1].transform.shrinkage == best.params["m__shrinkage"]
    assert t.runs(spark).count() == 4 and t.finalize_best_pipeline().predict(frame).count() == 60
    with pytest.raises(AssertionError):
        tune.Tuner(lda, cv.KFold(2), {"nope": {"x": [1]}}, frame)
    for bad in (("log", 0, 1), "x", (3, 1), []):
        with pytest.raises(ValueError):
            tune.Space.of(bad)
    assert tune.Space.of((1, 5)).kind == "int" and tune.Space.of((0.0, 1)).kind == "float"
    numeric = tune.Tuner(compose.Pipeline("bad", [("f", _Broken()), ("m", predict.LDA())]), cv.KFold(2), {"m": {"shrinkage": [0.1]}}, frame, "accuracy", enqueue_initial=False)
    with pytest.raises(RuntimeError):
        numeric.tune(1)
    assert numeric.trials[0].state == "pruned"


class _Broken(select.Identity):
    stateful = True

    def _fit(self, frame):
        raise ValueError("SVD did not converge")


def test_cache_keeps_state(toy):
    cache = ResultCache(limit=1)
    z = normalize.ZScore("channel", use_fit=True)
    a, out = cache.fit_transform(z, toy)
    b, again = cache.fit_transform(z.clone(), toy)
    assert a is b and a.stats is not None and again is out
    c, _ = cache.fit_transform(normalize.Demean("channel", use_fit=True), toy)
    assert c is not a and len(cache.held) == 1
    cache.clear()


def test_generators(spark):
    f = tables.field_potentials(spark, n_trials=4, n_channels=2, seconds=0.2)
    assert f.cells.count() == 4 * 2 * 100 and f.coords == {"stimulus": "trial", "session": "trial"}


def test_streaming_equals_batch(spark, tmp_path):
    from coordspark.streaming.inference import stream_frames

    rng = np.random.default_rng(0)
    rows = [(i, "a" if i % 2 else "b", rng.normal(size=4).tolist()) for i in range(40)]
    schema = "trial long, stimulus string, x array<double>"
    whole = LabeledFrame.from_dense(spark.createDataFrame(rows, schema), "trial", "x", "feature", ["stimulus"])
    model = compose.Pipeline("p", [normalize.ZScore("feature", use_fit=True), predict.LDA()]).fit(whole)
    for i in range(2):
        spark.createDataFrame(rows[i * 20 : i * 20 + 20], schema).write.parquet(str(tmp_path / f"in/part{i}"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    stream_frames(stream, "trial", "x", "feature", ["stimulus"], model.predict, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = {r.trial: r.prediction for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r.trial: r.prediction for r in model.predict(whole).collect()}


def test_registry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 90
