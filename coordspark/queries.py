"""Registered queries of the labelled-data operators, each with the SQL that gives the same rows.

Values are rounded to six decimals with ``+ 0.0`` (no negative zero) on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coordspark.frame import VALUE, LabeledFrame
from coordspark.functions import scoring
from coordspark.operators import align, compose, linear, normalize, predict, reduce, reshape, sampling, select, spatial, spectral, weights
from coordspark.plans import cv, tune
from coordspark.sources import tables
from coordspark.streaming import inference

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: The cubes in SQL.
E2 = "e2 as (select vec_id as trial, label, vec_id % 4 as session, unnest(range(len(embedding))) as feature, unnest(embedding)::double as value from embeddings)"
E3 = "e3 as (select vec_id as trial, label, vec_id % 4 as session, p // 8 as channel, p % 8 as time, value from (select vec_id, label, unnest(range(len(embedding))) as p, unnest(embedding)::double as value from embeddings))"
G8 = "g as (select vec_id as trial, unnest(range(len(embedding))) as channel, unnest(embedding)::double as value from embeddings)"
EV = "ev as (select user_id as trial, event_type as channel, day(ts) as time, avg(value) as value from events group by 1, 2, 3)"
S2 = "s as (select vec_id as trial, label, vec_id % 4 as session from embeddings)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(c, 6) + F.lit(0.0)


def cells(frame: LabeledFrame, *more: str) -> DataFrame:
    """Dimensions, named coordinates and the rounded value."""
    return frame.cells.select(*frame.dims, *more, r6(VALUE).alias(VALUE))


V = "round(value, 6) + 0.0 as value"


# -- selection -----------------------------------------------------------------------------------------------

@query(f"with {E3} select trial, channel, time, {V} from e3 where channel in (1, 3) and time = 2".replace("select trial, channel, time", "select trial, channel"))
def sel_labels(spark, d):
    return cells(tables.cube(spark, d).sel({"channel": [1, 3], "time": 2}))


@query(f"with {E3} select trial, channel, time, {V} from e3 where channel not in (0, 7)")
def drop_sel(spark, d):
    return cells(tables.cube(spark, d).drop_sel({"channel": [0, 7]}))


@query(f"with {E3} select trial, channel, time, {V} from e3 where time between 2 and 5")
def crop_time(spark, d):
    return cells(select.CropTime(2, 5).transform(tables.cube(spark, d)))


@query(f"with {E3} select trial, channel, time, {V} from e3 where session = 1 and label between 2 and 5 and time in (0, 4)")
def conditions_range(spark, d):
    return cells(select.by_conditions(tables.cube(spark, d), {"session": 1, "label": (2, 5), "time": [0, 4]}))


@query(f"with {E3} select trial, channel, time, {V} from e3 where session > 1 and label <= 7 and label <> 3 and channel not in (2, 5)")
def conditions_ops(spark, d):
    return cells(select.by_conditions(tables.cube(spark, d), {"session": {">": 1}, "label": {"<=": 7, "!=": 3}, "channel": {"!=": [2, 5]}}))


@query(f"with {E3} select trial, channel, time, round(case when channel in (0, 1) then value * 10 else value end, 6) + 0.0 as value from e3")
def transform_sel_scale(spark, d):
    return cells(select.Function(lambda c: c * 10, transform_sel={"channel": [0, 1]}).transform(tables.cube(spark, d)))


@query(f"with {E3} select trial, channel, time, round(case when channel = 4 then value else ln(1 + abs(value)) end, 6) + 0.0 as value from e3")
def transform_drop_sel_log(spark, d):
    return cells(select.Function(lambda c: F.log(1 + F.abs(c)), transform_drop_sel={"channel": [4]}).transform(tables.cube(spark, d)))


@query("select distinct label, dense_rank() over (order by label) - 1 as pos from embeddings")
def discover_groups(spark, d):
    return tables.vectors(spark, d).labels("label").select("label", F.col("pos").cast("long").alias("pos"))


@query(f"with {E3} select trial, channel, time, {V} from e3 where session = 2")
def select_group(spark, d):
    return cells(select.select_group(tables.cube(spark, d), "session", 2))


# -- reductions ----------------------------------------------------------------------------------------------

@query(f"with {E3} select trial, channel, label, round(avg(value), 6) + 0.0 as value from e3 group by 1, 2, 3")
def average_time(spark, d):
    return cells(reduce.Average("time").transform(tables.cube(spark, d)), "label")


@query(f"with {E3} select channel, round(avg(value), 6) + 0.0 as value from e3 group by 1")
def average_multi(spark, d):
    return cells(reduce.Average(["trial", "time"]).transform(tables.cube(spark, d)))


@query(f"with {EV} select trial, channel, round(avg(value) + 1e-9, 6) + 0.0 as value from ev group by 1, 2")
def average_missing(spark, d):
    return cells(reduce.Average("time").transform(tables.events(spark, d)).map_value(lambda v: v + 1e-9))


@query(f"with {E2} select feature, round(avg(value), 6) + 0.0 as mean, round(stddev_pop(value), 6) + 0.0 as std, count(value) as n from e2 group by 1")
def statistics(spark, d):
    return reduce.statistics(tables.vectors(spark, d), "feature").select("feature", r6("mean").alias("mean"), r6("std").alias("std"), "n")


@query(f"with {E2} select label, feature, round(avg(value), 6) + 0.0 as value from e2 group by 1, 2")
def class_means(spark, d):
    return reduce.class_means(tables.vectors(spark, d), "label", "trial").select("label", "feature", r6(VALUE).alias(VALUE))


@query(f"with {S2} select session, label, count(*) as n from s group by 1, 2")
def class_counts(spark, d):
    return reduce.class_counts(tables.vectors(spark, d), "label", "trial", "session")


@query(f"with {E3} select a.channel, b.channel as other, round(covar_samp(a.value, b.value), 6) + 0.0 as cov, count(*) as n from e3 a join e3 b on a.trial = b.trial and a.time = b.time and a.channel <= b.channel group by 1, 2")
def covariance_matrix(spark, d):
    return reduce.covariance(tables.cube(spark, d), "channel").select("channel", "other", r6("cov").alias("cov"), "n")


# -- reshaping -----------------------------------------------------------------------------------------------

@query(f"with {E3} select trial, channel * 8 + time as pos, {V} from e3")
def flatten(spark, d):
    out = reshape.Flatten(["channel", "time"]).transform(tables.cube(spark, d)).cells
    flat = F.col("flat_channel__time")
    return out.select("trial", (flat["channel"] * 8 + flat["time"]).cast("long").alias("pos"), r6(VALUE).alias(VALUE))


@query(f"with {E3} select trial, channel, time, label, {V} from e3")
def unflatten_roundtrip(spark, d):
    pair = compose.Pipeline("there and back", [reshape.Flatten(["channel", "time"]), reshape.Unflatten("flat_channel__time")])
    return cells(pair.transform(tables.cube(spark, d)), "label")


@query(f"with {E3} select trial as sample, channel as electrode, time, {V} from e3")
def rename_dims(spark, d):
    return cells(reshape.RenameDims({"trial": "sample", "channel": "electrode"}).transform(tables.cube(spark, d)))


@query(f"with {E3} select time, trial, channel, {V} from e3")
def transpose(spark, d):
    return cells(reshape.Transpose(["time", "trial", "channel"]).transform(tables.cube(spark, d)))


@query("select vec_id as trial, label, len(embedding) as n, round(list_sum(list_transform(embedding, lambda x: x::double)), 6) + 0.0 as total from embeddings")
def dense_layout(spark, d):
    out = tables.vectors(spark, d).dense("trial")
    return out.select("trial", "label", F.size("features").cast("long").alias("n"), r6(F.aggregate("features", F.lit(0.0), lambda a, x: a + x)).alias("total"))


@query(f"with {EV} select t.trial, c.channel, d.time, round(ev.value, 6) + 0.0 as value from (select distinct trial from ev) t cross join (select distinct channel from ev) c cross join (select distinct time from ev) d left join ev on ev.trial = t.trial and ev.channel = c.channel and ev.time = d.time")
def complete_missing(spark, d):
    return cells(tables.events(spark, d).complete("trial"))


# -- normalisation and cleaning ------------------------------------------------------------------------------

@query(f"with {E3} select trial, channel, time, round(value - avg(value) over (partition by channel), 6) + 0.0 as value from e3")
def demean_channel(spark, d):
    return cells(normalize.Demean("channel").transform(tables.cube(spark, d)))


@query(f"with {E3} select trial, channel, time, round((value - avg(value) over w) / nullif(stddev_pop(value) over w, 0), 6) + 0.0 as value from e3 window w as (partition by trial)")
def zscore_trial(spark, d):
    return cells(normalize.ZScore("trial").transform(tables.cube(spark, d)))


@query(f"with {EV} select trial, channel, time, round((value - avg(value) over w) / nullif(stddev_pop(value) over w, 0), 6) + 0.0 as value from ev window w as (partition by trial, channel)")
def zscore_missing(spark, d):
    return cells(normalize.ZScore(["trial", "channel"]).transform(tables.events(spark, d)))


@query(f"with {E3}, st as (select channel, avg(value) as m, stddev_pop(value) as sd from e3 where session < 2 group by 1) select trial, e3.channel, time, round((value - m) / nullif(sd, 0), 6) + 0.0 as value from e3 join st on e3.channel = st.channel where session >= 2")
def zscore_channel_fit(spark, d):
    cube = tables.cube(spark, d)
    z = normalize.ZScore("channel", use_fit=True).fit(cube.where(F.col("session") < 2))
    return cells(z.transform(cube.where(F.col("session") >= 2)))


@query(f"with {E3}, st as (select channel, avg(value) as m, stddev_pop(value) as sd from e3 where label in (0, 1) group by 1) select trial, e3.channel, time, round((value - m) / nullif(sd, 0), 6) + 0.0 as value from e3 join st on e3.channel = st.channel")
def zscore_fit_sel(spark, d):
    return cells(normalize.ZScore("channel", fit_sel={"label": [0, 1]}).fit_transform(tables.cube(spark, d)))


@query(f"with {E3}, st as (select channel, time, avg(value) as m from e3 where session = 0 group by 1, 2) select trial, e3.channel, e3.time, round(value - m, 6) + 0.0 as value from e3 join st on e3.channel = st.channel and e3.time = st.time")
def demean_fit_multi(spark, d):
    return cells(normalize.Demean(["channel", "time"], fit_sel={"session": 0}).fit_transform(tables.cube(spark, d)))


@query(f"with {E3}, st as (select channel, avg(value) as m, stddev_pop(value) as sd from e3 group by 1) select trial, e3.channel, time, round(greatest(m - 1.5 * sd, least(m + 1.5 * sd, value)), 6) + 0.0 as value from e3 join st on e3.channel = st.channel")
def remove_outliers(spark, d):
    return cells(normalize.RemoveOutliers("channel", 1.5).transform(tables.cube(spark, d)))


@query(f"with {E3} select trial, channel, time, round(value - avg(value) over (partition by trial, time), 6) + 0.0 as value from e3")
def car(spark, d):
    return cells(normalize.CommonAverage().transform(tables.cube(spark, d)))


@query(f"with {E3} select trial, channel, time, round(case when channel in (0, 7) then value else value - avg(case when channel not in (0, 7) then value end) over (partition by trial, time) end, 6) + 0.0 as value from e3")
def car_excluded(spark, d):
    return cells(normalize.CommonAverage(excluded_channels=[0, 7]).transform(tables.cube(spark, d)))


@query(f"with {E3}, r as (select trial, time, value as x from e3 where channel = 3), p as (select e3.*, x from e3 join r on e3.trial = r.trial and e3.time = r.time), f as (select channel, regr_slope(value, x) as b, regr_intercept(value, x) as a from p group by 1) select trial, p.channel, time, round(case when p.channel in (3, 7) then value else value - (a + b * x) end, 6) + 0.0 as value from p join f on p.channel = f.channel")
def regress_out_reference(spark, d):
    return cells(normalize.RegressOutReference(3, excluded_channels=[7]).transform(tables.cube(spark, d)))


# -- unions --------------------------------------------------------------------------------------------------

@query(f"with {E3}, m as (select trial, channel, avg(value) as value from e3 group by 1, 2) select trial, 'mean_' || channel as feature, {V} from m union all select trial, 'last_' || channel, {V} from e3 where time = 7")
def union_branches(spark, d):
    branches = [("mean", reduce.Average("time")), ("last", select.Identity(sel={"time": 7}))]
    return cells(compose.Union(branches, ["channel", "channel"]).transform(tables.cube(spark, d)))


@query(f"with {E2} select trial, 'identity_' || feature as feature, {V} from e2 union all select trial, 'demean_' || feature, round(value - avg(value) over (partition by feature), 6) + 0.0 from e2")
def union_with_input(spark, d):
    return cells(compose.UnionWithInput(normalize.Demean("feature"), "feature").transform(tables.vectors(spark, d)))


@query(f"with {E3} select trial, channel, time, round(case when session = 1 then value - avg(value) over (partition by session, channel) else value end, 6) + 0.0 as value from e3")
def switch_optional(spark, d):
    cube = tables.cube(spark, d)
    a = compose.Optional(normalize.Demean("channel"), use=True).transform(cube.where(F.col("session") == 1))
    b = compose.Switch([("demean", normalize.Demean("channel")), ("identity", select.Identity())], choose="identity").transform(cube.where(F.col("session") != 1))
    return cells(a).unionByName(cells(b))


# -- weights and sampling ------------------------------------------------------------------------------------

@query(f"with {S2} select trial, case label when 0 then 2.0 when 3 then 0.5 else 1.0 end::double as w from s")
def sample_weight_map(spark, d):
    out = weights.SampleWeight("label", weight_map={0: 2.0, 3: 0.5}).transform(tables.vectors(spark, d))
    return out.samples("trial").select("trial", F.col("sample_weight").alias("w"))


@query(f"with {S2} select trial, round(1.0::double / count(*) over (partition by label), 6) as w from s")
def balance_class(spark, d):
    out = weights.BalanceClassWeight("label").transform(tables.vectors(spark, d))
    return out.samples("trial").select("trial", F.round("sample_weight", 6).alias("w"))


@query(f"with {S2}, x as (select *, count(*) over (partition by session, label) as n, count(*) over (partition by session) as nd, (select count(distinct session) from s) as d from s) select trial, round(1.0::double / d / nd / n, 9) as w from x")
def balance_domain(spark, d):
    out = weights.BalanceClassWeight("label", balance_domains=True, domain_coord="session").transform(tables.vectors(spark, d))
    return out.samples("trial").select("trial", F.round("sample_weight", 9).alias("w"))


@query(f"with {S2}, c as (select session, count(distinct label) as k from s group by 1), x as (select s.*, count(*) over (partition by s.session, label) as n, k from s join c on s.session = c.session), w as (select trial, 0.25::double / k / n as w from x) select trial, round(w / (select avg(w) from w), 6) as w from w")
def balance_domain_totals_mean(spark, d):
    out = weights.BalanceClassWeight("label", balance_domains=True, domain_coord="session", normalize_domain_totals=True, weight_normalize="mean").transform(tables.vectors(spark, d))
    return out.samples("trial").select("trial", F.round("sample_weight", 6).alias("w"))


@query("select vec_id as trial from embeddings order by md5('0:' || vec_id), vec_id limit 50")
def trial_sampler(spark, d):
    return sampling.TrialSampler(50).transform(tables.vectors(spark, d)).cells.select("trial").distinct()


@query(f"with {S2} select trial, label from (select *, row_number() over (partition by label order by md5('3:' || trial), trial) as r from s) where r <= 7")
def stratified_sample(spark, d):
    return sampling.stratified_sample(tables.vectors(spark, d), "label", 7, seed=3).cells.select("trial", "label").distinct()


@query(f"with {S2} select trial, label from (select *, row_number() over (partition by label order by md5('0:' || trial), trial) as r, count(*) over (partition by label) as n from s) where r <= greatest(1, floor(n * 0.3))")
def sample_by_fraction(spark, d):
    return sampling.sample_fraction(tables.vectors(spark, d), "label", 0.3).cells.select("trial", "label").distinct()


@query(f"with {S2} select trial, r <= round(n * 0.2) as test from (select *, row_number() over (partition by label order by md5('0:' || trial), trial) as r, count(*) over (partition by label) as n from s)")
def train_test_split(spark, d):
    train, test = sampling.train_test_split(tables.vectors(spark, d), "label", 0.2)
    return train.samples("trial").select("trial", F.lit(False).alias("test")).unionByName(test.samples("trial").select("trial", F.lit(True).alias("test")))


# -- folds ---------------------------------------------------------------------------------------------------

def _folds_sql(rows: str, key: str, seed: int = 0, k: int = 5) -> str:
    return f"off as ({rows.replace('select *', f'select {key} as key, count(*) as n')} group by 1), offs as (select key, sum(n) over (order by key) - n as off from off), fold as (select x.*, ((row_number() over (partition by x.{key} order by md5('{seed}:' || trial), trial) - 1 + off) % {k})::int as fold from ({rows}) x join offs on x.{key} = offs.key)"


FOLDS = f"{S2}, {_folds_sql('select * from s', 'label')}"


@query(f"with {FOLDS} select trial, fold from fold")
def kfold_assign(spark, d):
    return cv.KFold(5, stratify_coord="label").folds(tables.vectors(spark, d))


NULLED = "s as (select vec_id as trial, case when vec_id % 5 = 0 then null else label end as label from embeddings), off as (select label, count(*) as n from s group by 1), offs as (select label, sum(n) over (order by label nulls first) - n as off from off)"


@query(f"with {NULLED} select trial, ((row_number() over (partition by s.label order by md5('0:' || trial), trial) - 1 + off) % 5)::int as fold from s join offs on s.label is not distinct from offs.label")
def kfold_null_label(spark, d):
    frame = tables.vectors(spark, d)
    nulled = frame.cells.withColumn("label", F.when(F.col("trial") % 5 != 0, F.col("label")))
    return cv.KFold(5, stratify_coord="label").folds(LabeledFrame(nulled, frame.dims, frame.coords))


@query(f"with {S2}, h as (select *, row_number() over (partition by label order by md5('0:' || trial), trial) <= round(count(*) over (partition by label) * 0.2) as held from s), {_folds_sql('select * from h where not held', 'label')} select trial, fold from fold union all select trial, -1 from h where held")
def holdout_assign(spark, d):
    return cv.KFold(5, stratify_coord="label", test_size=0.2).folds(tables.vectors(spark, d))


@query(f"with s as (select vec_id as trial, (vec_id % 4) || '_' || label as key from embeddings), {_folds_sql('select * from s', 'key', k=3)} select trial, fold from fold")
def grouped_kfold(spark, d):
    return cv.GroupedKFold("session", n_splits=3, stratify_coord="label").folds(tables.vectors(spark, d))


@query("select vec_id as trial, case when label in (8, 9) then -1 else label end as fold from embeddings")
def leave_group_out(spark, d):
    return cv.LeaveGroupOut("label", test_group_ids=[8, 9]).folds(tables.vectors(spark, d))


@query("with g as (select label, row_number() over (order by md5('0:' || label), label) - 1 as place from (select distinct label from embeddings)) select vec_id as trial, case when place < 4 then place // 4 else 1 + (place - 4) // 3 end::int as fold from embeddings join g using (label)")
def leave_group_out_chunks(spark, d):
    return cv.LeaveGroupOut("label", n_splits=3).folds(tables.vectors(spark, d))


@query(f"with s as (select vec_id as trial, label, vec_id % 4 as session from embeddings), {_folds_sql('select * from s where session > 1', 'label')}, t as (select trial, label, fold from fold union all select trial, label, -2 from s where session <= 1) select trial from t where fold = -2 union all select trial from (select *, row_number() over (partition by label order by md5('0:' || trial), trial) as r from t where fold >= 0 and fold <> 1) where r <= 3")
def sampled_domain_train(spark, d):
    v = cv.SampledDomainKFold("session", [2, 3], [0, 1], "label", default_samples_per_label=3)
    frame = tables.vectors(spark, d)
    return v.train_samples(frame.samples("trial").join(v.folds(frame), "trial"), 1)


# -- groups --------------------------------------------------------------------------------------------------

@query(f"with {E3} select trial, channel, time, round((value - avg(value) over w) / nullif(stddev_pop(value) over w, 0), 6) + 0.0 as value from e3 window w as (partition by session, channel)")
def group_zscore(spark, d):
    return cells(compose.GroupApply("session", normalize.ZScore("channel")).transform(tables.cube(spark, d)))


@query(f"with {E3}, x as (select * from e3 where label < 3) select trial, channel, time, round(value - avg(value) over (partition by session, label, time), 6) + 0.0 as value from x")
def group_multi_key(spark, d):
    return cells(compose.GroupApply(["session", "label"], normalize.Demean("time")).transform(tables.cube(spark, d).where(F.col("label") < 3)))


def _unseen(spark: SparkSession, d: str, policy: str) -> DataFrame:
    cube = tables.cube(spark, d)
    g = compose.GroupApply("session", normalize.Demean("channel", use_fit=True), unseen_policy=policy)
    return cells(g.fit(cube.where((F.col("session") < 2) | ((F.col("session") == 2) & (F.col("trial") < 100)))).transform(cube.where(F.col("session") == 3)))


_UNSEEN = "with " + E3 + ", f as (select * from e3 where session < 2 or (session = 2 and trial < 100)), st as (select session, channel, avg(value) as m, count(distinct trial)::double as n from f group by 1, 2), c as (select channel, {} as m from st group by 1) select trial, e3.channel, time, round(value - m, 6) + 0.0 as value from e3 join c on e3.channel = c.channel where session = 3"


@query(_UNSEEN.format("avg(m)"))
def unseen_average(spark, d):
    return _unseen(spark, d, "average")


@query(_UNSEEN.format("sum(m * n) / sum(n)"))
def unseen_weighted(spark, d):
    return _unseen(spark, d, "weighted_average")


# -- cross-validation ----------------------------------------------------------------------------------------

OOF = f"""{E2}, {FOLDS},
z as (select trial, feature, (value - avg(value) over w) / nullif(stddev_pop(value) over w, 0) as value from e2 window w as (partition by trial)),
zf as (select z.*, f.label, f.fold from z join fold f on z.trial = f.trial),
ps as (select fold, label, feature, sum(value) as s, count(value) as n from zf group by 1, 2, 3),
tot as (select label, feature, sum(s) as s, sum(n) as n from ps group by 1, 2),
mu as (select k.fold, t.label, t.feature, (t.s - coalesce(p.s, 0)) / nullif(t.n - coalesce(p.n, 0), 0) as m from (select distinct fold from ps) k cross join tot t left join ps p on p.fold = k.fold and p.label = t.label and p.feature = t.feature),
dist as (select zf.trial, zf.fold, zf.label as truth, mu.label as cand, sum((value - m) * (value - m)) as far from zf join mu on zf.fold = mu.fold and zf.feature = mu.feature group by 1, 2, 3, 4),
oof as (select trial, fold, truth, cand as prediction from (select *, row_number() over (partition by trial order by far, cand) as r from dist where far is not null) where r = 1)"""
PER_CLASS = "cl as (select {by} c as class, sum(tp) as tp, sum(sup) as support, sum(pred) as predicted from (select {by} truth as c, (truth = prediction)::int as tp, 1 as sup, 0 as pred from {t} union all select {by} prediction, 0, 0, 1 from {t}) group by all)"


def centroid_oof_frame(spark: SparkSession, d: str) -> DataFrame:
    z = normalize.ZScore("trial").transform(tables.vectors(spark, d))
    folds = cv.KFold(5, stratify_coord="label").folds(z)
    marked = LabeledFrame(z.cells.join(folds, "trial"), z.dims, {**z.coords, "fold": "trial"})
    return cv.nearest_mean_oof(marked, "label")


@query(f"with {OOF} select trial, fold, truth, prediction from oof")
def centroid_cv_oof(spark, d):
    return centroid_oof_frame(spark, d).select("trial", "fold", F.col("label").alias("truth"), "prediction")


@query(f"with {OOF}, {PER_CLASS.format(by='fold,', t='oof')} select fold, round(sum(support * 2.0::double * tp / (support + predicted)) / sum(support), 6) as score from cl group by 1")
def centroid_cv_scores(spark, d):
    return scoring.score_table("f1_weighted", centroid_oof_frame(spark, d), "label", ["fold"]).select("fold", F.round("score", 6).alias("score"))


@query(f"with {OOF} select truth, prediction, count(*) as n, round(count(*) / sum(count(*)) over (partition by truth)::double, 6) as share from oof group by 1, 2")
def confusion_matrix(spark, d):
    return scoring.normalised(scoring.confusion(centroid_oof_frame(spark, d), "label")).withColumn("share", F.round("share", 6))


@query(f"with {OOF}, {PER_CLASS.format(by='', t='oof')} select round(sum(support * 2.0::double * tp / (support + predicted)) / sum(support), 6) as f1_weighted, round(avg(2.0::double * tp / (support + predicted)), 6) as f1_macro, round(sum(tp)::double / sum(support), 6) as f1_micro, sum(support)::bigint as n from cl")
def f1_weighted_macro_micro(spark, d):
    return scoring.classification(centroid_oof_frame(spark, d), "label").select(*[F.round(c, 6).alias(c) for c in ("f1_weighted", "f1_macro", "f1_micro")], "n")


@query(f"with {OOF}, {PER_CLASS.format(by='fold,', t='oof')}, f as (select fold, sum(support * 2.0::double * tp / (support + predicted)) / sum(support) as s from cl group by 1), clp as (select class, sum(tp) as tp, sum(support) as support, sum(predicted) as predicted from cl group by 1) select round(0.75 * (select avg(s) from f) + 0.25 * (select sum(support * 2.0::double * tp / (support + predicted)) / sum(support) from clp), 6) as score")
def score_blend(spark, d):
    validator = cv.KFold(5, stratify_coord="label", pooled_score_weight=0.25)
    pipeline = compose.Pipeline("centroid", [normalize.ZScore("trial"), predict.NearestMean(target_coord="label")])
    result = cv.CrossValidator(validator, "f1_weighted").cross_validate(pipeline, tables.vectors(spark, d))
    return spark.createDataFrame([(round(result.score, 6),)], "score double")


_PAIRS = "p as (select o_orderkey as trial, o_totalprice as truth, 150000 + (o_orderkey % 1000) * 10.0::double as prediction, o_orderstatus as g from orders)"


@query(f"with {_PAIRS} select g, round(1 - avg((truth - prediction) ** 2) / var_pop(truth), 6) + 0.0 as r2, round(-sqrt(avg((truth - prediction) ** 2)), 4) as neg_rmse, round(-avg(abs(truth - prediction)), 4) as neg_mae, count(*) as n from p group by 1")
def regression_metrics(spark, d):
    o = tables.read_table(spark, d, "orders").select(F.col("o_totalprice").alias("truth"), (150000 + (F.col("o_orderkey") % 1000) * 10.0).alias("prediction"), F.col("o_orderstatus").alias("g"))
    return scoring.regression(o, "truth", ["g"]).select("g", r6("r2").alias("r2"), F.round("neg_rmse", 4).alias("neg_rmse"), F.round("neg_mae", 4).alias("neg_mae"), "n")


_MULTI = "m as (select (c_acctbal > 0)::int as a, (c_nationkey % 3 = 0)::int as b, (c_acctbal > 1000)::int as pa, (c_custkey % 3 = 0)::int as pb from customer)"


@query(f"with {_MULTI} select round(avg(case when a + b + pa + pb = 0 then 0 else 2.0::double * (a * pa + b * pb) / (a + b + pa + pb) end), 6) as f1_samples, round((2.0::double * sum(a * pa) / (sum(a) + sum(pa)) + 2.0::double * sum(b * pb) / (sum(b) + sum(pb))) / 2, 6) as f1_macro, round(2.0::double * sum(a * pa + b * pb) / sum(a + b + pa + pb), 6) as f1_micro, round(-avg((a <> pa)::int + (b <> pb)::int) / 2, 6) as neg_hamming, round(avg((a = pa and b = pb)::int), 6) as subset_accuracy from m")
def multilabel_metrics(spark, d):
    c = tables.read_table(spark, d, "customer").select((F.col("c_acctbal") > 0).alias("a"), (F.col("c_nationkey") % 3 == 0).alias("b"), (F.col("c_acctbal") > 1000).alias("pa"), (F.col("c_custkey") % 3 == 0).alias("pb"))
    out = scoring.multilabel(c, ["a", "b"], ["pa", "pb"])
    return out.select(*[F.round(x, 6).alias(x) for x in out.columns])


@query("with t as (select l_returnflag as g, l_discount as score, sum((l_tax > 0.04)::int) as tp, count(*) as n from lineitem group by 1, 2), c as (select g, tp, sum(tp) over w as above, sum(n) over w as seen, sum(tp) over (partition by g) as total from t window w as (partition by g order by score desc rows unbounded preceding)) select g, round(sum(above::double / seen * tp / total), 6) as ap from c group by 1")
def average_precision(spark, d):
    rows = tables.read_table(spark, d, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_discount").alias("score"), (F.col("l_tax") > 0.04).cast("int").alias("truth"))
    return scoring.average_precision(rows, "truth", "score", ["g"]).select("g", F.round("ap", 6).alias("ap"))


_LABELS = "m as (select c_custkey as k, (c_acctbal > 0)::int as y0, (c_nationkey % 3 = 0)::int as y1, c_acctbal::double as s0, (c_custkey % 50)::double * 200 as s1 from customer), l as (select k, 0 as label, y0 as y, s0 as s from m union all select k, 1, y1, s1 from m)"


def _ap_sql(by: str) -> str:
    keys = f"{by}," if by else ""
    part = f"partition by {by}" if by else ""
    return f"(select {by or '0'} as g, coalesce(sum(above::double / seen * tp / nullif(total, 0)), 0) as ap from (select {keys} tp, sum(tp) over ({part} order by s desc rows unbounded preceding) as above, sum(n) over ({part} order by s desc rows unbounded preceding) as seen, sum(tp) over ({part}) as total from (select {keys} s, sum(y) as tp, count(*) as n from l group by all)) group by 1)"


@query(f"with {_LABELS} select round((select avg(ap) from {_ap_sql('label')}), 6) as ap_macro, round((select ap from {_ap_sql('')}), 6) as ap_micro, round((select avg(ap) from {_ap_sql('k')}), 6) as ap_samples")
def multilabel_average_precision(spark, d):
    c = tables.read_table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") > 0).alias("y0"), (F.col("c_nationkey") % 3 == 0).alias("y1"), F.col("c_acctbal").alias("s0"), ((F.col("c_custkey") % 50) * 200.0).alias("s1"))
    out = scoring.multilabel_average_precision(c, "c_custkey", ["y0", "y1"], ["s0", "s1"])
    return out.select(*[F.round(x, 6).alias(x) for x in out.columns])


@query(f"with {OOF}, c as (select fold, truth, prediction, count(*) as n from oof group by 1, 2, 3), sh as (select truth, prediction, n / sum(n) over (partition by fold, truth)::double as share from c) select truth, prediction, round(sum(share) / 5, 6) as mean, round(sqrt(greatest(sum(share * share) / 5 - (sum(share) / 5) ** 2, 0)) / sqrt(5::double), 6) as sem from sh group by 1, 2")
def confusion_over_folds(spark, d):
    out = scoring.combined_confusion(scoring.confusion(centroid_oof_frame(spark, d), "label", ["fold"]), "fold")
    return out.select("truth", "prediction", F.round("mean", 6).alias("mean"), F.round("sem", 6).alias("sem"))


@query(f"with {E3}, x as (select * from e3 where session = 0 or (session = 1 and channel < 6)) select trial, channel, time, round(value - avg(value) over (partition by session, channel), 6) + 0.0 as value from x where channel < 6")
def group_cut_to_min(spark, d):
    cube = tables.cube(spark, d).where((F.col("session") == 0) | ((F.col("session") == 1) & (F.col("channel") < 6)))
    return cells(compose.GroupApply("session", normalize.Demean("channel"), unequal_output_dims="cut_to_min").transform(cube))


@query("select event_type, count(*) as n from events where event_type <> 'view' and user_id % 7 = 0 group by 1")
def scoring_filter_events(spark, d):
    e = tables.read_table(spark, d, "events").withColumn("time_offset_ms", F.col("user_id") % 7).withColumn("event_type", F.when(F.col("event_type") == "view", "intertrial").otherwise(F.col("event_type")))
    return cv.KFold(exclude_intertrial=True, exclude_time_offset=True).scored(e).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("select coalesce(event_type, '-') as event_type, count(*) as n from (select case when event_type = 'click' then null when event_type = 'view' then 'intertrial' else event_type end as event_type, case when user_id % 7 = 1 then null else user_id % 7 end as t from events) where event_type is distinct from 'intertrial' and (t = 0 or t is null) group by 1")
def scoring_filter_null(spark, d):
    e = tables.read_table(spark, d, "events")
    kind = F.when(F.col("event_type") == "click", None).when(F.col("event_type") == "view", "intertrial").otherwise(F.col("event_type"))
    offset = F.when(F.col("user_id") % 7 != 1, F.col("user_id") % 7)
    scored = cv.KFold(exclude_intertrial=True, exclude_time_offset=True).scored(e.select(kind.alias("event_type"), offset.alias("time_offset_ms")))
    return scored.groupBy(F.coalesce("event_type", F.lit("-")).alias("event_type")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {E2}, {FOLDS}, x as (select e2.trial, value as x, e2.label::double as y, fold from e2 join fold f on e2.trial = f.trial where feature = 0), b as (select k.fold, covar_pop(x, y) * count(*) / (var_pop(x) * count(*) + 1) as b, avg(x) as mx, avg(y) as my from x join (select distinct fold from x) k on x.fold <> k.fold group by 1) select trial, x.fold, round(my + b * (x - mx), 6) + 0.0 as prediction from x join b on x.fold = b.fold")
def ridge_single_feature_cv(spark, d):
    frame = tables.vectors(spark, d).where(F.col("feature") == 0)
    pipeline = compose.Pipeline("ridge", [select.Identity(), predict.Ridge(target_coord="label", alpha=1.0)])
    result = cv.CrossValidator(cv.KFold(5, stratify_coord="label"), "r2").cross_validate(pipeline, frame)
    return result.predictions.select("trial", "fold", r6("prediction").alias("prediction"))


# -- ensembles -----------------------------------------------------------------------------------------------

def _opinions(spark: SparkSession, d: str) -> DataFrame:
    """Three members' class probabilities, from an order's number and price."""
    o = tables.read_table(spark, d, "orders").select(F.col("o_orderkey").alias("trial"), F.explode(F.array(*[F.struct(F.lit(m).alias("member"), F.lit(w).alias("weight"), (F.col("o_orderkey") * (m + 1) % 7 + 1).cast("double").alias("a"), (F.col("o_custkey") * (m + 2) % 5 + 1).cast("double").alias("b")) for m, w in ((0, 0.5), (1, 0.3), (2, 0.2))])).alias("m")).select("trial", "m.*")
    p = F.array(F.col("a") / (F.col("a") + F.col("b") + 2), F.col("b") / (F.col("a") + F.col("b") + 2), F.lit(2.0) / (F.col("a") + F.col("b") + 2))
    return o.withColumn("probability", p).withColumn("prediction", predict.argmax("probability").cast("int")).select("trial", "member", "weight", "prediction", "probability")


_OPINIONS = """o as (select o_orderkey as trial, m as member, w::double as weight, (o_orderkey * (m + 1) % 7 + 1)::double as a, (o_custkey * (m + 2) % 5 + 1)::double as b from orders, (values (0, 0.5), (1, 0.3), (2, 0.2)) v(m, w)),
op as (select trial, member, weight, a / (a + b + 2) as p0, b / (a + b + 2) as p1, 2 / (a + b + 2) as p2 from o),
pr as (select *, case when p0 >= p1 and p0 >= p2 then 0 when p1 >= p2 then 1 else 2 end as prediction from op),
mp as (select trial, sum(weight * p0) as q0, sum(weight * p1) as q1, sum(weight * p2) as q2 from pr group by 1)"""


@query(f"with {_OPINIONS}, v as (select trial, prediction, sum(weight) as w from pr group by 1, 2) select trial, prediction from (select *, row_number() over (partition by trial order by round(w, 9) desc, prediction) as r from v) where r = 1")
def ensemble_vote(spark, d):
    o = _opinions(spark, d).drop("probability")
    return compose.combine(o, ["trial"])


@query(f"with {_OPINIONS} select trial, round(q0 / (q0 + q1 + q2), 6) as p0, round(q1 / (q0 + q1 + q2), 6) as p1, round(q2 / (q0 + q1 + q2), 6) as p2 from mp")
def ensemble_proba(spark, d):
    out = compose.mean_probability(_opinions(spark, d), ["trial"])
    return out.select("trial", *[F.round(F.col("probability")[i], 6).alias(f"p{i}") for i in range(3)])


@query(f"with {_OPINIONS}, h as (select trial, sum(weight * -(p0 * ln(p0 + 1e-10) + p1 * ln(p1 + 1e-10) + p2 * ln(p2 + 1e-10))) as al from pr group by 1) select trial, round(al, 6) + 0.0 as aleatoric, round(-(q0 * ln(q0 + 1e-10) + q1 * ln(q1 + 1e-10) + q2 * ln(q2 + 1e-10)) - al, 6) + 0.0 as epistemic from mp join h using (trial)")
def ensemble_uncertainty(spark, d):
    return compose.uncertainty(_opinions(spark, d), ["trial"]).select("trial", r6("aleatoric").alias("aleatoric"), r6("epistemic").alias("epistemic"))


@query(f"with {_OPINIONS}, l as (select trial, 0 as class, p0 as p from pr union all select trial, 1, p1 from pr union all select trial, 2, p2 from pr) select trial, class, round(avg(p), 6) as mean, round(stddev_pop(p), 6) as std from l group by 1, 2")
def ensemble_std(spark, d):
    return compose.spread(_opinions(spark, d), ["trial"]).select("trial", "class", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(f"with {_OPINIONS} select trial, round(sum(weight * prediction), 6) + 0.0 as prediction from pr group by 1")
def ensemble_regression(spark, d):
    return compose.combine(_opinions(spark, d).drop("probability"), ["trial"], regression=True).select("trial", r6("prediction").alias("prediction"))


# -- grid ----------------------------------------------------------------------------------------------------

@query(f"with {G8} select a.trial, (a.channel // 8) * 7 + a.channel % 8 as feature, round((a.value + b.value + c.value + e.value) / 4, 6) + 0.0 as value from g a join g b on a.trial = b.trial and b.channel = a.channel + 1 join g c on a.trial = c.trial and c.channel = a.channel + 8 join g e on a.trial = e.trial and e.channel = a.channel + 9 where a.channel % 8 < 7 and a.channel < 56")
def window_mean_pyramid(spark, d):
    return cells(spatial.WindowMeanPyramid(spatial.square_layout(8, 8)).transform(tables.grid(spark, d)))


_SIDES = "n as (select trial, channel, value, unnest([case when channel % 8 = 0 then channel else channel - 1 end, case when channel % 8 = 7 then channel else channel + 1 end, case when channel < 8 then channel else channel - 8 end, case when channel >= 56 then channel else channel + 8 end]) as other from g)"


@query(f"with {G8}, {_SIDES} select n.trial, n.channel, round(any_value(n.value) - avg(o.value), 6) + 0.0 as value from n join g o on n.trial = o.trial and n.other = o.channel group by 1, 2")
def laplacian_csd(spark, d):
    return cells(spatial.LaplacianCSD(spatial.square_layout(8, 8)).transform(tables.grid(spark, d)))


@query(f"with {G8}, m as (select trial, channel, case when (trial + channel) % 5 = 0 then null else value end as value from g) select a.trial, a.channel, round(coalesce(any_value(a.value), avg(b.value)), 6) + 0.0 as value from m a join m b on a.trial = b.trial and a.channel <> b.channel and abs(a.channel // 8 - b.channel // 8) <= 1 and abs(a.channel % 8 - b.channel % 8) <= 1 group by 1, 2")
def fill_nan_neighbors(spark, d):
    g = tables.grid(spark, d).map_value(lambda v: F.when((F.col("trial") + F.col("channel")) % 5 != 0, v))
    return cells(spatial.FillNeighbours(spatial.square_layout(8, 8)).transform(g))


@query()
def gaussian_pyramid(spark, d):
    return cells(spatial.GaussianPyramid(spatial.square_layout(8, 8), levels=2, keep_only_top=False).transform(tables.grid(spark, d)))


@query()
def local_zca(spark, d):
    return cells(spatial.LocalZCA(spatial.square_layout(8, 8), radius=1.5).fit_transform(tables.grid(spark, d)))


# -- projections ---------------------------------------------------------------------------------------------

@query()
def global_pca(spark, d):
    return cells(linear.FeaturePCA(n_components=4).fit_transform(tables.cube(spark, d)), "label")


@query()
def zca_white(spark, d):
    return cells(linear.GlobalZCA(pca_frac_to_keep=1.0).fit_transform(tables.cube(spark, d)))


@query(f"with {E3} select channel, (select count(distinct (trial, time)) from e3 where not (trial % 5 = 0 and time = 0)) as n, count(*) as cells from e3 group by 1")
def zca_missing(spark, d):
    """Channels keep their labels; a sample that lacks a cell is null in all of them."""
    lacking = (F.col("trial") % 5 == 0) & (F.col("channel") == 0) & (F.col("time") == 0)
    out = linear.GlobalZCA(pca_frac_to_keep=1.0).fit_transform(tables.cube(spark, d).where(~lacking)).cells
    return out.groupBy("channel").agg(F.count(VALUE).alias("n"), F.count(F.lit(1)).alias("cells"))


@query()
def coloring(spark, d):
    return cells(linear.GlobalColoring(n_components=3).fit_transform(tables.cube(spark, d)))


@query()
def pca_reconstruction(spark, d):
    return cells(linear.ReconstructionPCA(n_components=4).fit_transform(tables.cube(spark, d)))


@query()
def lda_projection(spark, d):
    return cells(linear.LDAProjection("label", shrinkage=0.1).fit_transform(tables.vectors(spark, d)))


@query()
def nearest_centroid_projection(spark, d):
    return cells(linear.NearestCentroidProjection("label").fit_transform(tables.vectors(spark, d)))


# -- predictors ----------------------------------------------------------------------------------------------

@query()
def lda_predict(spark, d):
    frame = tables.vectors(spark, d)
    return predict.LDA(target_coord="label", shrinkage=0.2).fit(frame).predict(frame).select("trial", "prediction", r6(F.array_max("probability")).alias("top"))


@query()
def ridge_multi(spark, d):
    frame = tables.vectors(spark, d)
    return predict.Ridge(target_coord=["label", "session"]).fit(frame).predict(frame).select("trial", r6("prediction__label").alias("label"), r6("prediction__session").alias("session"))


@query()
def logistic_cv(spark, d):
    from pyspark.ml.classification import LogisticRegression

    p = compose.Pipeline("logistic", [normalize.ZScore("trial"), predict.SparkPredictor(LogisticRegression, {"maxIter": 10, "regParam": 0.01}, target_coord="label")])
    return cv.CrossValidator(cv.KFold(3, stratify_coord="label")).cross_validate(p, tables.vectors(spark, d)).predictions.select("trial", "fold", "label", "prediction")


@query()
def gbt_early_stop(spark, d):
    frame = tables.document_measures(spark, d)
    model = predict.BoostedTrees({"maxIter": 8, "maxDepth": 3}, target_coord="quality")
    return model.fit(frame).predict(frame).select("trial", "quality", "prediction")


@query()
def multi_output(spark, d):
    frame = tables.vectors(spark, d)
    model = predict.MultiOutput(predict.Ridge(), target_coord=["label", "session"])
    return model.fit(frame).predict(frame).select("trial", r6("prediction__label").alias("label"), r6("prediction__session").alias("session"))


@query()
def ensemble_fit(spark, d):
    frame = tables.vectors(spark, d)
    members = [("lda", predict.LDA(target_coord="label", shrinkage=0.3)), ("sharp", predict.LDA(target_coord="label", shrinkage=0.05), 2.0)]
    return compose.Ensemble(members, target_coord="label").fit(frame).predict_with_uncertainty(frame).select("trial", r6("aleatoric").alias("aleatoric"), r6("epistemic").alias("epistemic"))


# -- signals -------------------------------------------------------------------------------------------------

@query()
def bandpass(spark, d):
    return cells(spectral.Bandpass(30, 90, fs=250).transform(tables.long_cube(spark, d)))


@query()
def multitaper_bands(spark, d):
    t = spectral.MultiTaper(250, time_halfbandwidth_product=2.5, num_time_windows=2, n_fft=128, avg_within_freq_bands=True, avg_over_time_windows=True, freq_ranges={"low": (2, 30), "high": (30, 100)})
    return cells(t.transform(tables.long_cube(spark, d)))


@query()
def hilbert_phase(spark, d):
    t = spectral.HilbertPhase(500, step_ms=10, bands={"mid": (40, 80), "high": (80, 160), "top": (160, 200)})
    return cells(t.transform(tables.long_cube(spark, d)))


@query()
def hilbert_relative(spark, d):
    t = spectral.HilbertPhase(500, mode="relative_average", start_ms=10, end_ms=50, bands={"mid": (40, 80), "high": (80, 160), "top": (160, 200)})
    return cells(t.transform(tables.long_cube(spark, d)))


@query(f"with {E2} select trial, feature, label, round((value - avg(value) over w) / nullif(stddev_pop(value) over w, 0), 6) + 0.0 as value from e2 window w as (partition by trial)")
def stream_zscore(spark, d):
    batch = tables.read_table(spark, d, "embeddings")
    stream = spark.readStream.schema(batch.schema).parquet(f"{d}/embeddings.parque[t]").select(F.col("vec_id").alias("trial"), "label", "embedding")  # a pattern may name a file or a folder
    return inference.run_once(stream, "trial", "embedding", "feature", ["label"], lambda f: cells(normalize.ZScore("trial").transform(f), "label"))


# -- alignment -----------------------------------------------------------------------------------------------

@query(f"with {E2}, c as (select session, feature, avg(value) as c from e2 group by 1, 2) select e2.session, label, e2.feature, round(avg(value) - any_value(c), 6) + 0.0 as value from e2 join c on e2.session = c.session and e2.feature = c.feature group by 1, 2, 3")
def procrustes_class_means(spark, d):
    centred = compose.GroupApply("session", normalize.Demean("feature")).transform(tables.vectors(spark, d))
    out = centred.cells.groupBy("session", "label", "feature").agg(F.avg(VALUE).alias(VALUE))
    return out.select("session", "label", "feature", r6(VALUE).alias(VALUE))


def _aligned(make: Callable[[], align._Aligner]) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        frame = tables.vectors(spark, d).where(F.col("feature") < 12)
        pairs = frame.where(F.col("session") < 2) if make().pairs_only else frame
        return cells(make().fit_transform(pairs), "session")

    return run


for _name, _make in {
    "procrustes": lambda: align.Procrustes(target_group=0, target_coord="label"),
    "coral": lambda: align.Coral(target_group=0),
    "subspace_align": lambda: align.SubspaceAlignment(target_group=0, n_components=5),
    "cca": lambda: align.CCA(target_coord="label", n_components=4),
    "mcca": lambda: align.MCCA(target_coord="label", n_components=4),
    "gcca": lambda: align.GCCA(target_coord="label", n_components=4),
    "kcca": lambda: align.KCCA(target_coord="label", n_components=4, kernel="rbf"),
    "jda": lambda: align.JDA(target_coord="label", n_components=5),
}.items():
    _QUERIES[_name] = _aligned(_make)


# -- tuning --------------------------------------------------------------------------------------------------

@query()
def tune_grid(spark, d):
    p = compose.Pipeline("ridge", [normalize.ZScore("trial"), predict.Ridge(target_coord="label")])
    t = tune.Tuner(p, cv.KFold(3), {"ridge": {"alpha": [0.1, 10.0, 1000.0]}}, tables.vectors(spark, d), "r2", sampler="grid", enqueue_initial=False)
    t.tune()
    return t.runs(spark).select("number", "pipeline", F.col("params")["ridge__alpha"].alias("alpha"), r6("score").alias("score"), "state")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Five-fold stratified nearest-class-mean on z-scored vectors: weighted F1 by fold."""
    return centroid_cv_scores(spark, d)
