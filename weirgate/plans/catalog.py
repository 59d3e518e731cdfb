"""Every operator as a named query over the given tables.

All flow tables are derived from the whole of ``events`` (see ``views``), so each
query's work grows with that table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weirgate.functions import cleaning, rules
from weirgate.operators import (
    capture, evaluate, features, knn, medians, naive_bayes, profile, sampling, smote, state, svm, trees, voting,
)
from weirgate.plans import training, views
from weirgate.schemas import CATEGORICAL, FLOW_FEATURES, MODEL_NAMES, NUMERIC
from weirgate.sources import flow_files, flow_json
from weirgate.streaming import live
from weirgate.streaming import state as stream_state
from weirgate.workspace import cut_lineage, scratch

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, Query] = {}

# A point in time inside the data, block lifetimes that suit its
# sparse arrivals, and the features used by the neighbour queries.
MARK_US = 1_705_363_200_000_000
IDLE_SECONDS, HARD_SECONDS = 6 * 3600, 12 * 3600
NEAR_FEATURES = ["flow_duration_sec", "packet_count", "byte_count"]
ROW_CAP = 5000
TOP_K = 12


def query(fn: Query) -> Query:
    CATALOG[f"q_{fn.__name__.removesuffix('_rows')}"] = fn
    return fn


def sig(c, digits: int = 9):
    """Rounded to significant digits, for values of any magnitude."""
    return F.format_string(f"%.{digits - 1}e", c).cast("double")


def _votes() -> dict:
    return {m: F.col(m) for m in MODEL_NAMES}


def _literal():
    return voting.weighted_vote(_votes(), views.WEIGHTS)


def _normalized():
    return voting.weighted_vote(_votes(), views.WEIGHTS, normalize=True)


# Sources and sinks


@query
def csv_roundtrip(spark, sf):
    path = scratch(spark, "csv")
    flow_files.write_csv(views.flow_features(views.events(spark, sf)), path)
    return cleaning.infinities_to_null(flow_files.read_csv(spark, path, FLOW_FEATURES))


@query
def csv_encodings(spark, sf):
    """Files in two encodings read as one table."""
    path = scratch(spark, "encodings")
    flows = views.flow_features(views.events(spark, sf)).withColumn("flags", F.concat(F.lit("é"), "flags"))
    flow_files.write_csv(flows.filter("flow_id % 2 = 0"), path)
    flows.filter("flow_id % 2 = 1").write.mode("append").options(
        header=True, nullValue="NULL", encoding="ISO-8859-1").csv(path)
    return flow_files.read_csv_any_encoding(spark, path, FLOW_FEATURES).select("flow_id", "flags", "ip_src")


@query
def null_sentinel(spark, sf):
    raw = views.flow_stats_raw(views.events(spark, sf))
    written = raw.select(
        "flow_id", F.coalesce(F.col("in_port").cast("string"), F.lit("NULL")).alias("in_port"),
        "eth_src", "eth_dst")
    return written.select(
        "flow_id", cleaning.nullable_int(cleaning.null_text(F.col("in_port"))).alias("in_port"),
        cleaning.null_text(F.col("eth_src")).alias("eth_src"),
        cleaning.null_text(F.col("eth_dst")).alias("eth_dst"))


@query
def json_flows(spark, sf):
    flows = flow_json.parse_flows(views.flow_json(views.events(spark, sf)))
    return flows.select(
        "dpid", "poll_id", "position", F.try_element_at("match", F.lit("in_port")).alias("in_port"),
        F.try_element_at("match", F.lit("eth_src")).alias("eth_src"),
        F.try_element_at("match", F.lit("eth_dst")).alias("eth_dst"), "packet_count", "byte_count")


@query
def json_switches(spark, sf):
    return flow_json.parse_switches(views.switch_lists(views.events(spark, sf)))


@query
def archive_union(spark, sf):
    flows = views.flow_stats(views.events(spark, sf))
    root = scratch(spark, "archive")
    for i, part in enumerate((F.col("time_us") <= MARK_US, F.col("time_us") > MARK_US)):
        flow_files.create_if_absent(spark, f"{root}/live{i}", flows.schema)
        flow_files.append(flows.filter(part), f"{root}/live{i}")
        flow_files.archive(spark, f"{root}/live{i}", f"{root}/old", f"{root}/live{i + 1}", flows.schema)
    return flow_files.read_archive(spark, f"{root}/old", flows.schema)


# Projections, filters, rules


@query
def flow_project(spark, sf):
    return capture.flow_records(views.match_maps(views.events(spark, sf)))


@query
def label_union(spark, sf):
    entries = views.match_maps(views.events(spark, sf))
    return capture.labelled_union(capture.normal_capture(entries), capture.attack_capture(entries))


@query
def attack_capture(spark, sf):
    rows = capture.attack_capture(views.match_maps(views.events(spark, sf)))
    reply = Window.partitionBy("poll", "dpid").orderBy("in_port", "eth_dst", "flow_id")
    return rows.withColumn("position", F.row_number().over(reply))


@query
def drop_null_label(spark, sf):
    return cleaning.drop_unlabelled(views.flow_features(views.events(spark, sf))).select("flow_id", "label")


@query
def feature_columns(spark, sf):
    df = cleaning.drop_unlabelled(views.flow_features(views.events(spark, sf)))
    return cleaning.infinities_to_null(cleaning.keep_features(cleaning.drop_identifiers(df)))


@query
def inf_to_null(spark, sf):
    df = views.flow_features(views.events(spark, sf)).select("flow_id", *NUMERIC)
    return cleaning.infinities_to_null(df)


@query
def missing_columns(spark, sf):
    df = views.flow_features(views.events(spark, sf)).select("flow_id", "packet_count", "flags")
    return cleaning.add_missing(df, NUMERIC, CATEGORICAL)


@query
def fill_unknown(spark, sf):
    df = views.flow_features(views.events(spark, sf)).select("flow_id", *CATEGORICAL)
    return cleaning.fill_categories(df, CATEGORICAL)


@query
def rule_high_volume(spark, sf):
    c = F.col
    return views.flow_stats(views.events(spark, sf)).select(
        "flow_id", rules.high_volume(c("packets"), c("bytes"), c("duration_sec")).alias("high_volume"))


@query
def rule_long_connection(spark, sf):
    return views.flow_stats(views.events(spark, sf)).select(
        "flow_id", rules.long_connection(F.col("duration_sec")).alias("long_connection"))


@query
def rule_invalid_mac(spark, sf):
    return views.flow_stats(views.events(spark, sf)).select("flow_id", *[
        rules.invalid_mac(F.col(c), mode).alias(f"{c}_{mode}")
        for c in ("eth_src", "eth_dst") for mode in ("literal", "repeated_octet")])


@query
def rules_split(spark, sf):
    judged = rules.judge(views.flow_stats(views.events(spark, sf)))
    route = F.when(F.col("blocked"), "block").otherwise("store")
    return judged.select("flow_id", "dpid", "in_port", "eth_src", "eth_dst", "packets", "bytes", "duration_sec",
                         route.alias("route"), F.array_join("reasons", ",").alias("reasons"))


@query
def rule_reasons(spark, sf):
    """Which flows would be blocked and why: rows per switch and reason."""
    judged = rules.judge(views.flow_stats(views.events(spark, sf)))
    return judged.select("dpid", "bytes", F.explode("reasons").alias("reason")).groupBy("dpid", "reason").agg(
        F.count(F.lit(1)).alias("flows"), F.sum("bytes").alias("bytes"))


@query
def high_water(spark, sf):
    return cleaning.newer_than(views.flow_stats(views.events(spark, sf)), MARK_US).select("flow_id", "time_us")


@query
def flagged_flows(spark, sf):
    voted = views.voted_flows(views.events(spark, sf)).withColumn("prediction", _literal())
    return voted.filter("prediction = 1").select("flow_id", "dpid", "in_port", "eth_src", "eth_dst", "prediction")


@query
def drop_lldp(spark, sf):
    return cleaning.drop_lldp(views.packets(views.events(spark, sf))).select("packet_id", "ethertype")


@query
def dpid_format(spark, sf):
    return views.flow_stats(views.events(spark, sf)).select(
        "flow_id", cleaning.dpid_decimal(F.col("dpid")).alias("dpid_decimal"),
        cleaning.dpid_hex(F.col("dpid")).alias("dpid_hex"))


@query
def live_features(spark, sf):
    return cleaning.live_features(views.flow_stats(views.events(spark, sf))).select(
        "flow_id", *NUMERIC, *CATEGORICAL)


# Joins and state


def _flagged(ev: DataFrame) -> DataFrame:
    return views.voted_flows(ev).withColumn("verdict", _normalized()).filter("verdict = 1")


@query
def block_candidates(spark, sf):
    ev = views.events(spark, sf)
    return state.block_candidates(_flagged(ev), state.active_switches(views.switch_state(ev))).select(
        "flow_id", "dpid", "in_port", "eth_src", "eth_dst")


@query
def unblockable(spark, sf):
    ev = views.events(spark, sf)
    return state.unblockable(_flagged(ev), state.active_switches(views.switch_state(ev))).select(
        "flow_id", "dpid", "in_port", "reason")


@query
def mac_asof(spark, sf):
    return state.mac_lookup(views.packets(views.events(spark, sf))).select(
        "packet_id", "dpid", "eth_dst", "out_port")


@query
def mac_table(spark, sf):
    return state.mac_table(views.packets(views.events(spark, sf)))


@query
def active_switches(spark, sf):
    return state.latest_state(views.switch_state(views.events(spark, sf)))


def _sightings(ev: DataFrame) -> DataFrame:
    return _flagged(ev).filter("dpid IS NOT NULL AND in_port IS NOT NULL")


@query
def block_episodes(spark, sf):
    return state.block_episodes(_sightings(views.events(spark, sf)), IDLE_SECONDS, HARD_SECONDS)


@query
def effective_action(spark, sf):
    ev = views.events(spark, sf)
    flows = views.flow_stats(ev).filter("dpid IS NOT NULL AND in_port IS NOT NULL")
    episodes = state.block_episodes(_sightings(ev), IDLE_SECONDS, HARD_SECONDS)
    return state.effective_action(flows, episodes, views.packets(ev))


# Votes and scores


@query
def vote_literal(spark, sf):
    return views.model_votes(views.events(spark, sf)).select("flow_id", "y", _literal().alias("verdict"))


@query
def vote_normalized(spark, sf):
    return views.model_votes(views.events(spark, sf)).select("flow_id", "y", _normalized().alias("verdict"))


@query
def model_counts(spark, sf):
    return voting.model_counts(views.model_votes(views.events(spark, sf)), MODEL_NAMES)


@query
def verdict_summary(spark, sf):
    return voting.verdict_summary(
        views.model_votes(views.events(spark, sf)).withColumn("verdict", _normalized()))


@query
def accuracy(spark, sf):
    return evaluate.round_all(evaluate.accuracy(views.model_votes(views.events(spark, sf)), MODEL_NAMES), 9)


@query
def confusion(spark, sf):
    return evaluate.confusion(views.model_votes(views.events(spark, sf)), "decision_tree")


@query
def class_report(spark, sf):
    return evaluate.round_all(
        evaluate.class_report(views.model_votes(views.events(spark, sf)), "decision_tree"), 9)


@query
def auc(spark, sf):
    flows = views.voted_flows(views.events(spark, sf)).select(
        "y", "duration_sec", voting.vote_share(_votes(), views.WEIGHTS).alias("vote_share"))
    parts = [
        evaluate.auc(flows, score).select(F.lit(score).alias("score"), F.round("auc", 9).alias("auc"),
                                          "positives", "negatives")
        for score in ("vote_share", "duration_sec")
    ]
    return parts[0].unionByName(parts[1])


@query
def score_table(spark, sf):
    """The published comparison table, computed from votes instead of typed in."""
    return evaluate.round_all(evaluate.score_table(views.model_votes(views.events(spark, sf)), MODEL_NAMES))


@query
def score_long(spark, sf):
    return evaluate.score_long(score_table(spark, sf))


# Profiles


def _parsed(spark, sf) -> DataFrame:
    return flow_json.parse_flows(views.flow_json(views.events(spark, sf)))


@query
def field_freq(spark, sf):
    return profile.field_frequency(_parsed(spark, sf))


@query
def ip_fields(spark, sf):
    return profile.ip_fields(_parsed(spark, sf))


@query
def ethertype_dist(spark, sf):
    return profile.ethertypes(_parsed(spark, sf))


@query
def flows_per_switch(spark, sf):
    switches = flow_json.parse_switches(views.switch_lists(views.events(spark, sf)))
    return profile.flows_per_switch(switches, _parsed(spark, sf))


@query
def first_flows(spark, sf):
    return profile.first_flows(_parsed(spark, sf))


@query
def profile_summary(spark, sf):
    switches = flow_json.parse_switches(views.switch_lists(views.events(spark, sf)))
    return profile.summary(switches, _parsed(spark, sf))


# Sampling


@query
def class_counts(spark, sf):
    return views.flow_features(views.events(spark, sf)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query
def stratified_cap(spark, sf):
    return sampling.stratified_cap(views.flow_features(views.events(spark, sf)).select("flow_id", "label"))


@query
def row_cap(spark, sf):
    return sampling.row_cap(views.flow_features(views.events(spark, sf)).select("flow_id", "label"), ROW_CAP)


@query
def split(spark, sf):
    return views.flow_features(views.events(spark, sf)).select(
        "flow_id", sampling.is_test().alias("is_test"), sampling.fold(5).alias("fold"))


@query
def stratified_folds(spark, sf):
    return sampling.stratified_fold(views.flow_features(views.events(spark, sf)).select("flow_id", "label"), 5)


# Features


def _labelled(spark, sf) -> DataFrame:
    return views.flow_features(views.events(spark, sf)).filter("label IS NOT NULL")


def _numeric(spark, sf) -> DataFrame:
    return cleaning.infinities_to_null(_labelled(spark, sf).select("flow_id", "label", *NUMERIC), NUMERIC)


@query
def median(spark, sf):
    found = medians.exact_medians(_numeric(spark, sf), NUMERIC)
    return spark.createDataFrame([(c, found[c]) for c in NUMERIC], "feature string, median double")


def _numeric_model(spark, sf) -> features.FlowFeaturesModel:
    return features.FlowFeatures(categorical=[]).fit(_labelled(spark, sf))


@query
def scale_stats(spark, sf):
    model = _numeric_model(spark, sf)
    rows = [(c, model.means[c], model.stds[c]) for c in NUMERIC]
    table = spark.createDataFrame(rows, "feature string, mean double, deviation double")
    return table.select("feature", sig(F.col("mean")).alias("mean"), sig(F.col("deviation")).alias("deviation"))


@query
def categories(spark, sf):
    return features.categories(_labelled(spark, sf), CATEGORICAL)


@query
def impute(spark, sf):
    df = _numeric(spark, sf)
    found = medians.exact_medians(df, NUMERIC)
    return df.select("flow_id", *[F.coalesce(F.col(c), F.lit(found[c] or 0.0)).alias(c) for c in NUMERIC])


@query
def standardise(spark, sf):
    return evaluate.round_all(_numeric_model(spark, sf).long(_labelled(spark, sf)), 6)


@query
def one_hot(spark, sf):
    model = features.FlowFeatures(numeric=[]).fit(_labelled(spark, sf))
    return model.long(views.flow_features(views.events(spark, sf)))


@query
def anova_f(spark, sf):
    model = features.FlowFeatures().fit(_labelled(spark, sf))
    rows = [(f.name, f.score) for f in model.selected]
    return evaluate.round_all(spark.createDataFrame(rows, "feature string, f double"), 6)


@query
def select_k_best(spark, sf):
    model = features.FlowFeatures(k=TOP_K).fit(_labelled(spark, sf))
    rows = [(i + 1, f.name, f.score) for i, f in enumerate(model.selected)]
    return evaluate.round_all(spark.createDataFrame(rows, "position int, feature string, f double"), 6)


@query
def features_long(spark, sf):
    df = _labelled(spark, sf)
    return evaluate.round_all(features.FlowFeatures(k=TOP_K).fit(df).long(df), 6)


@query
def features_score(spark, sf):
    """Fit on the training table, transform live rows that lack most columns."""
    model = features.FlowFeatures(k=TOP_K).fit(_labelled(spark, sf))
    flows = cleaning.live_features(views.flow_stats(views.events(spark, sf)))
    return evaluate.round_all(model.long(flows), 6)


# Models


def _near_rows(spark, sf) -> DataFrame:
    df = _labelled(spark, sf)
    model = features.FlowFeatures(numeric=NEAR_FEATURES, categorical=[]).fit(df)
    return model.transform(df).select("flow_id", "label", "x")


@query
def knn_predict(spark, sf):
    rows = _near_rows(spark, sf)
    train = knn.training_rows(sampling.stratified_cap(rows))
    model = knn.KnnModel(train, knn.class_labels(train), 5, "uniform", 2)
    return model.transform(rows).select("flow_id", F.col("label").alias("y"), "prediction")


@query
def knn_grid(spark, sf):
    train = cut_lineage(knn.training_rows(sampling.stratified_cap(_near_rows(spark, sf))))
    return evaluate.round_all(knn.grid_search(train, knn.LIVE_GRID, folds=3), 9)


@query
def gnb_predict(spark, sf):
    df = _labelled(spark, sf)
    rows = _numeric_model(spark, sf).transform(df)
    return naive_bayes.fit(rows).transform(rows).select("flow_id", F.col("label").alias("y"), "prediction")


@query
def gnb_grid(spark, sf):
    rows = _numeric_model(spark, sf).transform(_labelled(spark, sf))
    found = naive_bayes.grid_search(rows, folds=5)
    return evaluate.round_all(spark.createDataFrame(found, "smoothing double, accuracy double"), 9)


@query
def smote_rows(spark, sf):
    made = smote.smote(_near_rows(spark, sf))
    return made.select("base_id", "copy", "neighbor_id", "label", *[
        F.round(F.element_at("x", i + 1), 6).alias(f"x{i + 1}") for i in range(len(NEAR_FEATURES))])


def _prepared(spark, sf, **options) -> training.Prepared:
    return training.prepare(views.flow_features(views.events(spark, sf)), **options)


def _score_with(spark, sf, trainers: dict) -> DataFrame:
    """Train on the capped sample, score every flow of the table."""
    prepared = _prepared(spark, sf)
    models, _ = training.train_all(spark, prepared, trainers=trainers)
    scored = training.predict_all(views.flow_features(views.events(spark, sf)), models, list(trainers))
    return scored.select("flow_id", "label", *trainers)


@query
def rf(spark, sf):
    return _score_with(spark, sf, {"random_forest": training.LIVE["random_forest"]})


@query
def dt(spark, sf):
    return _score_with(spark, sf, {"decision_tree": training.LIVE["decision_tree"]})


@query
def svm_linear(spark, sf):
    return _score_with(spark, sf, {"svm": lambda p: training._train_svm(p, kernel="linear")})


@query
def svm_rbf(spark, sf):
    return _score_with(spark, sf, {"svm": training.LIVE["svm"]})


@query
def dt_grid(spark, sf):
    """The offline tree grid on the capped sample."""
    prepared = _prepared(spark, sf)
    _, scores = trees.tune_tree(prepared.balanced, 5, id_col="id", parallelism=8, stratified=True)
    rows = [(c["impurity"], c["maxDepth"], c["minSamplesSplit"], c["minInstancesPerNode"], float(a)) for c, a in scores]
    return spark.createDataFrame(rows, "impurity string, max_depth int, min_split int, min_rows int, accuracy double")


@query
def svm_grid(spark, sf):
    """The offline kernel grid on the capped sample."""
    prepared = _prepared(spark, sf)
    scores = svm.grid_search(prepared.balanced.select("id", "label", "x"), 5, id_col="id")
    rows = [(s["kernel"], float(s["C"]), s["gamma"], float(a)) for s, a in scores]
    return spark.createDataFrame(rows, "kernel string, c double, gamma string, accuracy double")


@query
def train_all(spark, sf):
    _, status = training.train_all(spark, _prepared(spark, sf), scratch(spark, "models"),
                                   {**training.LIVE, **training.NAIVE_BAYES})
    return status


@query
def predict_all(spark, sf):
    """Train, save, load, score every live row with every model, vote."""
    ev = views.events(spark, sf)
    models = training.load_or_train(spark, scratch(spark, "models"), lambda: views.flow_features(ev))
    scored = training.predict_all(cleaning.live_features(views.flow_stats(ev)), models)
    verdict = voting.weighted_vote(_votes(), training.weights(models))
    return scored.select("flow_id", *MODEL_NAMES, verdict.alias("verdict"))


@query
def rule_models(spark, sf):
    """Models trained, saved, loaded and applied to every flow; the label is a known rule of two categories."""
    flows = views.flow_features(views.events(spark, sf)).select(
        "flow_id", "flags", "ip_proto",
        ((F.coalesce("flags", F.lit("")) == "S") != (F.col("ip_proto") == 17)).cast("int").alias("label"))
    trainers = {**training.LIVE, "decision_tree": lambda p: training._tune_tree(p, 3)}
    models = training.load_or_train(spark, scratch(spark, "models"), lambda: flows, trainers)
    scored = training.predict_all(flows.drop("label"), models)
    verdict = voting.weighted_vote(_votes(), training.weights(models))
    return scored.select("flow_id", *MODEL_NAMES, verdict.alias("verdict"))


@query
def rule_kernel(spark, sf):
    """The exact RBF machine, trained, saved, loaded and applied to every flow, on the rule of two categories."""
    flows = views.flow_features(views.events(spark, sf)).select(
        "flow_id", "flags", "ip_proto",
        ((F.coalesce("flags", F.lit("")) == "S") != (F.col("ip_proto") == 17)).cast("int").alias("label"))
    models = training.load_or_train(spark, scratch(spark, "models"), lambda: flows, {"svm": training.train_kernel})
    return training.predict_all(flows.drop("label"), models, ["svm"]).select("flow_id", "svm")


@query
def rule_linear(spark, sf):
    """The linear machine and the counts of what was trained, on a label that one category decides."""
    flows = views.flow_features(views.events(spark, sf)).select(
        "flow_id", "flags", "ip_proto", (F.coalesce("flags", F.lit("")) == "S").cast("int").alias("label"))

    def fail(_):
        raise ValueError("not a model")

    trainers = {"svm": lambda p: training._train_svm(p, kernel="linear"), "broken": fail}
    models, status = training.train_all(spark, training.prepare(flows), trainers=trainers)
    counted = training.trained_count(status).first().asDict()
    scored = training.predict_all(flows.drop("label"), models, ["svm"])
    return scored.select("flow_id", "svm", *[F.lit(n).cast("bigint").alias(name) for name, n in counted.items()])


# Streams


def _stream(spark, sf) -> DataFrame:
    """The events table as a stream: its file arrives as one poll."""
    schema = StructType.fromDDL(views.EVENTS_SCHEMA)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def _judged(df: DataFrame) -> DataFrame:
    return df.select("flow_id", "dpid", "blocked", F.array_join("reasons", ",").alias("reasons"))


@query
def stream_rules(spark, sf):
    root = scratch(spark, "stream")
    run = live.judge_to(views.flow_stats(_stream(spark, sf)), f"{root}/out", f"{root}/checkpoint", None)
    run.awaitTermination()
    return _judged(spark.read.parquet(f"{root}/out"))


@query
def stream_restart(spark, sf):
    """Polls land in two steps with a restart in between; every row comes out once."""
    root = scratch(spark, "polls")
    flows = views.flow_stats(views.events(spark, sf))
    for part in (F.col("time_us") > MARK_US, F.col("time_us") <= MARK_US):
        flow_files.write_csv(flows.filter(part), f"{root}/landed", mode="append")
        polls = live.read_polls(spark, f"{root}/landed", flows.schema, max_files=4)
        live.judge_to(polls, f"{root}/out", f"{root}/checkpoint", None).awaitTermination()
    return _judged(spark.read.parquet(f"{root}/out"))


@query
def stream_verdicts(spark, sf):
    """The live pipeline with fixed votes: blocked flows with their cause."""
    root = scratch(spark, "live")

    pipeline = live.LivePipeline(
        views.add_votes, views.WEIGHTS, lambda: state.active_switches(views.switch_state(views.events(spark, sf))),
        root, normalize=True)
    pipeline.start(views.flow_stats(_stream(spark, sf)), f"{root}/checkpoint", None).awaitTermination()
    return pipeline.read(spark, "blocks").select("flow_id", "dpid", "in_port", "eth_src", "eth_dst", "cause")


@query
def stream_switches(spark, sf):
    root = scratch(spark, "switches")
    registry = stream_state.switch_registry(views.switch_state(_stream(spark, sf)))
    stream_state.upsert(registry, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return stream_state.current(spark, f"{root}/out", ["dpid"]).select("dpid", "state")


@query
def stream_mac_table(spark, sf):
    root = scratch(spark, "macs")
    learned = stream_state.learned_addresses(views.packets(_stream(spark, sf)))
    stream_state.upsert(learned, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return stream_state.current(spark, f"{root}/out", ["dpid", "mac"]).select("dpid", "mac", "in_port")


STREAM_POLLS = 3


@query
def stream_block_episodes(spark, sf):
    """All episodes, those still open included, from sightings that land in several polls."""
    root = scratch(spark, "episodes")
    found = _sightings(views.events(spark, sf))
    span = F.col("time_us") % STREAM_POLLS  # every poll holds sightings of all times
    for poll in range(STREAM_POLLS):
        found.filter(span == poll).write.mode("append").parquet(f"{root}/landed")
        stream = spark.readStream.schema(found.schema).parquet(f"{root}/landed")
        bins = stream_state.block_sightings(stream, IDLE_SECONDS, HARD_SECONDS, "3650 days")
        stream_state.upsert(bins, f"{root}/out", f"{root}/checkpoint/").awaitTermination()
    return stream_state.block_episodes(spark, f"{root}/out", IDLE_SECONDS, HARD_SECONDS)
