"""Named queries: one per operator, over the given tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgauge.caching import keep
from corpusgauge.functions import decision, formats, geometry, hashing
from corpusgauge.operators import (
    audit,
    bootstrap,
    calibration,
    classifiers,
    dedupe,
    detections,
    history,
    ledger,
    limits,
    manifest,
    metrics,
    ordering,
    pixels,
    reports,
    robustness,
    saliency,
    selection,
    test_sets,
)
from corpusgauge.plans import views as v
from corpusgauge.session import work_folder
from corpusgauge.sources import files, tables
from corpusgauge.streaming import limits as stream_limits
from corpusgauge.streaming import progress as stream_ledger
from corpusgauge.streaming import verdicts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

HEAD_WEIGHTS = (0.5, -1.0, 1.5, -2.0)
HEAD_GAMMA = (1.0, 0.5, 2.0, 1.5)
PROBE_WEIGHTS = tuple((k % 7 - 3) / 10 for k in range(64))
MODELS = ("m0", "m1", "m2", "m9")
META_COLUMNS = ("width", "height", "file_size_kb", "jpeg_quality_est")


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r(name: str | Column, digits: int = 6) -> Column:
    """Rounded, and never -0.0."""
    col = F.col(name) if isinstance(name, str) else name
    return F.round(col, digits) + F.lit(0.0)


def rounded(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    return df.withColumns({c: r(c, digits) for c in columns})


def set_counts(spark: SparkSession, sf: str, extra: Sequence[str] = ()) -> DataFrame:
    """Score counts per test set, folded before the sets are built."""
    folded = test_sets.build_test_sets(keep(test_sets.compact_scores(v.scored(spark, sf), extra=extra)))
    return metrics.score_counts(folded, [*extra, "test_set"], n=F.col("n"))


def auc_spread(spark: SparkSession, sf: str) -> DataFrame:
    """Smallest and largest AUC of each model and set over four hash shares of the items."""
    rows = v.scored(spark, sf).withColumn("share", hashing.stable_mod(F.col("item_id"), 61, 4))
    folded = test_sets.build_test_sets(keep(test_sets.compact_scores(rows, extra=["model", "share"])))
    keys = ["model", "share", "test_set"]
    counts = metrics.score_counts(folded, keys, n=F.col("n"))
    found = metrics.ranking_metrics(metrics.curve(counts, keys), keys)
    return found.groupBy("model", "test_set").agg(F.min("roc_auc").alias("low"), F.max("roc_auc").alias("high"))


def model_report(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.full_report(set_counts(spark, sf, ["model"]), ["model", "test_set"], v.THRESHOLD)


# --- sources and sinks -------------------------------------------------------------------------


@query
def discover_files(spark: SparkSession, sf: str) -> DataFrame:
    """Specs from both folder layouts of a listing."""
    paths = v.listed_paths(spark, sf)
    main = files.layout_specs(paths.filter("layout = 'split'"), "140k", "split", {"real": "ffhq", "fake": "stylegan"})
    return main.unionByName(files.layout_specs(paths.filter("layout = 'external'"), "crossgen"))


@query
def scan_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return files.scan_bytes(v.file_bytes(spark, sf)).select("page_id", "sha256", "file_size", "format", "read_error")


@query
def sniff_format(spark: SparkSession, sf: str) -> DataFrame:
    return v.file_bytes(spark, sf).select("page_id", formats.sniff_format(F.col("content")).alias("format"))


@query
def read_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest written below a folder of its own and read back, checked on both ends."""
    folder = work_folder(spark, "manifest")
    tables.write_manifest(v.manifest(spark, sf), folder)
    return tables.read_manifest(spark, folder)


@query
def manifest_lines(spark: SparkSession, sf: str) -> DataFrame:
    return tables.parse_manifest_lines(tables.manifest_lines(v.manifest(spark, sf)))


@query
def read_predictions(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.predictions(spark, sf).withColumn("processed_rel_path", F.concat(F.lit("out/"), "item_id"))
    first = rows.filter(F.col("model") == "m0")
    second = rows.withColumn("logit", F.col("logit") + 1.0)
    return tables.merge_predictions([first, second])


@query
def read_processed(spark: SparkSession, sf: str) -> DataFrame:
    rows = tables.processed_rows(v.ledger(spark, sf), ["train", "test"], ["140k"], fraction=0.5)
    return rows.select("dataset", "split", "label", "rel_path", "processed_rel_path")


@query
def read_progress_log(spark: SparkSession, sf: str) -> DataFrame:
    return tables.parse_progress(v.progress_log(spark, sf))


@query
def generation_log_status(spark: SparkSession, sf: str) -> DataFrame:
    events = v.table(spark, sf, "events")
    file = F.concat(F.lit("img_"), "user_id", F.lit("_"), "event_id", F.lit(".png"))
    log = events.select(
        F.col("event_id").alias("seq"),
        F.col("user_id").alias("index"),
        file.alias("file"),
        F.when(F.col("event_type") == "error", "degenerate").otherwise("ok").alias("status"),
    )
    there = log.filter(hashing.stable_mod(F.col("file"), 19, 3) > 0).select("file")
    return ledger.generation_status(log, there)


@query
def partitioned_sink(spark: SparkSession, sf: str) -> DataFrame:
    return tables.with_output_name(v.manifest(spark, sf)).select("rel_path", "processed_rel_path")


@query
def write_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.table(spark, sf, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max(F.lit(float("nan"))).alias("nothing")
    )
    return reports.report_json(rows)


@query
def metrics_document(spark: SparkSession, sf: str) -> DataFrame:
    """The document with a spread that SQL can follow in the interval's place; full_report_ci has bootstrap intervals."""
    rows = model_report(spark, sf).join(auc_spread(spark, sf), ["model", "test_set"], "left").select(
        "model",
        "test_set",
        "n",
        "roc_auc",
        F.col("low").alias("ci_low"),
        F.col("high").alias("ci_high"),
        *[F.col(f"tuned_{c}").alias(c) for c in ("balanced_accuracy", "precision", "recall_tpr", "f1", "fpr")],
        "ece",
    )
    return reports.metrics_document(rows, MODELS)


@query
def robustness_document(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.perturbed(spark, sf).filter(F.col("split") == "test")
    return reports.robustness_document(metrics.robustness_metrics(rows, ["model"], v.THRESHOLD), MODELS)


@query
def selection_document(spark: SparkSession, sf: str) -> DataFrame:
    return reports.selection_document(selection.select_model(v.model_summary(spark, sf)))


# --- expressions -------------------------------------------------------------------------------


@query
def validate_manifest(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.manifest(spark, sf)
    odd = F.when(F.col("format") == "unknown", "maybe").otherwise(F.col("label"))
    return manifest.validate_manifest(rows.unionByName(rows.withColumn("label", odd)))


@query
def validate_uploads(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.uploads(spark, sf)
    error = formats.upload_error(*[F.col(c) for c in ("file_size", "format", "width", "height", "num_faces")], max_bytes=8000)
    checked = rows.withColumn("error", error)
    return checked.select("page_id", "error", formats.upload_status(F.col("error")).alias("status"))


@query
def stable_hash(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("doc_id")
    return v.table(spark, sf, "documents").select(
        "doc_id",
        hashing.stable_hash(key, 42).cast("string").alias("h"),
        hashing.stable_uniform_int(key, 7, -5, 20).alias("drawn"),
    )


@query
def offline_quality(spark: SparkSession, sf: str) -> DataFrame:
    return v.manifest(spark, sf).select("rel_path", hashing.offline_quality(F.col("sha256")).alias("quality"))


@query
def resolve_paths(spark: SparkSession, sf: str) -> DataFrame:
    roots = manifest.parse_roots(["140k=/data/main", "crossgen=/data/cross"])
    return manifest.resolve_paths(v.manifest(spark, sf), roots).select("rel_path", "path")


@query
def metadata_features(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(
        audit.metadata_features(v.manifest(spark, sf), ["rel_path"]), ["aspect", "megapixels", "file_size_kb", "bytes_per_pixel"]
    )


@query
def jpeg_quality_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return v.quant_tables(spark, sf).select("item_id", formats.jpeg_quality_estimate(F.col("quant")).alias("quality"))


@query
def apply_calibration(spark: SparkSession, sf: str) -> DataFrame:
    return v.scored(spark, sf).select("item_id", r("prob").alias("prob"))


@query
def verdict(spark: SparkSession, sf: str) -> DataFrame:
    return v.scored(spark, sf).select("item_id", decision.verdict(F.col("prob"), v.THRESHOLD, v.DELTA).alias("verdict"))


@query
def outcome(spark: SparkSession, sf: str) -> DataFrame:
    return v.scored(spark, sf).select("item_id", decision.outcome(F.col("label"), F.col("prob"), v.THRESHOLD).alias("outcome"))


@query
def label_to_int(spark: SparkSession, sf: str) -> DataFrame:
    return v.predictions(spark, sf).select(
        "item_id",
        decision.label_to_int(F.col("label")).alias("y"),
        decision.group_label(F.col("source"), F.col("label")).alias("group"),
    )


@query
def detection_scale(spark: SparkSession, sf: str) -> DataFrame:
    scaled = geometry.detection_scale(F.col("image_width"), F.col("image_height"))
    rows = v.detections(spark, sf).select("image_id", scaled.alias("s"))
    return rows.select("image_id", r("s.scale").alias("scale"), F.col("s.width").alias("w"), F.col("s.height").alias("h"))


@query
def square_crop(spark: SparkSession, sf: str) -> DataFrame:
    box = [F.col(c) for c in ("x1", "y1", "x2", "y2", "image_width", "image_height")]
    rows = v.detections(spark, sf).select("image_id", geometry.square_crop(*box).alias("crop"))
    return rows.select("image_id", "crop.*")


@query
def scale_boxes(spark: SparkSession, sf: str) -> DataFrame:
    box = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    crop = geometry.scaled_crop(*box, F.lit(0.5), F.floor(F.col("image_width") / 2).cast("int"), F.floor(F.col("image_height") / 2).cast("int"))
    return v.detections(spark, sf).select("image_id", crop.alias("crop")).select("image_id", "crop.*")


@query
def result_faces(spark: SparkSession, sf: str) -> DataFrame:
    ranked = detections.rank_detections(v.detections(spark, sf), ties=("pos", "x1", "y1", "x2", "y2"))
    faces = detections.result_faces(ranked)
    text = F.transform(
        "faces", lambda f: F.concat(f["face_index"].cast("string"), F.lit(":"), F.concat_ws(",", F.transform(f["bbox"], lambda b: b.cast("string"))))
    )
    return faces.select("image_id", F.size("faces").alias("num_faces"), F.concat_ws(";", text).alias("faces"))


@query
def missing_features_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.manifest(spark, sf).select("rel_path", "width", "jpeg_quality_est", "read_error")
    return audit.complete_rows(rows, ["width", "jpeg_quality_est"])


@query
def constant_columns(spark: SparkSession, sf: str) -> DataFrame:
    rows = audit.complete_rows(v.manifest(spark, sf), ["width", "jpeg_quality_est"])
    return audit.constant_columns(rows, ["width", "height", "format", "mode", "jpeg_quality_est"])


@query
def degenerate_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.transform("embedding", lambda x: x.cast("double") * 24.0).alias("grey")
    )
    return rounded(audit.degenerate_filter(rows, "grey").select("item_id", "grey_std"), ["grey_std"])


# --- joins -------------------------------------------------------------------------------------


@query
def merge_specs_meta(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.manifest(spark, sf)
    specs = rows.select("rel_path", "dataset", "source", "label", "split")
    meta = rows.filter(F.col("read_error").isNull()).select("rel_path", "sha256", "format", "width", "height", "file_size")
    return manifest.merge_specs_meta(specs, meta)


@query
def near_duplicate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.near_duplicate_pairs(v.fingerprints(spark, sf), 4)


@query
def print_members(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.print_members(v.fingerprints(spark, sf))


@query
def bucket_guard(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.bucket_guard(v.fingerprints(spark, sf), 4, max_bucket=2)


@query
def annotate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    cells = dedupe.annotate_pairs(v.fingerprints(spark, sf), v.SPLITS)
    sides = [f"{c}_{t}" for t in "ij" for c in ("dataset", "split", "label")]
    return cells.select("print_i", "print_j", *sides, "phash_dist", "dhash_dist", "pairs", "cross_split", "label_conflict")


@query
def resolve_drops(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.resolve_drops(v.fingerprints(spark, sf), v.SPLITS)


@query
def exclude_dropped(spark: SparkSession, sf: str) -> DataFrame:
    drops = v.ledger(spark, sf).filter(F.col("status") == "duplicate_dropped")
    return ledger.exclude_dropped(v.manifest(spark, sf), drops).select("dataset", "split", "rel_path")


@query
def resume_todo(spark: SparkSession, sf: str) -> DataFrame:
    done = keep(tables.parse_progress(v.progress_log(spark, sf)))
    there = done.filter(hashing.stable_mod(F.col("processed_rel_path"), 31, 4) > 0)
    drops = v.ledger(spark, sf).filter(F.col("status") == "duplicate_dropped")
    todo = ledger.resume_todo(v.manifest(spark, sf), done, there, drops)
    return todo.select("dataset", "rel_path", "action")


@query
def ledger_for_manifest(spark: SparkSession, sf: str) -> DataFrame:
    done = tables.parse_progress(v.progress_log(spark, sf))
    return ledger.ledger_for_manifest(done, v.manifest(spark, sf))


@query
def join_latency(spark: SparkSession, sf: str) -> DataFrame:
    slow = ordering.exact_quantiles(v.latency(spark, sf), ["model"], ["sample_ms"], {"p95": 0.95})
    report = v.table(spark, sf, "events").groupBy(F.col("event_type").alias("model")).agg(F.count(F.lit(1)).alias("n"))
    measured = slow.filter(F.col("model") != "error")
    return rounded(selection.join_latency(report, measured), ["p95_latency_ms"])


@query
def owned_history(spark: SparkSession, sf: str) -> DataFrame:
    asked = v.history(spark, sf).select("id", F.when(F.col("num_faces") == 1, F.col("user_id")).otherwise(-1).alias("user_id"))
    return history.owned_history(v.history(spark, sf), asked).select("id", "user_id", "num_faces")


@query
def robustness_grid(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.predictions(spark, sf).filter(F.col("split").isin("test", "crossgen_full") | (F.col("dataset") == "crossgen"))
    return robustness.expand_grid(rows).select("item_id", "step", "family", "level")


# --- aggregations ------------------------------------------------------------------------------


@query
def summarize_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.summarize_manifest(v.manifest(spark, sf))


@query
def dedupe_report(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.dedupe_report(v.fingerprints(spark, sf), v.SPLITS)


@query
def borderline_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return dedupe.borderline_pairs(v.fingerprints(spark, sf), v.SPLITS)


@query
def import_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.manifest(spark, sf).select("source", "rel_path", "sha256", "format")
    held = rows.filter(F.col("format") == "png")
    return manifest.import_stats(rows, held, limit=20, seed=42)


@query
def class_balance(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.class_balance(v.manifest(spark, sf))


@query
def status_report(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ledger.status_report(v.ledger(spark, sf)), ["crop_clamped_rate", "multi_face_rate"])


@query
def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.status_counts(v.ledger(spark, sf))


@query
def status_rates(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(ledger.status_rates(v.ledger(spark, sf), ["source", "label"]), [f"{s}_rate" for s in ledger.STATUSES])


@query
def group_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    rows = audit.metadata_features(v.manifest(spark, sf), ["source", "label"])
    return rounded(audit.group_quantiles(rows, ["source", "label"], META_COLUMNS), ["p5", "p50", "p95"])


@query
def flag_rates(spark: SparkSession, sf: str) -> DataFrame:
    rows = audit.metadata_features(v.manifest(spark, sf), ["source", "label"])
    return rounded(audit.flag_rates(rows, ["source", "label"]), audit.FLAG_FEATURES)


@query
def clipped_histogram(spark: SparkSession, sf: str) -> DataFrame:
    rows = audit.metadata_features(v.manifest(spark, sf), ["label"])
    return rounded(audit.clipped_histogram(rows, ["label"], ["width", "file_size_kb"]), ["density"])


@query
def pixel_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pixels.pixel_stats(v.page_images(spark, sf), ["item_id"]), pixels.PIXEL_FEATURES)


@query
def image_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Shape and colour of each decoded picture (the part of the pixel features SQL can follow)."""
    images = v.page_images(spark, sf).select("item_id", "image.height", "image.width", "image")
    stats = pixels.pixel_stats(images, ["item_id", "height", "width"])
    colour = [c for c in pixels.PIXEL_FEATURES if c not in ("laplacian_var", "hf_energy_ratio")]
    return rounded(stats.select("item_id", "height", "width", *colour), colour)


@query
def mean_spectrum(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pixels.mean_spectrum(v.page_images(spark, sf), "source", 32), ["value"])


@query
def spectrum_counts(spark: SparkSession, sf: str) -> DataFrame:
    return pixels.spectrum_counts(v.page_images(spark, sf), "source", 32)


def channel_means(spark: SparkSession, sf: str) -> DataFrame:
    return v.feature_map(spark, sf).groupBy("c", "y", "x").agg(F.avg("a").alias("value"))


@query
def radial_profile(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pixels.radial_profile(channel_means(spark, sf), "c", 8), ["value"])


@query
def spectrum_diff(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pixels.spectrum_diff(channel_means(spark, sf), "c", 8, 0), ["upper_half_log_power", "mean_abs_diff"])


@query
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion(set_counts(spark, sf), ["test_set"], v.THRESHOLD)


@query
def threshold_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.threshold_metrics(set_counts(spark, sf), ["test_set"], v.THRESHOLD), list(metrics.rates()))


@query
def roc_curve(spark: SparkSession, sf: str) -> DataFrame:
    points = metrics.curve(set_counts(spark, sf), ["test_set"])
    return rounded(metrics.roc_curve(points, ["test_set"]), ["threshold", "fpr", "tpr"])


@query
def ranking_metrics(spark: SparkSession, sf: str) -> DataFrame:
    points = metrics.curve(set_counts(spark, sf), ["test_set"])
    return rounded(metrics.ranking_metrics(points, ["test_set"]), ["roc_auc", "pr_auc", "tpr_at_fpr"])


@query
def ece(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.ece(set_counts(spark, sf), ["test_set"]), ["ece"])


@query
def reliability_bins(spark: SparkSession, sf: str) -> DataFrame:
    table = metrics.reliability_bins(set_counts(spark, sf), ["test_set"])
    return rounded(table, ["bin_low", "bin_high", "mean_prob", "frac_positive"])


@query
def brier(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(set_counts(spark, sf).groupBy("test_set").agg(metrics.brier_aggregate()), ["brier"])


@query
def nll(spark: SparkSession, sf: str) -> DataFrame:
    counts = metrics.score_counts(v.predictions(spark, sf), ["dataset", "split"], "logit")
    return rounded(counts.groupBy("dataset", "split").agg(metrics.nll_aggregate(v.TEMPERATURE)), ["nll"])


@query
def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(bootstrap.bootstrap_ci(set_counts(spark, sf), ["test_set"], v.THRESHOLD), ["low", "high"])


@query
def full_report(spark: SparkSession, sf: str) -> DataFrame:
    table = model_report(spark, sf)
    return rounded(table, [f.name for f in table.schema.fields if f.dataType.simpleString() == "double"])


@query
def full_report_ci(spark: SparkSession, sf: str) -> DataFrame:
    """The report per model and set with its bootstrap intervals, as text of the metrics document too."""
    keys = ["model", "test_set"]
    counts = keep(set_counts(spark, sf, ["model"]))
    report = metrics.full_report(counts, keys, v.THRESHOLD)
    table = bootstrap.report_with_intervals(report, counts, keys, v.THRESHOLD)
    shown = table.withColumn("ci95", reports.interval_cell(F.col("roc_auc_low"), F.col("roc_auc_high")))
    return rounded(shown, [f.name for f in table.schema.fields if f.dataType.simpleString() == "double"])


@query
def per_source_rates(spark: SparkSession, sf: str) -> DataFrame:
    folded = test_sets.build_test_sets(test_sets.compact_scores(v.scored(spark, sf)))
    return rounded(test_sets.per_source_rates(folded, v.THRESHOLD), ["rate"])


@query
def robustness_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.perturbed(spark, sf).withColumn("test_set", F.when(F.col("split") == "test", "id_test").otherwise("crossgen_full"))
    return rounded(metrics.robustness_metrics(rows, ["test_set"], v.THRESHOLD), ["roc_auc", "balanced_accuracy", "accuracy", "fpr", "tpr"])


def set_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    judged = v.scored(spark, sf).withColumn("outcome", decision.outcome(F.col("label"), F.col("prob"), v.THRESHOLD))
    return test_sets.build_test_sets(judged)


@query
def outcome_counts(spark: SparkSession, sf: str) -> DataFrame:
    return selection.outcome_counts(set_outcomes(spark, sf))


@query
def prediction_counts(spark: SparkSession, sf: str) -> DataFrame:
    return v.predictions(spark, sf).groupBy("dataset", "split", "label").agg(F.count(F.lit(1)).alias("n"))


@query
def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.latency(spark, sf)
    found = ordering.exact_quantiles(rows, ["model"], ["sample_ms"], {"p50_ms": 0.5, "p95_ms": 0.95}).drop("feature")
    means = rows.groupBy("model").agg(F.avg("sample_ms").alias("mean_ms"))
    return rounded(found.withColumnRenamed("n", "runs").join(means, "model"), ["p50_ms", "p95_ms", "mean_ms"])


@query
def gradcam_map(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(saliency.gradcam_map(v.feature_map(spark, sf), HEAD_WEIGHTS), ["value"])


@query
def gradcam_map_normed(spark: SparkSession, sf: str) -> DataFrame:
    cam = saliency.gradcam_map_normed(v.feature_map(spark, sf), HEAD_WEIGHTS, HEAD_GAMMA, 1e-6, "real")
    return rounded(cam, ["value"], 5)


@query
def layernorm_gradient(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(saliency.layernorm_gradient(v.feature_map(spark, sf), HEAD_WEIGHTS, HEAD_GAMMA), ["g"], 4)


@query
def minmax_map(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(saliency.minmax_map(saliency.gradcam_map(v.feature_map(spark, sf), HEAD_WEIGHTS)), ["value"])


@query
def spearman_by_item(spark: SparkSession, sf: str) -> DataFrame:
    maps = v.feature_map(spark, sf)
    fake, real = (saliency.gradcam_map(maps, HEAD_WEIGHTS, target) for target in ("fake", "real"))
    return rounded(saliency.spearman_by_item(fake, real), ["spearman"])


@query
def mean_spearman(spark: SparkSession, sf: str) -> DataFrame:
    maps = v.feature_map(spark, sf)
    fake, real = (saliency.gradcam_map(maps, HEAD_WEIGHTS, target) for target in ("fake", "real"))
    return rounded(saliency.mean_spearman(fake, real), ["mean_spearman"])


# --- order and limits --------------------------------------------------------------------------


@query
def split_validation(spark: SparkSession, sf: str) -> DataFrame:
    done = manifest.split_validation(v.manifest(spark, sf), 42, "valid", "val_select", "val_calib")
    return done.select("rel_path", "label", "split")


@query
def hash_sample(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.hash_sample(v.manifest(spark, sf), 100, 42).select("rel_path", "source")


@query
def sample_groups(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.sample_groups(v.manifest(spark, sf), 5, 42, ["source", "label"]).select("source", "label", "rel_path")


@query
def sample_fraction(spark: SparkSession, sf: str) -> DataFrame:
    return manifest.sample_fraction(v.predictions(spark, sf), 0.3, 42, ["label"]).select("label", "rel_path")


@query
def rank_detections(spark: SparkSession, sf: str) -> DataFrame:
    ranked = detections.rank_detections(v.detections(spark, sf), ties=("pos", "x1", "y1", "x2", "y2"))
    return ranked.select("image_id", "face_rank", "score")


@query
def top_face(spark: SparkSession, sf: str) -> DataFrame:
    best = detections.top_face(v.detections(spark, sf), ties=("pos", "x1", "y1", "x2", "y2"))
    return best.select("image_id", "num_faces", "score", "x1", "y1")


@query
def worst_errors(spark: SparkSession, sf: str) -> DataFrame:
    return selection.worst_errors(set_outcomes(spark, sf), 10).select("test_set", "outcome", "rel_path")


@query
def outcome_gallery(spark: SparkSession, sf: str) -> DataFrame:
    picked = manifest.sample_groups(set_outcomes(spark, sf), 4, 42, ["test_set", "outcome"])
    return picked.select("test_set", "outcome", "rel_path")


@query
def threshold_for_fpr(spark: SparkSession, sf: str) -> DataFrame:
    points = metrics.curve(set_counts(spark, sf), ["test_set"])
    found = calibration.threshold_for_fpr(points, ["test_set"], 0.05)
    return found.select("test_set", r("threshold", 9).alias("threshold"), "n_real")


@query
def youden_threshold(spark: SparkSession, sf: str) -> DataFrame:
    points = metrics.curve(set_counts(spark, sf), ["test_set"])
    return rounded(calibration.youden_threshold(points, ["test_set"]), ["threshold"])


@query
def uncertainty_band(spark: SparkSession, sf: str) -> DataFrame:
    band = calibration.uncertainty_band(set_counts(spark, sf), ["test_set"], v.THRESHOLD)
    return rounded(band, ["delta", "abstention", "capture"])


@query
def select_model(spark: SparkSession, sf: str) -> DataFrame:
    return selection.select_model(v.model_summary(spark, sf)).select("model", "excluded", "tied", "winner")


@query
def summarize_models(spark: SparkSession, sf: str) -> DataFrame:
    report = model_report(spark, sf)
    measured = v.table(spark, sf, "events").select(F.concat(F.lit("m"), F.col("user_id") % 3).alias("model"), F.col("value").alias("ms"))
    slow = ordering.exact_quantiles(measured, ["model"], ["ms"], {"p95": 0.95}).filter("model <> 'm2'")
    table = selection.summarize_models(report, auc_spread(spark, sf), slow)
    return rounded(table, ["id_auc", "crossgen_mean_auc", "crossgen_min_auc_ci_low", "crossgen_full_auc", "own_auc", "p95_latency_ms"])


@query
def early_stop(spark: SparkSession, sf: str) -> DataFrame:
    return selection.early_stop(v.epochs(spark, sf), patience=4)


@query
def history_page(spark: SparkSession, sf: str) -> DataFrame:
    return history.history_page(v.history(spark, sf), 7, 20, 10).select("id", "user_id", "num_faces", "total")


# --- sets --------------------------------------------------------------------------------------


@query
def concat_manifests(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.manifest(spark, sf)
    return manifest.concat_manifests(rows, rows.withColumn("dataset", F.lit("own"))).select("dataset", "rel_path")


@query
def build_test_sets(spark: SparkSession, sf: str) -> DataFrame:
    return test_sets.build_test_sets(v.scored(spark, sf)).select("test_set", "item_id", "label", "source")


# --- fits --------------------------------------------------------------------------------------


def _one_row(spark: SparkSession, values: dict[str, float]) -> DataFrame:
    return spark.createDataFrame([(k, float(x)) for k, x in values.items()], "name string, value double")


@query
def fit_temperature(spark: SparkSession, sf: str) -> DataFrame:
    t = calibration.fit_temperature(metrics.score_counts(v.predictions(spark, sf), [], "logit"))
    return _one_row(spark, {"temperature": round(t, 6)})


@query
def calibrate(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.predictions(spark, sf).filter((F.col("dataset") == "140k") & (F.col("split") == "val_calib"))
    fitted = asdict(calibration.calibrate(rows))
    return _one_row(spark, {k: round(x, 6) for k, x in fitted.items()})


@query
def trivial_classifier(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.features(spark, sf)
    columns = ["n_chars", "n_words", "n_digits", "n_lines", "fixed"]
    return classifiers.trivial_classifier(rows, columns, "doc_id").to_df(rows)


@query
def permutation_importance(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.features(spark, sf)
    columns = ["n_chars", "n_words", "n_digits", "n_lines"]
    return classifiers.permutation_importance(rows, columns, "doc_id", 42)


@query
def audit_compare(spark: SparkSession, sf: str) -> DataFrame:
    """The shortcut test on metadata and pixels of raw and processed files, the latter also without file sizes."""
    small = [c for c in audit.METADATA_FEATURES if c not in audit.SIZE_FEATURES]
    sets = {f"{stage}_{name}": [f"{stage}_{c}" for c in columns] for stage in ("raw", "processed") for name, columns in (("metadata", audit.METADATA_FEATURES), ("pixels", pixels.PIXEL_FEATURES))}
    sets["processed_metadata_no_filesize"] = [f"processed_{c}" for c in small]
    return classifiers.audit_compare(v.audited(spark, sf), sets, "rel_path")


@query
def temperature_per_split(spark: SparkSession, sf: str) -> DataFrame:
    """One fit per dataset that there is, each on its own rows."""
    fitted = calibration.fit_temperatures(metrics.score_counts(v.predictions(spark, sf), ["dataset"], "logit"), ["dataset"])
    return fitted.select(F.col("dataset").alias("name"), F.round("temperature", 5).alias("value"))


@query
def linear_probe(spark: SparkSession, sf: str) -> DataFrame:
    fitted = classifiers.linear_probe(v.probe_rows(spark, sf))
    return _one_row(spark, {"best_c": fitted.best_c, **{f"auc_c_{c}": round(a, 6) for c, a in fitted.auc_by_c.items()}})


@query
def probe_score(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(classifiers.probe_score(v.probe_rows(spark, sf), PROBE_WEIGHTS, 0.25).select("item_id", "logit"), ["logit"])


# --- requests and streams ----------------------------------------------------------------------


@query
def sliding_rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    return limits.sliding_rate_limit(v.requests(spark, sf), 2, 3600 * 12).select("event_id", "accepted", "retry_after")


@query
def client_key(spark: SparkSession, sf: str) -> DataFrame:
    forwarded = F.when(F.col("event_type") == "view", F.concat(F.lit(" 10.0.0."), "user_id", F.lit(" , 10.1.1.1")))
    header = F.when(F.col("event_type") == "error", "").otherwise(forwarded)
    host = F.when(F.col("event_type") != "signup", F.concat(F.lit("192.168.0."), "user_id"))
    return v.table(spark, sf, "events").select(
        "event_id",
        formats.client_key(header, host, True).alias("trusted"),
        formats.client_key(header, host, False).alias("direct"),
    )


def _streamed(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One of the tables as a file stream, be it one file or a folder of them; of a pattern, unlike of a plain path, both may be streamed."""
    schema = v.table(spark, sf, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


def _drain(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there, into files, and read them back."""
    base = work_folder(spark, name)
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/state")
    writer.trigger(availableNow=True).start(f"{base}/out").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


@query
def stream_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    uploads = v.with_upload_columns(_streamed(spark, sf, "pages"))
    scored = verdicts.score_uploads(uploads, v.TEMPERATURE, v.THRESHOLD, v.DELTA, 8000)
    return _drain(spark, scored.select("page_id", "error", "status", r("prob").alias("prob"), "verdict"), "verdicts")


@query
def stream_progress(spark: SparkSession, sf: str) -> DataFrame:
    base = work_folder(spark, "progress")
    log = _streamed(spark, sf, "events").select(
        F.col("event_id").alias("seq"),
        F.lit("140k").alias("dataset"),
        F.concat(F.lit("doc/"), "user_id").alias("rel_path"),
        F.when(F.col("event_type") == "error", "read_error").otherwise("ok").alias("status"),
    )
    stream_ledger.stream_progress(log, f"{base}/ledger", f"{base}/state").awaitTermination()
    return stream_ledger.read_ledger(spark, f"{base}/ledger")


@query
def stream_rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    requests = _streamed(spark, sf, "events").select(
        "event_id", F.concat(F.lit("user"), "user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts")
    )
    decided = stream_limits.limit_stream(requests, 2, 3600 * 12, evict=False)
    return _drain(spark, decided, "limits").select("event_id", "accepted", "retry_after")


@query
def purge_count(spark: SparkSession, sf: str) -> DataFrame:
    return history.purge_count(history.expire_images(v.history(spark, sf), "2024-01-15"))


@query
def expire_images(spark: SparkSession, sf: str) -> DataFrame:
    return history.expire_images(v.history(spark, sf), "2024-01-15").select("id", "image_path", "purged")
