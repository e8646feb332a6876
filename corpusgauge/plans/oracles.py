"""SQL counterparts of the named queries, written independently of the Spark plans."""

from __future__ import annotations

from corpusgauge.functions.formats import quality_means
from corpusgauge.plans.view_sql import VIEWS, h, hx, output_name_sql, pick, sigmoid, with_views

ORACLES: dict[str, str] = {}


def oracle(name: str, sql: str, *views: str) -> None:
    ORACLES[name] = with_views(sql, *views) if views else sql.strip()


def rd(expression: str, digits: int = 6) -> str:
    return f"round(({expression})::DOUBLE, {digits}) + 0.0::DOUBLE"


T, D = "0.6::DOUBLE", "0.05::DOUBLE"
SNIFF = """CASE WHEN starts_with(hex(content), 'FFD8FF') THEN 'jpeg'
  WHEN starts_with(hex(content), '89504E470D0A1A0A') THEN 'png'
  WHEN starts_with(hex(content), '52494646') AND substr(hex(content), 17, 8) = '57454250' THEN 'webp'
  WHEN starts_with(hex(content), '474946383761') OR starts_with(hex(content), '474946383961') THEN 'gif'
  WHEN starts_with(hex(content), '424D') THEN 'bmp' ELSE 'unknown' END"""

# --- sources and sinks
oracle(
    "scan_manifest",
    f"""SELECT page_id, sha256(content) AS sha256, octet_length(content)::BIGINT AS file_size, f AS format,
  CASE WHEN octet_length(content) = 0 THEN 'empty file' WHEN f = 'unknown' THEN 'cannot identify image file' END AS read_error
FROM (SELECT *, {SNIFF} AS f FROM file_bytes)""",
    "file_bytes",
)
oracle("sniff_format", f"SELECT page_id, {SNIFF} AS format FROM file_bytes", "file_bytes")
oracle("read_manifest", "SELECT * FROM manifest", "manifest")
oracle("manifest_lines", "SELECT * FROM manifest", "manifest")
_LABEL = pick(h(53, "doc_id", 3), ["real", "fake", "masks"])
oracle(
    "discover_files",
    f"""SELECT rel_path, dataset, source, label, split FROM (
  SELECT {pick(h(52, 'doc_id', 4), ["train", "valid", "test", "extra"])} AS folder, {_LABEL} AS label, {h(54, 'doc_id', 5)} = 0 AS deep, {h(56, 'doc_id', 6)} = 0 AS bare,
    doc_id || '.' || {pick(h(55, 'doc_id', 4), ["JPG", "png", "txt", "jpeg"])} AS name, {h(51, 'doc_id', 2)} = 0 AS by_split, source AS own
  FROM documents),
LATERAL (SELECT CASE WHEN by_split THEN folder || '/' || label || '/' || CASE WHEN deep THEN 'more/' ELSE '' END || name ELSE label || '/' || CASE WHEN bare THEN '' ELSE own || '/' END || name END AS rel_path,
  CASE WHEN by_split THEN '140k' ELSE 'crossgen' END AS dataset, CASE WHEN by_split THEN CASE label WHEN 'real' THEN 'ffhq' ELSE 'stylegan' END ELSE own END AS source,
  CASE WHEN by_split THEN folder ELSE 'crossgen' END AS split)
WHERE label <> 'masks' AND name NOT LIKE '%.txt' AND CASE WHEN by_split THEN folder <> 'extra' ELSE NOT bare END""",
)
oracle(
    "read_predictions",
    """SELECT dataset, split, source, label, rel_path, 'out/' || item_id AS processed_rel_path,
  CASE WHEN model = 'm0' THEN logit ELSE logit + 1.0::DOUBLE END AS logit FROM predictions""",
    "predictions",
)
oracle(
    "read_processed",
    f"""SELECT dataset, split, label, rel_path, processed_rel_path FROM (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY {hx(42, 'rel_path')}, rel_path) AS k,
    count(*) OVER (PARTITION BY label) AS n
  FROM ledger WHERE status = 'ok' AND split IN ('train', 'test') AND dataset = '140k')
WHERE k <= round_even(0.5::DOUBLE * n, 0)""",
    "ledger",
)
oracle(
    "read_progress_log",
    "SELECT dataset, rel_path, seq, status, processed_rel_path FROM progress "
    "QUALIFY row_number() OVER (PARTITION BY dataset, rel_path ORDER BY seq DESC) = 1",
    "progress",
)
oracle(
    "generation_log_status",
    f"""SELECT count(*) FILTER (status = 'ok' AND there) AS saved, count(*) FILTER (status = 'degenerate') AS degenerate
FROM (SELECT CASE event_type WHEN 'error' THEN 'degenerate' ELSE 'ok' END AS status,
    {h(19, "('img_' || user_id || '_' || event_id || '.png')", 3)} > 0 AS there
  FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)""",
)
oracle("partitioned_sink", f"SELECT rel_path, {output_name_sql()} AS processed_rel_path FROM manifest", "manifest")
oracle(
    "write_report",
    """SELECT '{"event_type":"' || event_type || '","n":' || count(*) || ',"low":' || min(value) || ',"nothing":null}' AS json
FROM events GROUP BY event_type""",
)

# --- expressions
oracle(
    "validate_manifest",
    """SELECT 'unknown_label' AS rule, count(*) FILTER (format = 'unknown') AS n FROM manifest
UNION ALL SELECT 'duplicate_key', count(*) FROM manifest""",
    "manifest",
)
_UPLOADS = f"""SELECT page_id, CASE WHEN {h(42, 'page_id', 11)} = 0 THEN 0 ELSE octet_length(content) END AS size, {SNIFF} AS f,
  CASE WHEN {h(43, 'page_id', 9)} <> 0 THEN (64 + {h(44, 'page_id', 8000)}) * (64 + {h(45, 'page_id', 8000)}) END AS pixels,
  {h(46, 'page_id', 5)} AS faces, ({h(47, 'page_id', 101)} - 50) / 10.0::DOUBLE AS logit FROM file_bytes"""
_ERROR = """CASE WHEN size = 0 THEN 'INVALID_IMAGE' WHEN size > 8000 THEN 'FILE_TOO_LARGE'
  WHEN f NOT IN ('jpeg', 'png', 'webp') THEN 'UNSUPPORTED_MEDIA_TYPE'
  WHEN pixels IS NULL OR pixels > 40000000 THEN 'INVALID_IMAGE' WHEN faces = 0 THEN 'NO_FACE_DETECTED' END"""
_STATUS = """CASE error WHEN 'FILE_TOO_LARGE' THEN 413 WHEN 'UNSUPPORTED_MEDIA_TYPE' THEN 415
  WHEN 'INVALID_IMAGE' THEN 422 WHEN 'NO_FACE_DETECTED' THEN 422 ELSE 200 END::INTEGER"""
oracle(
    "validate_uploads",
    f"SELECT page_id, error, {_STATUS} AS status FROM (SELECT *, {_ERROR} AS error FROM ({_UPLOADS}))",
    "file_bytes",
)
oracle(
    "stable_hash",
    f"""SELECT doc_id, CAST(('0x' || {hx(42, 'doc_id')})::UBIGINT AS VARCHAR) AS h, -5 + {h(7, 'doc_id', 26)} AS drawn
FROM documents""",
)
oracle("offline_quality", f"SELECT rel_path, 80 + {h(42, 'sha256', 16)} AS quality FROM manifest", "manifest")
oracle(
    "resolve_paths",
    """SELECT rel_path, CASE dataset WHEN '140k' THEN '/data/main/' ELSE '/data/cross/' END || rel_path AS path FROM manifest""",
    "manifest",
)
_FEATURES = """SELECT rel_path, source, label, width::DOUBLE AS width, height::DOUBLE AS height,
  width::DOUBLE / height AS aspect, width::DOUBLE * height / 1e6 AS megapixels, file_size / 1024.0::DOUBLE AS file_size_kb,
  file_size::DOUBLE / (width::DOUBLE * height) AS bytes_per_pixel, coalesce(jpeg_quality_est, -1)::DOUBLE AS jpeg_quality_est,
  (jpeg_quality_est IS NULL)::INTEGER AS jpeg_quality_missing, (format = 'jpeg')::INTEGER AS is_jpeg,
  (format = 'png')::INTEGER AS is_png, (format = 'webp')::INTEGER AS is_webp,
  (lower(has_exif) IN ('true', '1'))::INTEGER AS has_exif, (lower(has_icc) IN ('true', '1'))::INTEGER AS has_icc,
  (lower(has_xmp) IN ('true', '1'))::INTEGER AS has_xmp FROM manifest"""
oracle(
    "metadata_features",
    f"""SELECT * EXCLUDE (source, label) REPLACE ({rd('aspect')} AS aspect, {rd('megapixels')} AS megapixels,
  {rd('file_size_kb')} AS file_size_kb, {rd('bytes_per_pixel')} AS bytes_per_pixel) FROM ({_FEATURES})""",
    "manifest",
)
_MEANS = ", ".join(f"({q + 1}, {m!r}::DOUBLE)" for q, m in enumerate(quality_means()))
oracle(
    "jpeg_quality_estimate",
    f"""SELECT item_id, (SELECT q FROM (VALUES {_MEANS}) t(q, m)
    WHERE quant IS NOT NULL ORDER BY abs(m - list_sum(quant)::DOUBLE / 64), q LIMIT 1)::INTEGER AS quality FROM quant_tables""",
    "quant_tables",
)
oracle("apply_calibration", f"SELECT item_id, {rd('prob')} AS prob FROM scored", "scored")
oracle(
    "verdict",
    f"""SELECT item_id, CASE WHEN abs(prob - {T}) < {D} THEN 'UNCERTAIN' WHEN prob >= {T} THEN 'AI_GENERATED'
  ELSE 'REAL' END AS verdict FROM scored""",
    "scored",
)
_OUTCOME = f"""CASE WHEN label = 'fake' THEN CASE WHEN prob >= {T} THEN 'TP' ELSE 'FN' END
  ELSE CASE WHEN prob >= {T} THEN 'FP' ELSE 'TN' END END"""
oracle("outcome", f"SELECT item_id, {_OUTCOME} AS outcome FROM scored", "scored")
oracle(
    "label_to_int",
    """SELECT item_id, (label = 'fake')::INTEGER AS y, source || ' (' || label || ')' AS "group" FROM predictions""",
    "predictions",
)
oracle(
    "detection_scale",
    f"""SELECT image_id, {rd('scale')} AS scale, greatest(1, round_even(image_width * scale, 0))::INTEGER AS w,
  greatest(1, round_even(image_height * scale, 0))::INTEGER AS h FROM detections""",
    "detections",
)


def _crop(scale: str, width: str, height: str) -> str:
    return f"""SELECT image_id, l AS "left", t AS top, side, clamped FROM (
  SELECT image_id, side, least(greatest(fl, 0), w - side)::INTEGER AS l, least(greatest(ft, 0), h - side)::INTEGER AS t,
    (side <> wanted OR fl <> least(greatest(fl, 0), w - side) OR ft <> least(greatest(ft, 0), h - side)) AS clamped
  FROM (SELECT *, round_even((x1 + x2) / 2 - side / 2.0::DOUBLE, 0)::INTEGER AS fl,
      round_even((y1 + y2) / 2 - side / 2.0::DOUBLE, 0)::INTEGER AS ft
    FROM (SELECT *, least(wanted, w, h)::INTEGER AS side
      FROM (SELECT *, greatest(1, round_even(greatest(x2 - x1, y2 - y1) * 1.3::DOUBLE, 0)::INTEGER) AS wanted
        FROM (SELECT image_id, x1 * {scale} AS x1, y1 * {scale} AS y1, x2 * {scale} AS x2, y2 * {scale} AS y2,
          {width} AS w, {height} AS h FROM detections)))))"""


oracle("square_crop", _crop("1.0::DOUBLE", "image_width", "image_height"), "detections")
oracle("scale_boxes", _crop("0.5::DOUBLE", "image_width // 2", "image_height // 2"), "detections")
_RANKED = """SELECT *, prob * (x2 - x1) * (y2 - y1) AS score FROM (
  SELECT image_id, pos, x1 / scale AS x1, y1 / scale AS y1, x2 / scale AS x2, y2 / scale AS y2, prob
  FROM detections WHERE prob >= 0.9::DOUBLE) WHERE x2 - x1 >= 40 AND y2 - y1 >= 40"""
_ORDERED = f"""SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, pos, x1, y1, x2, y2) AS k,
  count(*) OVER (PARTITION BY image_id) AS n FROM ({_RANKED})"""
oracle(
    "result_faces",
    f"""SELECT image_id, count(*)::INTEGER AS num_faces, string_agg((k - 1) || ':' || round_even(x1, 0)::INTEGER || ',' ||
    round_even(y1, 0)::INTEGER || ',' || round_even(x2, 0)::INTEGER || ',' || round_even(y2, 0)::INTEGER, ';' ORDER BY k) AS faces
FROM ({_ORDERED}) WHERE k <= 10 GROUP BY image_id""",
    "detections",
)
oracle(
    "missing_features_filter",
    "SELECT rel_path, width, jpeg_quality_est, read_error FROM manifest WHERE width IS NOT NULL AND jpeg_quality_est IS NOT NULL",
    "manifest",
)
oracle(
    "constant_columns",
    """SELECT unnest(list_filter([CASE WHEN count(DISTINCT width) <= 1 THEN 'width' END,
  CASE WHEN count(DISTINCT height) <= 1 THEN 'height' END, CASE WHEN count(DISTINCT format) <= 1 THEN 'format' END,
  CASE WHEN count(DISTINCT mode) <= 1 THEN 'mode' END,
  CASE WHEN count(DISTINCT jpeg_quality_est) <= 1 THEN 'jpeg_quality_est' END], lambda x: x IS NOT NULL)) AS feature
FROM manifest WHERE jpeg_quality_est IS NOT NULL""",
    "manifest",
)
oracle(
    "degenerate_filter",
    f"""SELECT item_id, {rd('s')} AS grey_std FROM (SELECT vec_id AS item_id, stddev_pop(x) AS s
  FROM (SELECT vec_id, unnest(embedding)::DOUBLE * 24.0::DOUBLE AS x FROM embeddings) GROUP BY vec_id) WHERE s < 3""",
)

# --- joins
oracle(
    "merge_specs_meta",
    """SELECT dataset, source, label, split, rel_path, CASE WHEN ok THEN sha256 END AS sha256, CASE WHEN ok THEN format END AS format,
  CASE WHEN ok THEN width END AS width, CASE WHEN ok THEN height END AS height, NULL::VARCHAR AS mode,
  CASE WHEN ok THEN file_size END AS file_size, NULL::INTEGER AS jpeg_quality_est, NULL::VARCHAR AS has_exif,
  NULL::VARCHAR AS has_icc, NULL::VARCHAR AS has_xmp, NULL::VARCHAR AS read_error
FROM (SELECT *, read_error IS NULL AS ok FROM manifest)""",
    "manifest",
)
_PAIRS = """pairs AS (SELECT a.item_id AS i, b.item_id AS j, bit_count(xor(a.phash, b.phash))::INTEGER AS pd,
    bit_count(xor(a.dhash, b.dhash))::INTEGER AS dd, a.dataset AS dataset_i, b.dataset AS dataset_j, a.split AS split_i,
    b.split AS split_j, a.label AS label_i, b.label AS label_j, a.rel_path AS path_i, b.rel_path AS path_j,
    list_position(ORDERED, a.split) AS rank_i, list_position(ORDERED, b.split) AS rank_j
  FROM fingerprints a JOIN fingerprints b ON a.item_id < b.item_id
    AND bit_count(xor(a.phash, b.phash)) <= 4 AND bit_count(xor(a.dhash, b.dhash)) <= 4)""".replace(
    "ORDERED", "['train', 'val_select', 'val_calib', 'test', 'crossgen', 'own']"
)
_PRINTS = "prints AS (SELECT *, min(item_id) OVER (PARTITION BY phash, dhash) AS print_id FROM fingerprints)"
_FP = VIEWS["fingerprints"].strip()


def fp_oracle(name: str, body: str, *ctes: str) -> None:
    ORACLES[name] = "WITH " + ",\n".join([f"fingerprints AS MATERIALIZED ({_FP})", *ctes]) + "\n" + body.strip()


fp_oracle(
    "near_duplicate_pairs",
    """SELECT least(a.print_id, b.print_id) AS print_i, greatest(a.print_id, b.print_id) AS print_j, pd AS phash_dist,
  dd AS dhash_dist, any_value(CASE WHEN a.print_id <= b.print_id THEN ca.n ELSE cb.n END) AS n_i,
  any_value(CASE WHEN a.print_id <= b.print_id THEN cb.n ELSE ca.n END) AS n_j, count(*) AS pairs
FROM pairs JOIN prints a ON a.item_id = i JOIN prints b ON b.item_id = j
  JOIN (SELECT print_id, count(*) AS n FROM prints GROUP BY 1) ca ON ca.print_id = a.print_id
  JOIN (SELECT print_id, count(*) AS n FROM prints GROUP BY 1) cb ON cb.print_id = b.print_id
GROUP BY 1, 2, 3, 4""",
    _PAIRS,
    _PRINTS,
)
fp_oracle("print_members", "SELECT item_id, print_id FROM prints", _PRINTS)
fp_oracle(
    "bucket_guard",
    """SELECT band, chunk, count(*) AS n FROM (
  SELECT unnest([0, 1, 2, 3, 4])::INTEGER AS band,
    unnest([phash & 8191, (phash >> 13) & 8191, (phash >> 26) & 8191, (phash >> 39) & 8191, phash >> 52])::BIGINT AS chunk
  FROM fingerprints) GROUP BY 1, 2 HAVING count(*) > 2""",
)
fp_oracle(
    "annotate_pairs",
    """SELECT * FROM (
  SELECT CASE WHEN flip THEN pj ELSE pi END AS print_i, CASE WHEN flip THEN pi ELSE pj END AS print_j,
    CASE WHEN flip THEN dataset_j ELSE dataset_i END AS dataset_i, CASE WHEN flip THEN split_j ELSE split_i END AS split_i,
    CASE WHEN flip THEN label_j ELSE label_i END AS label_i, CASE WHEN flip THEN dataset_i ELSE dataset_j END AS dataset_j,
    CASE WHEN flip THEN split_i ELSE split_j END AS split_j, CASE WHEN flip THEN label_i ELSE label_j END AS label_j,
    pd AS phash_dist, dd AS dhash_dist, count(*) AS pairs, split_i <> split_j AS cross_split, label_i <> label_j AS label_conflict
  FROM (SELECT pairs.*, a.print_id AS pi, b.print_id AS pj,
      CASE WHEN a.print_id = b.print_id THEN a.cell_id > b.cell_id ELSE a.print_id > b.print_id END AS flip
    FROM pairs JOIN celled a ON a.item_id = i JOIN celled b ON b.item_id = j)
  GROUP BY ALL)""",
    _PAIRS,
    _PRINTS,
    "celled AS (SELECT *, min(item_id) OVER (PARTITION BY print_id, dataset, split, label) AS cell_id FROM prints)",
)
_DROPS = """drops AS (SELECT * FROM (
  SELECT i, j, pd, dd, CASE WHEN rank_i > rank_j THEN dataset_i ELSE dataset_j END AS dataset,
    CASE WHEN rank_i > rank_j THEN split_i ELSE split_j END AS split,
    CASE WHEN rank_i > rank_j THEN path_i ELSE path_j END AS rel_path,
    CASE WHEN rank_i > rank_j THEN dataset_j ELSE dataset_i END AS duplicate_of_dataset,
    CASE WHEN rank_i > rank_j THEN split_j ELSE split_i END AS duplicate_of_split,
    CASE WHEN rank_i > rank_j THEN path_j ELSE path_i END AS duplicate_of_rel_path
  FROM pairs WHERE rank_i <> rank_j)
  QUALIFY row_number() OVER (PARTITION BY dataset, rel_path ORDER BY i, j) = 1)"""
fp_oracle(
    "resolve_drops",
    """SELECT dataset, split, rel_path, duplicate_of_dataset, duplicate_of_split, duplicate_of_rel_path,
  pd AS phash_dist, dd AS dhash_dist FROM drops""",
    _PAIRS,
    _DROPS,
)
fp_oracle(
    "dedupe_report",
    """SELECT 'pairs_total' AS metric, NULL::VARCHAR AS dataset, NULL::VARCHAR AS split, count(*) AS n FROM pairs
UNION ALL SELECT 'pairs_same_split', NULL, NULL, count(*) FROM pairs WHERE rank_i = rank_j
UNION ALL SELECT 'pairs_cross_split', NULL, NULL, count(*) FROM pairs WHERE rank_i <> rank_j
UNION ALL SELECT 'pairs_with_label_conflict', NULL, NULL, count(*) FROM pairs WHERE label_i <> label_j
UNION ALL SELECT 'images_hashed', NULL, NULL, count(*) FROM fingerprints
UNION ALL SELECT 'dropped_images', NULL, NULL, count(*) FROM drops
UNION ALL SELECT 'dropped_by_dataset_split', dataset, split, count(*) FROM drops GROUP BY dataset, split""",
    _PAIRS,
    _DROPS,
)
fp_oracle(
    "borderline_pairs",
    """SELECT i AS id_i, j AS id_j, split_i, split_j, pd AS phash_dist, dd AS dhash_dist FROM pairs
WHERE rank_i <> rank_j ORDER BY pd DESC, dd DESC, i, j LIMIT 12""",
    _PAIRS,
)
_DROPPED = "(SELECT dataset, rel_path FROM ledger WHERE status = 'duplicate_dropped')"
oracle(
    "exclude_dropped",
    f"SELECT dataset, split, rel_path FROM manifest WHERE (dataset, rel_path) NOT IN {_DROPPED}",
    "ledger",
)
_LATEST = "(SELECT * FROM progress QUALIFY row_number() OVER (PARTITION BY dataset, rel_path ORDER BY seq DESC) = 1)"
oracle(
    "resume_todo",
    f"""SELECT m.dataset, m.rel_path, CASE WHEN m.read_error IS NOT NULL THEN 'read_error'
  WHEN (m.dataset, m.rel_path) IN {_DROPPED} THEN 'duplicate_dropped' ELSE 'process' END AS action
FROM manifest m LEFT JOIN {_LATEST} d ON d.dataset = m.dataset AND d.rel_path = m.rel_path
WHERE d.seq IS NULL OR (d.status = 'ok' AND {h(31, 'd.processed_rel_path', 4)} = 0)""",
    "ledger",
    "progress",
)
oracle(
    "ledger_for_manifest",
    f"""SELECT dataset, rel_path, seq, status, processed_rel_path FROM {_LATEST}
WHERE (dataset, rel_path) IN (SELECT dataset, rel_path FROM manifest)""",
    "manifest",
    "progress",
)
oracle(
    "join_latency",
    f"""SELECT event_type AS model, count(*) AS n,
  CASE WHEN event_type <> 'error' THEN {rd('quantile_cont(value, 0.95)')} END AS p95_latency_ms FROM events GROUP BY 1""",
)
oracle("owned_history", "SELECT id, user_id, num_faces FROM history WHERE num_faces = 1", "history")
oracle(
    "robustness_grid",
    "SELECT item_id, step, family, level FROM predictions, grid WHERE split IN ('test', 'crossgen_full') OR dataset = 'crossgen'",
    "predictions",
    "grid",
)

# --- aggregations
oracle(
    "summarize_manifest",
    """SELECT dataset, split, source, label, count(*) AS images, count(read_error) AS unreadable FROM manifest
GROUP BY ALL""",
    "manifest",
)
oracle(
    "import_stats",
    f"""SELECT source, any_value(found) AS found, count(*) AS selected, count(*) - count(DISTINCT sha256) AS identical_skipped,
  count(DISTINCT sha256) FILTER (held) AS already_present, count(DISTINCT sha256) FILTER (NOT held) AS copied
FROM (SELECT *, (source, sha256) IN (SELECT source, sha256 FROM manifest WHERE format = 'png') AS held,
    count(*) OVER (PARTITION BY source) AS found,
    row_number() OVER (PARTITION BY source ORDER BY {hx(42, 'rel_path')}, rel_path) AS k FROM manifest)
WHERE k <= 20 GROUP BY source""",
    "manifest",
)
oracle(
    "class_balance",
    """SELECT r AS "real", f AS fake, e AS with_exif, CASE WHEN least(r, f) = 0 THEN 'single_class'
  WHEN greatest(r, f) / least(r, f)::DOUBLE > 1.1 THEN 'imbalanced' ELSE 'none' END AS warning
FROM (SELECT count(*) FILTER (read_error IS NULL AND label = 'real') AS r, count(*) FILTER (read_error IS NULL AND label = 'fake') AS f,
  count(*) FILTER (lower(has_exif) = 'true') AS e FROM manifest)""",
    "manifest",
)
oracle(
    "status_report",
    f"""SELECT source, count(*) AS n, count(*) FILTER (status = 'ok') AS n_ok,
  {rd("avg(crop_clamped::INTEGER) FILTER (status = 'ok')")} AS crop_clamped_rate,
  {rd("avg((num_faces > 1)::INTEGER) FILTER (status = 'ok')")} AS multi_face_rate FROM ledger GROUP BY source""",
    "ledger",
)
oracle(
    "status_counts",
    "SELECT dataset, split, source, label, status, count(*) AS n FROM ledger GROUP BY ALL",
    "ledger",
)
_RATES = ", ".join(
    f"""{rd(f"avg((status = '{s}')::INTEGER)")} AS {s}_rate""" for s in ("ok", "no_face", "read_error", "duplicate_dropped")
)
oracle("status_rates", f"SELECT source, label, {_RATES} FROM ledger GROUP BY ALL", "ledger")
_META = ("width", "height", "file_size_kb", "jpeg_quality_est")
oracle(
    "group_quantiles",
    f"WITH manifest AS ({VIEWS['manifest'].strip()}), feats AS ({_FEATURES})\n"
    + "\nUNION ALL ".join(
        f"""SELECT source, label, '{c}' AS feature, {rd(f'quantile_cont({c}, 0.05)')} AS p5,
  {rd(f'quantile_cont({c}, 0.5)')} AS p50, {rd(f'quantile_cont({c}, 0.95)')} AS p95, count(*) AS n FROM feats GROUP BY ALL"""
        for c in _META
    ),
)
_FLAG_NAMES = ("is_jpeg", "is_png", "is_webp", "has_exif", "has_icc", "has_xmp", "jpeg_quality_missing")
oracle(
    "flag_rates",
    f"SELECT source, label, {', '.join(f'{rd(f'avg({c})')} AS {c}' for c in _FLAG_NAMES)} FROM ({_FEATURES}) GROUP BY ALL",
    "manifest",
)
oracle(
    "clipped_histogram",
    f"WITH manifest AS ({VIEWS['manifest'].strip()}), feats AS ({_FEATURES})\n"
    + "\nUNION ALL ".join(
        f"""SELECT label, '{c}' AS feature, bin, coalesce(c, 0) AS count, {rd('coalesce(c, 0) / (n * (hi - lo) / 40)')} AS density
FROM (SELECT label, unnest(range(40))::INTEGER AS bin, count(*) AS n FROM feats GROUP BY label)
CROSS JOIN (SELECT quantile_cont({c}, 0.005) AS lo, quantile_cont({c}, 0.995) AS hi FROM feats)
LEFT JOIN (SELECT label, least(floor((least(greatest({c}, lo), hi) - lo) / (hi - lo) * 40), 39)::INTEGER AS bin, count(*) AS c
  FROM feats, (SELECT quantile_cont({c}, 0.005) AS lo, quantile_cont({c}, 0.995) AS hi FROM feats) GROUP BY 1, 2) USING (label, bin)"""
        for c in ("width", "file_size_kb")
    ),
)
def _byte(k: str) -> str:
    return f"CASE WHEN {k} < n THEN ('0x' || substr(hx, 2 * ({k}) + 1, 2))::INTEGER ELSE 0 END"


_COLOURS = ", ".join(
    [f"{rd(f'avg({c}) / 255')} AS mean_{c}" for c in "rgb"] + [f"{rd(f'stddev_pop({c}) / 255')} AS std_{c}" for c in "rgb"]
)
oracle(
    "image_pixels",
    f"""SELECT item_id, any_value(height) AS height, 32 AS width, {_COLOURS},
  {rd('avg(CASE WHEN greatest(r, g, b) > 0 THEN 255 * (greatest(r, g, b) - least(r, g, b)) // greatest(r, g, b) ELSE 0 END) / 255')} AS mean_saturation,
  {rd('avg(greatest(r, g, b)) / 255')} AS mean_brightness
FROM (SELECT item_id, height, {_byte('3 * p')} AS b, {_byte('3 * p + 1')} AS g, {_byte('3 * p + 2')} AS r
  FROM (SELECT page_id AS item_id, hex(encode(html)) AS hx, octet_length(encode(html)) AS n,
      ceil(octet_length(encode(html)) / 96.0)::INTEGER AS height,
      unnest(range(32 * ceil(octet_length(encode(html)) / 96.0)::INTEGER)) AS p FROM pages))
GROUP BY item_id""",
)
# the transform of a picture: over the columns of each row first, then over the rows
_GREY = f"""grey AS MATERIALIZED (SELECT item_id, source, h, p // 32 AS y, p % 32 AS x, r, g, b, ((19595 * r + 38470 * g + 7471 * b + 32768) >> 16)::DOUBLE AS v
  FROM (SELECT item_id, source, h, p, {_byte('3 * p')} AS b, {_byte('3 * p + 1')} AS g, {_byte('3 * p + 2')} AS r
    FROM (SELECT page_id AS item_id, {pick(h(41, 'page_id', 3), ['ffhq', 'sdxl', 'flux'])} AS source, hex(encode(html)) AS hx, octet_length(encode(html)) AS n,
        ceil(octet_length(encode(html)) / 96.0)::INTEGER AS h, unnest(range(32 * ceil(octet_length(encode(html)) / 96.0)::INTEGER)) AS p FROM pages)))"""


def _power(table: str) -> str:
    """CTEs up to `power` (item_id, source, h, w, u, power) of `table` (item_id, source, h, y, x, v)."""
    turn = "2 * pi() * ({a} * {b} % {n})::DOUBLE / {n}"
    across, down = turn.format(a="u", b="x", n="32"), turn.format(a="w", b="y", n="h")
    return f"""across AS MATERIALIZED (SELECT item_id, source, h, y, u, sum(v * c) AS re, -sum(v * s) AS im
  FROM {table} JOIN (SELECT u, x, cos({across}) AS c, sin({across}) AS s FROM range(32) a(u), range(32) b(x)) USING (x) GROUP BY ALL),
waves AS MATERIALIZED (SELECT h, w, y, cos({down}) AS c, sin({down}) AS s FROM (SELECT DISTINCT h FROM {table}), LATERAL (SELECT unnest(range(h)) AS w), LATERAL (SELECT unnest(range(h)) AS y)),
power AS MATERIALIZED (SELECT item_id, source, h, w, u, pow(sum(re * c + im * s), 2) + pow(sum(im * c - re * s), 2) AS power FROM across JOIN waves USING (h, y) GROUP BY ALL)"""


_FAR = "pow(2 * ((w + h // 2) % h - h // 2)::DOUBLE / h, 2) + pow(2 * ((u + 16) % 32 - 16)::DOUBLE / 32, 2) > 0.25"
ORACLES["pixel_stats"] = f"""WITH {_GREY},
centred AS (SELECT item_id, source, h, y, x, v - avg(v) OVER (PARTITION BY item_id) AS v FROM grey),
{_power('centred')},
high AS (SELECT item_id, CASE WHEN sum(power) > 0 THEN coalesce(sum(power) FILTER ({_FAR}), 0) / sum(power) ELSE 0.0 END AS share FROM power GROUP BY 1),
around AS (SELECT item_id, h, y, x, lag(v) OVER r + lead(v) OVER r + lag(v) OVER c + lead(v) OVER c - 4 * v AS edge FROM grey
  WINDOW r AS (PARTITION BY item_id, y ORDER BY x), c AS (PARTITION BY item_id, x ORDER BY y)),
edges AS (SELECT item_id, var_pop(edge) AS spread FROM around WHERE edge IS NOT NULL GROUP BY 1),
colours AS (SELECT item_id, {_COLOURS},
  {rd('avg(CASE WHEN greatest(r, g, b) > 0 THEN 255 * (greatest(r, g, b) - least(r, g, b)) // greatest(r, g, b) ELSE 0 END) / 255')} AS mean_saturation,
  {rd('avg(greatest(r, g, b)) / 255')} AS mean_brightness FROM grey GROUP BY 1)
SELECT colours.*, {rd('spread')} AS laplacian_var, {rd('share')} AS hf_energy_ratio FROM colours JOIN high USING (item_id) LEFT JOIN edges USING (item_id)"""
ORACLES["mean_spectrum"] = f"""WITH {_GREY},
patch AS (SELECT item_id, source, 32 AS h, y - (h - 32) // 2 AS y, x, v FROM grey WHERE h >= 32 AND y - (h - 32) // 2 BETWEEN 0 AND 31),
tapered AS (SELECT item_id, source, h, y, x, (v - avg(v) OVER (PARTITION BY item_id)) * (0.5 - 0.5 * cos(2 * pi() * y / 31)) * (0.5 - 0.5 * cos(2 * pi() * x / 31)) AS v FROM patch),
{_power('tapered')}
SELECT source, ((w + 16) % 32)::INTEGER AS y, ((u + 16) % 32)::INTEGER AS x, {rd('avg(ln(power + 1e-8))')} AS value FROM power GROUP BY ALL"""
oracle(
    "spectrum_counts",
    f"""SELECT {pick(h(41, 'page_id', 3), ['ffhq', 'sdxl', 'flux'])} AS source,
  count(*) FILTER (ceil(octet_length(encode(html)) / 96.0) >= 32) AS used,
  count(*) FILTER (ceil(octet_length(encode(html)) / 96.0) < 32) AS skipped FROM pages GROUP BY 1""",
)
_CHANNELS = "channels AS (SELECT c, y, x, avg(a) AS v, floor(sqrt((y - 4) * (y - 4) + (x - 4) * (x - 4)))::INTEGER AS r FROM feature_map GROUP BY 1, 2, 3)"
oracle(
    "radial_profile",
    f"WITH feature_map AS ({VIEWS['feature_map'].strip()}), {_CHANNELS} SELECT c, r, {rd('avg(v)')} AS value FROM channels WHERE r < 4 GROUP BY 1, 2",
)
oracle(
    "spectrum_diff",
    f"""WITH feature_map AS ({VIEWS['feature_map'].strip()}), {_CHANNELS}
SELECT c, {rd('tail')} AS upper_half_log_power, CASE WHEN c <> 0 THEN {rd('gap')} END AS mean_abs_diff
FROM (SELECT c, avg(m) AS tail FROM (SELECT c, r, avg(v) AS m FROM channels WHERE r BETWEEN 2 AND 3 GROUP BY 1, 2) GROUP BY 1)
JOIN (SELECT a.c, avg(abs(a.v - b.v)) AS gap FROM channels a JOIN channels b ON b.c = 0 AND a.y = b.y AND a.x = b.x GROUP BY 1) USING (c)""",
)
_CONF = f"""count(*) FILTER (label = 'fake' AND prob >= {T}) AS tp, count(*) FILTER (label = 'real' AND prob >= {T}) AS fp,
  count(*) FILTER (label = 'fake' AND prob < {T}) AS fn, count(*) FILTER (label = 'real' AND prob < {T}) AS tn"""
oracle("confusion", f"SELECT test_set, {_CONF} FROM test_sets GROUP BY 1", "test_sets")


def _rates(p: str = "") -> dict[str, str]:
    tp, fp, fn, tn = (f"{p}{c}::DOUBLE" for c in ("tp", "fp", "fn", "tn"))
    precision = f"CASE WHEN {p}tp + {p}fp > 0 THEN {tp} / ({tp} + {fp}) ELSE 0.0 END"
    recall = f"CASE WHEN {p}tp + {p}fn > 0 THEN {tp} / ({tp} + {fn}) ELSE 0.0 END"
    return {
        "accuracy": f"({tp} + {tn}) / ({tp} + {fp} + {fn} + {tn})",
        "balanced_accuracy": f"0.5::DOUBLE * ({recall} + CASE WHEN {p}tn + {p}fp > 0 THEN {tn} / ({tn} + {fp}) ELSE 0.0 END)",
        "precision": precision,
        "recall_tpr": recall,
        "f1": f"CASE WHEN {p}tp > 0 THEN 2 * {tp} / (2 * {tp} + {fp} + {fn}) ELSE 0.0 END",
        "fpr": f"CASE WHEN {p}tn + {p}fp > 0 THEN {fp} / ({fp} + {tn}) ELSE 0.0 END",
    }


_RATE_COLUMNS = ", ".join(f"{rd(e)} AS {k}" for k, e in _rates().items())
oracle(
    "threshold_metrics",
    f"SELECT test_set, tp, fp, fn, tn, {T} AS threshold, {_RATE_COLUMNS} FROM (SELECT test_set, {_CONF} FROM test_sets GROUP BY 1)",
    "test_sets",
)


def points(keys: str) -> str:
    """Distinct scores with counts at or above, and class totals."""
    return f"""SELECT {keys}, prob, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY {keys}) AS p,
    sum(neg) OVER (PARTITION BY {keys}) AS n
  FROM (SELECT {keys}, prob, count(*) FILTER (label = 'fake') AS pos, count(*) FILTER (label = 'real') AS neg FROM src GROUP BY {keys}, prob)
  WINDOW w AS (PARTITION BY {keys} ORDER BY prob DESC)"""


_AUC = "CASE WHEN max(p) > 0 AND max(n) > 0 THEN sum(neg * (tp - pos + pos / 2.0::DOUBLE)) / max(p)::DOUBLE / max(n)::DOUBLE END"
_AP = "CASE WHEN max(p) > 0 AND max(n) > 0 THEN sum(pos * tp::DOUBLE / (tp + fp)::DOUBLE) / max(p)::DOUBLE END"
_TPR5 = """CASE WHEN max(p) > 0 AND max(n) > 0 THEN
  coalesce(max(tp) FILTER (fp::DOUBLE / n::DOUBLE <= 0.05::DOUBLE), 0)::DOUBLE / max(p)::DOUBLE END"""


def set_oracle(name: str, body: str, keys: str = "test_set", source: str = "test_sets") -> None:
    inner = with_views(f"SELECT * FROM {source}", source)
    ORACLES[name] = f"WITH src AS MATERIALIZED ({inner}), pts AS ({points(keys)})\n{body.strip()}"


set_oracle(
    "roc_curve",
    f"""SELECT test_set, {rd('prob')} AS threshold, {rd('fp::DOUBLE / n::DOUBLE')} AS fpr, {rd('tp::DOUBLE / p::DOUBLE')} AS tpr FROM pts
UNION ALL SELECT DISTINCT test_set, 'inf'::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM pts""",
)
set_oracle(
    "ranking_metrics",
    f"SELECT test_set, {rd(_AUC)} AS roc_auc, {rd(_AP)} AS pr_auc, {rd(_TPR5)} AS tpr_at_fpr FROM pts GROUP BY 1",
)
_EDGES = "[" + ", ".join(f"{i}::DOUBLE * (1.0::DOUBLE / 15.0::DOUBLE)" for i in range(1, 15)) + "]"
_BIN = f"len(list_filter({_EDGES}, lambda e: e < prob))::INTEGER"


def _ece(keys: str) -> str:
    return f"""SELECT {keys}, sum(abs(pos - s)) / sum(c)::DOUBLE AS ece FROM (
  SELECT {keys}, {_BIN} AS b, count(*) FILTER (label = 'fake') AS pos, sum(prob) AS s, count(*) AS c FROM src GROUP BY {keys}, b)
GROUP BY {keys}"""


set_oracle("ece", f"SELECT test_set, {rd('ece')} AS ece FROM ({_ece('test_set')})")
set_oracle(
    "reliability_bins",
    f"""SELECT test_set, bin, {rd('bin * (1.0::DOUBLE / 15.0::DOUBLE)')} AS bin_low,
  {rd('CASE WHEN bin = 14 THEN 1.0 ELSE (bin + 1) * (1.0::DOUBLE / 15.0::DOUBLE) END')} AS bin_high,
  coalesce(c, 0) AS count, {rd('m')} AS mean_prob, {rd('f')} AS frac_positive
FROM (SELECT DISTINCT test_set, unnest(range(15))::INTEGER AS bin FROM src)
LEFT JOIN (SELECT test_set, {_BIN} AS bin, count(*) AS c, avg(prob) AS m, avg((label = 'fake')::INTEGER) AS f FROM src GROUP BY 1, 2)
  USING (test_set, bin)""",
)
set_oracle("brier", f"SELECT test_set, {rd('''avg((prob - (label = 'fake')::INTEGER) ** 2)''')} AS brier FROM src GROUP BY 1")
oracle(
    "nll",
    f"""SELECT dataset, split, {rd("avg(greatest(z, 0) - z * (label = 'fake')::INTEGER + ln(1 + exp(-abs(z))))")} AS nll
FROM (SELECT *, logit / 1.5::DOUBLE AS z FROM predictions) GROUP BY 1, 2""",
    "predictions",
)
_CELLS = ", ".join(
    f"sum({v}) FILTER (prob {op} {t})::BIGINT AS {pre}{k}"
    for pre, t in (("tuned_", T), ("half_", "0.5::DOUBLE"))
    for k, op, v in (("tp", ">=", "pos"), ("fp", ">=", "neg"), ("fn", "<", "pos"), ("tn", "<", "neg"))
)
_CELLS = _CELLS.replace("sum(", "coalesce(sum(").replace(")::BIGINT", "), 0)::BIGINT")
_REPORT = f"""report AS (SELECT m.*, e.ece, {', '.join(f'{e} AS {pre}{k}' for pre in ('tuned_', 'half_') for k, e in _rates(pre).items())}
  FROM (SELECT model, test_set, sum(pos + neg)::BIGINT AS n, sum(neg)::BIGINT AS n_real, sum(pos)::BIGINT AS n_fake, {_AUC} AS roc_auc,
    {_AP} AS pr_auc, {_TPR5} AS tpr_at_fpr, sum(pos * (prob - 1) ** 2 + neg * prob ** 2) / sum(pos + neg) AS brier, {_CELLS}
    FROM (SELECT * EXCLUDE (n), n AS n FROM pts) GROUP BY 1, 2) m
  JOIN ({_ece('model, test_set')}) e USING (model, test_set))"""
_REPORT_DOUBLES = ["roc_auc", "pr_auc", "tpr_at_fpr", "brier", "ece"] + [p + k for p in ("tuned_", "half_") for k in _rates()]


def report_oracle(name: str, body: str) -> None:
    set_oracle(name, "SELECT 1", keys="model, test_set")
    ORACLES[name] = ORACLES[name].rsplit("\n", 1)[0] + ",\n" + _REPORT + "\n" + body.strip()


report_oracle(
    "full_report",
    f"SELECT * REPLACE ({', '.join(f'{rd(c)} AS {c}' for c in _REPORT_DOUBLES)}) FROM report",
)
_SPREAD = f"""shares AS (SELECT *, {h(61, 'item_id', 4)} AS share FROM src),
spread AS (SELECT model, test_set, min(auc) AS low, max(auc) AS high FROM (SELECT model, share, test_set, {_AUC} AS auc
  FROM ({points('model, share, test_set').replace('FROM src', 'FROM shares')}) GROUP BY 1, 2, 3) GROUP BY 1, 2)"""
_REPORT += ",\n" + _SPREAD
_DOC_COLUMNS = ("tuned_balanced_accuracy", "tuned_precision", "tuned_recall_tpr", "tuned_f1", "tuned_fpr", "ece")
report_oracle(
    "metrics_document",
    f"""SELECT model, test_set, '| ' || test_set || ' | ' || n || ' | ' || printf('%.3f', roc_auc) || ' | ' ||
  coalesce('[' || printf('%.3f', low) || ', ' || printf('%.3f', high) || ']', 'TBD') || ' | ' ||
  {" || ' | ' || ".join(f"printf('%.3f', {c})" for c in _DOC_COLUMNS)} || ' |' AS line FROM report LEFT JOIN spread USING (model, test_set)
UNION ALL SELECT 'm9', s, '| ' || s || repeat(' | TBD', 9) || ' |' FROM (SELECT unnest(['id_test', 'crossgen_full', 'own']) AS s)""",
)
_SWAP = "starts_with(test_set, 'fake_swap_')"
report_oracle(
    "summarize_models",
    f"""SELECT model, {rd("max(roc_auc) FILTER (test_set = 'id_test')")} AS id_auc, {rd(f"avg(roc_auc) FILTER ({_SWAP})")} AS crossgen_mean_auc,
  {rd(f"min(low) FILTER ({_SWAP} AND roc_auc IS NOT NULL)")} AS crossgen_min_auc_ci_low,
  {rd("max(roc_auc) FILTER (test_set = 'crossgen_full')")} AS crossgen_full_auc,
  {rd("max(roc_auc) FILTER (test_set = 'own')")} AS own_auc, {rd("any_value(p95)")} AS p95_latency_ms
FROM report LEFT JOIN spread USING (model, test_set) LEFT JOIN (SELECT 'm' || (user_id % 3) AS model, quantile_cont(value, 0.95) AS p95 FROM events WHERE user_id % 3 <> 2 GROUP BY 1) USING (model)
GROUP BY model""",
)
oracle(
    "per_source_rates",
    f"""SELECT test_set, source, label, count(*) AS n, {rd(f'avg((prob >= {T})::INTEGER)')} AS rate FROM test_sets GROUP BY 1, 2, 3""",
    "test_sets",
)


def robust(name: str, select: str, groups: str, where: str) -> None:
    inner = with_views(f"SELECT *, CASE split WHEN 'test' THEN 'id_test' ELSE 'crossgen_full' END AS test_set FROM perturbed {where}", "perturbed")
    r = _rates()
    ORACLES[name] = f"""WITH src AS MATERIALIZED ({inner}), pts AS ({points(groups)}),
conf AS (SELECT {groups}, {_CONF}, count(*) AS cnt FROM src GROUP BY {groups}),
aucs AS (SELECT {groups}, {_AUC} AS roc_auc FROM pts GROUP BY {groups}),
res AS (SELECT {groups}, cnt AS n, roc_auc, {r['balanced_accuracy']} AS balanced_accuracy, {r['accuracy']} AS accuracy,
  {r['fpr']} AS fpr, {r['recall_tpr']} AS tpr FROM conf JOIN aucs USING ({groups}))
{select}"""


_RD_ALL = ", ".join(f"{rd(c)} AS {c}" for c in ("roc_auc", "balanced_accuracy", "accuracy", "fpr", "tpr"))
robust("robustness_metrics", f"SELECT * REPLACE ({_RD_ALL}) FROM res", "test_set, family, level", "")
_PICKED = (("none", 0.0), ("jpeg_quality", 50.0), ("jpeg_quality", 30.0), ("downscale", 0.5), ("blur_sigma", 2.0))
robust(
    "robustness_document",
    "SELECT m AS model, '| ' || m || ' | ' || "
    + " || ' | ' || ".join(
        f"coalesce(printf('%.3f', (SELECT balanced_accuracy FROM res WHERE model = m AND family = '{f}' AND level = {lv})), 'TBD')"
        for f, lv in _PICKED
    )
    + " || ' |' AS line FROM (SELECT unnest(['m0', 'm1', 'm2', 'm9']) AS m)",
    "model, family, level",
    "WHERE split = 'test'",
)
_JUDGED = f"(SELECT *, {_OUTCOME} AS outcome FROM test_sets)"
oracle("outcome_counts", f"SELECT test_set, outcome, count(*) AS n FROM {_JUDGED} GROUP BY 1, 2", "test_sets")
oracle("prediction_counts", "SELECT dataset, split, label, count(*) AS n FROM predictions GROUP BY ALL", "predictions")
oracle(
    "latency_percentiles",
    f"""SELECT event_type AS model, {rd('quantile_cont(value, 0.5)')} AS p50_ms, {rd('quantile_cont(value, 0.95)')} AS p95_ms,
  {rd('avg(value)')} AS mean_ms, count(*) AS runs FROM events GROUP BY 1""",
)
_W = "[0.5, -1.0, 1.5, -2.0][c + 1]::DOUBLE"
_G = "[1.0, 0.5, 2.0, 1.5][c + 1]::DOUBLE"
_CAM = f"SELECT item_id, y, x, greatest(sum({_W} * a), 0.0) AS value, greatest(-sum({_W} * a), 0.0) AS other FROM feature_map GROUP BY 1, 2, 3"
oracle("gradcam_map", f"SELECT item_id, y, x, {rd('value')} AS value FROM ({_CAM})", "feature_map")
_GRAD = f"""SELECT item_id, c, (v - avg(v) OVER i - hh * avg(v * hh) OVER i) / s AS g FROM (
  SELECT *, d / s AS hh, {_W} * {_G} AS v FROM (SELECT *, sqrt(avg(d * d) OVER (PARTITION BY item_id) + 1e-6) AS s
    FROM (SELECT *, m - avg(m) OVER (PARTITION BY item_id) AS d FROM (SELECT item_id, c, avg(a) AS m FROM feature_map GROUP BY 1, 2))))
  WINDOW i AS (PARTITION BY item_id)"""
oracle("layernorm_gradient", f"SELECT item_id, c, {rd('g', 4)} AS g FROM ({_GRAD})", "feature_map")
oracle(
    "gradcam_map_normed",
    f"""SELECT item_id, y, x, {rd('greatest(-sum(g * a), 0.0)', 5)} AS value FROM feature_map JOIN ({_GRAD}) USING (item_id, c) GROUP BY 1, 2, 3""",
    "feature_map",
)
oracle(
    "minmax_map",
    f"""SELECT item_id, y, x, {rd('CASE WHEN hi - lo < 1e-12 THEN 0.0 ELSE (value - lo) / (hi - lo) END')} AS value FROM (
  SELECT *, min(value) OVER (PARTITION BY item_id) AS lo, max(value) OVER (PARTITION BY item_id) AS hi FROM ({_CAM}))""",
    "feature_map",
)
oracle(
    "spearman_by_item",
    f"""SELECT item_id, {rd('CASE WHEN stddev_pop(ru) > 0 AND stddev_pop(rv) > 0 THEN corr(ru, rv) END')} AS spearman FROM (
  SELECT item_id, rank() OVER (PARTITION BY item_id ORDER BY value) + (count(*) OVER (PARTITION BY item_id, value) - 1) / 2.0::DOUBLE AS ru,
    rank() OVER (PARTITION BY item_id ORDER BY other) + (count(*) OVER (PARTITION BY item_id, other) - 1) / 2.0::DOUBLE AS rv
  FROM ({_CAM})) GROUP BY 1""",
    "feature_map",
)

ORACLES["mean_spearman"] = f"WITH each AS (\n{ORACLES['spearman_by_item']}\n)\nSELECT {rd('avg(spearman)')} AS mean_spearman, count(spearman) AS n FROM each"

# --- order and limits
oracle(
    "split_validation",
    f"""SELECT rel_path, label, CASE WHEN split <> 'valid' THEN split WHEN k <= n // 2 THEN 'val_select' ELSE 'val_calib' END AS split
FROM (SELECT *, row_number() OVER (PARTITION BY split, label ORDER BY {hx(42, 'sha256')}, rel_path) AS k,
  count(*) OVER (PARTITION BY split, label) AS n FROM manifest)""",
    "manifest",
)
oracle("hash_sample", f"SELECT rel_path, source FROM manifest ORDER BY {hx(42, 'rel_path')}, rel_path LIMIT 100", "manifest")
oracle(
    "sample_groups",
    f"""SELECT source, label, rel_path FROM manifest
QUALIFY row_number() OVER (PARTITION BY source, label ORDER BY {hx(42, 'rel_path')}, rel_path) <= 5""",
    "manifest",
)
oracle(
    "sample_fraction",
    f"""SELECT label, rel_path FROM predictions
QUALIFY row_number() OVER (PARTITION BY label ORDER BY {hx(42, 'rel_path')}, rel_path) <= round_even(0.3::DOUBLE * count(*) OVER (PARTITION BY label), 0)""",
    "predictions",
)
oracle("rank_detections", f"SELECT image_id, k::INTEGER AS face_rank, score FROM ({_ORDERED}) WHERE k <= 10", "detections")
oracle(
    "top_face",
    f"""SELECT image_id, least(n, 10) AS num_faces, score, x1, y1
FROM ({_ORDERED}) WHERE k = 1""",
    "detections",
)
oracle(
    "worst_errors",
    f"""SELECT test_set, outcome, rel_path FROM {_JUDGED} WHERE outcome IN ('FP', 'FN')
QUALIFY row_number() OVER (PARTITION BY test_set, outcome ORDER BY CASE outcome WHEN 'FP' THEN -prob ELSE prob END, rel_path) <= 5""",
    "test_sets",
)
oracle(
    "outcome_gallery",
    f"""SELECT test_set, outcome, rel_path FROM {_JUDGED}
QUALIFY row_number() OVER (PARTITION BY test_set, outcome ORDER BY {hx(42, 'rel_path')}, rel_path) <= 4""",
    "test_sets",
)
oracle(
    "threshold_for_fpr",
    f"""SELECT test_set, round(nextafter(prob, 'inf'::DOUBLE), 9) AS threshold, n AS n_real FROM (
  SELECT test_set, prob, row_number() OVER (PARTITION BY test_set ORDER BY prob DESC) - 1 AS k, count(*) OVER (PARTITION BY test_set) AS n
  FROM test_sets WHERE label = 'real') WHERE k = floor(0.05::DOUBLE * n)""",
    "test_sets",
)
set_oracle(
    "youden_threshold",
    f"""SELECT test_set, {rd('CASE WHEN max(g) > 0 THEN least(max(prob) FILTER (g = top), 1.0) ELSE 1.0 END')} AS threshold
FROM (SELECT *, max(g) OVER (PARTITION BY test_set) AS top FROM (SELECT *, tp::DOUBLE / p::DOUBLE - fp::DOUBLE / n::DOUBLE AS g FROM pts))
GROUP BY test_set""",
)
set_oracle(
    "uncertainty_band",
    f"""SELECT test_set, {rd('coalesce(min(d) FILTER (capture >= 0.5), max(d))')} AS delta,
  {rd('arg_min(abstention, CASE WHEN capture >= 0.5 THEN d ELSE 10 - d END)')} AS abstention,
  {rd('arg_min(capture, CASE WHEN capture >= 0.5 THEN d ELSE 10 - d END)')} AS capture
FROM (SELECT test_set, d, avg(inside::INTEGER) AS abstention,
    CASE WHEN sum(wrong::INTEGER) > 0 THEN sum((inside AND wrong)::INTEGER) / sum(wrong::INTEGER)::DOUBLE ELSE 1.0 END AS capture
  FROM (SELECT test_set, d, abs(prob - {T}) < d AS inside, (prob >= {T}) <> (label = 'fake') AS wrong
    FROM src, (SELECT unnest(range(51)) / 100.0::DOUBLE AS d)) GROUP BY 1, 2)
WHERE abstention <= 0.15 GROUP BY test_set""",
)
oracle(
    "select_model",
    """, judged AS (SELECT *, CASE WHEN id_auc IS NULL THEN 'no in-distribution AUC'
    WHEN id_auc < (SELECT max(id_auc) FROM model_summary) - 0.03::DOUBLE THEN 'AUC below margin'
    WHEN p95_latency_ms IS NULL THEN 'no latency measurement' WHEN p95_latency_ms > 500 THEN 'latency above budget' END AS excluded
  FROM model_summary),
crossed AS (SELECT * FROM judged WHERE excluded IS NULL AND crossgen_mean_auc IS NOT NULL),
leader AS (SELECT * FROM crossed ORDER BY crossgen_mean_auc DESC, id_auc DESC, model LIMIT 1),
close AS (SELECT model, p95_latency_ms, crossgen_mean_auc, id_auc FROM crossed
  WHERE model = (SELECT model FROM leader) OR crossgen_mean_auc >= (SELECT crossgen_min_auc_ci_low FROM leader)),
won AS (SELECT model FROM close ORDER BY p95_latency_ms, crossgen_mean_auc DESC, id_auc DESC, model LIMIT 1)
SELECT model, excluded, model IN (SELECT model FROM close) AND (SELECT count(*) FROM close) > 1 AS tied,
  model IN (SELECT model FROM won) AS winner FROM judged""",
    "model_summary",
)
ORACLES["select_model"] = ORACLES["select_model"].replace(")\n, judged", "),\njudged")
_SELECT_CTES = ORACLES["select_model"].rsplit("\nSELECT model, excluded", 1)[0]
ORACLES["selection_document"] = f"""{_SELECT_CTES}
SELECT s.model, '| ' || s.model || ' | ' || printf('%.3f', id_auc) || ' | ' || coalesce(printf('%.3f', crossgen_mean_auc), 'TBD') || ' | ' ||
  printf('%.3f', own_auc) || ' | ' || coalesce(printf('%.0f', p95_latency_ms), 'TBD') || ' |' AS line,
  s.model IN (SELECT model FROM won) AS winner FROM model_summary s"""
oracle(
    "early_stop",
    """, best AS (SELECT *, max(val_auc) OVER (PARTITION BY run ORDER BY epoch) AS top FROM epochs),
since AS (SELECT run, epoch, top, (SELECT min(e.epoch) FROM epochs e WHERE e.run = b.run AND e.val_auc = b.top) AS top_at FROM best b),
ends AS (SELECT run, min(epoch) FILTER (epoch - top_at >= 4) AS stop, max(epoch) AS final FROM since GROUP BY run)
SELECT run, top_at AS best_epoch, top AS best_auc, epoch AS epochs_run, stop IS NOT NULL AS stopped
FROM since JOIN ends USING (run) WHERE epoch = coalesce(stop, final)""",
    "epochs",
)
ORACLES["early_stop"] = ORACLES["early_stop"].replace(")\n, best", "),\nbest")
oracle(
    "history_page",
    """SELECT id, user_id, num_faces, (SELECT count(*) FROM history WHERE user_id = 7) AS total FROM history WHERE user_id = 7
ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 10""",
    "history",
)

# --- sets
oracle(
    "concat_manifests",
    """SELECT dataset, rel_path FROM manifest WHERE read_error IS NULL
UNION ALL SELECT 'own', rel_path FROM manifest WHERE read_error IS NULL""",
    "manifest",
)
oracle("build_test_sets", "SELECT test_set, item_id, label, source FROM test_sets", "test_sets")
oracle(
    "probe_score",
    f"""SELECT item_id, {rd('sum(v * ((k - 1) % 7 - 3) / 10.0::DOUBLE) + 0.25')} AS logit
FROM (SELECT item_id, unnest(x) AS v, unnest(range(1, 65)) AS k FROM probe_rows) GROUP BY 1""",
    "probe_rows",
)

# --- requests and streams
_LIMIT = """WITH RECURSIVE ordered AS (SELECT event_id, user_id, epoch_us(ts) AS us,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
walk AS (
  SELECT event_id, user_id, k, us, true AS accepted, NULL::INTEGER AS retry_after, [us] AS hits FROM ordered WHERE k = 1
  UNION ALL
  SELECT event_id, user_id, k, us, len(live) < 2,
    CASE WHEN len(live) >= 2 THEN greatest(1, ((43200000000 - (us - live[1])) // 1000000) + 1)::INTEGER END,
    CASE WHEN len(live) < 2 THEN list_append(live, us) ELSE live END
  FROM (SELECT o.event_id, o.user_id, o.k, o.us, list_filter(w.hits, lambda t: o.us - t < 43200000000) AS live
    FROM walk w JOIN ordered o ON o.user_id = w.user_id AND o.k = w.k + 1))
SELECT event_id, accepted, retry_after FROM walk"""
ORACLES["sliding_rate_limit"] = _LIMIT
ORACLES["stream_rate_limit"] = _LIMIT
oracle(
    "client_key",
    """SELECT event_id, CASE event_type WHEN 'view' THEN '10.0.0.' || user_id WHEN 'signup' THEN 'unknown'
    ELSE '192.168.0.' || user_id END AS trusted,
  CASE event_type WHEN 'signup' THEN 'unknown' ELSE '192.168.0.' || user_id END AS direct FROM events""",
)
oracle(
    "stream_verdicts",
    f"""SELECT page_id, error, {_STATUS} AS status, CASE WHEN error IS NULL THEN {rd('p')} END AS prob,
  CASE WHEN error IS NULL THEN CASE WHEN abs(p - {T}) < {D} THEN 'UNCERTAIN' WHEN p >= {T} THEN 'AI_GENERATED' ELSE 'REAL' END END AS verdict
FROM (SELECT *, {_ERROR} AS error, {sigmoid('logit / 1.5::DOUBLE')} AS p FROM ({_UPLOADS}))""",
    "file_bytes",
)
oracle(
    "stream_progress",
    """SELECT '140k' AS dataset, 'doc/' || user_id AS rel_path, event_id AS seq,
  CASE event_type WHEN 'error' THEN 'read_error' ELSE 'ok' END AS status FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""",
)
oracle(
    "expire_images",
    """SELECT id, CASE WHEN NOT old THEN image_path END AS image_path, old AS purged
FROM (SELECT *, created_at < TIMESTAMP '2024-01-15' AND image_path IS NOT NULL AS old FROM history)""",
    "history",
)
oracle(
    "purge_count",
    "SELECT count(*) AS purged FROM history WHERE created_at < TIMESTAMP '2024-01-15' AND image_path IS NOT NULL",
    "history",
)

# --- fits: the root of the slope of the mean loss in b = 1/T, narrowed on a grid of 200 points, five times


def _narrowed(source: str, keys: str) -> str:
    """CTEs ending in `fit`: (keys, t) for rows (keys, label, logit) of `source`."""
    by = f"{keys}," if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    ctes = [
        f"hist AS MATERIALIZED (SELECT {by} logit AS z, count(*)::DOUBLE AS n, count(*) FILTER (label = 'fake')::DOUBLE AS pos FROM {source} GROUP BY {by} logit)",
        f"r0 AS (SELECT {by} exp(-3.0::DOUBLE) AS lo, exp(3.0::DOUBLE) AS hi FROM hist {group or 'LIMIT 1'})",
    ]
    using = f"USING ({keys})" if keys else "ON true"
    for i in range(5):
        ctes.append(
            f"""r{i + 1} AS (SELECT {by} max(b) FILTER (slope <= 0) AS lo, min(b) FILTER (slope > 0) AS hi FROM (
  SELECT {by} b, sum(z * (n / (1 + exp(-greatest(least(z * b, 50), -50))) - pos)) AS slope
  FROM hist JOIN (SELECT {by} unnest(list_transform(range(201), lambda k: lo + (hi - lo) * k / 200.0::DOUBLE)) AS b FROM r{i}) {using}
  GROUP BY {by} b) {group})"""
        )
    ctes.append(f"fit AS (SELECT {by} 2 / (lo + hi) AS t FROM r5)")
    return ",\n".join(ctes)


_PRED = f"predictions AS ({VIEWS['predictions'].strip()})"
ORACLES["fit_temperature"] = f"""WITH {_PRED},
{_narrowed('predictions', '')}
SELECT 'temperature' AS name, round(t, 6) AS value FROM fit"""
ORACLES["temperature_per_split"] = f"""WITH {_PRED},
{_narrowed('predictions', 'dataset')}
SELECT dataset AS name, round(t, 5) AS value FROM fit"""
_CALIBRATED = f"""WITH {_PRED},
calib AS MATERIALIZED (SELECT * FROM predictions WHERE dataset = '140k' AND split = 'val_calib'),
{_narrowed('calib', '')},
src AS MATERIALIZED (SELECT label, logit, 1 AS one, {sigmoid('logit / t')} AS prob, {sigmoid('logit')} AS raw, t FROM calib, fit),
cut AS (SELECT nextafter(prob, 'inf'::DOUBLE) AS thr FROM (SELECT prob, row_number() OVER (ORDER BY prob DESC) - 1 AS k, count(*) OVER () AS n
  FROM src WHERE label = 'real') WHERE k = floor(0.05::DOUBLE * n)),
pts AS ({points('one')}),
widths AS (SELECT d, avg((abs(prob - thr) < d)::INTEGER) AS abstention,
    sum((abs(prob - thr) < d AND (prob >= thr) <> (label = 'fake'))::INTEGER)::DOUBLE / sum(((prob >= thr) <> (label = 'fake'))::INTEGER) AS capture
  FROM src, cut, (SELECT unnest(range(51)) / 100.0::DOUBLE AS d) GROUP BY d),
allowed AS (SELECT *, CASE WHEN capture >= 0.5 THEN d ELSE 10 - d END AS place FROM widths WHERE abstention <= 0.15)
SELECT name, round(value::DOUBLE, 6) AS value FROM (
  SELECT 'temperature' AS name, t AS value FROM fit
  UNION ALL SELECT 'threshold', thr FROM cut
  UNION ALL SELECT 'target_fpr', 0.05
  UNION ALL SELECT 'achieved_fpr', avg((prob >= thr)::INTEGER) FROM src, cut WHERE label = 'real'
  UNION ALL SELECT 'achieved_tpr', avg((prob >= thr)::INTEGER) FROM src, cut WHERE label = 'fake'
  UNION ALL SELECT 'youden_threshold', arg_max(prob, tp::DOUBLE / p - fp::DOUBLE / n) FROM pts
  UNION ALL SELECT 'uncertainty_delta', arg_min(d, place) FROM allowed
  UNION ALL SELECT 'abstention_rate', arg_min(abstention, place) FROM allowed
  UNION ALL SELECT 'errors_captured', arg_min(capture, place) FROM allowed
  UNION ALL SELECT 'ece_before', ece FROM ({_ece('one').replace('prob', 'raw')})
  UNION ALL SELECT 'ece_after', ece FROM ({_ece('one')})
  UNION ALL SELECT 'nll_before', avg(greatest(logit, 0) - logit * (label = 'fake')::INTEGER + ln(1 + exp(-abs(logit)))) FROM src
  UNION ALL SELECT 'nll_after', avg(greatest(logit / t, 0) - logit / t * (label = 'fake')::INTEGER + ln(1 + exp(-abs(logit / t)))) FROM src
  UNION ALL SELECT 'n', count(*) FROM src)"""
ORACLES["calibrate"] = _CALIBRATED
