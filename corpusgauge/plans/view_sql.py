"""The same views as SQL text, for the engine that checks the results."""

from __future__ import annotations

from corpusgauge.functions.formats import STANDARD_LUMA_TABLE
from corpusgauge.plans.views import SPLITS, TEMPERATURE


def h(seed: int, key: str, n: int) -> str:
    """stable hash % n"""
    return f"(('0x'||substr(sha256('{seed}:'||CAST({key} AS VARCHAR)),1,16))::UBIGINT % {n})::BIGINT"


def hx(seed: int, key: str) -> str:
    return f"substr(sha256('{seed}:'||CAST({key} AS VARCHAR)),1,16)"


def pick(index: str, values: list[str]) -> str:
    listed = ", ".join(f"'{v}'" for v in values)
    return f"([{listed}])[({index}) + 1]"


def sigmoid(x: str) -> str:
    return f"(1.0::DOUBLE / (1.0::DOUBLE + exp(-greatest(least(({x}), 50.0::DOUBLE), -50.0::DOUBLE))))"


def output_name_sql() -> str:
    suffix = f"lpad(CAST({h(0, 'rel_path', 10**8)} AS VARCHAR), 8, '0')"
    return f"dataset || '/' || split || '/' || label || '/' || substr(sha256, 1, 16) || '_' || {suffix} || '.jpg'"


_PICK_LEVEL = (
    "CASE substr(o_orderpriority,1,1) WHEN '1' THEN 'train' WHEN '2' THEN 'val_select' "
    "WHEN '3' THEN 'val_calib' ELSE 'test' END"
)

VIEWS: dict[str, str] = {}

VIEWS["predictions"] = f"""
SELECT item_id, model, dataset, CASE WHEN dataset = '140k' THEN part ELSE dataset END AS split,
  CASE WHEN dataset = '140k' THEN CASE WHEN label = 'real' THEN 'ffhq' ELSE 'stylegan' END
       WHEN dataset = 'own' THEN CASE WHEN label = 'real' THEN 'phone' ELSE 'mygen' END
       WHEN label = 'real' THEN 'celebahq' ELSE {pick(h(7, 'item_id', 2), ['sdxl', 'flux'])} END AS source,
  label, 'item/' || item_id AS rel_path, tenths, tenths / 10.0::DOUBLE AS logit
FROM (
  SELECT o_orderkey AS item_id, 'm' || (o_custkey % 3) AS model,
    CASE o_orderstatus WHEN 'P' THEN '140k' WHEN 'F' THEN 'crossgen' ELSE 'own' END AS dataset,
    CASE WHEN z + 4.0::DOUBLE * (u - 0.5::DOUBLE) > 0 THEN 'fake' ELSE 'real' END AS label,
    floor(17.0::DOUBLE * z + 0.5::DOUBLE)::BIGINT AS tenths, {_PICK_LEVEL} AS part
  FROM (SELECT *, (o_totalprice - 250000.0::DOUBLE) / 125000.0::DOUBLE AS z,
          {h(42, 'o_orderkey', 10000)} / 10000.0::DOUBLE AS u FROM orders))
"""
VIEWS["scored"] = f"SELECT *, {sigmoid(f'logit / {TEMPERATURE}::DOUBLE')} AS prob FROM predictions"

_FORMAT = pick(h(5, "doc_id", 4), ["jpeg", "png", "webp", "unknown"])
_FLAGS = {s: pick(h(s, "doc_id", 3), ["True", "False", "1"]) for s in (21, 22, 23)}
VIEWS["manifest"] = f"""
SELECT CASE WHEN lang = 'en' THEN '140k' ELSE 'crossgen' END AS dataset, source,
  {pick(h(1, 'doc_id', 2), ['real', 'fake'])} AS label,
  CASE WHEN lang <> 'en' THEN 'crossgen' WHEN {h(2, 'doc_id', 7)} <= 4 THEN 'train'
       WHEN {h(2, 'doc_id', 7)} = 5 THEN 'valid' ELSE 'test' END AS split,
  'doc/' || doc_id AS rel_path, sha256(text) AS sha256, {_FORMAT} AS format,
  ({h(3, 'doc_id', 512)} + 64)::INTEGER AS width, ({h(4, 'doc_id', 512)} + 64)::INTEGER AS height,
  'RGB' AS mode, n_chars AS file_size,
  CASE WHEN {_FORMAT} = 'jpeg' THEN ({h(8, 'doc_id', 100)} + 1)::INTEGER END AS jpeg_quality_est,
  {_FLAGS[21]} AS has_exif, {_FLAGS[22]} AS has_icc, {_FLAGS[23]} AS has_xmp,
  CASE WHEN {h(6, 'doc_id', 50)} = 0 THEN 'truncated' END AS read_error
FROM documents
"""
VIEWS["ledger"] = f"""
SELECT dataset, source, label, split, rel_path, sha256, status,
  CASE WHEN status = 'ok' THEN 1 + {h(32, 'rel_path', 3)} END AS num_faces,
  CASE WHEN status = 'ok' THEN {h(33, 'rel_path', 4)} = 0 END AS crop_clamped,
  CASE WHEN status = 'ok' THEN {output_name_sql()} END AS processed_rel_path
FROM (SELECT *, CASE WHEN read_error IS NOT NULL THEN 'read_error' WHEN {h(30, 'rel_path', 20)} = 0 THEN 'no_face'
        WHEN {h(30, 'rel_path', 20)} = 1 THEN 'duplicate_dropped' ELSE 'ok' END AS status FROM manifest)
"""


def _sql_flips(seed: int) -> str:
    masks = [
        f"CASE WHEN {h(10, 'item_id', 6)} > {j} THEN 1::UBIGINT << {h(seed, f'''(item_id || ':{j}')''', 64)} ELSE 0::UBIGINT END"
        for j in range(5)
    ]
    out = masks[0]
    for m in masks[1:]:
        out = f"xor({out}, {m})"
    return out


def _sql_bits(test: str) -> str:
    return f"list_sum(list_transform(range(64), lambda k: CASE WHEN {test} THEN 1::UBIGINT << k::INTEGER ELSE 0::UBIGINT END))::UBIGINT"


VIEWS["fingerprints"] = f"""
SELECT item_id, phash, dhash, CASE WHEN split IN ('crossgen', 'own') THEN split ELSE '140k' END AS dataset, split,
  'img/' || item_id AS rel_path, {pick(h(14, 'item_id', 2), ['real', 'fake'])} AS label
FROM (SELECT *, {pick(h(13, 'item_id', 6), list(SPLITS))} AS split FROM (
  WITH base AS (SELECT vec_id AS item_id,
    {_sql_bits('embedding[k + 1] > 0')} AS phash, {_sql_bits('embedding[k + 1] > embedding[(k + 1) % 64 + 1]')} AS dhash
    FROM embeddings)
  SELECT * FROM base UNION ALL
  SELECT item_id + 1000000000000, xor(phash, {_sql_flips(11)}), xor(dhash, {_sql_flips(12)}) FROM base
  WHERE item_id % 3 = 0))
"""
VIEWS["detections"] = f"""
SELECT image_id, pos, x1, y1, x1 + 10.0::DOUBLE + l_tax * 1000.0::DOUBLE AS x2,
  y1 + 10.0::DOUBLE + l_discount * 900.0::DOUBLE AS y2, 0.8::DOUBLE + l_discount * 2.0::DOUBLE AS prob,
  image_width, image_height, least(1.0::DOUBLE, 1024.0::DOUBLE / greatest(image_width, image_height)) AS scale
FROM (SELECT l_orderkey AS image_id, l_linenumber AS pos, l_quantity * 4.0::DOUBLE AS x1,
    l_linenumber * 20.0::DOUBLE AS y1, l_tax, l_discount,
    (200 + l_orderkey * 7919 % 1800)::INTEGER AS image_width,
    (200 + l_orderkey * 104729 % 1800)::INTEGER AS image_height FROM lineitem)
"""
VIEWS["history"] = f"""
SELECT event_id AS id, user_id, ts AS created_at, 1 + {h(15, 'event_id', 3)} AS num_faces,
  CASE WHEN {h(16, 'event_id', 4)} > 0 THEN 'up/' || event_id || '.jpg' END AS image_path, value AS latency_ms
FROM events
"""
VIEWS["features"] = """
SELECT doc_id, n_chars::DOUBLE AS n_chars, len(string_split(text, ' '))::DOUBLE AS n_words,
  length(regexp_replace(text, '[^0-9]', '', 'g'))::DOUBLE AS n_digits,
  len(string_split(text, chr(10)))::DOUBLE AS n_lines, 1.0::DOUBLE AS fixed,
  CASE WHEN quality = 0 THEN 'fake' ELSE 'real' END AS label
FROM documents JOIN labels USING (doc_id)
"""
VIEWS["probe_rows"] = f"""
SELECT vec_id AS item_id, embedding::DOUBLE[] AS x, CASE WHEN label < 5 THEN 'fake' ELSE 'real' END AS label,
  CASE WHEN {h(17, 'vec_id', 5)} = 0 THEN 'val' ELSE 'train' END AS split
FROM embeddings
"""
VIEWS["progress"] = f"""
SELECT event_id AS seq, '140k' AS dataset, 'doc/' || user_id AS rel_path,
  CASE event_type WHEN 'error' THEN 'read_error' WHEN 'view' THEN 'no_face' ELSE 'ok' END AS status,
  'out/' || event_id || '.jpg' AS processed_rel_path
FROM events WHERE {h(18, 'event_id', 25)} > 1
"""
VIEWS["file_bytes"] = f"""
SELECT page_id, url AS rel_path, unhex({pick(h(40, 'page_id', 7), [
    'FFD8FF', '89504E470D0A1A0A', '52494646000000005745425056503820', '474946383961', '424D', '474946383761', ''
])}) || encode(html) AS content
FROM pages
"""
VIEWS["epochs"] = """
SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch,
  round(value, 0) AS val_auc
FROM events
"""
VIEWS["feature_map"] = """
SELECT item_id, c, p // 8 AS y, p % 8 AS x, embedding[p + 1]::DOUBLE AS a
FROM (SELECT vec_id - vec_id % 4 AS item_id, (vec_id % 4)::INTEGER AS c, embedding, unnest(range(len(embedding)))::INTEGER AS p
      FROM embeddings)
"""
VIEWS["quant_tables"] = f"""
SELECT item_id, CASE WHEN {h(52, 'item_id', 10)} > 0 THEN list_transform(scaled, lambda v, i:
    CASE WHEN i = 1 THEN v + {h(51, 'item_id', 40)} ELSE v END) END AS quant
FROM (SELECT item_id, list_transform({list(STANDARD_LUMA_TABLE)},
    lambda v: least(255, greatest(1, (v * percent + 50) // 100))) AS scaled
  FROM (SELECT item_id, CASE WHEN q < 50 THEN 5000 // q ELSE 200 - 2 * q END AS percent
    FROM (SELECT p_partkey AS item_id, (1 + {h(50, 'p_partkey', 100)}) AS q FROM part)))
"""
VIEWS["grid"] = """
SELECT (row_number() OVER () - 1)::INTEGER AS step, family, level FROM (VALUES
  ('none', 0.0::DOUBLE),
  ('jpeg_quality', 100.0), ('jpeg_quality', 90.0), ('jpeg_quality', 80.0), ('jpeg_quality', 70.0),
  ('jpeg_quality', 60.0), ('jpeg_quality', 50.0), ('jpeg_quality', 40.0), ('jpeg_quality', 30.0),
  ('downscale', 1.0), ('downscale', 0.75), ('downscale', 0.5), ('downscale', 0.35), ('downscale', 0.25),
  ('blur_sigma', 0.5), ('blur_sigma', 1.0), ('blur_sigma', 1.5), ('blur_sigma', 2.0), ('blur_sigma', 3.0),
  ('screenshot', 1.0), ('screenshot', 2.0), ('screenshot', 3.0)) t(family, level)
"""
VIEWS["perturbed"] = f"""
SELECT p.* EXCLUDE (logit, l2), l2 AS logit, {sigmoid(f'l2 / {TEMPERATURE}::DOUBLE')} AS prob
FROM (SELECT *, (tenths + ((item_id * 31 + step * 17) % 21 - 10) * step) / 10.0::DOUBLE AS l2
  FROM predictions, grid WHERE split IN ('test', 'crossgen')) p
"""
VIEWS["model_summary"] = """
SELECT model, (9600 + s % 400) / 10000.0::DOUBLE AS id_auc,
  CASE WHEN n % 7 <> 0 THEN (6000 + k % 3000) / 10000.0::DOUBLE END AS crossgen_mean_auc,
  CASE WHEN n % 7 <> 0 THEN (5900 + k % 3000 - s % 50) / 10000.0::DOUBLE END AS crossgen_min_auc_ci_low,
  (7000 + sk % 2500) / 10000.0::DOUBLE AS own_auc,
  CASE WHEN n % 5 <> 0 THEN (100 + sk % 600)::DOUBLE END AS p95_latency_ms
FROM (SELECT p_brand AS model, count(*) AS n, sum(p_size)::BIGINT AS s, sum(p_partkey)::BIGINT AS k,
  sum(p_size * p_partkey)::BIGINT AS sk FROM part GROUP BY 1)
"""
VIEWS["test_sets"] = """
SELECT * FROM (
  SELECT *, 'id_test' AS test_set FROM scored WHERE dataset = '140k' AND split = 'test'
  UNION ALL SELECT *, 'crossgen_full' FROM scored WHERE dataset = 'crossgen'
  UNION ALL SELECT *, 'own' FROM scored WHERE dataset = 'own'
  UNION ALL SELECT *, 'fake_swap_' || source FROM scored WHERE dataset = 'crossgen' AND label = 'fake'
  UNION ALL SELECT s.*, 'fake_swap_' || c.source FROM scored s,
    (SELECT DISTINCT source FROM scored WHERE dataset = 'crossgen' AND label = 'fake') c
    WHERE s.dataset = '140k' AND s.split = 'test' AND s.label = 'real'
  UNION ALL SELECT *, 'real_swap_' || source FROM scored WHERE dataset = 'crossgen' AND label = 'real'
  UNION ALL SELECT s.*, 'real_swap_' || c.source FROM scored s,
    (SELECT DISTINCT source FROM scored WHERE dataset = 'crossgen' AND label = 'real') c
    WHERE s.dataset = '140k' AND s.split = 'test' AND s.label = 'fake')
QUALIFY count(*) FILTER (label = 'fake') OVER (PARTITION BY test_set) > 0
  AND count(*) FILTER (label = 'real') OVER (PARTITION BY test_set) > 0
"""

NEEDS = {
    "scored": ["predictions"],
    "ledger": ["manifest"],
    "perturbed": ["predictions", "grid"],
    "test_sets": ["scored"],
}


def with_views(query: str, *names: str) -> str:
    """Put the named views, and what they build on, in front of a query."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for base in NEEDS.get(name, []):
            add(base)
        if name not in wanted:
            wanted.append(name)

    for name in names:
        add(name)
    ctes = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in wanted)
    return f"WITH {ctes}\n{query.strip()}"
