"""Explicit schemas of the file formats; nothing is inferred."""

from __future__ import annotations

POINTS = "array<array<double>>"

COCO = (
    "images array<struct<id bigint, file_name string, width int, height int, license int, date_captured string>>, "
    "categories array<struct<id bigint, name string, supercategory string>>, "
    "annotations array<struct<id bigint, image_id bigint, category_id bigint, bbox array<double>, area double, iscrowd int, "
    f"segmentation {POINTS}, rotation double, attributes map<string,string>>>"
)

RESULT = (
    "struct<id string, type string, from_name string, annotationType string, value struct<x double, y double, width double, height double, "
    f"rotation double, points {POINTS}, rectanglelabels array<string>, polygonlabels array<string>, brushlabels array<string>, "
    "labels array<string>, choices array<string>, text string, region_comment string>, meta struct<text array<string>>>"
)
_GROUPS = f"array<struct<result array<{RESULT}>, response array<{RESULT}>>>"
TASK = (
    "id bigint, file_upload string, data map<string,string>, "
    f"annotations {_GROUPS}, completions {_GROUPS}, predictions {_GROUPS}, result array<{RESULT}>"
)

CORRECTIONS = "request_id string, corrections array<struct<component string, value string>>, _corrupt_record string"

EPOCHS = (
    "epoch int, time double, `train/box_loss` double, `train/seg_loss` double, `val/box_loss` double, `val/seg_loss` double, "
    "`metrics/mAP50(B)` double, `metrics/mAP50(M)` double"
)

MANIFEST = "filename string, label string, node_id string, degree string, position_row string, position_col string, timestamp string"
SWEEP = "image string, angle double, overlap double, max_joins int, timeout boolean, returncode int, elapsed_s double, stdout string"
MESSAGE = "session_id string, turn bigint, role string, content string, ts timestamp, updates map<string,string>"
ENTRY = "id string, type string, label string, filename string, payload string, is_delete boolean, seq bigint"
REQUEST = "ts timestamp, outcome string, latency_ms double"
EPOCH_EVENT = "run string, epoch int, time_s double, map50 double"
