"""The manifest's schema and vocabularies."""

from __future__ import annotations

# fixed values
MANIFEST_DDL = (
    "relative_path STRING, label BIGINT, class_name STRING, surface STRING, source_group STRING, source_group_verified BOOLEAN, "
    "group_resolution_method STRING, sha256 STRING, perceptual_hash STRING, width BIGINT, height BIGINT, source_width BIGINT, "
    "source_height BIGINT, source_mode STRING, image_format STRING, file_size_bytes BIGINT, exif_orientation BIGINT, "
    "audit_status STRING, audit_error STRING, split STRING"
)
GROUP_MAP_DDL = "relative_path STRING, source_group STRING, verified STRING, review_notes STRING, sha256 STRING"
PREDICTION_DDL = "relative_path STRING, y_true INT, score DOUBLE, threshold DOUBLE, y_pred INT, outcome STRING, sha256 STRING"
JOURNAL_DDL = "epoch INT, loss DOUBLE, val_loss DOUBLE, accuracy DOUBLE, val_accuracy DOUBLE, learning_rate DOUBLE"
SURFACES = ["D", "P", "W"]
SPLITS = ["train", "validation", "test"]
OUTCOMES = ["TP", "TN", "FP", "FN"]
RATIOS = {"train": 0.70, "validation": 0.15, "test": 0.15}
CLASS_FOLDERS = {"CD": ("D", 1), "UD": ("D", 0), "CP": ("P", 1), "UP": ("P", 0), "CW": ("W", 1), "UW": ("W", 0)}
TRUTHY = ["1", "true", "yes", "y", "verified"]
SHA256 = "^[0-9a-f]{64}$"
LABEL_TOLERANCE, SURFACE_TOLERANCE, STRATUM_TOLERANCE = 0.05, 0.05, 0.10
EPSILON = 1e-12
