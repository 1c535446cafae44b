"""Vocabulary, schemas and configuration of an audit."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import types as T

# These strings and numbers are part of the interface and of the results.
SPLITS = ("train", "val", "test")
SEVERITIES = ("critical", "high", "medium", "low", "info")
EXACT_CROSS = "exact_cross_split_leakage"
NEAR_CROSS = "near_duplicate_cross_split_leakage"
SEMANTIC = "possible_semantic_overlap"
CONFLICT = "conflicting_label_duplicate"
REDUNDANT = "same_split_redundancy"
CORRUPT = "corrupt_sample"
CLASS_IMBALANCE = "class_imbalance"
SPLIT_IMBALANCE = "split_imbalance"
PAIR_KINDS = (EXACT_CROSS, NEAR_CROSS, SEMANTIC, CONFLICT, REDUNDANT)
CONFIRMED = "Confirmed exact duplicate"
LIKELY = "Likely near duplicate"
POSSIBLE = "Possible semantic overlap"
NEEDS_REVIEW = "Requires human review"
METHODS = ("sha256", "phash", "embedding")
DECISIONS = ("unreviewed", "confirmed", "safe", "uncertain")
STATUSES = ("queued", "running", "complete", "failed", "deleted")
STAGES = (
    ("queued", "Queued"), ("validating", "Validating"), ("indexing", "Indexing"),
    ("exact_duplicate_analysis", "Exact duplicate analysis"), ("near_duplicate_analysis", "Near-duplicate analysis"),
    ("semantic_analysis", "Semantic analysis"), ("scoring", "Scoring"), ("evaluation_experiment", "Evaluation experiment"),
    ("report_generation", "Report generation"), ("complete", "Complete"),
)
UNLABELED = "(unlabeled)"
SPLIT_ALIASES = {"train": "train", "training": "train", "val": "val", "valid": "val", "validation": "val", "dev": "val", "test": "test", "testing": "test",
    "eval": "test"}
EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp")
#: category: (weight, share of samples at which the whole weight applies)
PENALTIES = {EXACT_CROSS: (35.0, 0.05), CONFLICT: (25.0, 0.03), NEAR_CROSS: (20.0, 0.10), SEMANTIC: (8.0, 0.25), REDUNDANT: (5.0, 0.30),
    CORRUPT: (6.0, 0.10), CLASS_IMBALANCE: (3.0, 10.0), SPLIT_IMBALANCE: (3.0, None)}
IMBALANCE_OK, IMBALANCE_FULL = 2.0, 10.0
TEST_MIN, TEST_LOW, TEST_HIGH, TEST_SPAN = 0.05, 0.10, 0.40, 0.3

SAMPLES = T.StructType([
    T.StructField("idx", T.LongType()), T.StructField("sample_id", T.StringType()), T.StructField("split", T.StringType()),
    T.StructField("label", T.StringType()), T.StructField("rel_path", T.StringType()), T.StructField("sha256", T.StringType()),
    T.StructField("phash", T.LongType()), T.StructField("width", T.LongType()), T.StructField("height", T.LongType()),
    T.StructField("bytes", T.LongType()), T.StructField("img_format", T.StringType()), T.StructField("corrupt", T.BooleanType()),
    T.StructField("error", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
])
REVIEWS = T.StructType([T.StructField("finding_id", T.StringType()), T.StructField("decision", T.StringType()), T.StructField("note", T.StringType()),
    T.StructField("updated_at", T.TimestampType())])


@dataclass(frozen=True)
class AuditConfig:
    """Options of an audit. `resolve` takes overrides, where None means the default and 0 means 0, and clamps them."""

    enable_exact: bool = True
    enable_perceptual: bool = True
    enable_semantic: bool = True
    phash_threshold: int = 8
    phash_strong_threshold: int = 4
    semantic_threshold: float = 0.90
    semantic_top_k: int = 10
    run_evaluation: bool = True
    seed: int = 1337
    min_per_class: int = 5
    min_classes: int = 2
    min_test: int = 10
    bootstrap_iterations: int = 1000
    min_bootstrap: int = 20
    #: "binomial" needs two counts, whatever the number of test rows; "sequence" draws row numbers one after another from a legacy
    #: generator, in one task that holds all test rows, and so repeats the digits of tools that do it that way.
    bootstrap: str = "binomial"

    @classmethod
    def resolve(cls, **overrides) -> AuditConfig:
        unknown = set(overrides) - set(cls.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown options: {sorted(unknown)}")
        c = replace(cls(), **{k: v for k, v in overrides.items() if v is not None})
        if c.bootstrap not in ("binomial", "sequence"):
            raise ValueError(f"unknown bootstrap: {c.bootstrap}")
        near = max(0, min(24, int(c.phash_threshold)))
        return replace(c, phash_threshold=near, phash_strong_threshold=max(0, min(near, int(c.phash_strong_threshold))),
            semantic_threshold=max(0.5, min(0.9999, float(c.semantic_threshold))), semantic_top_k=max(1, min(50, int(c.semantic_top_k))))


@dataclass(frozen=True)
class Limits:
    """Bounds of an archive that is taken in."""

    upload_bytes: int = 512 << 20
    uncompressed_bytes: int = 2 << 30
    files: int = 50_000
    member_bytes: int = 64 << 20
    compression_ratio: float = 200.0
    image_pixels: int = 64_000_000
    retention_hours: int = 24
