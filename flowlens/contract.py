"""Fixed vocabularies and the versioned feature contract."""

from __future__ import annotations

from dataclasses import dataclass


# ---- fixed values: versions -------------------------------------------------------------
FEATURE_SCHEMA_VERSION = "1.0"
DATASET_VERSION = "1.0"
CLASS_DEFINITION_VERSION = "1.0"
PREPROCESSING_VERSION = "1.0"
RULES_VERSION = "1.0.0"
EVIDENCE_VERSION = "1"
LABEL_SOURCES = ("user_provided",)

# ---- fixed values: capture files --------------------------------------------------------
CAPTURE_EXTENSIONS = ("pcap", "cap", "pcapng")
BURST_WINDOW_SECONDS = 0.1
HISTOGRAM_EDGES = (0, 64, 256, 1024, 4096, 65536)

# ---- fixed values: traffic classes ------------------------------------------------------
TRAFFIC_CLASSES = ("VOIP", "MESSAGING", "EMAIL", "WEB", "VIDEO", "ICMP", "UNKNOWN")
UNKNOWN_CLASS = "UNKNOWN"
CLASS_MIN_SAMPLES = 10

# ---- fixed values: dataset settings -----------------------------------------------------
SPLIT_SEED = 42
TRAIN_RATIO = 0.7
VALIDATION_RATIO = 0.15
MIN_TOTAL_SAMPLES = 40
MIN_SAMPLES_PER_CLASS = 2
MIN_CAPTURES_PER_SPLIT = 1
MIN_SAMPLES_FOR_METRICS = 20
MIN_CONFIDENCE = 0.60
LOW_CONFIDENCE = 0.75

# ---- fixed values: finding categories -----------------------------------
CATEGORIES = (
    "CRYPTOGRAPHY",
    "KEY_EXCHANGE",
    "PFS",
    "SECURITY_ASSOCIATION",
    "REPLAY_PROTECTION",
    "PROTOCOL",
    "METADATA",
    "CONFIGURATION",
    "VISIBILITY",
)


@dataclass(frozen=True)
class Feature:
    name: str
    nullable: bool = False
    minimum: float | None = 0.0
    maximum: float | None = None


# ---- fixed values: the 27 classifier features, in contract order -------------------------
FEATURES = (
    Feature("packet_count"),
    Feature("byte_count"),
    Feature("duration_seconds"),
    Feature("packets_per_second", nullable=True),
    Feature("bytes_per_second", nullable=True),
    Feature("packet_size_mean", nullable=True),
    Feature("packet_size_median", nullable=True),
    Feature("packet_size_std", nullable=True),
    Feature("packet_size_min", nullable=True),
    Feature("packet_size_max", nullable=True),
    Feature("packet_size_p25", nullable=True),
    Feature("packet_size_p75", nullable=True),
    Feature("interarrival_mean", nullable=True),
    Feature("interarrival_median", nullable=True),
    Feature("interarrival_std", nullable=True),
    Feature("interarrival_min", nullable=True),
    Feature("interarrival_max", nullable=True),
    Feature("upstream_packets"),
    Feature("downstream_packets"),
    Feature("upstream_bytes"),
    Feature("downstream_bytes"),
    Feature("direction_ratio", nullable=True, maximum=1.0),
    Feature("burst_count"),
    Feature("burst_packets_ratio", maximum=1.0),
    Feature("burst_mean_size"),
    Feature("burst_max_size"),
    Feature("burst_mean_duration"),
)
FEATURE_NAMES = tuple(feature.name for feature in FEATURES)

# ---- fixed values: columns that must never become features -------------------------------
EXCLUDED_FIELDS = frozenset(
    (
        "id",
        "analysis_id",
        "capture_id",
        "flow_id",
        "flow_key",
        "prediction_id",
        "created_at",
        "updated_at",
        "start_time",
        "end_time",
        "timestamp",
        "first_seen",
        "last_seen",
        "source_ip",
        "destination_ip",
        "source_port",
        "destination_port",
        "spi",
        "transport",
        "protocol",
        "title",
        "description",
        "filename",
        "path",
        "user_agent",
        "category",
        "packet_size_histogram",
        "severity",
        "finding_type",
        "rule_id",
        "evidence_digest",
    )
)

assert len(FEATURE_NAMES) == len(set(FEATURE_NAMES)) == 27
assert not EXCLUDED_FIELDS & set(FEATURE_NAMES)
