"""Readers of JSON records with fixed schemas, configuration and its fingerprint."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "turns": "start_s double, end_s double, state string, speaker string, text string",
    "events": "type string, t_s double, confidence double, evidence string, outcome string, meta map<string,string>",
    "telephony": "t_s double, kind string, detail string",
    "gold": "call_id string, start double, end double, label string, agreement double, human_id string",
    "queue": "call_id string, start double, end double, label string, agreement double, min_voters int, has_tie boolean, human_id string, reason string, final_label string, reviewer_note string",
    "manifest": "chunk_id string, source_file string, source_call string, index int, offset_s double, duration_s double, path string",
    "timeline": "t_s double, state string, confidence double, speaker_id string, text string, transfer_in_progress boolean, latency_ms double, sub_label string, evidence string",
}


def read_jsonl(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Records of a file, folder or glob, one JSON object a line, with the file's name as call_id where the records have none."""
    df = spark.read.schema(SCHEMAS[kind]).json(path)
    return df if "call_id" in df.columns else df.withColumn("call_id", F.regexp_extract(F.col("_metadata.file_name"), r"^([^.]+)", 1))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest written as one JSON array."""
    return spark.read.schema(SCHEMAS["manifest"]).option("multiLine", "true").json(path)


def read_carrier_log(spark: SparkSession, path: str) -> DataFrame:
    """Carrier events, in order of call and time within each partition."""
    return read_jsonl(spark, path, "telephony").sortWithinPartitions("call_id", "t_s")


SEGMENT = "start double, end double, label string, confidence double, evidence string, human_id string"


def parse_segments(raw: Column) -> Column:
    """Segments of a labeler's raw JSON answer: a list, or an object with a list under 'segments'; confidence 0.5 where it is missing; NULL for unreadable answers."""
    text = F.regexp_replace(raw, r"(?s)^.*?```(?:json)?\s*|```.*$", "")
    listed = F.from_json(text, f"array<struct<{SEGMENT.replace(' ', ':').replace(',:', ',')}>>")
    nested = F.from_json(F.get_json_object(text, "$.segments"), f"array<struct<{SEGMENT.replace(' ', ':').replace(',:', ',')}>>")
    return F.transform(F.coalesce(F.when(F.ltrim(text).startswith("["), listed), nested), lambda s: s.withField("confidence", F.coalesce(s["confidence"], F.lit(0.5))))


@dataclass(frozen=True)
class Config:
    """Numbers of the online pipeline (fixed values)."""

    sample_rate: int = 8000
    frame_ms: int = 20
    window_s: float = 6.0
    hop_s: float = 0.5
    decision_s: float = 2.5
    lexical_s: float = 4.0
    context_hops: int = 8
    speaker_similarity: float = 0.86
    commit_probability: float = 0.45
    announce_s: float = 45.0
    most_transfer_s: float = 240.0
    least_hold_s: float = 1.0
    settle_s: float = 2.0

    @classmethod
    def from_json(cls, path: str) -> Config:
        return cls(**json.loads(Path(path).read_text()))

    def fingerprint(self) -> str:
        """First twelve hexadecimal digits of the SHA-256 of the sorted JSON."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:12]
