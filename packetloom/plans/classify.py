"""From capture files to verdicts: scan, window, features, score, decide."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features, verdict, windows
from ..schemas import MODEL_FEATURES
from ..sources import pcap

SUPPORTED = (1,)


def classify_packets(packets: DataFrame, score: Callable[[DataFrame], DataFrame], threshold: float = verdict.THRESHOLD, **policy) -> DataFrame:
    """Verdicts of captures. score adds the column score to rows of the 22 model features. Captures without full windows are INSUFFICIENT_DATA, captures with
    an error packet ERROR."""
    sound, failed = windows.without_failed_captures(packets)
    scored = score(features.base_features(sound).select("pcap_id", "window_index", *MODEL_FEATURES)).select("pcap_id", "score")
    out = verdict.verdicts(scored, threshold, captures=sound.select("pcap_id"), **policy)
    broken = failed.select("pcap_id", F.lit("ERROR").alias("status"))
    return out.unionByName(broken, allowMissingColumns=True)


def classify_files(spark: SparkSession, path: str, score: Callable[[DataFrame], DataFrame], **policy) -> DataFrame:
    """Verdicts of all captures at path. Those of other link types are UNSUPPORTED_INPUT, files without a capture header ERROR; neither are read further, as
    the scan gets the list of the others."""
    kinds = [(r.pcap_path, r.linktype) for r in pcap.linktypes(spark, path).collect()]
    good = [p for p, kind in kinds if kind in SUPPORTED]
    rows = [(pcap.capture_id(p), "ERROR" if kind is None else "UNSUPPORTED_INPUT") for p, kind in kinds if kind not in SUPPORTED]
    skipped = spark.createDataFrame(rows, "pcap_id string, status string")
    if not good:
        return skipped
    return classify_packets(pcap.packets(spark, path, files=json.dumps(good)), score, **policy).unionByName(skipped, allowMissingColumns=True)
