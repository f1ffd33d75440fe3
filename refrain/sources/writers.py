"""Sinks K1 to K9: Parquet tables, partitioned where they are read by part; reports are tables too."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_features(rows: DataFrame, path: str, mode: str = "append") -> None:
    """K1: by split."""
    rows.write.mode(mode).partitionBy("split").parquet(path)


def write_pairs_by_anchor(pairs: DataFrame, path: str) -> None:
    """K3: a folder for each anchor. Rows are brought together by anchor, and a large anchor's are dealt over several tasks by Spark's rebalancing."""
    pairs.hint("rebalance", "anchor_id").write.mode("overwrite").partitionBy("anchor_id").parquet(path)


def write_forms(forms: DataFrame, path: str) -> None:
    """K4: token arrays as text."""
    from pyspark.sql import functions as F

    forms.select(F.array_join("sentence", " ").alias("sentence"), F.array_join("pattern", " ").alias("pattern")).write.mode("overwrite").csv(path)


def write_report(report: DataFrame, path: str) -> None:
    """K5, K8: metric tables and the series that plots would show."""
    report.write.mode("overwrite").parquet(path)


def write_side_outputs(words: DataFrame, lines: DataFrame, path: str) -> None:
    """K2: the mining path's word counts and caught lines."""
    words.write.mode("overwrite").parquet(f"{path}/word_map")
    lines.write.mode("overwrite").parquet(f"{path}/caught_lines")


def write_model(model, path: str) -> None:
    """K6."""
    model.write().overwrite().save(path)


def write_word_counts(counts: DataFrame, path: str) -> None:
    """K7: in ascending order."""
    counts.orderBy("df", "token").write.mode("overwrite").parquet(path)
