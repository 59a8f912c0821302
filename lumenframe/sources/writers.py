"""Writers for tables and reports. Each task writes its own part file."""

from __future__ import annotations

from pyspark.sql import DataFrame

PAIR_FIELDS = ["feature_a", "feature_b", "value", "abs_value", "strength", "direction"]


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per row, missing fields written as null."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_frame(df: DataFrame, path: str, fmt: str = "csv") -> None:
    (write_json if fmt == "json" else write_csv)(df, path)


def export_pairs(pairs: DataFrame, path: str, fmt: str = "csv") -> None:
    """Correlation pairs with their six fields."""
    write_frame(pairs.select(*PAIR_FIELDS), path, fmt)


def export_sections(sections: dict[str, DataFrame], path: str, fmt: str = "json") -> None:
    """A report: one folder per section."""
    for name, frame in sections.items():
        write_frame(frame, f"{path}/{name}", fmt)
