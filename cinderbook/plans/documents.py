"""Nested results: one document per row, and the sections of a report."""

from __future__ import annotations

from functools import reduce
from pathlib import PurePosixPath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderbook.params import DateRange
from cinderbook.plans import overview
from cinderbook.schemas import Ledger


def reading_documents(rows: DataFrame) -> DataFrame:
    """Readings with their building as a nested object."""
    return rows.select(
        F.col("record_id").alias("id"),
        "date_time",
        "source",
        "consumption_kwh",
        "co2e_emitted",
        F.struct(F.col("building_name").alias("name"), "primary_use", "sq_footage").alias("building"),
    )


def trip_documents(rows: DataFrame) -> DataFrame:
    """Trips with their user as a nested object."""
    return rows.select(
        F.col("trip_id").alias("id"),
        "date",
        "mode",
        "distance_km",
        "co2e_emitted",
        "created_at",
        F.struct(F.col("user_name").alias("name"), "email", "department").alias("user"),
    )


def as_json(rows: DataFrame, key: str = "id") -> DataFrame:
    """Each row as one JSON text beside its key."""
    return rows.select(F.col(key), F.to_json(F.struct(*rows.columns)).alias("document"))


# What names an item within its section.
_ITEMS = {
    "summary": (),
    "scopes": ("emission_scope",),
    "buildings": ("building_name",),
    "monthly_trend": ("month", "source"),
    "energy_sources": ("source",),
    "transport_modes": ("mode",),
}


def carbon_footprint_document(ledger: Ledger, days: DateRange) -> DataFrame:
    """The whole carbon footprint report as rows: section, item, and the item as one JSON document.

    Every building of the range has its document; no section is gathered into one row.
    """
    parts = []
    for name, section in overview.carbon_footprint(ledger, days).items():
        item = F.concat_ws(" ", *[F.col(c).cast("string") for c in _ITEMS[name]])
        parts.append(section.select(F.lit(name).alias("section"), item.alias("item"), F.to_json(F.struct("*")).alias("document")))
    return reduce(DataFrame.unionByName, parts)


def write_sections(sections: dict[str, DataFrame], path: str) -> None:
    """Write every section of a report as JSON lines in a folder of its own."""
    for name, section in sections.items():
        section.write.json(str(PurePosixPath(path) / name))
