"""Code-to-label maps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values of the event log and the device table.
MODE_NAMES = {"0": "stimulation", "1": "expression", "2": "mixed", "3": "custom"}
SOURCE_NAMES = {"remote_app": "app", "local_device": "hardware"}
REGION_NAMES = {"EC": "US-East", "EU": "Europe", "AP": "Asia-Pacific"}
STATUS_CODES = {"bound": 2, "unbound": 1}


def relabel(code: Column, names: dict, other: Column | None = None) -> Column:
    """The label of a code; an unknown code stays as it is, or becomes ``other``."""
    out = None
    for key, label in names.items():
        out = F.when(code == key, label) if out is None else out.when(code == key, label)
    return out.otherwise(code if other is None else other)


def mode_name(code: Column) -> Column:
    return relabel(code, MODE_NAMES)


def region_name(source: Column) -> Column:
    return relabel(source, REGION_NAMES, F.lit("other"))


def region_code(region: str) -> str:
    """Filter value -> stored code; an unknown value is passed through."""
    return {label: code for code, label in REGION_NAMES.items()}.get(region, region)


def status_code(status: str) -> str | int:
    return STATUS_CODES.get(status, status)
