"""Anomaly analytics for daily entity series, written as Spark DataFrame transformations."""

from tempora.spec import ObservationSpec

__all__ = ["ObservationSpec"]
