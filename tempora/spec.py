"""Column roles and analysis parameters shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class ObservationSpec:
    """Names the columns of an observation table and the periods it is analysed over.

    ``baseline`` serves the daily climatology, the monthly matrix, threshold days and degree
    days; ``summary_baseline`` serves the year-to-date and monthly summaries, which use a longer
    reference period. ``cutoff`` is the last month-day (``MM-dd``) of the year-to-date slice.
    """

    entity: str = "city"
    time: str = "time"
    temp: str = "temperature_2m_mean"
    temp_min: str = "temperature_2m_min"
    temp_max: str = "temperature_2m_max"
    precip: str = "precipitation_sum"
    snow: str = "snowfall_sum"
    sun: str = "sunshine_duration"
    wind: str = "wind_speed_10m_max"
    et0: str = "et0_fao_evapotranspiration"
    baseline: tuple[int, int] = (1991, 2020)
    summary_baseline: tuple[int, int] = (1991, 2025)
    current_year: int = 2026
    cutoff: str = "12-31"
    sentinel: float = -999.0

    @property
    def measures(self) -> list[str]:
        return [
            self.temp, self.temp_min, self.temp_max, self.precip,
            self.snow, self.sun, self.wind, self.et0,
        ]

    def present(self, df: DataFrame) -> list[str]:
        """The measures that this table really has; the schema is optional per source."""
        return [c for c in self.measures if c in df.columns]
