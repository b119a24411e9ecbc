"""Value bands: classification of readings and occupancy of histograms."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.channels import SEVERITY, band_index, band_label
from ..functions.shape import dense, occupancy


@dataclass(frozen=True)
class BandScheme:
    """Ascending boundaries and one label more; the outer bands are open."""

    boundaries: tuple[float, ...]
    labels: tuple[str, ...]

    def __post_init__(self):
        if list(self.boundaries) != sorted(set(self.boundaries)):
            raise ValueError("boundaries must ascend")
        if len(self.labels) != len(self.boundaries) + 1:
            raise ValueError("there must be one label more than boundaries")

    @classmethod
    def severity(cls, elevated: float, warning: float, critical: float) -> BandScheme:
        return cls((elevated, warning, critical), tuple(SEVERITY))

    def classify(self, df: DataFrame, value: str = "value") -> DataFrame:
        """df with band and band_index; null values have none."""
        v = F.col(value)
        index = F.when(v.isNotNull() & ~F.isnan(v), band_index(v, list(self.boundaries)))
        return df.withColumns({"band_index": index, "band": F.when(index.isNotNull(), band_label(v, list(self.boundaries), list(self.labels)))})

    def occupancy(self, histogram: DataFrame, schemas: DataFrame, keys: list[str]) -> DataFrame:
        """A share of the window's mass per band, a column each."""
        return dense(histogram, schemas, keys).select(*keys, *occupancy(list(self.boundaries), list(self.labels)))
