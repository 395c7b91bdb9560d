"""Readers for the reference's inputs, and adapters from the driver tables."""

from cellsight.sources.files import (read_cleaned, read_flat_csv, read_raw_activity, read_region_mapping,
                                     read_star, with_source_file)
from cellsight.sources.landing import list_landing

__all__ = ["list_landing", "read_cleaned", "read_flat_csv", "read_raw_activity",
           "read_region_mapping", "read_star", "with_source_file"]
