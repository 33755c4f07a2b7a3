"""Labels for z-scores."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: thresholds on |z| and the label each one earns, strictest first
SIGMA_BANDS = ((2.0, "Significant"), (1.0, "Notable"))
P_VALUE_BANDS = (
    (2.58, "Highly Significant (p<0.01)"),
    (1.96, "Significant (p<0.05)"),
    (1.64, "Notable (p<0.10)"),
)


def band(z: Column, bands=SIGMA_BANDS) -> Column:
    """The first label whose threshold ``|z|`` exceeds; ``Normal`` for the rest and NULL."""
    label = F.lit("Normal")
    for threshold, name in reversed(bands):
        label = F.when(F.abs(z) > F.lit(threshold), F.lit(name)).otherwise(label)
    return label
