"""Distribution fingerprinting, bitemporal facts and drift detection on Spark."""
