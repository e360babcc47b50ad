"""tablekit: inspect, clean, validate, compare and reshape tabular and document data on Spark."""
