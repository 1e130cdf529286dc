"""partwise: record linkage, classification and data quality for item master data, on Spark."""
