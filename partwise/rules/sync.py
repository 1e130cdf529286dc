"""Source priorities (smaller wins) and the conflict window."""

SOURCE_PRIORITY = {"ERP": 1, "PLM": 2, "PDM": 3, "MRP": 4, "WMS": 5, "manual": 10, "unknown": 99}
CONFLICT_WINDOW_SECONDS = 300
