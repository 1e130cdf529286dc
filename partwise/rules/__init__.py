"""Fixed rule values. Order matters wherever the first hit decides."""
