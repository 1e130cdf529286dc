"""Similarity weights, thresholds and unit synonyms of duplicate detection."""

WEIGHTS = {"name": 0.35, "spec": 0.25, "maker": 0.15, "type": 0.10, "unit": 0.05, "attributes": 0.10}
EDGE, HIGH, MEDIUM = 0.65, 0.85, 0.65
AUTO_MERGE, REVIEW = 0.85, 0.75
UNITS = {
    "个": ["个", "只", "件", "套", "pcs", "pc"],
    "kg": ["kg", "千克", "公斤", "kgs"],
    "g": ["g", "克", "公克"],
    "m": ["m", "米", "公尺"],
    "l": ["l", "升", "公升", "liter"],
}
EXISTING_GAIN = 0.1
