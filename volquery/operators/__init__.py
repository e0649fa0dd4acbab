"""Tiling, statistics, models, stitching, pyramids, telemetry and metadata."""
