"""lurewatch: URL risk reports as Spark batch and streaming jobs."""
