"""Column-level building blocks: URL parts, dates, scores."""
