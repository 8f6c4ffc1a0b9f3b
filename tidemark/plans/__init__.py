"""Named analytics, models with their dependencies, and the batch pipeline."""
