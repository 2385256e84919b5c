"""Sources, sinks and seeded table generators."""
