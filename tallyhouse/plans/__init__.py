"""The reports and the change jobs."""
