"""Search-demand analytics on Spark."""
