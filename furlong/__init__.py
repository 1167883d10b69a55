"""Contest-panel analytics on Spark."""
