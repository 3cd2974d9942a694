"""State changes and quality rules over whole snapshots."""
