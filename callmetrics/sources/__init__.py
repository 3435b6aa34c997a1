"""Session packages, tables bound to the canonical shape, and sinks."""
