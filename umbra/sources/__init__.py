"""umbra.sources."""
