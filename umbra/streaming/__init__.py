"""umbra.streaming."""
