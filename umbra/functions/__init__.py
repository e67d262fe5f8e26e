"""umbra.functions."""
