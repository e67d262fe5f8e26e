"""umbra.operators."""
