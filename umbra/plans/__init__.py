"""umbra.plans."""
