"""umbra.protocol: the cryptographic layer, for small fixtures that show it gives the semantic layer's answers."""
