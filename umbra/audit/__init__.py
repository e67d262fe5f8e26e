"""umbra.audit: how much membership size- and sum-revealing joins leak under a query budget."""
