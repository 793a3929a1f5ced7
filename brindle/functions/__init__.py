"""Part of the brindle engine."""
