"""End-to-end data products built from the operators."""
