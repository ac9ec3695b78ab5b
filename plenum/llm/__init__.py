"""Training-data operators. Nothing else in plenum imports this subpackage."""
