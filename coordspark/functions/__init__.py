"""Part of coordspark."""
