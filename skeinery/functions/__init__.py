"""Part of skeinery."""
