"""Sources of assets."""
