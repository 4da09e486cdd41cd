"""siltstone functions."""
