"""siltstone plans."""
