"""siltstone operators."""
