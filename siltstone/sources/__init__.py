"""siltstone sources."""
