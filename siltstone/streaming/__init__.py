"""siltstone streaming."""
