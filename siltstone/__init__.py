"""siltstone: file-knowledge search and analytics as Spark DataFrame plans."""
