"""Entity models, loaders and metadata."""
