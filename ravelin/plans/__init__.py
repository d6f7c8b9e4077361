"""The query language: tokens, syntax trees, parsers and logical plans."""
