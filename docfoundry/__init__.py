"""Spark jobs for document corpora: chunking, tables, search, access, upkeep and streams."""
