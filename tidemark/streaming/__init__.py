"""Incremental forms of operators whose state is small. These are additions of this library's own."""
