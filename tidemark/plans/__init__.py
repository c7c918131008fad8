"""Composed pipelines: event callers over signals and reads, and local reassembly."""
