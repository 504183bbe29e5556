"""Registries and composed pipelines."""
