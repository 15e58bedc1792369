"""Snapshots of trees: tables, manifests, file systems."""
