"""Readers, writers, contracts and manifests."""
