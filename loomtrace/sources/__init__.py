"""Readers, writers and the injected completion connector."""
