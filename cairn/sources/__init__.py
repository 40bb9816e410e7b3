"""Readers, writers and adapters that feed the operators."""
