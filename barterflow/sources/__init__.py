"""Readers, writers and source accounting."""
