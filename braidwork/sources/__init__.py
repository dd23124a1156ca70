"""Readers, writers and what they sniff out first."""
