"""Readers for threat feeds, configuration tables and observation tables."""
