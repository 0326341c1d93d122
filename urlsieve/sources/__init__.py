"""Readers, line parsers for threat feeds, and writers."""
