"""Readers of tables, advisories and configuration."""
