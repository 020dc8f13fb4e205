"""Catalog scans, feature tables and file indexes."""
