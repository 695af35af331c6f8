"""End-to-end jobs and the catalogue of named queries."""
