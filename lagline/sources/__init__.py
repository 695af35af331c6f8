"""Readers, writers, the model store and the adapter for the driver's tables."""
