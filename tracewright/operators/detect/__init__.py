"""Anomaly detection: features, detectors, metrics and stored results."""
