"""Scans, literal sources, generators and blob readers."""
