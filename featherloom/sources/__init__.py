"""Scans and sinks for the text formats the operators read and write."""
