"""Operators over ordered control logs and streams."""
