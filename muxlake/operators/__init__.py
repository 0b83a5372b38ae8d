"""Operators on packet, frame and capture tables."""
