"""Packet, frame and capture tables read out of the driver's tables."""
