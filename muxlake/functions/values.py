"""Values as they are written on a command line."""

from __future__ import annotations


def integer(text: str, least: int | None = None, most: int | None = None) -> int:
    """A whole number, decimal or with 0x, within the bounds given."""
    try:
        value = int(text, 0)
    except ValueError:
        raise ValueError(f"{text!r} is not a whole number") from None
    if least is not None and value < least or most is not None and value > most:
        raise ValueError(f"{value} is not from {least} to {most}")
    return value


def unsigned(text: str, most: int | None = None) -> int:
    """A whole number of 0 or more."""
    return integer(text, 0, most)


def real(text: str, least: float | None = None, most: float | None = None) -> float:
    """A number within the bounds given."""
    try:
        value = float(text)
    except ValueError:
        raise ValueError(f"{text!r} is not a number") from None
    if least is not None and value < least or most is not None and value > most:
        raise ValueError(f"{value} is not from {least} to {most}")
    return value


def host_port(text: str, default_port: int | None = None) -> tuple[str, int]:
    """Host and port of ``host:port``; the port may be left out where there is a default."""
    host, colon, port = text.partition(":")
    if not host or not colon and default_port is None:
        raise ValueError(f"{text!r} names no host and port")
    return host, integer(port, 1, 65535) if colon else default_port


def ids(text: str, most: int = 0x1FFF) -> list[int]:
    """Numbers separated by commas, as PIDs to keep."""
    return [unsigned(t.strip(), most) for t in text.split(",") if t.strip()]
