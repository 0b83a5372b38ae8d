"""Where a stream's bytes go: a file, standard output, a TCP connection, UDP datagrams.

A sink is called with bytes (``records.write_stream(..., target=sink)``) and closed at the end.
"""

from __future__ import annotations

import select
import socket
import sys
from collections.abc import Callable
from typing import BinaryIO

from muxlake.functions.values import host_port

#: Bytes of a datagram: seven transport packets.
DATAGRAM = 7 * 188


class FileSink:
    """Bytes to an open binary file."""

    def __init__(self, file: BinaryIO, own: bool = True):
        self.file, self.own = file, own

    def __call__(self, data: bytes) -> None:
        self.file.write(data)

    def close(self) -> None:
        """Flushes, and closes a file that was opened here."""
        self.file.flush()
        if self.own:
            self.file.close()


class TcpSink:
    """Bytes to a TCP peer, which may send commands back, a character each."""

    def __init__(self, host: str, port: int):
        self.peer = socket.create_connection((host, port))

    def __call__(self, data: bytes) -> None:
        self.peer.sendall(data)

    def commands(self) -> str:
        """The command characters that have come since the last call."""
        out = b""
        while select.select([self.peer], [], [], 0)[0]:
            got = self.peer.recv(4096)
            if not got:
                break
            out += got
        return "".join(c for c in out.decode("ascii", "ignore") if not c.isspace())

    def close(self) -> None:
        """Ends the connection."""
        self.peer.close()


class UdpSink:
    """Bytes as datagrams of ``size`` to a host or multicast group; the rest goes at the end."""

    def __init__(self, host: str, port: int, size: int = DATAGRAM, interface: str | None = None, hops: int = 16):
        self.to, self.size, self.held = (host, port), size, b""
        self.socket = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
        if 224 <= int(socket.gethostbyname(host).split(".")[0]) <= 239:
            self.socket.setsockopt(socket.IPPROTO_IP, socket.IP_MULTICAST_TTL, hops)
            if interface:
                self.socket.setsockopt(socket.IPPROTO_IP, socket.IP_MULTICAST_IF, socket.inet_aton(interface))

    def __call__(self, data: bytes) -> None:
        self.held += data
        while len(self.held) >= self.size:
            self.socket.sendto(self.held[: self.size], self.to)
            self.held = self.held[self.size :]

    def close(self) -> None:
        """Sends what is left."""
        if self.held:
            self.socket.sendto(self.held, self.to)
        self.socket.close()


def open_sink(name: str, **options) -> FileSink | TcpSink | UdpSink:
    """``-`` for standard output, ``tcp://host:port``, ``udp://host:port``, or a file's name."""
    if name == "-":
        return FileSink(sys.stdout.buffer, own=False)
    for scheme, kind in (("tcp://", TcpSink), ("udp://", UdpSink)):
        if name.startswith(scheme):
            return kind(*host_port(name.removeprefix(scheme), 88), **options)
    return FileSink(open(name, "wb"))


class Messages:
    """Where remarks and complaints go; both can be sent to functions."""

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        """Standard output for remarks, standard error for complaints."""
        self.say: Callable[[str], object] = lambda text: print(text)
        self.complain: Callable[[str], object] = lambda text: print(text, file=sys.stderr)

    def redirect(self, say: Callable[[str], object] | None = None, complain: Callable[[str], object] | None = None) -> None:
        """Sends remarks and complaints to the given functions; those not given stay."""
        self.say, self.complain = say or self.say, complain or self.complain

    def all_to_error(self) -> None:
        """Remarks go to standard error too, for a stream on standard output."""
        self.say = self.complain


messages = Messages()
