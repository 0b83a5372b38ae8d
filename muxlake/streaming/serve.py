"""A player's server: each connection sends commands and gets the pictures they show.

The index of pictures (source, idx, ref) and their bytes are tables; a connection's command is planned
over the index from where the last one ended, and the bytes go out through ``records.write_stream``.
"""

from __future__ import annotations

import socketserver
import threading

from pyspark.sql import DataFrame

from muxlake.operators import frames, trickplay
from muxlake.sources import records
from muxlake.sources.sinks import messages


class PictureServer(socketserver.ThreadingTCPServer):
    """Serves one stream of pictures ``(source, idx, ref, data)``; ``step`` pictures a command.

    Commands are those of ``trickplay``, with ``q`` to leave; a digit starts the stream anew. A
    connection has a thread and a place of its own.
    """

    allow_reuse_address = True
    daemon_threads = True

    def __init__(self, address: tuple[str, int], pictures: DataFrame, step: int = 25, fast: int = 8):
        self.pictures, self.step, self.fast = pictures, step, fast
        super().__init__(address, _Connection)

    def start(self) -> threading.Thread:
        """Serves in the background until ``shutdown``."""
        thread = threading.Thread(target=self.serve_forever, daemon=True)
        thread.start()
        return thread


class _Connection(socketserver.BaseRequestHandler):
    def handle(self) -> None:
        server, done = self.server, []
        while got := self.request.recv(64):
            for command in got.decode("ascii", "ignore"):
                if command == "q":
                    return
                if command.isdigit():
                    done = []
                elif command in "nfFrR><][":
                    done.append((command, server.step))
                    self._show(done)
                elif not command.isspace():
                    messages.complain(f"unknown command {command!r}")

    def _show(self, commands: list[tuple[str, int]]) -> None:
        """Sends what the last of all commands so far shows."""
        plan = trickplay.plan(self.server.pictures, commands, self.server.fast)
        now = plan.where(plan["step"] == len(commands) - 1)
        records.write_stream(frames.shown(now, self.server.pictures), ["source", "order"], "data", self.request.sendall)
