"""Live feeds as a streaming data source: text lines from sockets, or messages of subscribed topics, that survive dropped connections and restarts.

Each feed (a host and port, or a topic) is a partition with an offset of its own: how many lines it has given. What arrives is written to segment files in a buffer folder before its offset is reported, and micro-batches read the
segments in tasks, so a micro-batch that is repeated reads the same lines, and a query that is started again goes on where its checkpoint ends. Segments that every micro-batch has passed are deleted, but for each feed's
last, which keeps its count. A connection that breaks, or is silent beyond the deadline, is made anew; while that fails, the wait doubles from first_delay to most_delay. Lines that a server sends while no one is connected
are lost, as the protocol has no replay; an unfinished line of a broken connection is dropped.

    spark.dataSource.register(LiveFeed)
    feeds = [{"host": "feed.example", "port": 7000, "login": "N0CALL"}]
    spark.readStream.format("live_feed").option("feeds", json.dumps(feeds)).option("buffer", "/shared/feed").load()

Options: feeds (JSON list), buffer (a folder or URI that driver and executors share), transport (module:function that makes a transport of a feed; sockets without), poll, first_delay, most_delay, deadline (seconds).
A transport has poll(seconds) -> lines, which raises OSError when the connection is gone, and close().
"""

from __future__ import annotations

import importlib
import json
import socket
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "feed int, n long, value string"


class Lines:
    """Lines from a socket; login is sent once connected."""

    def __init__(self, feed: dict) -> None:
        self.socket = socket.create_connection((feed["host"], int(feed["port"])), timeout=30)
        self.held = b""
        if feed.get("login"):
            self.socket.sendall(feed["login"].encode() + b"\r\n")

    def poll(self, seconds: float) -> list[str]:
        self.socket.settimeout(seconds)
        try:
            got = self.socket.recv(1 << 20)
        except TimeoutError:
            return []
        if not got:
            raise ConnectionError("closed by the other side")
        *lines, self.held = (self.held + got).split(b"\n")
        return [x.rstrip(b"\r").decode("utf-8", "replace") for x in lines]

    def close(self) -> None:
        self.socket.close()


class Connection:
    """A feed's transport, made anew after a loss. clock and wait limits in seconds."""

    def __init__(self, feed: dict, make, first_delay: float, most_delay: float, deadline: float, clock=time.monotonic) -> None:
        self.feed, self.make, self.first_delay, self.most_delay, self.deadline, self.clock = feed, make, first_delay, most_delay, deadline, clock
        self.transport, self.delay, self.again_at, self.heard_at = None, first_delay, 0.0, 0.0

    def poll(self, seconds: float) -> list[str]:
        now = self.clock()
        if self.transport is None:
            if now < self.again_at:
                time.sleep(min(seconds, self.again_at - now))
                return []
            try:
                self.transport = self.make(self.feed)
            except OSError:
                self.again_at, self.delay = now + self.delay, min(2 * self.delay, self.most_delay)
                return []
            self.delay, self.heard_at = self.first_delay, now
        try:
            lines = self.transport.poll(seconds)
        except OSError:
            self.lose()
            return []
        if lines:
            self.heard_at = self.clock()
        elif self.clock() - self.heard_at > self.deadline:
            self.lose()
        return lines

    def lose(self) -> None:
        self.transport.close()
        self.transport = None


@dataclass
class Segment(InputPartition):
    """Lines lo to hi of a feed, in a file that begins with line start."""

    feed: int
    path: str
    start: int
    lo: int
    hi: int


class _Buffer:
    """Segment files: <feed>/<first line>-<line after the last>.txt."""

    def __init__(self, uri: str) -> None:
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)

    def segments(self, feed: int) -> list[tuple[int, int, str]]:
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(f"{self.root}/{feed}", allow_not_found=True))
        names = [f.path for f in found if f.base_name.endswith(".txt")]
        return sorted((*map(int, n.rsplit("/", 1)[1][:-4].split("-")), n) for n in names)

    def write(self, feed: int, start: int, lines: list[str]) -> None:
        place = f"{self.root}/{feed}"
        self.fs.create_dir(place, recursive=True)
        name = f"{place}/{start:018d}-{start + len(lines):018d}.txt"
        with self.fs.open_output_stream(name + ".part") as out:
            out.write("".join(x.replace("\n", " ") + "\n" for x in lines).encode())
        self.fs.move(name + ".part", name)

    def read(self, path: str) -> list[str]:
        with self.fs.open_input_stream(path) as f:
            return f.read().decode().split("\n")[:-1]

    def drop(self, path: str) -> None:
        self.fs.delete_file(path)


class LiveReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.feeds = json.loads(options["feeds"])
        self.uri = options["buffer"]
        made = options.get("transport")
        self.make = getattr(importlib.import_module(made.split(":")[0]), made.split(":")[1]) if made else Lines
        self.poll = float(options.get("poll", 0.2))
        self.limits = [float(options.get(k, d)) for k, d in (("first_delay", 5), ("most_delay", 60), ("deadline", 300))]
        self.connections: list[Connection] | None = None

    def initialOffset(self) -> dict:
        return {str(k): 0 for k in range(len(self.feeds))}

    def latestOffset(self) -> dict:
        buffer = _Buffer(self.uri)
        if self.connections is None:
            self.connections = [Connection(f, self.make, *self.limits) for f in self.feeds]
            self.counts = [max((hi for _, hi, _ in buffer.segments(k)), default=0) for k in range(len(self.feeds))]
        for k, c in enumerate(self.connections):
            if lines := c.poll(self.poll):
                buffer.write(k, self.counts[k], lines)
                self.counts[k] += len(lines)
        return {str(k): n for k, n in enumerate(self.counts)}

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        buffer, out = _Buffer(self.uri), []
        for k in range(len(self.feeds)):
            lo, hi = start.get(str(k), 0), end.get(str(k), 0)
            out += [Segment(k, path, a, max(a, lo), min(b, hi)) for a, b, path in buffer.segments(k) if a < hi and b > lo]
        return out

    def read(self, partition: Segment) -> Iterator[tuple]:
        lines = _Buffer(self.uri).read(partition.path)
        for n in range(partition.lo, partition.hi):
            yield partition.feed, n, lines[n - partition.start]

    def commit(self, end: dict) -> None:
        buffer = _Buffer(self.uri)
        for k in range(len(self.feeds)):
            for _, b, path in buffer.segments(k)[:-1]:
                if b <= end.get(str(k), 0):
                    buffer.drop(path)

    def stop(self) -> None:
        for c in self.connections or []:
            if c.transport is not None:
                c.lose()


class LiveFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "live_feed"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> LiveReader:
        return LiveReader(self.options)
