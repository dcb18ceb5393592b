"""Live feeds: a server that drops connections, topics, restarts."""

import json
import socket
import threading
import time

from ionolake.sources import live


class Server:
    """Sends each list of lines to one connection, then drops it; the last one stays open."""

    def __init__(self, *sends):
        self.sends, self.logins = list(sends), []
        self.socket = socket.create_server(("127.0.0.1", 0))
        self.port = self.socket.getsockname()[1]
        threading.Thread(target=self.serve, daemon=True).start()

    def serve(self):
        held = []
        for k, lines in enumerate(self.sends):
            c, _ = self.socket.accept()
            self.logins.append(c.recv(100))
            for line in lines:
                c.sendall(line.encode() + b"\r\n")
                time.sleep(0.02)
            c.sendall(b"half a li")
            held.append(c)
            if k + 1 < len(self.sends):
                c.close()


def run(spark, options, place, wanted):
    spark.dataSource.register(live.LiveFeed)
    r = spark.readStream.format("live_feed")
    for k, v in options.items():
        r = r.option(k, v)
    q = r.load().writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/progress").trigger(processingTime="100 milliseconds").start()
    try:
        end = time.time() + 90
        while time.time() < end:
            assert q.exception() is None
            got = spark.read.schema(live.SCHEMA).parquet(f"{place}/out").collect() if (place / "out" / "_spark_metadata").exists() else []
            if len(got) >= wanted:
                return got
            time.sleep(0.5)
        return got
    finally:
        q.stop()


def test_lines_through_two_drops_and_a_restart(spark, tmp_path):
    texts = [f"DX de W{i}AA: 14025.{i % 10} K1ABC CW {i} dB 1200Z" for i in range(26)]
    server = Server(texts[:5], texts[5:11], texts[11:17], texts[17:])
    feed = {"host": "127.0.0.1", "port": server.port, "login": "N0CALL"}
    options = {"feeds": json.dumps([feed]), "buffer": str(tmp_path / "buffer"), "first_delay": "0.1", "poll": "0.05"}
    (tmp_path / "buffer").mkdir()
    got = run(spark, options, tmp_path, 17)
    assert len(got) >= 17 and server.logins[0] == b"N0CALL\r\n"
    server2 = Server(["after the restart", "and one more"])
    options["feeds"] = json.dumps([{**feed, "port": server2.port}])
    n = len(got)
    got = run(spark, options, tmp_path, n + 2)
    assert [r["value"] for r in sorted(got, key=lambda r: r["n"])][:17] == texts[:17] and [r["n"] for r in sorted(got, key=lambda r: r["n"])] == list(range(len(got)))
    assert [r["value"] for r in sorted(got, key=lambda r: r["n"])][-2:] == ["after the restart", "and one more"]


class Topic:
    """An in-memory transport: messages of a topic from a file, each once per connection position."""

    def __init__(self, feed):
        self.path, self.at = feed["file"], feed.get("from", 0)

    def poll(self, seconds):
        with open(self.path) as f:
            lines = f.read().split("\n")[:-1]
        new, self.at = lines[self.at :], len(lines)
        time.sleep(0.01)
        return new

    def close(self):
        pass


def test_two_topics_and_offsets_of_their_own(spark, tmp_path):
    for name, n in (("cw", 7), ("ft8", 3)):
        (tmp_path / name).write_text("".join(f"{name} {i}\n" for i in range(n)))
    feeds = [{"topic": "filter/cw", "file": str(tmp_path / "cw")}, {"topic": "filter/ft8", "file": str(tmp_path / "ft8")}]
    options = {"feeds": json.dumps(feeds), "buffer": str(tmp_path / "buffer"), "transport": "tests.test_live:Topic", "poll": "0.05"}
    got = run(spark, options, tmp_path, 10)
    assert sorted((r["feed"], r["n"], r["value"]) for r in got) == [(0, i, f"cw {i}") for i in range(7)] + [(1, i, f"ft8 {i}") for i in range(3)]
    with (tmp_path / "ft8").open("a") as f:
        f.write("ft8 3\n")
    options["feeds"] = json.dumps([{**feeds[0], "from": 7}, {**feeds[1], "from": 3}])
    got = run(spark, options, tmp_path, 11)
    assert len(got) == 11 and [r["value"] for r in got if r["feed"] == 1 and r["n"] == 3] == ["ft8 3"]


def test_waits_double_up_to_their_limit_and_silence_ends_a_connection():
    now, tried = [0.0], []

    def make(feed):
        tried.append(now[0])
        if len(tried) < 6:
            raise ConnectionRefusedError
        return type("Silent", (), {"poll": lambda self, s: [], "close": lambda self: None})()

    c = live.Connection({}, make, 5, 60, 300, clock=lambda: now[0])
    for _ in range(4000):
        c.poll(0)
        now[0] += 0.25
    assert [round(b - a) for a, b in zip(tried, tried[1:], strict=False)][:5] == [5, 10, 20, 40, 60] and len(tried) > 6
    assert tried[6] - tried[5] >= 300
