"""Prefix trie of conversations by LCP-aware external mergesort.

A turn is named by 128 bits of a hash of its role and text, a conversation by the names of its turns in order. Conversations are dealt to ranges of that order, equal ones further by their id, so neither a
conversation with many copies nor a turn that many begin with has to lie in one range. In a range, each batch is a sorted run that knows how many turns every conversation shares with the one before it
(its LCP); a loser tree merges the runs and compares conversations from the first turn on that isn't known to be shared. The merged stream needs no comparison to say where the trie branches: its LCPs do.
A stack holds the path that is open. A conversation closes the nodes below its LCP, which are then complete and leave, and opens its own. What is held is a path.

Nodes on a range's first or last path may go on in its neighbours. Their counts are kept apart and merged by the same stack: the border paths of FAN ranges in order, where the nodes within become complete and
those on the outer borders are left, until one group remains. A node's parent has its smallest member only when it is complete itself, so that column comes from a join at the end.

Plan: one shuffle of 30 bytes a turn brings a conversation's turns together, with those of the conversation that it begins with (texts stay where they are read: JVM functions hash them and count their
words); one shuffle orders the conversations; one joins the parents. The ids of a node's whole members are hashed as they pass; those of more than LISTED members, or of a node that goes on in another range, are
written in lists, which one task per node hashes in order: a row for LISTED ids. Ranges are as many as keep each one's names at about RANGE bytes, and at least spark.sql.shuffle.partitions.

Cases: null role or text counts as empty; a null conv_id is no conversation; turns of one number (null included, which comes first) are in order of their names, so a repeated row is a turn of its own; a
conversation whose turns were all taken away has no turns and is a member of the root; an empty table has no nodes, not even the root; extra columns are ignored, whatever their names. A text may be of any length.
The names of one conversation's turns (24 bytes each) are held by a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

#: Bytes of a turn's name.
NAME = 16
RANGE = 32 << 20
LISTED = 4096
FAN = 64
#: Rows of a run, at most.
RUN = 10_000


def turn_name(role: str, text: str) -> Column:
    """The first 16 bytes of the SHA-256 of the role's length, the role and the text."""
    return F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * NAME))


def rebuilt(conversations: DataFrame, per_base: int = 20, shared: int = 4) -> DataFrame:
    """conv_id, names, words: each conversation c as the first h turns of the conversation c - c % per_base, and then its own from the h-th on; h = crc32(c) % shared. words: words in each turn's text."""
    id_ = F.col("conv_id").cast("long")
    turns = conversations.select(id_.alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).where("conv_id is not null")
    turns = turns.select((F.col("conv_id") - F.col("conv_id") % per_base).alias("base"), "conv_id", F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"), turn_name("role", "text").alias("name"), F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words")).alias("x"))
    own = turns.repartition("base").groupBy("base", "conv_id").agg(F.array_sort(F.collect_list("x")).alias("own"))
    first = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("own", 1, shared - 1))).over(Window.partitionBy("base"))
    h = (F.crc32(F.col("conv_id").cast("string")) % shared).cast("int")
    own = own.withColumns({"first": F.coalesce(first, F.array().cast(dict(own.dtypes)["own"])), "h": h})
    rest = F.when(F.size("own") > F.col("h"), F.expr("slice(own, h + 1, size(own))")).otherwise(F.array().cast(dict(own.dtypes)["own"]))
    whole = F.concat(F.when(F.col("h") > 0, F.expr("slice(first, 1, h)")).otherwise(F.array().cast(dict(own.dtypes)["own"])), rest)
    return own.withColumn("all", whole).select("conv_id", F.col("all.name").alias("names"), F.col("all.words").alias("words"))


def shared_turns(a: bytes, b: bytes, known: int) -> int:
    """How many turns a and b begin with in common, given that the first known are."""
    most = min(len(a), len(b))
    at, step = known * NAME, NAME
    while at < most and a[at : at + step] == b[at : at + step]:  # equal stretches of doubling length
        at, step = at + step, step * 2
    while step > NAME:
        step //= 2
        if a[at : at + step] == b[at : at + step]:
            at += step
    return min(at, most) // NAME


#: A conversation in a run: turns shared with the one before it, names, id, words.
Entry = tuple[int, bytes, int, np.ndarray]


def sorted_run(rows: list[tuple[bytes, int, np.ndarray]]) -> list[Entry]:
    rows.sort(key=lambda r: r[:2])
    out, before = [], b""
    for names, conv, words in rows:
        out.append((shared_turns(before, names, 0), names, conv, words))
        before = names
    return out


def merged(runs: list[list[Entry]]) -> Iterator[Entry]:
    """The runs as one, each entry with the turns that it shares with the one before it. Every contender knows what it shares with the last entry that came out: of two that differ in it the longer goes first, unseen; only equals
    are compared, from there on."""
    n = len(runs)
    ends = [len(r) for r in runs]
    at = [0] * n
    shared = [0] * n  # of each run's head with the last entry that came out

    def beats(i: int, j: int) -> bool:
        """Whether run i's head goes before run j's; the loser then knows what it shares with the winner."""
        if at[j] >= ends[j]:
            return True
        if at[i] >= ends[i]:
            return False
        if shared[i] != shared[j]:
            return shared[i] > shared[j]
        a, b = runs[i][at[i]], runs[j][at[j]]
        k = shared_turns(a[1], b[1], shared[i])
        first = (a[1][k * NAME :], a[2]) < (b[1][k * NAME :], b[2]) if len(a[1]) == len(b[1]) == k * NAME else a[1][k * NAME : (k + 1) * NAME] < b[1][k * NAME : (k + 1) * NAME]
        shared[j if first else i] = k
        return first

    size = 1
    while size < n:
        size *= 2
    loser = [-1] * size

    def play(node: int) -> int:
        """The winner of the runs below a node of the tree; losers stay in the nodes."""
        if node >= size:
            return node - size if node - size < n else -1
        i, j = play(2 * node), play(2 * node + 1)
        if i < 0 or j < 0:
            return max(i, j)
        if not beats(i, j):
            i, j = j, i
        loser[node] = j
        return i

    win = play(1) if n else -1
    while win >= 0 and at[win] < ends[win]:
        _, names, conv, words = runs[win][at[win]]
        yield shared[win], names, conv, words
        at[win] += 1
        if at[win] < ends[win]:
            shared[win] = runs[win][at[win]][0]
        node = (win + size) // 2
        while node:
            if loser[node] >= 0 and beats(loser[node], win):
                loser[node], win = win, loser[node]
            node //= 2


class Node:
    """An open node. kids, leaves and saved are those of its complete children; listed: its ids are in lists; edge: it lies on the first path of what the stack has seen."""

    __slots__ = ("name", "key", "n", "least", "kids", "leaves", "saved", "words", "ids", "hash", "listed", "edge")

    def __init__(self, name: bytes, key: bytes, words: int, edge: bool) -> None:
        self.name, self.key, self.words, self.edge = name, key, words, edge
        self.n = self.kids = self.leaves = self.saved = 0
        self.least: int | None = None
        self.ids: list[int] = []
        self.listed = False


ROOT = b"\0" * NAME


def child_key(parent: bytes, name: bytes) -> bytes:
    """Names a node: a hash of its path."""
    return hashlib.blake2b(parent + name, digest_size=NAME).digest()


class Rows:
    """Rows that leave a task: complete nodes (kind 0), border nodes (1) and lists of ids (2)."""

    COLUMNS = (("kind", "int"), ("key", "binary"), ("parent", "binary"), ("conv_id", "long"), ("depth", "long"), ("n_convs", "long"), ("n_children", "long"), ("n_leaves", "long"), ("saved_tokens", "long"), ("words", "long"),
               ("ends", "binary"), ("listed", "boolean"), ("slot", "long"), ("pos", "long"), ("name", "binary"), ("edge", "boolean"), ("tip", "boolean"))
    SCHEMA = ", ".join(f"{n} {t}" for n, t in COLUMNS)
    _TYPES = {"int": pa.int32(), "binary": pa.binary(), "long": pa.int64(), "boolean": pa.bool_()}

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def node(self, x: Node, parent: bytes | None, depth: int) -> None:
        """A complete node; gives its leaves and saved tokens."""
        leaves = x.leaves if x.kids else 1
        saved = x.saved + (x.n - 1) * x.words
        ends = None if x.listed else hashlib.sha256(",".join(map(str, x.ids)).encode()).digest()
        self.rows.append((0, x.key, parent, x.least, depth, x.n, x.kids, leaves, saved, None, ends, x.listed, None, None, None, None, None))

    def border(self, x: Node, depth: int, slot: int, pos: int, edge: bool, tip: bool) -> None:
        self.rows.append((1, x.key, None, x.least, depth, x.n, x.kids, x.leaves, x.saved, x.words, None, x.listed, slot, pos, x.name, edge, tip))

    def ids(self, x: Node) -> None:
        """Writes a node's ids so far as a list."""
        if x.ids:
            self.rows.append((2, x.key, None, x.ids[0], None, None, None, None, None, None, ",".join(map(str, x.ids)).encode(), None, None, None, None, None, None))
            x.ids, x.listed = [], True

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], self._TYPES[t]) for i, (_, t) in enumerate(self.COLUMNS)], names=[n for n, _ in self.COLUMNS])


class Stack:
    """The open path. Nodes that close leave as complete, or, on the first path, wait for what lies before it."""

    def __init__(self, rows: Rows) -> None:
        self.rows, self.path, self.first = rows, [], []

    def close_below(self, depth: int) -> None:
        """Closes the nodes deeper than depth."""
        while len(self.path) > depth + 1:
            x = self.path.pop()
            up = self.path[-1]
            if x.edge:
                self.first.append((len(self.path), x))
                continue
            up.kids += 1
            up.leaves += x.leaves if x.kids else 1
            up.saved += x.saved + (x.n - 1) * x.words
            self.rows.node(x, up.key, len(self.path))

    def finish(self, slot: int, close: bool) -> None:
        """What is left when nothing more comes: the border nodes, first path and last path, or, at the very end, the rest as complete."""
        if close:  # no node is on an edge then
            self.close_below(0)
            if self.path:
                self.rows.node(self.path[0], None, 0)
            return
        for x in [*self.path, *(x for _, x in self.first)]:
            self.rows.ids(x)
        both = [(d, x, x.edge, True) for d, x in enumerate(self.path) if x.edge]
        only_first = [(d, x, True, False) for d, x in reversed(self.first)]
        only_last = [(d, x, False, True) for d, x in enumerate(self.path) if not x.edge]
        for pos, (d, x, edge, tip) in enumerate([*both, *only_first, *only_last]):
            self.rows.border(x, d, slot, pos, edge, tip)


def _conversation(stack: Stack, entry: Entry, is_first: bool) -> None:
    """Takes the next conversation of the stream."""
    shared, names, conv, words = entry
    if not stack.path:
        stack.path.append(Node(b"", ROOT, 0, True))
    stack.close_below(shared)
    for d in range(shared, len(names) // NAME):
        name = names[d * NAME : (d + 1) * NAME]
        stack.path.append(Node(name, child_key(stack.path[-1].key, name), int(words[d]), is_first))
    for x in stack.path:
        x.n += 1
        if x.least is None or conv < x.least:
            x.least = conv
    end = stack.path[-1]
    end.ids.append(conv)
    if len(end.ids) >= LISTED:
        stack.rows.ids(end)


def _border_node(stack: Stack, r: dict, is_first: bool) -> None:
    """Takes the next border node, in order of ranges and within one of its first path, then its last."""
    d = r["depth"]
    if len(stack.path) > d and stack.path[d].name == r["name"]:
        x = stack.path[d]
    else:
        stack.close_below(d - 1)
        x = Node(r["name"], r["key"], r["words"], is_first and r["edge"])
        stack.path.append(x)
    x.n += r["n_convs"]
    x.kids += r["n_children"]
    x.leaves += r["n_leaves"]
    x.saved += r["saved_tokens"]
    x.listed |= r["listed"]
    if x.least is None or r["conv_id"] < x.least:
        x.least = r["conv_id"]


def _sort_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    runs = []
    for b in batches:
        convs = b.column(0).to_pylist()
        names = [b"".join(x) for x in b.column(1).to_pylist()]
        words = [np.array(x, np.int64) for x in b.column(2).to_pylist()]
        runs.append(sorted_run(list(zip(names, convs, words, strict=True))))
    rows, first = Rows(), True
    stack = Stack(rows)
    for entry in merged(runs):
        _conversation(stack, entry, first)
        first = False
        if len(rows.rows) >= RUN:
            yield rows.take()
    stack.finish(TaskContext.get().partitionId(), False)
    yield rows.take()


def _merge_borders(close: bool):
    def merge(key: tuple, t: pa.Table) -> pa.Table:
        rows = Rows()
        stack = Stack(rows)
        t = t.sort_by([("slot", "ascending"), ("pos", "ascending")])
        least = t.column("slot")[0].as_py()
        for r in t.to_pylist():
            _border_node(stack, r, not close and r["slot"] == least)
        stack.finish(key[0].as_py(), close)
        return pa.Table.from_batches([rows.take()])

    return merge


def _hash_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, ends: SHA-256 of each key's lists in order, joined by commas; a key's rows come together and in order."""
    key = state = None
    for b in batches:
        done: list[tuple[bytes, bytes]] = []
        for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    done.append((key, state.digest()))
                key, state = k, hashlib.sha256(text)
            else:
                state.update(b"," + text)
        yield pa.RecordBatch.from_pydict({"key": pa.array([k for k, _ in done], pa.binary()), "ends": pa.array([e for _, e in done], pa.binary())})
    if key is not None:
        yield pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "ends": pa.array([state.digest()], pa.binary())})


def trie(conversations: DataFrame) -> DataFrame:
    """A row for each node of conversations (conv_id, names, words): conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    held = materialise(conversations, "conversations")
    bytes_ = held.agg(F.sum(F.size("names").cast("long") * NAME)).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), bytes_ // RANGE + 1)
    found = materialise(held.repartitionByRange(ranges, "names", "conv_id").mapInArrow(_sort_range, Rows.SCHEMA), "trie0")
    out, level = [found], 0
    while True:
        borders = found.where("kind = 1")
        most = borders.agg(F.max("slot")).first()[0]
        if most is None:
            break
        level += 1
        merge = _merge_borders(most < FAN)
        found = materialise(borders.groupBy(F.floor(F.col("slot") / FAN).alias("group")).applyInArrow(merge, Rows.SCHEMA), f"trie{level}")
        out.append(found)
    rows = out[0]
    for x in out[1:]:
        rows = rows.unionByName(x)
    lists = rows.where("kind = 2").select("key", F.col("ends").alias("text"), F.col("conv_id").alias("first"))
    hashed = lists.repartition("key").sortWithinPartitions("key", "first").select("key", "text").mapInArrow(_hash_lists, "key binary, ends binary")
    nodes = rows.where("kind = 0").select("key", "parent", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends", "listed")
    nodes = nodes.where("not listed").unionByName(nodes.where("listed").drop("ends").join(hashed, "key").select(*nodes.columns))
    parents = rows.where("kind = 0 and n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = nodes.join(parents, "parent", "left")
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.lower(F.hex("ends")).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """trie() of the rebuilt() conversations."""
    return trie(rebuilt(conversations))


#: Fixed value: the polynomial of CRC-32, reflected.
_CRC = 3988292384
ORACLE_SQL = f"""WITH tab AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {_CRC}) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)),
t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(octet_length(encode(coalesce(role, '')))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS rn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({{'r': r, 'x': x}} ORDER BY rn) AS own FROM t GROUP BY conv_id),
h AS (SELECT o.*, xor(list_reduce(list_prepend(4294967295, [ascii(d)::BIGINT FOR d IN string_split(o.conv_id::VARCHAR, '')]), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 4 AS h FROM o, tab),
s AS (SELECT h.conv_id, list_concat(coalesce(b.own[1:h.h], []), h.own[h.h + 1:]) AS s FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 20),
m AS (SELECT conv_id, len(s) AS len, d, s[1:d] AS p FROM s, LATERAL (SELECT unnest(range(0, len(s) + 1)) AS d)),
n AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len = d), '')) AS ends FROM m GROUP BY p, d),
k AS (SELECT p[1:d - 1] AS p, count(*) AS kids FROM n WHERE d > 0 GROUP BY 1),
v AS (SELECT n.*, coalesce(k.kids, 0) AS kids, CASE WHEN n.d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(n.p[n.d].x, '[^\\x20\\x09-\\x0D]+')) END AS own FROM n LEFT JOIN k ON k.p = n.p),
u AS (SELECT p[1:a] AS p, sum(own) AS saved, count(*) FILTER (kids = 0) AS leaves FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM v) GROUP BY 1)
SELECT v.conv_id, v.d AS depth, q.conv_id AS parent_conv_id, v.n_convs, v.kids AS n_children, u.leaves AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, v.ends AS ends_sha256
FROM v JOIN u ON u.p = v.p LEFT JOIN v q ON v.d > 0 AND q.p = v.p[1:v.d - 1]"""
