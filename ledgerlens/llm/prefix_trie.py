"""Conversation prefix trie by union-find over sorted-neighbour LCP edges.

A conversation is the sequence of its turns, a turn a 16-byte digest of its role
and text. Equal sequences are counted first (partial sums map-side), so that the
*distinct* sequences are what is sorted; they are range-partitioned by their
bytes. In that order the sequences below a trie node are neighbours, and two
neighbours share a prefix of LCP turns: an edge.

- **Forest of a partition** (``grow``): edges in descending depth; each one unites
  the two components beside it. A component that is united at a smaller depth
  than its own is a finished node, and the union is a branching node at the edge's
  depth. What a node reports are sums over its component: members, smallest
  member, sequences, text bytes, and edges that end a sequence.
- **Contraction** (``contract``): components that hold a partition's first or last
  sequence may go on in the next partition. Only these (a node a depth at most,
  on either side) are kept, as *items* with the same sums: a partition shrinks to
  a list as long as its outer sequences are deep.
- **Boundaries**: lists of ``FAN`` neighbouring partitions, with the LCP edges
  between them, are grown and contracted again, until one list is left. A child
  that was finished before its parent finds the parent by the parent's key.

A compressed node stands for one trie node per depth down from its parent; these
have the same members and are written out last.

Rows: rows without conv_id take no part; null role and text are empty; turns are
ordered by turn (null first), of equal turns by digest; repeated rows are turns of
their own. A conversation is one row of some 30 bytes a turn while it is
sorted, however long its texts are. No conversations, no nodes. Other columns of
the input are not looked at.
"""

from __future__ import annotations

import hashlib
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, ship_package
from .text import bound_batches, partitions, read_table

WIDTH = 16                       # bytes a turn
FAN = 64                         # neighbouring lists merged at once
PARTITION_BYTES = 16 << 20       # of sequences that one task grows a forest of
PIECE_BYTES = 1 << 20            # of joined conv_ids sent at once
NO_ENDS = hashlib.sha256(b"").hexdigest()

FOREST = ("depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
          "saved_tokens long, ends binary, node_key binary, parent_key binary, segment long, pos long, item binary")
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@dataclass
class Item:
    """A run of neighbouring sequences: one sequence, or finished children of an open node.

    ``path`` is the prefix that all of it shares as far as anyone will ask (a
    sequence as a whole), ``cum[d]`` the text bytes of the path's first ``d``
    turns, ``top`` the path's depth, and ``kids`` the edges of that depth inside.
    ``sw`` is the text bytes of all members, ``c`` those of the distinct nodes.
    """
    path: bytes
    cum: np.ndarray
    top: int
    kids: int
    n: int
    conv: int
    seqs: int
    covered: int
    sw: int
    c: int
    first_len: int
    lcp: int = -1                # the edge to the item before: shared turns,
    cover: bool = False          # and whether the sequence before ends there


@dataclass
class _Tree:
    """A component: items ``left`` to ``right``, its sums, and finished children that wait for it."""
    left: int
    right: int
    top: int
    kids: int
    n: int
    conv: int
    seqs: int
    covered: int
    sw: int
    c: int
    waiting: list


def shared_turns(a: bytes, b: bytes) -> int:
    low, high = 0, min(len(a), len(b)) // WIDTH
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * WIDTH:mid * WIDTH] == b[low * WIDTH:mid * WIDTH]:
            low = mid
        else:
            high = mid - 1
    return low


def _key(path: bytes, depth: int) -> bytes:
    return hashlib.md5(path[:depth * WIDTH]).digest()


def grow(items: list[Item], whole: bool, keyed: bool) -> list[tuple]:
    """The node rows that are finished once all edges between the items are known;
    ``whole``: there is nothing beside them. ``keyed``: nodes say their key."""
    rows: list[tuple] = []
    last = len(items) - 1
    trees = [_Tree(i, i, x.top, x.kids, x.n, x.conv, x.seqs, x.covered, x.sw, x.c, []) for i, x in enumerate(items)]
    up = list(range(len(items)))

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def settle(tree: _Tree, is_open: bool) -> None:
        """Finished children learn of their parent."""
        parent = _key(items[tree.left].path, tree.top) if is_open else None
        for row in tree.waiting:
            rows.append((row[0], row[1], None if is_open else tree.conv, *row[3:9], parent))
        tree.waiting = []

    def close(tree: _Tree, above: int) -> list[tuple]:
        """The tree is a node whose parent has depth ``above``: the rows that wait for that parent."""
        is_open = not whole and (tree.left == 0 or tree.right == last)
        settle(tree, is_open)
        if is_open:
            return []
        first = items[tree.left]
        leaves, extra = tree.seqs - tree.covered, tree.sw - tree.c
        waiting = []
        for depth in range(above + 1, tree.top + 1):
            saved = extra - (tree.n - 1) * int(first.cum[depth - 1]) if depth else extra
            end = depth == tree.top
            children = tree.kids + (first.first_len > tree.top) if end else 1
            ends = _key(first.path, tree.top) if end and first.first_len == tree.top else None
            key = _key(first.path, tree.top) if end and keyed else None
            row = (depth, tree.conv, tree.conv, tree.n, children, leaves, saved, ends, key, None)
            (waiting if depth == above + 1 else rows).append(row)
        return waiting

    for e in sorted(range(1, len(items)), key=lambda i: -items[i].lcp):
        edge = items[e]
        a, b = find(e - 1), find(e)
        x, y, depth = trees[a], trees[b], edge.lcp
        kids, waiting = 1, []
        for tree in (x, y):
            if tree.top == depth:
                kids += tree.kids
                more = tree.waiting
            else:
                more = close(tree, depth)
            if len(more) > len(waiting):
                waiting, more = more, waiting
            waiting.extend(more)
        up[b] = a
        trees[a] = _Tree(x.left, y.right, depth, kids, x.n + y.n, min(x.conv, y.conv), x.seqs + y.seqs,
                         x.covered + y.covered + edge.cover, x.sw + y.sw, x.c + y.c - int(edge.cum[depth]), waiting)
        trees[b] = None
    if items:
        top = trees[find(0)]
        if whole:
            # The root has no parent; a chain's first node neither.
            rows.extend((r[0], r[1], None, *r[3:]) for r in close(top, -1))
        else:
            settle(top, True)
    return rows


def _bag(items: list[Item], depth: int) -> Item:
    """Neighbours that are whole children (with all below) of an open node of this depth."""
    first, inner = items[0], items[1:]
    return Item(first.path[:depth * WIDTH], first.cum[:depth + 1], depth,
                sum(x.kids for x in items if x.top == depth) + sum(x.lcp == depth for x in inner),
                sum(x.n for x in items), min(x.conv for x in items), sum(x.seqs for x in items),
                sum(x.covered for x in items) + sum(x.cover for x in inner), sum(x.sw for x in items),
                sum(x.c for x in items) - sum(int(x.cum[x.lcp]) for x in inner), first.first_len, first.lcp, first.cover)


def contract(items: list[Item]) -> list[Item]:
    """The list that grows the same open nodes: the outer items, and one for each depth on either side."""
    n = len(items)
    if n <= 2:
        return items
    least = min(x.lcp for x in items[1:])
    low = [i for i in range(1, n) if items[i].lcp == least]
    first, final = low[0], low[-1]
    left, at = [items[0]], 1
    while at < first:
        stop = at + 1
        while stop < first and items[stop].lcp >= items[at].lcp:
            stop += 1
        left.append(_bag(items[at:stop], items[at].lcp))
        at = stop
    if first < final:
        left.append(_bag(items[first:final], least))
    right, at = [items[-1]], n - 1
    while at > final:
        start = at - 1
        while start > final and items[start].lcp >= items[at].lcp:
            start -= 1
        right.append(_bag(items[start:at], items[at].lcp))
        at = start
    return left + right[::-1]


def _linked(items: list[Item], before: Item | None) -> None:
    """Set the edge between a list's first item and the sequence before it."""
    if before is not None:
        items[0].lcp = shared_turns(before.path, items[0].path)
        items[0].cover = items[0].lcp == before.first_len


def _forest(rows: list[tuple], items: list[Item], segment: int) -> pa.Table:
    names = [c.split()[0] for c in FOREST.split(", ")]
    nodes = [(*row, None, None, None) for row in rows]
    kept = [(*[None] * 10, segment, i, pickle.dumps(x)) for i, x in enumerate(items)]
    columns = list(zip(*(nodes + kept))) or [()] * len(names)
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    return pa.table([pa.array(c, kinds[f.split()[1]]) for c, f in zip(columns, FOREST.split(", "))], names=names)


def _local(batches):
    """The forest of one sorted partition."""
    items: list[Item] = []
    for batch in batches:
        for seq, sizes, conv, n in zip(*(c.to_pylist() for c in batch.columns)):
            cum = np.cumsum([0, *map(int, sizes.split(","))] if sizes else [0], dtype=np.int64)
            top, total = len(seq) // WIDTH, int(cum[-1])
            one = Item(seq, cum, top, 0, n, conv, 1, 0, n * total, total, top)
            _linked([one], items[-1] if items else None)
            items.append(one)
    if items:
        made = _forest(grow(items, False, False), contract(items), TaskContext.get().partitionId())
        yield from made.to_batches(max_chunksize=10_000)


def _merge(whole: bool):
    def run(key, table):
        table = table.sort_by([("segment", "ascending"), ("pos", "ascending")])
        items: list[Item] = []
        for pos, packed in zip(table["pos"].to_pylist(), table["item"].to_pylist()):
            one = pickle.loads(packed)
            if pos == 0:
                _linked([one], items[-1] if items else None)
            items.append(one)
        return _forest(grow(items, whole, True), [] if whole else contract(items), key[0].as_py())
    return run


def sequences(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): the turns of every conversation in order, as (digest, size) structs."""
    empty = F.lit("")
    rows = df.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), empty).alias("role"),
        F.coalesce(F.col(text), empty).alias("text"))
    digest = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(
        "turn", digest.alias("digest"), F.octet_length("text").cast("long").alias("size")))).alias("turns")).select(
        "conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("turns"))


def rebuilt(found: DataFrame, step: int = 5, heads: int = 9) -> DataFrame:
    """Each conversation c with the first h = crc32(c) % heads turns of conversation
    c - c % step in the place of its own first h."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    base = found.where(F.col("conv_id") % step == 0).select(
        F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    own = found.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % step)
    head = F.coalesce(F.expr("slice(head, 1, h)"), F.expr("slice(turns, 1, 0)"))
    return own.join(base, "base", "left").select(
        "conv_id", F.concat(head, F.expr("slice(turns, h + 1, size(turns))")).alias("turns"))


def _end_digests(members: DataFrame, parts: int) -> DataFrame:
    """(ends, ends_sha256): a digest of the ascending conv_ids of every sequence. A
    sequence's ids are joined where they are sorted and only then sent to one
    task, which holds one piece at a time."""
    def join(batches):
        key, first, ids, size = None, None, [], 0

        def piece():
            return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([first], pa.int64()),
                                               pa.array([",".join(ids).encode()], pa.binary())], names=["ends", "first", "ids"])
        for batch in batches:
            for k, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and (k != key or size > PIECE_BYTES):
                    yield piece()
                    ids, size = [], 0
                if not ids:
                    key, first = k, conv
                ids.append(str(conv))
                size += 21
        if ids:
            yield piece()

    def digest(batches):
        key, state, out = None, None, []
        for batch in batches:
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if state is not None and k == key:
                    state.update(b"," + ids)
                    continue
                if state is not None:
                    out.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(ids)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()),
                                              pa.array([d for _, d in out], pa.string())], names=["ends", "ends_sha256"])
            out = []
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())],
                                             names=["ends", "ends_sha256"])

    pieces = members.repartitionByRange(parts, "ends", "conv_id").sortWithinPartitions("ends", "conv_id").mapInArrow(
        join, "ends binary, first long, ids binary")
    return pieces.repartition(parts, "ends").sortWithinPartitions("ends", "first").mapInArrow(
        digest, "ends binary, ends_sha256 string")


def prefix_trie(found: DataFrame) -> DataFrame:
    """The nodes of the trie over (conv_id, turns), one row a node: smallest member,
    depth, the parent's smallest member, members, children, leaves below, bytes
    that sharing saves below, and a digest of the members that end here."""
    spark = found.sparkSession
    ship_package(spark)
    bound_batches(spark)
    joined = found.select(
        "conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), "")).alias("seq"),
        F.array_join(F.transform("turns", lambda t: t["size"].cast("string")), ",").alias("sizes"))
    joined = materialize(joined, as_table=True)
    distinct = materialize(joined.groupBy("seq", "sizes").agg(F.min("conv_id").alias("conv"), F.count("*").alias("n")),
                           as_table=True)
    size = distinct.agg(F.sum(F.octet_length("seq") + F.octet_length("sizes") + 100).alias("b")).first()["b"] or 0
    parts = max(partitions(found), -(-size // PARTITION_BYTES))
    step = materialize(distinct.repartitionByRange(parts, "seq").sortWithinPartitions("seq").mapInArrow(_local, FOREST),
                       as_table=True)
    nodes = step.where("depth is not null")
    lists = step.where("item is not null").select("segment", "pos", "item")
    count = (lists.agg(F.max("segment")).first()[0] or 0) + 1
    while True:
        count = -(-count // FAN)
        grouped = lists.withColumn("group", F.floor(F.col("segment") / FAN).cast("long")).groupBy("group")
        step = materialize(grouped.applyInArrow(_merge(count == 1), FOREST), as_table=True)
        nodes = nodes.union(step.where("depth is not null"))
        if count == 1:
            break
        lists = step.where("item is not null").select("segment", "pos", "item")

    parents = nodes.where("node_key is not null").select(F.col("node_key").alias("parent_key"), F.col("conv_id").alias("above"))
    early = nodes.where("parent_key is not null").join(parents, "parent_key").withColumn("parent_conv_id", F.col("above"))
    columns = [*COLUMNS[:-1], "ends"]
    nodes = nodes.where("parent_key is null").select(*columns).union(early.select(*columns))
    digests = _end_digests(joined.select(F.unhex(F.md5("seq")).alias("ends"), "conv_id"), parts)
    return nodes.where("ends is not null").join(digests, "ends").select(*COLUMNS).union(
        nodes.where("ends is null").select(*COLUMNS[:-1], F.lit(NO_ENDS).alias("ends_sha256")))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return prefix_trie(rebuilt(sequences(read_table(spark, sf_dir, "conversations"))))


ORACLE_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
),
own AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST,
                       md5(strlen(role) || ':' || role || text)) AS seq FROM turns GROUP BY conv_id
),
heads AS (
  SELECT conv_id, seq, CAST((list_reduce(list_prepend(4294967295, list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1),
           lambda i: ascii(substr(CAST(conv_id AS VARCHAR), i, 1))::BIGINT)),
           lambda crc, c: list_reduce(list_prepend(xor(crc, c), range(8)),
             lambda x, j: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) ) AS BIGINT) AS crc
  FROM own
),
rebuilt AS (
  SELECT h.conv_id, list_concat(coalesce(list_slice(b.seq, 1, xor(h.crc, 4294967295) % 9), []),
                                list_slice(h.seq, xor(h.crc, 4294967295) % 9 + 1, len(h.seq))) AS seq
  FROM heads h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 5
),
starts AS (SELECT conv_id, seq, unnest(range(len(seq) + 1)) AS depth FROM rebuilt),
nodes AS (
  SELECT depth, list_slice(seq, 1, depth) AS path, min(conv_id) AS conv_id, count(*) AS n_convs,
         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(seq) = depth), '') AS ends
  FROM starts GROUP BY ALL
),
kids AS (
  SELECT depth - 1 AS depth, list_slice(path, 1, depth - 1) AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL
),
sized AS (
  SELECT n.*, coalesce(k.n, 0) AS n_children, CASE WHEN n.depth = 0 THEN 0 ELSE strlen(path[n.depth].text) END AS bytes
  FROM nodes n LEFT JOIN kids k USING (depth, path)
),
above AS (SELECT unnest(range(depth + 1)) AS up, path, n_children, (n_convs - 1) * bytes AS saved FROM sized),
subtree AS (
  SELECT up AS depth, list_slice(path, 1, up) AS path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved
  FROM above GROUP BY ALL
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves,
       CAST(s.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM sized n JOIN subtree s USING (depth, path)
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = list_slice(n.path, 1, n.depth - 1)
"""
