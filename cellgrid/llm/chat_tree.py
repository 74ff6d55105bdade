"""Chat formatting by a prefix tree.

Conversations that begin with the same turns share them: a node of the tree is a turn with all turns before it, and
its text is emitted once, in depth-first order. A node carries where it starts in that order, its first position id
(its ancestors' lengths, so that every conversation reads as if it stood alone) and the spans of its ancestors that it
may attend to; spans that touch are one. Lengths are counted in code points, or in tokens if a tokenizer is given.

A turn is written `### role:` and a line end, the text, `</turn>` and a line end. Within roles and texts the control
characters are escaped (backslash, `#`, `<`; in roles also `:` and the line end), so no text can imitate a mark and
`unescape` restores it. The loss mask covers the texts of the roles that are learned, without marks.

The tree is distributed by sorting the conversations by their nodes' digests: conversations that share turns come
together, and a partition only needs the last conversation of the one before. Equal conversations are one entry, a
conversation's rows stream through one task in turn order, and no tree or group of conversations is gathered.

Null text or role: empty. Rows of a conversation with equal turns are ordered by role and text and all kept; a null
turn comes first. Rows with a null conversation id make one conversation of that id. An empty table gives empty results;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellgrid.llm.common import cut, cut_in_place, pick, shuffle_partitions

DIGEST = 16
END = "</turn>\n"
_ESCAPED = {"\\": "\\\\", "#": "\\h", "<": "\\l", ":": "\\c", "\n": "\\n"}
_PLAIN = {v: k for k, v in _ESCAPED.items()}
_MARKS = re.compile(r"[\\#<]")
_ROLE_MARKS = re.compile(r"[\\#<:\n]")
_SEQUENCE = re.compile(r"\\.")
_TURN = re.compile(r"### ([^:\n]*):\n([^<]*)</turn>\n")


def escape(text: str) -> str:
    return _MARKS.sub(lambda m: _ESCAPED[m[0]], text)


def unescape(text: str) -> str:
    return _SEQUENCE.sub(lambda m: _PLAIN[m[0]], text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The written turn, and where its text begins and ends."""
    head = f"### {_ROLE_MARKS.sub(lambda m: _ESCAPED[m[0]], role)}:\n"
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body)


def read_turns(written: str) -> list[tuple[str, str]]:
    """Roles and texts of a written conversation."""
    turns, at = [], 0
    while at < len(written):
        m = _TURN.match(written, at)
        if m is None:
            raise ValueError(f"not a turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


@dataclass(frozen=True)
class Tree:
    #: (node, parent, depth, root, start, length, position, attends, written, loss_from, loss_to[, ids]); parent null at a root.
    nodes: DataFrame
    #: (leaf, path): every distinct conversation's nodes in order.
    paths: DataFrame
    #: (conv, leaf)
    conversations: DataFrame


def _turn_rows(rows: DataFrame, roles: frozenset[str], tokenizer_path: str | None) -> DataFrame:
    """(conv, last, depth, node, parent, path, lengths, written, loss_from, loss_to, ids); path and lengths on a
    conversation's last row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = None
        if tokenizer_path:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(tokenizer_path)
            tokenizer.encode_special_tokens = True
        names = ["conv", "last", "depth", "node", "parent", "path", "lengths", "written", "loss_from", "loss_to", "ids"]
        schema = pa.schema([("conv", pa.int64()), ("last", pa.bool_()), ("depth", pa.int32()), ("node", pa.binary()), ("parent", pa.binary()), ("path", pa.binary()), ("lengths", pa.list_(pa.int64())), ("written", pa.string()), ("loss_from", pa.int64()), ("loss_to", pa.int64()), ("ids", pa.list_(pa.int32()))])
        out: list[list] = []
        size = 0
        held = None  # the latest row, until it is known whether the conversation goes on
        conv, path, lengths, first = None, bytearray(), [], True

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], names)

        def end_conversation() -> None:
            held[1], held[5], held[6] = True, bytes(path), list(lengths)
            out.append(held)

        for batch in batches:
            for c, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
                role, text = role or "", text or ""
                if held is not None:
                    if first or c != conv:
                        end_conversation()
                    else:
                        out.append(held)
                    held = None
                if first or c != conv:
                    conv, path, lengths, first = c, bytearray(), [], False
                parent = bytes(path[-DIGEST:]) or None
                r, t = role.encode(), text.encode()
                node = hashlib.blake2b((parent or b"") + len(r).to_bytes(8, "little") + r + t, digest_size=DIGEST).digest()
                path += node
                written, a, b = format_turn(role, text)
                if role not in roles:
                    a = b = 0
                ids = tokenizer.encode(written, add_special_tokens=False).ids if tokenizer else None
                lengths.append(len(ids) if tokenizer else len(written))
                held = [c, False, len(lengths) - 1, node, parent, None, None, written, a, b, ids]
                size += len(written)
                if size > 1 << 22 and out:
                    yield made()
                    out, size = [], 0
        if held is not None:
            end_conversation()
        if out:
            yield made()

    spread = rows.repartition(shuffle_partitions(rows.sparkSession), "conv").sortWithinPartitions("conv", "turn", "role", "text")
    return spread.mapInArrow(run, "conv long, last boolean, depth int, node binary, parent binary, path binary, lengths array<long>, written string, loss_from long, loss_to long, ids array<int>")


def _shared(a: bytes, b: bytes) -> int:
    """How many digests two paths share at the start."""
    n = min(len(a), len(b)) // DIGEST
    for k in range(n):
        if a[k * DIGEST : (k + 1) * DIGEST] != b[k * DIGEST : (k + 1) * DIGEST]:
            return k
    return n


def _edges(ordered: DataFrame) -> list[dict]:
    """Of every partition of the sorted paths: its first path, its last path and the length of what it adds to the
    first path; three short facts a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, last_starts, total, first_lengths = None, b"", [], 0, []
        for batch in batches:
            for path, lengths in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                k = 0 if first is None else _shared(last, path)
                starts = last_starts[:k]
                for x in lengths[k:]:
                    starts.append(total)
                    total += x
                if first is None:
                    first, first_lengths = path, lengths
                last, last_starts = path, starts
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([first]), pa.array([first_lengths], pa.list_(pa.int64())), pa.array([last]), pa.array([last_starts], pa.list_(pa.int64())), pa.array([total])], ["task", "first", "first_lengths", "last", "last_starts", "total"])

    got = ordered.mapInArrow(run, "task long, first binary, first_lengths array<long>, last binary, last_starts array<long>, total long").collect()
    return [r.asDict() for r in sorted(got, key=lambda r: r["task"])]


def _carried(edges: list[dict]) -> dict[int, tuple[int, bytes, list[int]]]:
    """For each partition: where it begins, and the path before it with its nodes' starts."""
    carried: dict[int, tuple[int, bytes, list[int]]] = {}
    base, last, starts = 0, b"", []
    for e in edges:
        carried[e["task"]] = (base, last, starts)
        k = _shared(last, e["first"])
        known = sum(e["first_lengths"][:k])  # emitted before this partition
        # Starts within the partition count the shared nodes; those of the first path's shared nodes are older.
        m = _shared(e["first"], e["last"])
        starts = [starts[i] if i < min(k, m) else base + s - known for i, s in enumerate(e["last_starts"])]
        base, last = base + e["total"] - known, e["last"]
    return carried


def build(rows: DataFrame, learned_roles: frozenset[str] = frozenset({"assistant"}), tokenizer_path: str | None = None) -> Tree:
    """rows: (conv, turn, role, text)."""
    rows = pick(rows, "conv", "turn", "role", "text").withColumn("conv", F.col("conv").cast("long"))
    turns = cut(_turn_rows(rows, learned_roles, tokenizer_path))
    ends = turns.filter("last").select("conv", F.col("node").alias("leaf"), "path", "lengths")
    paths = ends.groupBy("leaf").agg(F.first("path").alias("path"), F.first("lengths").alias("lengths"))
    ordered = cut_in_place(paths.select("path", "lengths").repartitionByRange(shuffle_partitions(rows.sparkSession), "path").sortWithinPartitions("path"))
    carried = rows.sparkSession.sparkContext.broadcast(_carried(_edges(ordered)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last, starts = carried.value.get(TaskContext.get().partitionId(), (0, b"", []))
        starts = list(starts)
        for batch in batches:
            out: list[tuple] = []
            for path, lengths in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                k = _shared(last, path)
                starts = starts[:k]
                position = sum(lengths[:k])
                spans: list[list[int]] = []
                for s, x in zip(starts, lengths):
                    if spans and spans[-1][1] == s:
                        spans[-1][1] = s + x
                    else:
                        spans.append([s, s + x])
                for d in range(k, len(lengths)):
                    node = path[d * DIGEST : (d + 1) * DIGEST]
                    out.append((node, path[:DIGEST], at, lengths[d], position, [{"from": a, "to": b} for a, b in spans]))
                    starts.append(at)
                    if spans and spans[-1][1] == at:
                        spans[-1][1] = at + lengths[d]
                    else:
                        spans.append([at, at + lengths[d]])
                    at += lengths[d]
                    position += lengths[d]
                last = path
            span = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
            columns = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), span))], ["node", "root", "start", "length", "position", "attends"])

    placed = ordered.mapInArrow(place, "node binary, root binary, start long, length long, position long, attends array<struct<from: long, to: long>>")
    texts = turns.groupBy("node").agg(*[F.first(c).alias(c) for c in ("parent", "depth", "written", "loss_from", "loss_to", "ids")])
    nodes = placed.join(texts, "node").select("node", "parent", "depth", "root", "start", "length", "position", "attends", "written", "loss_from", "loss_to", *(["ids"] if tokenizer_path else []))
    return Tree(cut(nodes), paths.select("leaf", "path"), ends.select("conv", "leaf"))


def read_back(tree: Tree) -> DataFrame:
    """(conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read from the emitted nodes only."""
    at = F.explode(F.sequence(F.lit(0), (F.octet_length("path") / DIGEST - 1).cast("int")))
    steps = tree.paths.select("leaf", "path", at.alias("depth"))
    steps = steps.select("leaf", "depth", F.substring(F.col("path"), F.col("depth") * DIGEST + 1, F.lit(DIGEST)).alias("node"))
    read = steps.join(tree.nodes.select("node", "written", "loss_from", "loss_to"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        done: list[tuple] = []

        def finish() -> None:
            n, turns, chars, loss, size = state
            done.append((now, n, turns.hexdigest(), chars, loss.hexdigest(), size))

        for batch in batches:
            for leaf, written, a, b in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4))):
                if leaf != now:
                    if state:
                        finish()
                    now, state = leaf, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_turns(written):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                learned = unescape(written[a:b])
                state[2] += len(learned)
                state[3].update(learned.encode())
                state[4] += len(written)
        if state:
            finish()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], ["leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    spread = read.select("leaf", "depth", "written", "loss_from", "loss_to").repartition(shuffle_partitions(read.sparkSession), "leaf").sortWithinPartitions("leaf", "depth")
    digests = spread.mapInArrow(run, "leaf binary, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return tree.conversations.join(digests, "leaf").drop("leaf")
