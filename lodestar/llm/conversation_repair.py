"""Conversation repair: the cheapest edits that make the turns of a conversation a legal sequence.

Legal conversations have role initials ``(s?(ua)+)?``. Edits are Keep (0), Rerole to user or assistant (1),
Delete (2; the only edit of blank and repeated rows) and Insert of an empty user or assistant turn (5, anywhere);
a truncated row that stays costs 5 more. Of several cheapest audits (the edits' initials in order) the least
in ASCII order is taken.

*Persistent audit DP.* After each row there is one best audit for each state of the role automaton (nothing
yet, after system, after user, after assistant). Audits are linked nodes that share their prefixes: a node has its letter,
depth, a rolling hash of its whole audit and its ancestors 1, 2, 4, ... letters back. Two audits of equal
cost are compared by the first letter in which they differ, found by lifting both nodes while their hashes
differ; the prefixes held equal by hash are then verified letter by letter up to the node they share, and
a collision falls back to comparing letters. Audits of equal cost over the same rows are never prefixes of each
other (only inserts make lengths differ, and they cost), so the order of two prefixes is the order of
their continuations. States that another one beats whatever follows are given up.

*Bounded memory.* A conversation is streamed through one task, as its result is one hash over all its repaired turns:
rows are dealt by ``conv_id``, sorted by turn (sorts spill) and never gathered. As soon as the audits of all
states share a prefix, the prefix is settled: its turns are passed on, their texts and nodes let go. What
a task holds of a conversation is the unsettled rest, and the audit itself, which is in its result row.
Repeated rows are found by Spark's window over equal role and text, with no set of seen texts in Python. One
shuffle serves both.

Defined cases: rows come by turn (nulls first), then role, text and copy; null roles and texts are one blank
(a role that is neither s, u nor a can only be reroled or deleted); a null ``conv_id`` is a conversation of its
own; very long texts and conversations are taken whole; repeated rows are duplicates; a conversation without rows
has zeros and an empty audit; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
_BLANK = " \t\n\x0b\x0c\r"
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_PRIME, _BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E687 % ((1 << 61) - 1)
_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_SUMMARY = "conv_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string"
_MESSAGES = "conv_id long, seq long, edit string, role string, text string"


class Audits:
    """Audits as linked nodes; node 0 is the empty audit."""

    def __init__(self, modulus: int = _PRIME):
        self.modulus = modulus
        self.letter, self.depth, self.hash, self.up = [""], [0], [0], [()]

    def add(self, node: int, letter: str) -> int:
        jumps, at, k = [node], node, 0
        while k < len(self.up[at]):
            at = self.up[at][k]
            jumps.append(at)
            k += 1
        self.letter.append(letter)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * _BASE + ord(letter)) % self.modulus)
        self.up.append(tuple(jumps))
        return len(self.letter) - 1

    def text(self, node: int, stop: int = 0) -> str:
        """The letters from below ``stop`` (an ancestor) to ``node``."""
        letters = []
        while node != stop:
            letters.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(letters))

    def _lift(self, node: int, depth: int) -> int:
        while self.depth[node] > depth:
            jumps = self.up[node]
            k = min(len(jumps), (self.depth[node] - depth).bit_length()) - 1
            while self.depth[jumps[k]] < depth:
                k -= 1
            node = jumps[k]
        return node

    def _equal(self, a: int, b: int) -> bool:
        """Verifies two audits of one depth, up to the node that they share."""
        while a != b:
            if self.letter[a] != self.letter[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether the audit of ``a`` comes before that of ``b``."""
        level = min(self.depth[a], self.depth[b])
        x, y = self._lift(a, level), self._lift(b, level)
        if x == y or (self.hash[x] == self.hash[y] and self._equal(x, y)):
            return self.depth[a] < self.depth[b]
        if self.hash[x] != self.hash[y]:
            k = len(self.up[x]) - 1
            while k >= 0:
                if k < len(self.up[x]):
                    p, q = self.up[x][k], self.up[y][k]
                    if self.hash[p] != self.hash[q]:
                        x, y = p, q
                k -= 1
            if self.letter[x] != self.letter[y] and self._equal(self.up[x][0], self.up[y][0]):
                return self.letter[x] < self.letter[y]
        return self.text(a) < self.text(b)  # hashes collided


def settled(audits: Audits, heads: dict[int, tuple[int, int]]) -> tuple[str, Audits, dict[int, tuple[int, int]]]:
    """The letters that all heads share, and the audits behind them as a tree of their own."""
    nodes = {node for _, node in heads.values()}
    while len(nodes) > 1:
        deepest = max(nodes, key=audits.depth.__getitem__)
        nodes.discard(deepest)
        nodes.add(audits.up[deepest][0])
    root = nodes.pop()
    fresh, renamed = Audits(audits.modulus), {root: 0}
    for _, node in heads.values():
        path = []
        while node not in renamed:
            path.append(node)
            node = audits.up[node][0]
        for child in reversed(path):
            renamed[child] = fresh.add(renamed[audits.up[child][0]], audits.letter[child])
    return audits.text(root), fresh, {s: (cost, renamed[node]) for s, (cost, node) in heads.items()}


class Repair:
    """One conversation, row by row; ``emit(edit, role, text)`` gets each settled edit in order."""

    def __init__(self, emit: Callable[[str, str, str], None] | None = None, limit: int = 256):
        self.emit, self.limit, self.first_limit = emit, limit, limit
        self.audits, self.heads = Audits(), {_START: (0, 0)}
        self.pending: deque[tuple[str, str]] = deque()
        self.audit: list[str] = []
        self.sha, self.said, self.state = hashlib.sha256(), False, _START
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.before: str | None = None
        self.turns: tuple[int, int, int] | None = None

    def _offer(self, heads: dict, state: int, cost: int, node: int, letter: str) -> None:
        """Keeps the better of what ``state`` has and the audit of ``node`` with one more letter."""
        old = heads.get(state)
        if old is None or cost < old[0]:
            heads[state] = (cost, self.audits.add(node, letter))
        elif cost == old[0]:
            new = self.audits.add(node, letter)
            if self.audits.less(new, old[1]):
                heads[state] = (cost, new)

    def _insert(self) -> None:
        """Audits that end with inserts: more than one user and one assistant in a row never pay."""
        heads = dict(self.heads)
        for state in (_START, _SYSTEM, _ASSISTANT):
            if state in self.heads:
                cost, node = self.heads[state]
                self._offer(heads, _USER, cost + INSERT, node, "I")
        if _USER in heads:
            cost, node = heads[_USER]
            self._offer(heads, _ASSISTANT, cost + INSERT, node, "I")
        # what follows a start (or a system turn) can also follow an assistant, at worst with the system turn deleted
        least = heads[_ASSISTANT][0] if _ASSISTANT in heads else float("inf")
        self.heads = {s: h for s, h in heads.items() if h[0] <= least + (DELETE if s == _START else 0) or s in (_USER, _ASSISTANT)}

    def add(self, turn: int | None, role: str, text: str, repeated: bool) -> None:
        first, end = role[:1], text.rstrip(_BLANK)[-1:]
        fault = "blank" if not end else "duplicate" if repeated else "truncated" if end not in ".!?" else ""
        if fault:
            self.counts[fault] += 1
        if self.before is not None and self.before + first not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.before = first
        if turn is not None:
            low, high, n = self.turns or (turn, turn, 1)
            self.turns = (low, turn, n + (turn != high))
        self.pending.append((role, text))
        self._insert()
        heads: dict[int, tuple[int, int]] = {}
        for state, (cost, node) in self.heads.items():
            self._offer(heads, state, cost + DELETE, node, "D")
            if fault in ("blank", "duplicate"):
                continue
            cost += CUT if fault else 0
            wanted, target = ("a", _ASSISTANT) if state == _USER else ("u", _USER)
            if first == wanted:
                self._offer(heads, target, cost, node, "K")
            else:
                self._offer(heads, target, cost + REROLE, node, "R")
                if first == "s" and state == _START:
                    self._offer(heads, _SYSTEM, cost, node, "K")
        self.heads = heads
        if len(self.audits.letter) > self.limit:
            self._settle()
            self.limit = max(self.first_limit, 2 * len(self.audits.letter))

    def _settle(self) -> None:
        letters, self.audits, self.heads = settled(self.audits, self.heads)
        self.audit.append(letters)
        for edit in letters:
            role, text = ("", "") if edit == "I" else self.pending.popleft()
            if edit != "D":
                if edit != "K":
                    role = "assistant" if self.state == _USER else "user"
                self.state = _SYSTEM if edit == "K" and role[:1] == "s" else _ASSISTANT if self.state == _USER else _USER
                self.sha.update(f"{chr(10) if self.said else ''}{role}:{text}".encode())
                self.said = True
            if self.emit is not None:
                self.emit(edit, role, text)

    def finish(self) -> dict:
        """Counts, cost, audit and the hash of the repaired turns."""
        self._insert()
        ends = [self.heads[s] for s in (_START, _ASSISTANT) if s in self.heads]
        best = ends[0]
        for cost, node in ends[1:]:
            if cost < best[0] or (cost == best[0] and self.audits.less(node, best[1])):
                best = (cost, node)
        self.heads = {_START: best}
        self._settle()
        if self.turns is not None:
            self.counts["gaps"] = self.turns[1] - self.turns[0] + 1 - self.turns[2]
        return self.counts | {"cost": best[0], "audit": "".join(self.audit), "repaired_sha256": self.sha.hexdigest()}


def _stream(messages: bool, flush: int = 4096):
    """Per task: conversations that follow each other, as summaries or as the edits with their turns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        names = [c.split()[0] for c in (_MESSAGES if messages else _SUMMARY).split(", ")]
        types = [pa.int64() if c.endswith("long") else pa.string() for c in (_MESSAGES if messages else _SUMMARY).split(", ")]

        def opened(key):
            seq = iter(range(1 << 62))
            return Repair((lambda edit, role, text: out.append((key, next(seq), edit, role, text))) if messages else None)

        def closed(key, repair):
            told = repair.finish()
            if not messages:
                out.append((key, *(told[c] for c in names[1:])))

        def rows():
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)
            out.clear()
            return batch

        repair, key = None, None
        for batch in batches:
            for conv, turn, role, text, repeated, gone in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "repeated", "gone"))):
                if repair is None or conv != key:
                    if repair is not None:
                        closed(key, repair)
                    repair, key = opened(conv), conv
                if not gone:
                    repair.add(turn, role, text, repeated)
                if len(out) >= flush:
                    yield rows()
        if repair is not None:
            closed(key, repair)
        if out:
            yield rows()
    return run


def _ordered(talks: DataFrame) -> DataFrame:
    """Rows dealt by conversation and sorted by turn; rows whose role and text came earlier are marked."""
    blank = F.lit(" ")
    rows = talks.select(
        talks["conv_id"].cast("long").alias("conv_id"), talks["turn"].cast("long").alias("turn"),
        F.coalesce(talks["role"].cast("string"), blank).alias("role"), F.coalesce(talks["text"].cast("string"), blank).alias("text"),
        (talks["gone"] if "gone" in talks.columns else F.lit(False)).alias("gone"),
        (talks["copy"].cast("long") if "copy" in talks.columns else F.lit(0).cast("long")).alias("copy"))
    same = Window.partitionBy("conv_id", "role", "text", "gone").orderBy(F.col("turn").asc_nulls_first(), "copy")
    return (rows.repartition("conv_id").withColumn("repeated", F.row_number().over(same) > 1)
            .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "copy")
            .select("conv_id", "turn", "role", "text", "repeated", "gone"))


def repair_conversations(talks: DataFrame) -> DataFrame:
    """One row per conversation of ``talks(conv_id, turn, role, text)``: faults, cost, audit, hash of the result.

    Rows with a true ``gone`` (a column that may be absent) name their conversation without being in it.
    """
    return _ordered(talks).mapInArrow(_stream(False), _SUMMARY)


def repaired_turns(talks: DataFrame) -> DataFrame:
    """The edits of each conversation in order with role and text after the edit (D: as they were)."""
    return _ordered(talks).mapInArrow(_stream(True), _MESSAGES)


def with_damage(talks: DataFrame) -> DataFrame:
    """``talks`` with a fifth of its rows' faults planted by a hash of conversation and turn."""
    blank = F.lit(" ")
    role, text = (F.coalesce(talks[c].cast("string"), blank) for c in ("role", "text"))
    name = F.concat(F.coalesce(talks["conv_id"].cast("string"), blank), F.lit(":"), F.coalesce(talks["turn"].cast("string"), blank))
    rows = talks.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(name) % 20).alias("kind"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") == 0).alias("gone"), F.explode(copies).alias("copy"))
