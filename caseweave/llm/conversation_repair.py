"""Conversation repair: the cheapest edits that give a conversation a legal order of roles.

A legal conversation is empty or an optional system turn followed by pairs of user and
assistant turns. Keeping a row is free, giving it the role user or assistant costs 2,
deleting it 3, inserting an empty user or assistant turn 2; blank rows and repeats must go,
and a truncated row that stays costs 1 more. Of all cheapest ways that one is taken whose
audit, the string of its edits' initials (D, I, K, R), comes first in ASCII order.

The dynamic program has four cells: nothing yet, after system, after user, after assistant.
A cell holds a cost and the last node of its audit. Audits are persistent: an edit is a node
linked to the one before it, so cells share prefixes and no string is copied. Every node
knows its ancestors 1, 2, 4, ... edits back and the rolling hash of its whole string; two
audits of equal cost are compared by searching their longest common prefix over these, and
the prefix that the hashes found equal is verified edit by edit (a pair of nodes verified
once is remembered, so later walks end there). Once all cells share a prefix it is settled:
it moves to the result and its nodes go.

Spark deals rows out by conversation, sorted by turn; tasks read them as a stream. The
program sees flags, never texts; a second stream applies the audits to the rows. A
conversation of any length costs a task its audit, one byte per edit, and the unsettled
nodes, not its texts: its audit is one value of the result, and its digest is
one sequential hash, so a single conversation is not split over tasks. Repeats are found by
aggregation and a join on row numbers, which a long conversation does not burden.

Defined cases: null roles and texts count as one space; null turns come first; equal turns
go by role, then by the md5 of the text; a null conversation id is a conversation of its
own; repeated rows are duplicates; an empty table gives an empty result.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.lineage import cut

DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
OK, CUT_SHORT, BLANK, REPEAT = 0, 1, 2, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: A role's initial leads from a cell to another one.
LEGAL = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The only role that may follow a cell when it is ours to choose.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
SPACE = " \t\n\x0b\x0c\r"


class Audits:
    """Edit strings as nodes linked to their prefixes."""

    def __init__(self, base: int = 1_000_003, modulus: int = (1 << 61) - 1):
        self.base, self.modulus = base, modulus
        self.settled: list[str] = []
        self._clear()

    def _clear(self) -> None:
        self.edit, self.depth, self.hash, self.up = [""], [0], [0], [[]]
        self.verified: set[tuple[int, int]] = set()

    def push(self, node: int, edit: str) -> int:
        back = [node]
        while len(self.up[back[-1]]) >= len(back):
            back.append(self.up[back[-1]][len(back) - 1])
        self.edit.append(edit)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * self.base + ord(edit)) % self.modulus)
        self.up.append(back)
        return len(self.edit) - 1

    def ancestor(self, node: int, depth: int) -> int:
        back = self.depth[node] - depth
        while back:
            k = back.bit_length() - 1
            node, back = self.up[node][k], back - (1 << k)
        return node

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.edit[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def equal(self, x: int, y: int) -> bool:
        """Whether two nodes of one depth spell the same string: hashes first, then edit by edit."""
        if self.hash[x] != self.hash[y]:
            return False
        a, b = x, y
        while a != b and (a, b) not in self.verified:
            if self.edit[a] != self.edit[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        self.verified.add((x, y))
        return True

    def before(self, x: int, y: int) -> bool:
        """Whether the string of ``x`` comes before that of ``y``."""
        depth = min(self.depth[x], self.depth[y])
        a, b = self.ancestor(x, depth), self.ancestor(y, depth)
        if a == b or self.equal(a, b):
            return self.depth[x] < self.depth[y]
        for k in reversed(range(len(self.up[a]))):
            if k < len(self.up[a]):
                p, q = self.up[a][k], self.up[b][k]
                if self.hash[p] != self.hash[q]:
                    a, b = p, q
        p, q = self.up[a][0], self.up[b][0]
        if p != q and not self.equal(p, q):  # hashes of different prefixes collide
            return self.text(x) < self.text(y)
        return self.edit[a] < self.edit[b]

    def settle(self, nodes: Sequence[int]) -> dict[int, int]:
        """Move the prefix that all ``nodes`` share to ``settled`` and keep only what leads on to them."""
        depth = min(self.depth[n] for n in nodes)
        top = {self.ancestor(n, depth) for n in nodes}
        while len(top) > 1:
            top = {self.up[n][0] for n in top}
        root = top.pop()
        self.settled.append(self.text(root))
        live, paths = {root: 0}, {}
        for n in nodes:
            while n != root and n not in paths:
                paths[n] = (self.up[n][0], self.edit[n])
                n = self.up[n][0]
        self._clear()
        for n in sorted(paths):  # a node is younger than its prefix
            parent, edit = paths[n]
            live[n] = self.push(live[parent], edit)
        return live


class Repair:
    """The program over the rows of one conversation."""

    def __init__(self, settle_at: int = 4096, **audits):
        self.audits, self.settle_at, self.full = Audits(**audits), settle_at, settle_at
        self.cells: list[tuple[int, int] | None] = [(0, 0), None, None, None]
        self._insert()

    def _best(self, offers: list[tuple[int, int, str]]) -> tuple[int, int] | None:
        if not offers:
            return None
        least = min(o[0] for o in offers)
        nodes = [n if edit == "" else self.audits.push(n, edit) for cost, n, edit in offers if cost == least]
        best = nodes[0]
        for n in nodes[1:]:
            if self.audits.before(n, best):
                best = n
        return least, best

    def _insert(self) -> None:
        """Cells reached by inserted turns."""
        def offer(q: int, edit: str = "I") -> list[tuple[int, int, str]]:
            cell = self.cells[q]
            return [] if cell is None else [(cell[0] + (INSERT if edit else 0), cell[1], edit)]

        ended = offer(ASSISTANT)  # reached without an insertion
        self.cells[USER] = self._best(offer(USER, "") + offer(START) + offer(SYSTEM))
        self.cells[ASSISTANT] = self._best(offer(ASSISTANT, "") + offer(USER))
        self.cells[USER] = self._best(offer(USER, "") + ended)
        # What may follow nothing may follow an assistant as well, but for a system turn, which can go; so these can win no more.
        for q, apart in ((START, DELETE), (SYSTEM, 0)):
            if self.cells[q] and self.cells[q][0] > self.cells[ASSISTANT][0] + apart:
                self.cells[q] = None

    def add(self, initial: str, fault: int) -> None:
        offers: list[list[tuple[int, int, str]]] = [[], [], [], []]
        more = TRUNCATED if fault == CUT_SHORT else 0
        for q, cell in enumerate(self.cells):
            if cell is None:
                continue
            cost, node = cell
            offers[q].append((cost + DELETE, node, "D"))
            if fault < BLANK:
                if (q, initial) in LEGAL:
                    offers[LEGAL[q, initial]].append((cost + more, node, "K"))
                offers[NEXT[q]].append((cost + REROLE + more, node, "R"))
        self.cells = [self._best(o) for o in offers]
        self._insert()
        if len(self.audits.edit) > self.full:
            live = self.audits.settle([c[1] for c in self.cells if c])
            self.cells = [c and (c[0], live[c[1]]) for c in self.cells]
            self.full = max(self.settle_at, 2 * len(self.audits.edit))

    def result(self) -> tuple[int, str]:
        """(cost, audit)"""
        ends = [(c[0], c[1], "") for c in (self.cells[START], self.cells[ASSISTANT]) if c]
        cost, node = self._best(ends)
        return cost, "".join(self.audits.settled) + self.audits.text(node)


class Replay:
    """Applies an audit to the rows of its conversation as they come; gives (position, edit, role, text)."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.tail = audit, 0, START, len(audit.rstrip("I"))

    def _edit(self, role: str | None, text: str) -> tuple[int, str, str, str]:
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = LEGAL[self.state, role[:1]]
        elif edit != "D":
            self.state = NEXT[self.state]
            role = ROLE[self.state]
        return self.at, edit, role, text

    def _inserted(self) -> Iterator[tuple[int, str, str, str]]:
        while self.audit[self.at:self.at + 1] == "I":
            yield self._edit(None, "")

    def row(self, role: str, text: str) -> Iterator[tuple[int, str, str, str]]:
        yield from self._inserted()
        yield self._edit(role, text)
        if self.at == self.tail:
            yield from self._inserted()


def damage(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text) with faults drawn from crc32(conv_id:turn) % 20: 0 drops the row, 1 empties its text,
    2 removes sentence ends, 3 repeats it, 4 makes it a user turn. A null counts as one space."""
    def spaced(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    draw = F.crc32(F.concat(spaced(conv_id), F.lit(":"), spaced(turn)).cast("binary")) % 20
    hit = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), spaced(role).alias("role"), spaced(text).alias("text"),
                      draw.alias("draw")).where("draw <> 0")
    copies = F.explode(F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return hit.select(
        "conv_id", "turn", F.when(F.col("draw") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("draw") == 1, F.lit("")).when(F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        copies.alias("copy")).drop("copy")


def turns(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, row, digest, kind) as a table; kind is a fault that the row has by itself."""
    filled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role, text)]
    own = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), filled[0].alias("role"), filled[1].alias("text"))
    end = F.substring(F.rtrim(F.col("text"), F.lit(SPACE)), -1, 1)
    kind = F.when(end == "", BLANK).when(end.isin(".", "!", "?"), OK).otherwise(CUT_SHORT)
    return cut(own.select("*", F.monotonically_increasing_id().alias("row"), F.md5(F.col("text").cast("binary")).alias("digest"),
                          kind.alias("kind")), "turns")


def faults(own: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, row, fault) of a table of turns; a row's first fault counts."""
    light = own.select("conv_id", "turn", "role", "digest", "row", "kind")
    firsts = light.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn", "row"))["row"].alias("row"))
    known = light.join(firsts.select("row", F.lit(True).alias("first")), "row", "left")
    fault = F.when(F.col("kind") == BLANK, BLANK).when(F.col("first").isNull(), REPEAT).otherwise(F.col("kind"))
    return known.select("conv_id", "turn", "role", "digest", "row", fault.alias("fault"))


def audits(faulty: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) per conversation, as a table."""
    kind = faulty.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now, state = [], object(), None
        names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]

        def close() -> None:
            if state is not None:
                cost, audit = state["repair"].result()
                gaps = 0 if state["turns"] == 0 else state["last"] - state["first"] + 1 - state["turns"]
                n = state["n"]
                done.append((now, gaps, n[BLANK], n[REPEAT], n[CUT_SHORT], state["illegal"], cost, audit))

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)
            done.clear()
            return out

        types = None
        for batch in batches:
            types = [batch.schema.field(0).type, *[pa.int64()] * 6, pa.string()]
            for conv, turn, initial, fault in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if state is None or conv != now:
                    close()
                    now = conv
                    state = {"repair": Repair(), "n": [0] * 4, "turns": 0, "first": None, "last": None, "before": None, "illegal": 0}
                state["repair"].add(initial, fault)
                state["n"][fault] += 1
                if turn is not None and turn != state["last"]:
                    state["turns"] += 1
                    state["first"] = turn if state["first"] is None else state["first"]
                    state["last"] = turn
                if state["before"] is not None and state["before"] + initial not in ("su", "ua", "au"):
                    state["illegal"] += 1
                state["before"] = initial
            if sum(len(d[-1]) for d in done) > 1 << 20:
                yield flush()
        close()
        if done:
            yield flush()

    light = faulty.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "fault", "role", "digest", "row")
    ordered = light.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest", "row")
    return cut(ordered.select("conv_id", "turn", "initial", "fault").mapInArrow(run, schema), "audits")


def edits(own: DataFrame, audited: DataFrame) -> DataFrame:
    """(conv_id, position, edit, role, text): every edit of the audits applied, a conversation's in order within one partition.

    Rows with edit D are those that go; the others are the repaired conversation.
    """
    kind = own.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = None
        for batch in batches:
            rows: list[tuple] = []
            for conv, audit, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if audit is not None:
                    replay = Replay(audit)
                else:
                    rows += [(conv, *edit) for edit in replay.row(role, text)]
            if rows:
                kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                                                 names=["conv_id", "position", "edit", "role", "text"])

    none = F.lit(None).cast("string")
    heads = audited.select("conv_id", "audit", none.alias("role"), none.alias("text"), F.lit(0).alias("part"),
                           F.lit(None).cast("long").alias("turn"), none.alias("digest"), F.lit(-1).cast("long").alias("row"))
    tails = own.select("conv_id", none.alias("audit"), "role", "text", F.lit(1).alias("part"), "turn", "digest", "row")
    ordered = heads.unionByName(tails).repartition("conv_id").sortWithinPartitions("conv_id", "part", "turn", "role", "digest", "row")
    return ordered.select("conv_id", "audit", "role", "text").mapInArrow(
        run, f"conv_id {kind}, position long, edit string, role string, text string")


def digests(edited: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of edits as edits() gives them: the kept rows as role:text, joined by newlines."""
    kind = edited.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, lines, types = None, None, 0, None
        for batch in batches:
            types, done = batch.schema.field(0).type, []
            for conv, position, edit, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if position == 1:
                    if sha is not None:
                        done.append((now, sha.hexdigest()))
                    now, sha, lines = conv, hashlib.sha256(), 0
                if edit != "D":
                    sha.update((f"\n{role}:{text}" if lines else f"{role}:{text}").encode())
                    lines += 1
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), [types, pa.string()])], names=["conv_id", "repaired_sha256"])
        if sha is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], types), pa.array([sha.hexdigest()])], names=["conv_id", "repaired_sha256"])

    return edited.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def repair(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(fault counts, cost and audit per conversation; the edits applied, see edits)."""
    own = turns(rows, conv_id, turn, role, text)
    audited = audits(faults(own))
    return audited, edits(own, audited)


def repair_report(rows: DataFrame, everything: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """One row for every conversation of ``everything``: counts, cost, audit and the sha256 of the repaired conversation in ``rows``."""
    audited, edited = repair(rows)
    ids = everything.select(F.col(conv_id).alias("id")).distinct()
    out = ids.join(audited, ids["id"].eqNullSafe(audited["conv_id"]), "left").drop("conv_id")
    sha = digests(edited)
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.join(sha, out["id"].eqNullSafe(sha["conv_id"]), "left").select(
        F.col("id").alias("conv_id"), *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
