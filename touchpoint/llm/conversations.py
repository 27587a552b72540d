"""Conversation structure repair (op13): a persistent audit DP.

The rows of a conversation, in order of turn, are edited until the initials of their roles
read ``(s?(ua)+)?``. Which role a kept, re-roled or inserted row must have follows from the
rows before it, so the initials of the edits (K, R, D, I: the *audit*) tell the whole repair,
and the cheapest audit, the least in ASCII order among equals, is unique.

The DP keeps, after each row, the best audit for each of four states. Audits are linked
nodes that share their beginnings; a node knows its 2^k-th ancestors and a rolling hash.
Of two audits of equal cost the longest common prefix is found by lifting both as long as
the hashes differ; equal hashes are verified letter by letter. Audits of one state and cost
are never beginnings of each other (what follows could only be insertions, which cost), so
the smaller of two stays the smaller whatever comes next, and the others can go. What all
live audits share is settled from time to time and kept as text only; states that have
fallen too far behind to matter are given up, as they would share nothing.

Rows are dealt by range of (conv_id, turn, role, digest), so a very long conversation is cut
into pieces: a piece that may continue another is solved for each state that it can start
in. A second pass takes each conversation's pieces, chains them, and streams its rows past
the audit; the digest of the repaired text is a chain by nature, but nothing is held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchpoint.llm.sql_rules import CRC_TABLE, crc32
from touchpoint.llm.stages import small_batches, written

RULES = 20
DROP, EMPTY, UNSTOP, REPEAT, TO_USER = range(5)
OK, BLANK, DUPLICATE, TRUNCATED, GONE = 0, 1, 2, 3, 4
LEGAL = {"su", "ua", "au"}
#: States: nothing yet, after the system row, after a user row, after an assistant row.
NONE, SYSTEM, USER, ASSISTANT = range(4)
DELETE_COST, REROLE_COST, INSERT_COST, TRUNCATED_COST = 3, 2, 2, 1
INSERTS = [(NONE, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER), (USER, ASSISTANT)]
#: (state, other, cost): whatever follows, ``other`` reaches with that much more what
#: ``state`` reaches (it deletes the system row that ``state`` could keep, or inserts).
BEHIND = [(NONE, ASSISTANT, 3), (NONE, USER, 5), (SYSTEM, ASSISTANT, 0), (SYSTEM, USER, 2)]
#: Rows after which the shared beginning of the live audits is settled.
SETTLE = 1024

MODULUS, FACTOR = (1 << 61) - 1, 0x1F3D5B79A2C4E680
BLANKS = r"[ \x09-\x0D]"


class Node:
    """An audit: the one of ``parent`` and one more letter."""

    __slots__ = ("parent", "letter", "depth", "hash", "up", "twin")

    def __init__(self, parent: Node | None, letter: str):
        self.parent, self.letter, self.twin = parent, letter, None
        if parent is None:
            self.depth, self.hash, self.up = 0, 0, []
            return
        self.depth = parent.depth + 1
        self.hash = (parent.hash * FACTOR + ord(letter)) % MODULUS
        up, k = [parent], 0
        while k < len(up[k].up):
            up.append(up[k].up[k])
            k += 1
        self.up = up

    def ancestor(self, depth: int) -> Node:
        node = self
        while node.depth > depth:
            k = min(len(node.up), (node.depth - depth).bit_length()) - 1
            node = node.up[k]
        return node


def one_of(node: Node) -> Node:
    while node.twin is not None:
        node = node.twin
    return node


def equal(a: Node, b: Node) -> bool:
    """Verifies that two nodes of equal depth and hash stand for the same letters; equal
    ones become twins, so that no stretch is read twice."""
    x, y = one_of(a), one_of(b)
    met = []
    while x is not y:
        if x.letter != y.letter:
            return False
        met.append((x, y))
        if x.parent is None or y.parent is None:
            break
        x, y = one_of(x.parent), one_of(y.parent)
    for x, y in met:
        if one_of(x) is not one_of(y):
            one_of(y).twin = one_of(x)
    return True


def letters_down_to(node: Node, base: int = 0) -> str:
    out = []
    while node.depth > base:
        out.append(node.letter)
        node = node.parent
    return "".join(reversed(out))


def less(a: Node, b: Node) -> bool:
    """Is audit ``a`` less than audit ``b``?"""
    depth = min(a.depth, b.depth)
    x, y = a.ancestor(depth), b.ancestor(depth)
    if x.hash == y.hash and equal(x, y):
        return a.depth < b.depth
    p, q = x, y
    while p.parent is not q.parent and p.parent.hash != q.parent.hash:
        for k in range(min(len(p.up), len(q.up)) - 1, -1, -1):
            if p.up[k].hash != q.up[k].hash:
                p, q = p.up[k], q.up[k]
                break
    if equal(p.parent, q.parent) and p.letter != q.letter:
        return p.letter < q.letter
    # two different audits with one hash: compare all letters
    while x.parent is not y.parent:
        if x.letter != y.letter:
            p, q = x, y
        x, y = x.parent, y.parent
    return x.letter < y.letter if x.letter != y.letter else p.letter < q.letter


class Audits:
    """The best audit (cost, node) of each state that can be reached from ``start``."""

    def __init__(self, start: int):
        self.best: list[tuple[int, Node] | None] = [None] * 4
        self.best[start] = (0, Node(None, ""))
        self.settled, self.base, self.rows = [], 0, 0
        self.insert()

    @staticmethod
    def offer(best: list, state: int, cost: int, parent: Node, letter: str) -> None:
        held = best[state]
        if held is None or cost < held[0]:
            best[state] = (cost, Node(parent, letter))
        elif cost == held[0]:
            node = Node(parent, letter)
            if less(node, held[1]):
                best[state] = (cost, node)

    def insert(self) -> None:
        for at, to in INSERTS:
            if self.best[at] is not None:
                cost, node = self.best[at]
                self.offer(self.best, to, cost + INSERT_COST, node, "I")

    def row(self, initial: str, fault: int) -> None:
        new: list[tuple[int, Node] | None] = [None] * 4
        extra = TRUNCATED_COST if fault == TRUNCATED else 0
        for state, held in enumerate(self.best):
            if held is None:
                continue
            cost, node = held
            self.offer(new, state, cost + DELETE_COST, node, "D")
            if fault in (BLANK, DUPLICATE):
                continue
            wanted = ASSISTANT if state == USER else USER
            kept = wanted if initial == ("a" if wanted == ASSISTANT else "u") else SYSTEM if initial == "s" and state == NONE else None
            if kept is not None:
                self.offer(new, kept, cost + extra, node, "K")
            self.offer(new, wanted, cost + REROLE_COST + extra, node, "R")
        self.best = new
        self.insert()
        for at, other, more in BEHIND:
            if new[at] is not None and new[other] is not None and new[other][0] + more < new[at][0]:
                new[at] = None
        self.rows += 1
        if self.rows % SETTLE == 0:
            self.settle()

    def settle(self) -> None:
        """Keeps what all live audits share as text, and lets go of its nodes."""
        live = [held[1] for held in self.best if held is not None]
        depth = min(n.depth for n in live)
        at = [n.ancestor(depth) for n in live]
        while any(n is not at[0] for n in at):
            depth -= 1
            at = [n.parent for n in at]
        shared, node = [], at[0]
        while node.depth > self.base:
            shared.append(node.letter)
            above = node.parent
            if node is not at[0]:
                node.parent, node.up = None, []
            node = above
        self.settled.append("".join(reversed(shared)))
        self.base = max(self.base, depth)

    def text(self, node: Node) -> str:
        return "".join(self.settled) + letters_down_to(node, self.base)


STATS = ["rows", "blank", "duplicate", "truncated", "illegal", "turns"]
PIECE = "piece int, src int, dst int, cost long, audit string, first_initial string, last_initial string, low {turn}, high {turn}, " + ", ".join(f"{s} long" for s in STATS)


class Piece:
    """Consecutive rows of one conversation, given in order."""

    def __init__(self, conv_id, number: int, open_start: bool):
        self.conv_id, self.number = conv_id, number
        self.audits = [Audits(s) for s in (range(4) if open_start else [NONE])]
        self.stats = dict.fromkeys(STATS, 0)
        self.first = self.last = self.low = self.high = self.before = None

    def add(self, turn, role: str, digest: str, fault: int) -> None:
        if fault == GONE:
            return
        # equal rows lie next to each other; all but the first were seen before
        if fault != BLANK and self.before == (turn, role, digest):
            fault = DUPLICATE
        self.before = (turn, role, digest)
        initial = role[:1]
        s = self.stats
        s["rows"] += 1
        if fault:
            s[{BLANK: "blank", DUPLICATE: "duplicate", TRUNCATED: "truncated"}[fault]] += 1
        if self.last is None:
            self.first = initial
        elif self.last + initial not in LEGAL:
            s["illegal"] += 1
        self.last = initial
        if turn is not None and turn != self.high:
            s["turns"] += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        for a in self.audits:
            a.row(initial, fault)

    def records(self) -> Iterator[tuple]:
        for source, a in enumerate(self.audits):
            for state, held in enumerate(a.best):
                if held is not None:
                    yield (self.conv_id, self.number, source, state, held[0], a.text(held[1]), self.first, self.last, self.low, self.high, *(self.stats[s] for s in STATS))


def batch_rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(column.to_pylist() for column in batch.columns))


def emit(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)


def solve_pieces(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, piece, out = TaskContext.get().partitionId(), None, []
        for batch in batches:
            for conv_id, turn, role, digest, fault in batch_rows(batch):
                if piece is None or piece.conv_id != conv_id:
                    if piece is not None:
                        out.extend(piece.records())
                    # only the first conversation of a task can have begun in another one
                    piece = Piece(conv_id, number, piece is None)
                piece.add(turn, role, digest, fault)
            if len(out) > 4096:
                yield emit(out, schema)
                out = []
        if piece is not None:
            out.extend(piece.records())
        yield emit(out, schema)

    return run


class Repair:
    """Chains the pieces of a conversation, then turns its rows into the repaired ones."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.best: dict[int, tuple[int, str]] = {NONE: (0, "")}
        self.number, self.next = None, {}
        self.totals = dict.fromkeys(STATS, 0)
        self.last = self.low = self.high = None
        self.audit, self.at, self.state, self.cost, self.before = None, 0, NONE, 0, None

    def piece(self, number, src, dst, cost, audit, first, last, low, high, *stats) -> None:
        if number != self.number:
            self._close()
            self.number = number
            if first is not None:
                self.totals["illegal"] += self.last is not None and self.last + first not in LEGAL
                self.last = last
            if low is not None:
                self.totals["turns"] -= low == self.high
                self.low = low if self.low is None else self.low
                self.high = high
            for name, value in zip(STATS, stats):
                self.totals[name] += value
        if src in self.best:
            total = (self.best[src][0] + cost, self.best[src][1] + audit)
            if dst not in self.next or total < self.next[dst]:
                self.next[dst] = total

    def _close(self) -> None:
        if self.next:
            self.best, self.next = self.next, {}

    def choose(self) -> None:
        if self.audit is None:
            self._close()
            self.cost, self.audit = min(self.best[s] for s in (NONE, ASSISTANT) if s in self.best)

    def _wanted(self) -> str:
        return "assistant" if self.state == USER else "user"

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            role = self._wanted()
            self.state = ASSISTANT if role == "assistant" else USER
            self.at += 1
            yield role, ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "D":
            return
        if edit == "R":
            role = self._wanted()
        self.state = SYSTEM if self.state == NONE and role[:1] == "s" else ASSISTANT if self.state == USER else USER
        yield role, text

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.totals["turns"]


def replay(batches: Iterator[pa.RecordBatch], on_line, on_end) -> Iterator[tuple]:
    """Calls ``on_line(repair, role, text)`` for every repaired row, and ``on_end(repair)``
    after each conversation; yields what they return."""
    now = None

    def finish():
        now.choose()
        for role, text in now.inserted():
            yield from on_line(now, role, text)
        yield from on_end(now)

    for batch in batches:
        for conv_id, kind, role, text, fault, *piece in batch_rows(batch):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    yield from finish()
                now = Repair(conv_id)
            if kind == 0:
                now.piece(*piece)
            elif fault != GONE:
                now.choose()
                for line in now.row(role, text):
                    yield from on_line(now, *line)
    if now is not None:
        yield from finish()


def in_batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += sum(len(v) for v in row if isinstance(v, str)) + 64
        if size > 1 << 20:
            yield emit(out, schema)
            out, size = [], 0
    yield emit(out, schema)


def summaries(schema: pa.Schema):
    def run(batches):
        def on_line(repair, role, text):
            if repair.before is None:
                repair.before = hashlib.sha256()
            else:
                repair.before.update(b"\n")
            repair.before.update(f"{role}:{text}".encode())
            return ()

        def on_end(r):
            digest = (r.before or hashlib.sha256()).hexdigest()
            t = r.totals
            yield (r.conv_id, r.gaps(), t["blank"], t["duplicate"], t["truncated"], t["illegal"], r.cost, r.audit, digest, t["rows"])

        yield from in_batches(replay(batches, on_line, on_end), schema)

    return run


def repaired_lines(schema: pa.Schema):
    def run(batches):
        def on_line(repair, role, text):
            repair.before = (repair.before or 0) + 1
            yield repair.conv_id, repair.before, role, text

        yield from in_batches(replay(batches, on_line, lambda r: ()), schema)

    return run


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: the rows damaged by the digest of their place. A
    dropped row stays as ``gone``, so that its conversation is known."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rule = F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")), F.lit(RULES))
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), rule.alias("rule"))
    text = F.when(F.col("rule").isin(DROP, EMPTY), "").when(F.col("rule") == UNSTOP, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("rule") == TO_USER, "user").otherwise(F.col("role"))
    times = F.when(F.col("rule") == REPEAT, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("rule") == DROP).alias("gone"), F.explode(times).alias("copy")).drop("copy")


def with_faults(rows: DataFrame) -> DataFrame:
    """Adds digest and fault; a row whose role and text came in an earlier turn is a
    duplicate (equal rows of one turn are found when the rows are read in order)."""
    rows = rows.withColumn("digest", F.sha2("text", 256))
    there = rows.where("NOT gone")
    # nulls come first; partial aggregation leaves one row a task of a hot text
    firsts = there.groupBy("conv_id", "role", "digest").agg(F.min("turn").alias("low"), F.max(F.col("turn").isNull()).alias("unnumbered"))
    firsts = firsts.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.when(~F.col("unnumbered"), F.col("low")).alias("low"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    later = F.col("turn").isNotNull() & (F.col("low").isNull() | (F.col("turn") > F.col("low")))
    last = F.right(F.regexp_replace("text", rf"{BLANKS}+\z", ""), F.lit(1))
    fault = (
        F.when(F.col("gone"), GONE)
        .when(~F.col("text").rlike(r"[^ \x09-\x0D]"), BLANK)
        .when(F.col("c_seen") & later, DUPLICATE)
        .when(~last.isin(".", "!", "?"), TRUNCATED)
        .otherwise(OK)
    )
    joined = rows.join(firsts.withColumn("c_seen", F.lit(True)), same, "left")
    return joined.select("conv_id", "turn", "role", "text", "digest", fault.alias("fault"))


def _arrow(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def pieces_and_rows(rows: DataFrame) -> DataFrame:
    """All rows of each conversation in one task, in order: first its pieces, then its rows."""
    small_batches(rows.sparkSession)
    kinds = dict(rows.dtypes)
    flagged = written(with_faults(rows), "turns")
    order = ["conv_id", "turn", "role", "digest"]
    schema = f"conv_id {kinds['conv_id']}, {PIECE.format(turn=kinds['turn'])}"
    ranged = flagged.select(*order, "fault").repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = written(ranged.mapInArrow(solve_pieces(_arrow(rows.sparkSession, schema)), schema), "pieces")
    of_piece = [c for c in pieces.columns if c != "conv_id"]
    blank = lambda df, names, kinds: [F.lit(None).cast(kinds[n]).alias(n) for n in names]
    piece_kinds = dict(pieces.dtypes)
    # the input's own rows have kind 1 and come after the pieces
    first = pieces.select("conv_id", F.lit(0).alias("kind"), *blank(pieces, ["role", "text", "fault", "turn", "digest"], {"role": "string", "text": "string", "fault": "int", "turn": kinds["turn"], "digest": "string"}), *of_piece)
    then = flagged.select("conv_id", F.lit(1).alias("kind"), "role", "text", F.col("fault").cast("int").alias("fault"), "turn", "digest", *blank(flagged, of_piece, piece_kinds))
    both = first.unionByName(then).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "piece", "turn", "role", "digest")
    return both.select("conv_id", "kind", "role", "text", "fault", *of_piece)


def repair(rows: DataFrame) -> DataFrame:
    """One row per conv_id of ``rows`` (conv_id, turn, role, text, gone): gaps, blank,
    duplicate, truncated, illegal, cost, audit, repaired_sha256, n_rows.

    Rows are taken by turn, nulls first; rows of one turn by role and then by the SHA-256 of
    their text, so that equal rows are neighbours. A null conv_id is a conversation like the
    others. Roles are known by their first letter; rows of other roles can only be re-roled
    or deleted. A conversation whose rows are all ``gone`` has zeros, an empty audit and the
    digest of the empty text. Columns of other names are ignored; an empty table gives an
    empty result.
    """
    conv = dict(rows.dtypes)["conv_id"]
    schema = f"conv_id {conv}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, n_rows long"
    return pieces_and_rows(rows).mapInArrow(summaries(_arrow(rows.sparkSession, schema)), schema)


def repaired_rows(rows: DataFrame) -> DataFrame:
    """conv_id, position (from 1), role, text: the repaired conversations themselves."""
    schema = f"conv_id {dict(rows.dtypes)['conv_id']}, position long, role string, text string"
    return pieces_and_rows(rows).mapInArrow(repaired_lines(_arrow(rows.sparkSession, schema)), schema)


def oracle_sql() -> str:
    """The query in DuckDB SQL: a recursion over the rows that keeps the least of the
    cheapest whole audits of each state, as plain text."""
    key = "(coalesce(ids.conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))"
    stop = "regexp_extract(text, '([^ \\x09-\\x0D])[ \\x09-\\x0D]*$', 1)"
    return rf"""
WITH RECURSIVE crc AS {CRC_TABLE},
ids AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
raw AS (SELECT c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32(key)} % {RULES} AS k FROM conversations JOIN ids ON conversations.conv_id IS NOT DISTINCT FROM ids.conv_id, crc),
hurt AS (
  SELECT c, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM raw WHERE k <> 0
),
placed AS (SELECT c, turn, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM hurt),
rows_ AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^ \x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'd'
                 WHEN {stop} NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
         lag(substr(role, 1, 1)) OVER (PARTITION BY c ORDER BY i) || substr(role, 1, 1) AS pair
  FROM placed
),
ins(q, p, s, c, lines) AS (VALUES ('N', 'N', '', 0, []::VARCHAR[]), ('N', 'U', 'I', 2, ['user:']), ('N', 'A', 'II', 4, ['user:', 'assistant:']), ('S', 'S', '', 0, []),
  ('S', 'U', 'I', 2, ['user:']), ('S', 'A', 'II', 4, ['user:', 'assistant:']), ('U', 'U', '', 0, []), ('U', 'A', 'I', 2, ['assistant:']), ('A', 'A', '', 0, []), ('A', 'U', 'I', 2, ['user:'])),
edit(p, e, need, q, c, role) AS (VALUES ('N', 'K', 's', 'S', 0, NULL), ('N', 'K', 'u', 'U', 0, NULL), ('S', 'K', 'u', 'U', 0, NULL), ('U', 'K', 'a', 'A', 0, NULL), ('A', 'K', 'u', 'U', 0, NULL),
  ('N', 'R', NULL, 'U', 2, 'user'), ('S', 'R', NULL, 'U', 2, 'user'), ('U', 'R', NULL, 'A', 2, 'assistant'), ('A', 'R', NULL, 'U', 2, 'user'),
  ('N', 'D', NULL, 'N', 3, NULL), ('S', 'D', NULL, 'S', 3, NULL), ('U', 'D', NULL, 'U', 3, NULL), ('A', 'D', NULL, 'A', 3, NULL)),
step AS (
  SELECT c, 0::BIGINT AS i, 'N' AS q, 0 AS cost, '' AS audit, []::VARCHAR[] AS lines FROM ids
  UNION ALL
  SELECT c, i, q, cost, audit, lines FROM (
    SELECT s.c, r.i, e.q, s.cost + n.c + e.c + CASE WHEN e.e <> 'D' AND r.fault = 't' THEN 1 ELSE 0 END AS cost, s.audit || n.s || e.e AS audit,
           list_concat(list_concat(s.lines, n.lines), CASE e.e WHEN 'D' THEN [] ELSE [coalesce(e.role, r.role) || ':' || r.text] END) AS lines,
           row_number() OVER (PARTITION BY s.c, e.q ORDER BY s.cost + n.c + e.c + CASE WHEN e.e <> 'D' AND r.fault = 't' THEN 1 ELSE 0 END, s.audit || n.s || e.e) AS best
    FROM step s JOIN rows_ r ON r.c = s.c AND r.i = s.i + 1 JOIN ins n ON n.q = s.q JOIN edit e ON e.p = n.p
    WHERE (e.need IS NULL OR e.need = substr(r.role, 1, 1)) AND (e.e = 'D' OR r.fault NOT IN ('b', 'd'))
  ) WHERE best = 1
),
counts AS (
  SELECT c, count(*) AS n_rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
         count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows_ GROUP BY c
),
done AS (
  SELECT s.c, s.cost + n.c AS cost, s.audit || n.s AS audit, list_concat(s.lines, n.lines) AS lines
  FROM step s JOIN ids USING (c) LEFT JOIN counts USING (c) JOIN ins n ON n.q = s.q
  WHERE s.i = coalesce(n_rows, 0) AND n.p IN ('N', 'A')
  QUALIFY row_number() OVER (PARTITION BY s.c ORDER BY s.cost + n.c, s.audit || n.s) = 1
)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       cost::BIGINT AS cost, audit, sha256(array_to_string(lines, chr(10))) AS repaired_sha256, coalesce(n_rows, 0) AS n_rows
FROM done JOIN ids USING (c) LEFT JOIN counts USING (c)
"""
