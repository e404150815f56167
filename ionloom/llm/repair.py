"""Repair of conversations by the cheapest edits, found by a Viterbi search whose survivors coalesce.

The rows of a conversation are in order of turn (nulls first; equal turns by role, then text). Each has at most one
fault, the first that holds: `blank` (nothing but white space), `duplicate` (role and text stand earlier in the
conversation), `truncated` (the last character that is not white space is none of `.!?`).

Edits: K keeps a row (cost 0), R gives it the role user or assistant (2), D deletes it (3; blank rows and duplicates
must go), I inserts an empty user or assistant row (2); a truncated row that is not deleted costs 1 more. What is left
must have the role initials `(s?(ua)+)?`. Of the cheapest ways, the one whose edit letters are least as text is taken.

The search reads rows one by one and holds, for each of four states (nothing yet, system, user, assistant last), the best
way there: a survivor, the end of a path in a tree of back pointers. Nodes count their references: a node with one
child becomes one with it, so the tree has a few nodes however long the conversation is, and when all survivors share
an ancestor the letters up to it are emitted for good. Ways of equal cost are compared over all that is unresolved: two
paths part at a node, whose children differ in their first letter. Each node has the state of the running SHA-256 of
the repaired rows, copied where paths part, so no text waits for a decision; a letter a row does, until it is resolved.

Duplicates are found before, by a shuffle on the digest of conversation, role and text that is split for digests with very many rows.
The rows of one conversation then pass through one task as a sorted stream, one at a time; they are never held together.
The digest of the repaired text is sequential, which is why a conversation is not dealt over tasks here; `repaired_turns`
rebuilds the texts relationally from the edit letters.

Null role and text count as one space; a null conv_id is a conversation of its own; null turns come first and count
for no gap. Repeated rows are duplicates of each other. A conversation without rows has zeros and empty texts; an
empty table gives no rows. Columns other than conv_id, turn, role and text are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ionloom.llm.common import heavy_keys, salted_join

# Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

START, SYSTEM, USER, ASSISTANT = range(4)
_AFTER = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_TURNS = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
_NAMES = {USER: "user", ASSISTANT: "assistant"}
_LEGAL = {"su", "ua", "au"}


# --- the search -------------------------------------------------------------------------------------


class Node:
    """Letters since the parent, how many children and survivors refer to the node, and the hash of all rows up to it."""

    __slots__ = ("parent", "letters", "references", "digest")

    def __init__(self, parent: Node | None, letters: bytes, digest):
        self.parent, self.letters, self.references, self.digest = parent, bytearray(letters), 0, digest
        if parent:
            parent.references += 1

    def path(self) -> list[Node]:
        out = [self]
        while out[-1].parent:
            out.append(out[-1].parent)
        return out[::-1]


def _release(node: Node | None) -> None:
    """One reference less; a node without any lets go of its parent."""
    while node:
        node.references -= 1
        if node.references:
            return
        node = node.parent


def earlier(node: Node, letter: bytes, other: Node, other_letter: bytes) -> bool:
    """Whether the path to `node` and `letter` is less, as text, than that to `other` and its letter."""
    if node is other:
        return letter < other_letter
    mine, its = node.path(), other.path()
    shared = 0
    while shared < len(mine) and shared < len(its) and mine[shared] is its[shared]:
        shared += 1
    first = bytes(mine[shared].letters[:1]) if shared < len(mine) else letter
    return first < (bytes(its[shared].letters[:1]) if shared < len(its) else other_letter)


class Survivors:
    """The best way to each state, and the letters that are settled."""

    def __init__(self):
        self.emitted = bytearray()
        self.root = Node(None, b"", hashlib.sha256())
        self.best: dict[int, tuple[int, Node]] = {}
        self._take(self.best, START, 0, self.root)
        self._insert(self.best)
        self._coalesce()

    @staticmethod
    def _take(best: dict, state: int, cost: int, node: Node) -> None:
        node.references += 1
        if state in best:
            _release(best[state][1])
        best[state] = cost, node

    @staticmethod
    def _extended(node: Node, letter: bytes, line: str | None, first: bool) -> Node:
        digest = node.digest
        if line is not None:
            digest = digest.copy()
            digest.update((line if first else "\n" + line).encode("utf-8", "surrogatepass"))
        return Node(node, letter, digest)

    def _insert(self, best: dict) -> None:
        """Ways that go on with inserted rows, until none is better."""
        again = True
        while again:
            again = False
            for state, to in _TURNS.items():
                if state not in best:
                    continue
                cost, node = best[state]
                cost += INSERT
                if to in best and (best[to][0] < cost or (best[to][0] == cost and not earlier(node, b"I", best[to][1], b""))):
                    continue
                self._take(best, to, cost, self._extended(node, b"I", f"{_NAMES[to]}:", state == START))
                again = True

    def add(self, role: str, text: str, fault: str | None) -> None:
        """Reads the next row."""
        offers: dict[int, list[tuple[int, Node, bytes, str | None, bool]]] = {}
        more = TRUNCATED if fault == "truncated" else 0
        for state, (cost, node) in self.best.items():
            offers.setdefault(state, []).append((cost + DELETE, node, b"D", None, False))
            if fault in ("blank", "duplicate"):
                continue
            to = _AFTER.get(role[:1], {}).get(state)
            if to is not None:
                offers.setdefault(to, []).append((cost + more, node, b"K", role, state == START))
            to = _TURNS[state]
            offers.setdefault(to, []).append((cost + more + REROLE, node, b"R", _NAMES[to], state == START))
        best: dict[int, tuple[int, Node]] = {}
        for to, ways in offers.items():
            way = ways[0]
            for other in ways[1:]:
                if other[0] < way[0] or (other[0] == way[0] and earlier(other[1], other[2], way[1], way[2])):
                    way = other
            cost, node, letter, name, first = way
            self._take(best, to, cost, self._extended(node, letter, None if name is None else f"{name}:{text}", first))
        for _, node in self.best.values():
            _release(node)
        self.best = best
        self._insert(best)
        self._forget()
        self._coalesce()

    def _forget(self) -> None:
        """Drops survivors that cannot win: what goes on from them goes on from ASSISTANT for less.

        That state allows all that follows SYSTEM, and all that follows START but for a system row, which it deletes.
        """
        if ASSISTANT in self.best:
            for state, dearer in ((START, DELETE), (SYSTEM, 0)):
                if state in self.best and self.best[state][0] > self.best[ASSISTANT][0] + dearer:
                    _release(self.best.pop(state)[1])

    def _coalesce(self) -> None:
        """Nodes with one reference, a child's, become one with it; what follows the root alone is emitted."""
        for _, leaf in self.best.values():
            node = leaf
            while node.parent:
                above = node.parent
                if above.references > 1:
                    node = above
                    continue
                if above.parent is None:  # all survivors come through `node`
                    self.emitted += node.letters
                    node.letters, node.parent, self.root = bytearray(), None, node
                else:
                    above.letters += node.letters
                    node.letters, node.parent = above.letters, above.parent

    def unresolved(self) -> int:
        """Letters that some survivors have and others not."""
        nodes = {id(n): n for _, leaf in self.best.values() for n in leaf.path()}
        return sum(len(n.letters) for n in nodes.values())

    def result(self) -> tuple[int, str, str]:
        """Cost, letters and digest of the best way to an accepted end."""
        ways = [self.best[s] for s in (START, ASSISTANT) if s in self.best]
        cost, node = ways[0]
        for other_cost, other in ways[1:]:
            if other_cost < cost or (other_cost == cost and earlier(other, b"", node, b"")):
                cost, node = other_cost, other
        letters = bytes(self.emitted) + b"".join(bytes(n.letters) for n in node.path())
        return cost, letters.decode(), node.digest.hexdigest()


# --- rows -------------------------------------------------------------------------------------------


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: each row after the damage that crc32 of `conv_id:turn` deals it.

    `copies` is 0 for a row that is dropped and 2 for one that is repeated. Nulls count as one space, also in the key.
    """
    space = F.lit(" ")
    key = F.concat(*[F.coalesce(F.col(c).cast("string"), space) if c != ":" else F.lit(":") for c in ("conv_id", ":", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", space)
    return turns.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.when(kind == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def _same(conv_id: str, role: str, text: str) -> Column:
    """A digest that is equal for equal conversation, role and text."""
    return F.unhex(F.sha2(F.concat(F.coalesce(F.col(conv_id).cast("string"), F.lit("")), F.lit("|"), F.length(role).cast("string"), F.lit("|"), F.col(role), F.lit("|"), F.col(text)), 256))


def ordered_rows(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies, fault, again, a sorted stream per conversation.

    `rows` has a `copies` column; rows of 0 copies only say that the conversation exists. `again`: role and text are those of an
    earlier turn (equal rows of one turn lie next to each other, the stream sees them).
    """
    rows = rows.withColumn("_same", _same("conv_id", "role", "text"))
    at = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn"))
    firsts = rows.where("copies > 0").groupBy("_same").agg(F.min(at).alias("_first"), F.count(F.lit(1)).alias("n"))
    total = rows.count()
    heavy = heavy_keys(firsts, "_same", total)
    found = salted_join(rows, firsts.drop("n"), "_same", "left", heavy, F.xxhash64("turn"))
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    ended = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    found = found.select(
        "conv_id", "turn", "role", "text", "copies",
        F.when(blank, "blank").when(~ended, "truncated").alias("fault"),
        F.coalesce(F.col("_first") < at, F.lit(False)).alias("again"),
    )
    return found.repartition("conv_id").sortWithinPartitions("conv_id", F.col("copies") > 0, F.asc_nulls_first("turn"), "role", "text")


class Reader:
    """Counts and survivors of one conversation, row by row."""

    COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")

    def __init__(self, conv_id: int | None):
        self.conv_id, self.survivors = conv_id, Survivors()
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.low = self.high = self.before = None
        self.turns = 0

    def add(self, turn: int | None, role: str, text: str, copies: int, fault: str | None, again: bool) -> None:
        for _ in range(copies):
            row = turn, role, text
            own = fault
            if fault != "blank" and (again or row == self.before):
                own = "duplicate"
            if own:
                self.counts[own] += 1
            if self.before and self.before[1][:1] + role[:1] not in _LEGAL:
                self.counts["illegal"] += 1
            if turn is not None and turn != self.high:
                self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
            self.before = row
            self.survivors.add(role, text, own)

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        cost, audit, digest = self.survivors.result()
        return self.conv_id, gaps, *self.counts.values(), cost, audit, digest


_REPAIRED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of `rows` (conv_id, turn, role, text, copies): counts of faults, cost, edit letters, digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [x.split() for x in _REPAIRED.split(", ")]
        schema = pa.schema([(name, pa.string() if kind == "string" else pa.int64()) for name, kind in fields])
        reader, out = None, []
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                for conv_id, *row in zip(*(c.to_pylist() for c in batch.slice(low, 1024).columns)):
                    if reader is None or reader.conv_id != conv_id:
                        if reader:
                            out.append(reader.row())
                        reader = Reader(conv_id)
                    reader.add(*row)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), schema)], schema=schema)
                    out = []
        if reader:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(reader.row(), schema)], schema=schema)

    return ordered_rows(rows).mapInArrow(run, _REPAIRED)


def numbered(rows: DataFrame) -> DataFrame:
    """conv_id, row_no, role, text: the rows in the order the edits are for, each copy by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number = (), 0
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                out = []
                for conv_id, role, text, copies in zip(*(c.to_pylist() for c in batch.slice(low, 1024).columns)):
                    if now != (conv_id,):
                        now, number = (conv_id,), 0
                    for _ in range(copies):
                        out.append((conv_id, number, role, text))
                        number += 1
                if out:
                    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], ["conv_id", "row_no", "role", "text"])

    return ordered_rows(rows).select("conv_id", "role", "text", "copies").mapInArrow(run, "conv_id long, row_no long, role string, text string")


def repaired_turns(rows: DataFrame, repaired: DataFrame) -> DataFrame:
    """conv_id, turn_no, edit, role, text: what is left of `rows` after the edits of `repaired`, in order.

    The role of each step follows from the letters alone: users and assistants take turns, a system row kept comes first.
    """
    letter = F.expr("substring(audit, step, 1)")
    steps = repaired.where("audit <> ''").select("conv_id", "audit", F.explode(F.sequence(F.lit(1), F.length("audit"))).alias("step"))
    # rows read and rows left up to each step, from the letters before it
    before = F.expr("substring(audit, 1, step - 1)")
    steps = steps.select(
        "conv_id", letter.alias("edit"), "step",
        F.length(F.translate(before, "I", "")).cast("long").alias("row_no"),
        F.length(F.translate(before, "D", "")).cast("long").alias("turn_no"),
    ).where("edit <> 'D'")
    own = numbered(rows).withColumnRenamed("conv_id", "_conv")
    kept = steps.join(own.withColumnRenamed("row_no", "_row"), F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("row_no") == F.col("_row")) & (F.col("edit") != "I"), "left")
    system = kept.where("turn_no = 0 AND edit = 'K' AND substring(role, 1, 1) = 's'").select(F.col("conv_id").alias("_with"), F.lit(1).alias("_system")).distinct()
    kept = kept.join(system, F.col("conv_id").eqNullSafe(F.col("_with")), "left")
    place = F.col("turn_no") - F.coalesce("_system", F.lit(0))
    role = F.when(F.col("edit") == "K", F.col("role")).when(place % 2 == 0, "user").otherwise("assistant")
    return kept.select("conv_id", "turn_no", "edit", role.alias("role"), F.when(F.col("edit") == "I", "").otherwise(F.col("text")).alias("text"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every original conv_id, damaged by rule and repaired."""
    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def _sql_fold() -> str:
    """The search in SQL: per row the best (cost, letters, output) of each state, by a recursive query over rows."""
    moves = [("s", START, SYSTEM), ("u", START, USER), ("u", SYSTEM, USER), ("u", ASSISTANT, USER), ("a", USER, ASSISTANT)]
    rows = [f"('K', '{i}', {a}, {b}, 0, NULL)" for i, a, b in moves]
    rows += [f"('R', NULL, {a}, {b}, {REROLE}, '{_NAMES[b]}')" for a, b in _TURNS.items()]
    rows += [f"('D', NULL, {s}, {s}, {DELETE}, NULL)" for s in range(4)]
    inserts = [(s, s, "", 0, "") for s in range(4)]
    for s in range(4):
        to, letters, out = s, "", ""
        for k in range(1, 4):
            to = _TURNS[to]
            letters += "I"
            out += f"|| chr(10) || '{_NAMES[to]}:'"
            inserts.append((s, to, letters, k * INSERT, out))
    values = ", ".join(f"({a}, {b}, '{letters}', {cost}, " + (out.removeprefix("|| ") or "''") + ")" for a, b, letters, cost, out in inserts)
    return ", ".join(rows), values


_EDITS, _INSERTS = _sql_fold()
_LEAST = "min(struct_pack(cost := cost, audit := audit, out := out))"

OP12_SQL = f"""
WITH RECURSIVE source AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key
  FROM conversations
), crc_steps AS (
  SELECT CAST(n AS BIGINT) AS n, CAST(n AS BIGINT) AS c, 0 AS k FROM range(256) t(n)
  UNION ALL SELECT n, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM crc_steps WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY n) AS t FROM crc_steps WHERE k = 8
), crc_walk AS (
  SELECT DISTINCT key, CAST(0 AS BIGINT) AS pos, CAST(4294967295 AS BIGINT) AS c FROM source
  UNION ALL SELECT key, pos + 1, xor(c // 256, t[xor(c & 255, CAST(ascii(substr(key, pos + 1, 1)) AS BIGINT)) + 1]) FROM crc_walk, crc_table WHERE pos < length(key)
), dealt AS (SELECT s.*, xor(c, 4294967295) % 20 AS kind FROM source s JOIN crc_walk w ON w.key = s.key AND w.pos = length(s.key)
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM dealt WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i FROM damaged
), faulty AS (
  SELECT conv_id, turn, i, role, text, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS before,
    CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault
  FROM placed
), edits(letter, initial, a, b, price, name) AS (VALUES {_EDITS}
), inserts(a, b, letters, price, added) AS (VALUES {_INSERTS}
), walk AS (
  SELECT c.conv_id, CAST(0 AS BIGINT) AS i, n.b AS state, {{'cost': CAST(n.price AS BIGINT), 'audit': n.letters, 'out': n.added}} AS best
  FROM (SELECT DISTINCT conv_id FROM conversations) c, inserts n WHERE n.a = {START}
  UNION ALL
  SELECT conv_id, i, state, {_LEAST} FROM (
    SELECT w.conv_id, r.i, n.b AS state, w.best.cost + e.price + n.price + CASE WHEN e.letter <> 'D' AND r.fault = 'truncated' THEN {TRUNCATED} ELSE 0 END AS cost,
      w.best.audit || e.letter || n.letters AS audit,
      w.best.out || CASE WHEN e.letter = 'D' THEN '' ELSE chr(10) || coalesce(e.name, r.role) || ':' || r.text END || n.added AS out
    FROM walk w JOIN faulty r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1
    JOIN edits e ON e.a = w.state AND (e.letter = 'D' OR r.fault IN ('', 'truncated')) AND (e.initial IS NULL OR e.initial = substr(r.role, 1, 1))
    JOIN inserts n ON n.a = e.b
  ) GROUP BY conv_id, i, state
), ends AS (
  SELECT w.conv_id, min(w.best) AS best FROM walk w
  WHERE w.state IN ({START}, {ASSISTANT}) AND w.i = (SELECT count(*) FROM faulty r WHERE r.conv_id IS NOT DISTINCT FROM w.conv_id) GROUP BY w.conv_id
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND substr(before, 1, 1) || substr(role, 1, 1) NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id
)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, e.best.cost AS cost, e.best.audit AS audit, sha256(substr(e.best.out, 2)) AS repaired_sha256
FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
"""
