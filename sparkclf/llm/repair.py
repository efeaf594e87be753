"""Conversation structure repair (persistent audit DP).

The rows of a conversation are edited at least cost into the role pattern ``(s?(ua)+)?``
(s system, u user, a assistant): Keep 0, Rerole to user or assistant 2, Delete 3, Insert an
empty user or assistant row 2, and 1 for every truncated row that is not deleted; blank and
duplicate rows must go.  The audit is the string of the edits' initials.  Of equally cheap
edits the ASCII-least audit is taken.

The dynamic programme goes over the rows with the four states of the pattern.  An audit is
a node that points to the node of its prefix, so audits share their prefixes; each node keeps
its 2^k-th ancestors and a rolling hash.  Two audits of equal cost are compared by searching
their longest common prefix with hashes of ancestors; equal hashes are verified by walking
to a shared node.  Two audits of one state and cost never extend one another (their rows are
the same, so the longer one would have more Inserts and a higher cost); their first
difference decides whatever follows, so the least of prefixes is a prefix of the least.

Conversations are not gathered.  Rows are dealt by ranges of (conversation, turn, role, text)
and streamed; a conversation inside one partition is finished there.  The parts of one that
spans partitions yield, for each state they may start in, the cheapest audit for each state
they may end in; these small tables are chained per conversation, and each part's audit is
applied to its own rows.  Only the digest of the repaired text needs the rows in order; they
are streamed through it.

Defined cases: null role and text are one space; rows of a null conversation form one
conversation; null turns come first; rows of one turn are taken by role and text; equal rows
stay, as duplicates; a role's initial is its first character (an empty role has none), so any
role in u or a may be kept; a conversation without rows does not exist here - ``repair`` takes
the wanted ids as a second table, and gives those without rows zeros, an empty audit and the
digest of the empty string; an empty table gives an empty result; extra columns are left out.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stash, pick

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
OK, BLANK, DUPLICATE, CUT = 0, 1, 2, 3
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})     # states: nothing yet, after s, after u, after a
ENDS = (0, 3)
_MOD, _BASE = (1 << 61) - 1, 1_000_003


class Audits:
    """Audit strings as linked nodes; node 0 is the empty audit."""

    def __init__(self):
        self.letter, self.depth, self.hash, self.up = [""], [0], [0], [()]

    def add(self, node: int, letter: str) -> int:
        up, new = [node], len(self.letter)
        while len(self.up[up[-1]]) >= len(up):        # the 2^k-th ancestor's 2^k-th ancestor
            up.append(self.up[up[-1]][len(up) - 1])
        self.letter.append(letter)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * _BASE + ord(letter)) % _MOD)
        self.up.append(tuple(up))
        return new

    def ancestor(self, node: int, depth: int) -> int:
        while (gap := self.depth[node] - depth) > 0:
            node = self.up[node][gap.bit_length() - 1]
        return node

    def less(self, a: int, b: int) -> bool:
        """Is a's audit before b's?"""
        low = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, low), self.ancestor(b, low)
        if self.hash[x] == self.hash[y] and self._same(x, y):
            return self.depth[a] < self.depth[b]
        p, q = x, y
        if self.hash[x] != self.hash[y]:
            # Lift both to the first place where the audits differ: behind their longest common prefix.
            for k in range(len(self.up[p]) - 1, -1, -1):
                if k < len(self.up[p]) and self.hash[self.up[p][k]] != self.hash[self.up[q][k]]:
                    p, q = self.up[p][k], self.up[q][k]
            if self._same(self.up[p][0], self.up[q][0]):
                return self.letter[p] < self.letter[q]
        return self.text(x) < self.text(y)            # equal hashes of different audits

    def _same(self, x: int, y: int) -> bool:
        """Verify equal hashes: audits are equal when letters agree up to a shared node."""
        while x != y:
            if self.letter[x] != self.letter[y]:
                return False
            x, y = self.up[x][0], self.up[y][0]
        return True

    def text(self, node: int, stop: int = 0) -> str:
        out = []
        while node != stop:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))


def cheapest(rows: list[tuple[str, int]], start: int = 0) -> dict[int, tuple[int, str]]:
    """state -> (cost, audit) of the cheapest edits of (role initial, fault) rows, from state ``start``."""
    audits = Audits()
    here: dict[int, tuple[int, int]] = {start: (0, 0)}

    def offer(to: dict, state: int, cost: int, node: int, letter: str) -> None:
        old = to.get(state)
        if old is None or cost < old[0]:
            to[state] = (cost, audits.add(node, letter))
        elif cost == old[0]:
            new = audits.add(node, letter)
            if audits.less(new, old[1]):
                to[state] = (cost, new)

    def insert() -> None:
        for _ in range(2):                            # a third Insert in a row only comes back to a state
            for state, (cost, node) in sorted(here.items()):
                for initial, nxt in NEXT[state].items():
                    if initial != "s":
                        offer(here, nxt, cost + INSERT, node, "I")

    for initial, fault in rows:
        insert()
        then: dict[int, tuple[int, int]] = {}
        for state, (cost, node) in sorted(here.items()):
            offer(then, state, cost + DELETE, node, "D")
            if fault in (BLANK, DUPLICATE):
                continue
            paid = cost + (TRUNCATED if fault == CUT else 0)
            for role, nxt in NEXT[state].items():
                if initial == role:
                    offer(then, nxt, paid + KEEP, node, "K")
                elif role != "s":
                    offer(then, nxt, paid + REROLE, node, "R")
        here = then
    insert()
    return {s: (c, audits.text(n)) for s, (c, n) in here.items()}


def best_end(ends: dict[int, tuple[int, str]]) -> int:
    """The accepted end state of the cheapest, then ASCII-least audit."""
    return min((s for s in ENDS if s in ends), key=lambda s: ends[s])


def repaired(rows: Iterator[tuple[str, str]], audit: str, state: int = 0) -> Iterator[tuple[str, str]]:
    """The rows of the audit's result, from the (role, text) rows that it edits."""
    rows, names = iter(rows), {"u": "user", "a": "assistant"}
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter in "IR":
            initial = next(i for i in NEXT[state] if i != "s")
            role = names[initial]
        else:
            initial = role[:1]
        state = NEXT[state][initial]
        yield role, text


def faults(text: Column) -> Column:
    """BLANK, CUT or OK of a text."""
    bare = F.rtrim(text, F.lit("\x20\x09\x0a\x0b\x0c\x0d"))
    return (F.when(bare == "", BLANK).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(OK))


_RUN = ("part long, whole boolean, rows array<struct<role:string,text:string,copies:long,first:boolean,fault:int>>, "
        "n_rows long, low long, high long, turns long, turn_in long, turn_out long, blank long, duplicate long, truncated long, "
        "illegal long, role_in string, role_out string, "
        "ways array<struct<start:int,stop:int,cost:long,audit:string>>, repaired_sha256 string")


class _Part:
    """One conversation's consecutive rows within a partition."""

    def __init__(self, conv):
        self.conv, self.rows, self.turns, self.n = conv, [], [], 0

    def edits(self) -> list[tuple[str, int]]:
        out = []
        for r in self.rows:
            initial, fault = r["role"][:1], r["fault"]
            out.append((initial, fault if r["first"] or fault == BLANK else DUPLICATE))
            out.extend([(initial, BLANK if fault == BLANK else DUPLICATE)] * (r["copies"] - 1))
        return out

    def result(self, part: int, whole: bool) -> dict:
        edits = self.edits()
        found = [f for _, f in edits]
        initials = [i for i, _ in edits]
        known = [t for t in self.turns if t is not None]
        ways = [{"start": s, "stop": e, "cost": c, "audit": a} for s in ((0,) if whole else range(4))
                for e, (c, a) in sorted(cheapest(edits, s).items())]
        digest, rows = None, self.rows
        if whole:
            best = best_end({w["stop"]: (w["cost"], w["audit"]) for w in ways})
            ways = [w for w in ways if w["stop"] == best]
            digest, rows = _digest(repaired(expanded(self.rows), ways[0]["audit"])), []
        return {"conv": self.conv, "part": part, "whole": whole, "rows": rows, "n_rows": len(edits),
                "low": min(known, default=None), "high": max(known, default=None), "turns": len(set(known)),
                "turn_in": self.turns[0], "turn_out": self.turns[-1], "blank": found.count(BLANK),
                "duplicate": found.count(DUPLICATE), "truncated": found.count(CUT),
                "illegal": sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:])),
                "role_in": initials[0], "role_out": initials[-1], "ways": ways, "repaired_sha256": digest}


def expanded(rows) -> Iterator[tuple[str, str]]:
    for r in rows:
        for _ in range(r["copies"]):
            yield r["role"], r["text"]


def _digest(rows: Iterator[tuple[str, str]]) -> str:
    h, first = hashlib.sha256(), True
    for role, text in rows:
        h.update(f"{'' if first else chr(10)}{role}:{text}".encode())
        first = False
    return h.hexdigest()


def _parts(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Sorted rows to one record per conversation and partition; the first and last may go on in a neighbour."""
    part, now, first, out = TaskContext.get().partitionId(), None, True, []
    for b in batches:
        for r in b.to_pylist():
            if now is None or r["conv"] != now.conv:
                if now is not None:
                    out.append(now.result(part, whole=not first))
                    first = False
                now = _Part(r["conv"])
            now.rows.append({k: r[k] for k in ("role", "text", "copies", "first", "fault")})
            now.turns.append(r["turn"])
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
    if now is not None:
        out.append(now.result(part, whole=False))
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _before(a: list[str], b: list[str]) -> bool:
    """Is the joined text of ``a`` before that of ``b``?  Shared first pieces are passed over."""
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x is not y and x != y), min(len(a), len(b)))
    return "".join(a[i:]) < "".join(b[i:])


def chain(parts: list[dict]) -> tuple[int, list[str], list[int]]:
    """A conversation's parts in order -> (cost, the audit of each part, the start state of each part).

    The start-to-stop tables compose: costs add up, audits concatenate, the least is kept.
    """
    here: dict[int, tuple] = {0: (0, [], [])}

    def better(new: tuple, old: tuple | None) -> bool:
        return old is None or new[0] < old[0] or (new[0] == old[0] and _before(new[1], old[1]))

    for p in parts:
        then: dict[int, tuple] = {}
        for w in p["ways"]:
            if w["start"] in here:
                cost, said, starts = here[w["start"]]
                new = (cost + w["cost"], said + [w["audit"]], starts + [w["start"]])
                if better(new, then.get(w["stop"])):
                    then[w["stop"]] = new
        here = then
    best = None
    for state in ENDS:
        if state in here and better(here[state], best):
            best = here[state]
    return best


_COUNTS = "blank long, duplicate long, truncated long, illegal long, cost long"
_DONE = f"gaps long, {_COUNTS}, audit string, repaired_sha256 string"


def _join_parts(table: pa.Table) -> pa.Table:
    """All parts of one conversation, without their rows, to one row per part with the conversation's figures."""
    conv, rows = table.column("conv"), table.drop_columns(["conv"]).to_pylist()
    order = sorted(range(len(rows)), key=lambda i: rows[i]["part"])
    parts = [rows[i] for i in order]
    cost, said, starts = chain(parts)
    known = [p for p in parts if p["low"] is not None]
    turns = sum(p["turns"] for p in parts)
    pairs = list(zip(parts, parts[1:]))
    turns -= sum(x["turn_out"] is not None and x["turn_out"] == y["turn_in"] for x, y in pairs)
    gaps = max(p["high"] for p in known) - min(p["low"] for p in known) + 1 - turns if known else 0
    total = {k: sum(p[k] for p in parts) for k in ("blank", "duplicate", "truncated", "illegal")}
    total["illegal"] += sum(x["role_out"] + y["role_in"] not in ("su", "ua", "au") for x, y in pairs)
    n = len(parts)
    out = {"conv": conv.slice(0, 1).combine_chunks().take(pa.array([0] * n)), "part": pa.array([p["part"] for p in parts], pa.int64()),
           "start": pa.array(starts, pa.int32()), "said": pa.array(said, pa.string()), "last": pa.array([i == n - 1 for i in range(n)]),
           "gaps": pa.array([gaps] * n, pa.int64()), **{k: pa.array([v] * n, pa.int64()) for k, v in total.items()},
           "cost": pa.array([cost] * n, pa.int64()), "audit": pa.array([None] * (n - 1) + ["".join(said)], pa.string())}
    return pa.table(out)


def _digests(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Parts in order, with their audits, to one row per conversation; the text is only streamed through its digest."""
    h, first = hashlib.sha256(), True
    for b in batches:
        for i in range(b.num_rows):
            r = b.slice(i, 1).to_pylist()[0]
            for role, text in repaired(expanded(r["rows"]), r["said"], r["start"]):
                h.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
            if r["last"]:
                yield pa.RecordBatch.from_pylist([{k: r.get(k) for k in schema.names} | {"repaired_sha256": h.hexdigest()}], schema)
                h, first = hashlib.sha256(), True


def repair(rows: DataFrame, ids: DataFrame | None = None, conv_col="conv_id", turn_col="turn", role_col="role",
           text_col="text") -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row per conversation.

    gaps: missing turn numbers between the first and the last; illegal: neighbouring rows whose roles may not
    follow each other; the three faults count rows by their first fault.  ``ids`` (its ``conv_col``) names
    conversations that are wanted even if they have no rows.  Texts count as seen when 128-bit digests agree.
    """
    spark, stash = rows.sparkSession, Stash(rows.sparkSession, "repair")
    r = pick(rows, conv=conv_col, turn=turn_col, role=role_col, text=text_col)
    conv_type = r.schema["conv"].dataType.simpleString()
    r = r.select("conv", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                 F.coalesce("text", F.lit(" ")).alias("text"))
    r = r.withColumn("key", F.unhex(F.md5(F.concat("role", F.lit("\0"), "text").cast("binary"))))
    seen = (r.groupBy("conv", "key").agg(F.min(F.struct("turn")).alias("at"))      # null turns are the first
             .select("conv", F.col("at.turn").alias("turn"), F.lit(None).cast("string").alias("role"),
                     F.lit(None).cast("string").alias("text"), "key", F.lit(0).alias("n"), F.lit(True).alias("mark")))
    r = r.withColumns({"n": F.lit(1), "mark": F.lit(False)}).unionByName(seen)
    r = (r.groupBy("conv", "turn", "key").agg(F.max("role").alias("role"), F.max("text").alias("text"),
                                              F.sum("n").alias("copies"), F.max("mark").alias("first"))
          .withColumn("fault", faults(F.col("text"))))
    r = (r.repartitionByRange("conv", "turn", "role", F.left("text", F.lit(64)))
          .sortWithinPartitions("conv", "turn", "role", "text").drop("key"))
    schema = f"conv {conv_type}, {_RUN}"
    arrow = _arrow_schema(spark, schema)
    parts = stash.put(r.mapInArrow(lambda b: _parts(b, arrow), schema), "parts")
    way = F.col("ways")[0]
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    inside = parts.filter("whole").select("conv", gaps, "blank", "duplicate", "truncated", "illegal", way["cost"].alias("cost"),
                                          way["audit"].alias("audit"), "repaired_sha256")
    split = parts.filter("NOT whole")
    plan = (split.drop("rows", "whole", "repaired_sha256").groupBy("conv")
                 .applyInArrow(_join_parts, f"conv {conv_type}, part long, start int, said string, last boolean, "
                                            f"gaps long, {_COUNTS}, audit string"))
    texts = split.select(F.col("conv").alias("_conv"), F.col("part").alias("_part"), "rows")
    joined = (plan.join(texts, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")))
                  .repartition("conv").sortWithinPartitions("conv", "part"))
    done = f"conv {conv_type}, {_DONE}"
    done_arrow = _arrow_schema(spark, done)
    across = joined.drop("_conv", "_part").mapInArrow(lambda b: _digests(b, done_arrow), done)
    out = inside.unionByName(across)
    if ids is not None:
        want = ids.select(F.col(conv_col).alias("want")).distinct()
        out = want.join(out, F.col("want").eqNullSafe(F.col("conv")), "left").drop("conv").withColumnRenamed("want", "conv")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("conv").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def _arrow_schema(spark, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def damage(rows: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """The query's damaged conversations: by crc32(``conv_id:turn``) % 20, 0 drops a row, 1 empties its text,
    2 takes out ``[.!?]``, 3 repeats it, 4 makes its role user; nulls are one space."""
    r = pick(rows, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    blank = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"),
                            F.coalesce(F.col("turn").cast("string"), blank)).cast("binary")) % 20
    r = r.withColumn("kind", kind).filter("kind <> 0")
    text = (F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(F.coalesce("text", blank), "[.!?]", ""))
             .otherwise(F.coalesce("text", blank)))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.coalesce("role", blank))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return r.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")
