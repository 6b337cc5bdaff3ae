"""Repair of conversation structure: the cheapest edits that give system?, then user and assistant in turn.

A Viterbi search over four states (nothing said yet, system, user, assistant) keeps one survivor a state in a tree of
backpointers with reference counts. As soon as all survivors share an ancestor, the edits up to it are final and leave the tree;
survivors that tie are told apart by their complete unresolved suffixes. A survivor that costs more than any other could ever
owe it is dropped, so survivors do coalesce.

Rows are sorted over all tasks by conversation and turn and searched in blocks of one Arrow batch, so no conversation has to fit
one task: a block gives the cost from every state to every state for the conversations that it cuts, these compose to the whole
conversation's choice, and only the blocks' own audits are put together. Equal rows of one turn travel as one row with a count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, stage, tidy

SPACE = " \t\n\x0b\x0c\r"
#: States: nothing said yet, system, user, assistant; and which pairs of role initials may follow each other.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
LEGAL = {"su", "ua", "au"}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Inserts that end a conversation in each state.
TAIL = {NOTHING: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
#: Whatever follows costs state x at most OWES[x][y] more than state y: x does y's edits, but inserts what y has said already,
#: deletes a system row that only y may keep, or inserts the turns that let it end.
OWES = ((0, 0, 3, 0), (6, 0, 3, 6), (7, 3, 0, 3), (4, 0, 3, 0))


class _Node:
    """One edit in the tree of backpointers; ``refs`` counts its children, and one more if it is a survivor's last edit."""
    __slots__ = ("parent", "edits", "refs", "depth")

    def __init__(self, parent: _Node | None, edits: str, depth: int):
        self.parent, self.edits, self.refs, self.depth = parent, edits, 1, depth
        if parent is not None:
            parent.refs += 1


def _suffixes(a: _Node, b: _Node) -> tuple[str, str]:
    """The edits of two survivors after their last common one."""
    left, right = [], []
    while a is not b:
        if a.depth >= b.depth:
            left.append(a.edits)
            a = a.parent
        else:
            right.append(b.edits)
            b = b.parent
    return "".join(reversed(left)), "".join(reversed(right))


class Survivors:
    """The search from one state; ``push`` takes a row, ``paths`` gives the best way to each state still held."""

    def __init__(self, start: int):
        self.root = _Node(None, "", 0)
        self.held: dict[int, tuple[int, _Node]] = {start: (0, self.root)}
        self.sure: list[str] = []
        self.depth = 0

    def push(self, initial: str, truncated: bool, must_go: bool, more: int) -> None:
        """A row with the initial of its role, and ``more`` copies of it, which have to go."""
        if must_go:
            self._step([(s, s, "D" * (more + 1), DELETE * (more + 1)) for s in self.held])
            return
        extra = TRUNCATED if truncated else 0
        ways = []
        for s in self.held:
            ways.append((s, s, "D", DELETE))
            for said, to in (("u", USER), ("a", ASSISTANT)):
                before = (s == USER) == (to == USER)  # the turn between is missing
                ways.append((s, to, "I" * before + ("K" if initial == said else "R"),
                             INSERT * before + (0 if initial == said else REROLE) + extra))
            if initial == "s" and s == NOTHING:
                ways.append((s, SYSTEM, "K", extra))
        self._step(ways)
        if more:
            self._step([(s, s, "D" * more, DELETE * more) for s in self.held])

    def _step(self, ways: list[tuple[int, int, str, int]]) -> None:
        best: dict[int, tuple[int, int, str]] = {}
        for s, to, edits, price in ways:
            cost = self.held[s][0] + price
            if to in best:
                have, from_, other = best[to]
                if cost > have:
                    continue
                if cost == have:
                    a, b = _suffixes(self.held[s][1], self.held[from_][1])
                    if a + edits >= b + other:
                        continue
            best[to] = (cost, s, edits)
        for to in [y for y in best if any(best[x][0] + OWES[x][y] < best[y][0] for x in best)]:
            del best[to]
        self.depth += 1
        old = [n for _, n in self.held.values()]
        self.held = {to: (cost, _Node(self.held[s][1], edits, self.depth)) for to, (cost, s, edits) in best.items()}
        for n in old:
            n.refs -= 1
            while not n.refs:
                n = n.parent
                n.refs -= 1
        if self.root.refs == 1:
            self._settle()

    def _settle(self) -> None:
        """Let go of the edits that all survivors share."""
        n, chain = next(iter(self.held.values()))[1], []
        ends = {id(x) for _, x in self.held.values()}
        while n is not self.root:
            chain.append(n)
            n = n.parent
        while chain and self.root.refs == 1 and id(self.root) not in ends:
            self.root = chain.pop()
            self.sure.append(self.root.edits)
            self.root.parent = None

    def paths(self) -> dict[int, tuple[int, str]]:
        sure = "".join(self.sure)
        out = {}
        for state, (cost, n) in self.held.items():
            rest = []
            while n is not self.root:
                rest.append(n.edits)
                n = n.parent
            out[state] = (cost, sure + "".join(reversed(rest)))
        return out


def render(lines: list[dict], audit: str, state: int) -> Iterator[tuple[str, str, str]]:
    """(role, text, edit) of the turns that an audit leaves, from rows of role, text and number of copies."""
    rows = (r for r in lines for _ in range(r["n"]))
    for edit in audit:
        if edit == "D":
            next(rows)
            continue
        role = "assistant" if state == USER else "user"
        text = ""
        if edit != "I":
            row = next(rows)
            text = row["text"]
            if edit == "K":
                role = row["role"]
        state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[:1]]
        yield role, text, edit


class _Hash:
    """SHA-256 of lines joined by a newline, line by line."""

    def __init__(self):
        self.sha, self.any = hashlib.sha256(), False

    def add(self, lines: Iterator[tuple[str, str, str]]) -> None:
        for role, text, _ in lines:
            self.sha.update((("\n" if self.any else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            self.any = True


_KEY = ["conv_null", "conv0"]
_ORDER = [*_KEY, "present", "turned", "turn0", "role", "fp"]
_COUNTS = ["blank", "duplicate", "truncated", "illegal"]
_LINE = pa.struct([("role", pa.string()), ("text", pa.string()), ("n", pa.int64())])
_PATH = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
_REPORT = [("gaps", pa.int64()), *((c, pa.int64()) for c in _COUNTS), ("cost", pa.int64()), ("audit", pa.string()),
           ("repaired_sha256", pa.string())]
_REPORT_DDL = ", ".join(["gaps long", *(f"{c} long" for c in _COUNTS), "cost long", "audit string", "repaired_sha256 string"])
_PART = pa.schema([("conv_null", pa.bool_()), ("conv0", pa.int64()), ("part", pa.int64()), ("whole", pa.bool_()), *_REPORT,
                   ("first", pa.string()), ("last", pa.string()), ("low", pa.int64()), ("high", pa.int64()),
                   ("turns", pa.int64()), ("paths", pa.list_(_PATH)), ("lines", pa.list_(_LINE))])
_PART_DDL = (f"conv_null boolean, conv0 long, part long, whole boolean, {_REPORT_DDL}, first string, last string, low long, "
             "high long, turns long, paths array<struct<start:int,end:int,cost:long,audit:string>>, "
             "lines array<struct<role:string,text:string,n:long>>")


def _run(rows: list[dict], whole: bool, may_continue: bool, keep_lines: bool) -> dict:
    """One conversation's rows in a block: what they count for, and the best way from each possible start to each end.

    ``whole``: the conversation lies in the block. ``may_continue``: it may have begun in the block before.
    """
    rows = [r for r in rows if r["present"]]
    out = dict.fromkeys(_COUNTS, 0) | {"first": None, "last": None, "low": None, "high": None, "turns": 0}
    searches = {s: Survivors(s) for s in (range(4) if may_continue else (NOTHING,))}
    last = None
    for r in rows:
        initial, text, n = r["role"][:1], r["text"].rstrip(SPACE), r["n"]
        blank = not text
        truncated = not blank and not r["again"] and text[-1] not in ".!?"
        out["blank"] += n * blank
        out["truncated"] += truncated
        out["duplicate"] += 0 if blank else n if r["again"] else n - 1
        out["illegal"] += n - 1 + (last is not None and last + initial not in LEGAL)
        if last is None:
            out["first"] = initial
        last = initial
        if r["turned"]:
            out["turns"] += r["turn0"] != out["high"]
            out["low"] = r["turn0"] if out["low"] is None else out["low"]
            out["high"] = r["turn0"]
        for s in searches.values():
            s.push(initial, truncated, blank or r["again"], n - 1)
    out["last"] = last
    lines = [{"role": r["role"], "text": r["text"], "n": r["n"]} for r in rows]
    if not whole:
        paths = [{"start": s, "end": e, "cost": cost, "audit": audit} for s, search in searches.items()
                 for e, (cost, audit) in search.paths().items()]
        return out | {"paths": sorted(paths, key=lambda p: (p["start"], p["audit"])), "lines": lines}
    cost, audit = min((cost + INSERT * TAIL[e], audit + "I" * TAIL[e])
                      for e, (cost, audit) in searches[NOTHING].paths().items())
    sha = _Hash()
    sha.add(render(lines, audit, NOTHING))
    gaps = out["high"] - out["low"] + 1 - out["turns"] if out["turns"] else 0
    return out | {"gaps": gaps, "cost": cost, "audit": audit, "repaired_sha256": sha.sha.hexdigest(),
                  "lines": lines if keep_lines else None}


def _parts(rows: DataFrame, keep_lines: bool) -> DataFrame:
    """A row per conversation and block; blocks are numbered in the order of the rows."""
    def plain(name: str, c: Column) -> list[Column]:
        return [c.isNull().alias(f"{name}_null"), F.coalesce(c.cast("long"), F.lit(0).cast("long")).alias(f"{name}0")]

    here = F.coalesce(F.col("present"), F.lit(False))
    filled = rows.select(*plain("conv", F.col("conv_id")), here.alias("present"),
                         (here & F.col("turn").isNotNull()).alias("turned"),
                         F.when(here, F.col("turn").cast("long")).alias("turn"),
                         *(F.when(here, F.coalesce(F.col(c).cast("string"), F.lit(" "))).otherwise("").alias(c)
                           for c in ("role", "text")))
    filled = (filled.withColumn("turn0", F.coalesce("turn", F.lit(0).cast("long")))
              .withColumn("fp", F.unhex(F.sha2("text", 256))))
    lines = filled.groupBy(*_ORDER).agg(F.count("*").alias("n"), F.first("text").alias("text"))
    said = (lines.where("present").groupBy(*_KEY, "present", "role", "fp")
            .agg(F.min(F.struct("turned", "turn0")).alias("at"))
            .select(*_KEY, "present", F.col("at.turned").alias("turned"), F.col("at.turn0").alias("turn0"), "role", "fp",
                    F.lit(True).alias("new")))
    marked = (lines.join(said, _ORDER, "left").withColumn("again", F.col("new").isNull() & F.col("present"))
              .repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
              .select(*_KEY, "present", "turned", "turn0", "role", "text", "n", "again"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        for batch in batches:
            if not batch.num_rows:
                continue
            part += 1
            runs: list[tuple[tuple, list[dict]]] = []
            for r in batch.to_pylist():
                key = (r["conv_null"], r["conv0"])
                if not runs or runs[-1][0] != key:
                    runs.append((key, []))
                runs[-1][1].append(r)
            made = []
            for i, (key, held) in enumerate(runs):
                inside = 0 < i < len(runs) - 1
                made.append({"conv_null": key[0], "conv0": key[1], "part": part, "whole": inside}
                            | _run(held, inside, i == 0, keep_lines))
            yield pa.RecordBatch.from_pylist(made, schema=_PART)
    bounded_batches(rows.sparkSession)
    return stage(marked.mapInArrow(tidy(run), _PART_DDL), "conversation-parts")


_CHOICE_DDL = ("conv_null boolean, conv0 long, part long, start int, end int, tail int, total_gaps long, "
               + ", ".join(f"total_{c} long" for c in [*_COUNTS, "cost"]))


def _choose(parts: pd.DataFrame) -> pd.DataFrame:
    """The state before and after each block of one conversation, on its cheapest, ASCII-least audit."""
    parts = parts.sort_values("part")
    ways = [[(int(p["start"]), int(p["end"]), int(p["cost"])) for p in x] for x in parts["ways"]]
    ahead = [{s: INSERT * n for s, n in TAIL.items()}]
    for way in reversed(ways):  # what the rest costs at least from each state
        back: dict[int, int] = {}
        for s, e, cost in way:
            if e in ahead[-1]:
                back[s] = min(back.get(s, cost + ahead[-1][e]), cost + ahead[-1][e])
        ahead.append(back)
    ahead.reverse()
    state, starts, ends = NOTHING, [], []
    for k, way in enumerate(ways):
        # ways from one state stand in the order of their audits; these all have the block's rows, so none begins another
        starts.append(state)
        state = next(e for s, e, cost in way if s == state and cost + ahead[k + 1].get(e, 1 << 62) == ahead[k][state])
        ends.append(state)
    totals = {c: int(parts[c].sum()) for c in _COUNTS}
    last, high, low, turns = None, None, None, 0
    for first, end, lo, hi, n in zip(*(parts[c] for c in ("first", "last", "low", "high", "turns")), strict=True):
        if isinstance(first, str):
            totals["illegal"] += last is not None and last + first not in LEGAL
            last = end
        if n:
            turns += int(n) - (high == lo)
            low, high = int(lo) if low is None else low, int(hi)
    gaps = high - low + 1 - turns if turns else 0
    out = parts[[*_KEY, "part"]].assign(start=starts, end=ends, tail=0, total_gaps=gaps, total_cost=ahead[0][NOTHING],
                                        **{f"total_{c}": v for c, v in totals.items()})
    out.iloc[-1, out.columns.get_loc("tail")] = TAIL[state]
    return out


def _picked(parts: DataFrame) -> DataFrame:
    """Blocks of conversations that blocks cut, with the chosen path's audit and the conversation's totals."""
    cut = parts.where(~F.col("whole"))
    ways = F.transform("paths", lambda p: F.struct(p.start.alias("start"), p.end.alias("end"), p.cost.alias("cost")))
    small = cut.select(*_KEY, "part", *_COUNTS, "first", "last",
                       *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("low", "high")), "turns", ways.alias("ways"))
    chosen = small.groupBy(*_KEY).applyInPandas(_choose, _CHOICE_DDL)
    path = F.filter("paths", lambda p: (p.start == F.col("start")) & (p.end == F.col("end")))[0]
    return (cut.select(*_KEY, "part", "paths", "lines").join(chosen, [*_KEY, "part"])
            .withColumn("audit", F.concat(path.audit, F.repeat(F.lit("I"), F.col("tail")))).drop("paths"))


def _conv_id() -> Column:
    return F.when(~F.col("conv_null"), F.col("conv0")).alias("conv_id")


def repair(rows: DataFrame) -> DataFrame:
    """A row per conversation of ``rows`` (conv_id, turn, role, text, present): conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256.

    Rows count in the order of turn (null first), then role, then the SHA-256 of the text; rows equal in all of these are one
    row and its copies. A row's first fault counts: blank, duplicate (role and text seen before in the conversation), truncated.
    Edits are Keep 0, Rerole to user or assistant 3, Delete 4 (required for blank and duplicate), Insert of an empty user or
    assistant turn 3, and a truncated row that stays adds 3; the audit spells the cheapest ones whose role initials read
    ``(s?(ua)+)?``, of ties the ASCII-least. repaired_sha256 hashes the lines ``role:text`` that are left.

    A row whose ``present`` is not true counts for nothing but keeps its conversation in the result; a conversation without any
    other rows has zeros, an empty audit and the hash of nothing. A null conv_id is a conversation of its own; null role or text
    is one space, and an empty role has no initial, so it is never kept. An empty table gives no rows; other columns are left
    behind. One conversation's hash is sequential by nature: it is computed in one task, block by block.
    """
    parts = _parts(rows, keep_lines=False)
    whole = parts.where("whole").select(_conv_id(), *(n for n, _ in _REPORT))
    names = ["conv_null", "conv0", *(n for n, _ in _REPORT)]
    schema = pa.schema([("conv_null", pa.bool_()), ("conv0", pa.int64()), *_REPORT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, audits, totals = None, _Hash(), [], {}

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(names, key, strict=False)) | totals
                                               | {"audit": "".join(audits), "repaired_sha256": sha.sha.hexdigest()}], schema=schema)
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if key != (at := (r["conv_null"], r["conv0"])):
                    if key is not None:
                        yield row()
                    key, sha, audits = at, _Hash(), []
                    totals = {c: r[f"total_{c}"] for c in ["gaps", *_COUNTS, "cost"]}
                audits.append(r["audit"])
                sha.add(render(r["lines"], r["audit"], r["start"]))
        if key is not None:
            yield row()
    cut = (_picked(parts).repartition(*_KEY).sortWithinPartitions(*_KEY, "part")
           .mapInArrow(tidy(run), f"conv_null boolean, conv0 long, {_REPORT_DDL}").select(_conv_id(), *(n for n, _ in _REPORT)))
    return whole.union(cut)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The turns that :func:`repair` leaves: conv_id, block and place (which order a conversation's turns), role, text, edit."""
    parts = _parts(rows, keep_lines=True)
    cols = [*_KEY, "part", "lines", "audit", "start"]
    todo = parts.where("whole").withColumn("start", F.lit(NOTHING)).select(*cols).union(_picked(parts).select(*cols))
    schema = pa.schema([("conv_null", pa.bool_()), ("conv0", pa.int64()), ("block", pa.int64()), ("place", pa.int64()),
                        ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield pa.RecordBatch.from_pylist(
                    [{"conv_null": r["conv_null"], "conv0": r["conv0"], "block": r["part"], "place": i, "role": role,
                      "text": text, "edit": edit}
                     for i, (role, text, edit) in enumerate(render(r["lines"], r["audit"], r["start"]))], schema=schema)
    return (todo.mapInArrow(tidy(run), "conv_null boolean, conv0 long, block long, place long, role string, text string, edit string")
            .select(_conv_id(), "block", "place", "role", "text", "edit"))


def damage(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text; null: one space) with planted faults, by crc32 of ``conv_id:turn`` modulo 20: 0 the
    row goes (``present`` is false), 1 its text is emptied, 2 loses its ``.!?``, 3 the row is repeated, 4 its role is user."""
    def filled(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn"))) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(filled("text"), ".!?", "")).otherwise(filled("text"))
    copies = F.when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(filled("role")).alias("role"), text.alias("text"),
                       (fault != 0).alias("present"), F.explode(copies).alias("copy")).drop("copy")
