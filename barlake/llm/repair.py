"""Repair of conversation structure by a suffix-shared automaton of role and fault signatures.

A repaired conversation has role initials `(s?(ua)+)?`. Each row is kept (K, free), given the role that the grammar wants (R, 1), or deleted
(D, 2; blank rows and repeats must be), and a row without text may be inserted anywhere (I, 5); a truncated row that stays costs 5
more. The cheapest edits are taken, and of those as cheap the string of initials that comes first in ASCII order.

1. Rows get their place in one global order, by range, so that a conversation of any length is spread over tasks. A row's signature
   is a letter: b blank, d repeat, else its role's initial (o for another), in capitals if truncated.
2. The letters of BLOCK consecutive rows of a conversation are a word. Equal words are one, and words are sorted from their
   ends, so that words with a common ending follow one another: a task walks them and makes each ending, a node of the automaton, once,
   for all conversations that end so. A node holds for each of the grammar's four states the cost to the end, the best audit and the
   state that it ends in, from those of the node after it. At equal cost the first letter decides, as the rest is the best of its node.
3. A conversation of several words is cut at costs: a word's matrix (cost from each state to each) is the same automaton with another
   end, and folding a conversation's matrices from its end gives each word's end costs; another fold gives the states that words begin in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barlake.llm.prefix import running_totals
from barlake.llm.store import materialize

BLOCK = 1024
RETYPE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Solved words up to this size are joined by broadcast.
BROADCAST_BYTES = 32 << 20

# Grammar states: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. Role that may follow, and the state after it.
WANTED = ("user", "user", "assistant", "user")
AFTER_WANTED = (2, 2, 3, 2)
AFTER_KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
FAR = 1 << 40
#: Costs after the last row: what must still be inserted.
FINAL = [0, 2 * INSERT, INSERT, 0]
FINAL_AUDITS = ["", "II", "I", ""]
FAULTS = {"b": "blank", "d": "duplicate"}


def node(letter: str, after: tuple[list, list, list]) -> tuple[list, list, list]:
    """(costs, audits, end states) by state before a row of this letter, from those after it."""
    costs, audits, ends = after
    kind, late = letter.lower(), TRUNCATED if letter.isupper() else 0
    must_go = letter in FAULTS
    best = []
    for s in range(4):
        ways = [(DELETE + costs[s], "D", s)]
        if not must_go:
            kept = AFTER_KEPT.get(kind, (None,) * 4)[s]
            if kept is not None:
                ways.append((late + costs[kept], "K", kept))
            ways.append((RETYPE + late + costs[AFTER_WANTED[s]], "R", AFTER_WANTED[s]))
        cost, edit, to = min(ways)
        best.append((cost, edit + audits[to], ends[to]))
    # insertions before the row: of one or two rows, as the third would be the first again
    for _ in range(2):
        best = [min(best[s], (INSERT + best[AFTER_WANTED[s]][0], "I" + best[AFTER_WANTED[s]][1], best[AFTER_WANTED[s]][2])) for s in range(4)]
    return [b[0] for b in best], [b[1] for b in best], [b[2] for b in best]


def end_node(costs: list[int]) -> tuple[list, list, list]:
    return costs, FINAL_AUDITS if costs == FINAL else [""] * 4, [0, 1, 2, 3]


_TERMINAL = T.ArrayType(T.LongType())
SOLVED = T.StructType([T.StructField("key", T.StringType()), T.StructField("terminal", _TERMINAL), T.StructField("costs", _TERMINAL), T.StructField("audits", T.ArrayType(T.StringType())), T.StructField("ends", _TERMINAL)])


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their end costs, sorted by those and from the words' ends: the path of the word before is kept as far as it is shared."""
    last, ending, path = None, "", []
    for batch in batches:
        out: list[tuple] = []
        for key, terminal in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            backwards = key[::-1]
            if terminal != last:
                last, ending, path = terminal, "", [end_node(terminal)]
            shared = 0
            for x, y in zip(ending, backwards, strict=False):
                if x != y:
                    break
                shared += 1
            del path[shared + 1 :]
            for letter in backwards[shared:]:
                path.append(node(letter, path[-1]))
            ending = backwards
            out.append((key, terminal, *path[-1]))
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64())), strict=True)], names=SOLVED.names)


def solved(words: DataFrame) -> DataFrame:
    """Costs, audits and end states by first state of the distinct (key, terminal) of words."""
    distinct = words.select("key", "terminal").distinct().withColumn("backwards", F.reverse("key"))
    dealt = distinct.repartitionByRange("terminal", "backwards").sortWithinPartitions("terminal", "backwards")
    return materialize(dealt.select("key", "terminal").mapInArrow(_solve, SOLVED), "solved")


def _longs(values: list[int]) -> Column:
    return F.array(*(F.lit(v).cast("long") for v in values))


def _end_costs(table: pa.Table) -> pa.Table:
    """Of one conversation's words (chunk, matrix): each word's costs at its end, less the least of them."""
    table = table.sort_by("chunk")
    after, out = FINAL, []
    for matrix in reversed(table.column("matrix").to_pylist()):
        out.append([x - min(after) for x in after] if after != FINAL else FINAL)
        after = [min(min(matrix[4 * t + s] + after[t] for t in range(4)), FAR) for s in range(4)]
    return pa.table({"chunk": table.column("chunk"), "terminal": pa.array(out[::-1], pa.list_(pa.int64()))})


def _begin_states(table: pa.Table) -> pa.Table:
    table = table.sort_by("chunk")
    state, out = 0, []
    for ends in table.column("ends").to_pylist():
        out.append(state)
        state = ends[state]
    return pa.table({"chunk": table.column("chunk"), "state": pa.array(out, pa.int64())})


def _with_solution(words: DataFrame) -> DataFrame:
    answers = solved(words)
    size = answers.agg(F.sum(F.length("key") * 5 + 200)).first()[0] or 0
    return words.join(F.broadcast(answers) if size <= BROADCAST_BYTES else answers, ["key", "terminal"])


def _audited(chunks: DataFrame) -> DataFrame:
    """(chunk, word, state, audit) of words (conv_id, chunk, word): the state that each begins in and its best audit."""
    order = Window.partitionBy("conv_id").orderBy("chunk")  # a row a word, not a row a row
    placed = chunks.withColumn("key", F.translate("word", "d", "b")).withColumn("first", F.lag("chunk").over(order).isNull()).withColumn("final", F.lead("chunk").over(order).isNull())
    placed = materialize(placed, "words")
    whole = placed.where("first AND final").withColumn("terminal", _longs(FINAL))
    parts = placed.where("NOT (first AND final)")
    if parts.limit(1).count():
        units = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), _longs([0 if s == t else FAR for s in range(4)]).alias("terminal")) for t in range(4)))).alias("unit")
        costs = _with_solution(parts.select("conv_id", "chunk", "key", units).select("conv_id", "chunk", "key", "unit.*"))
        matrix = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("t", "costs"))), lambda x: x["costs"])).alias("matrix")
        terminals = costs.groupBy("conv_id", "chunk").agg(matrix).groupBy("conv_id").applyInArrow(_end_costs, T.StructType([T.StructField("chunk", T.LongType()), T.StructField("terminal", _TERMINAL)]))
        answered = materialize(_with_solution(parts.join(terminals, "chunk")), "parts")
        states = answered.select("conv_id", "chunk", "ends").groupBy("conv_id").applyInArrow(_begin_states, T.StructType([T.StructField("chunk", T.LongType()), T.StructField("state", T.LongType())]))
        several = answered.join(states, "chunk")
    else:
        several = None
    one = _with_solution(whole).withColumn("state", F.lit(0).cast("long"))
    every = one if several is None else one.unionByName(several.select(one.columns))
    return every.select("chunk", "word", "state", "final", F.get("audits", F.col("state").cast("int")).alias("audit"))


PLAN = T.StructType([T.StructField("row_index", T.LongType()), T.StructField("fault", T.StringType()), T.StructField("edit", T.StringType()), T.StructField("new_role", T.StringType()), T.StructField("before", T.ArrayType(T.StringType())), T.StructField("after", T.ArrayType(T.StringType()))])


def _planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words (chunk, word, state, audit) to one row a row: its fault, edit and new role, and roles to insert before and after it."""
    for batch in batches:
        out: list[list] = []
        for chunk, word, state, audit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            place, waiting = 0, []
            for edit in audit:
                if edit == "I":
                    waiting.append(WANTED[state])
                    state = AFTER_WANTED[state]
                    continue
                letter = word[place]
                fault = FAULTS.get(letter) or ("truncated" if letter.isupper() else None)
                role = WANTED[state] if edit == "R" else None
                state = state if edit == "D" else AFTER_WANTED[state] if edit == "R" else AFTER_KEPT[letter.lower()][state]
                out.append([chunk + place, fault, edit, role, waiting, []])
                place, waiting = place + 1, []
            if waiting:
                out[-1][5] = waiting
            if len(out) >= 50_000:
                yield _plan_batch(out)
                out = []
        yield _plan_batch(out)


def _plan_batch(rows: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()))
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=PLAN.names)


def blank(text: Column) -> Column:
    return ~text.rlike(r"[^\x20\x09-\x0D]")


def truncated(text: Column) -> Column:
    return ~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")


def edited(conversations: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per row: conv_id, turn, role, text, `row_index` (place in the order of all rows), `fault` (blank, duplicate, truncated or null), `edit`
    (K, R or D), `new_role` (of R), and the roles inserted `before` it and, for a conversation's last row, `after` it.

    A conversation's rows stand by turn, nulls first, and rows of one turn by role and a digest of the text. A null role or text is one
    space, so a null text is blank; a null conversation is one of its own; a role counts by its first character, and an empty one
    fits nowhere. Of equal rows the first is kept and others are duplicates. An empty table gives no rows. Other columns aren't read,
    whatever their names."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(" "))
    slim = conversations.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"), text.alias("text"), F.sha2(text.cast("binary"), 256).alias("digest"), F.monotonically_increasing_id().alias("tag"))
    ordered = running_totals(slim, ["conv_id", "turn", "role", "digest", "tag"], [])
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("o")
    facts = ordered.select("row_index", "conv_id", "role", "digest", initial.alias("initial"), blank(F.col("text")).alias("blank"), truncated(F.col("text")).alias("truncated"))
    facts = materialize(facts, "facts")
    firsts = facts.where("NOT blank").groupBy("conv_id", "role", "digest").agg(F.min("row_index").alias("first_index"))
    letter = F.when(F.col("blank"), "b").when(F.col("first_index").isNull(), "d").when(F.col("truncated"), F.upper("initial")).otherwise(F.col("initial"))
    lettered = facts.join(firsts.select("first_index"), F.col("row_index") == F.col("first_index"), "left").select("conv_id", "row_index", letter.alias("letter"))
    word = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_index", "letter"))), lambda x: x["letter"]), "").alias("word")
    chunks = lettered.groupBy("conv_id", F.floor(F.col("row_index") / block).alias("block")).agg(F.min("row_index").alias("chunk"), word).drop("block")  # at most `block` rows a group
    plan = materialize(_audited(chunks).select("chunk", "word", "state", "audit").mapInArrow(_planned, PLAN), "plan")
    return ordered.drop("digest", "tag", "part").join(plan, "row_index")


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired conversations of `edited` rows: conv_id, row_index and `place` (their order), turn, role, text, edit; inserted rows have no turn and
    an empty text."""
    own = F.array(F.struct(F.coalesce("new_role", "role").alias("role"), F.col("text"), F.col("turn"), F.col("edit")))
    added = lambda c: F.transform(c, lambda r: F.struct(r.alias("role"), F.lit("").alias("text"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("I").alias("edit")))
    each = rows.select("conv_id", "row_index", F.posexplode(F.concat(added("before"), own, added("after"))).alias("place", "e"))
    return each.select("conv_id", "row_index", "place", "e.turn", "e.role", "e.text", "e.edit").where("edit <> 'D'")


def reported(rows: DataFrame) -> DataFrame:
    """One row per conversation of `edited` rows: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A conversation's rows go through one task one after another, as a digest of all its text needs; nothing is held of them but counters,
    the digest and the audit."""
    schema = T.StructType([rows.schema["conv_id"], *(T.StructField(n, T.LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Report | None = None
        for batch in batches:
            done = []
            for conv, turn, role, text, fault, edit, new_role, before, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or conv != now.conv:
                    done += [now.row()] if now else []
                    now = Report(conv)
                now.add(turn, role, text, fault, edit, new_role, before, after)
            yield _rows(done, batch.schema.field(0).type)
        if now:
            yield _rows([now.row()], batch.schema.field(0).type)

    def _rows(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        columns = list(zip(*done, strict=True)) if done else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=schema.names)

    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "row_index")
    return dealt.select("conv_id", "turn", "role", "text", "fault", "edit", "new_role", "before", "after").mapInArrow(run, schema)


class Report:
    """What is counted of one conversation while its rows go by."""

    def __init__(self, conv: object) -> None:
        self.conv, self.turns, self.first, self.last = conv, 0, None, None
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.initial, self.illegal, self.cost, self.audit, self.kept, self.digest = None, 0, 0, [], 0, hashlib.sha256()

    def _keep(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.kept else "") + role + ":" + text).encode())
        self.kept += 1

    def add(self, turn: int | None, role: str, text: str, fault: str | None, edit: str, new_role: str | None, before: list[str], after: list[str]) -> None:
        if turn is not None:
            self.turns += self.first is None or turn != self.last
            self.first, self.last = turn if self.first is None else self.first, turn
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in ("su", "ua", "au")
        self.initial = role[:1]
        if fault:
            self.faults[fault] += 1
        for name in before:
            self._keep(name, "")
        if edit != "D":
            self._keep(new_role or role, text)
        for name in after:
            self._keep(name, "")
        self.audit.append("I" * len(before) + edit + "I" * len(after))
        self.cost += INSERT * (len(before) + len(after)) + {"K": 0, "R": RETYPE, "D": DELETE}[edit] + (TRUNCATED if fault == "truncated" and edit != "D" else 0)

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return self.conv, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest()
