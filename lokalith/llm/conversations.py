"""Repair of conversation structure by weighted finite-state composition.

Three machines. The input acceptor spells the rows of a conversation in order. The edit transducer keeps a row (K, cost 0),
gives it the role user or assistant (R, 1), deletes it (D, 2; the only edit of a blank or repeated row) or inserts an
empty message between rows (I, 5); a truncated row that is not deleted costs 5 more. The role grammar accepts the
initials ``(s?(ua)+)?``. Their composition is built lazily, state by state, and its shortest path is found in reverse
topological order over weights (cost, label string): the cheapest, of equal ones the ASCII-least string of edits. Strings
are compared from the front and grow at the front, so that order is kept by every extension.

Rows are range-sorted by conversation and place, so a conversation of any size is spread over tasks, and cut into
fragments of bounded size. Each fragment is reduced to the weights between the four states of the grammar; these
products are associative, so the weights of a conversation are those of its fragments multiplied in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lokalith.llm.shared import lookup, materialise

#: Costs of the edits, the most of all being what an undeleted truncated row adds.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Grammar ``(s?(ua)+)?`` as a machine: start, after a system, after a user, after an assistant message.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ACCEPTED = (START, ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}
#: Rows and characters of a fragment at most; one row may be longer.
FRAGMENT_ROWS, FRAGMENT_CHARS = 512, 4 << 20

_NOT_BLANK, _LAST = r"[^\x20\x09-\x0D]", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z"
Weight = tuple[int, str]


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies``: rows with faults planted by ``crc32(conv_id:turn) % 20``; nulls count as one space.

    0 drops the row, 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it, 4 sets the role user. Equal rows of a turn are one
    row with their number, added up before the shuffle.
    """
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), told("role").alias("role"), told("text").alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    made = rows.where("fault <> 0").select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("fault") == 3, 2).otherwise(1).alias("n"))
    return made.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("copies"))


def messages(conversations: DataFrame) -> DataFrame:
    """A table of messages as it is, in the form of :func:`damaged`."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), told("role").alias("role"), told("text").alias("text"))
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))


def with_faults(rows: DataFrame) -> DataFrame:
    """``rows`` with ``fault``, the first that holds: ``blank``, ``duplicate`` (role and text in an earlier turn), ``truncated``, else null.

    Of several copies in one turn the first has this fault, the others are duplicates (or blank like it). First turns are found by
    partial aggregation and looked up, so a text repeated in a third of all rows is not gathered.
    """
    held = materialise(rows.withColumn("_same", F.sha2(F.to_json(F.struct(F.col("conv_id").cast("string").alias("c"), "role", "text")), 256)), "messages")
    place = F.coalesce("turn", F.lit(-(1 << 63)))
    firsts = materialise(held.groupBy("_same").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n")), "firsts")
    found = lookup(held.withColumn("_place", place), firsts, "_same", "_first", "_n", "turn")
    blank, cut = ~F.col("text").rlike(_NOT_BLANK), ~F.regexp_extract("text", _LAST, 1).isin(".", "!", "?")
    fault = F.when(blank, "blank").when(F.col("_place") > F.col("_first"), "duplicate").when(cut, "truncated")
    return found.select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"))


def edits(role: str, fault: str | None) -> Iterator[tuple[str, str | None, int]]:
    """Arcs of the edit transducer for one row: label, role initial that it puts out (None: nothing), cost."""
    yield "D", None, DELETE
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED if fault == "truncated" else 0
        yield "K", role[:1] or "-", KEEP + more  # a role without an initial fits no grammar
        for initial in ROLES:
            yield "R", initial, REROLE + more


def _inserted(best: list[Weight | None]) -> list[Weight | None]:
    """Weights with any number of insertions first: those of two arcs at most, as three lead back to a state."""
    for _ in range(2):
        longer = [[(w[0] + INSERT, "I" + w[1]) for x in ROLES if (t := NEXT.get((s, x))) is not None and (w := best[t])] for s in range(4)]
        best = [min([*longer[s], *([best[s]] if best[s] else [])], default=None) for s in range(4)]
    return best


def _before(role: str, fault: str | None, best: list[Weight | None]) -> list[Weight | None]:
    """Weights one row earlier: the arcs of the row, composed with the grammar at each state, then insertions."""
    out: list[Weight | None] = []
    for s in range(4):
        arcs = ((label, s if x is None else NEXT.get((s, x)), cost) for label, x, cost in edits(role, fault))
        out.append(min(((cost + w[0], label + w[1]) for label, t, cost in arcs if t is not None and (w := best[t])), default=None))
    return _inserted(out)


def fragment_weights(rows: list[tuple[str, str | None]]) -> list[list[Weight | None]]:
    """``[from][to]``: the least weight of the rows' edits between two states of the grammar; no insertion behind the last row."""
    columns = []
    for end in range(4):
        best: list[Weight | None] = [(0, "") if s == end else None for s in range(4)]
        for role, fault in reversed(rows):
            best = _before(role, fault, best)
        columns.append(best)
    return [[columns[t][s] for t in range(4)] for s in range(4)]


def joined_path(fragments: list[list[list[Weight | None]]]) -> tuple[int, list[tuple[int, str]]]:
    """Cost of the best whole path, and for each fragment the state it begins in and its labels; then insertions at the end."""
    best = _inserted([(0, "") if s in ACCEPTED else None for s in range(4)])
    tails = [best]
    for own in reversed(fragments):
        best = [min(((own[s][t][0] + best[t][0], own[s][t][1] + best[t][1]) for t in range(4) if own[s][t] and best[t]), default=None) for s in range(4)]
        tails.append(best)
    tails.reverse()
    cost, state, told = tails[0][START][0], START, []
    for own, now, later in zip(fragments, tails, tails[1:], strict=False):
        labels, state, before = next((own[state][t][1], t, state) for t in range(4) if own[state][t] and later[t] and now[state] == (own[state][t][0] + later[t][0], own[state][t][1] + later[t][1]))
        told.append((before, labels))
    return cost, [*told, (state, tails[-1][state][1])]


def spelled(state: int, labels: str, rows: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The messages that edits leave of ``rows(role, text)``, from a state of the grammar on."""
    out, left = [], iter(rows)
    for label in labels:
        role, text = next(left) if label != "I" else ("", "")
        if label == "D":
            continue
        if label != "K":
            role = ROLES["a" if state == USER else "u"]
        state = NEXT[(state, role[0])]
        out.append((role, text))
    return out


_WEIGHTS = pa.list_(pa.struct([("cost", pa.int64()), ("labels", pa.string())]))
_FRAGMENT = "part int, seq int, roles array<string>, texts array<string>, first string, last string, illegal long, weights array<struct<cost: long, labels: string>>"


def fragments_of(rows: DataFrame) -> DataFrame:
    """Rows with faults as fragments in the order of their conversation: its rows, its weights and what its borders show.

    A conversation is in one fragment unless it is long or a border of the range sort cuts it.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    spread = spread.select("conv_id", "role", "text", "copies", "fault", F.spark_partition_id().alias("part"))
    names = ["conv_id", "part", "seq", "roles", "texts", "first", "last", "illegal", "weights"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[tuple] = []
        done: list[tuple] = []
        seq = chars = waiting = 0
        kinds = [pa.null(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.string(), pa.int64(), _WEIGHTS]

        def close() -> None:
            initials = [r[1][:1] for r in own]
            illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
            weights = [{"cost": w[0], "labels": w[1]} if w else None for line in fragment_weights([(r[1], r[3]) for r in own]) for w in line]
            done.append((own[0][0], own[0][4], seq, [r[1] for r in own], [r[2] for r in own], initials[0], initials[-1], illegal, weights))

        def out() -> pa.RecordBatch:
            made = [pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays(made, names=names)

        for batch in batches:
            kinds[0] = batch.schema.field(0).type
            for conv, role, text, copies, fault, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for k in range(copies):
                    if own and (own[0][0] != conv or len(own) >= FRAGMENT_ROWS or chars >= FRAGMENT_CHARS):
                        close()
                        seq, waiting, chars, own = seq + 1, waiting + chars, 0, []
                        if waiting >= FRAGMENT_CHARS or len(done) >= FRAGMENT_ROWS:
                            yield out()
                            waiting = 0
                    own.append((conv, role, text, fault if k == 0 or fault == "blank" else "duplicate", part))
                    chars += len(text)
        if own:
            close()
            yield out()

    return spread.mapInArrow(run, f"conv_id {kind}, {_FRAGMENT}")


def _paths(fragments: DataFrame) -> DataFrame:
    """``conv_id, cost, illegal, audit, path``: ``path`` has a row (part, seq, state, labels) for each fragment, and one for the end."""
    kind = fragments.schema["conv_id"].dataType.simpleString()
    ordered = F.array_sort(F.collect_list(F.struct("part", "seq", "first", "last", "illegal", "weights")))
    whole = fragments.groupBy("conv_id").agg(ordered.alias("own"))
    path = pa.list_(pa.struct([("part", pa.int32()), ("seq", pa.int32()), ("state", pa.int32()), ("labels", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for own in batch.column(1).to_pylist():
                weights = [[[w and (w["cost"], w["labels"]) for w in f["weights"][4 * s : 4 * s + 4]] for s in range(4)] for f in own]
                cost, told = joined_path(weights)
                illegal = sum(f["illegal"] for f in own) + sum(a["last"] + b["first"] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
                places = [(f["part"], f["seq"]) for f in own] + [(1 << 30, 0)]
                out.append((cost, illegal, "".join(x[1] for x in told), [dict(zip(("part", "seq", "state", "labels"), (*p, *x), strict=True)) for p, x in zip(places, told, strict=True)]))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            arrays = [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), path), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["conv_id", "cost", "illegal", "audit", "path"])

    return whole.mapInArrow(run, f"conv_id {kind}, cost long, illegal long, audit string, path array<struct<part: int, seq: int, state: int, labels: string>>")


def _spelled(joined: DataFrame) -> DataFrame:
    kind = joined.schema["conv_id"].dataType.simpleString()
    message = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for state, labels, roles, texts in zip(*(c.to_pylist() for c in batch.columns[3:]), strict=True):
                out.append([{"role": r, "text": t} for r, t in spelled(state, labels, list(zip(roles or [], texts or [], strict=True)))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, message)], names=["conv_id", "part", "seq", "messages"])

    return joined.mapInArrow(run, f"conv_id {kind}, part int, seq int, messages array<struct<role: string, text: string>>")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(report, repaired)`` of ``rows(conv_id, turn, role, text, copies)``, see :func:`damaged` and :func:`messages`.

    ``report(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit)`` has a row for each conversation of ``rows``;
    ``repaired(conv_id, part, seq, messages)`` holds what is left of it in fragments, to be read in the order of
    ``part, seq``. Rows go by turn (nulls first), equal turns by role and text. A null ``conv_id`` is a conversation like any other;
    gaps ignore null turns. The audit of a conversation, one character an edit, must fit into one value.
    """
    faulty = materialise(with_faults(rows), "faults")
    fragments = materialise(fragments_of(faulty), "fragments")
    paths = materialise(_paths(fragments), "paths")
    is_ = lambda name: F.when(F.col("fault") == name, 1).otherwise(0)
    again = F.when(F.col("fault") == "blank", 0).otherwise(F.col("copies") - 1)
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps")
    sums = {"blank": is_("blank") * F.col("copies"), "duplicate": is_("duplicate") + again, "truncated": is_("truncated")}
    counts = faulty.groupBy("conv_id").agg(*[F.sum(c).alias(name) for name, c in sums.items()])
    spans = faulty.groupBy("conv_id").agg(gaps)
    same = lambda left, right: left.join(right.withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
    report = same(same(paths.drop("path"), counts), spans).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    steps = paths.select(F.col("conv_id").alias("_c"), F.explode("path").alias("p")).select("_c", "p.*").withColumnRenamed("part", "_part").withColumnRenamed("seq", "_seq")
    on = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_part")) & (F.col("seq") == F.col("_seq"))
    held = steps.join(fragments.select("conv_id", "part", "seq", "roles", "texts"), on, "left")
    joined = held.select(F.col("_c").alias("conv_id"), F.col("_part").alias("part"), F.col("_seq").alias("seq"), "state", "labels", "roles", "texts")
    return report, _spelled(joined.where("roles is not null or labels <> ''"))


def digests(repaired: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``: of ``role:text``, newline-joined. Fragments stream through one hash a conversation, none is gathered."""
    import hashlib

    kind = repaired.schema["conv_id"].dataType.simpleString()
    lines = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")
    ordered = repaired.where("size(messages) > 0").select("conv_id", "part", "seq", lines.alias("lines")).repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done, field = None, None, [], None
        for batch in batches:
            field = batch.schema.field(0).type
            for conv, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if state is not None and conv == now:
                    state.update(b"\n")
                else:
                    if state is not None:
                        done.append((now, state.hexdigest()))
                    now, state = conv, hashlib.sha256()
                state.update(text.encode("utf-8", "surrogatepass"))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), (field, pa.string()), strict=True)], names=["conv_id", "repaired_sha256"])
                done = []
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], field), pa.array([state.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])

    return ordered.select("conv_id", "lines").mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def whole_report(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """Every ``conv_id`` of ``conversations`` with the report on ``rows`` and ``repaired_sha256``; zeros and empty texts where no row is left."""
    report, repaired = repair(rows)
    every = conversations.select("conv_id").distinct()
    beside = lambda left, right: left.join(right.withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c")), "left").drop("_c")
    out = beside(beside(every, report), digests(repaired))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    numbers: list[Column] = [zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
