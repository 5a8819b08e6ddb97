"""Repair of the role structure of conversations at least cost.

A conversation is well formed if the initials of its roles spell ``(s?(ua)+)?``. Rows
are kept (0), given another role (2) or deleted (3, a must for blank and repeated rows),
empty turns are inserted (2), and a truncated row that stays costs 1. Among the cheapest
ways the one whose edits spell the ASCII-least word is taken.

Every state of a dynamic program over (row, state of the pattern) has one big integer as
its weight: the cost in the high digits, below it one octal digit per edit letter, the
first edit highest, zeros behind the last. The letters' digits are in ASCII order and a
padding zero is less than any, so the least integer is the cheapest and then least word.
An edge adds its own digits in front and moves the rest down. Inserts come before the
row that follows them (at the end, after the last row), which makes it a DAG and means
that no word over the same rows is a proper prefix of another. So a long conversation
can be cut: at a cut only the order of the words behind it matters, as one more digit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sentspark.llm.scratch import keep, scratch

LETTERS = "DIKR"        # ASCII order; digit 1 to 4
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
SEGMENT = 128           # rows between two cuts

_WHITE = " \t\n\x0b\f\r"
_INITIALS = "sua"
#: State after a role's initial: 0 nothing yet, 1 after s, 2 after u, 3 after a.
_STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_FILL = {0: "user", 1: "user", 2: "assistant", 3: "user"}
_DIGITS = 3 * SEGMENT + 3
_COST = 3 * _DIGITS     # bits below the cost
_LOW = (1 << _COST) - 1


def _filled(state: int) -> int:
    return _STEP[state, _FILL[state][0]]


def _weight(cost: int, word: str) -> int:
    letters = int("".join(str(LETTERS.index(x) + 1) for x in word) or "0", 8)
    return (cost << _COST) + (letters << 3 * (_DIGITS - len(word)))


def _moves(initial: str, gone: bool, cut: bool) -> list[list[tuple[int, int, int]]]:
    """Per state: (next state, weight, bits of its letters) of the ways to deal with one
    row, the least way to each next state."""
    found = []
    for state in range(4):
        ways: dict[int, list[tuple[int, str]]] = {}
        at, cost, word = state, 0, ""
        for _ in range(3):
            ways.setdefault(at, []).append((cost + DELETE, word + "D"))
            if not gone:
                if (at, initial) in _STEP:
                    ways.setdefault(_STEP[at, initial], []).append((cost + KEEP + cut * TRUNCATED, word + "K"))
                ways.setdefault(_filled(at), []).append((cost + REROLE + cut * TRUNCATED, word + "R"))
            at, cost, word = _filled(at), cost + INSERT, word + "I"
        found.append([(to, _weight(*min(w)), 3 * len(min(w)[1])) for to, w in ways.items()])
    return found


#: Code of a row: 4 * (place in _INITIALS, 3 for others) + 2 * gone + cut.
_MOVES = [_moves((_INITIALS + "?")[code // 4], bool(code & 2), bool(code & 1)) for code in range(16)]
_END = [_weight(0, ""), _weight(2 * INSERT, "II"), _weight(INSERT, "I"), _weight(0, "")]


def _segment(codes: bytes, after: list[int]) -> list[int]:
    """Least weight from each state before the rows ``codes`` to the end."""
    for code in reversed(codes):
        low = [w & _LOW for w in after]
        high = [w - x for w, x in zip(after, low)]
        after = [min(weight + high[to] + (low[to] >> bits) for to, weight, bits in ways) for ways in _MOVES[code]]
    return after


def cheapest(codes: bytes) -> tuple[int, str]:
    """Cost and edits of the cheapest repair of rows given by their codes. Works on
    integers of bounded length, one segment after the other from the end."""
    after, segments, order = _END, [], []
    for first in reversed(range(0, len(codes), SEGMENT)):
        after = _segment(codes[first:first + SEGMENT], after)
        segments.append(after)
        words = sorted({w & _LOW for w in after})
        order.append([words.index(w & _LOW) + 1 for w in after])
        after = [((w >> _COST) << _COST) + (rank << 3 * (_DIGITS - 1)) for w, rank in zip(after, order[-1])]
    if not segments:
        return 0, ""
    state, parts = 0, []
    for i in reversed(range(len(segments))):
        digits = format(segments[i][state] & _LOW, "o").zfill(_DIGITS).rstrip("0")
        if i:
            digits, state = digits[:-1], order[i - 1].index(int(digits[-1]))
        parts.append(digits)
    return segments[-1][0] >> _COST, "".join(parts).translate({ord(str(i + 1)): x for i, x in enumerate(LETTERS)})


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``present`` after damage by crc32 of
    ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 removes its
    sentence marks, 3 repeats it, 4 makes it the user's. NULL counts as one space in the
    key, role and text. A dropped row stays as a mark (present false), so that its
    conversation is known even if nothing is left of it."""
    space = F.lit(" ")
    named = [F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")]
    h = (F.crc32(F.encode(F.concat(named[0], F.lit(":"), named[1]), "UTF-8")) % 20).alias("h")
    rows = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), space).alias(c) for c in ("role", "text")], h)
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("h") != 0).alias("present"), F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _plain(rows: DataFrame, present: Column) -> DataFrame:
    space = F.lit(" ")
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *[
        F.coalesce(F.col(c).cast("string"), space).alias(c) for c in ("role", "text")], present.alias("present"))


def _seen_earlier(rows: DataFrame) -> DataFrame:
    """conv_id, role, digest and first turn of what is said in several turns of a
    conversation. Counted before the shuffle; equal rows of one turn lie side by side
    later on and need no entry."""
    return (
        rows.groupBy("conv_id", "role", "digest")
        .agg(F.min("turn").alias("first"), F.max("turn").alias("last"), F.max(F.col("turn").isNull()).alias("unnumbered"))
        .where((F.col("first") != F.col("last")) | (F.col("unnumbered") & F.col("first").isNotNull()))
        .select(*[F.col(c).alias(f"of_{c}") for c in ("conv_id", "role", "digest")], F.when(~F.col("unnumbered"), F.col("first")).alias("first"))
    )


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _audits(batches, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """From rows sorted by conversation and place: one row per conversation. Of a
    conversation it holds one byte per row."""
    conv, done = None, []

    def start(of):
        return {"of": of, "codes": bytearray(), "before": None, "initial": None, "turns": 0, "least": 0, "turn": None, "counts": [0, 0, 0, 0]}

    def close():
        cost, audit = cheapest(bytes(conv["codes"]))
        gaps = conv["turn"] - conv["least"] + 1 - conv["turns"] if conv["turns"] else 0
        done.append((conv["of"], gaps, *conv["counts"], cost, audit))

    def flush():
        columns = list(zip(*done)) or [[] for _ in schema]
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "digest", "present", "blank", "later", "cut")]
        for of, turn, role, digest, present, blank, later, cut in zip(*columns):
            if conv is None or conv["of"] != of:
                if conv is not None:
                    close()
                conv = start(of)
            if not present:
                continue
            if turn is not None and turn != conv["turn"]:
                conv["least"] = conv["least"] if conv["turns"] else turn
                conv["turns"], conv["turn"] = conv["turns"] + 1, turn
            again = later or conv["before"] == (turn, role, digest)
            conv["before"] = (turn, role, digest)
            initial = role[:1]
            if conv["codes"] and (conv["initial"] + initial) not in ("su", "ua", "au"):
                conv["counts"][3] += 1
            conv["initial"] = initial
            gone = blank or again
            if gone or cut:
                conv["counts"][0 if blank else 1 if again else 2] += 1
            kind = _INITIALS.index(initial) if initial and initial in _INITIALS else 3
            conv["codes"].append(4 * kind + 2 * gone + (cut and not gone))
        if done:
            yield flush()
    if conv is not None:
        close()
        yield flush()


def audit_conversations(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal,
    cost (long) and audit, the edits of its cheapest repair in order.

    ``rows`` needs conv_id, turn, role and text; other columns are ignored, so their
    names can't clash. ``present`` marks the rows that count; the others only tell that
    their conversation exists. Rows go by turn (NULL first), then role, then text; equal
    rows are repeats of the first. A NULL role or text counts as one space, NULL conv_id
    is a conversation of its own. Texts are read whole, however long, and compared by
    SHA-256. An empty table gives no rows.

    Texts never reach Python. A conversation goes through one task as a sorted stream
    that keeps one byte per row, as its audit is one value of that size anyway.
    """
    base = _plain(rows, F.lit(True) if present is None else present)
    end, digest = F.rtrim("text", F.lit(_WHITE)), F.unhex(F.sha2("text", 256))
    blank = F.col("present") & (end == "")
    kind = rows.schema["conv_id"].dataType.simpleString()
    with scratch(rows.sparkSession, "seen") as tmp:
        # Written first, so that its size decides how it is joined: few rows are broadcast
        # and the texts move once.
        seen = tmp.table(_seen_earlier(base.where("present").where(~blank).select("conv_id", "turn", "role", digest.alias("digest"))))
        same = F.col("conv_id").eqNullSafe(F.col("of_conv_id")) & (F.col("role") == F.col("of_role")) & (digest == F.col("of_digest"))
        later = F.col("of_role").isNotNull() & F.col("turn").isNotNull() & (F.col("first").isNull() | (F.col("turn") > F.col("first")))
        ordered = (
            base.join(seen, same, "left").select("conv_id", "turn", "role", "text", "present", later.alias("later"))
            .repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
            .select("conv_id", "turn", "role", digest.alias("digest"), "present", blank.alias("blank"), "later",
                    (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("cut"))
        )
        return keep(_stream(ordered, _audits, f"conv_id {kind}, {', '.join(f'{c} long' for c in _COUNTS)}, audit string"))


def _stream(df: DataFrame, work, schema: str) -> DataFrame:
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return df.mapInArrow(lambda batches: work(batches, arrow), schema)


class _Editor:
    """Applies the edits of one conversation to its rows, in order."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, 0

    def inserted(self) -> Iterator[tuple[str, str, None]]:
        while self.audit[self.at:self.at + 1] == "I":
            role = _FILL[self.state]
            self.at, self.state = self.at + 1, _filled(self.state)
            yield "I", role, None

    def row(self, role: str) -> tuple[str, str]:
        letter = self.audit[self.at]
        self.at += 1
        if letter == "R":
            role = _FILL[self.state]
        if letter != "D":
            self.state = _STEP[self.state, role[:1]]
        return letter, role


def _repaired(batches) -> Iterator[tuple]:
    """(conversation's columns, None) where one begins, (None, (edit, turn, role, text))
    for each of its rows after repair. Sorted input: the audit comes before the rows."""
    editor = None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("head", "turn", "role", "text")]
        for head, turn, role, text in zip(*columns):
            if head is not None:
                if editor is not None:
                    yield from ((None, (edit, None, new, "")) for edit, new, _ in editor.inserted())
                editor = _Editor(head["audit"])
                yield head, None
                continue
            yield from ((None, (edit, None, new, "")) for edit, new, _ in editor.inserted())
            edit, new = editor.row(role)
            if edit != "D":
                yield None, (edit, turn, new, text)
    if editor is not None:
        yield from ((None, (edit, None, new, "")) for edit, new, _ in editor.inserted())


_BATCH = 4096
_BATCH_CHARS = 1 << 22


def _rows(batches, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, chars, conv, place = [], 0, None, 0

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    for head, row in _repaired(batches):
        if head is not None:
            conv, place = head["conv_id"], 0
            continue
        held.append((conv, place, *row))
        place, chars = place + 1, chars + len(row[3])
        if len(held) >= _BATCH or chars >= _BATCH_CHARS:
            yield flush()
            held, chars = [], 0
    if held:
        yield flush()


def _digests(batches, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    done, head, digest = [], None, None

    def close():
        done.append((*[head[f.name] for f in schema if f.name != "repaired_sha256"], digest.hexdigest()))

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

    empty = True
    for now, row in _repaired(batches):
        if now is not None:
            if head is not None:
                close()
            head, digest, empty = now, hashlib.sha256(), True
            if len(done) >= _BATCH:
                yield flush()
                done.clear()
        else:
            digest.update((("" if empty else "\n") + row[2] + ":" + row[3]).encode())
            empty = False
    if head is not None:
        close()
        yield flush()


def _edited(rows: DataFrame, audits: DataFrame, present: Column | None) -> DataFrame:
    """Rows and audits of each conversation side by side, the audit first."""
    base = _plain(rows, F.lit(True) if present is None else present).where("present")
    names = audits.columns
    heads = audits.select("conv_id", F.struct(*names).alias("head"), *[
        F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"))])
    lines = base.select("conv_id", F.lit(None).cast(heads.schema["head"].dataType).alias("head"), "turn", "role", "text")
    return (
        heads.unionByName(lines).repartition("conv_id")
        .sortWithinPartitions("conv_id", F.col("head").isNull(), F.asc_nulls_first("turn"), "role", "text")
        .select("head", "turn", "role", "text")
    )


def repair_conversations(rows: DataFrame, audits: DataFrame, present: Column | None = None) -> DataFrame:
    """The rows of every conversation after the edits of ``audits``: conv_id, place (from
    0), edit (K, R or I), turn (NULL for inserted rows), role, text. Same terms as
    ``audit_conversations``; texts stream through, none is held longer than its batch."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    return _stream(_edited(rows, audits, present), _rows, f"conv_id {kind}, place long, edit string, turn long, role string, text string")


def with_digests(rows: DataFrame, audits: DataFrame, present: Column | None = None) -> DataFrame:
    """``audits`` with repaired_sha256, the SHA-256 of the repaired conversation's
    ``role:text`` lines joined by newlines. A hash is taken in order, so this is one
    stream per conversation; nothing of it is held."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in audits.schema)
    return _stream(_edited(rows, audits, present), _digests, f"{kinds}, repaired_sha256 string")
