"""Conversation repair against plain searches."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from sentspark.llm import turn_repair as T
from sentspark.llm.scratch import scratch

FORM = re.compile(r"(s?(ua)+)?")


def search(rows):
    """Least (cost, audit, lines) over every edit of ``rows`` (role, text, gone, cut),
    with up to two inserts before each row and at the end."""
    gaps = [x for n in range(3) for x in itertools.product(("user", "assistant"), repeat=n)]
    best = None

    def go(i, cost, audit, lines):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        for new in gaps:
            now = (cost + 2 * len(new), audit + "I" * len(new), lines + [f"{r}:" for r in new])
            if i == len(rows):
                if FORM.fullmatch("".join(x[:1] for x in now[2])) and (best is None or now[:2] < best[:2]):
                    best = now
                continue
            role, text, gone, cut = rows[i]
            go(i + 1, now[0] + 3, now[1] + "D", now[2])
            if not gone:
                go(i + 1, now[0] + cut, now[1] + "K", now[2] + [f"{role}:{text}"])
                for r in ("user", "assistant"):
                    go(i + 1, now[0] + 2 + cut, now[1] + "R", now[2] + [f"{r}:{text}"])

    go(0, 0, "", [])
    return best


def simple(codes):
    """The same program on (cost, word) pairs, without integers and cuts."""
    step, fill = T._STEP, T._FILL
    after = [(0, ""), (4, "II"), (2, "I"), (0, "")]
    for code in reversed(codes):
        initial, gone, cut = "sua?"[code // 4], code & 2, code & 1
        now = []
        for state in range(4):
            ways, at, cost, word = [], state, 0, ""
            for _ in range(3):
                filled = step[at, fill[at][0]]
                ways.append((cost + 3 + after[at][0], word + "D" + after[at][1]))
                if not gone:
                    ways.append((cost + 2 + cut + after[filled][0], word + "R" + after[filled][1]))
                    if (at, initial) in step:
                        ways.append((cost + cut + after[step[at, initial]][0], word + "K" + after[step[at, initial]][1]))
                at, cost, word = filled, cost + 2, word + "I"
            now.append(min(ways))
        after = now
    return after[0]


def test_cheapest_is_the_least_of_all_edits():
    rng = random.Random(1)
    for n in range(6):
        for _ in range(12):
            codes = bytes(rng.choice([0, 1, 4, 4, 5, 6, 8, 8, 9, 10, 12]) for _ in range(n))
            rows = [({"s": "system", "u": "user", "a": "assistant", "?": "tool"}["sua?"[c // 4]], "x", bool(c & 2), c & 1) for c in codes]
            assert T.cheapest(codes) == search(rows)[:2]


def test_cuts_between_segments_change_nothing():
    rng = random.Random(2)
    for n in (T.SEGMENT - 1, T.SEGMENT, T.SEGMENT + 1, 3 * T.SEGMENT, 1000):
        for kinds in ([4], [8], [0], [6], [4, 8], [0, 1, 4, 5, 6, 8, 9, 12], [4, 4, 4, 12], [5, 9]):
            codes = bytes(rng.choice(kinds) for _ in range(n))
            assert T.cheapest(codes) == simple(codes)


WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


def plain(rows):
    """The whole operator on one conversation's (turn, role, text) after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, counts, edits, before = set(), Counter(), [], None
    for turn, role, text in rows:
        body = text.rstrip(WHITE)
        kind = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        counts[kind] += 1
        counts["illegal"] += before is not None and before + role[:1] not in ("su", "ua", "au")
        before = role[:1]
        edits.append((role, text, kind in ("blank", "duplicate"), int(kind == "truncated")))
    turns = {t for t, _, _ in rows if t is not None}
    cost, audit, lines = search(edits)
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], counts["illegal"], cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        now = out.setdefault(conv, [])
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        now += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def table(spark):
    rng, rows = random.Random(4), []
    texts = ["One.", "Two!", "Three?", "open", "", " \n\t", None, "One.", "é漢👍.", "a\x85", "Mid. dle", "x . \x0b"]
    for conv in [*range(60), None]:
        for turn in range(rng.randrange(1, 6)):
            turn = rng.choice([turn, turn, turn, turn + 3, None])
            rows.append((conv, turn, rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]), rng.choice(texts)))
    rows += rows[:9]
    return rows, spark.createDataFrame([(*r, i, None) for i, r in enumerate(rows)],
                                       "conv_id long, turn long, role string, text string, present int, digest string").repartition(5)


def test_conversations(spark):
    rows, df = table(spark)
    hurt = T.damaged(df)
    with scratch(spark, "test") as tmp:
        audits = tmp.table(T.audit_conversations(hurt, F.col("present")))
        got = {r["conv_id"]: tuple(r)[1:] for r in T.with_digests(hurt, audits, F.col("present")).collect()}
        lines = T.repair_conversations(hurt, audits, F.col("present")).orderBy("conv_id", "place").collect()
    want = {conv: plain(r) if r else (0,) * 6 + ("", hashlib.sha256(b"").hexdigest()) for conv, r in damage(rows).items()}
    assert got == want
    for conv, found in got.items():
        mine = [r for r in lines if r["conv_id"] == conv]
        assert [r["place"] for r in mine] == list(range(len(mine)))
        assert hashlib.sha256("\n".join(f"{r['role']}:{r['text']}" for r in mine).encode()).hexdigest() == found[-1]
        assert "".join(r["edit"] for r in mine) == found[-2].replace("D", "")
    assert T.audit_conversations(hurt.where("false")).collect() == []
    assert T.with_digests(hurt.where("false"), T.audit_conversations(hurt.where("false"))).collect() == []


def test_one_long_conversation(spark):
    """Repeats in other turns, long texts, more rows than a segment."""
    rows = [(7, i, ("user", "assistant")[i % 2], f"Turn {i % 300}." if i % 5 else "word " * 20_000 + ".") for i in range(900)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    got = T.audit_conversations(df).first()
    seen, codes = set(), bytearray()
    for _, _, role, text in rows:
        codes.append(4 * "sua".index(role[0]) + 2 * ((role, text) in seen))
        seen.add((role, text))
    cost, audit = simple(bytes(codes))
    assert (got["cost"], got["audit"], got["duplicate"], got["gaps"]) == (cost, audit, sum(c & 2 > 0 for c in codes), 0)
