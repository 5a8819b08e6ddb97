"""Query of the conversation repair and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sentspark.llm.registry import query, table
from sentspark.llm.turn_repair import audit_conversations, damaged, with_digests


def crc32_sql(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of a SQL string, by the hex digits of its bytes."""
    remainders = []
    for nibble in range(16):
        for _ in range(4):
            nibble = (nibble >> 1) ^ (0xEDB88320 if nibble & 1 else 0)
        remainders.append(nibble)
    h = f"string_split(hex(encode({text})), '')"
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(generate_series(1, len({h})), lambda j: "
            f"(strpos('0123456789ABCDEF', {h}[CASE WHEN j % 2 = 1 THEN j + 1 ELSE j - 1 END]) - 1)::BIGINT)), "
            f"lambda c, d: xor(c >> 4, ({remainders}::BIGINT[])[(xor(c, d) & 15) + 1])), 4294967295)")


def _state_sql(state: int) -> str:
    """The least of all ways to deal with one row in a state of the pattern, as a
    struct of cost, edits and repaired lines; ways that aren't open cost a million."""
    fill, step = {0: "user", 1: "user", 2: "assistant", 3: "user"}, {0: 2, 1: 2, 2: 3, 3: 2}
    ways, at, cost, word, lines = [], state, 0, "", []
    for _ in range(3):
        def way(to, price, letter, line=None, fits="true"):
            new = "[" + ", ".join([*[f"'{x}:'" for x in lines], *([line] if line else [])]) + "]::VARCHAR[]"
            ways.append(f"{{'c': s{to}.c + {cost} + {price} + CASE WHEN {fits} THEN 0 ELSE 1000000 END, 'a': '{word}{letter}' || s{to}.a, "
                        f"'t': list_concat({new}, s{to}.t)}}")

        way(at, "3", "D")
        way(step[at], "2 + cut", "R", f"'{fill[at]}:' || text", "NOT gone")
        if at == 0:
            way(1, "cut", "K", "role || ':' || text", "NOT gone AND initial = 's'")
        way(step[at], "cut", "K", "role || ':' || text", f"NOT gone AND initial = '{fill[at][0]}'")
        cost, word, lines, at = cost + 2, word + "I", [*lines, fill[at]], step[at]
    return f"list_sort([{', '.join(ways)}])[1] AS s{state}"


_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_OP11_SQL = f"""WITH RECURSIVE
    keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS h FROM conversations),
    rows_ AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN h = 1 THEN '' WHEN h = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy FROM keyed WHERE h <> 0),
    numbered AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n, left(role, 1) AS initial,
        lag(left(role, 1)) OVER w AS before, rtrim(text, {_WHITE}) AS body
        FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
    told AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM numbered),
    judged AS (SELECT *, body = '' AS blank, body <> '' AND nth > 1 AS again, body <> '' AND nth = 1 AND right(body, 1) NOT IN ('.', '!', '?') AS open FROM told),
    coded AS (SELECT *, blank OR again AS gone, open::INTEGER AS cut FROM judged),
    ways AS (SELECT conv_id, n AS i, {{'c': 0, 'a': '', 't': []::VARCHAR[]}} AS s0, {{'c': 4, 'a': 'II', 't': ['user:', 'assistant:']}} AS s1,
        {{'c': 2, 'a': 'I', 't': ['assistant:']}} AS s2, {{'c': 0, 'a': '', 't': []::VARCHAR[]}} AS s3 FROM coded WHERE i = n
        UNION ALL SELECT ways.conv_id, ways.i - 1, {", ".join(_state_sql(q) for q in range(4))}
        FROM ways JOIN coded ON coded.conv_id IS NOT DISTINCT FROM ways.conv_id AND coded.i = ways.i),
    counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::INTEGER) AS blank, sum(again::INTEGER) AS duplicate,
        sum(cut) AS truncated, sum((i > 1 AND before || initial NOT IN ('su', 'ua', 'au'))::INTEGER) AS illegal FROM coded GROUP BY 1),
    ids AS (SELECT DISTINCT conv_id FROM conversations)
    SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
        coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(s0.c, 0)::BIGINT AS cost, coalesce(s0.a, '') AS audit,
        sha256(coalesce(array_to_string(s0.t, chr(10)), '')) AS repaired_sha256
    FROM ids LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ids.conv_id
        LEFT JOIN ways ON ways.conv_id IS NOT DISTINCT FROM ids.conv_id AND ways.i = 0"""


@query("op11_turn_repair", _OP11_SQL)
def op11_turn_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = damaged(table(spark, folder, "conversations"))
    return with_digests(rows, audit_conversations(rows, F.col("present")), F.col("present"))
