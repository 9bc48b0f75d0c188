"""Conversation structure repair: Dijkstra on the lattice of turns and grammar states."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

BLANKS = "\t\n\x0b\x0c\r "
ENDS = (".", "!", "?")
#: States: nothing yet, after the system turn, after a user turn, after an assistant turn. A conversation may end in the first or the last.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: The one turn that may be made in each state, by giving a turn another role or by insertion.
MADE = ((USER, "user"), (USER, "user"), (ASSISTANT, "assistant"), (USER, "user"))
REROLE, DELETE, INSERT = 2, 3, 2
#: Turns of a conversation that are searched at once; longer ones go on from the states reached.
BLOCK = 1024

Turn = tuple[str, bool, bool]  # role's initial, must go, cut short


def cheapest(turns: list[Turn], sources: dict[int, tuple[int, str]], last: bool = True) -> dict[int, tuple[int, str, int]]:
    """Least (cost, edits) from ``sources``, state -> (cost, edits so far), to the end of ``turns``: state -> (cost, edits, source).

    Dijkstra's search on nodes (turn, state) that are made as they are met,
    keyed by cost and then the edits' initials. If these turns are the last,
    the first node popped that may end a conversation is the answer. Else every
    state that can still matter is settled: from an assistant's turn all that
    other states can do costs 3 more at most (a system turn to delete), so
    what costs more than that is left.
    """
    heap = [(cost, edits, 0, state, state) for state, (cost, edits) in sources.items()]
    heap.sort()
    done: set[tuple[int, int]] = set()
    ends: dict[int, tuple[int, str, int]] = {}
    while heap:
        cost, edits, i, state, source = heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if ASSISTANT in ends and cost > ends[ASSISTANT][0] + DELETE:
            break
        if i == len(turns):
            if last and state in (START, ASSISTANT):
                return {state: (cost, edits, source)}
            ends[state] = (cost, edits, source)
        made = MADE[state][0]
        heappush(heap, (cost + INSERT, edits + "I", i, made, source))
        if i < len(turns):
            initial, must_go, cut = turns[i]
            heappush(heap, (cost + DELETE, edits + "D", i + 1, state, source))
            if not must_go:
                if initial in NEXT[state]:
                    heappush(heap, (cost + cut, edits + "K", i + 1, NEXT[state][initial], source))
                heappush(heap, (cost + REROLE + cut, edits + "R", i + 1, made, source))
    return ends


def told_apart(texts: dict[int, str]) -> dict[int, str]:
    """Short texts that compare with one another, whatever follows each, as ``texts`` do.

    Only the characters in which some differ stay. Where one text begins
    another, the rest of the longer one stays whole (insertions at one place).
    """
    if len(texts) < 2:
        return dict.fromkeys(texts, "")
    k = 0
    first = next(iter(texts.values()))
    while all(len(t) > k and t[k] == first[k : k + 1] for t in texts.values()):
        k += 1
    rest = {key: t[k:] for key, t in texts.items()}
    if not all(rest.values()):
        return rest
    groups: dict[str, dict[int, str]] = {}
    for key, t in rest.items():
        groups.setdefault(t[0], {})[key] = t[1:]
    return {key: head + t for head, group in groups.items() for key, t in told_apart(group).items()}


class Repair:
    """One conversation, its turns read in order and never held all at once.

    A path that may yet be the answer keeps its edits and a digest of the turns
    it leaves, so memory is a block of turns and a few bytes for each edit.
    """

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.rows: list[tuple[str, str, bool, bool]] = []
        self.paths = {START: (0, None, hashlib.sha256(), True)}  # cost, (earlier edits, edits), digest, whether nothing is in it
        self.order = {START: ""}
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.latest = self.before = None

    def add(self, turn: int | None, role: str, text: str, blank: bool, repeat: bool, cut: bool) -> None:
        if len(self.rows) == BLOCK:
            self.search(False)
        must_go = blank or repeat
        self.rows.append((role, text, must_go, cut and not must_go))
        self.blank += blank
        self.duplicate += repeat and not blank
        self.truncated += cut and not must_go
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.latest
            self.latest = turn
        initial = role[:1]
        if self.before is not None:
            self.illegal += self.before + initial not in ("su", "ua", "au")
        self.before = initial

    def search(self, last: bool) -> None:
        """Goes on over the rows held, from every path that is left."""
        found = cheapest([(role[:1], must_go, cut) for role, _, must_go, cut in self.rows], {s: (p[0], self.order[s]) for s, p in self.paths.items()}, last)
        paths = {}
        for state, (cost, edits, source) in found.items():
            _, before, digest, empty = self.paths[source]
            own = edits[len(self.order[source]) :]
            digest, at, now = digest.copy(), 0, source
            for e in own:
                if e == "D":
                    at += 1
                    continue
                role, text = self.rows[at][:2] if e != "I" else ("", "")
                if e == "K":
                    now = NEXT[now][role[:1]]
                else:
                    now, role = MADE[now]
                at += e != "I"
                digest.update(f"{'' if empty else chr(10)}{role}:{text}".encode())
                empty = False
            paths[state] = cost, (before, own), digest, empty
        self.paths, self.order = paths, told_apart({s: e for s, (_, e, _) in found.items()})
        self.rows = []

    def result(self) -> dict:
        self.search(True)
        ((cost, edits, digest, _),) = self.paths.values()
        audit = []
        while edits:
            edits, own = edits
            audit.append(own)
        gaps = 0 if self.first is None else self.latest - self.first + 1 - self.turns
        return {"conv_id": self.conv_id, "gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "cost": cost, "audit": "".join(reversed(audit)), "repaired_sha256": digest.hexdigest()}


def has_no_word(text: str) -> Column:
    return F.trim(F.col(text), F.lit(BLANKS)) == ""


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", modulus: int = 20) -> DataFrame:
    """(conv_id, turn, role, text, gone): faults planted by crc32 of ``conv_id:turn`` modulo ``modulus``, for tests of a repair.

    0 drops a row (it stays as gone, without role and text, so that its
    conversation is known), 1 empties its text, 2 takes ``.!?`` out of it, 3
    repeats the row, 4 makes the role user. Null ids and turns are one space
    in the key, null roles and texts are one space.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", space(conv_col), space(turn_col)).cast("binary")) % modulus
    own = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"), kind.alias("kind"))
    gone = F.col("kind") == 0
    role = F.when(gone, F.lit(None)).when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    text = F.when(gone, F.lit(None)).when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", "".join(ENDS), "")).otherwise(F.col("text"))
    return own.select("conv_id", "turn", role.alias("role"), text.alias("text"), gone.alias("gone"), F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def repaired(rows: DataFrame) -> DataFrame:
    """One row per conv_id of ``rows`` (conv_id, turn, role, text, gone): its faults, and the cheapest edits that give it a right structure.

    Rows stand in order of turn, nulls first, then role and text. A row's first
    fault counts: blank, duplicate (role and text of an earlier row), truncated
    (the last character that is not blank is none of ``.!?``). Kept rows cost
    0, another role 2, deletion 3 (a must for blank and duplicate rows), an
    inserted empty turn 2, and a truncated row that stays 1 more. The roles'
    initials must then read ``(s?(ua)+)?``. audit has the initials of the
    edits, Keep, Rerole, Delete, Insert, the ASCII-least of the cheapest;
    repaired_sha256 is of the turns left, ``role:text``, one a line.

    Rows are dealt by conversation and sorted; each task reads its
    conversations in order and holds at most BLOCK turns of one. A digest of a
    conversation's text needs its turns one after another, so a conversation is
    not cut between tasks, however long it is; its repeats are found by sorting
    too, not in memory. Null conv_ids are one conversation. Without rows that
    are not gone: zeros, an empty audit and the empty text's digest. Null roles
    and texts are taken as one space. An empty table gives an empty result.
    """
    some = rows.select("conv_id", "turn", F.when(~F.col("gone"), F.coalesce("role", F.lit(" "))).alias("role"), F.when(~F.col("gone"), F.coalesce("text", F.lit(" "))).alias("text"), "gone").withColumn("digest", F.unhex(F.sha2("text", 256)))
    seen = Window.partitionBy("conv_id", "role", "digest").orderBy(F.col("turn").asc_nulls_first())
    stripped = F.rtrim(F.col("text"), F.lit(BLANKS))
    told = some.repartition("conv_id").withColumn("repeat", F.row_number().over(seen) > 1).select("conv_id", "turn", "role", "text", "gone", has_no_word("text").alias("blank"), "repeat", (~F.substring(stripped, -1, 1).isin(*ENDS)).alias("cut"))
    kind = rows.schema["conv_id"].dataType
    schema = f"conv_id {kind.simpleString()}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Repair | None = None
        for batch in batches:
            out = []
            for conv_id, turn, role, text, gone, blank, repeat, cut in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or conv_id != now.conv_id:
                    if now:
                        out.append(now.result())
                    now = Repair(conv_id)
                if not gone:
                    now.add(turn, role, text, blank, repeat, cut)
            if out:
                yield made(out, batch.schema.field(0).type)
        if now:
            yield made([now.result()], batch.schema.field(0).type)

    def made(out: list[dict], id_type: pa.DataType) -> pa.RecordBatch:
        names = list(out[0])
        types = [id_type, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in zip(names, types, strict=True)], names)

    return told.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text").mapInArrow(run, schema)


def repaired_sql(modulus: int = 20) -> str:
    """DuckDB SQL for op13's rows: the least (cost, audit) of each grammar state, row by row, as one text of six digits and the edits."""
    crc = """xor(list_reduce(list_transform(range(length(s)), lambda i: ascii(substring(s, (i + 1)::INT, 1))::UBIGINT), lambda c, b:
               list_reduce(list_concat([xor(c, b)], [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384::UBIGINT)), 4294967295::UBIGINT), 4294967295)"""
    more = lambda key, cost, letter: f"printf('%06d', left({key}, 6)::INT + {cost}) || substring({key}, 7) || '{letter}'"
    stay = lambda key, initial: f"CASE WHEN NOT must THEN CASE WHEN r = '{initial}' THEN {more(key, 'cut::INT', 'K')} ELSE {more(key, '2 + cut::INT', 'R')} END END"
    bare = "rtrim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')"
    return f"""
      WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations),
      d AS (SELECT conv_id, turn, copy, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
            FROM (SELECT *, {crc} % {modulus} AS kind FROM k), range(2) t(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
      f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, left(role, 1) AS r, {bare} = '' AS blank,
                   row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS repeat, right({bare}, 1) NOT IN ('.', '!', '?') AS short FROM d),
      g AS (SELECT *, blank OR repeat AS must, short AND NOT blank AND NOT repeat AS cut, lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r AS two FROM f),
      dp AS (
        SELECT DISTINCT conv_id, 0::BIGINT AS i, '000000' AS k0, NULL::VARCHAR AS k1, '000002I' AS k2, '000004II' AS k3 FROM conversations
        UNION ALL
        SELECT conv_id, i, n0, n1, least(n2, {more('n0', 2, 'I')}, {more('n1', 2, 'I')}, {more('n3', 2, 'I')}), least(n3, {more('n2', 2, 'I')}, {more('n0', 4, 'II')}, {more('n1', 4, 'II')})
        FROM (SELECT dp.conv_id, g.i, {more('k0', 3, 'D')} AS n0, least({more('k1', 3, 'D')}, CASE WHEN NOT must AND r = 's' THEN {more('k0', 'cut::INT', 'K')} END) AS n1,
                     least({more('k2', 3, 'D')}, {stay('k0', 'u')}, {stay('k1', 'u')}, {stay('k3', 'u')}) AS n2, least({more('k3', 3, 'D')}, {stay('k2', 'a')}) AS n3
              FROM dp JOIN g ON g.conv_id IS NOT DISTINCT FROM dp.conv_id AND g.i = dp.i + 1)),
      best AS (SELECT conv_id, left(m, 6)::BIGINT AS cost, substring(m, 7) AS audit FROM (SELECT conv_id, arg_max(least(k0, k3), i) AS m FROM dp GROUP BY conv_id)),
      letters AS (SELECT conv_id, p, substring(audit, p::INT, 1) AS e FROM best, range(1, length(audit) + 1) t(p)),
      placed AS (SELECT *, sum((e <> 'I')::INT) OVER w AS i, sum((e <> 'D')::INT) OVER w - 1 AS j FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
      turns AS (SELECT l.conv_id, l.p, l.e, l.j, g.r, g.role, g.text, max((l.j = 0 AND l.e = 'K' AND g.r = 's')::INT) OVER (PARTITION BY l.conv_id) AS led
                FROM placed l LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM l.conv_id AND g.i = l.i AND l.e <> 'I' WHERE l.e <> 'D'),
      texts AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (j - led) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p) AS text FROM turns GROUP BY conv_id),
      faults AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE repeat AND NOT blank) AS duplicate,
                        count(*) FILTER (WHERE cut) AS truncated, count(*) FILTER (WHERE two NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id)
      SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit, sha256(coalesce(t.text, '')) AS repaired_sha256
      FROM best b LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM b.conv_id"""
