"""Conversation structure repair by signature deduplication.

A conversation becomes a signature: one letter a row, in order, for what the row's role begins with and for its first fault.
Each distinct signature is solved once: the cheapest edits after which the role initials read `(s?(ua)+)?`.  The solution (the
audit) is joined back to the conversations and replayed on their rows.

How it is dealt: the signatures are made from narrow rows (a digest stands for the text), the texts are shuffled once, for the
replay.  Both passes stream over rows sorted within a task, so a conversation of any length costs its task one letter a
row, never its texts.  Signatures that many conversations share are combined before the shuffle, and joined back by a
broadcast of checked size or else by a shuffle join whose large partitions Spark may split.

Edits: K keep (0), R give the role user or assistant (2), D delete (3; the only one for blank and duplicate rows), I insert an
empty row of user or assistant (2); a truncated row that stays costs 1 more.  At each point of the grammar one of user and
assistant alone can follow, so the letters say the whole repair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilmill.llm.common import cut

#: Letters of a signature: 4 * fault + role from "A" on; any other role is the last.
ROLES = "sua"
FAULTS = ("none", "truncated", "blank", "duplicate")
LEGAL = {"su", "ua", "au"}
#: Solved signatures are broadcast up to so many bytes, else joined by a shuffle.
BROADCAST_BYTES = 8 << 20

# Points of the grammar: nothing yet, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
GIVEN = {USER: "user", ASSISTANT: "assistant"}
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
#: Costs of what is left at each point when no row is left: u lacks its a, s lacks both.
ENDS = (0, 2 * INSERT, INSERT, 0)
#: Letters of a signature that are solved together.
PIECE = 64
LARGEST = (1 << 63) - 1

SIGNATURE = pa.schema([("conv_id", pa.int64()), ("gaps", pa.int64()), ("signature", pa.string())])
SOLVED = pa.schema([("signature", pa.string()), *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())])
HASHED = pa.schema([("conv_id", pa.int64()), ("repaired_rows", pa.int64()), ("repaired_sha256", pa.string())])
REPAIRED = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])

NON_BLANK = r"[^\x20\x09-\x0D]"


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped): the rows after seeded damage; a dropped row stays, marked, so that no conversation is lost.

    crc32 of `conv_id:turn`, modulo 20: 0 drops the row, 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 makes it a user's.
    Nulls are read as one space; a null turn and a null conv_id stay null.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    way = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(way == 1, F.lit("")).when(way == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    role = F.when(way == 4, F.lit("user")).otherwise(said("role"))
    times = F.when(way == 3, F.lit(2)).otherwise(F.lit(1))
    found = rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"),
        (way == 0).alias("dropped"), F.explode(F.array_repeat(F.lit(1), times)).alias("one"),
    )
    return found.drop("one")


def _digest() -> Column:
    return F.unhex(F.sha2(F.col("text").cast("binary"), 256))


def signatures(damaged: DataFrame) -> DataFrame:
    """(conv_id, gaps, signature) of every conversation; rows in order of turn (null first), then role and the text's SHA-256."""
    initial = F.substring("role", 1, 1)
    role = F.lit(len(ROLES))
    for i, letter in enumerate(ROLES):
        role = F.when(initial == letter, i).otherwise(role)
    blank = ~F.rlike("text", F.lit(NON_BLANK))
    ended = F.rlike("text", F.lit(r"[.!?][\x20\x09-\x0D]*\z"))
    narrow = damaged.select(
        "conv_id", "turn", "role", "dropped", role.alias("kind"), blank.alias("blank"), ended.alias("ended"), F.when(~F.col("dropped"), _digest()).alias("digest"),
    )
    # One exchange by conv_id serves both sorts.
    dealt = narrow.repartition("conv_id")
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy(F.col("turn").asc_nulls_first()))
    fault = F.when(F.col("blank"), FAULTS.index("blank")).when(F.col("seen") > 1, FAULTS.index("duplicate")).when(~F.col("ended"), FAULTS.index("truncated")).otherwise(0)
    letters = dealt.withColumn("seen", seen).select(
        "conv_id", "turn", "role", "digest", "seen", F.when(~F.col("dropped"), F.char(F.lit(65) + 4 * fault + F.col("kind"))).alias("letter")
    )
    letters = letters.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "digest", "seen")
    return letters.select("conv_id", "turn", "letter").mapInArrow(_spell, "conv_id bigint, gaps bigint, signature string")


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and order to one row a conversation."""
    conv, letters, turns, least, last = (), [], 0, 0, None  # conv (): none yet
    done: list = []

    def close() -> None:
        if conv != ():
            done.append((conv, min(LARGEST, last - least + 1 - turns) if turns else 0, "".join(letters)))

    for batch in batches:
        for key, turn, letter in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "letter"))):
            if key != conv:
                close()
                conv, letters, turns, last = key, [], 0, None
            if letter is None:  # a dropped row only keeps its conversation known
                continue
            letters.append(letter)
            if turn is not None and turn != last:
                least, last, turns = (least if turns else turn), turn, turns + 1
        yield from _batches(done, SIGNATURE)
        done = []
    close()
    yield from _batches(done, SIGNATURE)


def _batches(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.record_batch([pa.array(column, field.type) for column, field in zip(zip(*rows), schema)], schema=schema)


# The solver.  Costs at a point of the grammar are those of the cheapest edits of all rows from here on.  Among edits of equal
# cost the letters that sort first win; from one point two different first edits always have different letters, so
# comparing the first is enough.


def _choices(letter: str, after: tuple) -> list[list[tuple[int, str, int]]]:
    """For each point, (cost, edit, next point) of the row's own edits, the best first."""
    fault, role = divmod(ord(letter) - 65, 4)
    found = []
    for point in range(4):
        options = [(DELETE + after[point], "D", point)]
        if FAULTS[fault] not in ("blank", "duplicate"):
            more = TRUNCATED * (FAULTS[fault] == "truncated")
            target = FOLLOWS[point]
            options.append((REROLE + more + after[target], "R", target))
            if role == 0 and point == START:
                options.append((more + after[SYSTEM], "K", SYSTEM))
            elif (role, target) in ((1, USER), (2, ASSISTANT)):
                options.append((more + after[target], "K", target))
        found.append(sorted(options))
    return found


@lru_cache(1 << 16)
def _costs(signature: str, after: tuple) -> tuple:
    """Costs before `signature`, when those after it are `after`; halves are solved by the same function and remembered."""
    n = len(signature)
    if n > 1:
        return _costs(signature[: n // 2], _costs(signature[n // 2 :], after))
    own = [options[0][0] for options in _choices(signature, after)]
    # One insertion leads to the point that follows; a second one is of use only where the first ends after u.
    user, assistant = min(own[USER], INSERT + own[ASSISTANT]), min(own[ASSISTANT], INSERT + own[USER])
    return min(own[START], INSERT + user), min(own[SYSTEM], INSERT + user), user, assistant


def _edits(signature: str, after: tuple, point: int) -> tuple[str, int]:
    """The edits of `signature` from a point on, and the point where they end."""
    n = len(signature)
    if n > 1:
        left, point = _edits(signature[: n // 2], _costs(signature[n // 2 :], after), point)
        right, point = _edits(signature[n // 2 :], after, point)
        return left + right, point
    best, choices, written = _costs(signature, after), _choices(signature, after), ""
    while True:
        cost, edit, target = choices[point][0]
        inserted = INSERT + best[FOLLOWS[point]]
        if (cost, edit) < (inserted, "I"):
            return written + edit, target
        written, point = written + "I", FOLLOWS[point]


def solve(signature: str) -> tuple[int, str]:
    """The least cost and its edits."""
    pieces = [signature[i : i + PIECE] for i in range(0, len(signature), PIECE)]
    after = [ENDS]  # of each piece from the right, less the least, so that equal pieces are solved once
    for piece in reversed(pieces[1:]):
        costs = _costs(piece, after[-1])
        after.append(tuple(c - min(costs) for c in costs))
    edits, point = [], START
    for piece, ends in zip(pieces, reversed(after)):
        made, point = _edits(piece, ends, point)
        edits.append(made)
    written = "".join(edits) + "I" * (ENDS[point] // INSERT)
    return _price(signature, written), written


def _price(signature: str, edits: str) -> int:
    cost, at = 0, iter(signature)
    for edit in edits:
        if edit == "I":
            cost += INSERT
            continue
        fault = FAULTS[(ord(next(at)) - 65) // 4]
        cost += {"K": 0, "R": REROLE, "D": DELETE}[edit] + (TRUNCATED if fault == "truncated" and edit != "D" else 0)
    return cost


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for s in batch.column("signature").to_pylist():
            codes = [ord(c) - 65 for c in s]
            faults, roles = [FAULTS[c // 4] for c in codes], [(ROLES + "?")[c % 4] for c in codes]
            illegal = sum(a + b not in LEGAL for a, b in zip(roles, roles[1:]))
            rows.append((s, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, *solve(s)))
        yield from _batches(rows, SOLVED)


def audits(found: DataFrame) -> DataFrame:
    """found (conv_id, gaps, signature) with blank, duplicate, truncated, illegal, cost and audit of each signature, solved once."""
    distinct = found.select("signature").distinct()
    solved = cut(distinct.mapInArrow(_solved, "signature string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"))
    size = solved.agg(F.sum(F.length("signature") + F.length("audit") + 80)).first()[0] or 0
    return found.join(F.broadcast(solved) if size <= BROADCAST_BYTES else solved, "signature")


class Replay:
    """Applies a conversation's edits to its rows as they come; gives the repaired (role, text) rows."""

    def __init__(self, edits: str):
        self.edits, self.at, self.point = edits, 0, START

    def _inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            self.at += 1
            self.point = FOLLOWS[self.point]
            yield GIVEN[self.point], ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self._inserted()
        edit = self.edits[self.at]
        self.at += 1
        if edit == "R":
            self.point = FOLLOWS[self.point]
            yield GIVEN[self.point], text
        elif edit == "K":
            self.point = SYSTEM if role[0] == "s" else FOLLOWS[self.point]
            yield role, text

    def close(self) -> Iterator[tuple[str, str]]:
        yield from self._inserted()


class Hashes:
    """What a replay leaves of a conversation: the number of its rows and their hash."""

    schema = HASHED

    def __init__(self, conv: int | None):
        self.conv, self.n, self.sha = conv, 0, hashlib.sha256()

    def row(self, role: str, text: str) -> None:
        self.sha.update((b"\n" if self.n else b"") + f"{role}:{text}".encode())
        self.n += 1

    def close(self) -> list[tuple]:
        return [(self.conv, self.n, self.sha.hexdigest())]


class Rows:
    """The repaired rows themselves."""

    schema = REPAIRED

    def __init__(self, conv: int | None):
        self.conv, self.n, self.made = conv, 0, []

    def row(self, role: str, text: str) -> None:
        self.made.append((self.conv, self.n, role, text))
        self.n += 1

    def close(self) -> list[tuple]:
        made, self.made = self.made, []
        return made


def _replayed(keeper):
    """A function for mapInArrow over rows sorted so that the audit of a conversation stands before its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = kept = None
        done: list = []

        def close() -> None:
            if replay:
                for made in replay.close():
                    kept.row(*made)
                done.extend(kept.close())

        for batch in batches:
            for conv, audit, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text"))):
                if audit is not None:
                    close()
                    replay, kept = Replay(audit), keeper(conv)
                else:
                    for made in replay.row(role, text):
                        kept.row(*made)
            if kept and keeper is Rows:  # a long conversation is not held
                done.extend(kept.close())
            yield from _batches(done, keeper.schema)
            done = []
        close()
        yield from _batches(done, keeper.schema)

    return run


def _beside_audits(damaged: DataFrame, audited: DataFrame) -> DataFrame:
    """Rows and audits by conversation: the audit first, then the rows in order."""
    nothing = F.lit(None).cast("string")
    rows = damaged.where(~F.col("dropped")).select("conv_id", F.lit(1).alias("part"), nothing.alias("audit"), "turn", "role", "text", _digest().alias("digest"))
    heads = audited.select("conv_id", F.lit(0).alias("part"), "audit", F.lit(None).cast("bigint").alias("turn"), nothing.alias("role"), nothing.alias("text"), F.lit(None).cast("binary").alias("digest"))
    dealt = rows.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "part", F.col("turn").asc_nulls_first(), "role", "digest")
    return dealt.select("conv_id", "audit", "role", "text")


def _audited(damaged: DataFrame) -> DataFrame:
    return cut(audits(cut(signatures(damaged))))


def repaired(damaged: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the rows after repair, turns from 0; a conversation of which nothing is left has none.

    `damaged` has the columns that `damage` gives.  Any role but one that begins with s, u or a is to be given anew or deleted.
    """
    return _beside_audits(damaged, _audited(damaged)).mapInArrow(_replayed(Rows), "conv_id bigint, turn bigint, role string, text string")


def repair_report(damaged: DataFrame) -> DataFrame:
    """One row a conversation: gaps, faults, cost, audit, number and SHA-256 of the repaired rows.

    Empty tables give no row; a conversation of dropped rows alone gives zeros, an empty audit and the hash of nothing.  A null
    conv_id is a conversation.  Rows that are equal in turn are taken by role and SHA-256 of the text; repeated rows are duplicates.
    """
    audited = _audited(damaged)
    hashes = _beside_audits(damaged, audited).mapInArrow(_replayed(Hashes), "conv_id bigint, repaired_rows bigint, repaired_sha256 string")
    other = hashes.withColumnRenamed("conv_id", "_conv")
    return audited.join(other, audited["conv_id"].eqNullSafe(other["_conv"])).drop("_conv")


#: The report in DuckDB: CRC by its table, edits by recursion from the last row to the first over (cost, edits) at four points.
ORACLE_SQL = r"""
with recursive crc(i, k, c) as (
  select i, 0, i from range(256) t(i)
  union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from crc where k < 8
), lookup as (
  select list(c order by i) as t from crc where k = 8
), marked as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         xor(list_reduce([4294967295::bigint] || list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ord(x)::bigint),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 as way
  from conversations, lookup
), damaged as (
  select conv_id, turn, case when way = 4 then 'user' else role end as role,
         case way when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from (select *, unnest(case when way = 3 then [1, 2] else [1] end) from marked where way <> 0)
), numbered as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text)) as nth, count(*) over (partition by conv_id) as n_rows,
         substring(role, 1, 1) as initial
  from damaged
), seen as (
  select *, row_number() over (partition by conv_id, role, text order by nth) as times from numbered
), judged as (
  select *, lag(initial) over (partition by conv_id order by nth) as before,
         case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank' when times > 1 then 'duplicate'
              when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 'truncated' else 'none' end as fault
  from seen
), counted as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
         count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
         count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) as illegal
  from judged group by conv_id
), solved(conv_id, nth, none, system, usr, assistant) as (
  select conv_id, n_rows + 1, {'c': 0, 'e': ''}, {'c': 4, 'e': 'II'}, {'c': 2, 'e': 'I'}, {'c': 0, 'e': ''} from judged where nth = 1
  union all
  select conv_id, nth,
         least(o0, {'c': o2.c + 2, 'e': 'I' || o2.e}, {'c': o3.c + 4, 'e': 'II' || o3.e}), least(o1, {'c': o2.c + 2, 'e': 'I' || o2.e}, {'c': o3.c + 4, 'e': 'II' || o3.e}),
         least(o2, {'c': o3.c + 2, 'e': 'I' || o3.e}), least(o3, {'c': o2.c + 2, 'e': 'I' || o2.e})
  from (
    select s.conv_id, j.nth,
           least({'c': none.c + 3, 'e': 'D' || none.e}, {'c': usr.c + (case when stays then 2 + more else 999999 end), 'e': 'R' || usr.e},
                 {'c': usr.c + (case when stays and initial = 'u' then more else 999999 end), 'e': 'K' || usr.e},
                 {'c': system.c + (case when stays and initial = 's' then more else 999999 end), 'e': 'K' || system.e}) as o0,
           least({'c': system.c + 3, 'e': 'D' || system.e}, {'c': usr.c + (case when stays then 2 + more else 999999 end), 'e': 'R' || usr.e},
                 {'c': usr.c + (case when stays and initial = 'u' then more else 999999 end), 'e': 'K' || usr.e}) as o1,
           least({'c': usr.c + 3, 'e': 'D' || usr.e}, {'c': assistant.c + (case when stays then 2 + more else 999999 end), 'e': 'R' || assistant.e},
                 {'c': assistant.c + (case when stays and initial = 'a' then more else 999999 end), 'e': 'K' || assistant.e}) as o2,
           least({'c': assistant.c + 3, 'e': 'D' || assistant.e}, {'c': usr.c + (case when stays then 2 + more else 999999 end), 'e': 'R' || usr.e},
                 {'c': usr.c + (case when stays and initial = 'u' then more else 999999 end), 'e': 'K' || usr.e}) as o3
    from solved s join (select *, fault not in ('blank', 'duplicate') as stays, (fault = 'truncated')::int as more from judged) j
      on s.conv_id is not distinct from j.conv_id and s.nth = j.nth + 1
  )
), audits as (
  select conv_id, none.c as cost, none.e as audit from solved where nth = 1
), letters as (
  select conv_id, i, audit[i] as edit, length(replace(audit[1:i], 'I', '')) as nth, length(replace(audit[1:i], 'D', '')) as made
  from (select *, unnest(range(1, length(audit) + 1)) as i from audits)
), written as (
  select l.*, j.role, coalesce(j.text, '') as text, max((edit = 'K' and initial = 's')::int) over (partition by l.conv_id) as systems
  from letters l left join judged j on j.conv_id is not distinct from l.conv_id and j.nth = l.nth and l.edit <> 'I' where edit <> 'D'
), repaired as (
  select conv_id, count(*) as repaired_rows,
         sha256(string_agg(case when edit = 'K' then role when (made - systems) % 2 = 1 then 'user' else 'assistant' end || ':' || text, chr(10) order by i)) as sha
  from written group by conv_id
), every as (
  select distinct conv_id from conversations
)
select e.conv_id, coalesce(c.gaps, 0) as gaps, coalesce(c.blank, 0) as blank, coalesce(c.duplicate, 0) as duplicate, coalesce(c.truncated, 0) as truncated,
       coalesce(c.illegal, 0) as illegal, coalesce(a.cost, 0)::bigint as cost, coalesce(a.audit, '') as audit, coalesce(r.sha, sha256('')) as repaired_sha256, coalesce(r.repaired_rows, 0) as repaired_rows
from every e left join counted c on e.conv_id is not distinct from c.conv_id left join audits a on e.conv_id is not distinct from a.conv_id
left join repaired r on e.conv_id is not distinct from r.conv_id
"""
