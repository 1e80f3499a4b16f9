"""Conversation structure repair: rows damaged on purpose, faults found, and the least edits
that give roles s?(ua)+ (or none), by bidirectional Dijkstra (``lattice``).

Defined results: null roles and texts are one space; a null turn stands first;
rows of a null conv_id are one conversation; rows of one turn are ordered by role and text; a repeated row is a
duplicate fault; a role without a first character can be deleted or renamed, not kept;
extra columns are not read; an empty table gives an empty result.

A conversation of at most ``max_rows`` rows is solved in one piece.  A longer one is
cut into blocks; each block is solved for every pair of states at its ends, the
pieces are chained (states only, in order), and each block is repaired along the states chosen,
so no task holds the rows of a long conversation, only its audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroseries.llm import lattice
from hydroseries.llm.common import cut
from hydroseries.llm.sqlparts import CRC_TABLE, crc32
from hydroseries.llm.turns import ORDER, gathered, joined_sha256, placed

COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that crc32(conv_id:turn) mod 20 names."""
    space = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", space(F.col("role")).alias("role"), space(F.col("text")).alias("text"))
    code = F.pmod(F.crc32(F.concat(space(F.col("conv_id")), F.lit(":"), space(F.col("turn"))).cast("binary")), F.lit(20))
    return (rows.withColumn("_code", code).where("_code <> 0")
            .withColumn("_copy", F.explode(F.when(F.col("_code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
            .select("conv_id", "turn", F.when(F.col("_code") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(F.col("_code") == 1, "").when(F.col("_code") == 2, F.regexp_replace("text", "[.!?]", ""))
                    .otherwise(F.col("text")).alias("text")))


def faults(text: Column) -> Column:
    """blank, truncated or null by the text alone."""
    last = F.regexp_extract(text, r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return F.when(last == "", "blank").when(~last.isin(".", "!", "?"), "truncated")


def with_faults(rows: list[dict]) -> list[tuple[int | None, str, str, str | None]]:
    """(turn, role, text, fault) of sorted rows; ``again`` (long conversations) tells whether role and text came earlier."""
    seen, out = set(), []
    for r in rows:
        again = (r["role"], r["text"]) in seen if r["again"] is None else r["again"]
        seen.add((r["role"], r["text"]))
        out.append((r["turn"], r["role"], r["text"], r["fault"] if r["fault"] == "blank" or not again else "duplicate"))
    return out


def counted(rows) -> dict:
    """What a block adds: its faults, illegal neighbours and turns."""
    initials = [r[1][:1] for r in rows]
    got = {k: sum(r[3] == k for r in rows) for k in ("blank", "duplicate", "truncated")}
    turns = [r[0] for r in rows if r[0] is not None]
    return got | {"illegal": sum(p not in LEGAL for p in zip(initials, initials[1:])), "first": initials[0], "last": initials[-1],
                  "low": min(turns, default=None), "high": max(turns, default=None), "turns": len(set(turns))}


def _gaps(low, high, turns) -> int:
    return 0 if low is None else high - low + 1 - turns


def _arrow(fn, names, kinds):
    """mapInArrow over rows as dicts; ``fn`` is a generator over an iterator of rows."""
    def run(batches):
        import pyarrow as pa
        out = []
        emit = lambda: pa.RecordBatch.from_arrays(
            [pa.array([r[c] for r in out], type=t) for c, t in zip(names, kinds)], names=names)
        for row in fn(r for b in batches for r in _rows(b)):
            out.append(row)
            if len(out) >= 500:
                yield emit()
                out.clear()
        if out:
            yield emit()
    return run


def _rows(batch):
    for i in range(batch.num_rows):  # one row at a time as Python objects
        yield batch.slice(i, 1).to_pylist()[0]


def mapped(df: DataFrame, fn, schema: str) -> DataFrame:
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type
    kind = T.StructType.fromDDL(schema)
    return df.mapInArrow(_arrow(fn, kind.names, [to_arrow_type(f.dataType) for f in kind]), kind)


def whole(rows):
    """A short conversation: counts, cost, audit and hash in one step."""
    import hashlib
    for r in rows:
        turns = with_faults(r["rows"])
        c = counted(turns)
        cost, audit = lattice.search([(t[1][:1], t[3]) for t in turns])
        text = "\n".join(lattice.repaired([(t[1], t[2]) for t in turns], audit))
        yield c | {"conv_id": r["conv_id"], "gaps": _gaps(c["low"], c["high"], c["turns"]), "cost": cost, "audit": audit,
                   "repaired_sha256": hashlib.sha256(text.encode()).hexdigest()}


BLOCK = ("conv_id long, block long, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, "
         "high long, turns long, ways array<struct<start: int, end: int, cost: long, audit: string>>")


def solved(rows):
    """A block of a long conversation: counts and the least edits between every two states."""
    for r in rows:
        turns = with_faults(r["rows"])
        steps = [(t[1][:1], t[3]) for t in turns]
        ways = [(p, q, lattice.search(steps, p, (q,))) for p in range(lattice.STATES) for q in range(lattice.STATES)]
        yield counted(turns) | {"conv_id": r["conv_id"], "block": r["block"],
                                "ways": [{"start": p, "end": q, "cost": w[0], "audit": w[1]} for p, q, w in ways if w]}


CHAIN = ("conv_id long, block long, start int, piece string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long")


def chained(rows):
    """Blocks sorted by conv_id and block -> one row per block with the state it starts
    in and its audit, and one row with a null block and the sums per conversation."""
    import itertools
    for conv, group in itertools.groupby(rows, key=lambda r: r["conv_id"]):
        # per state: cost and the chain of choices (block, start, audit) behind it; ties by the whole audit so far
        labels = {lattice.BEGIN: (0, "", None)}
        total = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        low = high = last = None
        for b in group:
            new = {}
            for w in b["ways"]:
                if w["start"] in labels:
                    cost, audit, chain = labels[w["start"]]
                    got = (cost + w["cost"], audit + w["audit"], (b["block"], w["start"], w["audit"], chain))
                    if w["end"] not in new or got[:2] < new[w["end"]][:2]:
                        new[w["end"]] = got
            labels = new
            for k in total:
                total[k] += b[k]
            total["illegal"] += last is not None and (last, b["first"]) not in LEGAL
            total["turns"] -= b["low"] is not None and b["low"] == high  # a turn that goes on from the block before
            low, high, last = b["low"] if low is None else low, high if b["high"] is None else b["high"], b["last"]
        cost, _, chain = min(labels[q] for q in lattice.ACCEPT if q in labels)
        turns = total.pop("turns")
        yield {"conv_id": conv, "block": None, "start": None, "piece": None, "gaps": _gaps(low, high, turns), "cost": cost} | total
        while chain:
            block, start, audit, chain = chain
            yield dict.fromkeys(COUNTS) | {"conv_id": conv, "block": block, "start": start, "piece": audit}


def rebuilt(rows):
    for r in rows:
        lines = lattice.repaired([(t["role"], t["text"]) for t in r["rows"]], r["piece"], r["start"])
        yield {"conv_id": r["conv_id"], "block": r["block"], "repaired_sha256": "\n".join(lines) if lines else None}


def solve_long(long: DataFrame) -> DataFrame:
    """Result rows of the long conversations, from their rows with ``block`` and ``pos``."""
    firsts = long.groupBy("conv_id", "role", "text").agg(F.min("pos").alias("pos")).select("pos", F.lit(False).alias("_not_again"))
    marked = long.join(firsts, "pos", "left").withColumn("again", F.col("_not_again").isNull())
    blocks = cut(gathered(marked.withColumn("fault", faults(F.col("text"))), ["fault", "again"]))
    by_order = lambda df: df.repartition("conv_id").sortWithinPartitions("conv_id", "block")
    chain = cut(mapped(by_order(mapped(blocks, solved, BLOCK)), chained, CHAIN))
    pieces = chain.where("block IS NOT NULL").select(F.col("conv_id").alias("_conv"), F.col("block").alias("_block"), "start", "piece")
    here = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block"))
    joined = blocks.join(pieces, here).select("conv_id", "block", "rows", "start", "piece")
    lines = mapped(joined, rebuilt, "conv_id long, block long, repaired_sha256 string")
    hashes = joined_sha256(lines, ["repaired_sha256"], "\n")
    audits = (pieces.groupBy("_conv").agg(F.sort_array(F.collect_list(F.struct("_block", "piece"))).alias("p"))
              .select(F.col("_conv"), F.array_join(F.col("p.piece"), "").alias("audit")))
    sums = chain.where("block IS NULL").select("conv_id", *COUNTS)
    same = F.col("conv_id").eqNullSafe(F.col("_conv"))
    return (sums.join(audits, same).drop("_conv").join(hashes.withColumnRenamed("conv_id", "_conv"), same)
            .select("conv_id", *COUNTS, "audit", "repaired_sha256"))


def repair(rows: DataFrame, max_rows: int = 256) -> DataFrame:
    """Result rows of every conversation that has a row in ``rows`` (conv_id, turn, role, text without nulls in the last two)."""
    short, long = placed(rows.select("conv_id", *ORDER), max_rows)
    short = short.withColumns({"fault": faults(F.col("text")), "again": F.lit(None).cast("boolean")})
    out = mapped(gathered(short, ["fault", "again"]), whole, RESULT)
    return out if long is None else out.unionByName(solve_long(long))


def repair_damaged(turns: DataFrame, max_rows: int = 256) -> DataFrame:
    """Damage and repair of every conv_id of ``turns``; one whose rows are all dropped has zeros and an empty audit."""
    found = repair(damaged(turns), max_rows).withColumnRenamed("conv_id", "_conv")
    ids = turns.select("conv_id").distinct()
    joined = ids.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in COUNTS}
    return joined.select("conv_id", *[v.alias(c) for c, v in zero.items()], F.coalesce("audit", F.lit("")).alias("audit"),
                         F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def _oracle() -> str:
    """The same by dynamic programming over rows: per state one text, eight digits of cost and the audit."""
    step = lambda x, cost, letter: f"lpad((left({x}, 8)::BIGINT + {cost})::VARCHAR, 8, '0') || substr({x}, 9) || '{letter}'"
    ins = lambda x: step(x, 3, "I")
    use = lambda x, i: (f"CASE WHEN bad THEN NULL WHEN ini = '{i}' THEN {step(x, 'late', 'K')} "  # noqa: E731
                        f"ELSE {step(x, 'late + 3', 'R')} END")
    return rf"""
WITH RECURSIVE {CRC_TABLE},
d AS (SELECT c.*, ({crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20)::INT AS code
      FROM conversations c, crc_table),
e AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE coalesce("role", ' ') END AS r,
             CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce("text", ' '), '[.!?]', '', 'g') ELSE coalesce("text", ' ') END AS x,
             unnest(CASE WHEN code = 3 THEN [0, 1] ELSE [0] END) AS k
      FROM d WHERE code <> 0),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, x, k) AS i,
             left(r, 1) AS ini, right(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g'), 1) AS tail FROM e),
f2 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, r, x ORDER BY i) AS nth FROM f),
g AS (SELECT *, tail = '' AS blank, tail <> '' AND nth > 1 AS dup, tail <> '' AND nth = 1 AND tail NOT IN ('.', '!', '?') AS trunc,
             lag(ini) OVER (PARTITION BY conv_id ORDER BY i) || ini AS pair FROM f2),
sums AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (trunc) AS truncated,
                count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY conv_id),
dp AS (
  SELECT conv_id, 0::BIGINT AS i, '00000000' AS b, NULL::VARCHAR AS s, NULL::VARCHAR AS u, NULL::VARCHAR AS a FROM sums
  UNION ALL
  SELECT conv_id, i, {step('b', 4, 'D')}, least({step('s', 4, 'D')}, CASE WHEN ini = 's' AND NOT bad THEN {step('b', 'late', 'K')} END),
         least({step('u2', 4, 'D')}, {use('least(b, s, a1)', 'u')}), least({step('a1', 4, 'D')}, {use('u2', 'a')})
  FROM (SELECT *, least(u1, {ins('a1')}) AS u2 FROM (SELECT *, least(a, {ins('u1')}) AS a1
        FROM (SELECT dp.conv_id, g.i, b, s, a, least(u, {ins('least(b, s, a)')}) AS u1, ini, blank OR dup AS bad,
                     CASE WHEN trunc THEN 3 ELSE 0 END AS late
              FROM dp JOIN g ON g.conv_id IS NOT DISTINCT FROM dp.conv_id AND g.i = dp.i + 1)))),
best AS (SELECT conv_id, least(b, least(a, {ins(f"least(u, {ins('least(b, s, a)')})")})) AS w FROM dp SEMI JOIN sums
         ON dp.conv_id IS NOT DISTINCT FROM sums.conv_id AND dp.i = sums.n),
letters AS (SELECT conv_id, unnest(string_split(substr(w, 9), '')) AS c, generate_subscripts(string_split(substr(w, 9), ''), 1) AS p FROM best),
placed AS (SELECT *, count(*) FILTER (c <> 'I') OVER o AS i, count(*) FILTER (c <> 'D') OVER o AS m FROM letters WHERE c <> ''
           WINDOW o AS (PARTITION BY conv_id ORDER BY p)),
lines AS (SELECT q.conv_id, q.p, q.c, q.m, g.r, g.x,
                 max(CASE WHEN q.c = 'K' AND g.ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY q.conv_id) AS sys
          FROM placed q LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM q.conv_id AND g.i = q.i AND q.c <> 'I'),
said AS (SELECT conv_id, string_agg(CASE WHEN c = 'K' THEN r WHEN (m - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
                                    CASE WHEN c = 'I' THEN '' ELSE x END, chr(10) ORDER BY p) AS body
         FROM lines WHERE c <> 'D' GROUP BY conv_id)
SELECT k.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(left(w, 8)::BIGINT, 0) AS cost,
       coalesce(substr(w, 9), '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN sums ON k.conv_id IS NOT DISTINCT FROM sums.conv_id
LEFT JOIN best ON k.conv_id IS NOT DISTINCT FROM best.conv_id LEFT JOIN said ON k.conv_id IS NOT DISTINCT FROM said.conv_id
"""


ORACLE = _oracle()
