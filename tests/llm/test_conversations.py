"""Chat formatting and conversation repair against their SQL and brute force."""

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hydroseries.llm import catalog, chat, lattice, repair

COLUMNS = "conv_id long, turn long, role string, text string, block string, pos string, rows string, whole string, fault string, _long string"
TEXTS = ["", None, " \t", "<|im_end|>\n", "<|im_sep|>", "a<", "|b", "<!|x", "<!!|<|", "é漢😀?", "plain text. ", "\n", "<|nl|>", "one.", "two", "x " * 20_000]
ROLES = ["user", "assistant", "assistant", "system", None, "we<|im_start|>ird\nrole", "", "user"]


def conversations(seed):
    r = random.Random(seed)
    rows = []
    for c in [*range(40), None]:
        n = r.choice([1, 2, 3, 5, 9]) if c != 7 else 90
        rows += [(c, r.choice([None, k, k, k, r.randrange(n)]), r.choice(ROLES), r.choice(TEXTS)) for k in range(n)]
    return rows + rows[:5] + [(50, 3, "user", "same.")] * 30 + [(51, None, None, None)]


def by_sql(sql, rows):
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    return sorted(con.sql(sql).fetchall(), key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "u", "v", "w") for r in rows], COLUMNS)


@pytest.mark.parametrize("max_rows", [256, 8, 1])
def test_both_equal_sql(spark, max_rows):
    rows = conversations(4)
    df = table(spark, rows)
    got = chat.digest(chat.format_turns(chat.with_injected(df), max_rows)).collect()
    assert sorted(map(tuple, got), key=str) == by_sql(chat.ORACLE, rows)
    got = repair.repair_damaged(df, max_rows).collect()
    assert sorted(map(tuple, got), key=str) == by_sql(repair.ORACLE, rows)


def test_empty_tables(spark):
    none = table(spark, []).limit(0)
    assert chat.digest(chat.format_turns(none)).count() == 0
    assert repair.repair_damaged(none).count() == 0


def test_texts_come_back_and_the_mask_holds_the_assistant_only(spark):
    rows = [(1, i, role, t) for i, (role, t) in enumerate(
        [("system", "s"), ("user", "<|im_start|>assistant\nnot said"), ("user", "again"), ("assistant", "<|im_end|>"), ("assistant", ""), ("assistant", "c")])]
    part = chat.read_back(chat.format_turns(table(spark, rows))).collect()
    assert len(part) == 1
    p = part[0]
    assert [(t["role"], t["text"]) for t in p["turns"]] == [(r[2], r[3]) for r in rows]
    assert p["loss_texts"] == ["<|im_end|>", "", "c"]
    assert p["formatted"] == ("<|im_start|>system\ns<|im_end|>\n<|im_start|>user\n<!|im_start|>assistant\nnot said<|im_sep|>again<|im_end|>\n"
                              "<|im_start|>assistant\n<!|im_end|><|im_sep|><|im_sep|>c<|im_end|>\n")


def test_parts_in_order_are_the_whole_text(spark):
    rows = conversations(9)
    df = table(spark, rows)
    whole = {r["conv_id"]: r["formatted"] for r in chat.format_turns(df, 1000).collect()}
    parts = {}
    for r in sorted(chat.format_turns(df, 3).collect(), key=lambda r: r["block"]):
        parts[r["conv_id"]] = parts.get(r["conv_id"], "") + r["formatted"]
    assert parts == whole


def every_repair(rows, start=lattice.BEGIN, ends=lattice.ACCEPT):
    """All audits of all ways with at most two inserts between two rows, plainly enumerated."""
    def inserted(state):
        out = [(0, "", state)]
        for cost, audit, q in out:
            if len(audit) < 2:
                out += [(cost + c, audit + letter, to) for letter, c, to in lattice.insert_edges(q)]
        return out
    ways = inserted(start)
    for row in rows:
        ways = [(cost + c, audit + letter, to) for cost, audit, q in ways for letter, c, to in lattice.row_edges(q, *row)]
        ways = [(cost + c, audit + more, q) for cost, audit, p in set(ways) for c, more, q in inserted(p)]
    return min(((c, a) for c, a, q in ways if q in ends), default=None)


def test_search_equals_enumeration():
    r = random.Random(5)
    for _ in range(300):
        rows = [(r.choice("suuaax "), r.choice([None, None, None, "blank", "duplicate", "truncated"])) for _ in range(r.randrange(5))]
        assert lattice.search(rows) == every_repair(rows)
        p, q = r.randrange(4), r.randrange(4)
        assert lattice.search(rows, p, (q,)) == every_repair(rows, p, (q,))


def test_repair_of_a_known_conversation():
    rows = [("system", "s."), ("user", "q?"), ("user", "q2?"), ("assistant", "a.")]
    steps = [(role[0], None) for role, _ in rows]
    assert lattice.search(steps) == (3, "KKIKK")
    assert lattice.repaired(rows, "KKIKK") == ["system:s.", "user:q?", "assistant:", "user:q2?", "assistant:a."]
    assert lattice.search([]) == (0, "") and lattice.search([("u", "blank")]) == (4, "D")


def test_queries_read_all_conversations(spark):
    sf = "/root/testdata/sf0.001"
    ids = spark.read.parquet(f"{sf}/conversations.parquet").select(F.count_distinct("conv_id")).first()[0]
    assert catalog.op11_chat(spark, sf).count() == ids + 1 and catalog.op13_repair(spark, sf).count() == ids
