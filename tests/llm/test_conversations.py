"""Repair of conversations, against a search over all edit sequences."""

import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eocatalog.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """The least (cost, audit) and the initials of roles, over all sequences of edits with at most len + 2 insertions.

    rows: (initial of role, must go, cut off).
    """
    found = []
    shortest = {}

    def go(k, cost, audit, roles, left):
        if not re.fullmatch("s?(ua)*u?", roles) or cost > 3 * len(rows) + 1:
            return
        key = (k, roles)  # the same place by the same roles: what follows is the same
        if key in shortest and shortest[key] <= (cost, audit):
            return
        shortest[key] = (cost, audit)
        if k == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            found.append((cost, audit, roles))
        if left:
            for x in "ua":
                go(k, cost + 2, audit + "I", roles + x, left - 1)
        if k < len(rows):
            initial, must_go, cut_off = rows[k]
            go(k + 1, cost + 3, audit + "D", roles, left)
            if not must_go:
                go(k + 1, cost + cut_off, audit + "K", roles + (initial or "?"), left)
                for x in "ua":
                    go(k + 1, cost + cut_off + 2, audit + "R", roles + x, left)

    go(0, 0, "", "", len(rows) + 2)
    return min(found)


def judged(rows):
    """Rows in order (turn, role, text) with the first fault of each."""
    out, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def expected(rows):
    """What the query returns for one conversation's rows after damage, in any order."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    faults = judged(rows)
    cost, audit, _ = cheapest([(r[1][:1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(rows, faults, strict=True)]) if rows else (0, "", "")
    lines, left, turn = [], iter(rows), 0
    for x in audit:
        row = None if x == "I" else next(left)
        if x == "D":
            continue
        if x == "K":
            lines.append(f"{row[1]}:{row[2]}")
            turn = 0 if row[1][:1] == "s" else 1 - turn
        else:
            lines.append(f"{('user', 'assistant')[turn]}:{row[2] if row else ''}")
            turn = 1 - turn
    turns = {r[0] for r in rows if r[0] is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = out.setdefault(conv, [])
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


SYMBOLS = st.text("suaxSUA-", max_size=6)


@settings(max_examples=250, deadline=None)
@given(SYMBOLS)
def test_parser_finds_the_cheapest_edits(symbols):
    rows = [("?" if x.lower() in "x-" else x.lower(), x == "-", x.isupper()) for x in symbols]
    assert cr.least(symbols) == cheapest(rows)[:2]


@settings(max_examples=60, deadline=None)
@given(st.text("suaxSUA-", min_size=1, max_size=40), st.integers(1, 9))
def test_blocks_give_what_the_whole_gives(symbols, size):
    blocks = [cr.matrix(symbols[at : at + size]) for at in range(0, len(symbols), size)]
    assert cr.put_together(blocks) == cr.least(symbols)


def test_a_long_chart_stays_narrow():
    rng = random.Random(5)
    symbols = "".join(rng.choice("uauauas-UX") for _ in range(3000))
    cost, audit = cr.least(symbols)
    assert len(audit.replace("I", "")) == len(symbols) and cost > 0


def conversations(seed=1, n=150):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", " \t", "", "Well .  ", "ok.\n", "\xa0", "É."]
    out = []
    for conv in range(n):
        for turn in range(rng.randint(1, 6)):
            out.append((conv, rng.choice([turn, turn, turn, turn * 2, None]), rng.choice(["user", "assistant", ("user", "assistant")[turn % 2], "system", "tool", "", None, "ux"]), rng.choice([*texts, None])))
    return out + [(None, 0, "user", "Hi."), (None, 1, "assistant", "Ho."), (7, None, None, None), *[(n, 0, "user", "Same.")] * 3]


@pytest.mark.parametrize("long_rows", [cr.LONG_ROWS, 3])
def test_query_rows(spark, long_rows):
    """long_rows 3 sends most conversations through blocks, of two rows each."""
    rows = conversations()
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = cr.digests(cr.repair(cr.damage(table), "dropped", long_rows=long_rows, block_rows=2))
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = {r[0]: tuple(r[1:]) for r in out.collect()}
    want = {conv: expected(own) for conv, own in damaged(rows).items()}
    assert len(got) == len(want)
    assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}


def test_messages_and_other_columns(spark):
    rows = [(1, 0, "user", "A?", 5, "x"), (1, 1, "user", "B?", 5, "x"), (1, 2, "assistant", "C.", None, None)]
    row = cr.repair(spark.createDataFrame(rows, SCHEMA + ", cost int, audit string")).collect()
    assert [(r.conv_id, r.cost, r.audit, r.illegal) for r in row] == [(1, 2, "KIKK", 1)]
    assert [(m.edit, m.role, m.text) for m in row[0].repaired] == [("K", "user", "A?"), ("I", "assistant", ""), ("K", "user", "B?"), ("K", "assistant", "C.")]


def test_empty_and_absent(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert cr.digests(cr.repair(cr.damage(none), "dropped")).count() == 0
    gone = spark.createDataFrame([(4, 0, "user", "x.", True)], SCHEMA + ", gone boolean")
    for long_rows in (10, 0):
        r = cr.digests(cr.repair(gone, "gone", long_rows=long_rows)).collect()
        assert [tuple(x) for x in r] == [(4, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_a_megabyte_text_and_a_very_long_conversation(spark):
    long = "word " * 250_000 + "end."
    rows = [(1, 0, "user", long), (1, 1, "assistant", "Fine.")]
    r = cr.digests(cr.repair(spark.createDataFrame(rows, SCHEMA))).first()
    assert r.repaired_sha256 == hashlib.sha256(f"user:{long}\nassistant:Fine.".encode()).hexdigest()
    table = spark.range(30_001).select(F.lit(9).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("Turn "), (F.col("id") % 20_000).cast("string"), F.lit(".")).alias("text"))
    out = cr.repair(table, long_rows=5000)
    assert out.count() > 50
    r = cr.digests(out).collect()
    assert len(r) == 1 and r[0].duplicate == 10_001 and r[0].gaps == 0
    kept = [f"{('user', 'assistant')[i % 2]}:Turn {i}." for i in range(20_000)]
    assert r[0].audit == "K" * 20_000 + "D" * 10_001 and r[0].cost == 3 * 10_001
    assert r[0].repaired_sha256 == hashlib.sha256("\n".join(kept).encode()).hexdigest()
