"""Chains against a brute-force walk over small random groups."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from actiontrail.operators.chains import ChainRule, chain_matches, ring_size
from actiontrail.schema import conform, evidence

BASE = datetime(2026, 1, 1, tzinfo=timezone.utc)


def rows_for(seed: int, groups: int = 12, length: int = 70, steps: int = 4):
    rng = random.Random(seed)
    rows, seq = [], 0
    for g in range(groups):
        for _ in range(length):
            seq += rng.randint(1, 3)
            ts = None if rng.random() < 0.1 else (
                BASE + timedelta(seconds=rng.randint(0, 300))).strftime("%Y-%m-%dT%H:%M:%SZ")
            mask = sum(1 << s for s in range(steps) if rng.random() < 0.15)
            # Some ids repeat inside a group; the repeat must not count.
            eid = f"g{g}-{rng.randint(0, length - 1)}" if rng.random() < 0.1 else f"g{g}-s{seq}"
            rows.append((seq, f"g{g}", eid, ts, mask))
    return rows


def brute(rows, rules, ring, capped):
    found = set()
    groups = {}
    for row in sorted(rows):
        groups.setdefault(row[1], []).append(row)
    for name, group in groups.items():
        seen, line = set(), []
        for _, _, eid, ts, mask in group:
            if eid in seen:
                continue
            seen.add(eid)
            when = None if ts is None else datetime.strptime(ts, "%Y-%m-%dT%H:%M:%SZ")
            line.append((len(line), eid, when, mask))
        for rid, n, k, w, cap in rules:
            count = 0
            for pos, eid, when, mask in line:
                if not mask >> (n - 1) & 1:
                    continue
                chain, step = [], 0
                for cpos, ceid, cwhen, cmask in line[max(0, pos - ring):pos]:
                    if step == n - 1:
                        break
                    if not cmask >> step & 1:
                        continue
                    if step == 0:
                        if k and pos - cpos > k - 1:
                            continue
                        if w and (cwhen is None or when is None
                                  or not 0 <= (when - cwhen).total_seconds() <= w):
                            continue
                    chain.append(ceid)
                    step += 1
                if step == n - 1 and (not capped or count < cap):
                    count += 1
                    found.add((rid, (*chain, eid)))
    return found


RULES = [("two", 2, 9, None, 3), ("three", 3, 20, None, 2), ("four", 4, 40, None, 16),
         ("timed", 3, None, 60, 2), ("both", 2, 12, 90, 1)]


@pytest.mark.parametrize("capped", [True, False])
@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed, capped, monkeypatch):
    from actiontrail.operators import chains as C

    # A short look-back makes blocks and slices small enough to be crossed.
    monkeypatch.setattr(C, "MIN_RING", 16)
    rows = rows_for(seed)
    df = spark.createDataFrame(rows, "seq bigint, session_id string, event_id string, "
                                     "timestamp string, diff_bytes bigint")
    df = conform(df.withColumns({
        "source_agent": F.lit("codex"), "source_type": F.lit("hook"),
        "confidence": F.lit("high"), "event_type": F.lit("tool.call"),
        "evidence": evidence("hook")})).withColumn("bits", F.coalesce("diff_bytes", F.lit(0)))
    step = lambda i: F.col("bits").bitwiseAND(F.lit(1 << i)) != 0
    rules = [ChainRule(r, tuple(step(i) for i in range(n)), k, w, cap) for r, n, k, w, cap in RULES]
    got = chain_matches(df, rules, capped=capped, slice_rows=32, block_rows=64)
    found = {(r.rule_id, tuple(r.cited_event_ids)) for r in got.collect()}
    assert found == brute(rows, RULES, ring_size(rules), capped)
    assert len(found) > 20


def step_frame(spark, rows):
    df = spark.createDataFrame(rows, "seq bigint, session_id string, event_id string, timestamp string, diff_bytes bigint")
    return conform(df.withColumns({
        "source_agent": F.lit("codex"), "source_type": F.lit("hook"), "confidence": F.lit("high"), "event_type": F.lit("tool.call"),
        "evidence": evidence("hook")})).withColumn("bits", F.coalesce("diff_bytes", F.lit(0)))


@pytest.mark.parametrize("seed", [3, 4])
def test_time_is_the_only_bound(spark, seed):
    # Groups of more events than the usual look-back, with times out of order.
    rows = rows_for(seed, groups=3, length=700)
    step = lambda i: F.col("bits").bitwiseAND(F.lit(1 << i)) != 0
    for kinds in (RULES, [("t2", 2, None, 60, 16), ("t4", 4, None, 1, 16), ("t3", 3, None, 0.0000001, 3), ("t5", 2, None, 0.000007, 3)]):
        rules = [ChainRule(r, tuple(step(i) for i in range(n)), k, w, cap) for r, n, k, w, cap in kinds]
        got = chain_matches(step_frame(spark, rows), rules, capped=False, slice_rows=32, look_back=None)
        found = [(r.rule_id, tuple(r.cited_event_ids)) for r in got.collect()]
        assert len(found) == len(set(found)) > 20
        assert set(found) == brute(rows, kinds, 10**9, False)


def test_far_back_of_a_busy_user(spark, tmp_path):
    import duckdb

    from __spark_entry__ import oracle_sql, queries

    # 9,000 events of one user in nine days: errors first, then views only, clicks at the end; and a quiet user.
    kinds = ["error"] * 3 + ["view"] * 8_900 + ["click"] * 97
    rows = [(k, BASE.replace(tzinfo=None) + timedelta(seconds=86 * k), 3 if k % 50 else 4, kind, '{"k": 1}') for k, kind in enumerate(kinds)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, props string").write.parquet(
        str(tmp_path / "events.parquet"))
    name = "W8_chain_far_back"
    got = sorted((r.rule_id, r.chain) for r in queries()[name](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    assert got == sorted(con.sql(oracle_sql()[name]).fetchall()) and len(got) > 90


def test_rule_bounds():
    step = F.lit(True)
    with pytest.raises(ValueError):
        ChainRule("x", (step,), 5)
    with pytest.raises(ValueError):
        ChainRule("x", (step, step))
    with pytest.raises(ValueError):
        ChainRule("x", (step, step), 1)
    with pytest.raises(ValueError):
        ChainRule("x", (step, step), 5, max_matches=17)


@pytest.mark.parametrize("seed", range(3))
def test_first_in_range(seed):
    import numpy as np

    from actiontrail.operators.range_first import FirstInRange

    rng = np.random.default_rng(seed)
    for many in [*range(1, 34), 255, 256, 257]:
        times = rng.integers(0, 50, many)
        begin, low = rng.integers(0, many + 2, 100), rng.integers(-5, 55, 100)
        high = low + rng.integers(-2, 10, 100)
        got = FirstInRange(times).ask(begin, low, high)
        want = [next((j for j in range(b, many) if lo <= times[j] <= hi), many) for b, lo, hi in zip(begin, low, high)]
        assert got.tolist() == want


def test_both_bounds_over_a_full_ring(spark):
    """9,000 events of one group, disordered times, 4,096 events back, against a walk."""
    rng = random.Random(11)
    rows = [(seq, "g", f"e{seq}", (BASE + timedelta(seconds=rng.randrange(20_000))).strftime("%Y-%m-%dT%H:%M:%SZ") if rng.random() < 0.95 else None,
             1 if rng.random() < 0.3 else 2 if rng.random() < 0.3 else 0) for seq in range(9_000)]
    events = step_frame(spark, rows)
    rule = ChainRule("r", tuple(F.col("bits").bitwiseAND(bit) != 0 for bit in (1, 2)), 4096, 3.0, 16)
    got = {tuple(r.cited_event_ids) for r in chain_matches(events, [rule], capped=False).collect()}
    seconds = [None if t is None else int((datetime.strptime(t, "%Y-%m-%dT%H:%M:%SZ") - BASE.replace(tzinfo=None)).total_seconds()) for *_, t, _ in rows]
    want = set()
    for at, row in enumerate(rows):
        if row[4] & 2 and seconds[at] is not None:
            start = next((s for s in range(max(0, at - 4095), at) if rows[s][4] & 1 and seconds[s] is not None and 0 <= seconds[at] - seconds[s] <= 3), None)
            if start is not None:
                want.add((f"e{start}", f"e{at}"))
    assert got == want and len(want) > 200
