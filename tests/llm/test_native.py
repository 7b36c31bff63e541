"""Chat formatting and sharding."""

import zlib

from llm_cases import EDGES, prose

from quire.llm import chat, sharding

TURNS = "conv_id long, turn long, role string, text string, conv long, pos long, x long"


def turns(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], TURNS)


def formatted(spark, rows):
    return sorted(((r["conv_id"], r["n_turns"], r["n_copies"], r["rendered"]) for r in chat.format_chats(turns(spark, rows)).collect()), key=str)


def expected(rows):
    """By comparing every two conversations."""
    nulls_first = lambda v: (v is not None, v)
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn, role, text))
    said = {c: [t[1:] for t in sorted(ts, key=lambda t: tuple(map(nulls_first, t)))] for c, ts in convs.items()}
    out = []
    for c, s in said.items():
        same = [d for d, t in said.items() if t == s]
        if any(len(t) > len(s) and t[:len(s)] == s for t in said.values()) or c != min(same, key=nulls_first):
            continue
        out.append((c, len(s), len(same), "".join(f"<|im_start|>{role if role is not None else 'unknown'}\n{text or ''}<|im_end|>\n" for role, text in s)))
    return sorted(out, key=str)


def test_snapshots_collapse(spark):
    full = [("system", "be brief"), ("user", "a"), ("assistant", "b"), ("user", "c")]
    rows = [(10 + n, k, *t) for n in range(1, 5) for k, t in enumerate(full[:n])]
    rows += [(20, k, *t) for k, t in enumerate(full)] + [(21, 0, "user", "a"), (22, 0, "user", "a"), (22, 1, "assistant", "other")]
    got = formatted(spark, rows)
    assert got == expected(rows)
    assert [g[0] for g in got] == [14, 22] and got[0][2] == 2


def test_chat_edges(spark):
    rows = [(1, 0, None, "x"), (2, 0, "unknown", "x"), (3, 0, "user", None), (4, 0, "user", ""), (5, 0, "user", "x"), (5, 0, "user", "x"), (6, 0, "user", "x"),
            (None, 0, "user", "lost"), (7, None, "user", "early"), (7, 1, "user", "late"), (8, 0, "user", prose(30000)), (9, 0, "ab", "c"), (9, 1, "a", "bc"), (11, 0, "ab", "c"), (11, 1, "ab", "c")]
    assert formatted(spark, rows) == expected(rows)
    assert formatted(spark, []) == []


def test_many_copies(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(400) for t in range(1 + c % 4)]
    assert formatted(spark, rows) == expected(rows)


def placed(docs, rows, shards, slack=0.0):
    return [(r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in sharding.shard(docs(rows), shards, slack=slack).collect()]


def test_counts_slots_and_digests(docs):
    rows = [(k, prose(k % 9, k)) for k in range(1003)] + EDGES + [(77777, "same")] * 500
    got = placed(docs, rows, 24)
    assert sorted((g[:3] for g in got), key=str) == sorted(((i, 8 + len((t or "").encode()), None if t is None else zlib.crc32(t.encode())) for i, t in rows), key=str)
    slots = {}
    for g in got:
        slots.setdefault(g[3], []).append(g[4])
    assert set(slots) == set(range(24))
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert placed(docs, [], 24) == []


def test_deterministic_whatever_the_order(docs):
    rows = [(k, "x") for k in range(500)]
    assert sorted(placed(docs, rows, 7)) == sorted(placed(docs, rows[::-1], 7))


def test_one_more_shard_moves_little(docs):
    rows = [(k, "x") for k in range(3000)]
    for slack in (0.0, 0.1):
        a, b = ({g[0]: g[3] for g in placed(docs, rows, n, slack)} for n in (12, 13))
        moved = sum(a[k] != b[k] for k in a) / len(a)
        assert moved < 0.35  # 1/13 is the least; placing by remainder would move 12/13


def test_bounded_loads_and_overflow():
    counts, owners = [10, 0, 50, 3, 0, 1], [0, 1, 2, 0, 1, 2]
    parts = sharding.plan(owners, counts, 3, 0.0)
    load = [sum(hi - lo for _, lo, hi, s, _ in parts if s == k) for k in range(3)]
    assert sorted(load) == [21, 21, 22]
    for arc, n in enumerate(counts):
        covered = sorted((lo, hi) for a, lo, hi, _, _ in parts if a == arc)
        assert [lo for lo, _ in covered] + [n] == [0] * bool(covered) + [hi for _, hi in covered] or (n == 0 and not covered)
    assert all(s in (0, 2) for a, _, _, s, _ in parts if a == 0)
    loose = sharding.plan(owners, counts, 3, 5.0)
    assert all(s == owners[a] for a, _, _, s, _ in loose)
