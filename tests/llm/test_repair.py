"""Repaired conversations against the cheapest path by dynamic programming over whole strings."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from lurewatch.llm import repair

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
ROLE = {"u": "user", "a": "assistant"}


def cheapest(rows):
    """(cost, audit, output) of rows (role, text, fault), keeping the best path to each last role."""
    def inserted(paths):
        for _ in range(2):
            for last, (cost, audit, out) in list(paths.items()):
                to = NEXT[last]
                new = (cost + 2, audit + "I", [*out, (ROLE[to], "")])
                if to not in paths or new[:2] < paths[to][:2]:
                    paths[to] = new
        return paths

    paths = {"": (0, "", [])}
    for role, text, fault in rows:
        after = {}

        def offer(last, path, after=after):
            if last not in after or path[:2] < after[last][:2]:
                after[last] = path

        for last, (cost, audit, out) in inserted(paths).items():
            offer(last, (cost + 3, audit + "D", out))
            if fault in ("blank", "duplicate"):
                continue
            more = fault == "truncated"
            if (role[:1], last) in {("u", ""), ("u", "s"), ("u", "a"), ("a", "u"), ("s", "")}:
                offer(role[:1], (cost + more, audit + "K", [*out, (role, text)]))
            offer(NEXT[last], (cost + 2 + more, audit + "R", [*out, (ROLE[NEXT[last]], text)]))
        paths = after
    return min((p for last, p in inserted(paths).items() if last in ("", "a")), key=lambda p: p[:2])


def code_of(role, fault):
    kind = {"u": repair.USER, "a": repair.ASSISTANT, "s": repair.SYSTEM}.get(role[:1], repair.OTHER)
    return kind + {"blank": repair.GONE, "duplicate": repair.GONE, "truncated": repair.CUT}.get(fault, repair.PLAIN)


def answer(rows):
    found = list(repair.repair(bytes(code_of(r, f) for r, _, f in rows)))
    return sum(c for _, _, c in found), "".join(e for _, e, _ in found)


def test_every_short_conversation():
    kinds = [(r, "t", f) for r in ("user", "assistant", "system", "tool") for f in (None, "truncated")] + [("user", "", "blank")]
    for n in range(4):
        for rows in itertools.product(kinds, repeat=n):
            if rows:
                assert answer(rows) == cheapest(rows)[:2], rows


@pytest.mark.parametrize("n", [10, 31, 32, 33, 64, 65, 200])
def test_long_conversations(n):
    rng = random.Random(n)
    for weights in ([5, 5, 1, 1], [9, 1, 0, 0], [1, 0, 0, 0], [1, 1, 9, 9]):
        for _ in range(8):
            rows = [(rng.choices(["user", "assistant", "system", "tool"], weights)[0], "t", rng.choices([None, "truncated", "blank"], [8, 2, 1])[0]) for _ in range(n)]
            assert answer(rows) == cheapest(rows)[:2]


def test_bounds_never_exceed_the_cost():
    rng = random.Random(9)
    for _ in range(500):
        rows = [(rng.choice(["user", "assistant", "system", "x"]), "t", rng.choice([None, "truncated", "blank"])) for _ in range(rng.randint(1, 9))]
        assert repair.lower_bounds(bytes(code_of(r, f) for r, _, f in rows), 0)[0] <= cheapest(rows)[0]


def expected(turns):
    """The contract by hand for rows (conv_id, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in turns}:
        rows = []
        for _, turn, role, text in (r for r in turns if r[0] == conv):
            role, text = (" " if role is None else role), (" " if text is None else text)
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            rows += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, marked = set(), []
        for _, role, text in rows:
            end = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else None
            seen.add((role, text))
            marked.append((role, text, fault))
        numbers = [t for t, _, _ in rows if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        count = [sum(f == kind for _, _, f in marked) for kind in ("blank", "duplicate", "truncated")]
        illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
        cost, audit, kept = cheapest(marked) if marked else (0, "", [])
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out[conv] = (gaps, *count, illegal, cost, audit, digest)
    return out


def run(spark, turns):
    data = [(*t, 7, "x", 1) for t in turns]
    frame = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, pos long, fault string, code int")
    found = repair.repaired_after_damage(frame.repartition(3)).collect()
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert len({r.conv_id for r in found}) == len(found)
    return {r.conv_id: tuple(r[n] for n in names) for r in found}


def test_whole_tables(spark):
    rng = random.Random(3)
    texts = ["Yes.", "No", "", " \t\n", None, "Why?  \n", "é!", "Same text.", "x" * 50_000]
    roles = ["user", "assistant", "system", "tool", "", None]
    turns = []
    for conv in [*range(120), None]:
        for turn in range(rng.choice([1, 2, 5, 9, 40])):
            if rng.random() < 0.9:
                role = roles[turn % 2] if rng.random() < 0.8 else rng.choice(roles)
                turns.append((conv, rng.choice([turn, turn, turn, None]), role, rng.choice(texts)))
    turns += turns[:20]
    assert run(spark, turns) == expected(turns)


def test_hot_conversation_and_dropped_rows(spark):
    dropped = [c for c in range(500) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    turns = [(c, 0, "user", "gone.") for c in dropped]
    turns += [(1000, t, "user" if t % 3 else "assistant", f"{t % 50}.") for t in range(3000)]
    got = run(spark, turns)
    assert got == expected(turns)
    assert all(got[c] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for c in dropped)


def test_empty_table(spark):
    assert run(spark, []) == {}
