"""The Merkle manifest against plain recursion over the whole table."""

import hashlib
import random
import zlib

import pytest

from lurewatch.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    values = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)]
    return sha(*values)


def climb(digests):
    """Root, and the runs above each leaf with its place in them."""
    above = [[] for _ in digests]
    owners = [[i] for i in range(len(digests))]
    while len(digests) > 1:
        upper, groups = [], []
        for at in range(0, len(digests), 3):
            run = digests[at : at + 3]
            for place, group in enumerate(owners[at : at + 3]):
                for i in group:
                    above[i].append((run[:place], run[place + 1 :]))
            upper.append(sha(*run))
            groups.append([i for group in owners[at : at + 3] for i in group])
        digests, owners = upper, groups
    return digests[0], above


def expected(rows):
    def found(row):
        hit = row[0] is not None and row[1] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
        return (row[0], row[1].replace("\n", ""), *row[2:]) if hit else row

    sources = {}
    for row in rows:
        sources.setdefault(row[3], []).append(((row[0] is not None, row[0] or 0), leaf(*row), leaf(*found(row)), row[0]))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([own for _, own, _, _ in sorted(sources[s])]) for s in order}
    root, tops = climb([trees[s][0] for s in order])
    out = []
    for s, top in zip(order, tops, strict=True):
        for (_, own, other, doc_id), below in zip(sorted(sources[s]), trees[s][1], strict=True):
            proof, folded = "", other
            for left, right in [*below, *top]:
                proof, folded = proof + "".join(left + right), sha(*left, folded, *right)
            out.append((doc_id, own, trees[s][0], root, sha(proof), folded, folded == root))
    return out


def run(spark, rows):
    # Columns with names of the operator's own do no harm.
    data = [(*row, "g", 1, "p", 2) for row in rows]
    frame = spark.createDataFrame(data, SCHEMA + ", grp string, idx long, proof string, block long")
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return [tuple(r[n] for n in names) for r in manifest.tampered_manifest(frame.repartition(3)).collect()]


def key(row):
    return tuple(str(v) for v in row)


def test_hot_source_and_nulls(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, "", "a\nb", f"é {i}\n"]), rng.choice([None, "en"]), "hot", rng.choice([None, i])) for i in rng.sample(range(10_000), 1500)]
    rows += [(10_000 + i, f"t{i}\n", "de", rng.choice([None, "", "a", "ä", "Z", "one"]), 3) for i in range(60)]
    rows += [(None, "no id\n", None, "hot", 1), (None, None, None, None, None), (20_000, "x\n", "en", "single", 2)]
    rows += [rows[5], rows[5], (rows[6][0], "same id, other text", "en", "hot", 1)]
    got, want = run(spark, rows), expected(rows)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert len({r[-1] for r in got}) == 2


@pytest.mark.parametrize("n", [1, 2, 3, 4, 10])
def test_small_trees(spark, n):
    rows = [(i, f"{i}\n", "en", "s", 1) for i in range(n)]
    assert sorted(run(spark, rows)) == sorted(expected(rows))


def test_sources_of_one_row(spark):
    rows = [(i, "a\nb", None, f"s{i}", 3) for i in range(40)]
    assert sorted(run(spark, rows)) == sorted(expected(rows))


def test_empty_table(spark):
    assert run(spark, []) == []


def test_heights():
    nodes = manifest.forward(0, [str(i) for i in range(10)], 3)
    assert [len(level) for level in nodes] == [10, 4, 2, 1]
    assert nodes[1][3] == sha("9")  # a run of one becomes its digest
    proofs = manifest.backward(0, nodes, [("l", "r")])
    for i, proof in enumerate(proofs):
        own = str(i)
        for left, right in proof[:-1]:
            own = sha(left, own, right)
        assert own == nodes[3][0] and proof[-1] == ("l", "r")


def test_untampered_rows_verify(spark):
    frame = spark.createDataFrame([(i, f"{i}\n", "en", "s", 1) for i in range(5)], SCHEMA)
    found = manifest.manifest(frame).collect()
    assert all(r.verified and r.folded_root == r.root for r in found)
    assert [len(r.proof) for r in found] == [2] * 5
