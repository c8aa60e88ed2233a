"""The manifest against trees built level by level in plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from carelake.llm import merkle


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(leaves, fanout):
    """The root, and per leaf its siblings and its place among them, level by level."""
    proofs, level, at = [[] for _ in leaves], leaves, list(range(len(leaves)))
    while len(level) > 1:
        for i, a in enumerate(at):
            run = a // fanout * fanout
            proofs[i].append((level[run:a], level[a + 1:run + fanout]))
            at[i] = a // fanout
        level = [h("".join(level[i:i + fanout])) for i in range(0, len(level), fanout)]
    return level[0], proofs


def by_hand(rows, fanout):
    groups = {}
    for t, k, leaf, given in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2])):
        groups.setdefault(t, []).append((k, leaf, given))
    order = sorted(groups, key=lambda t: (t is not None, (t or "").encode()))
    built = {t: tree([leaf for _, leaf, _ in groups[t]], fanout) for t in order}
    root, upper = tree([built[t][0] for t in order], fanout)
    out = []
    for t, up in zip(order, upper):
        for (k, leaf, given), low in zip(groups[t], built[t][1]):
            node = given or leaf
            for before, after in low + up:
                node = h("".join([*before, node, *after]))
            proof = h("".join(x for before, after in low + up for x in before + after))
            out.append((k, leaf, built[t][0], root, proof, node, node == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("fanout", "block_levels"), [(3, 1), (3, 2), (2, 1), (4, 1), (3, 6)])
def test_manifest(spark, fanout, block_levels):
    rng = random.Random(fanout)
    sizes = {"hot": 171, "a": 1, "b": 2, "ä": 3, "": 4, None: 28, "c": 9, "d": 10, "e": 81, "f": 82, **{f"t{i}": 1 for i in range(7)}}
    rows = [(t, i * 7, h(f"{t} {i}"), h("bad") if rng.random() < 0.3 else None) for t, n in sizes.items() for i in range(n)]
    rows += [("hot", 21, h("same key"), None), (None, None, h("no key"), None)] + [("b", 5, h("repeated"), None)] * 3
    rng.shuffle(rows)
    given = spark.createDataFrame([(*r, "x", 1) for r in rows], "tree string, key long, leaf string, given string, block string, pos int")
    got = [tuple(r) for r in merkle.manifest(given.repartition(5), fanout, block_levels).collect()]
    assert sorted(got, key=repr) == by_hand(rows, fanout)


def test_one_row_and_none(spark):
    schema = "tree string, key long, leaf string, given string"
    assert merkle.manifest(spark.createDataFrame([], schema)).collect() == []
    one = merkle.manifest(spark.createDataFrame([(None, None, h("x"), None)], schema)).first()
    assert (one.leaf, one.subroot, one.root, one.folded_root) == (h("x"),) * 4 and one.proof_sha256 == h("") and one.verified


def test_row_digest(spark):
    rows = [(1, None, "é\n", 3, "x" * 100_000), (None, "", None, None, None)]
    got = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").select(
        merkle.row_digest([F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])).collect()
    assert [r[0] for r in got] == [h("1:1-3:é\n1:3100000:" + "x" * 100_000), h("-0:---")]


def test_only_lost_line_breaks_break_a_proof(spark, tmp_path):
    from carelake.llm.queries import op12_merkle_manifest
    rows = [(i, "a\nb" if i % 3 else "plain", "en", f"s{i % 4}", i) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.verified for r in op12_merkle_manifest(spark, str(tmp_path)).collect()}
    assert got == {i: i % 3 == 0 or zlib.crc32(str(i).encode()) % 2 == 1 for i in range(200)}
