"""Exact de-duplication, Merkle manifests and hard negatives against plain loops."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetlens.llm import exact_dedup, hard_negatives, merkle
from packetlens.llm.common import BLANKS
from tests.llm.helpers import DOC, LONG, no_documents, odd_documents


def squeezed(text):
    return "".join(c for c in text or "" if c not in BLANKS)


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, None, 1, "k", "w", 0, 2) for i, t in rows], DOC)


def expected_groups(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(squeezed(t), []).append((-len(t or ""), i is None, i))
    return {k: (len(v), min(v, key=lambda x: (x[0], x[1], x[2] or 0))[2]) for k, v in groups.items()}


def check_groups(rows, got):
    want = expected_groups(rows)
    names = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in want.items()}
    assert len(got) == len(rows)
    for r in got:
        assert (r.group_size, r.keep_id) == names[r.text_sha256]
    assert sum(r.kept for r in got) == len(want)
    assert all(r.keep_id == r.doc_id for r in got if r.kept)
    left = sorted(((r.doc_id or -1), r.text_sha256) for r in got)
    assert left == sorted(((i or -1), hashlib.sha256(squeezed(t).encode()).hexdigest()) for i, t in rows)


def repeated_texts(n):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        text = "the hot text" if i % 3 == 0 else f"text {rng.randrange(n)}"
        rows.append((rng.randrange(2 * n) if i % 50 else None, text.replace(" ", " " * rng.randrange(4) + rng.choice("\t\n\x0b\x0c\r "))))
    return rows


def test_equal_texts_meet(spark):
    docs = odd_documents(spark, ["one text", "onetext", " o n e text\r", "One text", "one text", LONG.replace(" ", "\n")])
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    check_groups(rows, exact_dedup.exact_duplicates(docs).collect())
    assert exact_dedup.exact_duplicates(no_documents(spark)).count() == 0
    assert exact_dedup.drop_copies(no_documents(spark)).columns == no_documents(spark).columns


@pytest.mark.parametrize("filter_bytes", [exact_dedup.MAX_FILTER_BYTES, 8 << 10])
def test_groups_equal_brute_force(spark, filter_bytes):
    """A bound of one shard makes a sweep per shard."""
    rows = repeated_texts(20_000)
    docs = documents(spark, rows).repartition(5)
    found = exact_dedup.Repeats(docs, filter_bytes)
    assert found.one_sweep == (filter_bytes > 1 << 20)
    check_groups(rows, exact_dedup.exact_duplicates(docs, filter_bytes).collect())


def test_copies_go_and_unique_rows_pass(spark):
    rows = repeated_texts(3_000) + [(9_000_000 + i, f"alone number {i}") for i in range(3_000)] + [(5, "same row")] * 3
    docs = documents(spark, rows)
    want = {k: v[1] for k, v in expected_groups(rows).items()}
    for bound in (exact_dedup.MAX_FILTER_BYTES, 8 << 10):
        kept = exact_dedup.drop_copies(docs, bound)
        assert kept.columns == docs.columns
        got = [(squeezed(r.text), r.doc_id) for r in kept.collect()]
        assert len(got) == len(want) and dict(got) == want
    found = exact_dedup.Repeats(documents(spark, [(i, f"alone number {i}") for i in range(20_000)]))
    assert found.marked.filter("_xd_maybe").count() < 0.06 * 20_000 and found.groups.count() == 0


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(leaves):
    """(root, proof text per leaf, levels) by loops over whole levels."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    proofs = []
    for i in range(len(leaves)):
        steps = []
        for level in levels[:-1]:
            run = level[i // 8 * 8 : i // 8 * 8 + 8]
            steps.append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
            i //= 8
        proofs.append(steps)
    return levels[-1][0], proofs


def plain_leaf(row, change=False):
    text = row.text
    if change and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    out = ""
    for v in (row.doc_id, row.source, row.lang, row.n_chars, text):
        out += "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(out)


def check_manifest(docs):
    rows = docs.collect()
    langs = sorted({r.lang for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees, where = [], {}
    for number, lang in enumerate(langs):
        own = sorted((r for r in rows if r.lang == lang), key=lambda r: (r.doc_id is not None, r.doc_id or 0, plain_leaf(r)))
        trees.append((own, *plain_tree([plain_leaf(r) for r in own])))
    root, top = plain_tree([t[1] for t in trees])
    want = []
    for (own, subroot, proofs), upper in zip(trees, top):
        for r, steps in zip(own, proofs):
            bad = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
            now = plain_leaf(r, bad)
            for left, right in steps + upper:
                now = h(left + now + right)
            want.append((r.doc_id, plain_leaf(r), subroot, root, h("".join(a + b for a, b in steps + upper)), now, now == root))
    manifest = merkle.Manifest(docs)
    got = manifest.leaves(
        merkle._verifier(manifest.root),
        "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
    )
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    return manifest


def test_manifest_equals_plain_trees(spark):
    check_manifest(odd_documents(spark, ["UPPER", "lower"]))
    check_manifest(documents(spark, [(1, "one leaf")]))
    manifest = merkle.Manifest(no_documents(spark))
    assert manifest.root is None and manifest.proofs().count() == 0


@pytest.mark.parametrize("n", [8, 513, 4_700])
def test_manifest_sizes(spark, n):
    """Whole and partial blocks, and trees of one, two and three phases beside a small one."""
    sizes = spark.range(n).selectExpr("id as doc_id", "concat('Text ', id) as text", "'en' as lang", "'s' as source", "7L as n_chars")
    check_manifest(sizes.unionByName(sizes.limit(3).withColumn("lang", F.lit(None).cast("string"))))


def test_many_groups_and_proofs(spark):
    docs = spark.range(1_300).selectExpr("id as doc_id", "'T' as text", "concat('l', id % 700) as lang", "'s' as source", "1 as n_chars")
    manifest = check_manifest(docs)
    for r in manifest.proofs().limit(50).collect():
        assert merkle.fold(r.leaf, merkle.chain(r.proof)) == manifest.root


def test_three_phases():
    leaves = [h(str(i)) for i in range(600)]
    root, proofs = plain_tree(leaves)
    block = merkle.Block(leaves, merkle.height(600))
    assert block.top == root
    got = dict(block.suffixes(None))
    assert [merkle.flatten(got[i]) for i in range(600)] == [[x for s in p for x in s] for p in proofs]


def plain_negatives(rows, anchor_of, top=5):
    usable = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        usable.append((i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    out = []
    anchors = {(i, tuple(v), label) for i, v, label in usable if i is not None and anchor_of(i)}
    clamp = lambda s: max(-(2**63), min(2**63 - 1, s))
    for i, v, label in anchors:
        scored = [(-sum(a * b for a, b in zip(v, w)), j is None, j or 0, j, other) for j, w, other in usable if j != i and len(w) == len(v)]
        scored.sort(key=lambda x: x[:3])
        for p in [x for x in scored if x[4] == label][:top]:
            fits = [x for x in scored if x[4] != label and 80 * -p[0] <= 100 * -x[0] <= 100 * -p[0]]
            out += [(i, p[3], rank, x[3], clamp(-p[0]), clamp(-x[0])) for rank, x in enumerate(fits[:top], 1)]
    return sorted(out, key=repr)


VECTOR = "vec_id long, embedding array<float>, label int, score int, query string, size int"


def mined(spark, rows, **how):
    table = spark.createDataFrame([(*r, 1, "q", 2) for r in rows], VECTOR)
    got = hard_negatives.mine(hard_negatives.summarise(table), F.col("vec_id") % 10 == 0, **how)
    return sorted(map(tuple, got.collect()), key=repr)


def vectors(n, size, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, size))
    return [(i, (spread * (centres[i % 4] + rng.normal(size=size) * 0.4)).astype(np.float32).tolist(), int(rng.integers(3))) for i in range(n)]


@pytest.mark.parametrize("size", [1, 5, 64])
def test_negatives_equal_brute_force(spark, size):
    rows = vectors(300, size, size)
    want = plain_negatives(rows, lambda i: i % 10 == 0)
    assert want and mined(spark, rows) == want
    assert mined(spark, rows, anchors_per_block=7) == want


def test_odd_vectors(spark):
    bad = [float("nan"), float("inf"), -float("inf"), None]
    rows = vectors(80, 6, 1) + vectors(40, 3, 2) + [(200 + i, [1.0, x, 0.0], 1) for i, x in enumerate(bad)]
    rows += [(210, None, 1), (220, [1.0, 2.0, 3.0], None), (230, [], 1), (231, [], 2), (232, [], 1)]
    rows += [(None, [0.5] * 6, 1), (None, [0.5] * 6, 2), (10, [0.5] * 6, 2), (300, [0.0] * 6, 1), (11, [0.25] * 6, 1), (11, [0.25] * 6, 1)]
    rows += [(400 + i, [0.125] * 6, i % 2) for i in range(20)]
    want = plain_negatives(rows, lambda i: i % 10 == 0)
    assert mined(spark, rows) == want
    assert mined(spark, []) == [] and mined(spark, [(10, [1.0], 1)]) == []


def test_scores_beyond_doubles(spark):
    rows = [(i, [float(2.0**40 + i * 2.0**20), 3.0, -1.0], i % 2) for i in range(20)] + [(100 + i, [1e30, -1e30, float(i)], 0) for i in range(10)]
    assert mined(spark, rows) == plain_negatives(rows, lambda i: i % 10 == 0)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(0)
    table = np.floor(256 * (rng.normal(size=(16, 1)) + 0.2 * rng.normal(size=(16, 64))).repeat(10, 0))
    mean, deviation = hard_negatives.summaries(table)
    pack = lambda x: [v.tobytes() for v in x]
    rows = hard_negatives.Vectors(range(160), [0] * 160, 64, pack(table), pack(mean), pack(deviation))
    exact, widths = rows.scores(rows), []
    for level in range(len(rows.levels)):
        low, high = rows.bounds(level, rows)
        assert (low <= exact).all() and (exact <= high).all()
        widths.append((high - low).mean())
    assert widths == sorted(widths, reverse=True)
    limits = np.full(160, np.quantile(exact, 0.9))
    mask, columns = hard_negatives.survivors(rows, rows, np.ones((160, 160), bool), limits, np.full(160, np.inf))
    assert mask.sum() < 0.3 * 160 * 160
