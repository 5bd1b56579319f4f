"""SimHash near-duplicates by covering-code anchors.

A fingerprint has 64 bits. The anchors are the code words of two binary Golay codes [23, 12], one over bits
0-22 and one over bits 23-45. The code is perfect: each 23-bit value is within the covering radius 3 of exactly
one code word. So each fingerprint has one home anchor, and it visits every anchor within the covering radius
plus the threshold, counted per block: distances ``d0`` and ``d1`` to the block's code words with
``max(0, d0 - 3) + max(0, d1 - 3) <= threshold``. If x and y differ in at most ``threshold`` bits, these fall into
the two blocks and the rest, so y visits the home of x: no link is lost. There are 2**24 anchors and about 61
visits a fingerprint; a pair is compared at x's home only.

Equal fingerprints are one row before all this, so a third of all documents being copies costs nothing. Within
an anchor only a spanning forest of the links is returned, never all pairs. An anchor with more than
``HOT_MEMBERS`` members passes them on instead of comparing them: they meet at the code that has every
64-bit word (covering radius 0), where fingerprints within two bits share a word at most one bit from either.
No word has more than 65 such fingerprints, so that step is linear, and exact.

Defined results: null, empty and blank texts have fingerprint 0 and are linked like any other. Rows with a null
id belong to their group, whose id is its smallest id that isn't null (null if there is none). Repeated rows are
members of one group. An empty table gives an empty table.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetlens.llm.common import SLICE_ROWS, connected_components, stored, table

SHINGLE = 3
SEED = 42
THRESHOLD = 2
HOT_MEMBERS = 20_000

#: The binary Golay code [23, 12, 7]: length, covering radius and generator polynomial (fixed values).
BLOCK = 23
RADIUS = 3
GENERATOR = 0b110001110101


def fingerprint(text: str | None) -> int:
    """Bits set in over half the XXH64 of the word shingles, repeats included. A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    n = max(1, len(words) - SHINGLE + 1)
    start = [0, *ends[: n - 1].tolist()]
    stop = (ends[-n:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(start, stop)], "<u8")
    counts = np.unpackbits(hashes.view("u1").reshape(n, 8), axis=1, bitorder="little").sum(0, dtype="i8")
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def _fingerprints(texts: pa.Array) -> pa.Array:
    out: list[int] = []
    for at in range(0, len(texts), SLICE_ROWS):
        out += [fingerprint(t.as_py()) for t in texts.slice(at, SLICE_ROWS)]
    return pa.array(np.array(out, "u8").astype("i8"), pa.int64())


def with_fingerprint(docs: DataFrame, name: str = "_sh_fp") -> DataFrame:
    """``docs`` and the fingerprint of ``text`` as a signed 64-bit number."""
    return docs.withColumn(name, F.arrow_udf(_fingerprints, "bigint").asNondeterministic()(F.col("text")))


def hex_of(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _remainders() -> list[int]:
    """x**i modulo the generator, for each bit of a block."""
    out, r = [], 1
    for _ in range(BLOCK):
        out.append(r)
        r <<= 1
        if r >> (BLOCK - 12):
            r ^= GENERATOR
    return out


@lru_cache
def _code():
    """Syndromes of the low 12 and high 11 bits, and per syndrome the error patterns by excess over the radius.

    A value and an error pattern of its syndrome make a code word. ``patterns[e]`` lists those of weight
    ``RADIUS + e`` (for e = 0: the only one within the radius), padded with -1.
    """
    unit = _remainders()

    def syndromes(first: int, bits: int) -> np.ndarray:
        out = np.zeros(1, "i8")
        for i in range(first, first + bits):
            out = np.concatenate([out, out ^ unit[i]])
        return out

    by: list[list[list[int]]] = [[[] for _ in range(2048)] for _ in range(THRESHOLD + 1)]
    for weight in range(RADIUS + THRESHOLD + 1):
        for at in combinations(range(BLOCK), weight):
            s = 0
            for i in at:
                s ^= unit[i]
            by[max(0, weight - RADIUS)][s].append(sum(1 << i for i in at))
    patterns = []
    for lists in by:
        width = max(map(len, lists))
        patterns.append(np.array([x + [-1] * (width - len(x)) for x in lists], "i8"))
    return syndromes(0, 12), syndromes(12, 11), patterns


def _near(values: np.ndarray) -> list[np.ndarray]:
    """Per excess, the code words near each value (a row each, -1 where there is none)."""
    low, high, patterns = _code()
    syndrome = low[values & 0xFFF] ^ high[values >> 12]
    return [np.where(p[syndrome] < 0, -1, values[:, None] ^ p[syndrome]) for p in patterns]


def anchors(fps: np.ndarray, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, is home) for every anchor that each fingerprint (unsigned) visits."""
    low = (1 << BLOCK) - 1
    a = _near((fps & np.uint64(low)).astype("i8"))
    b = _near(((fps >> np.uint64(BLOCK)) & np.uint64(low)).astype("i8"))
    rows, found, home = [], [], []
    for ea in range(threshold + 1):
        for eb in range(threshold + 1 - ea):
            x, y = a[ea][:, :, None], b[eb][:, None, :]
            row, i, j = np.nonzero((x >= 0) & (y >= 0))
            rows.append(row)
            found.append(a[ea][row, i] << BLOCK | b[eb][row, j])
            home.append(np.full(len(row), not ea + eb))
    return np.concatenate(rows), np.concatenate(found), np.concatenate(home)


def _visit(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            fps = batch.column(0).slice(at, 4096).to_numpy(zero_copy_only=False)
            row, anchor, home = anchors(fps.view("u8") if fps.dtype == np.int64 else fps)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor), pa.array(fps[row]), pa.array(home)], names=["anchor", "fp", "home"]
            )


def _forest(fps: np.ndarray, homes: int, threshold: int) -> list[tuple[int, int]]:
    """Links that join the members of an anchor as all pairs (home, member) within the threshold would do.

    The first ``homes`` members are at home. At most one link fewer than members is returned.
    """
    parent = np.arange(len(fps))
    out = []
    for i in range(homes):
        near = np.nonzero(np.bitwise_count(fps ^ fps[i]) <= threshold)[0]
        if len(near) == 1:
            continue
        roots = parent[near]
        while True:
            up = parent[roots]
            if (up == roots).all():
                break
            roots = up
        roots = np.unique(roots)
        parent[near] = roots[0]
        parent[roots] = roots[0]
        out += [(roots[0], r) for r in roots[1:]]
    return out


def _compare(batches, threshold: int = THRESHOLD, hot: int = HOT_MEMBERS):
    """Rows sorted by (anchor, not home) to links (a, b), or the members of a hot anchor as (fp, null)."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    passing = None  # the hot anchor whose members pass

    def emit(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    def work(anchor, fp, home):
        edge = np.flatnonzero(np.diff(anchor)) + 1
        first, last = np.r_[0, edge], np.r_[edge, len(anchor)]
        some = (last - first > 1) & home[first]
        a, b = [], []
        for s, e in zip(first[some], last[some]):
            own = fp[s:e].view("u8")
            for i, j in _forest(own, int(home[s:e].sum()), threshold):
                a.append(fp[s + i])
                b.append(fp[s + j])
        return emit(a, b)

    for batch in batches:
        anchor, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        home = batch.column(2).to_numpy(zero_copy_only=False)
        if not len(anchor):
            continue
        if passing is not None:
            n = int(np.searchsorted(anchor, passing, "right"))
            if n:
                yield emit(fp[:n], [None] * n)
            if n == len(anchor):
                continue
            passing, anchor, fp, home = None, anchor[n:], fp[n:], home[n:]
        held.append((anchor, fp, home))
        anchor, fp, home = (np.concatenate(x) for x in zip(*held))
        cut = int(np.searchsorted(anchor, anchor[-1], "left"))
        if cut:
            yield work(anchor[:cut], fp[:cut], home[:cut])
        anchor, fp, home = anchor[cut:], fp[cut:], home[cut:]
        held = [(anchor, fp, home)]
        if len(anchor) > hot:
            yield emit(fp, [None] * len(fp))
            passing, held = anchor[0], []
    if held:
        yield work(*(np.concatenate(x) for x in zip(*held)))


def links(fps: DataFrame, hot: int = HOT_MEMBERS) -> DataFrame:
    """(a, b) from distinct fingerprints (column ``fp``): joined by paths exactly as links of the threshold are."""
    spark = fps.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    visits = fps.select("fp").mapInArrow(_visit, "anchor long, fp long, home boolean")
    dealt = visits.repartition(parts, "anchor").sortWithinPartitions("anchor", F.desc("home"))
    found = stored(dealt.mapInArrow(lambda it: _compare(it, hot=hot), "a long, b long"), "simhash-links")
    crowd = found.filter(F.col("b").isNull()).select(F.col("a").alias("fp")).distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    words = crowd.select("fp", F.explode(flips).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("word"))
    stars = words.groupBy("word").agg(F.collect_set("fp").alias("near")).filter(F.size("near") > 1)
    near = stars.select(F.array_min("near").alias("a"), F.explode("near").alias("b")).filter("a <> b")
    return found.filter(F.col("b").isNotNull()).unionAll(near)


def groups(rows: DataFrame, hot: int = HOT_MEMBERS) -> DataFrame:
    """(doc_id, fp, component_id) from (doc_id, fp)."""
    known = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fingerprints")
    labels = stored(connected_components(links(known, hot)), "components")
    member = known.join(labels, F.col("fp") == F.col("node")).select("fp", "rep", "root")
    least = member.groupBy("root").agg(F.min("rep").alias("least"))
    linked = member.join(least, "root").select("fp", "least")
    single = known.join(labels, F.col("fp") == F.col("node"), "left_anti").select("fp", F.col("rep").alias("least"))
    component = linked.unionAll(single).withColumnRenamed("least", "component_id")
    return rows.join(component, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs`` (doc_id, text)."""
    return groups(stored(with_fingerprint(docs.select("doc_id", "text"), "fp").select("doc_id", "fp"), "simhash"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group: the one whose id is the group's. Columns of ``docs``.

    Rows with a null id can't be named as copies: they pass untouched. Of rows that repeat the id, one stays.
    """
    named = docs.filter(F.col("doc_id").isNotNull())
    kept = near_duplicates(named).filter(F.col("doc_id") == F.col("component_id"))
    kept = stored(kept.groupBy("doc_id").agg(F.count("*").alias("_sh_n")), "kept")
    once = named.join(kept.filter("_sh_n = 1").hint("shuffle_hash"), "doc_id", "left_semi")
    more = named.join(kept.filter("_sh_n > 1"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return once.unionByName(more).unionByName(docs.filter(F.col("doc_id").isNull()))


def op4(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")
