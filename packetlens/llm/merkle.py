"""Merkle manifest of a dataset by time-forward processing.

A leaf is the digest of a row's fields. Per group (language) the leaves in order of id form a tree of ``ARITY`` children a
node; the groups' roots in order of their names form the tree of the whole dataset.

Nodes are labelled by the last leaf below them, then by level, so a node's label comes after its children's. A sweep reads
the leaves in label order, and a priority queue ordered by label delivers the digests of children to their parent when its
turn comes. A second sweep in the opposite order delivers the siblings on the way to the root (the suffix of the proof)
from parents to children, down to the leaves. The queue has two parts. Labels of one block (``BLOCK`` consecutive leaves, a
whole subtree) meet in a heap, which holds a few messages a level. Labels of different blocks meet in tables of
messages keyed by label, sorted and spilled by Spark's shuffle: the digest of a block is a leaf of the next phase, and
its suffix comes back the same way. 10^10 leaves take four phases.

Ranks within a group come from a range-partitioned sort with offsets; no group is ever in one task.

Defined results: a null field counts as ``-``; null groups come first, and null ids come first in their group. Rows that
repeat an id are leaves of their own, ordered by digest. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetlens.llm.common import slices, stored, table, to_batch
from packetlens.operators.ranking import with_row_rank

ARITY = 8
#: Levels that one phase adds, and the leaves of a block.
LEVELS = 3
BLOCK = ARITY**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Groups whose totals are broadcast to the leaves; more are joined.
SMALL_GROUPS = 100_000


def digest(text: bytes | str) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def encode_fields(values) -> bytes:
    """Fields one after the other: ``-`` for null, else byte count, colon, value."""
    parts = []
    for v in values:
        if v is None:
            parts.append(b"-")
        else:
            raw = v if isinstance(v, bytes) else str(v).encode("utf-8", "surrogatepass")
            parts += [str(len(raw)).encode(), b":", raw]
    return b"".join(parts)


def height(leaves: int) -> int:
    """Levels above the leaves: as many as it takes until one node remains."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // ARITY), levels + 1
    return levels


class Block:
    """The subtree over some consecutive leaves, ``levels`` high."""

    def __init__(self, leaves: list[str], levels: int):
        self.leaves, self.levels = leaves, levels
        #: Inner nodes in label order with their children's digests, as the forward sweep met them.
        self.nodes: list[tuple[tuple[int, int, int], list[str]]] = []
        self.top = self._forward()

    def _label(self, level: int, at: int) -> tuple[int, int, int]:
        return min((at + 1) * ARITY**level, len(self.leaves)) - 1, level, at

    def _forward(self) -> str:
        if not self.levels:
            return self.leaves[0]
        queue: list[tuple[tuple[int, int, int], int, str]] = []
        top = ""
        for time, leaf in enumerate(self.leaves):
            heapq.heappush(queue, (self._label(1, time // ARITY), time, leaf))
            while queue and queue[0][0][0] == time:
                label, children = queue[0][0], []
                while queue and queue[0][0] == label:
                    children.append(heapq.heappop(queue)[2])
                self.nodes.append((label, children))
                made, (_, level, at) = digest("".join(children)), label
                if level == self.levels:
                    top = made
                else:
                    heapq.heappush(queue, (self._label(level + 1, at // ARITY), at, made))
        return top

    def suffixes(self, above):
        """(leaf index, its proof) from the last leaf to the first; ``above`` is the proof of the block's own node.

        A proof is a chain ``(left, right, rest)``: the siblings on each side, then what the parent has.
        """
        if not self.levels:
            yield 0, above
            return
        queue = [((-(len(self.leaves) - 1), -self.levels, 0), above)]
        for (time, level, at), children in reversed(self.nodes):
            label, rest = heapq.heappop(queue)
            assert label == (-time, -level, -at)
            for slot in range(len(children) - 1, -1, -1):
                child, proof = at * ARITY + slot, ("".join(children[:slot]), "".join(children[slot + 1 :]), rest)
                if level == 1:
                    yield child, proof
                else:
                    end, below, place = self._label(level - 1, child)
                    heapq.heappush(queue, ((-end, -below, -place), proof))


def chain(flat: list[str]):
    """A proof from its flat form ``left, right, left, right, ...``, leaf level first."""
    proof = None
    for i in range(len(flat) - 2, -1, -2):
        proof = (flat[i], flat[i + 1], proof)
    return proof


def flatten(proof) -> list[str]:
    flat = []
    while proof:
        flat += proof[:2]
        proof = proof[2]
    return flat


def fold(leaf: str, proof) -> str:
    """The root that a leaf and its proof lead to."""
    while proof:
        leaf, proof = digest(proof[0] + leaf + proof[1]), proof[2]
    return leaf


def proof_digest(proof) -> str:
    h = hashlib.sha256()
    while proof:
        h.update((proof[0] + proof[1]).encode())
        proof = proof[2]
    return h.hexdigest()


# --- phases -----------------------------------------------------------------------------------------------------------

_NODE = "struct<pos:long,digest:string,payload:string>"


def _blocks(nodes: DataFrame) -> DataFrame:
    """One row per block of (key, pos, n, digest, payload): its nodes in order, at most ``BLOCK``."""
    packed = F.sort_array(F.collect_list(F.struct("pos", "digest", "payload"))).cast(f"array<{_NODE}>").alias("nodes")
    grouped = nodes.groupBy("key", F.floor(F.col("pos") / BLOCK).cast("long").alias("block"))
    return stored(grouped.agg(F.first("n").alias("n"), packed), "merkle-blocks")


def _block(row) -> Block:
    return Block([x["digest"] for x in row["nodes"]], min(LEVELS, height(row["n"])))


def _rise(batches):
    for batch in slices(batches, 64):
        rows = batch.to_pylist()
        yield to_batch(
            {
                "key": ([r["key"] for r in rows], pa.string()),
                "pos": ([r["block"] for r in rows], pa.int64()),
                "n": ([-(-r["n"] // BLOCK) for r in rows], pa.int64()),
                "digest": ([_block(r).top for r in rows], pa.string()),
                "payload": ([None] * len(rows), pa.string()),
            }
        )


class Forest:
    """Trees over (key, pos, n, digest, payload), a tree per key with ``n`` leaves at ``pos`` 0 to n - 1."""

    def __init__(self, leaves: DataFrame):
        self.phases = [_blocks(leaves)]
        risen = self._risen()
        while risen.filter("n > 1").limit(1).count():
            self.done.append(risen.filter("n <= 1"))
            self.phases.append(_blocks(risen.filter("n > 1")))
            risen = self._risen()
        self.done.append(risen)

    done: list[DataFrame]

    def _risen(self) -> DataFrame:
        if len(self.phases) == 1:
            self.done = []
        made = self.phases[-1].mapInArrow(_rise, "key string, pos long, n long, digest string, payload string")
        return stored(made, "merkle-nodes")

    def roots(self) -> DataFrame:
        """(key, digest)"""
        out = self.done[0]
        for more in self.done[1:]:
            out = out.unionAll(more)
        return out.select("key", "digest")

    def sink(self, above: DataFrame, finish, schema: str) -> DataFrame:
        """``finish(key, node, proof, extra)`` for every leaf. ``above`` has (key, proof, extra) of each tree's root."""
        passed = None
        for phase in range(len(self.phases) - 1, -1, -1):
            # Trees that end in this phase take the proof of their root; the others that of their block.
            ended = self.done[phase].select("key").join(above, "key").select("key", F.lit(0).cast("long").alias("block"), "proof", "extra")
            proofs = ended if passed is None else ended.unionAll(passed)
            met = self.phases[phase].join(proofs, ["key", "block"])
            if phase:
                kept = met.mapInArrow(_sinking(_pass_on), "key string, block long, proof array<string>, extra string")
                passed = stored(kept, "merkle-proofs")
        return met.mapInArrow(_sinking(finish), schema)


def _pass_on(key, node, proof, extra):
    return {"key": key, "block": node["pos"], "proof": flatten(proof), "extra": extra}


def _sinking(finish):
    def run(batches):
        for batch in slices(batches, 8):
            for row in batch.to_pylist():
                nodes = row["nodes"]
                found = _block(row).suffixes(chain(row["proof"]))
                out = [finish(row["key"], nodes[at], proof, row["extra"]) for at, proof in found]
                yield pa.RecordBatch.from_pylist(out, schema=_arrow(out[0]))

    return run


_TYPES = {"block": pa.int64(), "doc_id": pa.int64(), "pos": pa.int64(), "proof": pa.list_(pa.string()), "verified": pa.bool_()}


def _arrow(row: dict) -> pa.Schema:
    return pa.schema([(name, _TYPES.get(name, pa.string())) for name in row])


# --- the dataset --------------------------------------------------------------------------------------------------------


def tampered(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0


def _leaves(batches):
    for batch in slices(batches):
        ids, leaves, changed = [], [], []
        columns = [batch.column(i).to_pylist() for i in range(len(FIELDS))]
        for values in zip(*columns):
            ids.append(values[0])
            leaves.append(digest(encode_fields(values)))
            text = values[-1]
            if not tampered(values[0]) or text is None or text == text.lower():
                changed.append(None)
            else:
                changed.append(digest(encode_fields((*values[:-1], text.lower()))))
        yield to_batch(
            {
                "doc_id": (ids, pa.int64()),
                "lang": (columns[2], pa.string()),
                "digest": (leaves, pa.string()),
                "changed": (changed, pa.string()),
            }
        )


def leaves_of(docs: DataFrame) -> DataFrame:
    """(doc_id, key, digest, changed): a leaf per row. ``changed`` is the digest after tampering, null where it is equal."""
    raw = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "n_chars", F.col("text").cast("binary").alias("text")
    )
    made = raw.mapInArrow(_leaves, "doc_id long, lang string, digest string, changed string")
    # Keys order as their names do, with null before all.
    key = F.coalesce(F.concat(F.lit("1"), "lang"), F.lit("0")).alias("key")
    return made.select("doc_id", key, "digest", "changed")


def _ranked(leaves: DataFrame) -> DataFrame:
    """(key, pos, n, digest, payload): ranks within the key, and the key's number of leaves."""
    order = [F.col("key").asc(), F.col("doc_id").asc_nulls_first(), F.col("digest").asc()]
    ranked = with_row_rank(leaves, order)
    totals = stored(ranked.groupBy("key").agg(F.count("*").alias("n"), F.min("row_rank").alias("start")), "merkle-totals")
    if totals.count() <= SMALL_GROUPS:
        totals = F.broadcast(totals)
    payload = F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), "changed").alias("payload")
    return ranked.join(totals, "key").select("key", (F.col("row_rank") - F.col("start")).alias("pos"), "n", "digest", payload)


class Manifest:
    """The tree of every group and the tree over their roots."""

    def __init__(self, docs: DataFrame):
        self.groups = Forest(_ranked(leaves_of(docs)))
        subroots = self.groups.roots()
        ranked = with_row_rank(subroots, [F.col("key").asc()])
        count = ranked.count()
        self.empty = not count
        self.names = Forest(
            ranked.select(
                F.lit("").alias("key"), F.col("row_rank").alias("pos"), F.lit(count).cast("long").alias("n"), "digest", F.col("key").alias("payload")
            )
        )
        first = self.names.roots().first()
        self.root = first["digest"] if first else None

    def _tops(self) -> DataFrame:
        """(key, proof, extra): the proof of each group's root, and the root itself."""
        spark = self.groups.phases[0].sparkSession
        start = spark.createDataFrame([("", [], "")], "key string, proof array<string>, extra string")
        out = self.names.sink(start, _name_proof, "key string, proof array<string>, extra string")
        return stored(out, "merkle-proofs")

    def leaves(self, finish, schema: str) -> DataFrame:
        return self.groups.sink(self._tops(), finish, schema)

    def proofs(self) -> DataFrame:
        """(doc_id, key, pos, leaf, subroot, proof): siblings per level to the root, left and right in turn."""
        return self.leaves(_proof_row, "doc_id long, key string, pos long, leaf string, subroot string, proof array<string>")


def _name_proof(key, node, proof, extra):
    return {"key": node["payload"], "proof": flatten(proof), "extra": node["digest"]}


def _payload(node) -> tuple[int | None, str]:
    """The id, and the digest of the row as it is found now."""
    doc_id, _, changed = node["payload"].partition(" ")
    return None if doc_id == "-" else int(doc_id), changed or node["digest"]


def _proof_row(key, node, proof, subroot):
    doc_id, _ = _payload(node)
    return {"doc_id": doc_id, "key": key, "pos": node["pos"], "leaf": node["digest"], "subroot": subroot, "proof": flatten(proof)}


def _verifier(root: str | None):
    def finish(key, node, proof, subroot):
        doc_id, found = _payload(node)
        folded = fold(found, proof)
        return {
            "doc_id": doc_id,
            "leaf": node["digest"],
            "subroot": subroot,
            "root": root,
            "proof_sha256": proof_digest(proof),
            "folded_root": folded,
            "verified": folded == root,
        }

    return finish


def op12(spark, sf_dir: str) -> DataFrame:
    manifest = Manifest(table(spark, sf_dir, "documents"))
    return manifest.leaves(
        _verifier(manifest.root),
        "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
    )


def _sql() -> str:
    """The trees level by level; ``LEVELS_SQL`` levels cover 8 ** LEVELS_SQL rows a language."""
    top, names = LEVELS_SQL, 3
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

    def field(value: str, size: str) -> str:
        return f"coalesce({size} || ':' || {value}, '-')"

    def leaf(text: str) -> str:
        numbers = [field(f"CAST({c} AS VARCHAR)", f"strlen(CAST({c} AS VARCHAR))") for c in ("doc_id", "n_chars")]
        texts = [field(c, f"strlen({c})") for c in ("source", "lang")]
        return f"sha256({numbers[0]} || {texts[0]} || {texts[1]} || {numbers[1]} || {field(text, f'strlen({text})')})"

    bit = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    crc = "SELECT i, i AS c FROM range(256) AS r(i)"
    for _ in range(8):
        crc = f"SELECT i, {bit} AS c FROM ({crc})"

    def tree(prefix: str, levels: int) -> list[str]:
        out = []
        for i in range(levels + 1):
            if i:
                out.append(
                    f"{prefix}{i} AS (SELECT key, pos // 8 AS pos, (n + 7) // 8 AS n, sha256(string_agg(h, '' ORDER BY pos)) AS h "
                    f"FROM {prefix}{i - 1} WHERE n > 1 GROUP BY key, pos // 8, n)"
                )
            w = "PARTITION BY key, pos // 8 ORDER BY pos ROWS BETWEEN"
            out.append(
                f"{prefix}{i}s AS (SELECT *, coalesce(string_agg(h, '') OVER ({w} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, "
                f"coalesce(string_agg(h, '') OVER ({w} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {prefix}{i} WHERE n > 1)"
            )
        return out

    def climb(start: str, prefix: str, levels: int) -> str:
        """Folds ``now`` and appends to ``proof``, level by level."""
        sql = start
        for i in range(levels + 1):
            sql = (
                f"SELECT x.* REPLACE (CASE WHEN s.h IS NULL THEN x.now ELSE sha256(s.l || x.now || s.r) END AS now, "
                f"x.proof || coalesce(s.l || s.r, '') AS proof, x.pos // 8 AS pos) FROM ({sql}) x LEFT JOIN {prefix}{i}s s ON s.key = x.key AND s.pos = x.pos"
            )
        return sql

    ends = " UNION ALL ".join(f"SELECT key, h FROM t{i} WHERE n = 1" for i in range(top + 1))
    roots = " UNION ALL ".join(f"SELECT h FROM u{i} WHERE n = 1" for i in range(names + 1))
    first = climb("SELECT doc_id, key, pos, h AS leaf, found AS now, '' AS proof FROM t0", "t", top)
    second = climb(
        f"SELECT y.doc_id, '' AS key, u0.pos, y.leaf, u0.h AS subroot, y.now, y.proof FROM ({first}) y JOIN u0 ON u0.name = y.key", "u", names
    )
    return f"""
WITH crc AS (SELECT list(c ORDER BY i) AS tab FROM ({crc})),
d AS (
  SELECT doc_id, coalesce('1' || lang, '0') AS key, {leaf("text")} AS h, {leaf(f"translate(text, '{upper}', '{lower}')")} AS changed,
    xor(4294967295, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT)),
      lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]), 4294967295)) % 3 = 0 AS bad
  FROM documents, crc
),
t0 AS (
  SELECT doc_id, key, h, CASE WHEN bad THEN changed ELSE h END AS found, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, h) - 1 AS pos,
    count(*) OVER (PARTITION BY key) AS n
  FROM d
),
{", ".join(tree("t", top))},
u0 AS (SELECT '' AS key, key AS name, h, row_number() OVER (ORDER BY key) - 1 AS pos, count(*) OVER () AS n FROM ({ends})),
{", ".join(tree("u", names))}
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, now AS folded_root, now = root AS verified
FROM ({second}), (SELECT h AS root FROM ({roots}))
"""


LEVELS_SQL = 7
OP12_SQL = _sql()
