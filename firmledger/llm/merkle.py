"""Merkle manifest of a dataset with SHA-256 midstates (operator 11).

Every row is a leaf: SHA-256 over its fields, each as ``-`` if null, else its UTF-8 length, ``:`` and the value. The leaves of a
language in ascending order of doc_id make a tree of fan-out ``FAN``: while several nodes remain, every run of ``FAN``
consecutive ones (the last may be shorter, even one) becomes the SHA-256 of their digests as hexadecimal text. What remains
is the language's subroot; the subroots in order of their language make the root in the same way.

A parent keeps a copy of its hash state before each child slot. To fold a leaf, the state before its slot is resumed with the
replacement and the siblings to its right only; siblings to the left are in the state already. Nothing is rebuilt.

The tree is cut into chunks of ``CHUNK`` consecutive nodes, each a task's group; chunk roots are the nodes of the next round,
so there are as many rounds as the logarithm of the rows, and no task, nor the driver, ever holds more than one chunk. Positions
come from a range partitioning and running sums of its counts, so a language with most of the rows is spread like any other.

Nulls in any field are part of the leaf; a null language is a language of its own and comes first; null doc_ids come first in it.
Equal doc_ids are ordered by their leaves, and repeated rows are leaves of their own. A null doc_id or n_chars is never
tampered with. Texts are hashed whole, where they are read. A dataset of one row has its leaf as subroot and root, and the proof
of no sibling. Extra columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

FAN, CHUNK = 2, 1 << 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<left:string,right:string>>"


class Subtree:
    """Levels of nodes above some leaves, with the hash states of every parent before each of its child slots."""

    def __init__(self, leaves: list[str], fan: int, levels: int | None = None) -> None:
        """Without ``levels`` the tree ends at one node; with it, it has exactly so many levels."""
        self.fan, self.nodes, self.states = fan, [leaves], []
        while len(self.nodes[-1]) > 1 if levels is None else len(self.states) < levels:
            below, parents, states = self.nodes[-1], [], []
            for start in range(0, len(below), fan):
                state, before = hashlib.sha256(), []
                for child in below[start : start + fan]:
                    before.append(state.copy())
                    state.update(child.encode())
                parents.append(state.hexdigest())
                states.append(before)
            self.nodes.append(parents)
            self.states.append(states)

    @property
    def root(self) -> str:
        return self.nodes[-1][0]

    def path(self, at: int) -> list[tuple[str, str]]:
        """Siblings of each level to the left and to the right, each side concatenated."""
        out = []
        for below in self.nodes[: len(self.states)]:
            start = at - at % self.fan
            out.append(("".join(below[start:at]), "".join(below[at + 1 : start + self.fan])))
            at //= self.fan
        return out

    def fold(self, at: int, leaf: str) -> str:
        """Root with another leaf at a place: resumed states, the replacement and right siblings."""
        for below, states in zip(self.nodes, self.states, strict=False):
            slot, start = at % self.fan, at - at % self.fan
            state = states[at // self.fan][slot].copy()
            state.update((leaf + "".join(below[at + 1 : start + self.fan])).encode())
            leaf = state.hexdigest()
            at //= self.fan
        return leaf


def leaf_digest(**replaced: Column) -> Column:
    """Digest of a row's fields; ``replaced`` gives other values for some of them."""
    parts = []
    for name in FIELDS:
        value = replaced.get(name, F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """Add ``pos`` (from 0) and ``members`` of each group, in the order of columns, without a task that holds a group."""
    spark = rows.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Equal rows are told apart by where they were read, so that a border can fall between them.
    keys = [F.col(c).asc_nulls_first() for c in (group, *order, "_read")]
    dealt = rows.withColumn("_read", F.monotonically_increasing_id()).repartitionByRange(width, *keys).sortWithinPartitions(*keys)
    placed = dealt.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")).drop("_read")
    placed = cut(placed, "ordered")
    parts = placed.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))  # a row per group and partition
    by = Window.partitionBy(group)
    parts = parts.select(
        F.col(group).alias("_group"), F.col("_part").alias("_in"), (F.col("_first") - F.sum("_n").over(by.orderBy("_part")) + F.col("_n")).alias("_lead"),
        F.sum("_n").over(by).alias("members"),
    )
    found = placed.join(parts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_in")))
    return found.withColumn("pos", F.col("_at") - F.col("_lead")).drop("_group", "_in", "_lead", "_part", "_at")


def _levels(members: int, chunk: int, fan: int) -> int | None:
    """Levels of a chunk's tree: all that fit where other chunks follow, else up to one node."""
    if members <= chunk:
        return None
    levels, width = 0, 1
    while width < chunk:
        levels, width = levels + 1, width * fan
    return levels


def _climb(nodes: DataFrame, fan: int, chunk: int) -> DataFrame:
    """Paths from the nodes(tree, pos, members, digest) to the tops of their trees: tree, pos, path, top."""
    rounds = []
    while True:
        part = (F.col("pos") / chunk).cast("bigint").alias("chunk")

        def paths(table: pa.Table) -> pa.Table:
            table = table.sort_by("pos")
            tree = Subtree(table["digest"].to_pylist(), fan, _levels(table["members"][0].as_py(), chunk, fan))
            path = [[{"left": a, "right": b} for a, b in tree.path(at)] for at in range(table.num_rows)]
            kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
            return pa.table([table["tree"], table["pos"], table["members"], table["chunk"], pa.array(path, kind), pa.array([tree.root] * table.num_rows)],
                            ["tree", "pos", "members", "chunk", "path", "top"])

        kind = nodes.schema["tree"].dataType.simpleString()
        done = nodes.select("tree", "pos", "members", "digest", part).groupBy("tree", "chunk").applyInArrow(
            paths, f"tree {kind}, pos bigint, members bigint, chunk bigint, path {_PATH}, top string"
        )
        rounds.append(cut(done, "paths"))
        if not rounds[-1].where(F.col("members") > chunk).limit(1).count():
            break
        more = rounds[-1].groupBy("tree", "chunk", "members").agg(F.first("top").alias("digest"))  # the same in all of a chunk
        nodes = more.select("tree", F.col("chunk").alias("pos"), F.ceil(F.col("members") / chunk).alias("members"), "digest")
    out = rounds.pop()
    while rounds:
        above = out.select(F.col("tree").alias("_tree"), F.col("pos").alias("_pos"), F.col("path").alias("_above"), F.col("top").alias("_top"))
        below = rounds.pop()
        out = below.join(above, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("chunk") == F.col("_pos")))
        out = out.select("tree", "pos", "members", "chunk", F.concat("path", "_above").alias("path"), F.col("_top").alias("top"))
    return out.select("tree", "pos", "path", "top")


def _fold(fan: int, chunk: int):
    """Fold every leaf of a chunk: states of the chunk's own tree first, then the states above it."""
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

    def fold(leaves: pa.Table, above: pa.Table) -> pa.Table:
        leaves = leaves.sort_by("pos")
        tree = Subtree(leaves["leaf"].to_pylist(), fan, _levels(leaves["members"][0].as_py(), chunk, fan))
        top = above.to_pylist()[0]
        # One state for each level above, with the left siblings in it: what all leaves of the chunk resume.
        states = [(hashlib.sha256(step["left"].encode()), step["right"].encode()) for step in top["path"]]
        upper = "".join(step["left"] + step["right"] for step in top["path"]).encode()
        proofs, roots = [], []
        for at, leaf in enumerate(leaves["given"].to_pylist()):
            proof = hashlib.sha256("".join(left + right for left, right in tree.path(at)).encode())
            proof.update(upper)
            proofs.append(proof.hexdigest())
            node = tree.fold(at, leaf)
            for state, right in states:
                state = state.copy()
                state.update(node.encode() + right)
                node = state.hexdigest()
            roots.append(node)
        n = leaves.num_rows
        columns = [leaves["doc_id"], leaves["leaf"], pa.array([top["subroot"]] * n), pa.array([top["root"]] * n), pa.array(proofs), pa.array(roots)]
        return pa.table([*columns, pa.array([r == top["root"] for r in roots])], names)

    return fold


def manifest(docs: DataFrame, given: Column, fan: int = FAN, chunk: int = CHUNK) -> DataFrame:
    """Leaf, subroot, root and proof of every row, and the root that ``given`` (another leaf digest, or null) folds to.

    Columns: doc_id, leaf, subroot, root, proof_sha256 (digest of the siblings up to the root), folded_root, verified.
    """
    width = fan
    while width < chunk:
        width *= fan
    chunk = width  # a chunk is a whole subtree
    leaves = docs.select(*(F.col(c) for c in FIELDS)).select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", leaf_digest().alias("leaf"), given.alias("given"))
    leaves = leaves.select("doc_id", "lang", "leaf", F.coalesce("given", "leaf").alias("given"))
    placed = cut(numbered(leaves, "lang", "doc_id", "leaf"), "leaves")
    part = (F.col("pos") / chunk).cast("bigint").alias("chunk")

    def tops(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        root = Subtree(table["leaf"].to_pylist(), fan, _levels(table["members"][0].as_py(), chunk, fan)).root
        return pa.table([table["lang"][:1], table["chunk"][:1], table["members"][:1], pa.array([root])], ["tree", "pos", "members", "digest"])

    bottom = placed.select("lang", "pos", "members", "leaf", part).groupBy("lang", "chunk").applyInArrow(tops, "tree string, pos bigint, members bigint, digest string")
    bottom = cut(bottom.withColumn("members", F.ceil(F.col("members") / chunk)), "chunk-roots")
    chunks = _climb(bottom, fan, chunk).withColumnsRenamed({"tree": "lang", "path": "_path", "top": "subroot"})
    subroots = chunks.where("pos = 0").select(F.lit(0).alias("tree"), "lang", F.col("subroot").alias("digest"))
    langs = cut(numbered(subroots, "tree", "lang"), "subroots")
    tree = _climb(langs, fan, chunk).select(F.col("pos").alias("_at"), F.col("path").alias("_over"), F.col("top").alias("root"))
    over = langs.select(F.col("lang").alias("_lang"), F.col("pos").alias("_at")).join(tree, "_at").drop("_at")
    chunks = chunks.join(over, F.col("lang").eqNullSafe(F.col("_lang")))
    chunks = chunks.select("lang", F.col("pos").alias("chunk"), F.concat("_path", "_over").alias("path"), "subroot", "root")
    below = placed.select("lang", "pos", "members", "doc_id", "leaf", "given", part).groupBy("lang", "chunk")
    shape = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return below.cogroup(chunks.groupBy("lang", "chunk")).applyInArrow(_fold(fan, chunk), shape)


def tampered() -> Column:
    """Leaf with one character more where 7 divides the CRC-32 of the decimal doc_id; null elsewhere."""
    hit = F.crc32(F.col("doc_id").cast("bigint").cast("string").cast("binary")) % 7 == 0
    return F.when(hit & F.col("n_chars").isNotNull(), leaf_digest(n_chars=F.col("n_chars").cast("bigint") + 1))


def oracle_sql() -> str:
    """The same rows by recursive SQL: levels of all trees, then the proofs and the folds of all rows."""
    parts = " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in FIELDS)
    changed = parts.replace("n_chars::VARCHAR", "(n_chars + 1)::VARCHAR")
    # CRC-32 bit by bit over the digits of the doc_id.
    crc = (
        "list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda a, c: "
        "list_reduce([xor(a, c)] || list_transform(range(8), lambda b: 0::BIGINT), lambda s, b: "
        "CASE WHEN s % 2 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END), 4294967295)"
    )
    grown = """
        SELECT l.lvl + 1, l.tree, l.pos // 2, sha256(string_agg(l.digest, '' ORDER BY l.pos)), (max(l.members) + 1) // 2
        FROM {0} l WHERE l.members > 1 GROUP BY l.lvl, l.tree, l.pos // 2"""
    return f"""
        WITH RECURSIVE leaves AS (
            SELECT doc_id, coalesce('=' || lang, '-') AS tree, sha256({parts}) AS leaf,
                   CASE WHEN n_chars IS NOT NULL AND xor({crc}, 4294967295) % 7 = 0 THEN sha256({changed}) ELSE sha256({parts}) END AS given
            FROM documents),
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS members FROM leaves),
        nodes(lvl, tree, pos, digest, members) AS (SELECT 0, tree, pos, leaf, members FROM placed UNION ALL {grown.format("nodes")}),
        subroots AS (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS spot, count(*) OVER () AS trees FROM nodes WHERE members = 1),
        tops(lvl, tree, pos, digest, members) AS (SELECT 0, '', spot, subroot, trees FROM subroots UNION ALL {grown.format("tops")}),
        walk(row_id, lvl, pos, node, proof, doc_id, leaf, tree) AS (
            SELECT row_number() OVER (), 0, pos, given, '', doc_id, leaf, tree FROM placed
            UNION ALL
            SELECT w.row_id, w.lvl + 1, w.pos // 2,
                   sha256(CASE WHEN w.pos % 2 = 1 THEN s.digest || w.node ELSE w.node || coalesce(s.digest, '') END), w.proof || coalesce(s.digest, ''), w.doc_id, w.leaf, w.tree
            FROM walk w JOIN nodes n ON n.lvl = w.lvl AND n.tree = w.tree AND n.pos = w.pos AND n.members > 1
            LEFT JOIN nodes s ON s.lvl = w.lvl AND s.tree = w.tree AND s.pos = xor(w.pos, 1)),
        climb(row_id, lvl, pos, node, proof, doc_id, leaf, subroot) AS (
            SELECT w.row_id, 0, s.spot, w.node, w.proof, w.doc_id, w.leaf, s.subroot
            FROM walk w JOIN nodes n ON n.lvl = w.lvl AND n.tree = w.tree AND n.pos = w.pos AND n.members = 1 JOIN subroots s ON s.tree = w.tree
            UNION ALL
            SELECT w.row_id, w.lvl + 1, w.pos // 2,
                   sha256(CASE WHEN w.pos % 2 = 1 THEN s.digest || w.node ELSE w.node || coalesce(s.digest, '') END), w.proof || coalesce(s.digest, ''), w.doc_id, w.leaf, w.subroot
            FROM climb w JOIN tops n ON n.lvl = w.lvl AND n.pos = w.pos AND n.members > 1
            LEFT JOIN tops s ON s.lvl = w.lvl AND s.pos = xor(w.pos, 1))
        SELECT o.doc_id, o.leaf, o.subroot, r.digest AS root, sha256(o.proof) AS proof_sha256, o.node AS folded_root, o.node = r.digest AS verified
        FROM climb o JOIN tops r ON r.members = 1 AND r.lvl = o.lvl
    """


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of all rows, held against leaves of which every seventh (by checksum) is tampered with."""
    return manifest(docs, tampered())
