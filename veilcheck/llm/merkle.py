"""A Merkle manifest as a persistent tree: changed leaves make versions by path copying.

Rows are leaves, ordered by id within their group; up to eight neighbours make
one node of the next level, until a group has one root, and the groups' roots
make the root of all in the same way.  Nodes never change.  A version with one
changed leaf shares every node with the tree but the leaf's ancestors, which it
copies; what a copied node needs of the nodes beside it is their digests.

Four levels at a time lie in aligned blocks of 4,096 nodes, one block per task
step.  A block hands one digest up; the blocks above work on these alone.  Down
again comes, per block, the path from its root to the root of all.  A leaf's
version copies within the leaf's block first and goes on along that path, so
that versions, of which there may be as many as rows, stay spread like the rows.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilcheck.session import written

FANOUT = 8
#: Levels and nodes of an aligned block.
BLOCK_LEVELS = 4
BLOCK = FANOUT**BLOCK_LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: One document in so many, by crc32 of its id, is tampered with.
TAMPER_ONE_IN = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The digests left and right of a node among its run of eight, level by level.
Path = list[tuple[str, str]]
_PATH = "array<struct<left:string,right:string>>"


def digest(text: str) -> str:
    """Lower-case hexadecimal SHA-256."""
    return sha256(text.encode()).hexdigest()


def record_digest(values: list[Column]) -> Column:
    """The digest of a record: ``-`` for a null, else length in bytes, colon, value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[
        F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts
    ]).cast("binary"), 256)


# Within a block


def levels_of(nodes: list[str], n: int) -> list[list[str]]:
    """The levels of a block, from its own nodes to its root; ``n`` nodes lie on the lowest level of the group."""
    levels = [nodes]
    while n > 1 and len(levels) <= BLOCK_LEVELS:
        below = levels[-1]
        levels.append([digest("".join(below[i : i + FANOUT])) for i in range(0, len(below), FANOUT)])
        n = -(-n // FANOUT)
    return levels


def path_of(levels: list[list[str]], i: int) -> Path:
    """What lies beside node ``i`` and its ancestors within the block."""
    path = []
    for level in levels[:-1]:
        first = i - i % FANOUT
        path.append(("".join(level[first:i]), "".join(level[i + 1 : first + FANOUT])))
        i //= FANOUT
    return path


def copy_path(node: str, path: Path) -> list[str]:
    """The nodes that a version owns: a changed node and copies of its ancestors.  All others are shared."""
    copies = [node]
    for left, right in path:
        copies.append(digest(left + copies[-1] + right))
    return copies


def proof_digest(path: Path) -> str:
    """The digest of all siblings, from left to right, level by level."""
    return digest("".join(left + right for left, right in path))


# Over blocks


def _numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows with their position ``pos`` in their ``grp`` and the number ``n`` of rows there.

    Rows lie in range partitions, so a group may span many; only the number of
    rows per group and partition is summed up.  The row number that ends the
    order tells equal rows apart, so that even those spread.
    """
    keyed = rows.withColumn("tie", F.monotonically_increasing_id())
    ranged = keyed.repartitionByRange("grp", *order, "tie").sortWithinPartitions("grp", *order, "tie").drop("tie")
    at = F.monotonically_increasing_id()
    table = written(ranged.select("*", F.shiftright(at, 33).alias("part"), at.bitwiseAND((1 << 33) - 1).alias("row")), name)
    parts = table.groupBy("grp", "part").agg(F.min("row").alias("first"), F.count("*").alias("size"))
    upto = F.sum("size").over(Window.partitionBy("grp").orderBy("part"))
    parts = parts.select(
        "grp", "part", (upto - F.col("size") - F.col("first")).alias("offset"),
        F.sum("size").over(Window.partitionBy("grp")).alias("n"),
    )
    placed = table.join(written(parts, f"{name}-parts"), ["grp", "part"])
    return placed.select(*rows.columns, (F.col("row") + F.col("offset")).alias("pos"), "n")


def _in_blocks(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("grp", F.floor(F.col("pos") / BLOCK).alias("block"))


def _plain(table: pa.Table, name: str) -> list:
    return table.column(name).to_pylist()


def _block_roots(leaves: DataFrame) -> DataFrame:
    """``(grp, pos, n, node)``: the root of each block, as a node of the next level of blocks."""

    def run(key: tuple, block: pa.Table) -> pa.Table:
        block, n = block.sort_by("pos"), block.column("n")[0].as_py()
        root = levels_of(_plain(block, "node"), n)[-1][0]
        return pa.table({"grp": [key[0].as_py()], "pos": [key[1].as_py()], "n": [-(-n // BLOCK)], "node": [root]})

    return _in_blocks(leaves).applyInArrow(run, "grp string, pos long, n long, node string")


def _climbed(nodes: DataFrame) -> DataFrame:
    """Nodes with the path to their block's root, and that root."""

    def run(key: tuple, block: pa.Table) -> pa.Table:
        block, n = block.sort_by("pos"), block.column("n")[0].as_py()
        levels = levels_of(_plain(block, "node"), n)
        paths = [[{"left": a, "right": b} for a, b in path_of(levels, i)] for i in range(len(block))]
        kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        return pa.table({
            "grp": block.column("grp"), "pos": block.column("pos"), "n": block.column("n"),
            "path": pa.array(paths, kind), "root": pa.array(levels[-1] * len(block), pa.string()),
        })

    return _in_blocks(nodes).applyInArrow(run, f"grp string, pos long, n long, path {_PATH}, root string")


def _paths_to_top(nodes: DataFrame, name: str) -> DataFrame:
    """``(grp, pos, path, top)``: the path of every node to its group's root, which is ``top``.

    Each round climbs four levels; there are as many as the largest group needs.
    """
    rounds = []
    while True:
        rounds.append(written(_climbed(nodes), f"{name}-{len(rounds)}"))
        if rounds[-1].agg(F.coalesce(F.max("n"), F.lit(0)).alias("n")).first().n <= BLOCK:
            break
        above = rounds[-1].filter(F.col("pos") % BLOCK == 0)
        nodes = above.select("grp", F.floor(F.col("pos") / BLOCK).alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("root").alias("node"))
    paths = rounds[-1].select("grp", "pos", "path", F.col("root").alias("top"))
    for below in reversed(rounds[:-1]):
        upper = paths.select("grp", F.col("pos").alias("block"), F.col("path").alias("rest"), "top")
        paths = below.withColumn("block", F.floor(F.col("pos") / BLOCK)).join(upper, ["grp", "block"]).select(
            "grp", "pos", F.concat("path", "rest").alias("path"), "top"
        )
    return written(paths, f"{name}-paths")


def build(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tree over ``leaves(grp, id, node, changed)``, as two tables.

    ``(grp, id, node, changed, pos, n)`` are the numbered leaves; ``(grp, pos,
    path, subroot, root)`` has one row per block of leaves, with the path from
    the block's root to the root of all.
    """
    numbered = written(_numbered(leaves, ["id", "node"], "leaves"), "numbered")
    paths = _paths_to_top(written(_block_roots(numbered), "blocks"), "upper")
    # The groups' roots are the leaves of one more tree.
    tops = paths.filter("pos = 0").select(F.lit("").alias("grp"), F.col("grp").alias("id"), F.col("top").alias("node"))
    numbered_tops = written(_numbered(tops, ["id"], "groups"), "numbered-groups")
    roots = _block_roots(numbered_tops)
    above = _paths_to_top(written(roots, "group-blocks"), "group-upper")
    within = _climbed(numbered_tops.select("grp", "pos", "n", "node")).select("pos", "path")
    to_root = numbered_tops.select("pos", "id").join(within, "pos").withColumn("block", F.floor(F.col("pos") / BLOCK)).join(
        above.select(F.col("pos").alias("block"), F.col("path").alias("rest"), F.col("top").alias("root")), "block"
    ).select(F.col("id").alias("grp"), F.concat("path", "rest").alias("to_root"), "root")
    whole = paths.join(to_root, "grp").select("grp", "pos", F.concat("path", "to_root").alias("path"), F.col("top").alias("subroot"), "root")
    return numbered, written(whole, "paths")


def versions(numbered: DataFrame, paths: DataFrame, with_copies: bool = False) -> DataFrame:
    """Proof and version of every leaf of a tree that ``build`` made.

    A leaf with a ``changed`` digest makes a version of the tree, another one
    folds to the tree itself.  ``with_copies`` adds ``copies``, the nodes that a
    version owns, from its leaf to its root.
    """
    kind = numbered.schema["id"].dataType
    names = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, n_copied int"
    names += ", copies array<string>" if with_copies else ""

    def run(key: tuple, block: pa.Table, above: pa.Table) -> pa.Table:
        block, n = block.sort_by("pos"), block.column("n")[0].as_py()
        nodes, changed = _plain(block, "node"), _plain(block, "changed")
        levels = levels_of(nodes, n)
        upper = above.to_pylist()[0]
        rest = [(p["left"], p["right"]) for p in upper["path"]]
        out: dict[str, list] = {name: [] for name in ("proof_sha256", "folded_root", "verified", "n_copied", "copies")}
        for i, (node, other) in enumerate(zip(nodes, changed, strict=True)):
            path = path_of(levels, i) + rest
            copies = copy_path(node if other is None else other, path)
            out["proof_sha256"].append(proof_digest(path))
            out["folded_root"].append(copies[-1])
            out["verified"].append(copies[-1] == upper["root"])
            # A version that changes nothing is the tree itself.
            own = [] if other is None or other == node else copies
            out["n_copied"].append(len(own))
            out["copies"].append(own)
        same = {name: [upper[name]] * len(nodes) for name in ("subroot", "root")}
        table = {"id": block.column("id"), "leaf": nodes, **same, **out}
        table["n_copied"] = pa.array(out["n_copied"], pa.int32())
        if with_copies:
            table["copies"] = pa.array(out["copies"], pa.list_(pa.string()))
        else:
            del table["copies"]
        return pa.table(table)

    mine = numbered.withColumn("block", F.floor(F.col("pos") / BLOCK)).groupBy("grp", "block")
    theirs = paths.withColumnRenamed("pos", "block").groupBy("grp", "block")
    return mine.cogroup(theirs).applyInArrow(run, f"id {kind.simpleString()}, {names}")


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", text_col: str = "text", fields: tuple[str, ...] = FIELDS,
             tamper: Callable[[Column], Column] | None = None, with_copies: bool = False) -> DataFrame:
    """One row per document: id, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``, ``n_copied``.

    ``fields`` go into a leaf, each as text.  Leaves ascend by id within their
    group (a null id first, equal ids by their digest), groups ascend by name
    (null first, bytewise).  ``tamper`` decides by id which documents get their
    text lower-cased (A-Z); by default one in three.  A null text stays null, a
    null id is never tampered with, and a text without capitals makes no new
    version.  Each row is a leaf of its own, repeated ones too.  Of a text,
    whatever its length, only the digest leaves the task that reads it.  An
    empty table has no rows; other columns take no part, and their names do not
    matter.
    """
    chosen = tamper or (lambda doc_id: F.crc32(doc_id.cast("string").cast("binary")) % TAMPER_ONE_IN == 0)
    values = {name: F.col(name) for name in fields}
    lowered = values | {text_col: F.translate(F.col(text_col), _UPPER, _LOWER)}
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("+"), F.col(group_col).cast("string")), F.lit("")).alias("grp"), F.col(id_col).alias("id"),
        record_digest(list(values.values())).alias("node"),
        F.when(chosen(F.col(id_col)), record_digest(list(lowered.values()))).alias("changed"),
    )
    numbered, paths = build(written(leaves, "digests"))
    return versions(numbered, paths, with_copies).withColumnRenamed("id", id_col)


def _sql(levels: int = 8, group_levels: int = 3) -> str:
    """The same tree level by level, for up to 8 ** levels leaves a group and 8 ** group_levels groups."""
    piece = lambda x: f"coalesce(strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR), '-')"
    record = lambda text: "sha256(" + " || ".join(piece(text if x == "text" else x) for x in FIELDS) + ")"
    steps, n_steps = [], 0

    def climb(source: str, count: int, groups: str) -> str:
        nonlocal n_steps
        for _ in range(count):
            side = lambda frame: f"coalesce(string_agg(node, '') OVER (PARTITION BY {groups}, pos // 8 ORDER BY pos ROWS BETWEEN {frame}), '')"
            steps.append(f"""s{n_steps} AS (SELECT *, {side("UNBOUNDED PRECEDING AND 1 PRECEDING")} AS lft, {side("1 FOLLOWING AND UNBOUNDED FOLLOWING")} AS rgt FROM {source})""")
            steps.append(f"""n{n_steps} AS (SELECT {groups}, pos // 8 AS pos, (n + 7) // 8 AS n, CASE WHEN n > 1 THEN sha256(string_agg(node, '' ORDER BY pos)) ELSE min(node) END AS node FROM {source} GROUP BY {groups}, n, pos // 8)""")
            source, n_steps = f"n{n_steps}", n_steps + 1
        return source

    tops = climb("leaves", levels, "grp")
    steps.append(f"tops AS (SELECT 0 AS one, grp, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n, node FROM {tops})")
    root = climb("tops", group_levels, "one")
    fold, proof, joins = [], [], []
    for k in range(levels + group_levels):
        at, place = (f"l.pos // {8**k}", "s{0}.grp = l.grp AND") if k < levels else (f"t.pos // {8 ** (k - levels)}", "")
        joins.append(f"JOIN s{k} ON {place.format(k)} s{k}.pos = {at}")
        proof.append(f"CASE WHEN s{k}.n > 1 THEN s{k}.lft || s{k}.rgt ELSE '' END")
        fold.append(f"f{k} AS (SELECT * REPLACE (CASE WHEN n{k} > 1 THEN sha256(l{k} || cur || r{k}) ELSE cur END AS cur) FROM {'joined' if not k else f'f{k - 1}'})")
    columns = ", ".join(f"s{k}.n AS n{k}, s{k}.lft AS l{k}, s{k}.rgt AS r{k}" for k in range(levels + group_levels))
    return f"""
WITH RECURSIVE g(i, c, k) AS (
       SELECT i, CAST(i AS BIGINT), 0 FROM range(256) r(i)
       UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM g WHERE k < 8),
     t256 AS (SELECT list(c ORDER BY i) AS tab FROM g WHERE k = 8),
     d AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(CAST(doc_id AS VARCHAR))), '..'), lambda h: CAST('0x' || h AS BIGINT))),
             lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255) + 1])), 4294967295) % {TAMPER_ONE_IN} = 0 AS tampered FROM documents, t256),
     h AS (SELECT doc_id, coalesce('+' || lang, '') AS grp, {record("text")} AS node,
             CASE WHEN tampered THEN {record(f"translate(text, '{_UPPER}', '{_LOWER}')")} END AS changed FROM d),
     leaves AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, node) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM h),
     {", ".join(steps)},
     joined AS (SELECT l.doc_id, l.node AS leaf, l.changed, t.node AS subroot, (SELECT node FROM {root}) AS root,
                  sha256({" || ".join(proof)}) AS proof_sha256, coalesce(l.changed, l.node) AS cur, {columns}
                FROM leaves l JOIN tops t ON t.grp = l.grp {" ".join(joins)}),
     {", ".join(fold)}
SELECT doc_id, leaf, subroot, root, proof_sha256, cur AS folded_root, cur = root AS verified,
       CAST(CASE WHEN changed <> leaf THEN 1 + {" + ".join(f"CAST(n{k} > 1 AS INTEGER)" for k in range(levels + group_levels))} ELSE 0 END AS INTEGER) AS n_copied
FROM f{levels + group_levels - 1}
"""


SQL = _sql()
