"""Merkle manifest of a dataset, proven by the preimages of a leaf's ancestors.

A parent stores the concatenated hashes of its children, its preimage.  A leaf
joins the preimages above it, cuts its own 64 characters out of each (what is
left are its siblings) and splices a replacement in to fold a path to the root.

Positions come from a range sort: a row's place in its task plus the counts of
the tasks before it, so no tree is numbered in one task.  Parents are made in
blocks of at most ``BLOCK`` nodes, several levels at a time, tier upon tier;
paths go down again by block, so the upper part of a path is joined once a
block and not once a leaf.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import small_batches, stored, tidy, work_dir

#: Most nodes of a block.
BLOCK = 1024
DIGITS = 64
STEP = pa.list_(pa.struct([("preimage", pa.string()), ("slot", pa.int32())]))
STEPS = "array<struct<preimage:string,slot:int>>"
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(**changed: Column) -> Column:
    """The hash of a row's columns, some of them ``changed``."""
    return F.sha2(F.concat(*(field(changed.get(c, F.col(c))) for c in COLUMNS)), 256)


def levels_in_block(arity: int) -> int:
    levels = 1
    while arity ** (levels + 1) <= BLOCK:
        levels += 1
    return levels


def height(n: int, arity: int) -> int:
    """Levels above ``n`` nodes up to the one that remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // arity), levels + 1
    return levels


def climb(nodes: list[str], levels: int, arity: int) -> tuple[list[list[str]], str]:
    """(preimages by level, hash of the last one) of a block's nodes."""
    preimages = []
    for _ in range(levels):
        preimages.append(["".join(nodes[i : i + arity]) for i in range(0, len(nodes), arity)])
        nodes = [sha(p) for p in preimages[-1]]
    return preimages, nodes[0]


def way_up(preimages: list[list[str]], at: int, arity: int) -> list[dict]:
    """The preimages above node ``at`` of a block and its slot in each."""
    out = []
    for level in preimages:
        out.append({"preimage": level[at // arity], "slot": at % arity})
        at //= arity
    return out


def siblings(path: list[dict]) -> str:
    """The hashes beside a path, from its leaf to the root, each run from left to right."""
    return "".join(s["preimage"][: DIGITS * s["slot"]] + s["preimage"][DIGITS * (s["slot"] + 1) :] for s in path)


def folded(node: str, path: list[dict]) -> str:
    """The root that ``node`` would give in its place."""
    for s in path:
        node = sha(s["preimage"][: DIGITS * s["slot"]] + node + s["preimage"][DIGITS * (s["slot"] + 1) :])
    return node


def numbered(nodes: DataFrame, folder: str, name: str) -> DataFrame:
    """Adds pos, from 0 in each tree by (ord, hash), and total, the nodes of the tree."""
    order = ("tree", "ord", "hash")
    rows = stored(nodes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_mid", F.monotonically_increasing_id()), folder, f"{name}-sorted")
    task = F.shiftright("_mid", 33)
    starts = rows.groupBy("tree", task.alias("_task")).agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    tree = Window.partitionBy("tree")
    before = F.sum("_n").over(tree.orderBy("_task")) - F.col("_n")
    starts = starts.select("tree", "_task", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(tree).alias("total"))
    return rows.withColumn("_task", task).join(starts, ["tree", "_task"]).withColumn("pos", F.col("_mid") + F.col("_shift")).drop("_task", "_mid", "_shift", "ord")


def _rows_of(out: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)


def parents(nodes: DataFrame, folder: str, name: str, arity: int) -> list[DataFrame]:
    """The parents above numbered nodes (tree, hash, row, pos, total), a table of blocks for each tier.

    A block: tree, block, total (the tree's nodes at its bottom), nodes (hash and,
    in the first tier, row), preimages by level, top (its last hash).  Blocks of a
    tree that has only one end it.
    """
    per, span = levels_in_block(arity), arity ** levels_in_block(arity)
    most = nodes.agg(F.max("total")).first()[0] or 0
    row_type = nodes.schema["row"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            total, made = batch.column("total").to_pylist(), []
            hashes = [[n["hash"] for n in block] for block in batch.select(["nodes"]).column(0).to_pylist()]
            for n, block in zip(total, hashes):
                made.append(climb(block, min(per, height(n, arity)), arity))
            tops = [pa.array([m[0] for m in made], pa.list_(pa.list_(pa.string()))), pa.array([m[1] for m in made], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *tops], names=[*batch.schema.names, "preimages", "top"])

    tiers, left = [], most
    while left > 0:
        block = F.floor(F.col("pos") / F.lit(span)).cast("long").alias("block")
        groups = nodes.groupBy("tree", block, "total").agg(F.array_sort(F.collect_list(F.struct("pos", "hash", "row"))).alias("nodes"))
        shape = f"tree string, block long, total long, nodes array<struct<pos:bigint,hash:string,row:{row_type}>>, preimages array<array<string>>, top string"
        tiers.append(stored(groups.mapInArrow(tidy(run), shape), folder, f"{name}-{len(tiers)}"))
        left = 0 if left <= span else -(-left // span)
        up = tiers[-1].where(F.col("total") > span)
        nodes = up.select("tree", F.col("top").alias("hash"), F.lit(None).cast(row_type).alias("row"), F.col("block").alias("pos"), F.ceil(F.col("total") / F.lit(span)).cast("long").alias("total"))
    return tiers


def tops(tiers: list[DataFrame], arity: int) -> DataFrame:
    """tree and hash of what remains of each tree."""
    span, out = arity ** levels_in_block(arity), None
    for tier in tiers:
        end = tier.where(F.col("total") <= span).select("tree", F.col("top").alias("hash"))
        out = end if out is None else out.unionAll(end)
    return out


def descend(tiers: list[DataFrame], above: DataFrame, arity: int, emit, shape: str, schema: pa.Schema, folder: str, name: str) -> DataFrame:
    """Every node of the first tier as ``emit(row, hash, path, subroot, root)``; ``above``: tree, path, subroot and root of each tree's top."""
    span = arity ** levels_in_block(arity)
    carried, waiting = ("path", "subroot", "root"), above

    def down(batches):
        fields = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("path", STEP), ("subroot", pa.string()), ("root", pa.string())])
        for batch in batches:
            for tree, nodes, preimages, path, subroot, root in zip(*(batch.column(c).to_pylist() for c in ("tree", "nodes", "preimages", *carried))):
                yield _rows_of([(tree, n["pos"], way_up(preimages, i, arity) + path, subroot, root) for i, n in enumerate(nodes)], fields)

    def leaves(batches):
        for batch in batches:
            for nodes, preimages, path, subroot, root in zip(*(batch.column(c).to_pylist() for c in ("nodes", "preimages", *carried))):
                yield _rows_of([emit(n["row"], n["hash"], way_up(preimages, i, arity) + path, subroot, root) for i, n in enumerate(nodes)], schema)

    passed = None
    for t in range(len(tiers) - 1, -1, -1):
        ending = tiers[t].where(F.col("total") <= span).join(waiting, "tree").select("tree", "block", "nodes", "preimages", *carried)
        blocks = ending if passed is None else ending.unionAll(tiers[t].where(F.col("total") > span).join(passed, ["tree", "block"]).select("tree", "block", "nodes", "preimages", *carried))
        if t == 0:
            return blocks.mapInArrow(tidy(leaves), shape)
        passed = stored(blocks.mapInArrow(tidy(down), f"tree string, block long, path {STEPS}, subroot string, root string"), folder, f"{name}-paths-{t}")
    raise ValueError("no tiers")


def manifest(docs: DataFrame, changed: Column, folder: str, arity: int = 2) -> dict:
    """The stored tables of a manifest: ``leaves``, the tiers of ``parents`` of the trees by lang, those of ``crown`` above them.

    ``changed`` is the hash of what a proof is tried with in a leaf's place, null
    for the leaf itself.
    """
    small_batches(docs.sparkSession)
    lang = F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("="), F.col("lang")))
    leaves = stored(docs.select(lang.alias("tree"), F.col("doc_id").alias("ord"), leaf().alias("hash"), F.struct("doc_id", changed.alias("changed")).alias("row")), folder, "leaves")
    trees = parents(numbered(leaves, folder, "trees"), folder, "parents", arity)
    if not trees:
        return {"leaves": leaves, "parents": [], "crown": []}
    subroots = tops(trees, arity).select(F.lit("").alias("tree"), F.col("tree").alias("ord"), "hash", F.struct(F.col("tree").alias("lang_tree")).alias("row"))
    return {"leaves": leaves, "parents": trees, "crown": parents(numbered(subroots, folder, "crowned"), folder, "crown", arity)}


def merkle_query(docs: DataFrame, arity: int = 2, modulus: int = 7) -> DataFrame:
    """Leaf, roots, proof and a tampered proof's outcome for every document.

    Trees by lang (null is one of its own), leaves by doc_id (null first), rows of
    one doc_id by their hash.  Returns doc_id, leaf, subroot, root, proof_sha256 (of
    the siblings from leaf to root; of nothing where there are none), folded_root
    (with n_chars one larger where ``modulus`` divides the crc32 of doc_id; a null
    doc_id or n_chars isn't changed) and verified.  Texts are hashed whole,
    repeated rows are leaves each, an empty table gives no rows, other columns
    are left aside.
    """
    spark = docs.sparkSession
    folder = work_dir(spark)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % modulus == 0, leaf(n_chars=F.col("n_chars") + 1))
    made = manifest(docs, tampered, folder, arity)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if not made["parents"]:
        return spark.createDataFrame([], shape)
    root = tops(made["crown"], arity).select("tree", F.array().cast(STEPS).alias("path"), F.col("hash").alias("subroot"), F.col("hash").alias("root"))
    above_schema = pa.schema([("tree", pa.string()), ("path", STEP), ("subroot", pa.string()), ("root", pa.string())])
    above = descend(made["crown"], root, arity, lambda row, node, path, _, root: (row["lang_tree"], path, node, root), f"tree string, path {STEPS}, subroot string, root string", above_schema, folder, "crown")
    above = stored(above, folder, "above")

    def proof(row, node, path, subroot, root):
        again = folded(row["changed"] or node, path)
        return row["doc_id"], node, subroot, root, sha(siblings(path)), again, again == root

    id_arrow = pa.int64() if id_type == "bigint" else pa.int32() if id_type == "int" else pa.string()
    schema = pa.schema([("doc_id", id_arrow), *((c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_())])
    return descend(made["parents"], above, arity, proof, shape, schema, folder, "trees")
