"""Merkle manifest of a dataset: leaf, language and root hashes, and a proof per row that a recursive query climbs.

Every row is a leaf. The leaves of one language, in id order, form a tree in which every `FAN` consecutive nodes become
their hash; the language roots, in order of the language, form one more tree above them. Places inside a language come
from one range sort and the row counts of its partitions, so no language is ever in one task.

The built levels are stored as parent-linked node rows: a node, its parent, and the hashes of its siblings on the left
and on the right. A recursive query then ascends from the leaves: each step joins the node rows, appends the siblings
to the proof and folds them around the hash that came up so far. The leaves of one run of `FAN` share every node above
them, so a row of the recursion carries a run with up to `FAN` folded hashes and one proof; the siblings inside the run
are the run itself. A node high in a tree would be a hot join key: node rows are repeated once per `SPAN` runs below
them, which adds a few rows per `SPAN`, and no key ever meets more than `SPAN` runs.

Defined cases: null fields are hashed as `-`; a null language is a language of its own, before all others; rows without
an id come first and are never tampered with; rows with equal ids stand in the order of their leaf hash, and equal rows
are separate leaves; a single leaf is its own root with the proof of no siblings; an empty table gives no rows.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talloom.llm.common import prepared, stored

#: Children of a node, and leaves of a run.
FAN = 8
#: Runs that may meet one copy of a node row.
SPAN = 512

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_hash(*values: Column) -> Column:
    """Binary sha256 over the length-prefixed fields of a row."""
    return F.unhex(F.sha2(F.concat(*[_field(v) for v in values]), 256))


def _hex(value: Column) -> Column:
    return F.lower(F.hex(value))


def _joined(hashes: Column) -> Column:
    """Binary hashes as one hexadecimal text."""
    return F.array_join(F.transform(hashes, _hex), "")


def leaves(docs: DataFrame, order: str, group: str, fields: list[str], changed: dict[str, Column], where: Column) -> DataFrame:
    """id, grp, leaf and `seen` (the leaf found later: of changed fields where `where` holds) of every row, numbered."""
    prepared(docs.sparkSession)
    own = [F.col(f"`{n}`") for n in fields]
    new = [changed.get(n, F.col(f"`{n}`")) for n in fields]
    rows = docs.select(
        F.col(f"`{order}`").alias("id"), F.col(f"`{group}`").alias("grp"), row_hash(*own).alias("leaf"),
        F.when(F.coalesce(where, F.lit(False)), row_hash(*new)).alias("seen"), F.monotonically_increasing_id().alias("row"),
    )
    return stored(rows, "leaves")


def placed(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Rows with their place from 0 inside their group as `idx`, and the group's size as `n`.

    One range sort over all groups; a place is the row's number in its partition plus what the group has in earlier
    partitions. Only counts per partition and group are ever brought together.
    """
    by = [F.col(c).asc_nulls_first() for c in group + order]
    sorted_ = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    sorted_ = stored(sorted_.withColumn("_seq", F.monotonically_increasing_id()), "sorted")
    piece = F.shiftright("_seq", 33)
    pieces = sorted_.groupBy(piece.alias("_p"), *[F.col(c).alias(f"_g_{c}") for c in group]).agg(
        F.count("*").alias("_n"), F.min("_seq").alias("_first")
    )
    own = Window.partitionBy(*[f"_g_{c}" for c in group])
    earlier = own.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumns({
        "_before": F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first"), "n": F.sum("_n").over(own),
    }).drop("_n", "_first")
    on = [piece == F.col("_p"), *[F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in group]]
    return sorted_.join(pieces, on).select(*rows.columns, (F.col("_seq") + F.col("_before")).alias("idx"), "n")


def _above(n: int) -> int:
    return -(-n // FAN)


def _runs(nodes: DataFrame, carry: list[str]) -> DataFrame:
    """Each run of FAN consecutive nodes (tree, n, idx, hash) as a row with its sorted `items`."""
    item = F.struct("idx", "hash", *carry)
    run = F.floor(F.col("idx") / FAN).cast("long").alias("run")
    return nodes.groupBy("tree", "n", run).agg(F.array_sort(F.collect_list(item)).alias("items"))


def _tops(runs: DataFrame) -> DataFrame:
    """The nodes above the runs of trees that still have several nodes."""
    hashes = F.transform("items", lambda x: x["hash"])
    return runs.where("n > 1").select(
        "tree", F.ceil(F.col("n") / FAN).cast("long").alias("n"), F.col("run").alias("idx"), F.unhex(F.sha2(_joined(hashes), 256)).alias("hash")
    )


def _linked(runs: DataFrame, level: int) -> DataFrame:
    """Parent-linked node rows: tree, level, idx, parent, and the hashes of the siblings left and right of the node."""
    hashes = F.transform("items", lambda x: x["hash"])
    at = F.posexplode("items").alias("_k", "_item")
    rows = runs.where("n > 1").select("tree", "n", "run", hashes.alias("_h"), at)

    def glued(part: Column) -> Column:
        return F.aggregate(part, F.lit(b""), lambda acc, x: F.concat(acc, x))

    return rows.select(
        "tree", "n", F.lit(level).alias("level"), F.col("_item.idx").alias("idx"), F.col("run").alias("parent"),
        glued(F.slice("_h", F.lit(1), F.col("_k"))).alias("lefts"),
        glued(F.slice("_h", F.col("_k") + 2, F.lit(FAN))).alias("rights"),
    )


def grown(nodes: DataFrame, first: DataFrame | None = None) -> tuple[DataFrame, DataFrame, int]:
    """Builds all levels above nodes (tree, n, idx, hash): the roots (tree, hash), the node rows, and the height.

    first: stored runs of the lowest level, where the caller has them already.
    """
    runs = stored(_runs(nodes, []), "level-0") if first is None else first
    most = runs.agg(F.max("n")).first()[0] or 0
    roots = runs.where("n = 1").select("tree", F.get("items", F.lit(0))["hash"].alias("hash"))
    rows, level = _linked(runs, 0), 0
    while most > 1:
        most, level = _above(most), level + 1
        runs = stored(_runs(_tops(runs), []), f"level-{level}")
        rows = rows.unionByName(_linked(runs, level))
        roots = roots.unionByName(runs.where("n = 1").select("tree", F.get("items", F.lit(0))["hash"].alias("hash")))
    return roots, rows, level


_CLIMB = """
WITH RECURSIVE climb(tree, part, run, level, idx, folds, proof) AS (
  SELECT tree, part, run, level, idx, folds, CAST('' AS BINARY) FROM {anchor}
  UNION ALL
  SELECT c.tree, c.part, c.run, c.level + 1, n.parent,
         transform(c.folds, f -> unhex(sha2(concat(lower(hex(n.lefts)), lower(hex(f)), lower(hex(n.rights))), 256))),
         concat(c.proof, n.lefts, n.rights)
  FROM climb c JOIN {nodes} n ON c.tree = n.tree AND c.part = n.part AND c.level = n.level AND c.idx = n.idx)
SELECT tree, run, level, folds, proof FROM climb
"""


@contextmanager
def _unbounded_recursion(spark: SparkSession):
    """The recursion has a row per run and level: its row limit is lifted, and put back afterwards."""
    key = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _folded_in_run(items: Column) -> Column:
    """What each leaf of a run folds to one level up, given the other leaves as they were."""
    hashes = F.transform(items, lambda x: _hex(x["hash"]))

    def up(x: Column, k: Column) -> Column:
        found = _hex(F.coalesce(x["seen"], x["hash"]))
        around = F.concat(F.slice(hashes, F.lit(1), k), F.array(found), F.slice(hashes, k + 2, F.lit(FAN)))
        return F.unhex(F.sha2(F.array_join(around, ""), 256))

    return F.transform(items, up)


def manifest(rows: DataFrame) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root and verified of every leaf of `leaves`."""
    spark = rows.sparkSession
    groups = stored(rows.groupBy("grp").agg(F.count("*").alias("size")), "groups")
    ranks = stored(placed(groups.withColumn("_all", F.lit(0)), ["_all"], ["grp"]).select("grp", F.col("idx").alias("tree")), "ranks")

    nodes = placed(rows, ["grp"], ["id", "leaf", "row"])
    # the rank of a language joins the runs, of which each task has few, rather than all leaves of a hot language
    item = F.struct("idx", F.col("leaf").alias("hash"), "id", "seen")
    run = F.floor(F.col("idx") / FAN).cast("long").alias("run")
    runs = nodes.groupBy("grp", "n", run).agg(F.array_sort(F.collect_list(item)).alias("items"))
    runs = runs.join(ranks.withColumnRenamed("grp", "_grp"), F.col("grp").eqNullSafe(F.col("_grp"))).drop("grp", "_grp")
    runs = stored(runs, "runs")

    subroots, inner, _ = grown(runs, runs)
    subroots = stored(subroots, "subroots")
    total = ranks.count()
    top = subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(total).cast("long").alias("n"), F.col("tree").alias("idx"), "hash")
    roots, outer, above = grown(top)
    root = roots.select("hash").first()
    if root is None:
        return _empty(rows)

    # how high each tree is, and into how many spans its runs fall
    size = groups.join(ranks.withColumnRenamed("grp", "_grp"), F.col("grp").eqNullSafe(F.col("_grp"))).select("tree", "size")
    trees = size.join(subroots, "tree").select(
        "tree", F.col("hash").alias("subroot"), F.ceil(F.col("size") / FAN).cast("long").alias("runs"),
        F.aggregate(F.sequence(F.lit(1), F.lit(21)), F.struct(F.lit(0).alias("d"), F.col("size").alias("n")), lambda a, _: F.struct(
            (a["d"] + F.when(a["n"] > 1, 1).otherwise(0)).alias("d"), F.ceil(a["n"] / FAN).cast("long").alias("n")))["d"].alias("depth"),
    )
    trees = stored(trees, "trees")
    links = _spread(inner.where("level > 0"), outer, trees, above)

    anchor = runs.join(trees.select("tree", "depth"), "tree").select(
        "tree", F.floor(F.col("run") / SPAN).cast("long").alias("part"), "run", F.least(F.col("depth"), F.lit(1)).alias("level"),
        F.when(F.col("depth") <= 1, F.col("tree")).otherwise(F.col("run")).alias("idx"),
        F.when(F.col("depth") == 0, F.transform("items", lambda x: F.coalesce(x["seen"], x["hash"]))).otherwise(_folded_in_run(F.col("items"))).alias("folds"),
    )
    with _unbounded_recursion(spark):
        climbed = stored(spark.sql(_CLIMB, anchor=anchor, nodes=stored(links, "nodes")), "climb")

    known = trees.select("tree", F.col("depth") + above, "subroot").toDF("tree", "height", "subroot")
    found = climbed.join(known, "tree").where("level = height").drop("level", "height")
    at = F.posexplode(F.arrays_zip(F.col("items"), F.col("folds"))).alias("_k", "_x")
    each = runs.join(found, ["tree", "run"]).select("proof", "subroot", F.transform("items", lambda x: x["hash"]).alias("_h"), at)
    others = F.concat(F.slice("_h", F.lit(1), F.col("_k")), F.slice("_h", F.col("_k") + 2, F.lit(FAN)))
    return each.select(
        F.col("_x.items.id").alias("id"), _hex(F.col("_x.items.hash")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"),
        _hex(F.lit(bytes(root[0]))).alias("root"), F.sha2(F.concat(_joined(others), _hex(F.col("proof"))), 256).alias("proof_sha256"),
        _hex(F.col("_x.folds")).alias("folded_root"), (F.col("_x.folds") == F.lit(bytes(root[0]))).alias("verified"),
    )


def _spread(inner: DataFrame, outer: DataFrame, trees: DataFrame, above: int) -> DataFrame:
    """Node rows as the climb meets them: (tree, part, level, idx) of the tree that climbs, parent and siblings.

    A node that covers more than SPAN runs has a row per span. The nodes above the language roots go on counting
    levels where the language ends, and are repeated per language.
    """
    reach = F.pow(F.lit(FAN), F.col("level") - 1).cast("long")  # runs below a node
    own = inner.join(trees.select("tree", "runs", "depth"), "tree").select(
        "tree", F.floor(F.col("idx") * reach / SPAN).cast("long").alias("_a"),
        F.floor((F.least((F.col("idx") + 1) * reach, F.col("runs")) - 1) / SPAN).cast("long").alias("_b"),
        "level", "idx", F.when(F.col("level") + 1 == F.col("depth"), F.col("tree")).otherwise(F.col("parent")).alias("parent"), "lefts", "rights",
    )
    own = own.select("tree", F.explode(F.sequence("_a", "_b")).alias("part"), "level", "idx", "parent", "lefts", "rights")
    if not above:
        return own
    levels = F.explode(F.sequence(F.lit(0), F.lit(above - 1))).alias("_level")
    steps = trees.select("tree", "runs", "depth", levels).withColumn("_idx", F.floor(F.col("tree") / F.pow(F.lit(FAN), F.col("_level"))).cast("long"))
    outer = outer.select(F.col("level").alias("_level"), F.col("idx").alias("_idx"), "parent", "lefts", "rights")
    high = steps.join(outer, ["_level", "_idx"]).select(
        "tree", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("runs") - 1) / SPAN).cast("long"))).alias("part"),
        (F.col("depth") + F.col("_level")).alias("level"), F.col("_idx").alias("idx"), "parent", "lefts", "rights",
    )
    return own.unionByName(high)


def _empty(rows: DataFrame) -> DataFrame:
    text = [F.lit("").alias(n) for n in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]
    return rows.select("id", *text, F.lit(True).alias("verified")).limit(0)


def document_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of documents, checked against a copy in which every third document (by id) came in lower case."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    lowered = F.translate("text", _UPPER, _LOWER)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    found = manifest(leaves(docs, "doc_id", "lang", fields, {"text": lowered}, hit))
    return found.withColumnRenamed("id", "doc_id")
