"""Sources mixed to target shares by hierarchical budgeting.

The budget goes down a tree of levels, here domain, language and source. A leaf offers its tokens as
often as they may be repeated. What a leaf can't use goes to its siblings first and to the rest of
the tree only when they are full. Each leaf takes whole epochs of its documents and, in a seeded
order, the prefix of the next epoch that its budget still holds.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexicarta.runtime import cut, spread

TOKENIZERS = "/opt/tokenizers"
#: Parts of a leaf's seeded order over which token sums are taken: a leaf is never one task.
SLICES = 1024
#: Leaves of the tree that budgets are worked out for; ValueError beyond.
MOST_LEAVES = 100_000


def token_counts(df: DataFrame, text: Column, columns: dict[str, Column], tokenizer: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """The given columns, as text or whole numbers, and ``tokens``, the length of ``text`` in tokens of a public byte-level BPE.

    ``tokenizer`` is the path of its ranks. Null and empty texts have 0 tokens.
    """
    narrow = df.select(*[c.alias(name) for name, c in columns.items()], text.cast("string").alias("_text"))
    fields = [f for f in narrow.schema.fields if f.name != "_text"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "tokens bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(tokenizer, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        # the split pattern that byte-level BPE vocabularies of this size are published with
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for batch in batches:
            counts = [len(encode(t)) if t else 0 for t in batch.column(len(fields)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], names=[*(f.name for f in fields), "tokens"])

    return spread(narrow).mapInArrow(run, schema)


@dataclass
class Node:
    """A place in the tree: what it weighs among its siblings, what it may give and what it is to give."""

    weight: float = 0.0
    capacity: float = 0.0
    budget: float = 0.0
    children: dict[str, Node] = field(default_factory=dict)


def share_out(budget: float, nodes: Sequence[Node]) -> float:
    """Give ``budget`` to siblings by weight, what full ones can't take to the others; return what none could take."""
    open_ = [n for n in nodes if n.capacity > n.budget and n.weight > 0]
    while budget > 1e-9 and open_:
        total = sum(n.weight for n in open_)
        part = budget / total
        full = [n for n in open_ if n.budget + part * n.weight >= n.capacity]
        if not full:
            for n in open_:
                n.budget += part * n.weight
            return 0.0
        for n in full:
            budget -= n.capacity - n.budget
            n.budget = n.capacity
        open_ = [n for n in open_ if n not in full]
    return max(0.0, budget)


def budgets(leaves: Sequence[tuple[tuple[str, ...], float, float]], total: float) -> dict[tuple[str, ...], float]:
    """The budget of each leaf ``(path, weight, capacity)`` when ``total`` goes down the tree.

    A node weighs what its leaves weigh and its own share comes first: a shortage below it is made
    up by its other descendants as long as they can, and only the rest goes to its siblings.
    """
    root = Node()
    for path, weight, capacity in leaves:
        node = root
        node.weight += weight
        node.capacity += capacity if weight > 0 else 0
        for name in path:
            node = node.children.setdefault(name, Node())
            node.weight += weight
            node.capacity += capacity if weight > 0 else 0
    root.budget = min(total, root.capacity)

    def down(node: Node) -> None:
        # a child's capacity is its whole subtree's, so siblings get a shortage before anything is left to hand up
        share_out(node.budget, list(node.children.values()))
        for child in node.children.values():
            down(child)

    down(root)
    found = {}
    for path, *_ in leaves:
        node = root
        for name in path:
            node = node.children[name]
        found[path] = node.budget
    return found


def mix(
    counted: DataFrame, levels: Sequence[str], targets: DataFrame, seed: int = 17, total: float | None = None, most_leaves: int = MOST_LEAVES
) -> tuple[DataFrame, DataFrame]:
    """Documents to take and how often, and the shares reached.

    Args:
        counted: ``doc_id``, ``tokens``, ``source`` and the columns of ``levels``; no other column is read.
        levels: the tree from the root down; one of them is ``source``.
        targets: ``source, target_share, max_repeats``.
        total: tokens of the whole mix; by default those of all documents.
        most_leaves: a bound on the leaves, whose budgets are worked out by the driver; ValueError beyond it.

    Returns:
        ``(doc_id, source, tokens, times)`` of all documents taken, and ``(source, target_share,
        available, budget, tokens, actual_share, documents, most_times)`` of all targets, also of
        those without documents.

    A source's weight is spread over its leaves by the tokens they have. Documents
    of a null source or of one without a target aren't taken, though their tokens count in the
    default total; documents without tokens aren't taken. Repeated rows are documents of their own.
    A document is taken at most ``max_repeats`` times. The prefix ends before the first document
    that would exceed the leaf's budget, so a leaf falls short of it by less than one document.
    A repeated target source takes its least share and repeats.
    """
    spark = counted.sparkSession
    levels = list(levels)
    counted = cut(counted.select("doc_id", "tokens", *levels))
    goals = targets.where("source is not null").groupBy("source").agg(F.min("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    usable = counted.where("tokens > 0").join(goals, "source")
    key = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in levels]
    # one row per leaf: as many as targets and values of the other levels
    sums = usable.groupBy(*key, "target_share", "max_repeats").agg(F.sum("tokens").alias("have")).limit(most_leaves + 1).collect()
    if len(sums) > most_leaves:
        raise ValueError(f"the tree has more than {most_leaves} leaves")
    sums.sort(key=lambda r: tuple(r[c] for c in levels))
    whole = total if total is not None else (counted.agg(F.sum("tokens")).first()[0] or 0)
    of_source: dict[str, float] = {}
    for r in sums:
        of_source[r["source"]] = of_source.get(r["source"], 0) + r["have"]
    leaves = [(tuple(r[c] for c in levels), r["target_share"] * r["have"] / of_source[r["source"]], float(r["have"] * max(0, r["max_repeats"]))) for r in sums]
    given = budgets(leaves, whole)
    plan = [(*path, int(given[path]) // r["have"], int(given[path]) % r["have"]) for (path, *_), r in zip(leaves, sums)]
    plan = [(*p[:-2], *((p[-2], p[-1]) if p[-2] < r["max_repeats"] else (r["max_repeats"], 0))) for p, r in zip(plan, sums)]
    columns = ", ".join(f"`{c}` string" for c in levels)
    epochs = spark.createDataFrame(plan, f"{columns}, epochs bigint, rest bigint")

    # the seeded order of the epoch that is taken in part, in slices whose sums are added up first
    at = F.xxhash64(F.lit(seed), "epochs", "doc_id")
    placed = usable.select("doc_id", "tokens", *key).join(F.broadcast(epochs), levels).withColumn("at", at).withColumn("slice", F.shiftrightunsigned("at", 54).cast("int"))
    slices = placed.groupBy(*levels, "slice").agg(F.sum("tokens").alias("in_slice"))
    before = Window.partitionBy(*levels).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.withColumn("offset", F.coalesce(F.sum("in_slice").over(before), F.lit(0))).drop("in_slice")
    within = Window.partitionBy(*levels, "slice").orderBy("at", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    running = placed.withColumn("sofar", F.sum("tokens").over(within)).join(offsets, [*levels, "slice"])
    chosen = running.withColumn("times", F.col("epochs") + F.when(F.col("offset") + F.col("sofar") <= F.col("rest"), 1).otherwise(0)).where("times > 0")
    taken = cut(chosen.select("doc_id", "source", "tokens", "times"))

    got = taken.groupBy("source").agg(F.sum(F.col("tokens") * F.col("times")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("times").alias("most_times"))
    aims = spark.createDataFrame([(p[levels.index("source")], float(b), float(r["have"])) for (p, b), r in zip(given.items(), sums)], "source string, budget double, have double")
    aims = aims.groupBy("source").agg(F.sum("budget").alias("budget"), F.sum("have").cast("bigint").alias("available"))
    everything = taken.agg(F.sum(F.col("tokens") * F.col("times")).alias("all_tokens"))
    shares = (
        goals.join(aims, "source", "left")
        .join(got, "source", "left")
        .crossJoin(F.broadcast(everything))  # a single row
        .select(
            "source", "target_share", F.coalesce("available", F.lit(0)).alias("available"), F.round(F.coalesce("budget", F.lit(0.0)), 0).cast("bigint").alias("budget"),
            F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"),
            F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_times", F.lit(0)).alias("most_times"),
        )
    )
    return taken, shares

