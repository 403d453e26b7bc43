"""Trie of conversation prefixes, built family by family and merged.

Conversations whose ids have one base (``id - id % 5``) are a family: each is the head of the
base's own turns, then its own turns after as many.  A cogroup by base rebuilds a family and
builds its small trie; only its combined nodes are shuffled for the merge of all families.

A node is the path of its turns: depth and 128 bits, the exclusive-or of a hash of each turn
and its place.  The smallest member of a node *owns* it.  The nodes that a conversation owns
are the end of its path, so sums over subtrees need no walk over the levels of the trie:

* a childless node is owned by one conversation, and counts once for each node on its path;
* the nodes of a subtree weigh ``(members - 1) * bytes``: every member's bytes but the owner's,
  so each conversation adds the bytes of the nodes on its path that it does not own.

Hot keys: a node of many families is summed before its shuffle; turns of one conversation are
sorted over all tasks (``running``) and those beyond ``NEAR`` go round the cogroup, so neither
a turn that all share nor a conversation with a third of all rows meets in one task.  Ids
of members that end in one node are packed in runs before they meet, and hashed as a stream.

Cases: rows without a conversation id belong to no conversation; null role and text are
empty; turns of equal number follow by a digest of role and text; repeated rows are turns of
their own; the remainder of a negative id is that of SQL; an empty table gives no nodes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recallkit.llm.common import discard, join_heavy, map_arrow, staged

FAMILY = 5
#: Heads have fewer turns than this.
HEADS = 9
#: Own turns of a conversation that the cogroup of its family sees.
NEAR = 64
#: Ids of one run of members that end in a node.
RUN = 4096
_MASK = (1 << 64) - 1
PATH = ["depth", "x", "y"]
_STEP = (
    "conv_id bigint, depth bigint, x bigint, y bigint, px bigint, py bigint, "
    "before bigint, bytes bigint, n bigint, last boolean, goes_on boolean"
)


def _mixed(depth: np.ndarray, half: np.ndarray, salt: int) -> np.ndarray:
    """64 bits of a turn's half digest at a depth: the finaliser of splitmix64, twice."""
    with np.errstate(over="ignore"):
        z = depth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)
        for extra in (half.astype(np.int64).view(np.uint64), np.uint64(0)):
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            z = (z ^ (z >> np.uint64(31))) ^ extra
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _path_bits(depth: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _mixed(depth, a, 1).view(np.int64), _mixed(depth, b, 2).view(np.int64)


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, a, b, bytes``: the digest of role and text, and the text's bytes."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), digest.alias("digest"),
        F.octet_length(text).cast("bigint").alias("bytes"),
    )
    halves = [F.xxhash64("digest", F.lit(i)).alias(name) for i, name in enumerate("ab")]
    return rows.select("conv_id", "turn", *halves, "bytes")


def running(df: DataFrame, order: list, xors: list[str], sums: list[str], label: str) -> DataFrame:
    """``k`` and running ``xors`` and ``sums`` over the rows of each ``conv_id``, in ``order``, this row included.

    Rows are sorted over all tasks by range.  A task starts each conversation at zero; what the
    earlier tasks hold of the one that it continues (one at most, so the carried rows are fewer
    than the tasks) is added after.  The columns ``xors`` and ``sums`` are replaced.
    """
    last = F.monotonically_increasing_id()  # equal rows can then lie in different tasks
    spread = df.withColumn("__tie", last).repartitionByRange("conv_id", *order, "__tie").sortWithinPartitions("conv_id", *order, "__tie")
    rows = spread.drop("__tie").withColumn("part", F.spark_partition_id()).withColumn("k", F.lit(0).cast("bigint"))
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            got = {c: batch.column(i) for i, c in enumerate(names)}
            conv = got["conv_id"].to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
            of = np.searchsorted(starts, np.arange(len(conv)), "right") - 1
            begun = of > 0 if held == conv[0] else np.ones(len(conv), dtype=bool)
            for c in ["k", *sums, *xors]:
                own = np.ones(len(conv), np.int64) if c == "k" else got[c].to_numpy(zero_copy_only=False).astype(np.int64)
                if c in xors:
                    all_ = np.bitwise_xor.accumulate(own)
                    value = all_ ^ (all_ ^ own)[starts][of]
                    value = np.where(begun, value, value ^ state.get(c, 0))
                else:
                    all_ = np.cumsum(own)
                    value = all_ - (all_ - own)[starts][of]
                    value = np.where(begun, value, value + state.get(c, 0))
                state[c] = value[-1]
                got[c] = pa.array(value, pa.int64())
            held = conv[-1]
            yield pa.RecordBatch.from_arrays([got[c] for c in names], names=names)

    local = staged(map_arrow(rows, run, rows.schema), label)
    ends = local.groupBy("conv_id", "part").agg(
        F.max("k").alias("k"), *[F.max_by(c, "k").alias(c) for c in [*sums, *xors]]
    )
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(
        "conv_id", "part", *[F.sum(c).over(earlier).alias(f"__{c}") for c in ["k", *sums]],
        *[F.bit_xor(c).over(earlier).alias(f"__{c}") for c in xors],
    ).where("__k IS NOT NULL")
    joined = local.join(F.broadcast(carry), ["conv_id", "part"], "left")
    fixed = {c: F.col(c) + F.coalesce(F.col(f"__{c}"), F.lit(0)) for c in ["k", *sums]}
    fixed |= {c: F.col(c).bitwiseXOR(F.coalesce(F.col(f"__{c}"), F.lit(0))) for c in xors}
    return joined.select(*[fixed.get(c, F.col(c)).alias(c) for c in names if c != "part"])


def _family(heads: pa.Table, own: pa.Table, near: int) -> pa.Table:
    """Steps of a family: ``n`` members at the row of the family's owner of a node, 0 at the others'."""
    head = heads.sort_by("k")
    out: dict[str, list] = {name: [] for name in (f.split()[0] for f in _STEP.split(", "))}
    nodes: dict[tuple[int, int, int], list[int]] = {}  # place of its row, members
    own = own.sort_by([("conv_id", "ascending"), ("k", "ascending")])
    convs = own.column("conv_id").to_numpy()
    cuts = np.flatnonzero(np.r_[True, convs[1:] != convs[:-1], True])
    for start, stop in zip(cuts[:-1], cuts[1:]):
        conv = int(convs[start])
        h = zlib.crc32(str(conv).encode()) % HEADS
        mine = own.slice(start + h, max(0, min(stop - start, near) - h))
        more = stop - start > near
        a, b, size = (np.concatenate([head.column(c).to_numpy()[:h], mine.column(c).to_numpy()]) for c in ("a", "b", "bytes"))
        depth = np.arange(len(a) + 1)
        bits = [np.r_[0, np.bitwise_xor.accumulate(v)] for v in _path_bits(depth[1:], a, b)]
        x, y = (v.astype(np.int64).tolist() for v in bits)
        size = [0, *size.tolist()]
        before = (np.cumsum(size) - size).tolist()
        for d in range(len(x)):
            node = nodes.setdefault((d, x[d], y[d]), [len(out["n"]), 0])
            node[1] += 1
            out["n"].append(0)
        out["conv_id"] += [conv] * len(x)
        out["depth"] += depth.tolist()
        out["x"] += x
        out["y"] += y
        out["px"] += [None, *x[:-1]]
        out["py"] += [None, *y[:-1]]
        out["before"] += before
        out["bytes"] += size
        out["last"] += [False] * (len(x) - 1) + [not more]
        out["goes_on"] += [True] * (len(x) - 1) + [more]
    for place, members in nodes.values():
        out["n"][place] = members
    return pa.table({k: pa.array(v, pa.bool_() if k in ("last", "goes_on") else pa.int64()) for k, v in out.items()})


def family_steps(numbered: DataFrame, near: int = NEAR) -> DataFrame:
    """Steps of all conversations up to ``near`` own turns, by a cogroup of heads and turns by base."""
    base = (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base")
    own = numbered.where(F.col("k") <= near + 1).select(base, "conv_id", "k", "a", "b", "bytes")
    heads = own.where((F.col("conv_id") == F.col("base")) & (F.col("k") < HEADS)).select(
        *[F.col(c).alias(c) for c in ("base", "k", "a", "b", "bytes")]  # columns of its own, for the cogroup
    )

    def build(left: pa.Table, right: pa.Table) -> pa.Table:
        return _family(left, right, near)

    return heads.groupBy("base").cogroup(own.groupBy("base")).applyInArrow(build, _STEP)


def _far_steps(numbered: DataFrame, steps: DataFrame, near: int) -> DataFrame:
    """Steps beyond ``near`` own turns, from the last near step of their conversation."""
    rows = numbered.where(F.col("k") > near).select("conv_id", "k", "a", "b", "bytes")
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("rows"))
    state = steps.where("goes_on").groupBy("conv_id").agg(
        F.max_by(F.struct("depth", "x", "y", (F.col("before") + F.col("bytes")).alias("total")), "depth").alias("at")
    )
    long = staged(sizes.join(state, "conv_id").select("conv_id", "rows", "at"), "long")
    met = join_heavy(rows, long, ["conv_id"], "rows")
    placed = met.select(
        "conv_id", (F.col("k") - near + F.col("at.depth")).alias("depth"), "a", "b", "bytes", F.col("at.x").alias("x0"),
        F.col("at.y").alias("y0"), F.col("at.total").alias("total"), (F.col("k") - near == F.col("rows")).alias("last"),
    )
    at = {c: placed.columns.index(c) for c in placed.columns}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [batch.column(at[c]).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("depth", "a", "b")]
            x, y = (pa.array(v) for v in _path_bits(*got))
            held = [x if c == "a" else y if c == "b" else batch.column(i) for c, i in at.items()]
            yield pa.RecordBatch.from_arrays(held, names=list(at))

    hashed = map_arrow(placed, run, placed.schema).select("*", F.col("a").alias("ha"), F.col("b").alias("hb"), F.col("bytes").alias("sum"))
    run_on = running(hashed, ["depth"], ["a", "b"], ["sum"], "far")
    x, y = F.col("a").bitwiseXOR(F.col("x0")), F.col("b").bitwiseXOR(F.col("y0"))
    return run_on.select(
        "conv_id", "depth", x.alias("x"), y.alias("y"), x.bitwiseXOR(F.col("ha")).alias("px"),
        y.bitwiseXOR(F.col("hb")).alias("py"), (F.col("total") + F.col("sum") - F.col("bytes")).alias("before"), "bytes",
        F.lit(1).cast("bigint").alias("n"), "last", (~F.col("last")).alias("goes_on"),
    )


def _ends(steps: DataFrame, run: int) -> DataFrame:
    """Path and SHA-256 of the ids of the members that end there, ascending and joined by commas."""
    members = steps.where("last").select(*PATH, "conv_id")
    spread = members.repartitionByRange(*PATH, "conv_id").sortWithinPartitions(*PATH, "conv_id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            new = np.zeros(batch.num_rows, dtype=bool)
            for col in cols:
                new[1:] |= col[1:] != col[:-1]
            cuts = sorted({0, batch.num_rows, *np.flatnonzero(new).tolist(), *range(0, batch.num_rows, run)})
            ids = pc.cast(batch.column(3), pa.string())
            firsts = cuts[:-1]
            runs = [",".join(ids.slice(i, j - i).to_pylist()) for i, j in zip(cuts, cuts[1:])]
            taken = [batch.column(i).take(pa.array(firsts, pa.int64())) for i in range(4)]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(runs, pa.string())], names=[*PATH, "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            paths = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
            for path, ids in zip(paths, batch.column(3).to_pylist()):
                if path == key:
                    state.update(b",")
                else:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = path, hashlib.sha256()
                state.update(ids.encode())
            yield _table(out)
        if key is not None:
            yield _table([(*key, state.hexdigest())])

    def _table(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [[]] * 4
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=[*PATH, "ends_sha256"])

    bits = "depth bigint, x bigint, y bigint"
    packed = map_arrow(spread, pack, f"{bits}, first bigint, ids string")
    met = packed.repartition(*PATH).sortWithinPartitions(*PATH, "first").select(*PATH, "ids")
    return map_arrow(met, digest, f"{bits}, ends_sha256 string")


def prefix_trie(conversations: DataFrame, near: int = NEAR, run: int = RUN) -> DataFrame:
    """One row a node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``near`` (``HEADS`` or more) and ``run`` bound what a task holds and do not change the rows.
    """
    numbered = running(turns(conversations), [F.col("turn").asc_nulls_first(), "a", "b"], [], [], "turns")
    first_steps = staged(family_steps(numbered, near), "near")
    steps = staged(first_steps.unionByName(_far_steps(numbered, first_steps, near)), "steps")
    discard(first_steps)
    first = F.min(F.struct("conv_id", "goes_on")).alias("own")
    merged = steps.where("n > 0").groupBy(*PATH).agg(
        first, F.sum("n").alias("n_convs"), F.max("px").alias("px"), F.max("py").alias("py"), F.max("before").alias("before")
    )
    merged = staged(merged.select(*PATH, "own.*", "n_convs", "px", "py", "before"), "nodes")
    tops = merged.groupBy("conv_id").agg(F.min_by(F.struct(*PATH, "px", "py", "before"), "depth").alias("top"))
    tops = staged(tops.select("conv_id", "top.*"), "tops")  # where what a conversation owns begins
    up = [(F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")]
    branches = tops.where("depth > 0").select(*up).groupBy(*PATH).agg(F.count("*").alias("branches"))
    nodes = merged.join(branches, PATH, "left").withColumn(
        "n_children", F.coalesce("branches", F.lit(0)) + F.col("goes_on").cast("int")
    )
    nodes = staged(nodes.select(*PATH, "conv_id", "n_convs", "n_children", "branches"), "counted")
    discard(merged)
    parents = nodes.where("branches > 0").select(*PATH, F.col("conv_id").alias("parent_conv_id"), "branches")
    hung = tops.where("depth > 0").select(F.col("conv_id").alias("owner"), F.col("depth").alias("at"), *up)
    above = join_heavy(hung, staged(parents, "parents"), PATH, "branches").select(
        F.col("owner").alias("conv_id"), F.col("at").alias("depth"), "parent_conv_id"
    )
    leaves = nodes.where("n_children = 0").select("conv_id", F.lit(1).alias("leaf"))  # one of an owner
    ends = steps.where("last").select("conv_id", (F.col("before") + F.col("bytes")).alias("total"), (F.col("depth") + 1).alias("length"))
    about = ends.join(tops.select("conv_id", "before"), "conv_id", "left").join(leaves, "conv_id", "left").select(
        "conv_id", F.coalesce("before", "total").alias("shared"), F.coalesce("leaf", F.lit(0)).alias("leaf"), "length"
    )
    weighed = join_heavy(steps.select(*PATH, "conv_id", "before"), staged(about, "about"), ["conv_id"], "length")
    sums = weighed.groupBy(*PATH).agg(
        F.sum("leaf").alias("n_leaves"), F.sum(F.greatest(F.lit(0), F.col("shared") - F.col("before"))).alias("saved_tokens")
    )
    whole = nodes.join(sums, PATH).join(_ends(steps, run), PATH, "left").join(above, ["conv_id", "depth"], "left")
    own_parent = F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id"))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return whole.select(
        "conv_id", "depth", own_parent.alias("parent_conv_id"), "n_convs", F.col("n_children").cast("bigint").alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )
