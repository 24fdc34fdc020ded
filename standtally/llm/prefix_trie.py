"""Prefix trie of conversations, with count-min screening of prefix digests.

A node of the trie is a distinct sequence of first turns. Each turn becomes a digest, and a
prefix is known by its length and two polynomials over the digests of its turns, together
128 bits; texts leave the first scan only as digests. A count-min sketch counts all prefixes.
It never counts too few, so an estimate of one proves that a prefix belongs to a single
conversation, and so do all longer ones: such a tail is emitted where it stands. Only prefixes
that may be shared are shuffled and grouped exactly. The sketch has a fixed largest width;
past about as many prefixes it proves less and more is grouped, with the same result.

A conversation that is the smallest member of a node is the smallest of every deeper node on
its way, so the nodes fall into one path per conversation, and the paths form a tree. Sums
over subtrees follow from totals of paths, by doubling the reach of each path's ancestor, and
running sums along a path.

Turns are ordered by number (missing first), then role, then text; in repeated rows each
counts as a turn. Ties that agree in role and the text's first 64 bytes go by digest. Missing
roles and texts are empty. Rows without ``conv_id`` belong to no conversation and are left
out. ``conv_id - conv_id % 20`` follows the sign of the number. An empty table has no nodes,
not even a root. Further columns are ignored. One conversation may hold any share of the
rows: its turns are numbered and summed over many tasks. Building the plan runs jobs, as
stages are written and sized.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from standtally.llm.common import join_many_to_one, shuffle_partitions
from standtally.llm.segments import MULTIPLIERS, by_batch, carries, power, scan, whole_polynomials, whole_sums
from standtally.sources.staging import stage

EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
ROWS = 4
# Cells in a row of the sketch: a byte each in a task, two bits each where it is read.
MAX_CELLS = 1 << 24
BLOCK = 1 << 13
BLOB = 1 << 20
TIE_BYTES = 64
SALTS = 32
# Odd multipliers of the sketch's rows.
ROW_HASH = (
    (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F),
    (0x165667B19E3779F9, 0xFF51AFD7ED558CCD),
    (0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9),
    (0x94D049BB133111EB, 0x27D4EB2F165667C5),
)

_DIGESTS = "conv bigint, turn bigint, tie binary, t1 bigint, t2 bigint, words bigint"
_SCREENED = (
    "conv bigint, depth bigint, p1 bigint, p2 bigint, q1 bigint, q2 bigint, words bigint,"
    " ends boolean, single boolean, top boolean"
)


def turn_digests(turns: DataFrame) -> DataFrame:
    """Every turn as two 64-bit digests with its number of words; texts stay behind."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        ties, digests, words = [], [], []
        for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            ties.append((role[:TIE_BYTES] + b"\0" + text[:TIE_BYTES])[:TIE_BYTES])
            digest = hashlib.sha256(len(role).to_bytes(8, "little") + role)
            digest.update(text)
            digests.append(digest.digest()[:16])
            # Splitting bytes at white space means that of ASCII.
            words.append(len(text.split()))
        lanes = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
        columns = [
            batch.column(0), batch.column(1), pa.array(ties, pa.binary()),
            pa.array(lanes[:, 0].copy()), pa.array(lanes[:, 1].copy()), pa.array(words, pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["conv", "turn", "tie", "t1", "t2", "words"])

    empty = F.lit("")
    read = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("bigint"),
        F.col("turn").cast("bigint"),
        F.coalesce("role", empty).cast("binary"),
        F.coalesce("text", empty).cast("binary"),
    )
    return read.mapInArrow(by_batch(work), _DIGESTS)


def rebuilt_turns(turns: DataFrame) -> DataFrame:
    """(conv, pos, t1, t2, words) of the rebuilt conversations; pos 0 is the root's.

    Conversation c takes the first h turns of conversation c - c % 20, and then its own after
    its first h; h is the checksum of its number, modulo 4. So at most three turns are lent,
    and they are joined by the lender's number alone.
    """
    order = ["conv", F.col("turn").asc_nulls_first(), "tie", "t1", "t2"]
    placed = whole_sums(scan(turn_digests(turns), "conv", order, [], [], "turns"), "conv", [])
    placed = placed.select("conv", F.col("k").alias("pos"), "t1", "t2", "words")
    taken = F.crc32(F.col("conv").cast("string").cast("binary")) % 4
    convs = placed.filter("pos = 1").select("conv", taken.alias("h"), (F.col("conv") - F.col("conv") % 20).alias("base"))
    lent = placed.filter("pos <= 3 and conv % 20 = 0").withColumnRenamed("conv", "base")
    borrowed = convs.filter("h > 0").join(lent, "base").filter("pos <= h")
    zero = F.lit(0).cast("bigint")
    roots = convs.select("conv", zero.alias("pos"), zero.alias("t1"), zero.alias("t2"), zero.alias("words"))
    own = placed.filter(F.col("pos") > taken)
    return roots.unionByName(borrowed.drop("h", "base")).unionByName(own)


class _Prefixes:
    """Depths and prefix digests of some rows of the scan over rebuilt turns."""

    def __init__(self, batch: pa.RecordBatch, found: dict) -> None:
        self.columns = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        place, (self.p1, self.p2) = whole_polynomials(self.columns, "conv", ["t1", "t2"], found)
        self.conv, self.depth = self.columns["conv"], place - 1
        at = place.astype(np.uint64)
        self.q1 = self.p1 - self.columns["t1"].view(np.uint64) * power(MULTIPLIERS[0], at)
        self.q2 = self.p2 - self.columns["t2"].view(np.uint64) * power(MULTIPLIERS[1], at)

    def cells(self, row: int, bits: int) -> np.ndarray:
        a, b = ROW_HASH[row]
        mixed = self.p1 * np.uint64(a) + self.p2 * np.uint64(b) + self.depth.astype(np.uint64)
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(a)
        return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def count_min(prefixes: DataFrame, found: dict, bits: int) -> list[tuple[int, bytes]]:
    """Blocks of the sketch: a bit for each cell that was counted twice or more.

    A task counts up to two in a byte a cell and sends two bits a cell, without empty blocks.
    Blocks are merged in two rounds, so that no group holds more than some of the tasks'.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((ROWS, 1 << bits), np.uint8)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _Prefixes(batch, found)
            for r in range(ROWS):
                cell, times = np.unique(rows.cells(r, bits), return_counts=True)
                counts[r][cell] = np.minimum(counts[r][cell] + np.minimum(times, 2), 2)
        once = np.packbits(counts.reshape(-1) >= 1).tobytes()
        twice = np.packbits(counts.reshape(-1) >= 2).tobytes()
        cut = [(b, once[b : b + BLOCK], twice[b : b + BLOCK]) for b in range(0, len(once), BLOCK)]
        cut = [x for x in cut if any(x[1])]
        if cut:
            block, ones, twos = zip(*cut, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(block, pa.int64()), pa.array(ones, pa.binary()), pa.array(twos, pa.binary())],
                names=["block", "once", "twice"],
            )

    def merge(group):
        once = np.zeros(len(group.once.iloc[0]), np.uint8)
        twice = once.copy()
        for a, b in zip(group.once, group.twice, strict=True):
            one = np.frombuffer(a, np.uint8)
            twice |= np.frombuffer(b, np.uint8) | (once & one)
            once |= one
        return group.iloc[:1][["block"]].assign(once=once.tobytes(), twice=twice.tobytes())

    schema = "block bigint, once binary, twice binary"
    blocks = prefixes.mapInArrow(count, schema).withColumn("salt", (F.rand(1) * SALTS).cast("int"))
    merged = blocks.groupBy("block", "salt").applyInPandas(merge, schema)
    merged = merged.groupBy("block").applyInPandas(merge, schema)
    # The bound: ROWS * MAX_CELLS bits, 8 MB.
    return [(r.block, bytes(r.twice)) for r in merged.select("block", "twice").collect()]


def screen(prefixes: DataFrame, cells: int = MAX_CELLS) -> DataFrame:
    """Every prefix with its digests, ``single`` where the sketch proves it so.

    ``top`` marks the first row of a proven tail, as far as the rows at hand show it.
    """
    found, goes_on = carries(prefixes, "conv", [], ["t1", "t2"])
    bits = max(10, min(cells.bit_length() - 1, (4 * prefixes.count()).bit_length()))
    twice = np.zeros(ROWS << bits >> 3, np.uint8)
    for block, data in count_min(prefixes, found, bits):
        twice[block : block + len(data)] = np.frombuffer(data, np.uint8)
    sketch = prefixes.sparkSession.sparkContext.broadcast(twice.tobytes())

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen = np.frombuffer(sketch.value, np.uint8)
        rows = _Prefixes(batch, found)
        single = np.zeros(batch.num_rows, bool)
        for r in range(ROWS):
            cell = rows.cells(r, bits) + (r << bits)
            single |= (seen[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 0
        conv, part = rows.conv, rows.columns["part"]
        new = np.ones(len(conv), bool)
        new[1:] = (conv[1:] != conv[:-1]) | (part[1:] != part[:-1])
        first = np.flatnonzero(new)
        at = np.cumsum(new) - 1
        proven = np.cumsum(single)
        single = proven - (proven - single)[first[at]] > 0
        top = single.copy()
        top[1:] &= new[1:] | ~single[:-1]
        # A conversation ends where the next row is another's; the last row of a stretch
        # ends one unless it goes on in the next stretch.
        ends = rows.columns["last"] == 1
        for i in np.flatnonzero(rows.columns["edge"] >= 2):
            ends[i] = int(part[i]) not in goes_on
        lanes = [pa.array(x.view(np.int64)) for x in (rows.p1, rows.p2, rows.q1, rows.q2)]
        return pa.RecordBatch.from_arrays(
            [pa.array(conv), pa.array(rows.depth), *lanes, batch.column("words"), *map(pa.array, (ends, single, top))],
            names=["conv", "depth", "p1", "p2", "q1", "q2", "words", "ends", "single", "top"],
        )

    return stage(prefixes.mapInArrow(by_batch(work), _SCREENED), "screened")


def end_digests(ending: DataFrame) -> DataFrame:
    """(p1, p2, depth, ends_sha256) over the numbers of the conversations that end in a node.

    Numbers are sorted over many tasks and joined to texts of up to a megabyte; one task then
    hashes a node's texts in order, holding one at a time, as the hash can't be split.
    """
    node = ["p1", "p2", "depth"]

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, numbers, size = None, 0, [], 0
        for batch in batches:
            out = []
            for *this, conv in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if this != key or size > BLOB:
                    if numbers:
                        out.append((*key, first, ",".join(numbers).encode()))
                    key, first, numbers, size = this, conv, [], 0
                numbers.append(str(conv))
                size += len(numbers[-1]) + 1
            if out:
                yield _batch(out, ("p1", "p2", "depth", "first"), "numbers")
        if numbers:
            yield _batch([(*key, first, ",".join(numbers).encode())], ("p1", "p2", "depth", "first"), "numbers")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            out = []
            for *this, _, numbers in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if this != key:
                    if key is not None:
                        out.append((*key, digest.hexdigest()))
                    key, digest = this, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(numbers)
            if out:
                yield _batch(out, ("p1", "p2", "depth"), "ends_sha256", pa.string())
        if key is not None:
            yield _batch([(*key, digest.hexdigest())], ("p1", "p2", "depth"), "ends_sha256", pa.string())

    n = shuffle_partitions(ending.sparkSession)
    order = [*node, "conv"]
    sorted_ends = ending.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order)
    keys = "p1 bigint, p2 bigint, depth bigint"
    blobs = sorted_ends.mapInArrow(texts, f"{keys}, first bigint, numbers binary")
    together = blobs.repartition(n, *node).sortWithinPartitions(*node, "first")
    return together.mapInArrow(hashed, f"{keys}, ends_sha256 string")


def _batch(rows: list[tuple], numbers: tuple[str, ...], last: str, kind=None) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    arrays = [pa.array(c, pa.int64()) for c in columns[:-1]] + [pa.array(columns[-1], kind or pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, names=[*numbers, last])


def path_totals(paths: DataFrame) -> DataFrame:
    """(conv, saved, leaves) of paths (conv, anc, saved, leaves) with all that hangs on them.

    In each round a path gains what the paths hold whose known ancestor it is, and they take
    its ancestor for theirs; so the reach doubles, and rounds are the logarithm of the depth.
    """
    state = stage(paths, "paths")
    while state.filter("anc is not null").limit(1).count():
        up = state.filter("anc is not null")
        gained = up.groupBy(F.col("anc").alias("conv")).agg(F.sum("saved").alias("_saved"), F.sum("leaves").alias("_leaves"))
        above = state.select(F.col("conv").alias("anc"), F.col("anc").alias("above"))
        moved = join_many_to_one(up, above, ["anc"]).unionByName(
            state.filter("anc is null").withColumn("above", F.lit(None).cast("bigint"))
        )
        state = stage(
            moved.join(gained, "conv", "left").select(
                "conv",
                F.col("above").alias("anc"),
                (F.col("saved") + F.coalesce("_saved", F.lit(0))).alias("saved"),
                (F.col("leaves") + F.coalesce("_leaves", F.lit(0))).alias("leaves"),
            ),
            "paths",
        )
    return state.drop("anc")


def trie_nodes(prefixes: DataFrame, cells: int = MAX_CELLS) -> DataFrame:
    """Nodes of the trie over (conv, pos, t1, t2, words), where pos 0 stands for the root.

    Returns conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256. ``cells`` is the largest width of the sketch; it bears on time alone.
    """
    marked = scan(prefixes, "conv", ["conv", "pos"], [], ["t1", "t2"], "prefixes")
    screened = screen(marked, cells)
    grouped = stage(
        screened.filter("not single")
        .groupBy("depth", "p1", "p2")
        .agg(
            F.count("*").alias("n"),
            F.min("conv").alias("conv"),
            *[F.max(c).alias(c) for c in ("words", "q1", "q2")],
            F.max(F.col("ends").cast("int")).cast("boolean").alias("ends"),
        ),
        "nodes",
    )
    shared = grouped.filter("n > 1")
    # Proven tails, and what only the exact count shows to be of one conversation.
    late = grouped.filter("n = 1").select("conv", "depth", "q1", "q2", "ends")
    tops = screened.filter("single and top").select("conv", "depth", "q1", "q2", "ends").unionByName(late)
    is_single, parent = F.lit(True).alias("single"), ["q1", "q2", "over"]
    over = (F.col("depth") - 1).alias("over")
    below = tops.select("q1", "q2", over, is_single).unionByName(
        shared.select("q1", "q2", over, F.lit(False).alias("single"))
    )
    children = below.groupBy("q1", "q2", "over").agg(
        F.count("*").alias("n_children"), F.sum(F.col("single").cast("bigint")).alias("n_single")
    )
    above = shared.select(
        F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("depth").alias("over"), F.col("conv").alias("parent")
    )
    nodes = stage(
        shared.join(
            children.toDF("p1", "p2", "depth", "n_children", "n_single"), ["p1", "p2", "depth"], "left"
        ).select(
            "conv",
            "depth",
            "p1",
            "p2",
            "q1",
            "q2",
            "n",
            over,
            F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"),
            F.coalesce("n_single", F.lit(0)).cast("bigint").alias("n_single"),
            ((F.col("n") - 1) * F.col("words")).alias("saved"),
        )
        .withColumn("leaves", F.col("n_single") + (F.col("n_children") == 0).cast("bigint")),
        "nodes",
    )
    linked = stage(join_many_to_one(nodes, above, parent), "linked")

    # A path's first node hangs on another path; the root's hangs on none.
    hangs = linked.filter("parent <> conv").select("conv", F.col("parent").alias("anc"), over)
    sums = linked.groupBy("conv").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    hanging = stage(hangs, "hanging")
    totals = path_totals(sums.join(hanging.drop("over"), "conv", "left").select("conv", "anc", "saved", "leaves"))
    at = (
        hanging.join(totals, "conv")
        .groupBy(F.col("anc").alias("conv"), F.col("over").alias("depth"))
        .agg(F.sum("saved").alias("_saved"), F.sum("leaves").alias("_leaves"))
    )
    own = linked.join(at, ["conv", "depth"], "left").select(
        "conv", "depth", "p1", "p2", "parent", "n", "n_children",
        (F.col("saved") + F.coalesce("_saved", F.lit(0))).alias("saved"),
        (F.col("leaves") + F.coalesce("_leaves", F.lit(0))).alias("leaves"),
    )
    summed = whole_sums(
        scan(own, "conv", ["conv", F.col("depth").desc()], ["saved", "leaves"], [], "subtrees"),
        "conv",
        ["saved", "leaves"],
    )
    ending = screened.filter("ends and not single").join(
        shared.select("p1", "p2", "depth"), ["p1", "p2", "depth"], "left_semi"
    )
    out_shared = summed.join(end_digests(ending), ["p1", "p2", "depth"], "left").select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        "n_children",
        F.col("sum_leaves").alias("n_leaves"),
        F.col("sum_saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
    )
    linked_tops = join_many_to_one(stage(tops.withColumn("over", over), "tops"), above, parent)
    inner = screened.filter("single and not top").select("conv", "depth", "ends", F.col("conv").alias("parent"))
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    out_single = (
        linked_tops.select("conv", "depth", "ends", "parent")
        .unionByName(inner)
        .select(
            F.col("conv").alias("conv_id"),
            "depth",
            # No shared node above: the node above is of this conversation alone.
            F.when(F.col("depth") > 0, F.coalesce("parent", "conv")).alias("parent_conv_id"),
            one.alias("n_convs"),
            F.when(F.col("ends"), none).otherwise(one).alias("n_children"),
            one.alias("n_leaves"),
            none.alias("saved_tokens"),
            F.when(F.col("ends"), F.sha2(F.col("conv").cast("string").cast("binary"), 256))
            .otherwise(F.lit(EMPTY_SHA256))
            .alias("ends_sha256"),
        )
    )
    return out_shared.unionByName(out_single)


def conversation_trie(turns: DataFrame, cells: int = MAX_CELLS) -> DataFrame:
    """Nodes of the trie over rebuilt conversations (conv_id, turn, role, text)."""
    return trie_nodes(rebuilt_turns(turns), cells)
