"""Near duplicates by SetSketch registers, bands, a joint likelihood estimate and a check on the full shingle sets.

Register i of a set is floor(1 - log_b x), truncated to 0 .. q + 1, of the smallest x that any element draws from an
exponential distribution with hash i. The maximum of two sketches is the sketch of the union. Similar sets agree in a
register with a probability of about their similarity, so bands of registers find candidates.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import remove
from .textkit import LOWER, bounded_batches, mix64, release, shared_folder, spread, texts_of, word_hashes

U64, U32 = np.uint64, np.uint32
#: Sketch: registers, base, rate and limit. At a similarity of 0.8 a pair meets in no band once in 2e7.
REGISTERS, BASE, RATE, LIMIT = 128, 1.001, 20.0, (1 << 16) - 2
BANDS, ROWS = 32, 4
#: A link needs 100 * intersection >= 80 * union. Pairs estimated below the threshold less MARGIN (over 5 standard errors of the estimate) aren't fetched.
PERCENT, MARGIN = 80, 0.2
_seed = (mix64(np.arange(1, REGISTERS + 1, dtype=U64)) >> U64(32)).astype(U32)
_odd = (mix64(np.arange(1001, REGISTERS + 1001, dtype=U64)) >> U64(32)).astype(U32) | U32(1)
_FIRST, _SECOND, _ALONE = U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB), U64(0x8EBC6AF09C88C6E3)


def shingles(text: bytes, words: int = 2) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `words` words; of all words as one where there are fewer; none without words."""
    h = word_hashes(text.translate(LOWER))
    if not len(h):
        return h
    with np.errstate(over="ignore"):
        if len(h) < words:
            out = U64(len(h)) * _ALONE
            for x in h:
                out = mix64(np.array([out ^ x]) * _FIRST)[0]
            return np.array([out])
        out = np.zeros(len(h) - words + 1, U64)
        for k in range(words):
            out = mix64(out * _SECOND + h[k : len(h) - words + 1 + k] * _FIRST)
    return np.unique(out)


def sketch(elements: np.ndarray) -> np.ndarray:
    """Registers (uint16) of a set of 64-bit hashes."""
    low = np.full(REGISTERS, 0xFFFFFFFF, U32)
    x = (elements >> U64(32)).astype(U32)
    with np.errstate(over="ignore"):
        for at in range(0, len(x), 512):
            y = x[at : at + 512, None] ^ _seed
            y *= _odd
            y ^= y >> U32(15)
            y *= U32(0x2C1B3C6D)
            y ^= y >> U32(16)
            np.minimum(low, y.min(axis=0), out=low)
    if not len(x):
        return np.zeros(REGISTERS, np.uint16)
    drawn = -np.log1p(-(low + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(drawn) / np.log(BASE)), 0, LIMIT + 1).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def likeliest_similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum likelihood estimates of the Jaccard similarity from registers (pairs, registers) and known sizes.

    With u, v the sizes' shares, a register is larger in a with probability p(u - vJ), in b with p(v - uJ), where
    p(x) = -log_b(1 - x (b - 1) / b). The log likelihood is concave in J; its derivative's zero is found by halving.
    """
    more, less = (a > b).sum(1).astype(float), (a < b).sum(1).astype(float)
    same = a.shape[1] - more - less
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    c, log_b = (BASE - 1) / BASE, np.log(BASE)
    low, high = np.zeros(len(a)), np.minimum(u / v, v / u)
    eps = 1e-9
    for _ in range(24):
        j = (low + high) / 2
        x, y = np.maximum(u - v * j, eps), np.maximum(v - u * j, eps)
        p, q = -np.log1p(-x * c) / log_b, -np.log1p(-y * c) / log_b
        dp, dq = -v * c / ((1 - x * c) * log_b), -u * c / ((1 - y * c) * log_b)
        slope = more * dp / p + less * dq / q - same * (dp + dq) / np.maximum(1 - p - q, eps)
        low, high = np.where(slope > 0, j, low), np.where(slope > 0, high, j)
    return (low + high) / 2


def sketched(docs: DataFrame, words: int = 2) -> DataFrame:
    """doc_id, n_shingles, d1, d2 (the set's 128-bit digest) and registers of every text; digest and registers null without words."""

    def run(batches):
        for batch in batches:
            n, d1, d2, regs = [], [], [], []
            for t in texts_of(batch):
                s = shingles(t, words)
                n.append(len(s))
                if len(s):
                    with np.errstate(over="ignore"):
                        a, b = np.bitwise_xor.reduce(mix64(s + _FIRST)), (mix64(s ^ _SECOND) * U64(3)).sum(dtype=U64)
                    d1.append(int(a) - (1 << 63))
                    d2.append(int(b) - (1 << 63))
                    regs.append(sketch(s).tobytes())
                else:
                    d1.append(None)
                    d2.append(None)
                    regs.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(regs, pa.binary())], names=["doc_id", "n_shingles", "d1", "d2", "registers"])
        release()

    return spread(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).mapInArrow(run, "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, registers binary")


#: Members of a block, and bytes of full sets. A group of more has more blocks, and a task holds two blocks at most.
BLOCK, BLOCK_BYTES = 512, 32 << 20
#: Members of a block's largest connected part that stand for it where blocks are connected.
STAND = 2
#: Up to so many ids are broadcast to a scan of the documents (16 MB); beyond it, that join shuffles.
BROADCAST_IDS = 2_000_000
#: Up to so many edges are connected in one task (two numbers each); more are contracted over all tasks until so few are left.
FEW_EDGES = 50_000
#: Rows of a task: a table of few rows isn't dealt over as many tasks as a shuffle of any size has. Those compared cost more.
TASK_ROWS, COMPARED_ROWS = 20_000, 1_000
#: Labels of up to so many keys are broadcast to any rows (some 3 MB); of more keys, those of keys with so many rows are.
BROADCAST_LABELS, HOT_ROWS = 50_000, 100_000


def packed(rows: DataFrame, n: int, per_task: int = TASK_ROWS) -> DataFrame:
    """rows, some n of them, in fewer partitions where there are more than n rows and the cores need. Partitions are put together whole."""
    return rows.coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // per_task)))


def forest(size: int, near) -> list[tuple[int, int]]:
    """Edges that connect 0 .. size-1 as near does. near(i, others) tells which of the others are near to i; what is connected already isn't asked again."""
    out, left = [], np.ones(size, bool)
    for i in range(size):
        if not left[i]:
            continue
        left[i] = False
        todo = [i]
        while todo:
            at = todo.pop()
            others = np.flatnonzero(left)
            if not len(others):
                return out
            found = others[near(at, others)]
            left[found] = False
            out += [(at, int(k)) for k in found]
            todo += found.tolist()
    return out


class Sketches:
    """near() of sketches: pairs estimated within MARGIN of the threshold or above it."""

    def __init__(self, n: list[int], registers: list[bytes], whole: bool):
        self.x, self.n = np.frombuffer(b"".join(registers), np.uint16).reshape(-1, REGISTERS), np.array(n, float)

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        a, b = self.n[i], self.n[j]
        out = 100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b)
        i, j, a, b = i[out], j[out], a[out], b[out]
        x, y = self.x[i], self.x[j]
        enough = (x == y).sum(1) >= (PERCENT / 100 - 1.5 * MARGIN) * REGISTERS
        enough[enough] = likeliest_similarity(x[enough], y[enough], a[enough], b[enough]) >= PERCENT / 100 - MARGIN
        out[out] = enough
        return out


class FullSets:
    """near() of full sets: links. whole: the sets are one group, and all its intersections are counted at once."""

    def __init__(self, elements: list[bytes], whole: bool):
        self.sets = [np.frombuffer(x, U64) for x in elements]
        self.matrix = linked(self.sets) if whole else None

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self.matrix[i, j] if self.matrix is not None else np.array([self._link(self.sets[a], self.sets[b]) for a, b in zip(i, j)], bool)

    @staticmethod
    def _link(x: np.ndarray, y: np.ndarray) -> bool:
        small, large = (x, y) if len(x) <= len(y) else (y, x)
        if 100 * len(small) < PERCENT * len(large):
            return False
        both = int(np.count_nonzero(large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small))
        return 100 * both >= PERCENT * (len(x) + len(y) - both)


def linked(sets: list[np.ndarray], columns: int = 1 << 12) -> np.ndarray:
    """Which pairs of a group of sorted sets are links, by the sizes of all intersections (a matrix product over elements that two sets have)."""
    n = np.array([len(x) for x in sets], np.int64)
    both = np.zeros((len(sets), len(sets)))
    elements, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    order = np.argsort(elements, kind="stable")
    elements, owner = elements[order], owner[order]
    new = np.append(True, elements[1:] != elements[:-1])
    place = np.cumsum(new) - 1
    twice = np.bincount(place) > 1
    keep = twice[place]
    owner, place = owner[keep], (np.cumsum(twice) - 1)[place[keep]]
    total = int(twice.sum())
    for at in range(0, total, columns):
        some = (place >= at) & (place < at + columns)
        x = np.zeros((len(sets), min(columns, total - at)), np.float32)
        x[owner[some], place[some] - at] = 1
        both += x @ x.T
    out = 100 * both >= PERCENT * (n[:, None] + n[None] - both)
    np.fill_diagonal(out, False)
    return out


#: Groups of so few rows are looked at many at once, all their pairs; larger ones each by forest().
FEW, AT_ONCE = 8, 2048


def by_task(dealt: DataFrame, data: list[str], n: int) -> DataFrame:
    """What compared() takes of dealt, some n rows: those of one task (group, lo, hi) together, by id."""
    keys = ["group", "lo", "hi"]
    return packed(dealt.select(*keys, "id", "side", "part", *data).repartition(*keys).sortWithinPartitions(*keys, "id"), n, COMPARED_ROWS)


def compared(dealt: DataFrame, data: list[str], kind) -> DataFrame:
    """Edges (a, b) that connect what is near within each task (group, lo, hi), and the ids that stand for it (grp, a).

    dealt has group, lo, hi, id, side, part, data, as by_task() gives them. Pairs of one part, and of one side (0 or 1; -1 is with all), aren't
    looked at. kind (Sketches or FullSets) is made of the data columns. Rows come by id, so most edges lead to a group's
    smallest ids and are the same from group to group.
    """
    given = len(data)

    def run(batches):
        def groups():
            now, rows = None, []
            for batch in batches:
                columns = [c.to_pylist() for c in batch.columns]
                for r in zip(*columns):
                    if r[:3] != now:
                        if rows:
                            yield now, rows
                        now, rows = r[:3], []
                    rows.append(r[3:])
            if rows:
                yield now, rows

        def made(rows, whole):
            return kind(*([r[3 + k] for r in rows] for k in range(given)), whole)

        def edges():
            few, i, j, size = [], [], [], 0
            for (group, _, _), rows in groups():
                if len(rows) <= FEW:
                    n = len(few)
                    for y in range(1, len(rows)):
                        for x in range(y):
                            if rows[x][2] != rows[y][2] and (rows[x][1] < 0 or rows[x][1] != rows[y][1]):
                                i.append(n + x)
                                j.append(n + y)
                    few += rows
                    size += sum(len(r[-1]) for r in rows)
                    if len(few) >= AT_ONCE or size >= BLOCK_BYTES:
                        yield few, i, j, made(few, False).near(np.array(i, np.int64), np.array(j, np.int64)), []
                        few, i, j, size = [], [], [], 0
                    continue
                test, side, part = made(rows, True), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
                apart = lambda x, others: (part[others] != part[x]) & ((side[x] < 0) | (side[others] != side[x]))  # noqa: B023, E731

                def near(x, others):
                    out = apart(x, others)  # noqa: B023
                    out[out] = test.near(np.full(int(out.sum()), x), others[out])  # noqa: B023
                    return out

                found = forest(len(rows), near)
                yield rows, [x for x, _ in found], [y for _, y in found], np.ones(len(found), bool), [(group, k) for k in stand_ins(len(rows), found)]
            if few:
                yield few, i, j, made(few, False).near(np.array(i, np.int64), np.array(j, np.int64)), []

        for rows, i, j, near, stands in edges():
            pairs = [(*sorted((rows[x][0], rows[y][0])), None) for x, y, ok in zip(i, j, near) if ok] + [(rows[k][0], None, g) for g, k in stands]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in range(3)], names=["a", "b", "grp"])
        release()

    return dealt.mapInArrow(run, "a bigint, b bigint, grp bigint")


def stand_ins(size: int, edges: list[tuple[int, int]]) -> list[int]:
    """The first STAND members of the largest connected part; edges come as forest() gives them, from parents to children."""
    root = list(range(size))
    for x, y in edges:
        root[y] = root[x]
    most = max(range(size), key=lambda r, n=np.bincount(root, minlength=size): (n[r], -r))
    return [k for k in range(size) if root[k] == most][:STAND]


def with_labels(rows: DataFrame, labels: DataFrame, on: list[str], how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """rows joined to labels, which have a row for each key, however many rows a key has.

    Few labels are broadcast. Of many, those of keys with more than HOT_ROWS rows are, and the rest shuffles. hot: these
    keys, where they are known; else they are counted.
    """
    if labels.count() <= BROADCAST_LABELS:
        return rows.join(F.broadcast(labels), on, how)
    if hot is None:
        hot = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT_ROWS).select(*on)
    hot = hot.checkpoint()
    if hot.isEmpty():
        return rows.join(labels, on, how)
    hot = F.broadcast(hot)
    return rows.join(hot, on, "left_anti").join(labels, on, how).unionByName(rows.join(hot, on, "left_semi").join(F.broadcast(labels.join(hot, on, "left_semi")), on, how))


def by_blocks(members: DataFrame, n: int, large: DataFrame | None, fetch, data: list[str], kind) -> DataFrame:
    """Edges (a, b) that connect what is near within each group of members (group, id, blocks), which has n rows.

    large has the members of groups of several blocks; fetch adds the data columns to rows with ids. A group of one block
    is one task. A larger one takes three steps: each block by itself; members that stand for the blocks with each other,
    which connects the blocks of one cluster; and what then isn't in the group's largest connected part with all blocks.
    So each row of a cluster is sent a few times, and only rows beside it go to all blocks; no link is left out.
    """
    own = F.pmod(F.xxhash64("id"), F.col("blocks"))
    none = F.lit(-1)
    first = compared(by_task(fetch(members.select("group", "id", own.alias("lo"), own.alias("hi"), none.alias("side"), F.col("id").alias("part"))), data, n), data, kind)
    links = lambda found: found.where("a < b").select("a", "b")
    if large is None:
        return packed(links(first).distinct(), n).checkpoint()
    first = first.checkpoint()
    n_large = large.count()
    held = packed(fetch(large.select("group", "id", "blocks")), n_large, COMPARED_ROWS).checkpoint()
    stands = first.where("grp is not null").select(F.col("grp").alias("group"), F.col("a").alias("id")).join(F.broadcast(large.select("group").distinct()), "group", "left_semi").distinct()
    stands = packed(stands, n_large).checkpoint()
    stands = with_labels(stands, packed(stands.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")), n_large).checkpoint(), ["group"])
    n_stands, n_second = stands.agg(F.count(F.lit(1)), F.coalesce(F.sum("blocks"), F.lit(0))).first()
    dealt = held.drop("blocks").join(F.broadcast(stands) if n_stands <= BROADCAST_IDS else stands, ["group", "id"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    second = links(compared(by_task(dealt.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other"), "side": none, "part": F.col("id")}), data, n_second), data, kind))
    edges = packed(links(first).unionByName(second).distinct(), n).checkpoint()

    ids = packed(held.select("id").distinct(), n_large).checkpoint()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    among = edges.join(ids.select(F.col("id").alias("a")), "a", "left_semi").join(ids.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b").checkpoint()
    parts = held.select("group", "id").join(components(among), "id", "left").select("group", "id", F.coalesce("component", "id").alias("part"))
    parts = packed(parts, n_large).checkpoint()
    counts = packed(parts.groupBy("group", "part").agg(F.count(F.lit(1)).alias("n")), n_large)
    main = counts.groupBy("group").agg(F.max_by("part", F.struct("n", "part")).alias("main"), (F.sum("n") - F.max("n")).alias("beside"), F.sum("n").alias("members")).where("beside > 0").withColumn("seats", F.ceil(F.col("beside") / F.lit(BLOCK)))
    main = packed(main, n_large).checkpoint()
    n_third = main.agg(F.sum(F.col("members") * F.col("seats") + F.col("beside") * F.ceil(F.col("members") / F.lit(BLOCK)))).first()[0]
    if n_third is None:
        return edges
    main = main.drop("members")
    rows = held.join(with_labels(parts, main, ["group"]), ["group", "id"])
    to = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    residents = rows.withColumn("lo", own).withColumn("hi", to("seats")).withColumn("side", F.lit(0))
    visitors = rows.where("part <> main").withColumn("hi", F.pmod(F.xxhash64("id", F.lit(1)), F.col("seats"))).withColumn("lo", to("blocks")).withColumn("side", F.lit(1))
    third = links(compared(by_task(residents.unionByName(visitors), data, n_third), data, kind))
    return packed(edges.unionByName(third).distinct(), n).checkpoint()


def candidate_links(classes: DataFrame) -> DataFrame:
    """Edges that connect all classes (id, n, registers) which share a band and are likely links."""
    n_banded = BANDS * classes.count()
    width = 2 * ROWS
    keys = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.substring("registers", 1 + i * width, F.lit(width))))
    banded = classes.select("id", F.explode(keys).alias("group"))
    shared = packed(banded.groupBy("group").agg(F.count(F.lit(1)).alias("size")), n_banded).where("size > 1").select("group", "size", F.ceil(F.col("size") / BLOCK).alias("blocks")).checkpoint()
    n = shared.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    shared = shared.drop("size")
    members = with_labels(banded, shared, ["group"], hot=shared.where(F.col("blocks") > HOT_ROWS // BLOCK).select("group"))
    hot = shared.where("blocks > 1")
    large = with_labels(banded, hot, ["group"]).checkpoint() if not hot.isEmpty() else None
    return by_blocks(members, n, large, lambda rows: rows.join(classes.select("id", "n", "registers"), "id"), ["n", "registers"], Sketches)


def confirmed_links(groups: DataFrame, classes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """Edges that connect all links within the groups (id, component), counted on the full sets of the documents with these ids."""
    groups = groups.join(classes.select("id", "n"), "id")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(BLOCK), 8 * F.sum("n") / F.lit(BLOCK_BYTES)))
    n = groups.count()
    members = with_labels(groups, packed(groups.groupBy("component").agg(blocks.alias("blocks")), n).checkpoint(), ["component"]).select(F.col("component").alias("group"), "id", "blocks").checkpoint()
    texts = docs.select(F.col("doc_id").cast("bigint").alias("_id"), "text")

    def fetch(rows: DataFrame) -> DataFrame:
        rows = rows.checkpoint()
        names = rows.columns
        placed = F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows

        def run(batches):
            for batch in batches:
                sets = pa.array([shingles(t, words).tobytes() for t in texts_of(batch)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names), sets], names=[*names, "elements"])
            release()

        schema = ", ".join(f"`{k}` {t}" for k, t in rows.dtypes)
        return texts.join(placed, texts["_id"] == placed["id"]).select(*names, "text").mapInArrow(run, f"{schema}, elements binary")

    large = members.where("blocks > 1")
    return by_blocks(members, n, None if large.isEmpty() else large, fetch, ["elements"], FullSets)


def components(links: DataFrame) -> DataFrame:
    """id and component (the smallest id reachable) of every end of the links (a, b).

    Each round hooks every node to the smallest of itself and its neighbours, follows the hooks twice and contracts the
    links to those between different hooks, until FEW_EDGES are left, which are connected in one task. Minima are
    combined before they are shuffled, so a node with many links costs no task more, and the links left shrink fast.
    """
    spark = links.sparkSession
    folder, n = f"{shared_folder(spark)}/components-{uuid.uuid4().hex}", 0

    def kept(rows: DataFrame) -> DataFrame:
        # A table, not a checkpoint, once a round: a checkpoint hands on the size that the optimizer guessed, and joins multiply guesses, round by round.
        nonlocal n
        n += 1
        rows.write.option("compression", "uncompressed").parquet(f"{folder}/{n}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{n}")

    edges = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    labels = None
    while edges.count() > FEW_EDGES:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low")).select("id", F.least("id", "low").alias("hook")).checkpoint()
        for _ in range(2):
            hooks = with_labels(hooks, hooks.select(F.col("id").alias("hook"), F.col("hook").alias("next")), ["hook"]).select("id", F.col("next").alias("hook")).checkpoint()
        if labels is None:
            labels = hooks.select("id", F.col("hook").alias("component"))
        else:
            labels = with_labels(labels, hooks.select(F.col("id").alias("component"), "hook"), ["component"], "left").select("id", F.coalesce("hook", "component").alias("component")).checkpoint()
        edges = with_labels(edges, hooks.select(F.col("id").alias("a"), F.col("hook").alias("x")), ["a"])
        edges = with_labels(edges, hooks.select(F.col("id").alias("b"), F.col("hook").alias("y")), ["b"])
        edges = kept(edges.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    last = connected(edges).checkpoint()
    if labels is None:
        return last
    labels = with_labels(labels, last.select(F.col("id").alias("component"), F.col("component").alias("hook")), ["component"], "left").select("id", F.coalesce("hook", "component").alias("component")).checkpoint()
    remove(spark, folder)
    return labels


def connected(edges: DataFrame) -> DataFrame:
    """components() of few edges, in one task."""

    def run(batches):
        parts = [np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]) for batch in batches]
        if not parts:
            return
        ids, ends = np.unique(np.concatenate(parts, axis=1), return_inverse=True)
        a, b = ends.reshape(2, -1)
        root = np.arange(len(ids))
        while len(a):
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
            a, b = root[a], root[b]
            a, b = a[a != b], b[a != b]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], names=["id", "component"])

    return edges.select("a", "b").coalesce(1).mapInArrow(run, "id bigint, component bigint")


def near_duplicates(docs: DataFrame, words: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document.

    Equal sets become one class. Classes that share a band and are likely links by their registers form groups, which
    hold every pair that can be a link; within each group the links are counted on the full sets. Both steps hand on
    edges that connect what they found, never all pairs. Null and empty texts, and texts of white space, are linked with
    nothing. Rows that repeat a doc_id are one node. Only doc_id and text are read.
    """
    shared_folder(docs.sparkSession)
    bounded_batches(docs.sparkSession)
    rows = sketched(docs, words).checkpoint()
    n = rows.count()
    classes = rows.where("d1 is not null and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers"), F.count(F.lit(1)).alias("copies"))
    classes = packed(classes, n).checkpoint()
    labels = components(confirmed_links(components(candidate_links(classes)), classes, docs, words))
    by_class = classes.join(labels, "id", "left").select("d1", "d2", F.coalesce("component", "id").alias("component"))
    by_class = packed(by_class, n).checkpoint()
    return with_labels(rows.select("doc_id", "n_shingles", "d1", "d2"), by_class, ["d1", "d2"], "left", classes.where(F.col("copies") > HOT_ROWS).select("d1", "d2")).select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def unique(docs: DataFrame, words: int = 5) -> DataFrame:
    """The documents of which no near copy has a smaller doc_id, with all their columns. Rows that repeat a doc_id are one document and stay together."""
    gone = near_duplicates(docs, words).where(~F.col("kept")).select("doc_id").distinct().checkpoint()
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
