"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's shingles are ordered by how often they occur in the corpus, rare ones first, as a counting sketch over all
documents tells. Of a set of s shingles, at least a = ceil(t * s) are shared with any partner, so two partners have l
shingles in common among the first s - a + l of each. Each document chooses its own l: where common shingles in its
prefix promise many candidates, it takes a longer prefix and asks for more shared shingles. Two documents are compared if
their prefixes share as many shingles as their sizes and prefixes require.

Documents with equal sets are one node. Each node is compared with one pivot first, the node that most of its lists name,
and linked nodes get a common label. Then the lists that still hold several labels are read: short ones are paired, pairs
whose prefixes share too little fall out, and the rest are compared exactly. Of a long list, as a group of thousands of near
copies makes, no pairs are formed: each node's difference from a pivot of the list takes the place of its set, and the
differences are joined by the same filter (_gap_entries), again and again if lists stay long. So no link is lost, and a group
costs in proportion to its size.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from aquila.llm.batches import chunks, map_chunks, trim
from aquila.llm.components import components
from aquila.llm.shingles import fingerprint, mixed, shingle_sets
from aquila.llm.tables import bucketed, buckets, drop, load, ship, written

#: Counters of the sketch, as a power of two, and the rows that it travels in.
SKETCH_BITS, SKETCH_ROWS = 22, 256
#: The most shingles asked for by a prefix's choice, and the cost of comparing two sets in looked-up prefix entries.
MOST, COMPARE = 8, 4.0
#: Nodes of a list up to SHORT are paired; a longer list is replaced by lists of differences from a pivot, DEPTH - 1 times. In
#: these few pairs fit, so lists up to SHORT_GAPS are paired.
SHORT, SHORT_GAPS, DEPTH = 12, 256, 4
#: Rounds that drop entries without a partner of fitting size.
PRUNINGS = 2
#: Sets that a task remembers so as not to emit them again.
REMEMBERED = 200_000
#: The most bits of the bitmap of wanted documents, as a power of two: 16 MB.
BITMAP_BITS = 27
#: Sizes up to EXACT are told apart; beyond, in steps of STEP.
EXACT, STEP = 128, 1.01


def _counter(shingles: np.ndarray) -> np.ndarray:
    return (shingles.view(np.uint64) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _packed(counts: np.ndarray) -> bytes:
    """In the narrowest unsigned type, which the first byte names."""
    kind = np.min_scalar_type(counts.max())
    return kind.char.encode() + zlib.compress(counts.astype(kind).tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw[1:]), raw[:1].decode())


def scan_sets(docs: DataFrame, n: int) -> DataFrame:
    """part = -1: doc_id, size and node (the set's fingerprint; null without words) of a document. part >= 0: a task's
    counts of shingles in that part of the sketch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        names = ["doc_id", "size", "node", "part", "counts"]
        for batch in chunks(batches, "text"):
            sets = shingle_sets(batch.column(1).to_pylist(), n)
            np.add.at(sketch, _counter(np.concatenate(sets)), np.uint32(1))
            size = pa.array([len(s) for s in sets], pa.int64())
            node = pa.array([fingerprint(s) if len(s) else None for s in sets], pa.int64())
            rows = batch.num_rows
            yield pa.record_batch([batch.column(0), size, node, pa.array([-1] * rows, pa.int32()), pa.nulls(rows, pa.binary())], names)
        if sketch.any():
            parts = [_packed(p) for p in np.split(sketch, SKETCH_ROWS)]
            none = pa.nulls(SKETCH_ROWS, pa.int64())
            yield pa.record_batch([none, none, none, pa.array(range(SKETCH_ROWS), pa.int32()), pa.array(parts, pa.binary())], names)
        trim()

    ship(docs.sparkSession)
    return docs.mapInArrow(run, "doc_id bigint, size bigint, node bigint, part int, counts binary")


def sum_sketch(scanned: DataFrame) -> np.ndarray:
    """The sketch of all tasks on the driver, 2**SKETCH_BITS counters as float32, which none outgrows."""

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << SKETCH_BITS) // SKETCH_ROWS, np.int64)
        for b in batches:
            for raw in b.column(1).to_pylist():
                total += _unpacked(raw)
        yield pa.record_batch([pa.array([key[0].as_py()], pa.int32()), pa.array([_packed(total)], pa.binary())], ["part", "counts"])

    rows = scanned.where("part >= 0").select("part", "counts").groupBy("part").applyInArrow(add, "part int, counts binary").collect()  # SKETCH_ROWS rows
    sketch = np.zeros((SKETCH_ROWS, (1 << SKETCH_BITS) // SKETCH_ROWS), np.float32)
    for r in rows:
        sketch[r["part"]] = _unpacked(r["counts"])
    return sketch.ravel()


def least_shared(size: int, num: int, den: int) -> int:
    """Shingles shared with any partner, at least."""
    return -(-num * size // den)


def choose_prefix(counts: np.ndarray, size: int, shared: int, usual: float) -> int:
    """The prefix length of least estimated cost. counts: of the ordered shingles; usual: of a shingle that occurs once.

    Reading l more entries costs what their lists hold; documents that share l shingles are at most the sum of the lists
    divided by l, and each is compared."""
    base = size - shared
    lists = np.cumsum(np.maximum(counts[: base + MOST].astype(np.float64) - usual, 0.0))
    asked = np.arange(1, min(MOST, len(lists) - base) + 1)
    held = lists[base + asked - 1]
    return base + int(asked[np.argmin(held + COMPARE * held / asked + asked)])


def emit_prefixes(docs: DataFrame, n: int, num: int, den: int, sketch: np.ndarray) -> DataFrame:
    """node, token, size and prefix (its length), a row for each shingle of each prefix. A set met before in the same task
    is left out; sets that tasks share come more than once."""
    usual = float(np.median(sketch)) + 2.0 * float(np.sqrt(np.median(sketch)))
    shared_sketch = docs.sparkSession.sparkContext.broadcast(sketch)  # of fixed size

    def start():
        counters, seen = shared_sketch.value, set()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            nodes, tokens, sizes, lengths = [], [], [], []
            for s in shingle_sets(batch.column(1).to_pylist(), n):
                if not len(s) or (node := fingerprint(s)) in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(node)
                count = counters[_counter(s)]
                order = np.lexsort((mixed(s.view(np.uint64)), count))
                length = choose_prefix(count[order], len(s), least_shared(len(s), num, den), usual)
                tokens.append(s[order[:length]])
                nodes.append(node)
                sizes.append(len(s))
                lengths.append(length)
            if not nodes:
                return None
            of = lambda x, kind: pa.array(np.repeat(np.array(x, kind), lengths))
            return pa.record_batch([of(nodes, np.int64), pa.array(np.concatenate(tokens)), of(sizes, np.int32), of(lengths, np.int32)], ["node", "token", "size", "prefix"])

        return step

    return map_chunks(docs, "text", "node bigint, token bigint, size int, prefix int", start)


def _shared_at_least(num: int, den: int, a: str, b: str) -> Column:
    """The shingles that the prefixes of a and b share if they are linked: with x shared in all, all but
    (size - x) of a prefix's entries can be missing from the other."""
    both = F.ceil((F.col(f"{a}.size") + F.col(f"{b}.size")) * F.lit(num) / F.lit(num + den))
    return F.least(F.col(f"{a}.prefix") - F.col(f"{a}.size"), F.col(f"{b}.prefix") - F.col(f"{b}.size")) + both


def _step(size: Column) -> Column:
    return F.when(size <= EXACT, size).otherwise(EXACT + F.floor(F.ln(size / EXACT) / F.lit(float(np.log(STEP))))).cast("int")


def _least_asked(num: int, den: int) -> Callable[[Column], Column]:
    """At least so many shared entries a partner asks for whose size is in a step and who chose l or more; null if none of
    that size can be one. Over all partners it is 1: the largest asks for no more than its own l."""
    size, slack = F.col("size"), F.col("prefix") - F.col("size")

    def asked(other: Column, l: Column) -> Column:
        return F.least(slack, l - F.ceil(other * F.lit(num) / F.lit(den))) + F.ceil((size + other) * F.lit(num) / F.lit(num + den))

    def of(group: Column) -> Column:
        step, l = group["step"], group["l"]
        scale = lambda k: F.pow(F.lit(STEP), k - EXACT) * EXACT
        low = F.greatest(F.when(step < EXACT, step).otherwise(F.floor(scale(step))), F.ceil(size * F.lit(num) / F.lit(den)))
        high = F.least(F.when(step < EXACT, step).otherwise(F.ceil(scale(step + 1))), F.floor(size * F.lit(den) / F.lit(num)))
        # least at one of the ends, but for rounding
        return F.when(low <= high, F.least(asked(low, l), asked(high, l)) - 1)

    return of


def _sizes(num: int, den: int) -> Column:
    """Sizes, in steps, with the l that was chosen; few for a list, however long it is."""
    chosen = F.col("prefix") - F.col("size") + F.ceil(F.col("size") * F.lit(num) / F.lit(den))
    return F.collect_set(F.struct(_step(F.col("size")).alias("step"), chosen.cast("int").alias("l"))).alias("sizes")


def _counted(entries: DataFrame, name: str) -> DataFrame:
    """Each entry once, with the number of its node's entries."""
    entries = entries.repartition("node").distinct()
    return written(entries.withColumn("found", F.count(F.lit(1)).over(Window.partitionBy("node"))), name)  # no longer than a prefix


def _pruned(entries: DataFrame, num: int, den: int) -> DataFrame:
    """Entries whose list holds a partner, by size and l, that asks for no more shared entries than their node has, with
    these counted anew."""
    lists = entries.groupBy("token").agg(_sizes(num, den), F.min("node").alias("x"), F.max("node").alias("y")).where("x != y")
    lists = written(lists.select("token", "sizes"), "lists")
    asked = _least_asked(num, den)
    kept = entries.join(lists, "token").where(F.exists("sizes", lambda group: F.coalesce(F.col("found") >= asked(group), F.lit(False)))).select("node", "token", "size", "prefix")
    kept = _counted(kept, "entries")
    drop(entries)
    drop(lists)
    return kept


def links(docs: DataFrame, nodes: DataFrame, n: int, num: int, den: int, sketch: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between nodes, enough to connect all that are connected, and node, root of connected nodes.

    nodes: node, rep (a document with that set)."""
    prefixes = written(emit_prefixes(docs, n, num, den, sketch), "prefixes")
    # rows suffice here: a set that several tasks have met is told apart when the lists are pruned
    shared = prefixes.groupBy("token").agg(F.count(F.lit(1)).alias("held")).where("held > 1").select("token")
    # One shared entry can be enough, whatever l a node has chosen; the sizes and l in its lists tell.
    entries = _counted(prefixes.join(shared, "token"), "entries")
    drop(prefixes)
    for _ in range(PRUNINGS):
        entries = _pruned(entries, num, den)
    info = written(entries.select("node").distinct(), "partnered")
    sets = _sets_of(docs, info, nodes, n)
    heads = written(entries.groupBy("node").agg(F.first("size").alias("size"), F.first("prefix").alias("prefix"), F.collect_set("token").alias("head")), "heads")

    def compared(pairs: DataFrame) -> DataFrame:
        one, other = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
        joined = written(_promising(pairs, heads, num, den), "promising").join(one, "a").join(other, "b")
        return joined.where(_linked(F.size("sa"), F.size("sb"), F.size(F.array_intersect("sa", "sb")), num, den)).select("a", "b").distinct()

    # The pivot of a shingle: the node with the fewest entries of its own alone, which is nearest to the others.
    alone = (F.col("prefix") - F.col("found")).alias("alone")
    pivot = entries.groupBy("token").agg(F.min(F.struct(alone, F.xxhash64("node").alias("h"), "node")).alias("p"))
    near = entries.join(pivot.select("token", F.col("p.node").alias("b")), "token").where("node != b")
    best = near.groupBy("node", "b").agg(F.count(F.lit(1)).alias("n")).groupBy("node").agg(F.max(F.struct("n", "b")).alias("p"))
    found = written(compared(best.select(F.col("node").alias("a"), F.col("p.b").alias("b"))), "links")
    labels = written(components(found), "labels")

    here = entries.join(labels, "node", "left").withColumn("label", F.coalesce("root", "node")).drop("root", "found")
    open_ = here.groupBy("token").agg(_sizes(num, den), F.count(F.lit(1)).alias("held"), F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").drop("x", "y")
    here = here.join(written(open_, "open"), "token").withColumn("asked", F.array_min(F.transform("sizes", _least_asked(num, den)))).where("asked is not null").drop("sizes")
    # Two nodes that share k entries share one among all but the last k - 1 of each, in any common order.
    own = Window.partitionBy("node")
    here = here.withColumns({"d": F.count(F.lit(1)).over(own), "asked": F.greatest(F.lit(1), F.min("asked").over(own)), "nth": F.row_number().over(own.orderBy("held", "token"))})
    here = here.where("nth <= d - asked + 1").select(F.col("token").alias("key"), "node", "label", "size", "prefix", "d", "nth", (F.col("prefix") - F.col("d")).alias("alone"))
    here, fits, direct = written(here, "first-entries"), _fits_prefixes(num, den), None
    for depth in range(DEPTH):
        lists = here.groupBy("key").agg(F.count(F.lit(1)).alias("held"), F.min("label").alias("x"), F.max("label").alias("y"), F.min(F.struct("alone", F.xxhash64("node").alias("h"), "node")).alias("p"))
        here = written(here.join(written(lists.where("x != y").select("key", "held", "p"), "lists"), "key"), "listed")
        last, most = depth == DEPTH - 1, SHORT_GAPS if depth else SHORT
        short = here if last else here.where(F.col("held") <= most)
        pairs = short.alias("a").join(short.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.label") != F.col("b.label")) & fits)
        pairs = written(pairs.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct(), "pairs")
        direct = pairs if direct is None else direct.unionByName(pairs)
        long = here.where(F.col("held") > most)
        if last or long.isEmpty():
            break
        gaps = written(_differences(_members(long), sets, num, den), "differences")
        found = written(found.unionByName(gaps.where("linked and node != p").select(F.col("node").alias("a"), F.col("p").alias("b"))), "links")
        here, fits = written(_gap_entries(gaps, num, den), "gap-entries"), _fits_gaps(num, den)
    found = written(found.unionByName(compared(direct.distinct())), "links")
    return found, components(found)


def _sets_of(docs: DataFrame, info: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """node, shingles of the nodes of ``info``, each once. A bitmap of the wanted documents, of at most 2**BITMAP_BITS bits
    however many they are, keeps most others from being shuffled."""
    wanted = written(info.join(nodes, "node"), "wanted")
    bits = min(BITMAP_BITS, max(12, (32 * wanted.count()).bit_length()))
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits)).alias("bucket")
    marks = wanted.where("rep is not null").select(bucket("rep")).groupBy((F.col("bucket") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bucket % 64 as int))")).alias("marks")).toArrow()
    bitmap = np.zeros(1 << bits >> 6, np.int64)
    bitmap[marks.column("word").to_numpy()] = marks.column("marks").to_numpy()
    shared_bitmap = docs.sparkSession.sparkContext.broadcast(bitmap)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        at = batch.column(2).fill_null(0).to_numpy()
        marked = (shared_bitmap.value[at >> 6] >> (at & 63)) & 1 | batch.column(0).is_null().to_numpy(zero_copy_only=False)
        batch = batch.take(pa.array(np.flatnonzero(marked)))
        sets = shingle_sets(batch.column(1).to_pylist(), n)
        nodes = [fingerprint(s) if len(s) else None for s in sets]
        return pa.record_batch([batch.column(0), pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["doc_id", "node", "shingles"])

    found = map_chunks(docs.select("doc_id", "text", F.when(F.col("doc_id").isNotNull(), bucket("doc_id")).alias("bucket")), "text", "doc_id bigint, node bigint, shingles array<bigint>", lambda: step)
    # a repeated doc_id can bring other texts
    found = found.repartition(buckets(docs.sparkSession), "node").join(wanted.withColumnRenamed("node", "own"), (F.col("node") == F.col("own")) & F.coalesce(F.col("doc_id") == F.col("rep"), F.col("doc_id").isNull() & F.col("rep").isNull()))  # dealt by node alone
    return bucketed(found.select("node", "shingles").dropDuplicates(["node"]), "sets", "node")


def _linked(size: Column, other: Column, shared: Column, num: int, den: int) -> Column:
    return shared * den >= (size + other - shared) * num


def _promising(pairs: DataFrame, heads: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) whose prefixes share as many entries as those of linked nodes do."""
    one, other = (heads.select(F.col("node").alias(x), F.struct("size", "prefix", "head").alias(f"h{x}")) for x in "ab")
    both = F.size(F.array_intersect("ha.head", "hb.head"))
    fit = F.least("ha.size", "hb.size") * den >= F.greatest("ha.size", "hb.size") * num
    return pairs.join(one, "a").join(other, "b").where(fit & (both >= _shared_at_least(num, den, "ha", "hb"))).select("a", "b")


def _fits_prefixes(num: int, den: int) -> Column:
    need = F.greatest(F.lit(1), _shared_at_least(num, den, "a", "b"))
    place = (F.col("a.nth") <= F.col("a.d") - need + 1) & (F.col("b.nth") <= F.col("b.d") - need + 1)
    return place & (F.least("a.size", "b.size") * den >= F.greatest("a.size", "b.size") * num)


def _members(long: DataFrame) -> DataFrame:
    """node, label, size and p: the nodes of long lists with the pivots of these. A pivot that is in a list of a better one gives
    way to it in all its lists, so the many lists of a group have few pivots, and a node few differences."""
    best = long.groupBy("node").agg(F.min("p").alias("best"))
    pivots = long.select(F.col("p.node").alias("node")).distinct().join(best, "node")
    pivots = written(pivots.select(F.col("node").alias("p"), F.col("best.node").alias("better")), "pivots")
    members = long.select("node", "label", "size", F.col("p.node").alias("p")).distinct().join(pivots, "p")
    return members.select("node", "label", "size", F.col("better").alias("p")).distinct()


def _differences(members: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """To each (node, label, size, p) the pivot's size, whether it is linked with the pivot, and gap: the shingles that one
    of the two has alone."""
    one, pivot = sets.select("node", "shingles"), sets.select(F.col("node").alias("p"), F.col("shingles").alias("ps"))
    joined = members.join(one, "node").join(pivot, "p").withColumn("gap", F.concat(F.array_except("shingles", "ps"), F.array_except("ps", "shingles")))
    shared = F.expr("(size + size(ps) - size(gap)) div 2")
    return joined.select("node", "label", "size", "p", F.size("ps").alias("p_size"), _linked(F.col("size"), F.size("ps"), shared, num, den).alias("linked"), "gap")


def _gap_entries(gaps: DataFrame, num: int, den: int) -> DataFrame:
    """The lists that replace a long one. Nodes x and y differ in as many shingles as their gaps do. Two that are both linked
    with the pivot need no comparison; of any others that are linked, the gaps share

        need >= (|gap x| + |gap y| - (den - num) * (size x + size y) / (den + num)) / 2

    shingles, and at least one: a gap of a node that isn't linked is too large to stand against a gap without a common
    shingle. So two linked nodes share one among all but the last need - 1 of their gaps' shingles that others have too, rare
    ones first."""
    cells = gaps.select("node", "label", "size", "p", "p_size", "linked", F.size("gap").alias("gap"), F.explode("gap").alias("token"))
    least = [F.min("gap").alias("least"), F.min(F.when(~F.col("linked"), F.col("gap"))).alias("least_open"), F.max("size").alias("most")]
    lists = cells.groupBy("p", "token").agg(F.count(F.lit(1)).alias("held"), F.min("label").alias("x"), F.max("label").alias("y"), *least).where("x != y and least_open is not null")
    own = Window.partitionBy("p", "node")
    cells = cells.join(written(lists.drop("x", "y"), "gap-lists"), ["p", "token"])
    sizes = F.col("size") + F.least("most", F.floor(F.col("size") * F.lit(den) / F.lit(num)))  # with a partner's, at most
    # a partner's gap, at least: it differs from this one in as many shingles as the two nodes do
    other = F.greatest(F.when(F.col("linked"), F.col("least_open")).otherwise(F.col("least")), F.col("gap") - _apart(sizes, num, den))
    asked = F.greatest(F.lit(1), F.ceil(_shared_gap(F.col("gap") + other, sizes, num, den)))
    cells = cells.withColumns({"d": F.count(F.lit(1)).over(own), "asked": F.min(asked).over(own), "nth": F.row_number().over(own.orderBy("held", "token"))})
    return cells.where("nth <= d - asked + 1").select(F.xxhash64("p", "token").alias("key"), "node", "label", "size", "linked", "gap", "d", "nth", (F.col("gap") - F.col("d")).alias("alone"))


def _apart(sizes: Column, num: int, den: int) -> Column:
    """The shingles that one of two linked nodes has alone, at most. sizes: the sum of both."""
    return sizes * F.lit((den - num) / (den + num))


def _shared_gap(gaps: Column, sizes: Column, num: int, den: int) -> Column:
    """What the gaps of two linked nodes share, at least; a little less, for rounding."""
    return (gaps - _apart(sizes, num, den)) / 2 - 1e-6


def _fits_gaps(num: int, den: int) -> Column:
    need = F.greatest(F.lit(1), F.ceil(_shared_gap(F.col("a.gap") + F.col("b.gap"), F.col("a.size") + F.col("b.size"), num, den)))
    return (F.col("a.nth") <= F.col("a.d") - need + 1) & (F.col("b.nth") <= F.col("b.d") - need + 1) & ~(F.col("a.linked") & F.col("b.linked"))


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles (of its set), component_id (the least doc_id reachable by links, its
    own included). Documents link if den * |intersection| >= num * |union| of their sets of n-word shingles, A-Z
    lower-cased; texts of fewer words are one shingle.

    Null texts and texts without words have 0 shingles and stand alone. Rows with equal sets are linked, so repeated rows
    share a component. A null doc_id is never a component's id unless all its rows have one. An empty table gives an
    empty table; other columns are ignored. Shingles and sets are told apart by 64-bit hashes.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scanned = written(scan_sets(docs, n), "scanned")
    own = scanned.where("part = -1").select("doc_id", "size", "node")
    nodes = written(own.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep")), "reps")
    _, roots = links(docs, nodes, n, num, den, sum_sketch(scanned))
    named = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = written(named.join(written(least, "least"), "root").select("node", "component_id"), "components")
    return own.join(named, "node", "left").select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Of each group of jaccard_groups the row of least doc_id, with all its columns; of rows that are equal in doc_id and
    text one stays. Rows without a doc_id stay."""
    chosen = jaccard_groups(docs, n=n, num=num, den=den).where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(written(chosen, "chosen"), "doc_id", "left_semi").withColumn("_text_hash", F.xxhash64("text"))
    return kept.dropDuplicates(["doc_id", "_text_hash"]).drop("_text_hash").unionByName(docs.where("doc_id is null"))


#: Distinct sets meet by their shingles, and links are followed to the least document; for small tables.
SQL = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT r, doc_id, CASE WHEN coalesce(len(ws), 0) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_sort(list_distinct([array_to_string(ws[i:i + 2], ' ') for i in range(1, len(ws) - 1)])) END AS v FROM d),
n AS (SELECT v, row_number() OVER () AS node, min(doc_id) AS least FROM s WHERE len(v) > 0 GROUP BY v),
x AS (SELECT node, len(v) AS size, unnest(v) AS shingle FROM n),
p AS (SELECT a.node AS a, b.node AS b FROM x a JOIN x b ON a.shingle = b.shingle AND a.node <> b.node AND 100 * least(a.size, b.size) >= 90 * greatest(a.size, b.size)
      GROUP BY a.node, b.node, a.size, b.size HAVING 100 * count(*) >= 90 * (a.size + b.size - count(*))),
c AS (SELECT node, least FROM n UNION SELECT p.b, c.least FROM c JOIN p ON c.node = p.a),
m AS (SELECT node, min(least) AS component_id FROM c GROUP BY node)
SELECT s.doc_id, len(s.v) AS n_shingles, coalesce(m.component_id, s.doc_id) AS component_id FROM s LEFT JOIN n ON n.v = s.v LEFT JOIN m ON m.node = n.node
"""


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(load(spark, sf_dir, "documents"), n=3, num=90, den=100)
