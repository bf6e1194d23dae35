"""Set-similarity join of documents by word shingles: universe partition with pigeonhole.

Two sets of sizes l <= s with a Jaccard similarity of p differ in at most (l + s)(1 - p)/(1 + p)
elements, H for a band of sizes. The universe of shingles is dealt into segments by hash, as many
that H differences cannot touch all of them twice over: of two similar sets one segment is equal, or
differs in one element where the band's allocation says so (then the segment's subsets of one
element less are indexed too). Documents meet by the hashes of their segments.

Equal sets are one class and join once. A group of classes that meet is compared pair by pair only
up to SMALL members. A set leaves larger groups, the largest first, as far as it has segments to
spare: those are mostly groups of unlike sets with some passage in common. A group that stays large
is compared with its hub. Where members of large groups are not linked with the hub, these members
are refined together, each once: similar ones share one of their elements that come first when the
elements rare among them are taken first. What still meets in a large group is compared in blocks.
So every link that joins two components is found, and no group is written out as pairs.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Scratch, join_sized

WIDTH, PERCENT = 5, 80
# Sizes of one band differ by less than this factor.
BAND = 1.5
SMALL = 16
# What a match by chance costs against one more signature, in the choice of an allocation.
CHANCE_COST = 16
# The share of its segments by which a set of its band's least size need not meet others, because too
# many share them.
ROOM = 0.05
# Counters by which the elements of open members are ordered, rare ones first.
SLOTS = 1 << 16
BLOCK = 64
# Packs of a group that one task compares with the group's outsiders.
LANE = 16

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (SplitMix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct hashes of all runs of ``width`` words; fewer words are one run.

    A-Z are lower-cased; words are the runs of anything but ASCII white space.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    n = len(words)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=_U, count=n)
    if n == 0:
        return hashes
    if n < width:
        one = np.array([n], dtype=_U)
        for h in hashes:
            one = mix(one) + h
        return mix(one)
    run = hashes[: n - width + 1]
    for k in range(1, width):
        run = mix(run) + hashes[k : n - width + 1 + k]
    return np.unique(mix(run))


def most_differences(l: int, s: int, percent: int) -> int:
    """How many elements two sets of these sizes may differ in."""
    return (l + s) * (100 - percent) // (100 + percent)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


@lru_cache(maxsize=None)
def band_start(k: int) -> int:
    start = 1
    for _ in range(k):
        start = max(start + 1, int(start * BAND))
    return start


def band_of(n: int) -> int:
    k = 0
    while band_start(k + 1) <= n:
        k += 1
    return k


@lru_cache(maxsize=None)
def allocation(band: int, percent: int) -> tuple[int, int, int]:
    """(segments, how many of them also match with one element less, spare segments).

    ones + 2 twos must exceed the differences of the band's largest pair; of the choices that do,
    the cheapest. The cost is that of the signatures and of the matches by chance, which halve with
    every element of a segment. Spare segments of the first kind make up for those that are empty
    in a set of the band's least size (or hold one element where one less shall match), so that
    hardly a set needs to meet others by emptiness, and for a share of ROOM that is left.
    """
    top = band_start(band + 1) - 1
    most = most_differences(top, top * 100 // percent, percent)
    if most == 0:
        return 0, 0, 0  # only equal sets

    def cost(twos: int) -> float:
        segments = max(most + 1 - 2 * twos, 0) + twos
        size = top / segments
        return segments + twos * size + CHANCE_COST * segments * 2.0**-size

    twos = min(range((most + 2) // 2 + 1), key=cost)
    segments, spare, least = max(most + 1 - 2 * twos, 0) + twos, 0, band_start(band)
    for spare in range(segments + 1):
        none = (1 - 1 / (segments + spare)) ** least
        one = none * least / max(segments + spare - 1, 1)
        lost = (segments + spare - twos) * none + 2 * twos * (none + one)
        if spare >= lost + 3 * lost**0.5 + ROOM * segments:
            break
    return segments + spare, twos, spare


def signature_parts(own: np.ndarray, percent: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """The hashes by which a set meets others, for its own band and for the band below where it can
    have a partner there: (of segments that also match with one element less, of the others, room).

    A similar set has one of them even without some that count no more than ``room``, where a hash
    of the first kind counts 2 and one of the second kind 1. Room below 0: all are needed.
    """
    home, out = band_of(len(own)) if len(own) else -1, []
    for band in (home, home - 1):
        if band < 0 or (band < home and (band_start(band + 1) - 1) * 100 < percent * len(own)):
            continue
        segments, twos, spare = allocation(band, percent)
        if not segments:
            continue
        at = ((own >> _U(32)) % _U(segments)).astype(np.int64)
        element = mix(own ^ _U(0x9E3779B97F4A7C15))
        total = np.zeros(segments, dtype=_U)
        np.add.at(total, at, element)
        salt = mix(np.arange(segments, dtype=_U) + _U(band * 1_000_003 + 17))
        held = np.bincount(at, minlength=segments)
        # Segments by which the set could only meet others because nothing is left in them. With no
        # more than ``spare`` of them, every similar set is met by another segment.
        lost = 2 * np.count_nonzero(held[:twos] <= 1) + np.count_nonzero(held[twos:] == 0)
        full = held > 0 if lost <= spare else held >= 0
        whole = mix(total + salt)
        fewer = at < twos
        if lost <= spare:
            fewer &= held[at] > 1
        less = mix(total[at[fewer]] - element[fewer] + salt[at[fewer]])
        out.append((np.concatenate([whole[:twos][full[:twos]], less]), whole[twos:][full[twos:]], spare - lost))
    return out


def signatures(own: np.ndarray, percent: int) -> np.ndarray:
    """All hashes by which a set meets others."""
    return np.concatenate([own[:0], *(keys for *both, _ in signature_parts(own, percent) for keys in both)])


def sketch(own: np.ndarray) -> bytes:
    """One byte per slot: the sum of the elements there. Each differing slot of two sets holds at
    least one differing element."""
    bits = max(4, len(own).bit_length() - 1)
    total = np.zeros(1 << bits, dtype=_U)
    np.add.at(total, (own >> _U(64 - bits)).astype(np.int64), mix(own ^ _U(0xD1B54A32D192ED03)))
    return (total & _U(0xFF)).astype(np.uint8).tobytes()


def may_link(n_a: int, a: bytes, n_b: int, b: bytes, percent: int) -> bool:
    """False only for sets that are not similar."""
    if 100 * min(n_a, n_b) < percent * max(n_a, n_b):
        return False
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[::2] + x[1::2]
    while len(y) > len(x):
        y = y[::2] + y[1::2]
    return int(np.count_nonzero(x != y)) <= most_differences(n_a, n_b, percent)


def _blocks(rows: DataFrame) -> DataFrame:
    """(group, block, blocks, pack) of rows (group, f, n, sketch, root): packs of BLOCK rows on average."""
    sizes = rows.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    block = F.pmod(F.xxhash64("f"), F.col("blocks"))
    packs = rows.join(sizes, "group").groupBy("group", "blocks", block.alias("block"))
    return packs.agg(F.collect_list(F.struct("f", "n", "sketch", "root")).alias("pack"))


def _block_pairs(rows: DataFrame, outside: DataFrame) -> DataFrame:
    """Every pack of ``rows`` with every pack of ``outside`` of its group, LANE packs to a task."""
    left = _blocks(rows)
    lanes = left.groupBy("group").agg((F.floor(F.max("block") / LANE) + 1).cast("int").alias("lanes"))
    others = _blocks(outside).join(lanes, "group").select(
        "group", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane"), F.col("pack").alias("others")
    )
    dealt = left.withColumn("lane", F.floor(F.col("block") / LANE).cast("int"))
    return dealt.join(others, ["group", "lane"]).select("pack", "others")


def _by_length(pack: list) -> list[tuple[np.ndarray, ...]]:
    """The ids, sizes, roots and sketches of a pack, by sketch length."""
    out = []
    for length in {len(r["sketch"]) for r in pack}:
        own = [r for r in pack if len(r["sketch"]) == length]
        matrix = np.frombuffer(b"".join(r["sketch"] for r in own), np.uint8).reshape(-1, length)
        out.append((*(np.array([r[k] for r in own]) for k in ("f", "n", "root")), matrix))
    return out


def block_pairs(a: list, b: list, percent: int):
    """The pairs (x < y) of two packs with different roots that ``may_link`` lets pass."""
    for ids_a, n_a, roots_a, x in _by_length(a):
        for ids_b, n_b, roots_b, y in _by_length(b):
            u, v = x, y
            while u.shape[1] > v.shape[1]:
                u = u[:, ::2] + u[:, 1::2]
            while v.shape[1] > u.shape[1]:
                v = v[:, ::2] + v[:, 1::2]
            most = (n_a[:, None] + n_b[None, :]) * (100 - percent) // (100 + percent)
            least, largest = np.minimum.outer(n_a, n_b), np.maximum.outer(n_a, n_b)
            differ = np.stack([np.count_nonzero(v != row, axis=1) for row in u])
            near = (differ <= most) & (100 * least >= percent * largest)
            near &= roots_a[:, None] != roots_b[None, :]
            for i, j in zip(*np.nonzero(near)):
                yield int(min(ids_a[i], ids_b[j])), int(max(ids_a[i], ids_b[j]))


def _batch(schema: str, rows: list) -> pa.RecordBatch:
    kinds = {
        "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()),
    }
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields)], [name for name, _ in fields]
    )


class Join:
    """One run of the join over ``docs`` (doc_id, text)."""

    def __init__(self, docs: DataFrame, width: int, percent: int, scratch: Scratch):
        self.width, self.percent, self.scratch = width, percent, scratch
        self.docs = docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.xxhash64("text").alias("h"),
            F.col("text").cast("string").alias("text"),
        )
        self.rows = scratch.write(self._indexed(), "sets")
        filled = self.rows.where("n > 0")
        copies = filled.groupBy("f").agg(
            F.min("doc_id").alias("first"),
            F.min(F.struct("doc_id", "h")).alias("lead"),
            F.count(F.lit(1)).alias("n_copies"),
        )
        self.copies = scratch.write(copies.where("n_copies > 1"), "copies")
        led = join_sized(filled, self.copies, ["f"], "left", scratch, "copies")
        is_lead = F.col("lead").isNull() | F.struct("doc_id", "h").eqNullSafe(F.col("lead"))
        #: One row per class of equal sets: f, doc_id, h, n, sigs, parts (see ``needed``), sketch.
        self.classes = led.where(is_lead).drop("lead", "n_copies", "first")

    def _indexed(self) -> DataFrame:
        width, percent = self.width, self.percent
        schema = "doc_id long, h long, n long, f long, sigs array<long>, parts array<long>, sketch binary"

        def index(batches):
            for batch in batches:
                rows = []
                for doc_id, h, text in zip(
                    batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
                ):
                    own = shingle_set(text.as_py(), width)
                    f = xxhash.xxh3_64_intdigest(own.tobytes()) if len(own) else 0
                    f -= (f >> 63) << 64
                    dealt = signature_parts(own, percent)
                    sigs = np.concatenate([own[:0], *(keys for *both, _ in dealt for keys in both)]).view(np.int64)
                    parts = [k for twos, ones, room in dealt for k in (len(twos), len(ones), room)]
                    rows.append((doc_id, h, len(own), f, sigs, parts, sketch(own)))
                yield _batch(schema, rows)

        return self.docs.mapInArrow(index, schema)

    def sets_of(self, nodes: DataFrame, name: str) -> DataFrame:
        """(f, own) with the sets of the given classes, recomputed from their texts."""
        width = self.width
        wanted = self.scratch.write(
            self.classes.select("f", "doc_id", "h").join(nodes.select("f").distinct(), "f", "left_semi")
            .select("f", F.col("doc_id").alias("_id"), F.col("h").alias("_h")).dropDuplicates(["f"]),
            f"{name}-keys",
        )
        side = F.broadcast(wanted) if self.scratch.size(f"{name}-keys") <= BROADCAST_BYTES else wanted
        same = self.docs["doc_id"].eqNullSafe(side["_id"]) & (self.docs["h"] == side["_h"])

        def read(batches):
            for batch in batches:
                texts = batch.column(1)
                rows = [
                    (f, shingle_set(text.as_py(), width).tobytes())
                    for f, text in zip(batch.column(0).to_pylist(), texts)
                ]
                yield _batch("f long, own binary", rows)

        found = self.docs.join(side, same).select("f", "text").mapInArrow(read, "f long, own binary")
        sets = self.scratch.write(found, name)
        self.scratch.drop(f"{name}-keys")
        return sets

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (x, y) of classes whose sets are similar: first by sketch, then exactly."""
        percent = self.percent
        pairs = self.scratch.write(pairs.where("x <> y").distinct(), f"{name}-pairs")
        light = self.classes.select("f", "n", "sketch")
        left = light.select(F.col("f").alias("x"), F.col("n").alias("n_x"), F.col("sketch").alias("s_x"))
        right = light.select(F.col("f").alias("y"), F.col("n").alias("n_y"), F.col("sketch").alias("s_y"))
        both = pairs.join(left, "x").join(right, "y").select("x", "y", "n_x", "s_x", "n_y", "s_y")

        def sift(batches):
            for batch in batches:
                rows = [
                    (x, y)
                    for x, y, n_x, s_x, n_y, s_y in zip(*(c.to_pylist() for c in batch.columns))
                    if may_link(n_x, s_x, n_y, s_y, percent)
                ]
                yield _batch("x long, y long", rows)

        likely = self.scratch.write(both.mapInArrow(sift, "x long, y long").distinct(), f"{name}-likely")
        self.scratch.drop(f"{name}-pairs")
        return self.exact(likely, name)

    def exact(self, likely: DataFrame, name: str) -> DataFrame:
        percent = self.percent
        nodes = likely.select(F.explode(F.array("x", "y")).alias("f"))
        sets = self.sets_of(nodes, f"{name}-sets")
        first = sets.select(F.col("f").alias("x"), F.col("own").alias("a"))
        second = sets.select(F.col("f").alias("y"), F.col("own").alias("b"))
        both = join_sized(likely, first, ["x"], "inner", self.scratch, f"{name}-sets")
        both = join_sized(both, second, ["y"], "inner", self.scratch, f"{name}-sets")

        def test(batches):
            for batch in batches:
                rows = [
                    (x, y)
                    for x, y, a, b in zip(*(c.to_pylist() for c in batch.columns))
                    if similar(np.frombuffer(a, _U), np.frombuffer(b, _U), percent)
                ]
                yield _batch("x long, y long", rows)

        links = both.select("x", "y", "a", "b").mapInArrow(test, "x long, y long")
        links = self.scratch.write(links, f"{name}-links")
        self.scratch.drop(f"{name}-sets", f"{name}-likely")
        return links

    def groups(self, members: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """Pairs (x, y) from the small groups of ``members`` (key, f, root, ...), but for those of one
        root, and the rows of the large ones."""
        met = members.groupBy("key").agg(F.count(F.lit(1)).alias("met")).where("met > 1")
        met = self.scratch.write(met, f"{name}-met")
        rows = join_sized(members, met, ["key"], "inner", self.scratch, f"{name}-met")
        if "room" in rows.columns:
            rows = self.needed(self.scratch.write(rows, f"{name}-all"))
        rows = self.scratch.write(rows, f"{name}-rows")
        self.scratch.drop(f"{name}-met", *([f"{name}-all"] if f"{name}-all" in self.scratch.paths else []))
        small = rows.where(f"met <= {SMALL}").groupBy("key").agg(
            F.sort_array(F.collect_set(F.struct("f", "root"))).alias("all")
        )

        def with_earlier(y, j):
            earlier = F.filter(F.slice("all", F.lit(1), j), lambda x: x["root"] != y["root"])
            return F.transform(earlier, lambda x: F.struct(x["f"].alias("x"), y["f"].alias("y")))

        listed = small.select(F.explode(F.flatten(F.transform("all", with_earlier))).alias("p")).select("p.x", "p.y")
        return listed.distinct(), rows.where(f"met > {SMALL}").drop("met")

    def needed(self, rows: DataFrame) -> DataFrame:
        """The rows (key, f, root, met) of ``rows`` without memberships in large groups that need not be.

        A set leaves its largest groups as far as its room allows. All sets go by one order of the
        groups, so of two similar sets the one that leaves off earlier still has a group in common
        with the other, which the other has not left either.
        """
        order = Window.partitionBy("f", "part").orderBy(F.desc("met"), "key")
        large = rows.where(f"met > {SMALL}").withColumn("left", F.sum("weight").over(order))
        large = large.where("left > room").select("key", "f", "root")
        large = self.scratch.write(large, "needed")
        met = large.groupBy("key").agg(F.count(F.lit(1)).alias("met"))
        met = self.scratch.write(met, "needed-met")
        large = join_sized(large, met, ["key"], "inner", self.scratch, "needed-met")
        return rows.where(f"met <= {SMALL}").select("key", "f", "root", "met").unionByName(large)

    def links(self) -> DataFrame:
        """Stars (hi, lo) of the components that the similar pairs of classes make."""
        first = self.classes.select(F.posexplode("sigs").alias("at", "key"), "f", F.col("f").alias("root"), "parts")
        # parts holds three numbers for each band of a set: signatures that count 2, that count 1, room.
        part = F.when(F.col("at") < F.col("parts")[0] + F.col("parts")[1], 0).otherwise(1)
        first = first.withColumn("part", part)
        at = F.col("at") - F.when(F.col("part") == 1, F.col("parts")[0] + F.col("parts")[1]).otherwise(0)
        first = first.select(
            "key", "f", "root", "part",
            F.when(at < F.get("parts", F.col("part") * 3), 2).otherwise(1).alias("weight"),
            F.get("parts", F.col("part") * 3 + 2).alias("room"),
        )
        pairs, large = self.groups(first, "first")
        spokes = self.with_hubs(large).where("f <> hub").select("hub", "f").distinct()
        spokes = self.scratch.write(spokes, "spokes")
        least, most = F.least("hub", "f").alias("x"), F.greatest("hub", "f").alias("y")
        found = self.verified(pairs.unionByName(spokes.select(least, most)), "first")
        self.scratch.drop("first-rows", "needed", "needed-met")
        stars = connect(found, self.scratch)
        members = self.open_members(spokes, stars)
        self.scratch.drop("spokes")
        return stars if members is None else self.refined(stars, members)

    def with_hubs(self, large: DataFrame) -> DataFrame:
        """``large`` (key, f) with the hub of each group: the member of the most large groups, the text
        the others stem from."""
        large = large.select("key", "f")
        ranked = large.join(large.groupBy("f").agg(F.count(F.lit(1)).alias("degree")), "f")
        hubs = ranked.groupBy("key").agg(F.max(F.struct("degree", "f"))["f"].alias("hub"))
        return large.join(hubs, "key")

    def open_members(self, spokes: DataFrame, stars: DataFrame) -> DataFrame | None:
        """Members (f, root) of the hubs that met members of other components, those hubs included.
        None if there are no such hubs. A member is there once however many hubs it met.
        """
        roots = stars.select(F.col("hi").alias("f"), F.col("lo").alias("root"))
        hubs = spokes.select(F.col("hub").alias("f")).distinct().join(roots, "f", "left")
        hubs = hubs.select(F.col("f").alias("hub"), F.coalesce("root", "f").alias("hub_root"))
        hubs = self.scratch.write(hubs, "hub-roots")
        placed = join_sized(spokes, hubs, ["hub"], "inner", self.scratch, "hub-roots").join(roots, "f", "left")
        placed = placed.select("hub", "hub_root", "f", F.coalesce("root", "f").alias("root"))
        placed = self.scratch.write(placed, "placed")
        apart = self.scratch.write(placed.where("root <> hub_root").select("hub").distinct(), "apart")
        if apart.isEmpty():
            return None
        members = join_sized(placed, apart, ["hub"], "left_semi", self.scratch, "apart").select("f", "root")
        itself = join_sized(hubs, apart, ["hub"], "left_semi", self.scratch, "apart")
        itself = itself.select(F.col("hub").alias("f"), F.col("hub_root").alias("root"))
        members = self.scratch.write(members.unionByName(itself).distinct(), "open")
        self.scratch.drop("placed", "apart", "hub-roots")
        return members

    def frequencies(self, sets: DataFrame) -> np.ndarray:
        """How many elements of ``sets`` (f, own) fall into each of SLOTS slots."""

        def count(batches):
            total = np.zeros(SLOTS, dtype=np.int64)
            for batch in batches:
                for own in batch.column(0):
                    slots = (np.frombuffer(own.as_py(), _U) % _U(SLOTS)).astype(np.int64)
                    total += np.bincount(slots, minlength=SLOTS)
            used = np.flatnonzero(total)
            yield _batch("slot long, n long", list(zip(used.tolist(), total[used].tolist())))

        counted = sets.select("own").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
        out = np.zeros(SLOTS, dtype=np.int64)
        for row in counted.collect():
            out[row["slot"]] = row["n"]
        return out

    def refined(self, stars: DataFrame, members: DataFrame) -> DataFrame:
        """Stars of the components that ``stars`` and the similar ones of ``members`` (f, root) make.

        Every member lists, once, the elements by which a partner must meet it, rare ones first. Only
        elements that members of several components list matter.
        """
        percent = self.percent
        sets = self.sets_of(members, "open-sets")
        often = self.frequencies(sets)
        schema = "f long, root long, tokens array<long>"

        def prefix(batches):
            for batch in batches:
                rows = []
                for f, root, own in zip(*(batch.column(k).to_pylist() for k in ("f", "root", "own"))):
                    own = np.frombuffer(own, _U)
                    ordered = own[np.lexsort((own, often[(own % _U(SLOTS)).astype(np.int64)]))]
                    # Any partner shares ceil(p n) elements, so it has one of these.
                    n = len(own) - -(-percent * len(own) // 100) + 1
                    rows.append((f, root, ordered[:n].view(np.int64)))
                yield _batch(schema, rows)

        tokens = members.join(sets, "f").select("f", "root", "own").mapInArrow(prefix, schema)
        tokens = self.scratch.write(tokens, "prefixes")
        self.scratch.drop("open-sets", "open")
        keyed = tokens.select(F.explode("tokens").alias("key"), "f", "root")
        mixed = keyed.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"))
        mixed = self.scratch.write(mixed.where("least <> most").select("key"), "mixed")
        pairs, large = self.groups(join_sized(keyed, mixed, ["key"], "left_semi", self.scratch, "mixed"), "second")
        near = self.verified(pairs, "second")
        # Large groups again, taken together by their hubs: members that are not yet in their hub's
        # component are compared with every member that is in another one, in blocks.
        pairs_of = lambda s: s.select(F.col("hi").alias("x"), F.col("lo").alias("y"))
        stars = connect(pairs_of(stars).unionByName(near), self.scratch)
        roots = stars.select(F.col("hi").alias("f"), F.col("lo").alias("root"))
        still = self.with_hubs(large).select(F.col("hub").alias("group"), "f").distinct().join(roots, "f", "left")
        still = self.scratch.write(still.select("group", "f", F.coalesce("root", "f").alias("root")), "still")
        self.scratch.drop("prefixes", "mixed", "second-rows")
        group_roots = still.select(F.col("group").alias("f")).distinct().join(roots, "f", "left")
        group_roots = group_roots.select(F.col("f").alias("group"), F.coalesce("root", "f").alias("group_root"))
        group_roots = self.scratch.write(group_roots, "group-roots")
        still = join_sized(still, group_roots, ["group"], "inner", self.scratch, "group-roots")
        apart = self.scratch.write(still.where("root <> group_root").select("group").distinct(), "still-apart")
        marked = join_sized(still, apart, ["group"], "left_semi", self.scratch, "still-apart")
        marked = marked.join(self.classes.select("f", "n", "sketch"), "f")
        marked = self.scratch.write(marked.select("group", "f", "n", "sketch", "root", "group_root"), "marked")
        if marked.isEmpty():
            return stars

        def compare(batches):
            for batch in batches:
                for a, b in zip(*(batch.column(k).to_pylist() for k in ("pack", "others"))):
                    yield _batch("x long, y long", list(block_pairs(a, b, percent)))

        likely = _block_pairs(marked, marked.where("root <> group_root")).mapInArrow(compare, "x long, y long")
        likely = self.scratch.write(likely.distinct(), "third-likely")
        return connect(pairs_of(stars).unionByName(self.exact(likely, "third")), self.scratch)

    def components(self, stars: DataFrame) -> DataFrame:
        """(f, component): the smallest doc_id that links reach, for every linked class."""
        ids = self.classes.select("f", "doc_id")
        label = stars.select(F.col("hi").alias("f"), F.col("lo").alias("root"))
        label = label.unionByName(label.select(F.col("root").alias("f"), "root").distinct())
        label = label.join(ids, "f")
        least = label.groupBy("root").agg(F.min("doc_id").alias("component"))
        return self.scratch.write(label.join(least, "root").select("f", "component").distinct(), "components")

    def result(self) -> DataFrame:
        parts = self.components(self.links())
        rows = self.rows.select("doc_id", "h", F.col("n").alias("n_shingles"), "f")
        rows = join_sized(rows, self.copies.select("f", "first"), ["f"], "left", self.scratch, "copies")
        rows = join_sized(rows, parts, ["f"], "left", self.scratch, "components")
        own = F.when(F.col("n_shingles") > 0, F.coalesce("component", "first", "doc_id")).otherwise(F.col("doc_id"))
        return rows.select("doc_id", "h", "n_shingles", own.alias("component_id"))


def connect(links: DataFrame, scratch: Scratch) -> DataFrame:
    """Stars (hi, lo) of the components of ``links`` (x, y): every node with its smallest one.

    Alternates large and small stars until nothing changes, which takes about log(nodes) rounds.
    """
    edges = scratch.write(
        links.select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct(), "edges-0"
    )

    def state(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first()

    before, k = state(edges), 0
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi")
        small = small.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(
            least.select("hi", F.col("m").alias("lo"))
        )
        k += 1
        edges = scratch.write(small.distinct(), f"edges-{k}")
        after = state(edges)
        if after == before:
            return edges
        scratch.drop(f"edges-{k - 1}")
        before = after


def similar_documents(
    docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, scratch: Scratch | None = None
) -> DataFrame:
    """doc_id, h (hash of the text), n_shingles and component_id of every row of ``docs``.

    Two documents link when their sets of ``width``-word shingles have a Jaccard similarity of at
    least ``percent`` %; component_id is the smallest doc_id that links reach, its own included.
    Fewer words than ``width`` are one shingle; null and empty texts have none and link with
    nothing. Equal rows stay and get equal results; a null doc_id is reached only where its
    component has no other. Other columns are ignored; an empty table gives no rows.
    """
    return Join(docs, width, percent, scratch or Scratch(docs.sparkSession)).result()


def one_of_each(
    docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, scratch: Scratch | None = None
) -> DataFrame:
    """The rows of ``docs``, all columns, without those that link to a smaller doc_id."""
    scratch = scratch or Scratch(docs.sparkSession)
    found = similar_documents(docs, width, percent, scratch)
    gone = found.where("doc_id <> component_id").select(
        F.col("doc_id").alias("_gone_id"), F.col("h").alias("_gone_hash")
    )
    gone = scratch.write(gone.distinct(), "gone")
    side = F.broadcast(gone) if scratch.size("gone") <= BROADCAST_BYTES else gone
    same = (F.col("doc_id").cast("long") == F.col("_gone_id")) & (
        F.xxhash64("text") == F.col("_gone_hash")
    )
    return docs.join(side, same, "left_anti")
