"""Near-duplicates by fast similarity sketching, banding and exact verification.

Sketch: COORDINATES bins are filled in rounds. In round i every shingle lands in one hashed bin with value i + v, v hashed
in [0, 1), and each bin keeps its smallest value; the rounds end once all bins are filled. From round COORDINATES on, round
i serves bin i - COORDINATES alone, so every coordinate fills. Two sketches agree in a coordinate with a chance equal to the
Jaccard similarity, with tail bounds as for independent samples. Texts of some length fill all bins within two or three
rounds.

Links: documents with equal shingle sets form a class with one representative. Bands of ROWS coordinates put the
representatives into buckets (a pair misses all bands 4 times in 10^9: 50 bands at similarity 0.85, 83 at 0.8). First every
member of a bucket is compared with the smallest one. Pairs whose sketches agree in too few coordinates (`maybe`) are
dropped; the rest are confirmed on the full sets, and links merge components.

Buckets that still hold several components are joined to groups (nodes reachable over them), and `differing` finds all
other pairs of a group that may be linked, without expanding a group into its pairs: one member is the group's centre, and
what tells a member from the centre is its difference, the shingles that only one of the two has. The symmetric difference
of two members is that of their differences, so two members that are linked, but not both to the centre, must have a known
part of their differences in common, and so one of the rarest elements of each. Near copies that are edited in places of
their own have rare elements that nobody shares, and meet nobody. Of the pairs that meet, each document's best one is confirmed
first, then all that are still between components. No link between components is lost.

Defined results: a null or blank text has no shingles and is linked with nothing; fewer than WORDS words are one shingle;
rows with equal ids are one document; a null id has no component and is kept; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderbook.llm.common import mapped, saved, slices

WORDS = 5
BANDS, ROWS = 50, 7
COORDINATES = BANDS * ROWS
KEPT = 1 << 18  # hashes of distinct words a task remembers at a time

_U = np.uint64
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], _U)


def bands_for(percent: int) -> int:
    """Bands of ROWS coordinates that a pair at the limit misses as rarely as BANDS bands at 0.85, and BANDS at least."""
    miss = lambda share: math.log1p(-(share**ROWS))
    return max(BANDS, math.ceil(BANDS * miss(0.85) / miss(percent / 100))) if percent < 100 else BANDS


def maybe(percent: int, coordinates: int) -> float:
    """Share of equal coordinates that pairs at the limit fall short of only by eight standard deviations."""
    share = percent / 100
    return round(share - 8 * math.sqrt(share * (1 - share) / coordinates), 2)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Hashes of the distinct shingles of a text, in order. Only A-Z is lower-cased, only ASCII white space separates."""
    words = text.encode().lower().split() if text else []
    n = len(words)
    if n == 0:
        return np.zeros(0, _U)
    if n < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), n)], _U)
    w = np.fromiter(map(hashes.__getitem__, words), _U, n)
    total = w[: n - WORDS + 1] * _ODD[0]
    for i in range(1, WORDS):
        total = total + w[i : n - WORDS + 1 + i] * _ODD[i]
    return np.unique(_mix(total))


def sketch(values: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """The coordinates of a set of 64-bit hashes, the set not empty."""
    none = ~_U(0)
    out, at, many = np.full(coordinates, none), 0, max(1, 1600 // len(values))
    while at < 2 * coordinates:
        rounds = np.arange(at, min(at + many, 2 * coordinates), dtype=_U)[:, None]
        h = _mix(values[None, :] ^ _mix((rounds + _U(1)) * _ODD[1]))
        bins = np.where(rounds < coordinates, ((h >> _U(32)) * _U(coordinates)) >> _U(32), rounds - _U(coordinates))
        value = (rounds << _U(48)) | ((h * _ODD[2]) >> _U(16))
        np.minimum.at(out, bins.ravel().astype(np.int64), value.ravel())
        at += many
        if not (out == none).any():
            break
    return out


def sketched(df: DataFrame, text: str, doc_id: str, bands_of: int = BANDS) -> DataFrame:
    """id, n_shingles, digest (of the shingle set), bands, coordinates (a byte each) for every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seeds = WordHashes(), np.arange(1, bands_of + 1, dtype=_U) * _ODD[3]
        for batch in slices(batches, 1):
            sizes, digests, bands, bytes_of = [], [], [], []
            for value in batch.column(1).to_pylist():
                found = shingles(value, hashes)
                sizes.append(len(found))
                digests.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                if len(found):
                    s, key = sketch(found, bands_of * ROWS), seeds
                    for column in s.reshape(bands_of, ROWS).T:
                        key = _mix(key ^ column) + _ODD[4]
                    bands.append(key.view(np.int64))
                    bytes_of.append((_mix(s) & _U(255)).astype(np.uint8).tobytes())
                else:
                    bands.append(None)
                    bytes_of.append(None)
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(digests, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.array(bytes_of, pa.binary()),
                ],
                ["id", "n_shingles", "digest", "bands", "coordinates"],
            )

    schema = "id long, n_shingles long, digest binary, bands array<long>, coordinates binary"
    return mapped(df.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text")), rows, schema)


def sets_of(df: DataFrame, text: str, doc_id: str) -> DataFrame:
    """id, digest, shingles for every row that has any."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, 1):
            found = [shingles(value, hashes) for value in batch.column(1).to_pylist()]
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in found]
            arrays = pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))
            yield pa.record_batch([batch.column(0), pa.array(digests, pa.binary()), arrays], ["id", "digest", "shingles"])

    asked = df.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    return mapped(asked, rows, "id long, digest binary, shingles array<long>").where("digest IS NOT NULL")


def _agreeing(pairs: DataFrame, nodes: DataFrame, coordinates: int, least: float) -> DataFrame:
    """a, b, agree: pairs whose sketches agree in a share `least` of the coordinates or more."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, coordinates) for c in ("one", "two"))
            agree = (one == two).mean(axis=1) if batch.num_rows else np.zeros(0)
            out = pa.record_batch([batch.column("a"), batch.column("b"), pa.array(agree)], ["a", "b", "agree"])
            yield out.filter(pa.array(agree >= least))

    one = nodes.select(F.col("node").alias("a"), F.col("coordinates").alias("one"))
    two = nodes.select(F.col("node").alias("b"), F.col("coordinates").alias("two"))
    return mapped(pairs.join(one, "a").join(two, "b").select("a", "b", "one", "two"), rows, "a long, b long, agree double")


def components(edges: DataFrame) -> DataFrame | None:
    """node, root: the smallest node reachable over edges (a, b), for every node that has an edge; None if there is no edge.

    Every node turns to its smallest neighbour, these pointers are followed twice, and the edges are redrawn between the
    nodes pointed to, until none is left. The rounds' pointers are put together where the result is used, not by a job of
    their own: the driver remembers every plan that ran.
    """
    edges, steps = saved(edges.where("a <> b").distinct(), "edges"), []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        point = saved(point.select("node", F.least("node", "root").alias("root")), "pointers")
        point = saved(_followed(_followed(point, point), point), "pointers")
        steps.append(point)
        a, b = (point.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
        edges = edges.join(a, "a").join(b, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
        edges = saved(edges, "edges")
    return functools.reduce(_followed, steps) if steps else None


def _followed(mapping: DataFrame, point: DataFrame) -> DataFrame:
    """Each node's root replaced by what that points to."""
    onward = point.select(F.col("node").alias("root"), F.col("root").alias("further"))
    return mapping.join(onward, "root", "left").select("node", F.coalesce("further", "root").alias("root"))


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels after links (a, b) between nodes."""
    a, b = (labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in "ab")
    roots = components(links.join(a, "a").join(b, "b").select(F.col("la").alias("a"), F.col("lb").alias("b")))
    if roots is None:
        return labels
    found = labels.join(roots.withColumnRenamed("node", "label"), "label", "left")
    return saved(found.select("node", F.coalesce("root", "label").alias("label")), "labels")


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b, ...) of different components."""
    a, b = (labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}")) for c in "ab")
    return pairs.join(a, "a").join(b, "b").where("la <> lb").drop("la", "lb")


def _differences(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """node, n, centre, n_centre, difference, d, core for every member (bucket, low, node, size): the set sizes of the node and
    of its group's centre, the shingles that only one of them has, their number, and whether the two are linked.

    The centre is the node that shares most places in buckets; any other would serve, with more pairs.
    """
    groups = components(members.where("low < node").select(F.col("low").alias("a"), F.col("node").alias("b")))
    weights = members.groupBy("node").agg(F.sum("size").alias("weight")).join(groups.select("node", "root"), "node")
    centres = weights.groupBy("root").agg(F.max(F.struct("weight", (-F.col("node")).alias("m"))).alias("c"))
    centres = centres.select("root", (-F.col("c.m")).alias("centre"))
    its = centres.join(sets.select(F.col("node").alias("centre"), F.col("shingles").alias("its")), "centre")
    rows = weights.select("root", "node").join(sets, "node").join(its, "root")
    apart = F.concat(F.array_except("shingles", "its"), F.array_except("its", "shingles"))
    rows = rows.select("node", F.size("shingles").alias("n"), "centre", F.size("its").alias("n_centre"), apart.alias("difference"))
    rows = rows.withColumn("d", F.size("difference"))
    return rows.withColumn("core", (100 + percent) * F.col("d") <= (100 - percent) * (F.col("n") + F.col("n_centre")))


def differing(differences: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """a, b: pairs of a group that have different labels and may be linked, every linked one among them.

    Two sets of n and m shingles are linked if and only if at most h = (100 - percent) / (100 + percent) * (n + m) shingles are
    in one alone. With differences of d and e elements they then have (d + e - h) / 2 elements of these in common. If one of
    them is not linked to the centre, that is more than 0. For a least number of common elements, o, the d - o + 1 rarest of
    either side hold one of them, whatever the partner. Here o is at least
    * d - hmax, with hmax = (100 - percent) / percent * n the most that h can be: the probing side, not linked to the centre,
    * d - hmax / 2 for the smaller difference of two, neither linked to the centre,
    * over half of d + (100 - percent) / (100 + percent) * (n_centre - n) if the partner is not linked to the centre.
    """
    more, less = 100 + percent, 100 - percent
    entries = differences.select("centre", "node", F.explode("difference").alias("element"))
    counts = entries.groupBy("centre", "element").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    # Elements of one node alone are the rarest of all and meet nothing: only their number matters.
    shared = entries.join(counts, ["centre", "element"]).groupBy("node").agg(F.sort_array(F.collect_list(F.struct("times", "element"))).alias("shared"))
    rows = differences.drop("difference").join(shared, "node").join(labels, "node").withColumn("alone", F.col("d") - F.size("shared"))
    rows = rows.withColumn("hmax", F.expr(f"{less} * n div {percent}")).withColumn("half", F.expr(f"d - floor(({more} * d + {less} * (n_centre - n)) / {2 * more}.0D)"))
    rows = saved(rows.withColumn("short", F.expr("least(d, half, IF(core, hmax, hmax div 2) + 1) - alone")), "differing")

    def side(rows: DataFrame, most: str, end: str) -> DataFrame:
        rows = rows.withColumn("most", F.expr(most).cast("int")).where("most > 0")
        rows = rows.select("*", F.posexplode(F.slice("shared", F.lit(1), F.col("most"))).alias("at", "e"))
        # What is left of the difference from this element on.
        left = F.col("d") - F.col("alone") - F.col("at")
        named = {"node": "node", "label": "label", "n": "n", "d": "d", "core": "core"}
        return rows.select("centre", F.col("e.element").alias("element"), left.alias(f"left{end}"), *[F.col(c).alias(f"{k}{end}") for k, c in named.items()])

    index, probe = side(rows, "short", "1"), side(rows.where("NOT core"), "least(d, hmax + 1) - alone", "2")
    pairs = index.join(probe, ["centre", "element"]).where(
        f"label1 <> label2 AND (core1 OR d1 < d2 OR d1 = d2 AND node1 < node2) AND {more} * (d1 + d2 - 2 * least(left1, left2)) <= {less} * (n1 + n2)"
    )
    return pairs.select(F.least("node1", "node2").alias("a"), F.greatest("node1", "node2").alias("b")).distinct()


def linked(df: DataFrame, text: str, doc_id: str, percent: int = 85) -> DataFrame:
    """id, n_shingles, component_id, kept for every row: links at 100 * intersection >= percent * union of shingle sets."""
    df, doc_id, text = df.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text")), "id", "text"
    bands_of = bands_for(percent)
    least = maybe(percent, bands_of * ROWS)
    rows = saved(sketched(df, text, doc_id, bands_of), "sketches")
    filled = rows.where("digest IS NOT NULL AND id IS NOT NULL")
    classes = saved(filled.groupBy("digest").agg(F.min("id").alias("node")), "classes")
    own = filled.withColumnRenamed("id", "node").join(classes, ["digest", "node"]).dropDuplicates(["digest", "node"])
    nodes = saved(own.select("node", "digest", "bands", "coordinates"), "nodes")

    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("bucket", "low")
    members = saved(banded.join(shared, "bucket"), "buckets")
    labels = saved(members.select("node").distinct().withColumn("label", F.col("node")), "labels")
    # The full sets of all representatives in a shared bucket, for the confirmations. The ids may be many at any size.
    texts = df.join(labels.select("node").hint("merge"), df["id"] == F.col("node"), "left_semi")
    keys = nodes.select("digest", "node").join(labels.select("node"), "node")
    found = sets_of(texts, text, doc_id).join(keys, "digest").where("id = node")
    sets = saved(found.select("node", "shingles").dropDuplicates(["node"]), "sets")

    def judged(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) and whether they are linked, on the full sets."""
        one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("one"))
        two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("two"))
        common = F.size(F.array_intersect("one", "two"))
        similar = 100 * common >= percent * (F.size("one") + F.size("two") - common)
        return saved(pairs.join(one, "a").join(two, "b").select("a", "b", similar.alias("similar")), "judged")

    def confirmed(pairs: DataFrame, labels: DataFrame, best_first: bool) -> DataFrame:
        """The labels after all links among the pairs (a, b). best_first, for pairs that may be many more than the documents:
        the best pair of each document, then all pairs that are still between components; else all pairs at once, which takes
        fewer jobs."""
        pending = saved(_agreeing(pairs, nodes, bands_of * ROWS, least), "pending")
        if best_first:
            place = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("agree"), "a"))
            best = judged(pending.withColumn("place", place).where("place = 1"))
            labels = _merged(labels, best.where("similar"))
            pending = saved(_apart(pending.join(best, ["a", "b"], "left_anti"), labels), "pending")
            if pending.isEmpty():
                return labels
        return _merged(labels, judged(pending).where("similar"))

    labels = confirmed(members.where("low < node").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct(), labels, best_first=False)
    named = members.join(labels, "node")
    ends = (F.min("label").alias("least"), F.max("label").alias("most"), F.count(F.lit(1)).alias("size"))
    mixed = named.groupBy("bucket").agg(*ends).where("least < most").select("bucket", "size")
    members = saved(members.join(mixed, "bucket"), "buckets")
    if not members.isEmpty():
        differences = saved(_differences(members, sets, percent), "differences")
        labels = _merged(labels, differences.where("core AND node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")))
        labels = confirmed(differing(differences, labels, percent), labels, best_first=True)
    found = rows.join(classes, "digest", "left").join(labels, "node", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("label", "node", "id"))
    return found.select("id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("id").isNull() | (F.col("id") == F.col("component_id")))
