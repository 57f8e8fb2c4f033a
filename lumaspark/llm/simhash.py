"""Near duplicates by SimHash fingerprints and multi-index hashing.

A fingerprint is made from the XXH64 of a text's word shingles, whole text, repeats included:
one bit per hash bit, set where over half the hashes set it; longer fingerprints take one
word of 64 bits per seed. Equal fingerprints are one node. To find nodes at `distance` or fewer
bits, the bits are cut into segments with a radius each. Every node is put into one table per
segment, looks up the Hamming ball of its own segment there, and a match counts only if all
bits together are close enough. Where the radii sum to distance - segments + 1 no pair stays
undetected, since a pair beyond every segment's radius differs in more bits.

Links are found in two steps, so that a large group of near copies does not emit its pairs:
first each bucket of a table links its members to its smallest one where they are close; then
the lookups keep only links between different components of the first step, as pairs of those
components. The components of both steps together are those of all links.

Null texts are empty; texts without words have fingerprint zero and are linked like any other.
Rows that repeat an id appear as often as they are given; null ids are never a component's id
unless it has no other. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaspark.llm.components import components
from lumaspark.llm.shingles import BANDS, LEAST, SEED, WORDS, fingerprint, shingle_hashes, similar_components
from lumaspark.llm.tables import Steps, small_batches, text_of

SEEDS = (SEED, 43)  # one word of 64 bits each


def _prints(width: int, seeds: tuple[int, ...]):
    def run(batches):
        for batch in batches:
            texts = batch.column("body").to_pylist()
            words = [pa.array([fingerprint(shingle_hashes(t, width, s)) for t in texts], pa.int64()) for s in seeds]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *words], names=["doc_id", *_words(len(seeds))])

    return run


def _words(n: int) -> list[str]:
    return [f"fp{i}" for i in range(n)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4,
                 seeds: tuple[int, ...] = (SEED,)) -> DataFrame:
    """(doc_id, fp0, ...): words of 64 bits as signed numbers."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.encode(text_of(text_col), "utf-8").alias("body"))
    return rows.mapInArrow(_prints(width, seeds), ", ".join(["doc_id long", *(f"{w} long" for w in _words(len(seeds)))]))


@dataclass(frozen=True)
class Segment:
    word: int
    shift: int
    bits: int
    radius: int

    def key(self, side: str = "") -> Column:
        return F.shiftrightunsigned(f"{side}fp{self.word}", self.shift).bitwiseAND(F.lit((1 << self.bits) - 1))

    def differing(self, mixed: list[np.ndarray]) -> np.ndarray:
        """Bits of the segment that are set in the words of a fingerprint."""
        return np.bitwise_count((mixed[self.word] >> np.uint64(self.shift)) & np.uint64((1 << self.bits) - 1))


def segment_plan(distance: int, per_word: int, words: int = 1) -> list[Segment]:
    """Segments of even bits with radii that sum to distance - segments + 1: no pair stays undetected. Segments
    beyond distance + 1 have radius zero and are left out, since the others suffice."""
    n = min(per_word * words, distance + 1)
    spare, plan = distance - n + 1, []
    for i in range(n):
        word, k = divmod(i, per_word)
        low, high = 64 * k // per_word, 64 * (k + 1) // per_word
        plan.append(Segment(word, low, high - low, spare // n + (i < spare % n)))
    return plan


def ball(bits: int, radius: int) -> list[int]:
    """Masks of at most `radius` set bits among `bits`."""
    out, edge = [0], [(0, 0)]
    for _ in range(radius):
        edge = [(m | 1 << b, b + 1) for m, low in edge for b in range(low, bits)]
        out += [m for m, _ in edge]
    return out


def _probes(i: int, segment: Segment) -> Column:
    """Keys of the ball that are not below the node's own: of two nodes, the one with the smaller segment finds the other."""
    masks = F.array(*(F.lit(m).cast("bigint") for m in ball(segment.bits, segment.radius)))
    keys = F.filter(F.transform(masks, lambda m: segment.key().bitwiseXOR(m)), lambda k: k >= segment.key())
    return F.transform(keys, lambda k: F.struct(F.lit(i).alias("seg"), k.alias("key"), (k == segment.key()).alias("own")))


def _close(left: str, right: str, words: list[str], distance: int) -> Column:
    differing = [F.bit_count(F.col(f"{left}{w}").bitwiseXOR(F.col(f"{right}{w}"))) for w in words]
    return sum(differing[1:], differing[0]) <= distance


@dataclass(frozen=True)
class BitIndex:
    """A table per segment of the fingerprints of nodes (node, fp0, ...), numbers that differ for different nodes."""

    words: list[str]
    distance: int
    plan: list[Segment]

    def _homes(self) -> Column:
        return F.explode(F.array(*(F.struct(F.lit(i).alias("seg"), s.key().alias("key")) for i, s in enumerate(self.plan)))).alias("p")

    def stars(self, nodes: DataFrame) -> DataFrame:
        """(a, b): each node of a bucket with the smallest one there, where they are close."""
        tables = nodes.select("node", *self.words, self._homes()).select("node", *self.words, "p.seg", "p.key")
        first = tables.groupBy("seg", "key").agg(F.min(F.struct("node", *self.words)).alias("m"), F.count("*").alias("n")).filter("n > 1")
        first = first.select("seg", "key", F.col("m.node").alias("a"), *(F.col(f"m.{w}").alias(f"m_{w}") for w in self.words))
        stars = tables.join(first, ["seg", "key"]).filter((F.col("a") != F.col("node")) & _close("", "m_", self.words, self.distance))
        return stars.select("a", F.col("node").alias("b"))

    def lookups(self, known: DataFrame) -> DataFrame:
        """(a, b, a_root, b_root): nodes of (node, root, fp0, ...) that are close and have different roots."""
        asked = known.select("node", "root", *self.words, F.explode(F.concat(*(_probes(i, s) for i, s in enumerate(self.plan)))).alias("p"))
        asked = asked.select(F.col("node").alias("a"), F.col("root").alias("a_root"), *(F.col(w).alias(f"a_{w}") for w in self.words), "p.seg", "p.key")
        tables = known.select("node", "root", *self.words, self._homes())
        tables = tables.select(F.col("node").alias("b"), F.col("root").alias("b_root"), *(F.col(w).alias(f"b_{w}") for w in self.words), "p.seg", "p.key")
        links = asked.join(tables, ["seg", "key"]).filter((F.col("a_root") != F.col("b_root")) & _close("a_", "b_", self.words, self.distance))
        turned = F.col("a") > F.col("b")
        return links.select(*(F.when(turned, two).otherwise(F.col(one)).alias(one) for one, two in (
            ("a", F.col("b")), ("b", F.col("a")), ("a_root", F.col("b_root")), ("b_root", F.col("a_root")))))

    def meetings(self, known: DataFrame, steps: Steps) -> DataFrame:
        """(seg, key, node, root, home, fp0, ...): what ``lookups`` lists as pairs, as the two sides of each bucket. Every pair meets
        in the first segment that is close, once: of the node at home there and the one that looks it up. A node has no more rows than
        it has keys to look up, and only where it meets one, however large the group it belongs to."""
        asked = known.select("node", "root", *self.words, F.explode(F.concat(*(_probes(i, s) for i, s in enumerate(self.plan)))).alias("p"))
        asked = asked.select(F.col("node").alias("a"), F.col("root").alias("a_root"), *(F.col(w).alias(f"a_{w}") for w in self.words), "p.*")
        tables = known.select("node", "root", *self.words, self._homes())
        tables = tables.select(F.col("node").alias("b"), F.col("root").alias("b_root"), *(F.col(w).alias(f"b_{w}") for w in self.words),
                               F.col("p.seg").alias("b_seg"), F.col("p.key").alias("b_key"))
        meet = (F.col("seg") == F.col("b_seg")) & (F.col("key") == F.col("b_key")) & (F.col("a_root") != F.col("b_root"))
        meet &= (~F.col("own") | (F.col("a") > F.col("b"))) & _close("a_", "b_", self.words, self.distance)
        for i, s in enumerate(self.plan[:-1]):
            meet &= (F.col("seg") <= i) | (F.bit_count(s.key("a_").bitwiseXOR(s.key("b_"))) > s.radius)
        finders = steps.write(asked.join(tables, meet, "left_semi"), "finders")
        homes = tables.join(finders, meet, "left_semi")
        both = [("a", finders, "seg", "key", False), ("b", homes, F.col("b_seg").alias("seg"), F.col("b_key").alias("key"), True)]
        one, two = (rows.select(seg, key, F.col(c).alias("node"), F.col(f"{c}_root").alias("root"), F.lit(home).alias("home"),
                                *(F.col(f"{c}_{w}").alias(w) for w in self.words)) for c, rows, seg, key, home in both)
        return one.unionByName(two)

    def meet(self, seg: int, homes: list[np.ndarray], finders: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For nodes at home in a bucket and those that look it up, by their words: which meet there, and which of these have the bucket's key both."""
        mixed = [h[:, None] ^ f[None, :] for h, f in zip(homes, finders, strict=True)]
        found = sum(np.bitwise_count(m).astype(np.int64) for m in mixed) <= self.distance
        for s in self.plan[:seg]:
            found &= s.differing(mixed) > s.radius
        return found, self.plan[seg].differing(mixed) == 0


def node_components(nodes: DataFrame, words: list[str], distance: int, plan: list[Segment], steps: Steps) -> DataFrame:
    """(node, root) of all nodes, from (node, fp0, ...), node a number that differs for different fingerprints."""
    index = BitIndex(words, distance, plan)
    near = components(index.stars(nodes), steps)
    known = steps.write(nodes.join(near, "node", "left").select("node", *words, F.coalesce("root", "node").alias("root")), "known")
    links = index.lookups(known).select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b"))
    merged = components(links, steps).select(F.col("node").alias("root"), F.col("root").alias("top"))
    return known.join(merged, "root", "left").select("node", F.coalesce("top", "root").alias("root"))


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = 4,
                    per_word: int = 3, seeds: tuple[int, ...] = (SEED,), plan: list[Segment] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, its fingerprint (fp0, ...) and component_id, the smallest id reachable over links.

    Three segments a word suit up to some 100 million distinct fingerprints, two many more; results are equal.
    A plan of smaller radii than segment_plan's asks less and may leave the farthest links undetected."""
    steps, words = Steps(docs.sparkSession, "simhash"), _words(len(seeds))
    rows = steps.write(fingerprints(docs, id_col, text_col, width, seeds), "prints")
    nodes = rows.groupBy(*words).agg(F.min("doc_id").alias("low")).withColumn("node", F.monotonically_increasing_id())
    nodes = steps.write(nodes, "nodes")  # pins the numbers
    rooted = node_components(nodes.drop("low"), words, distance, plan or segment_plan(distance, per_word, len(seeds)), steps)
    rooted = steps.write(nodes.join(rooted, "node"), "roots")
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lows, "root").select(*words, "component_id")
    return rows.join(named, words).select("doc_id", *words, "component_id")


STAGE_BITS = 24  # candidates differ in no more of 128 bits; 19.4 are expected at a similarity of 0.8
STAGE_PLAN = segment_plan(11, 3, 2)  # whatever differs in 11 bits or fewer is a candidate, farther ones where a segment is close


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5,
                         least: tuple[int, int] = LEAST, bands: int = BANDS) -> DataFrame:
    """docs with the document of the smallest id of each component; all columns and names stay as they are.

    Links are pairs of texts whose five-word shingles have a similarity of 0.8 as multisets. Multi-index hashing of fingerprints
    of 128 bits brings the candidates, and the shingles decide: bits scatter by 4 around the 19.4 that are expected
    there, so they can only guess. Pairs beyond the reach of the index come from bands of minhashes, see ``shingles``.

    Rows that repeat the id that stays are one document and stay. Rows of null id stay only where their component has
    no id at all."""
    found = similar_components(docs, BitIndex(WORDS, STAGE_BITS, STAGE_PLAN), id_col, text_col, width, least, bands)
    gone = found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    gone = Steps(docs.sparkSession, "simhash-gone").write(gone, "ids")
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names).withColumn("__id", F.col(names[docs.columns.index(id_col)]).cast("bigint"))
    kept = rows.join(gone, F.col("__id").eqNullSafe(F.col("doc_id")), "left_anti")
    return kept.select(*names).toDF(*docs.columns)
