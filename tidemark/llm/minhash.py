"""MinHash near-duplicates: universal-hash minima, banding, verification on full shingle sets, components.

Documents with the same shingle set are one class; only its least document goes on.
A band's bucket is linked as a star around its least member, so a bucket of n members
gives n - 1 pairs. Where verification leaves a bucket's members in different
components, all its remaining pairs are compared too: tile by tile, in blocks of
bounded size that each report no more than a spanning forest of the links found.
No bucket is capped and no pair that shares a bucket goes unchecked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, cut, join_groups, map_batches, small_side, table, to_arrow
from .components import components

#: 35 bands of 5 minima: two sets of similarity 0.8 share no bucket with probability (1 - 0.8^5)^35 < 1e-6.
BANDS, ROWS = 35, 5
#: Members, and shingles of them, that one side of a tile holds (about; members are dealt by hash).
TILE, TILE_SHINGLES = 1024, 1_000_000
#: Sets that are compared at once within a tile, and distinct shingles of them.
STRIP, STRIP_SHINGLES = 128, 1 << 16
#: Stars laid over each bucket, around different members, before what is left is compared in tiles.
CENTERS = 2
_MIX = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1


def multipliers(n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """n universal hash functions x -> (a x + b) mod 2^64, upper half: odd a, any b."""
    r = np.random.RandomState(seed)
    draw = lambda: r.randint(0, 1 << 32, n, np.uint64) << np.uint64(32) | r.randint(0, 1 << 32, n, np.uint64)
    return draw() | np.uint64(1), draw()


class Shingler:
    """64-bit hashes of the distinct shingles of a text; words are runs without ASCII white space, A-Z lower-cased."""

    def __init__(self, width: int):
        self.width, self.words = width, WordHashes()

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "replace").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(words) < self.width:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        out = h[: len(h) - self.width + 1].copy()
        for i in range(1, self.width):
            out *= np.uint64(_MIX)
            out ^= out >> np.uint64(29)
            out += h[i : len(h) - self.width + 1 + i]
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
        return np.unique(out)


def _bands(shingles: np.ndarray, a: np.ndarray, b: np.ndarray, bands: int, rows: int) -> np.ndarray:
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):
        part = shingles[i : i + 2048, None] * a
        part += b
        np.minimum(least, part.min(0), out=least)
    least >>= np.uint64(32)
    key = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(_MIX)
    for row in least.reshape(bands, rows).T:
        key = (key ^ row) * np.uint64(0xFF51AFD7ED558CCD)
        key ^= key >> np.uint64(33)
    return key.view(np.int64)


def signatures(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, set_key (128-bit digest of the set, null without words) and the buckets' keys."""

    def make():
        shingle, (a, b) = Shingler(width), multipliers(bands * rows)

        def work(rows_in):
            sets = [shingle(t) for t in rows_in["text"]]
            return {
                "doc_id": rows_in["doc_id"],
                "n_shingles": [len(s) for s in sets],
                "set_key": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                "keys": [_bands(s, a, b, bands, rows) if len(s) else None for s in sets],
            }

        return work

    return map_batches(docs, ["doc_id", "text"], make, "doc_id long, n_shingles long, set_key binary, keys array<long>")


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id and its whole sorted set of shingle hashes."""

    def make():
        shingle = Shingler(width)
        return lambda rows: {"doc_id": rows["doc_id"], "shingles": [shingle(t).view(np.int64) for t in rows["text"]]}

    return map_batches(docs, ["doc_id", "text"], make, "doc_id long, shingles array<long>")


def intersections(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of the sets xs and ys, exactly; memory is bounded by STRIP_SHINGLES a set."""
    pool = np.unique(np.concatenate(xs))
    out = np.zeros((len(xs), len(ys)), np.int64)
    places = []
    for y in ys:
        at = np.minimum(np.searchsorted(pool, y), len(pool) - 1)
        places.append(at[pool[at] == y])
    mine = [np.searchsorted(pool, x) for x in xs]
    for low in range(0, len(pool), STRIP_SHINGLES):
        high = min(low + STRIP_SHINGLES, len(pool))
        has = np.zeros((high - low, len(ys)), np.uint8)
        for j, at in enumerate(places):
            has[at[np.searchsorted(at, low) : np.searchsorted(at, high)] - low, j] = 1
        for i, at in enumerate(mine):
            out[i] += has[at[np.searchsorted(at, low) : np.searchsorted(at, high)] - low].sum(0, dtype=np.int64)
    return out


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    sized = pairs.join(left, "a").join(right, "b")
    both = F.size(F.array_intersect("x", "y"))
    return sized.where(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b")


def _as_links(label: DataFrame) -> DataFrame:
    """Components as stars: what is joined later starts from them, not from all links again."""
    return label.select(F.col("component").alias("a"), F.col("node").alias("b"))


def _undecided(members: DataFrame, label: DataFrame) -> DataFrame:
    """Members (key, doc_id) with their component, of the buckets that hold more than one component."""
    labelled = cut(members.select("key", "doc_id").join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component")), "labelled")
    several = cut(labelled.groupBy("key").agg(F.min("component").alias("p"), F.max("component").alias("q"), F.count(F.lit(1)).alias("n")).where("p != q AND n > 2").select("key"), "several")
    return cut(labelled.join(small_side(several, 16, several.count()), "key", "left_semi"), "rest")


def _stars(members: DataFrame, turn: int) -> DataFrame:
    """Pairs of each bucket's members with one of them, another in each turn, where the components differ."""
    draw = F.struct(F.xxhash64("doc_id", F.lit(turn)).alias("h"), "doc_id", "component")
    center = cut(members.groupBy("key").agg(F.min(draw).alias("c")), "centers")
    pairs = members.join(small_side(center, 60, center.count()), "key").where("component != c.component")
    return pairs.select(F.least("doc_id", "c.doc_id").alias("a"), F.greatest("doc_id", "c.doc_id").alias("b")).distinct()


def _tiles(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among the members of each bucket (key, doc_id, component): each block of members against each other block."""
    # Blocks are cut by a hash of the member, so their number follows from the bucket's totals without ordering it in one task.
    sized = groups.join(sets.select("doc_id", F.size("shingles").cast("long").alias("n")), "doc_id")
    total = sized.groupBy("key").agg(F.ceil(F.greatest(F.count(F.lit(1)) / TILE, F.sum("n") / TILE_SHINGLES)).cast("int").alias("blocks"))
    total = cut(total, "blocks")
    placed = sized.drop("n").join(small_side(total, 16, total.count()), "key").withColumn("own", F.pmod(F.xxhash64("doc_id", "key"), F.col("blocks")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(F.least(i, "own").alias("i"), F.greatest(i, "own").alias("j")))
    dealt = placed.select("key", "doc_id", "component", "own", F.explode(others).alias("t")).select("key", "doc_id", "component", "own", "t.i", "t.j")
    arrow = to_arrow("a long, b long")

    def compare(rows: pa.Table) -> pa.Table:
        """Within one tile: join what is similar and not yet joined."""
        ids, own, comp = (rows.column(c).to_numpy() for c in ("doc_id", "own", "component"))
        i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
        sets_ = [np.asarray(x.values).view(np.uint64) for x in rows.column("shingles")]
        size = np.array([len(s) for s in sets_])
        root = {c: c for c in comp.tolist()}

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        out: list[tuple[int, int]] = []
        by_size = np.argsort(size, kind="stable")
        left, right = by_size[own[by_size] == i], by_size[own[by_size] == j]
        for x in range(0, len(left), STRIP):
            xs = left[x : x + STRIP]
            for y in range(0, len(right), STRIP):
                ys = right[y : y + STRIP]
                if (i == j and y < x) or 100 * size[xs[-1]] < percent * size[ys[0]] or 100 * size[ys[-1]] < percent * size[xs[0]]:
                    continue
                if len({find(c) for c in comp[xs].tolist()} | {find(c) for c in comp[ys].tolist()}) == 1:
                    continue
                both = intersections([sets_[k] for k in xs], [sets_[k] for k in ys])
                union = size[xs][:, None] + size[ys][None, :] - both
                for k, m in np.argwhere(100 * both >= percent * union):
                    p, q = find(int(comp[xs[k]])), find(int(comp[ys[m]]))
                    if p != q:
                        root[max(p, q)] = min(p, q)
                        out.append((int(ids[xs[k]]), int(ids[ys[m]])))
        return pa.table({"a": pa.array([p[0] for p in out], pa.int64()), "b": pa.array([p[1] for p in out], pa.int64())}, schema=arrow)

    return dealt.join(sets, "doc_id").groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every document.

    Documents are linked if the similarity of their sets of distinct ``width``-word shingles is at least ``percent``
    hundredths; component_id is the least doc_id reachable over links, kept says that it is the document's own.
    A text with fewer words than ``width`` has its whole word sequence as its one shingle. A null, empty or blank text
    has no shingles and is linked with nothing. A null doc_id is linked with nothing: its component_id is null and it
    is kept. Repeated rows get the same result each. Where one doc_id has different texts, its component is the least of
    theirs, and links are verified on the least text in binary order. A component's least id may then differ from its own.
    Other columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    signed = cut(signatures(docs, width, bands, rows), "signatures")
    linkable = signed.where("doc_id IS NOT NULL AND set_key IS NOT NULL")
    classes = cut(linkable.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.any_value("keys").alias("keys"), F.count(F.lit(1)).alias("size")), "classes")
    # One row for each bucket and class; buckets of one class are dropped before anything else is joined.
    banded = classes.select("rep", F.explode("keys").alias("key"))
    shared = cut(banded.groupBy("key").agg(F.min("rep").alias("center"), F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    buckets = cut(banded.join(small_side(shared, 40, shared.count()), "key"), "buckets")
    stars = cut(buckets.where("rep != center").select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct(), "stars")
    ids = cut(stars.select(F.col("a").alias("doc_id")).unionByName(stars.select(F.col("b").alias("doc_id"))).distinct(), "ids")
    wanted = docs.join(small_side(ids, 16, ids.count()), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    sets = cut(shingle_sets(wanted, width), "sets")
    links = cut(verified(stars, sets, percent), "links")
    rest, label = buckets.select("key", F.col("rep").alias("doc_id")), components(links)
    for turn in range(CENTERS):
        rest = _undecided(rest, label)
        if turn + 1 < CENTERS:
            label = components(_as_links(label).unionByName(verified(_stars(rest, turn), sets, percent)))
    final = components(_as_links(label).unionByName(_tiles(rest, sets, percent)))
    # Components are found for classes; a class of very many copies is dealt to many tasks.
    labelled = classes.select("set_key", "rep", "size").join(final.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component"), "size")
    total = classes.agg(F.sum("size")).first()[0] or 0
    by_doc = join_groups(linkable.select("doc_id", "set_key"), labelled, ["set_key"], total, ["doc_id"]).groupBy("doc_id").agg(F.min("component").alias("component"))
    return (
        signed.select("doc_id", "n_shingles")
        .join(by_doc, "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))
    )


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components over 2-word shingles at similarity 0.8 of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=2)
