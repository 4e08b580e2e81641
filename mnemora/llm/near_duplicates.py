"""MinHash near-duplicates on fast similarity sketches, banding and exact verification.

A sketch has ``COORDINATES`` coordinates. In round i each element is thrown into one bin with the
value i + u; rounds go on until all bins are filled, and rounds COORDINATES.. fill one bin each,
so every coordinate is filled after at most 2 * COORDINATES rounds. Two sketches agree in a
coordinate with a probability of the sets' similarity.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from mnemora.llm.common import saved, sized
from mnemora.llm.graph import components

SHINGLE = 5
PERCENT = 75  # linked when 100 * intersection >= PERCENT * union
BANDS, ROWS = 36, 4  # a pair of similarity 0.75 shares no band with probability 1.1e-6
COORDINATES = BANDS * ROWS
# A pair is verified when its sketches agree in this share: five deviations below PERCENT.
LEAST_AGREEMENT = 0.57
# Shingles of a bucket that one task compares with each other; larger buckets are cut into blocks.
BLOCK_SHINGLES = 500_000
PART_SHINGLES = 2_000_000  # shingles of a star's members that one task compares with their hub
STARS = 2  # hubs tried per document before what is left is compared block by block

_MUL = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * _MUL[1]
    x = (x ^ (x >> np.uint64(27))) * _MUL[2]
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the five-word shingles; fewer words make one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=n)
    size = min(n, SHINGLE)
    out = np.full(n - size + 1, size, dtype=np.uint64)
    for i in range(size):
        out = mix(out * _MUL[0] + hashes[i : n - size + 1 + i])
    return np.unique(out)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """The sketch of each non-empty set, all sets of a batch in one pass per round."""
    t = np.uint64(COORDINATES)
    out = np.full((len(sets), COORDINATES), _EMPTY, dtype=np.uint64)
    active = np.arange(len(sets))
    low = np.uint64(0xFFFFFFFF)
    for i in range(2 * COORDINATES):
        if not len(active):
            break
        lengths = [len(sets[a]) for a in active]
        h = mix(np.concatenate([sets[a] for a in active]) + np.uint64((i + 1) * int(_MUL[0]) % 2**64))
        if i < COORDINATES:
            bins = ((h >> np.uint64(32)) * t) >> np.uint64(32)
        else:
            bins = np.full(len(h), i - COORDINATES, dtype=np.uint64)
        value = (np.uint64(i) << np.uint64(32)) | (h & low)
        part = np.full(len(active) * COORDINATES, _EMPTY, dtype=np.uint64)
        at = np.repeat(np.arange(len(active), dtype=np.uint64) * t, lengths) + bins
        np.minimum.at(part, at.astype(np.int64), value)
        out[active] = np.minimum(out[active], part.reshape(len(active), COORDINATES))
        active = active[(out[active] == _EMPTY).any(axis=1)]
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """One key for each band; keys of different bands differ."""
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(sketch), BANDS)).copy()
    for r in range(ROWS):
        key = mix(key * _MUL[0] + sketch[:, r::ROWS])
    return key.view(np.int64)


def short_sketch(sketch: np.ndarray) -> np.ndarray:
    """One byte of each coordinate: enough to estimate the similarity."""
    return ((sketch * _MUL[0]) >> np.uint64(56)).astype(np.uint8)


SIGNATURE = "doc_id bigint, mark bigint, n_shingles bigint, fingerprint binary, bands array<bigint>, sketch binary"


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        for start in range(0, len(texts), 256):
            sets = [shingle_set(t.as_py()) for t in texts[start : start + 256]]
            full = [i for i, s in enumerate(sets) if len(s)]
            sketch = sketches([sets[i] for i in full])
            bands: list = [None] * len(sets)
            short: list = [None] * len(sets)
            prints: list = [None] * len(sets)
            for i, b, s in zip(full, band_keys(sketch), short_sketch(sketch), strict=True):
                bands[i], short[i] = b, s.tobytes()
                prints[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(start, 256),
                    batch.column("mark").slice(start, 256),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(prints, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                    pa.array(short, pa.binary()),
                ],
                names=["doc_id", "mark", "n_shingles", "fingerprint", "bands", "sketch"],
            )


@F.pandas_udf(DoubleType())
def agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of equal coordinates of two short sketches."""
    left = np.frombuffer(b"".join(a), dtype=np.uint8).reshape(len(a), COORDINATES)
    right = np.frombuffer(b"".join(b), dtype=np.uint8).reshape(len(b), COORDINATES)
    return pd.Series((left == right).mean(axis=1))


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of rows sorted by key; one group is held at a time."""
    rest = None
    for batch in batches:
        batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        new = (batch[keys] != batch[keys].shift()).any(axis=1).to_numpy().nonzero()[0]
        for a, b in zip(new[:-1], new[1:], strict=True):
            yield batch.iloc[a:b]
        rest = batch.iloc[new[-1] :] if len(new) else None
    if rest is not None:
        yield rest


CELL = ["band_no", "band", "i", "j"]
CELL_ROW = "band_no int, band bigint, i int, j int, node bigint, component bigint, side int"


def _sides(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    side = rows["side"].to_numpy()
    return np.flatnonzero(side <= 1), np.flatnonzero(side >= 1)


def _promising(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of each cell that have a partner in another component with an agreeing sketch.

    A pair counts in the first band that it shares only, so most rows stay in few cells. Which band that
    is follows from the full keys that made the buckets: bytes of the short sketch agree by chance too.
    """
    for rows in _groups(batches, CELL):
        sketch = np.frombuffer(b"".join(rows["sketch"]), dtype=np.uint8).reshape(len(rows), COORDINATES)
        bands = np.stack(rows["bands"].to_list())[:, : int(rows["band_no"].iloc[0])]
        component = rows["component"].to_numpy()
        left, right = _sides(rows)
        wanted = np.zeros(len(rows), dtype=bool)
        for i in left:
            others = right[component[right] != component[i]]
            near = others[(sketch[others] == sketch[i]).mean(axis=1) >= LEAST_AGREEMENT]
            found = near[~(bands[near] == bands[i]).any(axis=1)]
            wanted[found] = True
            wanted[i] |= len(found) > 0
        if wanted.any():
            yield rows.loc[wanted, [*CELL, "node", "component", "side"]]


def _cell_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links between components within each cell, by full shingle sets; at most one less than its rows."""
    for rows in _groups(batches, CELL):
        sets = [shingle_set(t) for t in rows["text"]]
        sizes = np.array([len(x) for x in sets])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
        held = np.zeros(codes.max() + 1, dtype=np.int64)
        node, label = rows["node"].to_numpy(), rows["component"].to_numpy().copy()
        left, right = _sides(rows)
        right_side = np.zeros(len(rows), dtype=bool)
        right_side[right] = True
        u, v = [], []
        for i in left:
            own = codes[starts[i] : starts[i] + sizes[i]]
            held[own] = 1
            both = np.add.reduceat(held[codes], starts)
            held[own] = 0
            linked = right_side & (label != label[i]) & (100 * both >= PERCENT * (sizes + sizes[i] - both))
            for k in np.flatnonzero(linked):
                if label[k] != label[i]:
                    u.append(node[i])
                    v.append(node[k])
                    label[label == label[k]] = label[i]
        yield pd.DataFrame({"u": u, "v": v}, dtype="int64")


def _marked(docs: DataFrame) -> DataFrame:
    """doc_id, mark, text; the mark tells the texts of one id apart."""
    return docs.select("doc_id", F.xxhash64("text").alias("mark"), "text")


def _texts_of(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text) of the given nodes (node, doc_id, mark), one row each."""
    texts = _marked(docs).join(sized(wanted), ["doc_id", "mark"]).select("node", "text")
    return texts.dropDuplicates(["node"])


def _shared_ids(named: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (u, v) between the texts of one id: its rows are one document of the graph."""
    prints = named.groupBy("doc_id").agg(F.min("fingerprint").alias("first"), F.max("fingerprint").alias("last"))
    several = saved(prints.where("first <> last").select("doc_id", "first"), "ids-with-several-texts")
    pairs = named.join(several, "doc_id").where("fingerprint <> first").select("fingerprint", "first").distinct()
    name = nodes.select("fingerprint", F.col("node").alias("u"))
    return pairs.join(name, "fingerprint").join(name.toDF("first", "v"), "first").select("u", "v")


def _star_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The members linked with their hub. Rows come sorted by star, each part's hub first."""
    hub, held = None, None
    for rows in batches:
        u, v = [], []
        for node, star, is_hub, text in zip(rows["node"], rows["hub"], rows["is_hub"], rows["text"], strict=True):
            own = shingle_set(text)
            if is_hub:
                hub, held = star, own
                continue
            if hub != star:
                raise ValueError(f"star {star} came without its hub")
            both = len(np.intersect1d(own, held, assume_unique=True))
            if 100 * both >= PERCENT * (len(own) + len(held) - both):
                u.append(node)
                v.append(star)
        yield pd.DataFrame({"u": u, "v": v}, dtype="int64")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v, n_shingles of u) that are linked, by their full shingle sets.

    Texts go to the hubs v, not sets: a set takes two to three times the room. The members of a large
    star are dealt over parts of bounded size, and the hub goes to each of them.
    """
    size = F.sum("n_shingles")
    parts = F.least(F.count("*"), F.ceil(size / PART_SHINGLES)).cast("int")
    stars = pairs.groupBy("v").agg(F.greatest(parts, F.lit(1)).alias("parts"))
    members = pairs.join(stars, "v").select(
        F.col("u").alias("node"), F.col("v").alias("hub"),
        F.pmod(F.xxhash64("u"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("is_hub"),
    )
    hubs = stars.select(
        F.col("v").alias("node"), F.col("v").alias("hub"),
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("is_hub"),
    )
    meeting = members.union(hubs).join(texts, "node").repartition("hub", "part")
    meeting = meeting.sortWithinPartitions("hub", "part", F.desc("is_hub"))
    return meeting.select("node", "hub", "is_hub", "text").mapInPandas(_star_links, "u bigint, v bigint")


def _open_links(buckets: DataFrame, joined: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Links between members of one bucket that are still in different components.

    Buckets are cut into blocks of bounded size and every two blocks meet in a cell. A first pass over
    sketches leaves the rows that have a promising partner; only for those the full texts are sent to
    the cells. Both passes return no more rows than they read.
    """
    member = buckets.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = (
        member.groupBy("band_no", "band")
        .agg(F.min("component").alias("a"), F.max("component").alias("z"), F.sum("n_shingles").alias("all"))
        .where("a <> z")
        .select("band_no", "band", F.ceil(F.col("all") / BLOCK_SHINGLES).cast("int").alias("parts"))
    )
    sketch = nodes.groupBy("node").agg(F.min("sketch").alias("sketch"), F.min_by("bands", "sketch").alias("bands"))
    side = F.when(F.col("mine") == F.col("other"), 1).when(F.col("mine") < F.col("other"), 0).otherwise(2)
    cells = (
        member.join(mixed, ["band_no", "band"])
        .withColumn("mine", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other"), "side": side})
        .select(*CELL, "node", "component", "side")
        .join(sketch, "node")
    )
    promising = saved(
        cells.repartition(*CELL).sortWithinPartitions(*CELL).mapInPandas(_promising, CELL_ROW), "promising"
    )
    meeting = promising.join(texts, "node").repartition(*CELL).sortWithinPartitions(*CELL)
    return saved(meeting.mapInPandas(_cell_links, "u bigint, v bigint").distinct(), "open-links")


def linked_classes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents of equal shingle sets are one node from the start. Every band bucket links its nodes to the one
    of the smallest doc_id: these stars are verified first, which
    joins the members of large groups of copies in one step each. What shares a bucket and is still
    in different components is then compared in blocks, by sketches and then by full sets. No pairs
    are made within a component.

    Texts that are null, empty or without words are linked with nothing. Repeated rows fall into one
    class; rows of the same doc_id count as one document of the graph, which has the links of all its texts. A null doc_id is linked with
    nothing and kept, its component_id is null. Other columns are ignored, empty tables give none.
    """
    marks = saved(_marked(docs).mapInArrow(_signatures, SIGNATURE), "signatures")
    named = marks.where("doc_id is not null and fingerprint is not null")
    # Equal sets have equal sketches, so any row of a class stands for it.
    nodes = saved(
        named.groupBy("fingerprint").agg(
            F.min(F.struct("doc_id", "mark")).alias("least"), *[F.first(c).alias(c) for c in ("n_shingles", "bands", "sketch")]
        ).withColumn("node", F.monotonically_increasing_id()),
        "nodes",
    )
    spread = nodes.select(F.posexplode("bands").alias("band_no", "band"), "node", "n_shingles", "least.doc_id")
    smallest = F.min(F.struct("doc_id", "node")).alias("hub")
    hubs = spread.groupBy("band_no", "band").agg(smallest, F.count("*").alias("n")).where("n > 1")
    hubs = hubs.select("band_no", "band", F.col("hub.node").alias("hub"), F.col("hub.doc_id").alias("hub_id"))
    buckets = saved(spread.drop("doc_id").join(hubs, ["band_no", "band"]), "buckets")
    # All that is verified later shares a bucket: one pass over the documents finds their texts.
    least = nodes.select("node", "least.doc_id", "least.mark")
    wanted = saved(least.join(buckets.select("node").distinct(), "node", "left_semi"), "wanted")
    texts = saved(_texts_of(wanted, docs), "texts")

    sketch = nodes.groupBy("node").agg(F.min("sketch").alias("sketch"))
    stars = (
        buckets.where("node <> hub")
        .groupBy("node", "hub", "hub_id")
        .agg(F.count("*").alias("shared"), F.max("n_shingles").alias("n_shingles"))
    )
    best = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("shared"), "hub_id", "hub"))
    first = stars.withColumn("rank", best).where(F.col("rank") <= STARS).select("node", "hub", "n_shingles", "rank")
    near = (
        first.join(sketch, "node")
        .join(sketch.select(F.col("node").alias("hub"), F.col("sketch").alias("other")), "hub")
        .where(agreement("sketch", "other") >= LEAST_AGREEMENT)
        .select(F.col("node").alias("u"), F.col("hub").alias("v"), "n_shingles", "rank")
    )
    near = saved(near, "stars")
    same_id = saved(_shared_ids(named, nodes), "shared-ids")
    links = near.select("u", "v").where("false")
    for rank in range(1, STARS + 1):
        # A further hub is tried only for members that no hub before it has taken in.
        untaken = near.where(F.col("rank") == rank).drop("rank").join(links.select("u"), "u", "left_anti")
        links = links.union(saved(_verified(untaken, texts), "links"))
    links = links.union(same_id)
    joined = components(links)
    more = _open_links(buckets, joined, nodes, texts)
    if not more.isEmpty():
        joined = components(links.union(more))

    placed = nodes.join(joined, "node", "left")
    placed = saved(placed.select("fingerprint", "least.doc_id", F.coalesce("component", "node").alias("component")), "placed")
    smallest_id = placed.groupBy("component").agg(F.min("doc_id").alias("class"))
    classes = placed.join(saved(smallest_id, "smallest"), "component").select("fingerprint", "class")
    by_id = (
        named.select("doc_id", "fingerprint")
        .join(classes, "fingerprint")
        .groupBy("doc_id")
        .agg(F.min("class").alias("class"))
    )
    found = marks.select("doc_id", "n_shingles").join(by_id, "doc_id", "left")
    component = F.coalesce("class", "doc_id")
    kept = F.coalesce(component == F.col("doc_id"), F.lit(True))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each class of near-duplicates, with all its columns.

    Rows that share a doc_id with a kept row are repeats of it: the first by text stays. Rows of
    null doc_id stay.
    """
    classes = saved(linked_classes(docs), "classes")
    drop = sized(saved(classes.where("not kept").select(F.col("doc_id").alias("_drop")).distinct(), "drop"))
    counts = classes.where("doc_id is not null").groupBy(F.col("doc_id").alias("_again")).count()
    repeated = sized(saved(counts.where("count > 1").select("_again"), "repeated"))
    left = docs.select(F.struct("*").alias("row")).join(drop, F.col("row.doc_id") == F.col("_drop"), "left_anti")
    once = F.col("row.doc_id") == F.col("_again")
    again = left.join(repeated, once, "left_semi")
    first = again.groupBy("row.doc_id").agg(F.min_by("row", F.struct("row.text")).alias("row"))
    return left.join(repeated, once, "left_anti").select("row.*").union(first.select("row.*"))
