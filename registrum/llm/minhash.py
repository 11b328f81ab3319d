"""Near-duplicates by improved consistent weighted sampling (Ioffe, 2010) of TF-IDF shingles, banded, and verified by
weighted Jaccard similarity.

Texts that are equal are one node from the start. A node's shingles of five words weigh their count times an inverse
document frequency; the frequencies of all documents are kept in a table of fixed size by hash. Nodes that share a band are
compared: first with the most connected node of the band, then, in bands that are still of several components, with each
other in blocks that follow the links as they find them. So no link between different texts within a band is lost, while a
large group makes about as many rows as it has nodes.
"""

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from registrum.llm._shared import bounded, lean, scratch, staged, unused
from registrum.llm.components import connected_components
from registrum.llm.wordhash import mix, shingle_sets

#: Buckets of the table of document frequencies, and of a block of it.
BUCKETS, BLOCK = 1 << 20, 1 << 14
POOL = 1024


@dataclass(frozen=True)
class Settings:
    """shingle: words in a shingle; bands of `rows` samples each; threshold: weighted Jaccard similarity of a link; plain: that
    of the sets without weights links as well; floor: what the commonest shingle weighs against the rarest; block: nodes of
    a band that are compared with as many others in one go; agree: the least share of equal samples with which two nodes of a
    block are verified (of two texts at the threshold, 2 in 10,000 have fewer)."""

    shingle: int = 5
    bands: int = 14
    rows: int = 4
    threshold: float = 0.8
    plain: bool = True
    floor: float = 0.8
    block: int = 512
    agree: float = 0.6
    seed: int = 7


def _count_blocks(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, docs = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for _, bounds, hashes, _ in shingle_sets(batch.column("text"), shingle):
                counts += np.bincount((hashes & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
                docs += int(np.count_nonzero(np.diff(bounds)))
        if docs:
            yield _blocks({k: counts[k * BLOCK : (k + 1) * BLOCK] for k in range(BUCKETS // BLOCK)} | {-1: np.array([docs])})

    return run


def _blocks(sums: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"block": pa.array(list(sums), pa.int32()), "counts": pa.array([zlib.compress(v.astype(np.int64).tobytes(), 1) for v in sums.values()], pa.binary())})


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, packed in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            own = np.frombuffer(zlib.decompress(packed), np.int64)
            sums[block] = sums[block] + own if block in sums else own
    if sums:
        yield _blocks(sums)


def idf_table(docs: DataFrame, settings: Settings) -> np.ndarray:
    """Inverse document frequency by bucket of the shingle's hash, over all documents: 1 for the rarest, `floor` for what every
    document has. Buckets that shingles share count for all of them; the table's size does not depend on the documents. Its
    blocks are summed by tasks that hold no more than the table."""
    parts = docs.select("text").mapInArrow(lean(_count_blocks(settings.shingle)), "block int, counts binary")
    rows = parts.repartition(16, "block").mapInArrow(_add_blocks, "block int, counts binary").collect()
    sums = {r["block"]: np.frombuffer(zlib.decompress(r["counts"]), np.int64) for r in rows}
    if not sums:
        return np.ones(BUCKETS, np.float32)
    n = int(sums[-1][0])
    df = np.concatenate([sums[k] for k in range(BUCKETS // BLOCK)])
    scaled = np.log((1 + n) / (1 + np.minimum(df, n))) / np.log(1 + n)
    return (settings.floor + (1 - settings.floor) * scaled).astype(np.float32)


class Sampler:
    """Consistent weighted samples: equal shingles of equal weight draw the same numbers wherever they are met. The numbers
    come from pools by parts of the shingle's hash; a sample is known by the least value that it reaches."""

    def __init__(self, settings: Settings):
        n = settings.bands * settings.rows
        draw = np.random.Generator(np.random.PCG64(settings.seed))
        gamma = lambda: -np.log(draw.random((n, POOL)))
        self.bands, self.rows = settings.bands, settings.rows
        self.r1, self.r2, self.beta = gamma().astype(np.float32), gamma().astype(np.float32), draw.random((n, POOL)).astype(np.float32)
        self.log_c = np.log(gamma() + gamma()).astype(np.float32)

    def samples(self, bounds: np.ndarray, hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """A row of samples for each set; those of sets without shingles are 0."""
        low = np.uint64(POOL - 1)
        i1, i2, i3, i4 = ((hashes >> np.uint64(s) & low).astype(np.int32) for s in (0, 10, 20, 30))
        log_w, full = np.log(weights.astype(np.float64)).astype(np.float32), np.flatnonzero(np.diff(bounds))
        starts = bounds[:-1][full]
        out = np.zeros((self.bands * self.rows, len(bounds) - 1), np.uint32)
        if len(starts):
            for k in range(len(out)):
                r, b = self.r1[k].take(i1) + self.r2[k].take(i2), self.beta[k].take(i3)
                t = np.floor(log_w / r + b)
                out[k, full] = np.minimum.reduceat(self.log_c[k].take(i4) - r * (t - b + np.float32(1)), starts).view(np.uint32)
        return np.ascontiguousarray(out.T)

    def band_hashes(self, samples: np.ndarray) -> np.ndarray:
        out = np.tile(np.arange(1, self.bands + 1, dtype=np.uint64), (len(samples), 1))
        for k in range(self.rows):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + samples[:, k :: self.rows])
        return out.view(np.int64)


def weights_of(hashes: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """A shingle's count weighs by its logarithm, so that one pair of words said a hundred times does not outweigh a text."""
    return (1 + np.log(counts)) * idf[(hashes & np.uint64(BUCKETS - 1)).astype(np.int64)]


def _sign(shared, settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(settings)
        for batch in batches:
            for at, bounds, hashes, counts in shingle_sets(batch.column("text"), settings.shingle):
                found = sampler.band_hashes(sampler.samples(bounds, hashes, weights_of(hashes, counts, shared.value)))
                full = np.diff(bounds) > 0
                values = [row.tolist() if ok else [] for row, ok in zip(found, full, strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(at, len(full)), "node": batch.column("node").slice(at, len(full)), "bands": pa.array(values, pa.list_(pa.int64()))})

    return run


def pack(hashes: np.ndarray) -> bytes:
    """48-bit hashes in 6 bytes each."""
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


VECTOR = "node binary, hashes binary, times binary, samples binary"


def _vectors(shared, settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(settings)
        for batch in batches:
            for at, bounds, hashes, counts in shingle_sets(batch.column("text"), settings.shingle):
                spans = list(zip(bounds[:-1], bounds[1:], strict=True))
                samples = sampler.samples(bounds, hashes, weights_of(hashes, counts, shared.value))
                columns = {"hashes": [pack(hashes[a:b]) for a, b in spans], "times": [counts[a:b].astype(np.uint32).tobytes() for a, b in spans], "samples": [row.tobytes() for row in samples]}
                yield pa.RecordBatch.from_pydict({"node": batch.column("node").slice(at, len(spans))} | {k: pa.array(v, pa.binary()) for k, v in columns.items()})

    return run


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[float, float]:
    """Of two weighted sets (sorted hashes and their weights): their weighted similarity, and that of the sets alone."""
    if len(b[0]) < len(a[0]):
        a, b = b, a
    if not len(a[0]):
        return 0.0, 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    same = b[0][at] == a[0]
    both, n = float(np.minimum(a[1][same], b[1][at[same]]).sum()), int(same.sum())
    return both / (float(a[1].sum() + b[1].sum()) - both), n / (len(a[0]) + len(b[0]) - n)


class Verifier:
    """Tells whether two packed vectors are a link, and their weighted similarity."""

    def __init__(self, idf: np.ndarray, settings: Settings):
        self.idf, self.settings = idf, settings

    def vector(self, hashes: bytes, times: bytes) -> tuple[np.ndarray, np.ndarray]:
        h = unpack(hashes)
        return h, weights_of(h, np.frombuffer(times, np.uint32), self.idf).astype(np.float64)

    def link(self, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float | None:
        weighted, plain = weighted_jaccard(a, b)
        return weighted if weighted >= self.settings.threshold or (self.settings.plain and plain >= self.settings.threshold) else None


LINK = "u binary, v binary, similarity double"


def _link_rows(found: list[tuple[bytes, bytes, float]]) -> pa.RecordBatch:
    u, v, sim = zip(*found, strict=True) if found else ((), (), ())
    return pa.RecordBatch.from_pydict({"u": pa.array(u, pa.binary()), "v": pa.array(v, pa.binary()), "similarity": pa.array(sim, pa.float64())})


def _verify(shared, settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        verifier = Verifier(shared.value, settings)
        for batch in batches:
            found = []
            u, v, h1, t1, h2, t2 = (batch.column(c) for c in ("u", "v", "h1", "t1", "h2", "t2"))
            for k in range(batch.num_rows):
                sim = verifier.link(verifier.vector(h1[k].as_py(), t1[k].as_py()), verifier.vector(h2[k].as_py(), t2[k].as_py()))
                if sim is not None:
                    found.append((u[k].as_py(), v[k].as_py(), sim))
            yield _link_rows(found)

    return run


class _Sets:
    """Disjoint sets of what is hashable."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        root = x
        while (above := self.up.get(root, root)) != root:
            root = above
        while x != root:
            self.up[x], x = root, self.up.get(x, x)
        return root

    def join(self, a, b) -> None:
        self.up[self.find(a)] = self.find(b)


def block_links(rows: list[dict], verifier: Verifier, agree: float) -> list[tuple[bytes, bytes, float]]:
    """Links that join the components of a pair of blocks. Nodes of the first are held against those of the second (the same, if
    there is but one); pairs that are already of one component are passed over, those with most equal samples come first."""
    one = [r for r in rows if r["side"] != 1]
    two = [r for r in rows if r["side"] != 0]
    if not one or not two:
        return []
    a, b = (np.frombuffer(b"".join(r["samples"] for r in part), np.uint32).reshape(len(part), -1) for part in (one, two))
    equal = np.zeros((len(a), len(b)), np.uint16)
    for k in range(a.shape[1]):
        equal += a[:, k, None] == b[None, :, k]
    i, j = np.nonzero(equal >= agree * a.shape[1])
    sets, vectors, found = _Sets(), {}, []

    def vector(r: dict) -> tuple[np.ndarray, np.ndarray]:
        if r["node"] not in vectors:
            vectors[r["node"]] = verifier.vector(r["hashes"], r["times"])
        return vectors[r["node"]]

    for k in np.argsort(-equal[i, j].astype(np.int32), kind="stable"):
        x, y = one[i[k]], two[j[k]]
        if sets.find(x["part"]) == sets.find(y["part"]):
            continue
        sim = verifier.link(vector(x), vector(y))
        if sim is not None:
            sets.join(x["part"], y["part"])
            found.append((x["node"], y["node"], sim))
    return found


def _blocks_verified(shared, settings: Settings):
    """Takes rows sorted by (band, lo, hi), a pair of blocks after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        verifier, rows, now = Verifier(shared.value, settings), [], None
        for batch in batches:
            for row in batch.to_pylist():
                key = row["band"], row["lo"], row["hi"]
                if key != now:
                    yield _link_rows(block_links(rows, verifier, settings.agree))
                    rows, now = [], key
                rows.append(row)
        yield _link_rows(block_links(rows, verifier, settings.agree))

    return run


def _leader_links(members: DataFrame, vectors: DataFrame, shared, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Links of all nodes of a band with its most connected one, and the leaders (band, node)."""
    lead = members.groupBy("band").agg(F.max(F.struct("weight", "node")).alias("lead")).select("band", F.col("lead.node").alias("v"))
    pairs = members.join(lead, "band").where(F.col("node") != F.col("v")).select(F.least("node", "v").alias("u"), F.greatest("node", "v").alias("v"))
    pairs = bounded(staged(pairs.distinct(), "pairs"))
    first = vectors.select(F.col("node").alias("u"), F.col("hashes").alias("h1"), F.col("times").alias("t1"))
    second = vectors.select(F.col("node").alias("v"), F.col("hashes").alias("h2"), F.col("times").alias("t2"))
    found = first.join(pairs, "u").join(second, "v").mapInArrow(lean(_verify(shared, settings)), LINK)
    return staged(found, "verified"), lead.withColumnRenamed("v", "node")


def _block_links(members: DataFrame, vectors: DataFrame, shared, settings: Settings) -> DataFrame:
    """Links between the components (part) of the nodes of each band. Both the nodes of a band's largest component and all others are
    dealt into blocks; a node of the former goes to the pairs of its block with blocks of the others, and a node of those to
    the pairs of its own with all blocks. Nodes of the largest component are not held against each other: a band of n nodes of which
    m are not of it makes (n + m) * m / block rows and more only by the remainders, so a large group with few strays is linear."""
    parts = members.groupBy("band", "part").agg(F.count(F.lit(1)).alias("n"))
    sizes = parts.groupBy("band").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n"))
    blocks = lambda n: F.ceil(n / F.lit(settings.block)).cast("int")
    sizes = sizes.select("band", "main", blocks(F.col("n_main")).alias("mains"), blocks(F.col("n") - F.col("n_main")).alias("others"))
    dealt = members.join(sizes, "band").withColumn("is_main", F.col("part") == F.col("main"))
    own = F.when(F.col("is_main"), F.pmod(F.xxhash64("node"), F.col("mains"))).otherwise(F.col("mains") + F.pmod(F.xxhash64("node"), F.col("others")))
    first = F.when(F.col("is_main"), F.col("mains")).otherwise(F.lit(0))
    dealt = dealt.withColumn("own", own.cast("int")).withColumn("other", F.explode(F.sequence(first, F.col("mains") + F.col("others") - 1)))
    side = F.when(F.col("own") == F.col("other"), F.lit(-1)).when(F.col("own") < F.col("other"), F.lit(0)).otherwise(F.lit(1))
    dealt = dealt.select("node", "band", "part", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), side.alias("side"))
    rows = dealt.join(vectors, "node").repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi")
    return staged(rows.mapInArrow(lean(_blocks_verified(shared, settings)), LINK), "verified")


def _links(rows: DataFrame, nodes: DataFrame, shared, settings: Settings) -> DataFrame:
    """Verified links (u, v, similarity) of the nodes (node, first_id, bands) whose texts are in rows."""
    banded = nodes.select("node", F.posexplode("bands").alias("no", "value")).select("node", F.xxhash64("no", "value").alias("band"))
    sizes = banded.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    members = staged(banded.join(sizes, "band"), "members")
    centre = members.groupBy("node").agg(F.sum("size").alias("weight"))
    members = staged(members.join(centre, "node").select("band", "node", "weight"), "members")

    holders = members.select("node").distinct().join(nodes.select("node", "first_id"), "node").select("first_id", F.col("node").alias("held"))
    texts = rows.join(bounded(staged(holders, "holders")), F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("node") == F.col("held")), "left_semi").select("node", "text")
    vectors = staged(texts.mapInArrow(lean(_vectors(shared, settings)), VECTOR).dropDuplicates(["node"]), "vectors")

    links, lead = _leader_links(members, vectors, shared, settings)
    parts = connected_components(links.select("u", "v"))
    # bands whose nodes, without the leader that all have been held against, aren't of one component
    left = members.join(lead, ["band", "node"], "left_anti").join(parts, "node", "left")
    left = staged(left.select("band", "node", F.coalesce("component", "node").alias("part")), "left")
    apart = left.groupBy("band").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where(F.col("lo") != F.col("hi")).select("band")
    return links.unionByName(_block_links(left.join(apart, "band"), vectors, shared, settings))


def near_duplicates(docs: DataFrame, settings: Settings = Settings(), *, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(classes, links). classes has a row for each row of docs: key, node (digest of the text), class_id, the least key of its
    class, and kept, true for exactly one row of each class. links has the verified pairs of different texts and their similarity.

    Classes are the connected components of equal texts and verified links. Texts of fewer words than a shingle are one
    shingle; a text without words matches nothing but equal texts; a null text matches nothing and is kept. Rows are told apart
    by key and text, not by key alone; a null key comes after all others, and class_id is null where a class has no other.
    Of repeated rows at most one is kept. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[key].cast("long").alias("doc_id"), F.unhex(F.md5(docs[text].cast("binary"))).alias("node"), docs[text].alias("text"))
    rows = rows.where(F.col("text").isNotNull())
    shared = spark.sparkContext.broadcast(idf_table(rows, settings))
    with scratch(spark) as keep:
        signed = rows.mapInArrow(lean(_sign(shared, settings)), "doc_id long, node binary, bands array<long>")
        signed = staged(signed.withColumn("row", F.monotonically_increasing_id()), "signatures")
        least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row"))
        nodes = staged(signed.groupBy("node").agg(least.alias("first"), F.first("bands").alias("bands")).select("node", "first", F.col("first.doc_id").alias("first_id"), "bands"), "nodes")
        links = keep(staged(_links(rows, nodes, shared, settings), "links"))
        parts = connected_components(links.select("u", "v"))
        nodes = nodes.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
        heads = nodes.groupBy("component").agg(F.min("first").alias("head"))
        classed = nodes.join(heads, "component").select("node", F.col("head.doc_id").alias("class_id"), F.col("head.row").alias("head_row"))
        mine = signed.select("doc_id", "node", "row").join(classed, "node").withColumn("kept", F.col("row") == F.col("head_row"))
        mine = keep(staged(mine.select("doc_id", "node", "class_id", "kept"), "classes"))
    others = docs.where(docs[text].isNull()).select(docs[key].cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("node"), docs[key].cast("long").alias("class_id"), F.lit(True).alias("kept"))
    return mine.unionByName(others).withColumnRenamed("doc_id", key), links


def keep_one(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents without all but the first of each class; all columns stay. Repeated rows (doc_id and text) of that first are
    one, whatever their other columns; rows that share a doc_id alone are judged by their own texts. An empty table stays empty."""
    its_id, its_node, node = (unused(docs, c) for c in ("its_id", "its_node", "node"))
    with scratch(docs.sparkSession) as keep:
        classes, _ = near_duplicates(docs, settings)
        pairs = classes.where(F.col("node").isNotNull()).groupBy(F.col("doc_id").alias(its_id), F.col("node").alias(its_node))
        pairs = pairs.agg(F.bool_or("kept").alias("head"), F.count(F.lit(1)).alias("n"))
        told = keep(staged(pairs.where(~F.col("head") | (F.col("n") > 1)).select(its_id, its_node, "head"), "told"))
    drop, repeated = (told.where(c).drop("head") for c in (~F.col("head"), F.col("head")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(its_id)) & (F.col(node) == F.col(its_node))
    left = docs.withColumn(node, F.unhex(F.md5(F.col("text").cast("binary")))).join(bounded(drop), same, "left_anti")
    if not repeated.isEmpty():
        once = left.join(repeated, same, "left_semi").dropDuplicates(["doc_id", node])
        left = left.join(repeated, same, "left_anti").unionByName(once)
    return left.select(*docs.columns)
