"""Near-duplicate embeddings by sorted projection passes.

In each pass the vectors are ordered lexicographically by the concatenated signs
of random projections and each is compared with a bounded window of neighbours;
the pairs that reach the threshold are united over all passes. Inside a
component, vectors within half the threshold's angle of its least vector are all
linked with each other; only the remaining ones are compared one by one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.llm.common import stored, tidy
from strandmill.llm.components import components

#: Neighbours compared, signs in a key, and the share of pairs at the threshold
#: itself that the passes shall find.
WINDOW, SIGNS, RECALL = 48, 62, 0.97
#: Vectors sampled to measure how keys crowd, those of them that get a partner at the
#: threshold, and the passes tried on them.
SAMPLE, PROBES, TRIALS = 4096, 256, 64
#: Rows of a block when a component's vectors are compared one by one.
BLOCK = 512


def passes_needed(rows: int, threshold: float, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes after which a pair at the threshold has met with chance ``recall``.

    Two vectors meet if their keys share a prefix that about ``window`` keys share.
    """
    agree = 1 - math.acos(threshold) / math.pi
    meets = agree ** max(math.log2(max(rows, 2) / window), 1.0)
    return max(4, math.ceil(math.log(1 - recall) / math.log(1 - min(meets, 0.999))))


def measured_passes(sample: np.ndarray, rows: int, threshold: float, window: int = WINDOW, recall: float = RECALL, seed: int = 0) -> tuple[int, np.ndarray]:
    """Passes that find pairs at the threshold where keys crowd, and the centre for the keys.

    Sampled vectors get a partner at the threshold in the direction of another one.
    A trial pass counts the sampled keys between both, without vectors that link with
    either, as those are united anyway. How often few enough lie between is carried
    on to all rows by a power law. The tenth of the vectors that meets least in half
    of the trials decides, by its other half. The centre is the mean or the origin,
    whichever needs fewer passes.
    """
    least = passes_needed(rows, threshold, window, recall)
    origin, n, dims = np.zeros(sample.shape[1]), *sample.shape
    if n < 3 or rows <= window or dims < 2:
        return least, origin
    rng = np.random.default_rng([seed, dims])
    x, z = sample[rng.permutation(n)[:PROBES]], sample[rng.permutation(n)[:PROBES]]
    aside = z - np.einsum("ij,ij->i", x, z)[:, None] * x
    aside = np.where((np.linalg.norm(aside, axis=1) < 1e-6)[:, None], rng.normal(size=x.shape), aside)
    aside -= np.einsum("ij,ij->i", x, aside)[:, None] * x
    y = threshold * x + math.sqrt(1 - threshold**2) * aside / np.linalg.norm(aside, axis=1)[:, None]
    far = (x @ sample.T < threshold) & (y @ sample.T < threshold)
    places = np.unique(np.geomspace(max(2.0, window * n / rows), max(4.0, n / 8), 6).astype(int)) if window * n < 2 * rows else np.array([window * n // rows])
    weights = 1 << np.arange(SIGNS - 1, -1, -1, dtype=np.int64)
    found = []
    for centre in (origin, sample.mean(axis=0)):
        between = np.empty((TRIALS, len(x)), np.int64)
        draw = np.random.default_rng([seed, dims, 1])
        for t in range(TRIALS):
            planes = draw.normal(size=(dims, SIGNS))
            all_keys, one, two = ((((v - centre) @ planes > 0) * weights).sum(axis=1) for v in (sample, x, y))
            low, high = np.minimum(one, two)[:, None], np.maximum(one, two)[:, None]
            between[t] = ((all_keys >= low) & (all_keys <= high) & far).sum(axis=1)
        close = between[:, :, None] < places
        crowded = np.argsort(close[::2].mean(axis=(0, 2)), kind="stable")[: max(len(x) // 10, 1)]
        meets = np.maximum(close[1::2][:, crowded].mean(axis=(0, 1)), 0.5 / (TRIALS // 2 * len(crowded)))
        power = max(np.polyfit(np.log(places), np.log(meets), 1)[0], 0.0) if len(places) > 1 else 0.0
        chance = meets[0] * min(window * n / rows / places[0], 1.0) ** power
        found.append((math.ceil(math.log(1 - recall) / math.log(1 - min(chance, 0.999))), centre))
    passes, centre = min(found, key=lambda f: f[0])
    return max(least, passes), centre


def _unit_rows(column: pa.ListArray) -> tuple[np.ndarray, list]:
    """Which vectors are usable, and the unit vectors of those (None elsewhere)."""
    usable = np.zeros(len(column), bool)
    units: list = [None] * len(column)
    for i, value in enumerate(column):
        if not value.is_valid or len(value.values) == 0 or value.values.null_count:
            continue
        v = value.values.to_numpy(zero_copy_only=False).astype(np.float64)
        top = np.abs(v).max()
        if np.isfinite(top) and top > 0:
            v = v / top
            units[i] = v / math.sqrt(float(v @ v))
            usable[i] = True
    return usable, units


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            _, units = _unit_rows(part.column(1))
            prints = [xxhash.xxh3_128_intdigest(u.tobytes()) if u is not None else None for u in units]
            signed = lambda x: x - 2**64 if x >= 2**63 else x
            columns = [
                part.column(0),
                pa.array([None if p is None else signed(p >> 64) for p in prints], pa.int64()),
                pa.array([None if p is None else signed(p & (2**64 - 1)) for p in prints], pa.int64()),
                pa.array(units, pa.list_(pa.float64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "print_a", "print_b", "unit"])


def _keys(passes: int, seed: int, centres: dict[int, np.ndarray]):
    """Rows (pass, dims, key, id, unit): one per pass of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(SIGNS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                ids, units = part.column(0).to_numpy(), part.column(1).to_pylist()
                for dims in sorted({len(u) for u in units}):
                    rows = [i for i, u in enumerate(units) if len(u) == dims]
                    if dims not in planes:
                        planes[dims] = np.random.default_rng([seed, dims]).normal(size=(dims, passes * SIGNS))
                    x = np.array([units[i] for i in rows])
                    keys = (((x - centres.get(dims, 0.0)) @ planes[dims] > 0).reshape(len(rows), passes, SIGNS) * weights).sum(axis=2).T.reshape(-1)
                    vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, dims * len(rows) * passes + 1, dims), pa.int32()), pa.array(np.tile(x, (passes, 1)).reshape(-1)))
                    columns = [
                        pa.array(np.repeat(np.arange(passes, dtype=np.int32), len(rows))),
                        pa.array(np.full(len(keys), dims, np.int32)),
                        pa.array(keys),
                        pa.array(np.tile(ids[rows], passes)),
                        vectors,
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["pass", "dims", "key", "id", "unit"])

    return run


def _united(ids: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Least id that each place reaches over the pairs (p, q)."""
    label = ids.copy()
    while True:
        low = np.minimum(label[p], label[q])
        new = label.copy()
        np.minimum.at(new, p, low)
        np.minimum.at(new, q, low)
        if (new == label).all():
            return label
        label = new


def _windows(threshold: float, window: int):
    """Links inside windows of ordered rows, as (id, least id it reaches here)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                group = part.column(0).to_numpy().astype(np.int64) * 2**32 + part.column(1).to_numpy()
                ids, units = part.column(2).to_numpy(), part.column(3)
                for kind in np.unique(group):
                    rows = np.flatnonzero(group == kind)
                    flat = units.slice(rows[0], len(rows)).flatten().to_numpy(zero_copy_only=False)
                    x, own = flat.reshape(len(rows), -1), ids[rows]
                    if held is not None and held[0] == kind:
                        x, own = np.vstack([held[1], x]), np.concatenate([held[2], own])
                    p, q = [], []
                    for step in range(1, min(window, len(x) - 1) + 1):
                        near = np.flatnonzero(np.einsum("ij,ij->i", x[step:], x[:-step]) >= threshold)
                        p.append(near + step)
                        q.append(near)
                    held = kind, x[-window:], own[-window:]
                    if p and sum(map(len, p)):
                        label = _united(own, np.concatenate(p), np.concatenate(q))
                        moved = label != own
                        yield pa.RecordBatch.from_arrays([pa.array(own[moved]), pa.array(label[moved])], ["a", "b"])

    return run


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def near_duplicate_vectors(embeddings: DataFrame, threshold: float = 0.9, window: int = WINDOW, recall: float = RECALL, seed: int = 11) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors link if their cosine in double precision is at least ``threshold``
    (above 0). The passes follow from the number of distinct vectors and from how
    their keys crowd in a sample (``measured_passes``); a pair at the threshold
    meets in one of them with chance ``recall``, closer pairs more surely. Once two vectors are in one component, the link between them is
    decided exactly, so dense groups lose none.

    Vectors that are null, empty, zero or hold null or non-finite components link
    with nothing; vectors of other lengths are not compared. Equal vectors are
    one class whatever their number. Rows without a vec_id count as links of
    others only if an equal vector has one, and get a null component and are
    kept; rows that share a vec_id are separate vectors with one name. Other
    columns are ignored; an empty table gives no rows.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    ready = stored(rows.mapInArrow(tidy(_prepared), "vec_id long, print_a long, print_b long, unit array<double>"), "vectors")
    usable = ready.where("print_a is not null")
    classes = usable.groupBy("print_a", "print_b").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("unit").alias("unit")).where("id is not null")
    # Ids name classes; where rows share an id, its classes count as one through it.
    classes = stored(classes, "vector-classes")
    passes, centres = 4, {}
    for dims, count in classes.groupBy(F.size("unit")).count().collect():
        own = classes.where(F.size("unit") == dims)
        sample = own.select("unit").orderBy(F.xxhash64("print_a", "print_b"), "print_a", "print_b").limit(SAMPLE).collect()
        needed, centres[dims] = measured_passes(np.array([r.unit for r in sample]), count, threshold, window, recall, seed)
        passes = max(passes, needed)
    keyed = classes.select("id", "unit").mapInArrow(tidy(_keys(passes, seed, centres)), "pass int, dims int, key long, id long, unit array<double>")
    order = ["pass", "dims", "key", "id"]
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("pass", "dims", "id", "unit")
    links = ordered.mapInArrow(tidy(_windows(threshold, window)), "a long, b long").distinct()
    parts = stored(components(links), "vector-parts")

    members = stored(classes.join(parts.withColumnRenamed("node", "id"), "id").select("component", "id", "copies", "unit"), "vector-members")
    heads = members.where("id = component").select("component", F.col("unit").alias("head"))
    inner = math.cos(math.acos(threshold) / 2) + 1e-9
    placed = members.join(heads, "component").select("component", "id", "copies", "unit", (_dot(F.col("unit"), F.col("head")) >= inner).alias("core"))
    placed = stored(placed, "vector-placed")
    core = placed.where("core").groupBy("component").agg(F.sum("copies").alias("core_copies"))
    fringe = placed.where("not core")
    sizes = placed.join(fringe.select("component").distinct(), "component", "left_semi").groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    left = fringe.join(sizes, "component").select("component", block.alias("i"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("j"), F.col("id").alias("a"), F.col("unit").alias("x"), F.col("copies").alias("copies_a"))
    right = placed.join(sizes, "component").select("component", F.explode(F.expr("sequence(0, blocks - 1)")).alias("i"), block.alias("j"), F.col("id").alias("b"), F.col("unit").alias("y"), F.col("copies").alias("copies_b"), F.col("core").alias("core_b"))
    same = (F.col("a") != F.col("b")) & (F.size("x") == F.size("y"))
    pairs = left.join(right, ["component", "i", "j"]).where(same & (_dot(F.col("x"), F.col("y")) >= threshold))
    pairs = stored(pairs.select("a", "b", "copies_a", "copies_b", "core_b"), "vector-pairs")
    extra = pairs.select(F.col("a").alias("id"), F.col("copies_b").alias("more")).unionByName(pairs.where("core_b").select(F.col("b").alias("id"), F.col("copies_a").alias("more")))
    extra = extra.groupBy("id").agg(F.sum("more").alias("more"))
    counted = placed.join(core, "component", "left").join(extra, "id", "left")
    own = F.when(F.col("core"), F.col("core_copies")).otherwise(F.col("copies")) - 1
    counted = counted.select("id", "component", (own + F.coalesce("more", F.lit(0))).alias("linked")).groupBy("id").agg(F.min("component").alias("component"), F.max("linked").alias("linked"))
    labelled = classes.select("print_a", "print_b", "id", "copies").join(counted, "id", "left")
    named = ready.select("vec_id", "print_a", "print_b").join(labelled, ["print_a", "print_b"], "left")
    component = F.when(F.col("vec_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "id", "vec_id"))
    n_links = F.coalesce("linked", F.col("copies") - 1, F.lit(0)).cast("long")
    return named.select("vec_id", n_links.alias("n_links"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
