"""Near-duplicate documents by b-bit MinHash.

A document is its set of distinct word shingles. The minima of 128 permutations
of that set give 32 band keys of four minima each, and their lowest two bits
form a packed signature. Documents of equal sets are one class. Classes that
share a band key are candidates: first each with a pivot of its bucket, in two
rounds. What is not connected then is compared inside its bucket, in blocks of
bounded size on both sides. Bit counts of the packed signatures estimate the
similarity, corrected for the chance that low bits of different minima agree; what
the estimate does not rule out is decided on the full sets, by how both differ
from the bucket's pivot, inside the comparison, so only links leave it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.llm.common import Shelf, stored, tidy, whole
from strandmill.llm.components import components

HASHES, BANDS, BITS = 128, 32, 2
#: Least corrected estimate that goes on to the full sets: at a similarity of 0.8
#: one pair in a million has less, as 128 matches have a deviation of 0.03.
LEAST_ESTIMATE = 0.59
#: Ids that are broadcast to pick texts; more are joined by shuffle. Rows of a block,
#: and rounds of pivots before the comparison of blocks.
BROADCAST_IDS, BLOCK, ROUNDS = 200_000, 2048, 2
_rng = np.random.default_rng(20_240_601)
_MULTIPLIERS = _rng.integers(0, 2**63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _rng.integers(0, 2**63, 8, np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _rng.integers(0, 2**63, BANDS, np.uint64)
_WIDE = 2048


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: bytes, words_each: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of lower-cased ASCII-split words.

    Fewer words than a shingle holds make one shingle together; no word, none.
    """
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < words_each:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    last = len(words) - words_each + 1
    total = np.zeros(last, np.uint64)
    for i in range(words_each):
        total += hashed[i : i + last] * _PLACES[i]
    return np.unique(_mixed(total))


def minima(shingles: np.ndarray) -> np.ndarray:
    """Least value of the set under each of the permutations."""
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), _WIDE):
        np.minimum(out, (_MULTIPLIERS[:, None] * shingles[None, at : at + _WIDE]).min(axis=1), out=out)
    return out


def band_keys(least: np.ndarray) -> np.ndarray:
    """A 64-bit key per band."""
    each = HASHES // BANDS
    return _mixed((least.reshape(BANDS, each) * _PLACES[:each]).sum(axis=1, dtype=np.uint64) ^ _BAND)


def packed(least: np.ndarray) -> np.ndarray:
    """The lowest bits of the minima in planes of 64: BITS numbers per 64 minima."""
    low = _mixed(least)
    planes = np.stack([(low >> np.uint64(b)) & np.uint64(1) for b in range(BITS)]).reshape(BITS, len(least) // 64, 64)
    return (planes << np.arange(64, dtype=np.uint64)).sum(axis=2, dtype=np.uint64).reshape(-1)


PLANES = BITS * HASHES // 64


def _signatures(words_each: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sizes, first, second, keys, planes = [], [], [], [], []
                for text in part.column(1).to_pylist():
                    shingles = shingle_set(text or b"", words_each)
                    least = minima(shingles)
                    print_ = xxhash.xxh3_128_intdigest(shingles.tobytes())
                    sizes.append(len(shingles))
                    first.append(print_ >> 64)
                    second.append(print_ & (2**64 - 1))
                    keys.append(band_keys(least))
                    planes.append(packed(least))
                signed = lambda values: pa.array(np.array(values, np.uint64).view(np.int64))
                lists = lambda rows, n: pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(rows) + 1, n), pa.int32()), pa.array(np.concatenate(rows).view(np.int64)))
                columns = [part.column(0), pa.array(sizes, pa.int64()), signed(first), signed(second), lists(keys, BANDS), lists(planes, PLANES)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "print_a", "print_b", "bands", "planes"])

    return run


def _shingle_sets(words_each: int):
    """Shingle sets of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                sets = [shingle_set(text or b"", words_each) for text in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, sets)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))], ["id", "shingles"])

    return run


def estimate(left: Column, right: Column) -> Column:
    """Similarity from two packed signatures: a minimum agrees if all its bits do."""
    per = HASHES // 64
    differ = lambda w: reduce(lambda x, y: x.bitwiseOR(y), [F.element_at(left, w + b * per).bitwiseXOR(F.element_at(right, w + b * per)) for b in range(BITS)])
    unlike = reduce(lambda x, y: x + y, [F.bit_count(differ(w + 1)) for w in range(per)])
    chance = 2.0**-BITS
    return ((HASHES - unlike) / float(HASHES) - chance) / (1 - chance)


def _plausible(n1: Column, n2: Column, p1: Column, p2: Column, percent: int) -> Column:
    """Sizes and estimate do not rule the link out."""
    return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & (estimate(p1, p2) >= LEAST_ESTIMATE)


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Texts of some ids: broadcast if those are few, else joined by shuffle."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "id", "left_semi")


def _confirmed(docs: DataFrame, pairs: DataFrame, percent: int, words_each: int, shelf: Shelf) -> DataFrame:
    """Pairs (a, b) whose full sets overlap enough."""
    pairs = shelf.put(pairs, "pairs")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = shelf.put(_texts_of(docs, ids).mapInArrow(tidy(_shingle_sets(words_each)), "id long, shingles array<long>"), "sets")
    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", common.alias("common"), (F.size("x") + F.size("y")).alias("sizes"))
    return shelf.put(both.where((F.col("common") > 0) & (100 * F.col("common") >= percent * (F.col("sizes") - F.col("common")))).select("a", "b").distinct(), "confirmed")


def _stars(placed: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of each bucket's pivot with its members of other parts.

    In the first turn the pivot is the member whose buckets hold most rows, as it
    differs least from the others; later it is drawn by a hash of bucket, id and
    turn, so a group that shares many buckets is tried against many pivots.
    """
    draw = F.xxhash64("key", "id", F.lit(turn))
    draw = F.struct((F.col("weight") if turn == 0 else F.lit(0)).alias("first"), draw, "id", "part")
    pivots = placed.groupBy("key").agg(F.max(draw).alias("pivot")).select("key", F.col("pivot.id").alias("pivot"), F.col("pivot.part").alias("pivot_part"))
    pairs = placed.join(pivots, "key").where("part <> pivot_part")
    return pairs.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()


def _likely(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """Pairs that sizes and signatures do not rule out."""
    one = marks.select(F.col("id").alias("a"), F.col("n").alias("n1"), F.col("planes").alias("p1"))
    two = marks.select(F.col("id").alias("b"), F.col("n").alias("n2"), F.col("planes").alias("p2"))
    joined = pairs.join(one, "a").join(two, "b")
    return joined.where(_plausible(F.col("n1"), F.col("n2"), F.col("p1"), F.col("p2"), percent)).select("a", "b")


def _blocked(rows: DataFrame) -> DataFrame:
    """``rows`` (key, id, part, ...) with the bucket's most frequent part ``main``, a block
    of at most about BLOCK rows on each side of it, and the numbers of such blocks."""
    counted = rows.groupBy("key", "part").agg(F.count(F.lit(1)).alias("members")).groupBy("key").agg(F.max_by("part", F.struct("members", "part")).alias("main"), F.sum("members").alias("all"), F.max("members").alias("most"))
    blocks = lambda n: F.greatest(F.ceil(n / BLOCK), F.lit(1)).cast("int")
    sides = counted.where("all > most").select("key", "main", blocks(F.col("most")).alias("mains"), blocks(F.col("all") - F.col("most")).alias("others"))
    placed = rows.join(sides, "key").withColumn("is_main", F.col("part") == F.col("main"))
    return placed.withColumn("block", F.pmod(F.xxhash64("id"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("others"))).cast("int"))


def _distinct_buckets(rows: DataFrame) -> DataFrame:
    """One bucket of those that hold the same members; the others would compare them again."""
    ids = rows.select("key", "id").distinct()
    held = ids.groupBy("key").agg(F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("a"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("b"), F.count(F.lit(1)).alias("n"))
    return rows.join(held.groupBy("a", "b", "n").agg(F.min("key").alias("key")).select("key"), "key", "left_semi")


def _side(rows: DataFrame, tag: str, own: str, across: str, columns: list[str], extra: list[str] = ()) -> DataFrame:
    """Rows for one side of a comparison of blocks: (key, own, across) and the columns, tagged."""
    return rows.select("key", F.col("block").alias(own), F.explode(F.expr(f"sequence(0, {across} - 1)")).alias("j" if own == "i" else "i"), *[F.col(c).alias(c + tag) for c in columns], *extra)


def _live(members: DataFrame, marks: DataFrame, percent: int, shelf: Shelf) -> DataFrame:
    """(key, id, part, weight) of bucket members that have a plausible partner in
    another part at all. Semi-joins of blocks return a member once, however many
    partners it has."""
    rows = shelf.put(_blocked(_distinct_buckets(members).join(marks, "id")), "open")
    columns = ["id", "part", "weight", "n", "planes"]
    fits = _plausible(F.col("n1"), F.col("n2"), F.col("planes1"), F.col("planes2"), percent)
    main, rest = rows.where("is_main"), rows.where("not is_main")
    parts = []
    for one, two, own, across in ((rest, main, "others", "mains"), (main, rest, "mains", "others"), (rest, rest, "others", "others")):
        left, right = _side(one, "1", "i", across, columns), _side(two, "2", "j", own, columns)
        on = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("key", "i", "j")]
        found = left.alias("l").join(right.alias("r"), [*on, F.col("part1") != F.col("part2"), fits], "left_semi")
        parts.append(found.select("key", F.col("id1").alias("id"), F.col("part1").alias("part"), F.col("weight1").alias("weight")))
    return shelf.put(_distinct_buckets(shelf.put(reduce(DataFrame.unionByName, parts).distinct(), "live-rows")), "live-rows")


def _differences(live: DataFrame, texts: DataFrame, words_each: int, shelf: Shelf) -> DataFrame:
    """(key, id, part, n, d, diff): how each bucket member differs from its bucket's pivot.

    ``d`` is the size of the symmetric difference of both sets. ``diff`` holds it without
    the shingles that no other live set has, as those are in no other difference. With
    o shingles common to the differences of two members, the intersection of their full
    sets is (n1 + n2 - d1 - d2) / 2 + o, exactly.
    """
    ids = shelf.put(live.select("id").distinct(), "live")
    sets = _texts_of(texts, ids).mapInArrow(tidy(_shingle_sets(words_each)), "id long, shingles array<long>")
    # Rows of one id may hold several texts; each of their sets is a member.
    sets = shelf.put(sets.groupBy("id", F.xxhash64("shingles").alias("mark")).agg(F.first("shingles").alias("shingles")), "live-sets")
    owners = sets.select("id", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.min("id").alias("id"), F.max("id").alias("other")).where("id = other")
    alone = owners.groupBy("id").agg(F.collect_list("shingle").alias("alone"))
    common = F.array_except("shingles", F.coalesce("alone", F.array().cast("array<bigint>")))
    sets = shelf.put(sets.join(alone, "id", "left").select("id", "mark", "shingles", common.alias("common")), "live-sets")
    central = F.struct("weight", F.xxhash64("key", "id"), "id")
    pivots = live.groupBy("key").agg(F.max(central).alias("pivot")).select("key", F.col("pivot.id").alias("id"))
    one_set = sets.groupBy("id").agg(F.min("mark").alias("mark"))
    of_pivot = pivots.join(one_set, "id").join(sets.select("id", "mark", F.col("shingles").alias("base")), ["id", "mark"]).select("key", "base")
    rows = live.join(sets, "id").join(of_pivot, "key")
    lost = F.array_except("base", "shingles")
    size = F.size("shingles") - F.size("base") + 2 * F.size(lost)
    return rows.select("key", "id", "part", F.size("shingles").alias("n"), size.alias("d"), F.concat(lost, F.array_except("common", "base")).alias("diff"))


def _bridges(live: DataFrame, marks: DataFrame, texts: DataFrame, percent: int, words_each: int, shelf: Shelf) -> DataFrame:
    """Links (a, b) between parts of the same bucket, decided on full sets.

    A member outside the bucket's main part needs no more than one link to it, so a
    semi-join finds whether it has any and (member, main part) is returned; members
    outside are compared with each other. Blocks bound both sides of a comparison.
    """
    rows = shelf.put(_differences(live, texts, words_each, shelf).join(marks.select("id", "planes"), "id"), "differences")
    rows = shelf.put(_blocked(rows).withColumn("w", ((100 - percent) * F.col("n") - (100 + percent) * F.col("d")).cast("long")), "blocks")
    columns = ["id", "part", "n", "w", "diff", "planes"]
    gain = 2 * (100 + percent)
    bound = F.col("w1") + F.col("w2") + gain * F.least(F.size("diff1"), F.size("diff2")) >= 0
    exact = F.col("w1") + F.col("w2") + gain * F.size(F.array_intersect("diff1", "diff2")) >= 0
    fits = (F.col("part1") != F.col("part2")) & bound & _plausible(F.col("n1"), F.col("n2"), F.col("planes1"), F.col("planes2"), percent) & exact
    main, rest = rows.where("is_main"), rows.where("not is_main")
    on = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("key", "i", "j")]
    left = _side(rest, "1", "i", "mains", columns, ["main"]).alias("l")
    joined = left.join(_side(main, "2", "j", "others", columns).alias("r"), [*on, fits], "left_semi").select(F.col("main").alias("a"), F.col("id1").alias("b"))
    left = _side(rest, "1", "i", "others", columns).alias("l")
    across = left.join(_side(rest, "2", "j", "others", columns).alias("r"), [*on, F.col("id1") < F.col("id2"), fits]).select(F.col("id1").alias("a"), F.col("id2").alias("b"))
    return shelf.put(joined.unionByName(across).distinct(), "bridges")


def near_duplicates(docs: DataFrame, percent: int = 80, words_each: int = 5) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked if 100 * |intersection| >= percent * |union| of their
    shingle sets; a component's id is its least doc_id, whose document is kept.
    32 bands of four minima miss a pair at 0.8 with a chance of 5e-8.

    Null and empty texts have an empty set and no link. Rows that share a doc_id
    count as one document with the links of all of them, and each row is
    returned. Rows without a doc_id link nothing, have a null component and are
    kept. Other columns are ignored; an empty table gives no rows. Copies cost
    one class however many there are. The result reads the stored signatures,
    classes and components; all other stored tables are deleted.
    """
    shelf = Shelf()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    signed = stored(rows.mapInArrow(tidy(_signatures(words_each)), "doc_id long, n_shingles long, print_a long, print_b long, bands array<long>, planes array<long>"), "signatures")
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    classes = usable.groupBy("print_a", "print_b").agg(
        F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("planes").alias("planes")
    )
    classes = stored(classes, "classes")
    marks = classes.select("id", "n", "planes")
    banded = classes.select(F.explode("bands").alias("key"), "id")
    keys = banded.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high")
    placed = banded.join(keys.select("key", "rows"), "key")
    weights = placed.groupBy("id").agg(F.sum("rows").alias("weight"))
    placed = shelf.put(placed.join(weights, "id").select("key", "weight", "id", F.col("id").alias("part")), "members")
    texts = rows.select(F.col("doc_id").alias("id"), "text")
    links = None
    for turn in range(ROUNDS):
        pairs = _likely(_stars(placed, turn), marks, percent)
        found = _confirmed(texts, pairs, percent, words_each, shelf)
        links = found if links is None else links.unionByName(found)
        parts = components(links).withColumnRenamed("node", "id")
        members = placed.drop("part").join(parts, "id", "left").select("key", "weight", "id", F.coalesce("component", "id").alias("part"))
        open_ = members.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("key")
        placed = shelf.put(members.join(open_, "key", "left_semi"), "members")
    live = _live(placed, marks, percent, shelf)
    all_links = links.unionByName(_bridges(live, marks, texts, percent, words_each, shelf))

    # Rows that share an id carry it through their classes, so ids join classes as well.
    owned = usable.join(classes.select("print_a", "print_b", "id"), ["print_a", "print_b"]).where("doc_id <> id").select(F.col("doc_id").alias("b"), F.col("id").alias("a")).distinct()
    repeated = owned.groupBy("b").agg(F.min("a").alias("low"), F.max("a").alias("high")).where("low <> high").select(F.col("low").alias("a"), "b")
    tied = owned.join(repeated.select("b"), "b", "left_semi").select("a", "b")
    parts = components(all_links.unionByName(tied))
    shelf.clear()
    named = signed.join(classes.select("print_a", "print_b", F.col("id").alias("class_id")), ["print_a", "print_b"], "left")
    named = named.join(parts.withColumnRenamed("node", "class_id"), "class_id", "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.coalesce("component", "class_id", "doc_id"))
    return named.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_near_duplicates(docs: DataFrame, percent: int = 80, words_each: int = 5) -> DataFrame:
    """The rows of ``docs`` whose document is kept; the ids that go are broadcast if
    they are few and joined by shuffle otherwise. Rows without a doc_id stay."""
    found = near_duplicates(docs, percent, words_each)
    gone = stored(found.where("not kept").select("doc_id").distinct(), "gone")
    few = gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti").select(*whole(docs))
