"""Filter interaction audit: what each filter of a chain removes, in every order of the chain.

Four filters look at one text; the fifth, E, fails a document whose text a smaller
doc_id has as well, anywhere in the table. E's equality is decided on full texts:

* a task keeps, for the texts it has met, chains of (text, least id) by fingerprint,
  and lets go of every document that turns out not to be the least of its text; a
  chain's table is bounded in bytes and handed on when it is full;
* what is left, one row per text and task, is dealt out by xxhash; there chains of
  all tasks meet, so a text that a third of all documents share costs a task as many
  rows as there were tasks, not documents;
* every document leaves as its id with the mask of filters it fails; labels join by
  id, without texts, and ``combineByKey`` adds up counts by part and mask.

Orders of filters are then read off the 32 masks of a part.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from strandmill.llm.common import named, ship_library

FILTERS = "ABCDE"
REPEATED = 1 << FILTERS.index("E")
ORDERS = tuple("".join(order) for order in itertools.permutations(FILTERS))
#: Bytes of texts that a task's chains hold before they are handed on.
HELD_BYTES = 32 << 20
#: Bytes of texts that one partition of the second step is meant for.
PARTITION_BYTES = 64 << 20
_UPPER = bytes(range(65, 91))
_SIGNS = b"#$%&*|"


def text_mask(text: bytes) -> int:
    """Bits of the filters A to D that a UTF-8 text fails; an empty text fails A alone.

    Bytes that are no UTF-8 count as U+FFFD each, as Python replaces them.
    """
    try:
        points = len(text.decode())
    except UnicodeDecodeError:
        points = len(text.decode("utf-8", "replace"))
    words = text.split()
    upper = len(text) - len(text.translate(None, _UPPER))
    fails = (
        len(words) < 100,
        100 * len(set(words)) < 80 * len(words),
        100 * upper > 10 * points,
        len(text.translate(None, _SIGNS)) < len(text),
    )
    return sum(1 << i for i, failed in enumerate(fails) if failed)


class Chains:
    """Texts met so far, chained by fingerprint, each with its least id and that id's documents.

    ``add`` returns the documents that are certain not to be the least of their text.
    Documents are (part, mask) pairs with a count: rows that repeat an id and agree in
    both are one entry, so an id repeated without end takes no room.
    """

    def __init__(self) -> None:
        self.by_print: dict[int, list[list]] = {}
        self.held = 0

    def add(self, print_: int, text: bytes, doc_id: int, documents: dict) -> list[tuple[int, dict]]:
        chain = self.by_print.setdefault(print_, [])
        for entry in chain:
            if entry[0] == text:
                break
        else:
            chain.append([text, doc_id, dict(documents)])
            self.held += len(text) + 200
            return []
        if doc_id > entry[1]:
            return [(doc_id, documents)]
        if doc_id == entry[1]:
            for key, n in documents.items():
                entry[2][key] = entry[2].get(key, 0) + n
            return []
        out = (entry[1], entry[2])
        entry[1:] = [doc_id, dict(documents)]
        return [out]

    def drain(self) -> Iterator[tuple[int, tuple[bytes, int, dict]]]:
        for print_, chain in self.by_print.items():
            for entry in chain:
                yield print_, tuple(entry)
        self.by_print, self.held = {}, 0


def fingerprint(text: bytes) -> int:
    return xxhash.xxh3_64_intdigest(text)


def _near(rows: Iterator) -> Iterator[tuple[int, tuple]]:
    """First step, before the shuffle: (place, (text, doc_id, documents)).

    Documents whose fifth filter is settled go on without a text, dealt out in turn;
    the least ones of this task's texts go to the place of their fingerprint.
    """
    chains, turn = Chains(), itertools.count()
    for doc_id, part, text in rows:
        text = bytes(text)
        mask = text_mask(text)
        if doc_id is None:
            yield next(turn), (None, None, {(part, mask): 1})
            continue
        for other, documents in chains.add(fingerprint(text), text, doc_id, {(part, mask): 1}):
            yield next(turn), (None, other, _repeated(documents))
        if chains.held > HELD_BYTES:
            yield from chains.drain()
    yield from chains.drain()


def _far(rows: Iterator[tuple[int, tuple]]) -> Iterator[tuple]:
    """Second step: chains of all tasks meet. (doc_id, part, mask, count) with E settled."""
    chains = Chains()
    for place, (text, doc_id, documents) in rows:
        if text is None:
            yield from _rows(doc_id, documents)
        else:
            for other, repeats in chains.add(place, text, doc_id, documents):
                yield from _rows(other, _repeated(repeats))
    for _, (_, doc_id, documents) in chains.drain():
        yield from _rows(doc_id, documents)


def _repeated(documents: dict) -> dict:
    return {(part, mask | REPEATED): n for (part, mask), n in documents.items()}


def _rows(doc_id: int | None, documents: dict) -> Iterator[tuple]:
    for (part, mask), n in documents.items():
        yield doc_id, part, mask, n


def document_masks(docs: DataFrame, part: str = "lang") -> DataFrame:
    """doc_id, part, mask and count: documents by the filters they fail, E among them.

    ``docs`` needs doc_id and text; other columns, whatever their names, play no part.
    Null texts are empty ones and equal to each other. A null part is the empty string.
    Of equal texts all rows with the least id pass E, repeated rows of it too, as no
    smaller id has their text. A null doc_id is neither smaller nor larger than any
    other and passes E. Rows of one id that agree in part and mask are one row with a
    count. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship_library(spark)
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(named(part).cast("string"), F.lit("")).alias("part"), body.alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + F.lit(100))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(size // PARTITION_BYTES) + 1)
    schema = StructType([StructField("doc_id", LongType()), StructField("part", StringType()), StructField("mask", IntegerType()), StructField("count", LongType())])
    settled = rows.rdd.mapPartitions(_near).partitionBy(n, int).mapPartitions(_far)
    return spark.createDataFrame(settled, schema, verifySchema=False)


def audit_orders(masks: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Counts for every part, order of filters and step, from ``document_masks``.

    ``labels`` has doc_id, quality and toxic: a document counts as good or toxic where
    any row of its id says 1; null ids and null marks say nothing.
    """
    spark = masks.sparkSession
    if labels is None:
        marked = masks.withColumns({"good": F.lit(0), "toxic": F.lit(0)})
    else:
        said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        said = said.agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
        marked = masks.join(said, "doc_id", "left").na.fill(0, ["good", "toxic"])
    summed = marked.groupBy("part", "mask", "good", "toxic").agg(F.sum("count").alias("n")).rdd.map(lambda r: (r["part"], (r["mask"], r["n"], r["good"], r["toxic"])))
    vectors = summed.combineByKey(lambda row: _counted([0] * 96, row), _counted, lambda a, b: [x + y for x, y in zip(a, b, strict=True)])
    kinds = [("part", StringType()), ("filter_order", StringType()), ("step", IntegerType()), *[(name, LongType()) for name in COUNTS]]
    return spark.createDataFrame(vectors.flatMap(lambda found: _steps(*found)), StructType([StructField(*kind) for kind in kinds]), verifySchema=False)


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _counted(vector: list[int], row: tuple[int, int, int, int]) -> list[int]:
    """Adds documents to a part's counts: by mask all, then good, then toxic ones."""
    mask, n, good, toxic = row
    vector[mask] += n
    vector[32 + mask] += n * good
    vector[64 + mask] += n * toxic
    return vector


def _steps(part: str, vector: list[int]) -> list[tuple]:
    """All orders and steps of one part."""
    of_all, of_good, of_toxic = vector[:32], vector[32:64], vector[64:]
    rows, removed_by = [], dict.fromkeys(FILTERS, 0)
    for order in ORDERS:
        gone = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            here = [m for m in range(32) if m & bit and not m & gone]
            removed = sum(of_all[m] for m in here)
            redundant = sum(of_all[m] for m in range(32) if m & bit and m & gone)
            gone |= bit
            kept = sum(of_all[m] for m in range(32) if not m & gone)
            rows.append((part, order, step, kept, removed, redundant, of_all[bit], sum(of_good[m] for m in here), sum(of_toxic[m] for m in here)))
            removed_by[letter] += removed
    return [(*row, removed_by[row[1][row[2] - 1]]) for row in rows]


def filter_audit(docs: DataFrame, labels: DataFrame | None = None, part: str = "lang") -> DataFrame:
    """The audit of the filters A to E over ``docs``: 600 rows for each value of ``part``.

    A: fewer than 100 words; B: under 80 % of words distinct; C: over 10 % of code points
    in A-Z; D: one of ``#$%&*|``; E: a smaller id has the same text.
    """
    return audit_orders(document_masks(docs, part), labels)


def audit_sql() -> str:
    """DuckDB SQL for ``filter_audit`` over documents and labels, by plain definition."""
    orders = ", ".join(f"('{order}')" for order in ORDERS)
    return f"""
with worded as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words
  from documents),
failing as (
  select doc_id, part,
    len(words) < 100 as "A",
    100 * len(list_distinct(words)) < 80 * len(words) as "B",
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) as "C",
    regexp_matches(text, '[#$%&*|]') as "D",
    coalesce(doc_id > min(doc_id) over (partition by text), false) as "E"
  from worded),
said as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
counted as (
  select part, "A", "B", "C", "D", "E", count(*) as n, count(*) filter (good = 1) as good, count(*) filter (toxic = 1) as toxic
  from failing left join said using (doc_id) group by all),
failed as (
  select part, map {{'A': "A", 'B': "B", 'C': "C", 'D': "D", 'E': "E"}} as fails,
    "A"::int + "B"::int + "C"::int + "D"::int + "E"::int as failures, n, good, toxic from counted),
steps as (
  select filter_order, step, substr(filter_order, step, 1) as letter, substr(filter_order, 1, step - 1) as earlier
  from (values {orders}) as o(filter_order), (select unnest(range(1, 6)) as step)),
crossed as (
  select part, filter_order, step, letter, n, good, toxic, failures, fails[letter] as fails_it,
    len(list_filter(string_split(earlier, ''), lambda x: x <> '' and fails[x])) > 0 as gone
  from failed, steps),
stepped as (
  select part, filter_order, step, letter,
    sum(n) filter (not gone and not fails_it) as kept, sum(n) filter (not gone and fails_it) as removed,
    sum(n) filter (gone and fails_it) as redundant, sum(n) filter (fails_it and failures = 1) as unique_fails,
    sum(good) filter (not gone and fails_it) as good_lost, sum(toxic) filter (not gone and fails_it) as toxic_lost
  from crossed group by all)
select part, filter_order, step::int as step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed,
  coalesce(redundant, 0)::bigint as redundant, coalesce(unique_fails, 0)::bigint as unique_fails,
  coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost,
  sum(coalesce(removed, 0)) over (partition by part, letter)::bigint as shapley
from stepped"""
