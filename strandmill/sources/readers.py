"""Readers: delimited tables, sequences, annotations, sites, lists, trees, documents.

Tables and sequences are scanned by Spark; small files that shape a plan (rules,
maps, trees, configurations) are read on the driver through Spark's file layer,
so they may lie in any store.
"""

from __future__ import annotations

import bz2
import gzip
import json
import lzma
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Names of id columns by precedence, and delimiters: fixed values.
ID_COLUMNS = ("id", "strain", "name")
DELIMITERS = (",", "\t")
#: Column for the text of rows that do not fit their header.
BROKEN = "_sm_broken"


def file_bytes(spark: SparkSession, path: str) -> bytes:
    """A small file's content, unpacked by its magic bytes (gzip, bzip2, xz, zstd)."""
    data = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    if data[:2] == b"\x1f\x8b":
        return gzip.decompress(data)
    if data[:3] == b"BZh":
        return bz2.decompress(data)
    if data[:6] == b"\xfd7zXZ\x00":
        return lzma.decompress(data)
    if data[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    return data


def file_text(spark: SparkSession, path: str) -> str:
    """A small file's text with universal newlines."""
    return file_bytes(spark, path).decode("utf-8-sig").replace("\r\n", "\n").replace("\r", "\n")


def sniff_delimiter(first_line: str, allowed: tuple[str, ...] = DELIMITERS) -> str:
    """The allowed delimiter that occurs most in a header line."""
    best = max(allowed, key=first_line.count)
    if best not in first_line:
        if len(first_line.split()) <= 1:
            return best
        raise ValueError(f"no delimiter of {allowed!r} in the first line")
    return best


def id_column(columns: list[str], candidates: tuple[str, ...] = ID_COLUMNS) -> str:
    """The first candidate that is a column."""
    found = next((c for c in candidates if c in columns), None)
    if found is None:
        raise ValueError(f"no id column of {candidates} among {columns}")
    return found


def read_metadata(spark: SparkSession, path: str, delimiters: tuple[str, ...] = DELIMITERS, columns: list[str] | None = None, id_columns: tuple[str, ...] = ID_COLUMNS, strict: bool = True) -> tuple[DataFrame, str]:
    """(all-string table with '' for blanks, id column). Columns that are asked for but
    missing are dropped with a warning. A row with another number of cells than the header
    fails the job when ``strict``, whichever columns are used, and is named by its text."""
    header = spark.read.text(path).first()
    separator = sniff_delimiter(header[0] if header else "", delimiters)
    options = {"sep": separator, "header": True, "mode": "PERMISSIVE", "quote": '"', "escape": '"'}
    df = spark.read.csv(path, inferSchema=False, **options)
    if strict and df.columns:
        schema = df.schema.add(BROKEN, "string")
        # Cells are counted only where all columns are parsed.
        df = spark.read.option("columnPruning", False).csv(path, schema=schema, columnNameOfCorruptRecord=BROKEN, **options)
        message = F.concat(F.lit(f"a row has no {len(schema) - 1} cells: "), F.substring(BROKEN, 1, 200), F.lit(", it begins with "), F.coalesce(F.col(f"`{schema[0].name}`"), F.lit("nothing")))
        df = df.where(F.when(F.col(BROKEN).isNull(), True).otherwise(F.raise_error(message).cast("boolean"))).drop(BROKEN)
    df = df.fillna("")
    key = id_column(df.columns, id_columns)
    if columns is not None:
        for name in [c for c in columns if c not in df.columns]:
            print(f"WARNING: column {name!r} does not exist")
        df = df.select(*dict.fromkeys([key, *[c for c in columns if c in df.columns]]))
    return df, key


def read_ndjson(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def read_fasta(spark: SparkSession, *paths: str) -> DataFrame:
    """(id, description, sequence), one row per record; lines of a sequence are joined."""
    parts = [spark.read.text(path, lineSep="\n>") for path in paths]
    rows = reduce(DataFrame.unionAll, parts)
    record = F.regexp_replace(F.regexp_replace("value", "\r", ""), "^(?:;[^\n]*\n)*>?", "")
    head = F.regexp_extract(record, "^([^\n]*)", 1)
    body = F.regexp_replace(F.regexp_replace(record, "^[^\n]*\n?", ""), r"\s", "")
    return rows.where(F.trim("value") != "").select(F.regexp_extract(head, r"^(\S*)", 1).alias("id"), head.alias("description"), body.alias("sequence"))


def genbank_sequences(spark: SparkSession, *paths: str) -> DataFrame:
    """(id, description, sequence) of GenBank flat files, one row per record.

    The id is the record's VERSION, else its first ACCESSION, else its LOCUS name. Records
    are split where a line begins with //, so one file is read by several tasks.
    """
    rows = reduce(DataFrame.unionAll, [spark.read.text(path, lineSep="\n//") for path in paths])
    record = F.regexp_replace("value", "\r", "")
    field = lambda name, form: F.regexp_extract(record, rf"(?m)^{name}\s+{form}", 1)
    names = [F.nullif(field(name, r"(\S+)"), F.lit("")) for name in ("VERSION", "ACCESSION", "LOCUS")]
    said = F.regexp_replace(F.regexp_extract(record, r"(?m)^DEFINITION\s+([^\n]*(?:\n\s+[^\n]*)*)", 1), r"\s+", " ")
    letters = F.upper(F.regexp_replace(F.regexp_extract(record, r"(?s)\nORIGIN[^\n]*\n(.*)$", 1), r"[\s0-9]", ""))
    return rows.where(record.rlike(r"(?m)^LOCUS\s")).select(F.coalesce(*names).alias("id"), said.alias("description"), letters.alias("sequence"))


def read_sequences(spark: SparkSession, *paths: str, kind: str = "fasta", repeats: str | None = None) -> DataFrame:
    """(id, description, sequence) of ``fasta`` or ``genbank`` files.

    ``repeats`` says what an id that comes twice does: ``error`` fails the job,
    ``same`` keeps one row if the sequences agree and fails else, None keeps all rows.
    """
    found = {"fasta": read_fasta, "genbank": genbank_sequences}[kind](spark, *paths)
    if repeats is None:
        return found
    text = F.struct("description", "sequence")
    grouped = found.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min(text).alias("one"), F.min(F.md5("sequence")).alias("low"), F.max(F.md5("sequence")).alias("high"))
    wrong = F.col("n") > 1 if repeats == "error" else F.col("low") != F.col("high")
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("sequence id is repeated: "), F.col("id")))).otherwise(F.col("id"))
    return grouped.select(checked.alias("id"), "one.description", "one.sequence")


def numbered(rows: DataFrame, column: str = "row") -> DataFrame:
    """Rows of a file scan with their number in the order of files (by path) and lines, from 0.

    ``rows`` is a scan as the readers return it, not yet filtered. Rows keep their order
    inside the block of a file that a task reads; one aggregate counts the rows of each
    block, and running sums over blocks, not rows, give every block its first number.
    """
    place = rows.withColumns({"_sm_file": F.col("_metadata.file_path"), "_sm_block": F.col("_metadata.file_block_start"), "_sm_at": F.monotonically_increasing_id()})
    blocks = place.groupBy("_sm_file", "_sm_block").agg(F.min("_sm_at").alias("_sm_first"), F.count(F.lit(1)).alias("_sm_n"))
    inside = W.partitionBy("_sm_file").orderBy("_sm_block").rowsBetween(W.unboundedPreceding, -1)
    files = blocks.groupBy("_sm_file").agg(F.sum("_sm_n").alias("_sm_all"))
    # One row per file.
    ahead = files.select("_sm_file", F.coalesce(F.sum("_sm_all").over(W.orderBy("_sm_file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_sm_ahead"))
    starts = blocks.withColumn("_sm_before", F.coalesce(F.sum("_sm_n").over(inside), F.lit(0))).join(ahead, "_sm_file")
    number = F.col("_sm_ahead") + F.col("_sm_before") + F.col("_sm_at") - F.col("_sm_first")
    return place.join(starts, ["_sm_file", "_sm_block"]).select(*rows.columns, number.alias(column))


def single_sequence(sequences: DataFrame) -> tuple[str, str]:
    """(id, sequence) of a set that must hold one record."""
    found = sequences.limit(2).collect()
    if len(found) != 1:
        raise ValueError("expected exactly one sequence")
    return found[0]["id"], found[0]["sequence"]


def sequence_ids(sequences: DataFrame) -> DataFrame:
    """Ids of a sequence set; raises if one repeats."""
    repeated = sequences.groupBy("id").count().where("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"sequence id {repeated[0][0]!r} is repeated")
    return sequences.select("id")


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """Long calls (sample, chrom, pos (0-based), ref, alt) of samples that differ from the
    reference; a genotype's first allele decides, ``.`` is the reference."""
    lines = spark.read.text(path)
    header = lines.where("value like '#CHROM%'").first()
    if header is None:
        raise ValueError("no header line")
    samples = header[0].rstrip("\n").split("\t")[9:]
    cells = lines.where("value not like '#%'").select(F.split("value", "\t").alias("c"))
    names = F.array(*[F.lit(s) for s in samples])
    calls = cells.select(F.col("c")[0].alias("chrom"), (F.col("c")[1].cast("int") - 1).alias("pos"), F.col("c")[3].alias("ref"), F.split(F.col("c")[4], ",").alias("alts"), F.explode(F.arrays_zip(names.alias("s"), F.slice("c", 10, len(samples)).alias("g"))).alias("call"))
    allele = F.regexp_extract("call.g", r"^(\d+|\.)", 1)
    return calls.select(F.col("call.s").alias("sample"), "chrom", "pos", "ref", F.try_element_at("alts", allele.try_cast("int")).alias("alt")).where(~allele.isin("0", ".", "")).where("alt is not null")


def read_bed_sites(spark: SparkSession, path: str) -> DataFrame:
    """(site), 0-based: the half-open ranges of a BED file of one chromosome."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*$|^(browser|track|#)"))
    cells = lines.select(F.split("value", r"\s+").alias("c")).where(F.try_element_at("c", F.lit(2)).rlike(r"^\d+$"))
    if cells.select(F.col("c")[0]).distinct().limit(2).count() > 1:
        raise ValueError("several chromosomes in one BED file")
    start, end = F.col("c")[1].cast("int"), F.col("c")[2].cast("int")
    return cells.where(end > start).select(F.explode(F.sequence(start, end - 1)).alias("site")).distinct()


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """(site), 0-based, from 1-based numbers: one per line, or the second column."""
    cells = F.split(F.trim("value"), "\t")
    number = F.coalesce(F.try_element_at(cells, F.lit(2)), F.element_at(cells, 1)).try_cast("int")
    return spark.read.text(path).select((number - 1).alias("site")).where("site is not null").distinct()


def read_id_list(spark: SparkSession, *paths: str) -> DataFrame:
    """(id): one per line, comments and blanks left out."""
    rows = reduce(DataFrame.unionAll, [spark.read.text(p) for p in paths])
    return rows.select(F.trim(F.element_at(F.split("value", "#"), 1)).alias("id")).where("id <> ''").distinct()


def read_priorities(spark: SparkSession, path: str) -> DataFrame:
    """(id, priority) by tab or blanks."""
    cells = F.split(F.trim("value"), r"\t|\s+(?=\S+$)")
    return spark.read.text(path).where(F.trim("value") != "").select(F.element_at(cells, 1).alias("id"), F.element_at(cells, -1).cast("double").alias("priority"))


def read_weights(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """(table, weighted columns); weights must be numbers of at least 0."""
    df = spark.read.csv(path, sep="\t", header=True, comment="#").fillna("")
    bad = df.where(~F.col("weight").rlike(r"^\d+(\.\d+)?$")).limit(1).collect()
    if bad:
        raise ValueError(f"weight {bad[0]['weight']!r} is no number of at least 0")
    return df.withColumn("weight", F.col("weight").cast("double")), [c for c in df.columns if c != "weight"]


def read_gff(spark: SparkSession, path: str, types: tuple[str, ...] = ("gene", "source", "region")) -> DataFrame:
    """(seqid, type, start (0-based), end, strand, attributes map) of the wanted features."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    c = F.split("value", "\t")
    rows = lines.select(c[0].alias("seqid"), c[2].alias("type"), (c[3].cast("int") - 1).alias("start"), c[4].cast("int").alias("end"), F.when(c[6] == "-", -1).otherwise(1).alias("strand"), F.expr("str_to_map(split(value, '\t')[8], ';', '=')").alias("attributes"))
    rows = rows.where(F.col("type").isin(*types))
    if rows.select("seqid").distinct().limit(2).count() > 1:
        raise ValueError("several sequence ids in one annotation")
    return rows.withColumn("name", F.coalesce(*[F.try_element_at("attributes", F.lit(k)) for k in ("gene", "gene_name", "locus_tag", "Name", "ID")]))


def gff_extent(spark: SparkSession, path: str) -> tuple[int, int]:
    """(start (0-based), end) of the whole sequence, by the sequence-region directive and by
    source and region features; those that there are must agree, and one must be there."""
    lines = spark.read.text(path)
    cells = F.split("value", r"\s+")
    said = lines.where(F.col("value").startswith("##sequence-region")).select(F.element_at(cells, -2).cast("int").alias("low"), F.element_at(cells, -1).cast("int").alias("high"))
    whole = read_gff(spark, path, ("source", "region")).select((F.col("start") + 1).alias("low"), F.col("end").alias("high"))
    found = said.unionAll(whole).distinct().orderBy("low", "high").limit(2).collect()
    if len(found) != 1:
        raise ValueError("extents of the whole sequence disagree" if found else "nothing says how long the sequence is")
    return found[0]["low"] - 1, found[0]["high"]


def feature_errors(features: DataFrame) -> DataFrame:
    """Features other than the whole sequence whose length is no multiple of three."""
    return features.where(~F.col("type").isin("source", "region") & ((F.col("end") - F.col("start")) % 3 != 0))


def read_genbank(text: str) -> list[dict]:
    """Coding features of a GenBank record, and ``nuc`` from its source feature."""
    features, current, last = [], None, None
    for line in text.split("FEATURES", 1)[-1].split("ORIGIN", 1)[0].splitlines()[1:]:
        if line[:5] == "     " and line[5:6].strip():
            kind, place = line.split(None, 1)
            current, last = {"type": kind, "place": place.strip(), "qualifiers": {}}, None
            features.append(current)
        elif current is not None:
            body = line.strip()
            match = re.match(r'/(\w+)=?"?(.*?)"?$', body)
            if match:
                last = match[1]
                current["qualifiers"][last] = match[2]
            elif last:
                current["qualifiers"][last] += body.rstrip('"')
            else:
                current["place"] += body
    out = []
    for f in features:
        parts = [(int(a) - 1, int(b)) for a, b in re.findall(r"<?(\d+)\.\.>?(\d+)", f["place"])]
        strand = -1 if f["place"].startswith("complement") else 1
        name = f["qualifiers"].get("locus_tag") or f["qualifiers"].get("gene")
        if f["type"] == "source":
            if not parts or parts[0][0] != 0:
                raise ValueError("the source feature must start at 1")
            out.append({"name": "nuc", "parts": parts, "strand": 1})
        elif f["type"] == "CDS" and name:
            out.append({"name": name, "parts": parts, "strand": strand})
    if not any(f["name"] == "nuc" for f in out):
        raise ValueError("no source feature")
    return out


def read_distance_map(spark: SparkSession, path: str):
    from strandmill.operators.distance import DistanceMap

    return DistanceMap.from_json(json.loads(file_text(spark, path)))


def read_clade_definitions(spark: SparkSession, path: str) -> DataFrame:
    """(clade, gene, pos, alt) with inherited alleles; TSV, or CSV by extension."""
    from strandmill.operators.clades import inherited_definitions

    separator = "," if path.endswith(".csv") else "\t"
    lines = [line.split("#")[0].rstrip() for line in file_text(spark, path).splitlines()]
    cells = [[c.strip() for c in line.split(separator)] for line in lines if line.strip()]
    at = {name: i for i, name in enumerate(cells[0])}
    rows = [(r[at["clade"]], r[at["gene"]], r[at["site"]] if r[at["gene"]] == "clade" else int(r[at["site"]]), r[at["alt"]] if len(r) > at["alt"] else "") for r in cells[1:]]
    return spark.createDataFrame(inherited_definitions(rows), "clade string, gene string, pos int, alt string")


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(gene, pos, alt, display_name, feature); a missing gene is ``nuc``."""
    df = spark.read.csv(path, sep="\t", header=True).fillna("")
    upper = {c.upper(): c for c in df.columns}
    gene = F.when(F.col(upper["GENE"]) == "", "nuc").otherwise(F.col(upper["GENE"])) if "GENE" in upper else F.lit("nuc")
    site, alt = F.col(upper["SITE"]).cast("int"), F.col(upper["ALT"])
    shown = F.col(upper["DISPLAY_NAME"]) if "DISPLAY_NAME" in upper else F.concat(site.cast("string"), alt)
    return df.select(gene.alias("gene"), site.alias("pos"), alt.alias("alt"), shown.alias("display_name"), F.col(upper["FEATURE"]).alias("feature"))


def read_location_rules(spark: SparkSession, path: str, case_sensitive: bool = False):
    """Rules ``a/b/c/d<TAB>a/b/c/d``; comments and malformed lines are skipped, the last
    of equal patterns counts."""
    from strandmill.operators.curate import LocationRules

    rules = {}
    for line in file_text(spark, path).splitlines():
        cells = line.split("#")[0].rstrip().split("\t")
        if len(cells) < 2:
            continue
        pattern, target = (tuple(p.strip() for p in c.split("/")) for c in cells[:2])
        if len(pattern) == len(target) == 4:
            rules[pattern] = target
    return LocationRules(rules, case_sensitive)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(id, field, value, line) of three-column annotations without trailing comments."""
    lines = [(i, line.rstrip("\n").split("\t")) for i, line in enumerate(file_text(spark, path).splitlines()) if line.strip() and not line.startswith("#")]
    rows = [(c[0], c[1], c[2].split("#")[0].rstrip(), i) for i, c in lines if len(c) >= 3]
    return spark.createDataFrame(rows, "id string, field string, value string, line int")


def read_colors(*texts: str) -> dict[str, dict[str, str]]:
    """Colours by trait and lower-case value from three-column texts; later ones override."""
    out: dict[str, dict[str, str]] = {}
    for text in texts:
        for line in text.splitlines():
            cells = line.split("\t")
            if len(cells) >= 3 and not line.startswith("#"):
                out.setdefault(cells[0].lower(), {})[cells[1].lower()] = cells[2].strip()
    return out


def read_places(*texts: str) -> dict[tuple[str, str], tuple[float, float]]:
    """Coordinates by (resolution, lower-case value) from four-column texts."""
    out = {}
    for text in texts:
        for line in text.splitlines():
            cells = line.split("\t")
            if len(cells) >= 4 and not line.startswith("#"):
                out[cells[0].lower(), cells[1].lower()] = (float(cells[2]), float(cells[3]))
    return out


def read_titer_table(spark: SparkSession, path: str, excluded_sources: list[str] = ()) -> DataFrame:
    from strandmill.operators.titers import read_titers

    return read_titers(spark.read.csv(path, sep="\t", header=False).select("_c0", "_c1", "_c2", "_c3", "_c4"), excluded_sources)


def read_collection(spark: SparkSession, path: str, strain: str = "strain", value: str = "value") -> DataFrame:
    """Measurements with columns strain and value (a number) first."""
    df = spark.read.csv(path, sep="\t", header=True)
    bad = df.where(F.col(value).isNotNull() & F.col(value).try_cast("double").isNull()).limit(1).collect()
    if bad:
        raise ValueError(f"value {bad[0][value]!r} is no number")
    return df.select(F.col(strain).alias("strain"), F.col(value).cast("double").alias("value"), *[c for c in df.columns if c not in (strain, value)])


def read_config(spark: SparkSession, *paths: str, section: str | None = None) -> dict:
    """A YAML or JSON document, later files merged over earlier ones; dates stay text."""
    import yaml

    class Plain(yaml.SafeLoader):
        pass

    Plain.yaml_implicit_resolvers = {k: [r for r in v if r[0] != "tag:yaml.org,2002:timestamp"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}
    merged: dict = {}
    for path in paths:
        merged = merged_config(merged, yaml.load(file_text(spark, path), Plain) or {})
    return merged[section] if section else merged


def merged_config(base: dict, over: dict) -> dict:
    """Dictionaries merge by key; lists of entries with a ``key`` merge by it, others append."""
    out = dict(base)
    for name, value in over.items():
        old = out.get(name)
        if isinstance(old, dict) and isinstance(value, dict):
            out[name] = merged_config(old, value)
        elif isinstance(old, list) and isinstance(value, list):
            if all(isinstance(v, dict) and "key" in v for v in [*old, *value]):
                by_key = {v["key"]: v for v in old}
                out[name] = list((by_key | {v["key"]: merged_config(by_key.get(v["key"], {}), v) for v in value}).values())
            else:
                out[name] = old + [v for v in value if v not in old]
        else:
            out[name] = value
    return out
