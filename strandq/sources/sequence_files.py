"""Sequence and record files as DataFrames, read and written through Spark's own sources."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import intervals, sequences
from .shared import materialise


def _qualities(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c) - 33)


def read_fasta(spark: SparkSession, path: str, stream: bool = False, files: int = 1000) -> DataFrame:
    """ident, flags, bases: records begin with > at the start of a line; all white space within bases is dropped.

    A record is what Spark's text source finds between two such places, so that files are split; a file begins with a record.
    With `stream` the folder's files are a stream, of at most `files` new ones a batch."""
    source = spark.readStream.option("maxFilesPerTrigger", files) if stream else spark.read
    raw = source.text(path, lineSep="\n>").filter(F.trim("value") != "")
    body = F.regexp_replace("value", "^>", "")
    head = F.regexp_replace(F.substring_index(body, "\n", 1), "\r", "")
    bases = F.when(F.instr(body, "\n") > 0, F.regexp_replace(body.substr(F.instr(body, "\n") + 1, F.length(body)), r"\s", "")).otherwise("")
    return raw.select(T.ident(head).alias("ident"), T.flags(head).alias("flags"), bases.alias("bases"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """value, and where it comes from: file, start of the split, and a number that grows within the split."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))


def _whole_records(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Records of four lines that lie within a split, and (records of one line) the lines before the first and behind the last.

    A split's first record begins at the first @ line that a + line follows after one other; at 0 it begins at once."""
    at, held, number, begun = None, [], 0, False

    def rows(lines, part):
        nonlocal number
        n = len(lines) if part != 1 else len(lines) // 4
        table = np.array(lines, object).reshape(n, -1)
        out = pd.DataFrame({"file": at[0], "split": at[1], "part": part, "i": np.arange(number, number + n)} | {f"l{k}": table[:, k] if k < table.shape[1] else None for k in range(4)})
        number += n
        return out

    def settle(last):
        nonlocal held, begun
        if not begun:
            starts = [0] if at[1] == 0 else [k for k in range(len(held) - 2) if held[k].startswith("@") and held[k + 2].startswith("+")]
            if starts:
                if starts[0]:
                    yield rows(held[: starts[0]], 0)
                held, begun = held[starts[0] :], True
        if begun and len(held) >= 4:
            n = len(held) // 4 * 4
            yield rows(held[:n], 1)
            held = held[n:]
        if last and held:
            yield rows(held, 2 if begun else 0)
            held = []

    for part in parts:
        for key, some in part.groupby(["file", "split"], sort=False):
            if key != at:
                if at is not None:
                    yield from settle(True)
                at, held, number, begun = key, [], 0, False
            held += some["value"].tolist()
            yield from settle(False)
    if at is not None:
        yield from settle(True)


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """ident, flags, bases, quals (array), error: records of four lines; a record whose first or third line isn't an @ or a +
    has error 1.

    Files are split.  The few lines at the ends of splits are put together per file; what lies between goes no way.  If a
    split holds no record at all, its lines are such ends."""
    names = [f"l{k}" for k in range(4)]
    parts = _lines(spark, path).mapInPandas(_whole_records, "file string, split long, part int, i long, l0 string, l1 string, l2 string, l3 string")
    ends = parts.filter("part <> 1").withColumn("nth", F.row_number().over(Window.partitionBy("file").orderBy("split", "part", "i")) - 1)
    joined = ends.groupBy("file", F.expr("nth div 4").alias("r")).agg(*(F.max(F.when(F.col("nth") % 4 == k, F.col("l0"))).alias(n) for k, n in enumerate(names)))
    rec = parts.filter("part = 1").select(*names).unionByName(joined.select(*names)).select(*(F.regexp_replace(n, r"\r$", "").alias(n) for n in names)).filter("l0 <> '' or l1 is not null")
    head = F.regexp_replace("l0", "^@", "")
    good = F.col("l0").startswith("@") & F.coalesce(F.col("l2").startswith("+"), F.lit(False))
    return rec.select(T.ident(head).alias("ident"), T.flags(head).alias("flags"), F.when(good, F.col("l1")).otherwise("").alias("bases"),
                      F.when(good, _qualities(F.coalesce("l3", F.lit("")))).otherwise(F.array().cast("array<int>")).alias("quals"), F.when(good, 0).otherwise(1).alias("error"))


def _mixed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The records of sorted lines of whole files: ident line, bases, qualities, error."""
    at, kind, head, lines, skipped, out = None, "", "", [], False, []

    def record():
        nonlocal kind, lines, skipped
        if kind == ">":
            out.append((head, "".join("".join(lines).split()), "", 2 * skipped))
        elif kind == "@":
            good = len(lines) > 1 and lines[1].startswith("+")
            out.append((head, lines[0] if good else "", lines[2] if good and len(lines) > 2 else "", (not good) + 2 * skipped))
        if kind:
            skipped = False
        kind, lines = "", []

    for part in parts:
        for file, value in zip(part["file"], part["value"], strict=True):
            value = value.rstrip("\r")
            if file != at:
                record()
                at, skipped = file, False
            if kind == "@" and len(lines) < 3 and (len(lines) != 1 or value.startswith("+")):
                lines.append(value)
                if len(lines) == 3:
                    record()
            elif value[:1] in (">", "@"):
                record()
                kind, head = value[0], value[1:]
            elif kind == ">":
                lines.append(value)
            else:
                record()
                skipped = skipped or bool(value.strip())
        yield pd.DataFrame(out, columns=["head", "bases", "q", "error"])
        out = []
    record()
    yield pd.DataFrame(out, columns=["head", "bases", "q", "error"])


def read_mixed(spark: SparkSession, path: str) -> DataFrame:
    """ident, flags, bases, quals, error of files in which records with > and with @ may stand side by side.

    error 1: a record without its + line, which has no bases; 2: lines before it belonged to no record.  From the middle of
    such a file it can't be told what a line is, so a file is read by one task, line by line."""
    lines = _lines(spark, path).withColumn("i", F.monotonically_increasing_id())
    rec = lines.repartition("file").sortWithinPartitions("file", "split", "i").mapInPandas(_mixed, "head string, bases string, q string, error int")
    return rec.select(T.ident(F.col("head")).alias("ident"), T.flags(F.col("head")).alias("flags"), "bases", _qualities(F.col("q")).alias("quals"), "error")


def sniff(spark: SparkSession, path: str) -> str:
    """fasta, fastq or sam, by the first three lines: a > line; an @ line that a tab or another @ line makes a header; a + line."""
    first = [r[0] for r in spark.read.text(path).limit(3).collect()]
    lead = first[0] if first else ""
    if lead.startswith(">"):
        return "fasta"
    if lead.startswith("@"):
        if "\t" in lead[:1000] or (len(first) > 1 and first[1].startswith("@")):
            return "sam"
        if len(first) > 2 and first[2].startswith("+"):
            return "fastq"
    raise ValueError(f"{path} isn't a sequence file")


def open_sequences(spark: SparkSession, path: str) -> DataFrame:
    """ident, bases, quals of a file of any of the three kinds; FASTA has no qualities."""
    kind = sniff(spark, path)
    if kind == "sam":
        return sam_reads(read_sam(spark, path)).select("ident", "bases", _qualities(F.col("qual")).alias("quals"))
    if kind == "fastq":
        return read_fastq(spark, path).select("ident", "bases", "quals")
    return read_fasta(spark, path).select("ident", "bases", F.array().cast("array<int>").alias("quals"))


def numbered(reads: DataFrame) -> DataFrame:
    """reads with seq_idx, gapless from 0 in their order; partitions are counted, and their offsets (a row each) broadcast."""
    rows = materialise(reads.withColumns({"part_": F.spark_partition_id(), "nth_": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = rows.groupBy("part_").agg(F.count("*").alias("n")).select("part_", before.alias("before_"))
    return rows.join(F.broadcast(offsets), "part_").withColumn("seq_idx", F.col("before_") + F.col("nth_")).drop("part_", "nth_", "before_")


def sequence_table(reads: DataFrame, most: int = 1 << 16, of: str = "bases") -> DataFrame:
    """ident, chunk, length, piece of reads (ident, bases): what regions are fetched from; one row per `most` bases.  `of` may name
    a text of qualities instead."""
    length = F.length(of)
    own = reads.select("ident", length.alias("length"), F.posexplode_outer(sequences.pieces(F.col(of), most)).alias("chunk", "piece"))
    return own.select("ident", F.coalesce("chunk", F.lit(0)).alias("chunk"), "length", F.coalesce("piece", F.lit("")).alias("piece"))


def fetch(table: DataFrame, regions: DataFrame, most: int = 1 << 16) -> DataFrame:
    """region, bases of texts 'name', 'name:beg' or 'name:beg-end' in regions (region) from a sequence_table with the same `most`.

    Ends beyond a sequence are clipped, and what lies beyond gives no bases; unknown names give null.  Only the pieces that
    a region touches are joined."""
    r = intervals.parse_region(F.col("region"))
    asked = regions.select("region").distinct().select("region", r["name"].alias("ident"), r["beg"].alias("beg"), r["end"].alias("stop"))
    sizes = table.filter("chunk = 0").select("ident", "length")
    own = asked.join(sizes, "ident", "left").withColumns({"beg": F.least("beg", "length"), "stop": F.least(F.coalesce("stop", "length"), "length")})
    need = F.sequence(F.expr(f"beg div {most}"), F.greatest(F.expr(f"beg div {most}"), F.expr(f"(stop - 1) div {most}")))
    wanted = own.filter("length is not null").withColumn("chunk", F.explode(need))
    cut = F.col("piece").substr(F.greatest(F.col("beg") - F.col("chunk") * most, F.lit(0)).cast("int") + 1, F.greatest(F.least(F.col("stop") - F.col("chunk") * most, F.lit(most)) - F.greatest(F.col("beg") - F.col("chunk") * most, F.lit(0)), F.lit(0)).cast("int"))
    got = wanted.join(table.select("ident", F.col("chunk").cast("long").alias("chunk"), "piece"), ["ident", "chunk"]).select("region", F.struct("chunk", cut.alias("part")).alias("x"))
    whole = got.groupBy("region").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["part"]), "").alias("bases"))
    return own.join(whole, "region", "left").select("region", F.when(F.col("length").isNotNull(), F.coalesce("bases", F.lit(""))).alias("bases"))


def fasta_text(reads: DataFrame, width: int = 0) -> DataFrame:
    """One text per record of reads (ident, bases), wrapped at width; write it with write.text."""
    bases = F.col("bases") if not width else F.regexp_replace("bases", f"(.{{{width}}})(?=.)", "$1\n")
    return reads.select(F.concat(F.lit(">"), "ident", F.lit("\n"), bases).alias("value"))


def fastq_text(reads: DataFrame, constant: int | None = None) -> DataFrame:
    """Of reads (ident, bases, quals), with one quality for all bases if a constant is given."""
    q = F.array_join(F.transform("quals", lambda x: F.char(x + 33)), "") if constant is None else F.repeat(F.lit(chr(33 + constant)), F.length("bases"))
    return reads.select(F.concat_ws("\n", F.concat(F.lit("@"), "ident"), "bases", F.lit("+"), q).alias("value"))


def write_lines(lines: DataFrame, path: str, compression: str = "none") -> None:
    """Write the one text column of lines, compressed by one of Spark's codecs."""
    lines.write.text(path, compression=compression)


def sam_text(sam: DataFrame) -> DataFrame:
    """Of the eleven columns and tags of read_sam; tags are written in the order of their names, with the types of the map kinds
    where it has them, else as texts (Z)."""
    fields = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]
    kind = lambda k: F.coalesce(F.try_element_at("kinds", k), F.lit("Z")) if "kinds" in sam.columns else F.lit("Z")
    tags = F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat_ws(":", e["key"], kind(e["key"]), e["value"]))
    return sam.select(F.concat_ws("\t", *(F.col(c).cast("string") for c in fields), tags).alias("value"))


def bed_text(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat_ws("\t", "chrom", "bgn", "end_").alias("value"))


def vcf_text(rows: DataFrame) -> DataFrame:
    """Of the columns of read_vcf; missing values are dots, and INFO keys stand in the order of their names."""
    info = F.array_join(F.transform(F.array_sort(F.map_entries("info")), lambda e: F.when(F.size(e["value"]) > 0, F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))).otherwise(e["key"])), ";")
    dot = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("."))
    number = F.regexp_replace(F.col("qual").cast("string"), r"\.0$", "")
    return rows.select(F.concat_ws("\t", "chrom", "pos", dot(F.col("id")), "ref", dot(F.array_join("alt", ",")), dot(number), dot(F.array_join("filters", ";")), dot(info)).alias("value"))


#: Where tables of regions hold name, begin and end (counted from 1; 0: none), whether begins count from 0, and what marks a comment.
REGION_COLUMNS = {"gff": (1, 4, 5, False, "#"), "bed": (1, 2, 3, True, "#"), "psl": (15, 17, 18, True, "#"), "sam": (3, 4, 0, False, "@"), "vcf": (1, 2, 0, False, "#")}


def read_regions(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """chrom, bgn (from 0), end_, fields of tab-separated tables of a kind of REGION_COLUMNS; without an end, records of a
    CIGAR or a reference allele end with it.  Lines that begin with a comment mark are left out."""
    name, begin, end, zero, mark = REGION_COLUMNS[kind]
    f = F.split("value", "\t")
    bgn = f[begin - 1].cast("long") - (0 if zero else 1)
    size = {"sam": sequences.totals(sequences.cigar(f[5]), {"n": "MDN=X"})["n"], "vcf": F.length(f[3])}.get(kind)
    rows = spark.read.text(path).filter(~F.col("value").startswith(mark) & (F.col("value") != ""))
    return rows.select(f[name - 1].alias("chrom"), bgn.alias("bgn"), (f[end - 1].cast("long") if end else bgn + size).alias("end_"), f.alias("fields"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """The eleven columns of alignment text records, their tags as a map to texts, and kinds, a map to the letters of their types
    (A, i, f, Z, H or B)."""
    part = F.split("value", "\t")
    names = [("qname", "string"), ("flag", "int"), ("rname", "string"), ("pos", "long"), ("mapq", "int"), ("cigar", "string"), ("rnext", "string"), ("pnext", "long"), ("tlen", "long"), ("seq", "string"), ("qual", "string")]
    of = lambda value: F.map_from_entries(F.transform(F.slice(part, 12, 1 << 20), lambda t: F.struct(F.substring(t, 1, 2), value(t))))
    tags, kinds = of(lambda t: t.substr(F.lit(6), F.length(t))), of(lambda t: F.substring(t, 4, 1))
    return spark.read.text(path).filter(~F.col("value").startswith("@")).select(*(part[i].try_cast(t).alias(n) for i, (n, t) in enumerate(names)), tags.alias("tags"), kinds.alias("kinds"))


def sam_reads(sam: DataFrame) -> DataFrame:
    """Primary records as sequences; those on the reverse strand are turned back."""
    from ..functions import bases as B

    back = F.col("flag").bitwiseAND(16) != 0
    return sam.filter(F.col("flag").bitwiseAND(0x900) == 0).select(F.col("qname").alias("ident"), F.when(back, B.complement_reversed(F.col("seq"))).otherwise(F.col("seq")).alias("bases"), F.when(back, F.reverse("qual")).otherwise(F.col("qual")).alias("qual"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    part = F.split("value", "\t")
    return spark.read.text(path).filter("value not like '#%' and value not like 'track%' and value <> ''").select(part[0].alias("chrom"), part[1].cast("long").alias("bgn"), part[2].cast("long").alias("end_"))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """chrom, pos, id, ref, alt (array), qual, filters (array), info (map) of variant text records."""
    p = F.split("value", "\t")
    info = F.map_from_entries(F.transform(F.filter(F.split(p[7], ";"), lambda x: ~x.isin(".", "")), lambda x: F.struct(F.substring_index(x, "=", 1), F.when(x.contains("="), F.split(F.regexp_replace(x, "^[^=]*=", ""), ",")).otherwise(F.array().cast("array<string>")))))
    return spark.read.text(path).filter("value not like '#%'").select(p[0].alias("chrom"), p[1].cast("long").alias("pos"), p[2].alias("id"), p[3].alias("ref"), F.split(p[4], ",").alias("alt"), p[5].try_cast("double").alias("qual"), F.split(p[6], ";").alias("filters"), info.alias("info"))


def read_vcf_calls(spark: SparkSession, path: str, samples: list[str] | None = None) -> DataFrame:
    """chrom, pos, ref, alt (array), sample, call of variant text records: a row per record and sample, with the map of what its
    FORMAT names to texts.

    Samples are named by each file's own header, or all alike by `samples`.  Values that a call leaves out at its end are
    null, and so are those of a missing call; records without FORMAT have no rows, and neither do columns without a
    name.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    p = F.split("value", "\t")
    rows = lines.filter("value not like '#%' and value <> ''")
    if samples is None:
        rows = rows.join(lines.filter("value like '#CHROM\t%'").select("file", F.slice(p, 10, 1 << 20).alias("names")), "file")
    else:
        rows = rows.withColumn("names", F.array(*map(F.lit, samples)))
    each = rows.filter(F.size(p) > 9).select(p[0].alias("chrom"), p[1].cast("long").alias("pos"), p[3].alias("ref"), F.split(p[4], ",").alias("alt"), F.split(p[8], ":").alias("keys"), F.explode(F.arrays_zip(F.col("names").alias("sample"), F.slice(p, 10, 1 << 20).alias("text"))).alias("x"))
    each = each.filter("x.sample is not null").select("chrom", "pos", "ref", "alt", "keys", "x.sample", F.split("x.text", ":").alias("values"))
    call = F.map_from_entries(F.transform("keys", lambda k, i: F.struct(k, F.get("values", i))))
    return each.select("chrom", "pos", "ref", "alt", "sample", call.alias("call"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(T.chomp(F.col("value")).alias("line"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, size, md5 of each file."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.md5("content").alias("md5"))


def read_xz_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line of files packed by xz, which Spark's text source can't read; a file is one row, and unpacked as a stream."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io
        import lzma

        for batch in rows:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lines = lzma.open(io.BytesIO(content), "rt", encoding="utf-8", errors="replace", newline="\n")
                while held := [x.rstrip("\n") for x in islice(lines, 10_000)]:
                    yield pa.record_batch({"path": pa.array([name] * len(held)), "line": pa.array(held)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, line string")


def file_states(spark: SparkSession, path: str) -> DataFrame:
    """path, size, modified of each file that isn't empty: what a table made from them is kept with."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def changed(saved: DataFrame, now: DataFrame) -> DataFrame:
    """path, state ('new', 'gone' or 'changed') of the files whose file_states differ; no row if what was made from them still holds."""
    both = saved.select("path", F.struct("size", "modified").alias("a")).join(now.select("path", F.struct("size", "modified").alias("b")), "path", "full")
    state = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "gone").when(F.col("a") != F.col("b"), "changed")
    return both.select("path", state.alias("state")).filter("state is not null")
