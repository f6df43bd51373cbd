"""Exact duplicates by deterministic block naming.

A text without white space is cut into fixed-size blocks.  Equal blocks are sorted together and
get one integer name; then adjacent names are paired and pairs get names in the same way, until
every document has a single name.  Names stand for contents one to one, so equal names of
documents of equal length are equal texts: nothing rests on a hash being free of collisions.

Naming goes in two steps so that nothing gathers.  A task first names the blocks of a few
megabytes of text by itself, so a block that fills a third of the corpus leaves each such chunk
once; only these first occurrences, each with its count, are sorted by content to find the common
name.  A document with a block (or pair) that occurs nowhere else is alone and is done at once;
only the others, few in most corpora, go on to the next level.  Every level is a written table.

Defined cases: a null or empty text, or one of white space only, is one empty block; of equal
texts the row with most code points in the original stays, then the least doc_id, then the row
read first; a null doc_id counts as the largest; repeated rows are members like any other; very
long texts take a level more for each doubling; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopledger.llm.shared import discard, workspace, written

BLOCK = 1024
#: Bytes of text whose blocks a task names by itself at a time.
CHUNK_BYTES = 16_000_000
#: Tasks that the rows of one name spread over in a join.
SALTS = 16

_SPACE = b" \t\n\v\f\r"


def _locally_named(docs: DataFrame, block: int) -> DataFrame:
    """One row for each document, with local block names and the blocks that its chunk met first."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"row long, doc_id {kind}, n_chars long, text_sha256 string, names array<long>, "
              "blocks array<struct<name: long, times: long, content: binary>>")

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 40
        row, given = task, task
        for batch in batches:
            for part in _parts(batch):
                ids, texts = part.column(0), part.column(1).to_pylist()
                out, local, times, first = [], {}, [], []
                for k, text in enumerate(texts):
                    bare = (text or "").encode("utf-8", "surrogatepass").translate(None, _SPACE)
                    names = []
                    for a in range(0, len(bare) or 1, block):
                        content = bare[a : a + block]
                        n = local.setdefault(content, len(local))
                        if n == len(times):
                            times.append(0)
                            first.append((k, content))
                        times[n] += 1
                        names.append(given + n)
                    out.append((row, len(text or ""), hashlib.sha256(bare).hexdigest(), names))
                    row += 1
                blocks: list[list] = [[] for _ in texts]
                for n, (k, content) in enumerate(first):
                    blocks[k].append({"name": given + n, "times": times[n], "content": content})
                given += len(local)
                rows, chars, shas, names = (list(c) for c in zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows, pa.int64()), ids, pa.array(chars, pa.int64()), pa.array(shas, pa.string()),
                     pa.array(names, pa.list_(pa.int64())),
                     pa.array(blocks, pa.list_(pa.struct([("name", pa.int64()), ("times", pa.int64()),
                                                          ("content", pa.binary())])))],
                    names=["row", "doc_id", "n_chars", "text_sha256", "names", "blocks"])

    return docs.select("doc_id", "text").mapInArrow(name, schema)


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about CHUNK_BYTES of text."""
    sizes = pc.binary_length(batch.column(1)).fill_null(0).to_pylist()
    start, held = 0, 0
    for k, size in enumerate(sizes):
        if held and held + size > CHUNK_BYTES:
            yield batch.slice(start, k - start)
            start, held = k, 0
        held += size
    if start < len(sizes):
        yield batch.slice(start)


def _same_blocks(local: DataFrame) -> DataFrame:
    """(local, name) for the blocks that occur more than once: one name for each content."""
    found = local.select(F.explode("blocks").alias("b")).select("b.name", "b.times", "b.content")
    same = "OVER (PARTITION BY content)"
    named = found.select(F.col("name").alias("local"), F.expr(f"min(name) {same}").alias("name"),
                         F.expr(f"sum(times) {same}").alias("times"))
    return named.where("times > 1").select("local", "name")


def _gather(named: DataFrame) -> DataFrame:
    """(row, size, names) of documents of which every name is there: of (row, size, expected, at, name) rows."""
    rows = named.groupBy("row", "size", "expected").agg(F.sort_array(F.collect_list(F.struct("at", "name"))).alias("all"))
    return rows.where(F.size("all") == F.col("expected")).select("row", "size", F.col("all.name").alias("names"))


def _spread(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Join where one key may hold much of the left side: its rows go to SALTS tasks."""
    salted = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("salt", F.pmod(F.col("row"), F.lit(SALTS)).cast("int")).join(
        salted, [*keys, "salt"]).drop("salt")


def _next_level(level: DataFrame, path: str) -> DataFrame:
    """The same for adjacent names: documents with a pair of their own are done and left out."""
    pairs = F.expr("transform(sequence(0, size(names) - 1, 2), "
                   "i -> struct(names[i] AS a, coalesce(get(names, i + 1), -1L) AS b))")
    apart = level.select("row", "size", F.size(pairs).alias("expected"), F.posexplode(pairs).alias("at", "p"))
    paired = written(apart.select("row", "size", "expected", "at", "p.a", "p.b").withColumn(
        "own", F.monotonically_increasing_id()), path)
    names = paired.groupBy("a", "b").agg(F.min("own").alias("name"), F.count(F.lit(1)).alias("times"))
    return _gather(_spread(paired, names.where("times > 1").select("a", "b", "name"), ["a", "b"]))


def duplicate_groups(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, n_chars), one row for each document."""
    spark = docs.sparkSession
    folder = workspace(spark, "naming")
    local = written(_locally_named(docs, block), f"{folder}/local")
    own = local.select("row", F.size("names").alias("size"), F.posexplode("names").alias("at", "local")).select(
        "row", "size", F.col("size").alias("expected"), "at", "local")
    level = written(_gather(own.join(_same_blocks(local), "local")), f"{folder}/0")
    done, depth = [level.where("size(names) = 1")], 0
    longest = level.agg(F.max(F.size("names"))).first()[0] or 1
    while longest > 1:
        depth += 1
        level = written(_next_level(level.where("size(names) > 1"), f"{folder}/{depth}-pairs"), f"{folder}/{depth}")
        discard(spark, f"{folder}/{depth}-pairs")
        done.append(level.where("size(names) = 1"))
        longest = level.agg(F.max(F.size("names"))).first()[0] or 1
    finished = done[0]
    for more in done[1:]:
        finished = finished.union(more)
    about = local.select("row", "doc_id", "n_chars", "text_sha256")
    members = about.join(finished.select("row", "size", F.col("names")[0].alias("name")), "row")
    order = F.struct(-F.col("n_chars"), F.col("doc_id").isNull(), "doc_id", "row")
    groups = members.groupBy("size", "name").agg(
        F.min_by(F.struct("doc_id", "row"), order).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    shared = written(_spread(members.select("row", "size", "name"), groups.where("group_size > 1"), ["size", "name"])
                     .select("row", "keep", "group_size"), f"{folder}/shared")
    return about.join(shared, "row", "left").select(
        "doc_id", F.when(F.col("keep").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep.row") == F.col("row"), F.lit(True)).alias("kept"), "text_sha256", "n_chars")
