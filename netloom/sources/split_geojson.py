"""One large GeoJSON file read by many tasks.

The text is cut behind every ``}`` by Spark's splittable line reader, so a block
of a file, of ``spark.sql.files.maxPartitionBytes``, is a task. A block doesn't
know whether it begins inside a string, nor how deep; so a first pass reads each
block under both assumptions about the string and gives the change of depth.
These summaries, one row a block, are put in order file by file, which tells
every block where it begins. The second pass takes the features out: what stands
in braces directly inside the array ``features`` of the root. A feature that
goes over the end of a block comes as fragments and is put together by its number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.lineage import cut

FEATURE_JSON = "type string, geometry struct<type:string,coordinates:string>, properties string"
BATCH_BYTES = 8 << 20
#: Strings and brackets of JSON, and the rest of a string that began before.
TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|"|[{\[\]]', re.DOTALL)
STRING_END = re.compile(r'(?:[^"\\]|\\.)*?"', re.DOTALL)
ARRAY_KEY = re.compile(r'("(?:[^"\\]|\\.)*")\s*:\s*$', re.DOTALL)


@dataclass
class Place:
    """Where a reader stands: inside a string or not, open braces and brackets, and the key of the last array opened at each depth."""

    string: bool = False
    braces: int = 0
    brackets: int = 0
    keys: dict[tuple[int, int], str] = field(default_factory=dict)

    def piece(self, text: str) -> Iterator[tuple[str, int]]:
        """Read on over ``text`` and the ``}`` behind it; gives (token, its position) of the brackets outside strings, before they count."""
        at = 0
        if self.string:
            end = STRING_END.match(text)
            if end is None:
                return
            self.string, at = False, end.end()
        while (m := TOKEN.search(text, at)) is not None:
            token, at = m.group(), m.end()
            if token == '"':
                self.string = True
                return
            if token[0] == '"':
                continue
            yield token, m.start()
            if token == "{":
                self.braces += 1
            elif token == "[":
                named = ARRAY_KEY.search(text[max(0, m.start() - 200) : m.start()])
                self.keys[self.braces, self.brackets] = named.group(1) if named else ""
                self.brackets += 1
            else:
                self.brackets -= 1
        yield "}", len(text)
        self.braces -= 1


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """value, file, block: the text between closing braces, in order within a block."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.option("lineSep", "}").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"))


def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], list[str]]]:
    """Runs of pieces of one block."""
    for batch in batches:
        values, files, blocks = (batch.column(i).to_pylist() for i in range(3))
        start = 0
        for i in range(1, len(values) + 1):
            if i == len(values) or (files[i], blocks[i]) != (files[start], blocks[start]):
                yield (files[start], blocks[start]), values[start:i]
                start = i


SUMMARY = "file string, block long, inside boolean, string boolean, braces int, brackets int, keys string"


def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each block does to a reader that comes to it outside or inside a string."""
    now, two = None, []

    def rows():
        names = [f.split(" ")[0] for f in SUMMARY.split(", ")]
        out = [(*now, inside, p.string, p.braces, p.brackets, "\x1f".join(f"{a},{b},{k}" for (a, b), k in p.keys.items())) for inside, p in zip((False, True), two, strict=True)]
        types = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.int32(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    for where, values in by_block(batches):
        if where != now:
            if now:
                yield rows()
            now, two = where, [Place(), Place(string=True)]
        for p in two:
            for value in values:
                for _ in p.piece(value):
                    pass
    if now:
        yield rows()


def starts(blocks: pd.DataFrame) -> pd.DataFrame:
    """The place of a reader at the start of each block of one file."""
    found = {(r.block, r.inside): r for r in blocks.itertuples()}
    place, out = Place(), []
    for block in sorted(set(blocks.block)):
        root = place.keys.get((1, 0), "") if place.brackets else ""
        out.append((blocks.file.iloc[0], block, place.string, place.braces, place.brackets, root))
        r = found[block, place.string]
        for entry in filter(None, r.keys.split("\x1f")):
            a, b, key = entry.split(",", 2)
            place.keys[place.braces + int(a), place.brackets + int(b)] = key
        place.string, place.braces, place.brackets = bool(r.string), place.braces + int(r.braces), place.brackets + int(r.brackets)
    return pd.DataFrame(out, columns=["file", "block", "string", "braces", "brackets", "root"])


def read_large_geojson(spark: SparkSession, path: str) -> DataFrame:
    """feature_index (from 0 in each file), type, geometry, properties and file of the features of FeatureCollections, whatever the size of
    a file and however it is laid out; a feature alone must fit a row. INVALID_COLLECTION_TYPE where the root isn't one."""
    text = pieces(spark, path)
    summary = text.select("value", "file", "block").mapInArrow(summaries, SUMMARY)
    begun = summary.groupBy("file").applyInPandas(starts, "file string, block long, string boolean, braces int, brackets int, root string")
    known = {(r.file, r.block): (r.string, r.braces, r.brackets, r.root) for r in begun.collect()}  # one small row a block of input

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, place, part, number, out = None, Place(), [], -1, []

        def flush():
            rows, out[:] = list(zip(*out, strict=True)) if out else [[]] * 5, []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string()), strict=True)], names=["file", "block", "number", "whole", "text"])

        def emit(whole: bool):
            out.append((*now, number, whole, "".join(part)))
            part.clear()

        for where, values in by_block(batches):
            if where != now:
                if part:
                    emit(False)
                now, number = where, -1
                string, braces, brackets, root = known[where]
                place = Place(string, braces, brackets, {(1, 0): root})
                inside = braces >= 2 and root == '"features"'
                started = False
            for value in values:
                begin = 0 if inside else None
                ended, header = False, []
                for token, at in place.piece(value):
                    in_array = place.brackets == 1 and place.keys.get((1, 0)) == '"features"'
                    if token == "{" and place.braces == 1 and in_array:
                        inside, begin, started = True, at, True
                        number += 1
                    elif token == "}" and place.braces == 2 and inside:
                        ended = True
                    elif token in "[}" and place.braces == 1 and place.brackets == 0:
                        header.append(value[:at])
                if inside:
                    part.append(value[begin:] + "}")
                if ended:
                    emit(started)
                    inside = started = False
                out += [(*now, None, True, h) for h in header if '"' in h]
            yield flush()
        if part:
            emit(False)
            yield flush()

    raw = cut(text.select("value", "file", "block").mapInArrow(take, "file string, block long, number int, whole boolean, text string"))
    header = F.col("number").isNull() & F.col("text").rlike(r'"type"\s*:\s*"FeatureCollection"')
    wrong = text.select("file").distinct().join(raw.where(header).select("file").distinct(), "file", "left_anti")
    if wrong.take(1):
        raise ValueError("INVALID_COLLECTION_TYPE")
    found = raw.where("number IS NOT NULL")
    counts = found.groupBy("file", "block").agg((F.max("number") + 1).alias("n"))  # one row a block
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")).select("file", "block", "before")
    numbered = found.join(before, ["file", "block"]).select("file", (F.col("before") + F.col("number")).alias("feature_index"), "block", "whole", "text")
    broken = numbered.where("NOT whole").groupBy("file", "feature_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda p: p["text"]), "").alias("text"))
    every = numbered.where("whole").select("file", "feature_index", "text").unionByName(broken)
    return every.select(F.col("feature_index").cast("long").alias("feature_index"), F.from_json("text", FEATURE_JSON).alias("f"), "file").select("feature_index", "f.*", "file")
