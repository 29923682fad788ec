"""Readers and writers of the file formats: tab-separated splits, histories, ontology CSVs, line files, XML, embeddings, status."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from truthframe.operators.interactions import column_ranges, group_interactions
from truthframe.session import ship

INTERACTIONS = "uid int, iid int, label int, time long"
ONTOLOGY = "file_name string, consistency string, tokenized_length int, body string, injected_pattern string"
STATUS = "file_name string, status string, cluster string, injected_axiom string, consistent string, tokens string, error_message string, timestamp timestamp"


def read_split(spark: SparkSession, path: str, schema: str | StructType = INTERACTIONS) -> DataFrame:
    """A tab-separated file with a header, in a declared schema."""
    return spark.read.schema(schema).csv(path, sep="\t", header=True)


def read_splits(spark: SparkSession, base: str, names: Sequence[str] = ("train", "validation", "test"), schema: str | StructType = INTERACTIONS) -> dict[str, DataFrame]:
    """``base.<name>.csv`` for each name that is there."""
    out = {}
    for n in names:
        path = f"{base}.{n}.csv"
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            out[n] = read_split(spark, path, schema)
    return out


def label_counts(splits: dict[str, DataFrame], label: str = "label") -> DataFrame:
    """``(split, label, n)``."""
    out = None
    for name, df in splits.items():
        one = df.groupBy(label).agg(F.count("*").alias("n")).select(F.lit(name).alias("split"), label, "n")
        out = one if out is None else out.union(one)
    return out


def write_column_info(path: str, *frames: DataFrame) -> dict:
    """Every numeric column's largest and smallest value as two lines of JSON at a local path."""
    rows = column_ranges(*frames).collect()  # a row a column
    most, least = ({r["column"]: r[c] for r in rows} for c in ("highest", "lowest"))
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(most, sort_keys=True) + "\n" + json.dumps(least, sort_keys=True) + "\n")
    return {"max": most, "min": least}


def write_history(df: DataFrame, path: str, positives: bool = True, order: Sequence[str] = ("time",)) -> None:
    """``uid <tab> comma-joined items`` of the positive (or the other) interactions."""
    rows = df.filter(F.col("label") > 0 if positives else F.col("label") <= 0)
    lists = group_interactions(rows, order).select("uid", F.array_join(F.transform("iids", lambda x: x.cast("string")), ",").alias("iids"))
    lists.write.mode("overwrite").csv(path, sep="\t", header=True)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("uid int, iids string").csv(path, sep="\t", header=True)
    return rows.select("uid", F.transform(F.split("iids", ","), lambda x: x.cast("int")).alias("iids"))


def read_ontologies(spark: SparkSession, path: str) -> DataFrame:
    """An ontology CSV; bodies may hold line ends and quotes. Empty fields are null; a null label reads as consistent, a null pattern stays null."""
    rows = spark.read.schema(ONTOLOGY).csv(path, header=True, multiLine=True, quote='"', escape='"')
    return rows.fillna("Consistent", ["consistency"])


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return df


def write_splits(df: DataFrame, base: str, split: str = "split") -> DataFrame:
    """One CSV folder for each split, and the summary that ``split_summary`` gives."""
    for name in [r[0] for r in df.select(split).distinct().collect()]:  # names of splits
        rows = df.filter(F.col(split) == name).drop(split)
        rows.write.mode("overwrite").csv(f"{base}/{name}", header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return split_summary(df, split)


def split_summary(df: DataFrame, split: str = "split") -> DataFrame:
    """``(split, consistency, rows, most_tokens)``, nulls counted as a label of their own."""
    return df.groupBy(split, "consistency").agg(F.count("*").alias("rows"), F.max("tokenized_length").alias("most_tokens"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file_name, line_no, line)`` of text files; a file is read whole, so that lines keep their order."""
    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file_name"), "value")
    return files.select("file_name", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))


def write_triples(triples: DataFrame, path: str) -> None:
    """One JSON line for each file, with its triples in order."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "s", "p", "o")))
    lists = triples.groupBy("file_name").agg(F.transform(rows, lambda t: F.array(t["s"], t["p"], t["o"])).alias("triples"))
    lists.write.mode("overwrite").json(path)


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("file_name string, triples array<array<string>>").json(path)
    return rows.select("file_name", F.posexplode("triples").alias("pos", "t")).select("file_name", "pos", *(F.col("t")[i].alias(c) for i, c in enumerate("spo")))


_RDF = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"


def _triples_of(text: bytes) -> Iterator[tuple[str, str, str]]:
    blank = 0

    def walk(node: ET.Element) -> Iterator[tuple]:
        nonlocal blank
        subject = node.get(f"{_RDF}about") or node.get(f"{_RDF}ID") or node.get(f"{_RDF}nodeID")
        if subject is None:
            blank += 1
            subject = f"_:b{blank}"
        if node.tag != f"{_RDF}Description":
            yield subject, "type", node.tag.replace("{", "").replace("}", "")
        for key, value in node.attrib.items():
            if not key.startswith(_RDF):
                yield subject, key.replace("{", "").replace("}", ""), value
        for prop in node:
            name = prop.tag.replace("{", "").replace("}", "")
            target = prop.get(f"{_RDF}resource") or prop.get(f"{_RDF}nodeID")
            if target is not None:
                yield subject, name, target
            elif len(prop):
                for child in prop:
                    inner = list(walk(child))
                    here = child.get(f"{_RDF}about") or child.get(f"{_RDF}ID") or child.get(f"{_RDF}nodeID") or (inner[0][0] if inner else f"_:b{blank}")
                    yield subject, name, here
                    yield from inner
            else:
                yield subject, name, (prop.text or "").strip()

    root = ET.fromstring(text)
    for node in root if root.tag == f"{_RDF}RDF" else [root]:
        yield from walk(node)


def read_rdf_xml(spark: SparkSession, path: str) -> DataFrame:
    """``(file_name, pos, s, p, o)`` of RDF/XML files, each parsed in one task; a broken file has a single row with its error in ``o`` and nulls elsewhere."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for name, content in zip(files["path"], files["content"]):
                try:
                    rows = [(name.rsplit("/", 1)[-1], i, *t) for i, t in enumerate(_triples_of(bytes(content)))]
                except ET.ParseError as e:
                    rows = [(name.rsplit("/", 1)[-1], None, None, None, str(e))]
                yield pd.DataFrame(rows, columns=["file_name", "pos", "s", "p", "o"])

    ship(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file_name string, pos int, s string, p string, o string")


def manifest(candidates: DataFrame, done: DataFrame, key: str = "file_name", limit: int | None = None) -> DataFrame:
    """What is still to do: candidates that have no output yet, nulls left out; ``limit`` takes the first by name."""
    rest = candidates.filter(F.col(key).isNotNull()).select(key).distinct().join(done.select(key), key, "left_anti")
    return rest.orderBy(key).limit(limit) if limit is not None else rest


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in the given order: an upsert of rows as they came. Cut to one row a key on the map side."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    best = F.max(F.struct(*order, *rest)).alias("x")
    return rows.groupBy(*keys).agg(best).select(*keys, "x.*").select(*rows.columns)


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str], replace: bool = True) -> DataFrame:
    """``table`` with ``rows`` that replace (or, without ``replace``, yield to) rows of the same key."""
    if replace:
        return table.join(rows.select(*keys), list(keys), "left_anti").select(*table.columns).unionByName(rows)
    return table.unionByName(rows.join(table.select(*keys), list(keys), "left_anti").select(*rows.columns))


def join_embeddings(rows: DataFrame, vectors: DataFrame, key: str = "file_name") -> DataFrame:
    """Rows with their ``embedding``: by the name without its ending, else by that without its first ``_`` part; the others drop out."""
    stem = F.regexp_replace(key, r"\.[^./]*$", "")
    bare = F.regexp_replace(stem, r"^[^_]*_", "")
    v = vectors.select(F.col("stem"), F.col("embedding"))
    both = rows.withColumns({"s__": stem, "b__": bare}).join(v.toDF("s__", "e1"), "s__", "left").join(v.toDF("b__", "e2"), "b__", "left")
    return both.withColumn("embedding", F.coalesce("e1", "e2")).filter("embedding is not null").drop("s__", "b__", "e1", "e2")


def write_embeddings(vectors: DataFrame, path: str, key: str = "stem") -> DataFrame:
    """Adds the vectors ``(stem, embedding)`` whose key isn't stored yet, and returns all that are stored then."""
    spark = vectors.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fresh = vectors.select(key, F.col("embedding").cast("array<float>").alias("embedding")).dropDuplicates([key])
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        fresh = fresh.join(spark.read.parquet(path).select(key), key, "left_anti")
    fresh.write.mode("append").parquet(path)
    return spark.read.parquet(path)
