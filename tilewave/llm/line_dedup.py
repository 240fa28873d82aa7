"""Line dedup over levelled sorted runs of line hashes.

A run is a table of (h1, h2, first): the 128-bit hash of a line's key and the smallest doc_id that
holds it, bucketed and sorted by hash, in the shared folder. Batches come in rising order of doc_id.
Each batch's keys are merge-anti-joined with the runs, which are bucketed alike and so aren't dealt
out again; what is left is new and becomes a run of level 0. A level that has `fanout` runs is
compacted into one run of the next. Runs share no key, so a key's first document is in one run only.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of at least
`min_chars` code points that more than one document holds keep their lines in the first document only.

Edge cases: a null or empty text is one empty line. A null doc_id counts as one document after all
others. Rows that repeat a doc_id are one document: all its rows keep or lose a key's lines together.
Lines repeated inside the first document stay. An empty table gives an empty table. Extra columns,
whatever their names, pass through dedup_lines untouched.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewave.llm.common import OWN, drop_path, n_partitions, new_path

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for a null doc_id: after all others.
LAST = (1 << 63) - 1
HASH = ["h1", "h2"]


def ascii_lower(text: Column) -> Column:
    # lower() is fast and right for pure ASCII
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def text_hash(text: Column) -> Column:
    """Tells rows of one doc_id apart: their positions are their own, and those of equal texts are equal."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def hashed_lines(docs: DataFrame, min_chars: int, id_col: str = "doc_id", text_col: str = "text", by_text: bool = False) -> DataFrame:
    """(doc, pos, h1, h2) of each line whose key has at least min_chars code points; with by_text, the text's hash too."""
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    row = [text_hash(F.col(text_col)).alias("row")] if by_text else []
    kept = ["doc", "row"] if by_text else ["doc"]
    lines = docs.select(doc.alias("doc"), *row, F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"))
    # a key is as long as its stripped line, so short ones go before case is looked at
    lines = lines.where(F.length("line") >= min_chars).select(*kept, "pos", F.btrim("line", F.lit(SPACE)).alias("line")).where(F.length("line") >= min_chars)
    key = ascii_lower(F.col("line"))
    return lines.select(*kept, "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


class LineRuns:
    """Levels of runs; level k's runs are up to fanout**k batches large."""

    def __init__(self, spark: SparkSession, fanout: int = 3):
        self.spark, self.fanout, self.buckets = spark, fanout, n_partitions(spark)
        self.levels: list[list[tuple[str, str]]] = []

    def runs(self) -> list[tuple[str, str]]:
        return [run for level in self.levels for run in level]

    def _write(self, df: DataFrame) -> tuple[str, str]:
        """df must be dealt out by HASH over self.buckets partitions, so that each bucket is one file."""
        name, path = f"line_run_{uuid.uuid4().hex}", new_path(self.spark, "line-run")
        df.write.bucketBy(self.buckets, *HASH).sortBy(*HASH).option("path", path).saveAsTable(name)
        return name, path

    def _drop(self, run: tuple[str, str]) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run[0]}")
        drop_path(self.spark, run[1])

    def absorb(self, hashed: DataFrame) -> None:
        """Adds the keys of a batch whose doc_ids are all above those of earlier batches."""
        new = hashed.groupBy(*HASH).agg(F.min("doc").alias("first"))
        for name, _ in self.runs():
            new = new.join(self.spark.table(name).select(*HASH).hint("merge"), HASH, "left_anti")
        self._add(0, self._write(new))

    def _add(self, level: int, run: tuple[str, str]) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            merged = self._union(old).repartition(self.buckets, *HASH)
            self._add(level + 1, self._write(merged))
            for x in old:
                self._drop(x)

    def _union(self, runs: list[tuple[str, str]]) -> DataFrame:
        out = self.spark.createDataFrame([], "h1 long, h2 long, first long")
        for k, (name, _) in enumerate(runs):
            out = out.union(self.spark.table(name)) if k else self.spark.table(name)
        return out

    def firsts(self) -> DataFrame:
        """(h1, h2, first) of all keys, read as plain files: dealt out anew, so that the adaptive join can split hot keys."""
        runs = [self.spark.read.schema("h1 long, h2 long, first long").parquet(path) for _, path in self.runs()]
        return reduce(DataFrame.union, runs)


def build_runs(docs: DataFrame, min_chars: int = 10, batches: int = 4, fanout: int = 3, id_col: str = "doc_id", text_col: str = "text") -> LineRuns:
    """Runs of a whole table, taken in as batches of doc_id ranges."""
    runs = LineRuns(docs.sparkSession, fanout)
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    low, high = docs.agg(F.min(F.col(id_col).cast("long")), F.max(F.col(id_col).cast("long"))).first()
    if low is None:
        low = high = 0
    cuts = sorted({low + (high - low + 1) * k // batches for k in range(1, batches)} - {low})
    edges = [None, *cuts, None]
    for a, b in zip(edges, edges[1:]):
        part = docs if a is None else docs.where(doc >= a)
        part = part if b is None else part.where(doc < b)
        runs.absorb(hashed_lines(part, min_chars, id_col, text_col))
    return runs


def dropped_lines(docs: DataFrame, runs: LineRuns, min_chars: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, row, drops): the positions of the lines that a text of a document loses. Hot keys are split by the adaptive skew join."""
    firsts = runs.firsts().select(F.col("h1"), F.col("h2"), F.col("first"))
    lost = hashed_lines(docs, min_chars, id_col, text_col, by_text=True).join(firsts.hint("merge"), HASH).where("doc > first")
    return lost.groupBy("doc", "row").agg(F.collect_set("pos").alias("drops"))


def dedup_lines(docs: DataFrame, min_chars: int = 10, batches: int = 4, fanout: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text less its dropped lines, and __tw_n_lines and __tw_n_dropped."""
    runs = build_runs(docs, min_chars, batches, fanout, id_col, text_col)
    lost = dropped_lines(docs, runs, min_chars, id_col, text_col)
    lost = lost.select(F.col("doc").alias(f"{OWN}doc"), F.col("row").alias(f"{OWN}row"), F.col("drops").alias(f"{OWN}drops"))
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))
    both = docs.withColumn(f"{OWN}doc", doc).withColumn(f"{OWN}row", text_hash(F.col(text_col))).join(lost, [f"{OWN}doc", f"{OWN}row"], "left")
    lines, drops = lines_of(F.col(text_col)), F.col(f"{OWN}drops")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drops)
    text = F.when(drops.isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    sizes = {f"{OWN}n_lines": F.size(lines).cast("long"), f"{OWN}n_dropped": F.coalesce(F.size(drops), F.lit(0)).cast("long")}
    own = [F.col(c) for c in docs.columns if c != text_col]
    out = both.select(*own, text.alias(text_col), *[v.alias(k) for k, v in sizes.items()])
    return out.select(*docs.columns, *sizes)


#: The same for DuckDB over the view documents.
SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), firsts AS (
  SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k
), marked AS (
  SELECT keyed.*, coalesce(firsts.first < keyed.doc_id, FALSE) AS gone FROM keyed LEFT JOIN firsts USING (k)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
