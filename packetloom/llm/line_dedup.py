"""Line deduplication over levelled sorted runs of line hashes. DataFrame and SQL functions only."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, SPACE, UPPER, hash128, new_path, scratch, written

KEY = ["h1", "h2"]
RUN = "h1 long, h2 long, n_docs long, last_doc long"


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


@dataclass
class LineRuns:
    """Levelled runs of (line hash, number of documents, largest document id), bucketed and sorted by hash.

    ``add`` merge-anti-joins a batch with the runs: hashes that no run holds become a run of level 0, the others' counts are kept beside it. So a hash is in
    one run only. Runs are bucketed alike, so these joins move the batch alone. When a level holds ``fanout`` runs they are merged into one of the next level:
    a hash is rewritten once a level. Only lines of at least ``min_chars`` code points count. Rows of a batch that repeat a doc_id are one document, those
    with a null doc_id one more; a doc_id must not come again in a later batch. ``drop`` deletes what is stored."""

    spark: SparkSession
    min_chars: int = 40
    fanout: int = 4
    runs: list[tuple[int, str]] = field(default_factory=list)
    tables: list[str] = field(default_factory=list)
    #: Tables with counts of hashes that were in a run before, of runs that have been merged.
    again: list[DataFrame] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def hashes(self, docs: DataFrame) -> DataFrame:
        """One row for each row of docs and distinct long key in it."""
        keys = F.array_distinct(F.filter(F.transform(lines(F.col("text")), line_key), lambda k: F.length(k) >= self.min_chars))
        key = docs.select("doc_id", F.explode(keys).alias("key"))
        h1, h2 = hash128(F.col("key"))
        return key.select("doc_id", h1.alias("h1"), h2.alias("h2"))

    def _stored(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        rows.write.format("parquet").option("path", new_path(self.spark, "line-run")).bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(name)
        self.tables.append(name)
        return name

    def _run(self, name: str) -> DataFrame:
        return self.spark.table(name).where("is_new").drop("is_new")

    def _seen(self, rows: DataFrame) -> DataFrame:
        """rows, with a column for each run that tells whether it holds the hash."""
        for i, (_, name) in enumerate(self.runs):
            rows = rows.join(self._run(name).select(*KEY, F.lit(True).alias(f"in_{i}")), KEY, "left")
        return rows

    def _is_new(self) -> Column:
        return reduce(lambda x, y: x & y, (F.col(f"in_{i}").isNull() for i in range(len(self.runs))), F.lit(True))

    def add(self, docs: DataFrame) -> None:
        """Adds a batch of documents."""
        own = self.hashes(docs).distinct().groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))
        rows = self._seen(own).select(*KEY, "n_docs", "last_doc", self._is_new().alias("is_new"))
        self.runs.append((0, self._stored(rows)))
        self._compact()

    def _compact(self) -> None:
        level = 0
        while level <= max(x for x, _ in self.runs):
            own = [name for x, name in self.runs if x == level]
            if len(own) >= self.fanout:
                merged = reduce(DataFrame.unionByName, map(self._run, own)).withColumn("is_new", F.lit(True))
                self.again.append(written(self._summed([self.spark.table(name).where("NOT is_new") for name in own]), "line-counts"))
                self.runs = [r for r in self.runs if r[0] != level] + [(level + 1, self._stored(merged))]
            level += 1

    def _summed(self, parts: list[DataFrame]) -> DataFrame:
        rows = reduce(DataFrame.unionByName, (p.select(*KEY, "n_docs", "last_doc") for p in parts))
        return rows.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))

    def merged(self) -> DataFrame:
        """RUN rows, one for each hash, with all counts."""
        if not self.runs:
            return self.spark.createDataFrame([], RUN)
        again = self._summed([*self.again, *(self.spark.table(name).where("NOT is_new") for _, name in self.runs)])
        again = written(again.select(*KEY, F.col("n_docs").alias("n_again"), F.col("last_doc").alias("last_again")), "line-counts")
        n_docs, last_doc = F.col("n_docs") + F.coalesce("n_again", F.lit(0)), F.greatest("last_doc", "last_again")
        return reduce(DataFrame.unionByName, (self._run(name).join(again, KEY, "left").select(*KEY, n_docs.alias("n_docs"), last_doc.alias("last_doc")) for _, name in self.runs))

    def unseen(self, docs: DataFrame) -> DataFrame:
        """(doc_id, h1, h2) of a batch's lines that no run holds."""
        return self._seen(self.hashes(docs)).where(self._is_new()).select("doc_id", *KEY)

    def drop(self) -> None:
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def repeated_lines(docs: DataFrame, min_chars: int, min_docs: int, batches: int) -> DataFrame:
    """h1, h2, last_doc of the lines that at least min_docs documents hold, written: joins with it can then be split where a line is hot. Documents come in
    batches by a hash of doc_id."""
    with scratch():
        runs = LineRuns(docs.sparkSession, min_chars=min_chars)
        for i in range(batches):
            runs.add(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == i))
        found = written(runs.merged().where(F.col("n_docs") >= min_docs).select(*KEY, "last_doc"), "repeated-lines", keep=True)
        runs.drop()
        return found


def drop_repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4) -> DataFrame:
    """docs with two more columns: ``kept_lines`` (array, in order) and ``n_lines`` (before dropping).

    A line whose key has min_chars code points and is in min_docs documents stays only in the largest doc_id that holds it.
    Null text is one empty line. Rows that repeat a doc_id are one document, which loses the same lines in each; rows with a null doc_id are one document,
    the smallest. Texts of any length are read whole. Other columns pass through, but for those named like the two. An empty table has an empty result."""
    slim = docs.select("doc_id", "text")
    repeated = repeated_lines(slim, min_chars, min_docs, batches)
    lost = LineRuns(docs.sparkSession, min_chars=min_chars).hashes(slim).join(repeated, KEY).where(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
    lost = lost.groupBy("doc_id").agg(F.collect_set(F.struct(*KEY)).alias("_lost")).withColumnRenamed("doc_id", "_doc")
    # Whole rows travel in a struct, so that no column of docs can clash with those made here.
    packed = docs.drop("n_lines", "kept_lines")
    packed = packed.select(F.struct(*[packed[c] for c in packed.columns]).alias("_row"))
    all_lines = lines(F.col("_row.text"))

    def stays(line: Column) -> Column:
        key = line_key(line)
        return (F.length(key) < min_chars) | ~F.array_contains(F.col("_lost"), F.struct(*[h.alias(n) for n, h in zip(KEY, hash128(key))]))

    joined = packed.join(lost, F.col("_row.doc_id").eqNullSafe(F.col("_doc")), "left")
    kept = F.when(F.col("_lost").isNull(), all_lines).otherwise(F.filter(all_lines, stays))
    return joined.select("_row", F.size(all_lines).cast("long").alias("n_lines"), kept.alias("kept_lines")).select("_row.*", "n_lines", "kept_lines")


def op9_line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    out = drop_repeated_lines(docs.select("doc_id", "text"))
    text = F.concat_ws("\n", "kept_lines")
    return out.select("doc_id", "n_lines", (F.col("n_lines") - F.size("kept_lines")).cast("long").alias("n_dropped"), F.sha2(text.cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM d),
k AS (SELECT *, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
n AS (SELECT key, max(doc_id) AS last_doc, count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) AS n_docs FROM k WHERE length(key) >= 40 GROUP BY key),
x AS (SELECT k.*, n.n_docs >= 5 AND k.doc_id IS DISTINCT FROM n.last_doc AS gone FROM k LEFT JOIN n USING (key))
SELECT doc_id, count(*) AS n_lines, count(CASE WHEN gone THEN 1 END) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE gone IS NOT TRUE), '')) AS kept_sha256
FROM x GROUP BY r, doc_id
"""
