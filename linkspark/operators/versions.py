"""Published and draft versions of datasets: a control table (dataset, status, live, staged), one row for each dataset."""

from __future__ import annotations

from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def live_graphs(control: DataFrame) -> DataFrame:
    """Graphs that reads may see: promoted datasets' live version, or the dataset's own graph before versions."""
    return control.where("status = 'promoted'").select(F.coalesce("live", "dataset").alias("g"))


def published(q: DataFrame, control: DataFrame) -> DataFrame:
    """Quads of published graphs. The control table is one row for each dataset; Spark broadcasts it by its size."""
    return q.join(live_graphs(control), "g", "left_semi")


def merged(q: DataFrame, control: DataFrame) -> DataFrame:
    """All published graphs as one set."""
    return published(q, control).drop("g").dropDuplicates(["s", "p", "o", "kind", "dt", "lang"])


def stage(control: DataFrame, dataset: str, version: str) -> DataFrame:
    return control.withColumn("staged", F.when(F.col("dataset") == dataset, version).otherwise(F.col("staged")))


def replaced(control: DataFrame, dataset: str) -> DataFrame:
    """(g) of a dataset's staged version, which stage() is about to take the place of: to be queued for removal."""
    return control.where((F.col("dataset") == dataset) & F.col("staged").isNotNull()).select(F.col("staged").alias("g"))


class Removals:
    """Graphs of a table at `path` (a folder a graph, as write_graph() makes) that are to be removed. The queue is a folder
    of empty files beside the data, so it outlives the run; a graph is queued once however often it is asked for."""

    def __init__(self, spark: SparkSession, path: str):
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.root = path.rstrip("/")
        self.fs = self.hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _files(self, folder: str) -> list[str]:
        where = self.hadoop.Path(folder)
        return sorted(f.getPath().getName() for f in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def queued(self) -> list[str]:
        """Graphs that wait, by name."""
        return [unquote(n) for n in self._files(f"{self.root}/_removals")]

    def add(self, graphs: DataFrame, control: DataFrame) -> None:
        """Queue graphs (g) that no dataset of the control table points at; others are a ValueError. Versions are few, their
        names come to the driver."""
        used = control.select(F.explode(F.array_compact(F.array("dataset", "live", "staged"))).alias("g"))
        if graphs.join(used, "g", "left_semi").head(1):
            raise ValueError("a graph that a dataset points at can't be removed")
        for r in graphs.where("g is not null").distinct().collect():
            self.fs.create(self.hadoop.Path(f"{self.root}/_removals/{quote(r['g'], safe='')}"), True).close()

    def sweep(self, most: int | None = None) -> list[str]:
        """Remove waiting graphs one by one, each as a whole folder, and then their queue file; those that are done. A run
        that ends between the two finds the folder gone and goes on."""
        folders = {unquote(n.removeprefix("g=")): n for n in self._files(self.root) if n.startswith("g=")}
        done = self.queued()[:most]
        for g in done:
            if g in folders:
                self.fs.delete(self.hadoop.Path(f"{self.root}/{folders[g]}"), True)
            self.fs.delete(self.hadoop.Path(f"{self.root}/_removals/{quote(g, safe='')}"), False)
        return done


def promote(control: DataFrame, dataset: str) -> DataFrame:
    """Point live at staged: a change of one control row, no data moves."""
    this = (F.col("dataset") == dataset) & F.col("staged").isNotNull()
    return control.select("dataset", F.when(this, "promoted").otherwise(F.col("status")).alias("status"), F.when(this, F.col("staged")).otherwise(F.col("live")).alias("live"), F.when(~this, F.col("staged")).alias("staged"))


def retract(control: DataFrame, dataset: str) -> DataFrame:
    return control.withColumn("status", F.when(F.col("dataset") == dataset, "retracted").otherwise(F.col("status")))


def orphans(q: DataFrame, control: DataFrame) -> DataFrame:
    """Version graphs that no dataset points at."""
    used = control.select(F.explode(F.array_compact(F.array("dataset", "live", "staged"))).alias("g"))
    return q.select("g").distinct().join(used, "g", "left_anti")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Triples in one of two versions only."""
    key = ["s", "p", "o", "kind", "dt", "lang"]
    return a.select(*key).exceptAll(b.select(*key)).withColumn("side", F.lit("a")).unionByName(b.select(*key).exceptAll(a.select(*key)).withColumn("side", F.lit("b")))


def reinstate(control: DataFrame, dataset: str) -> DataFrame:
    """A retracted dataset is published again; one that never was stays as it is."""
    back = (F.col("dataset") == dataset) & (F.col("status") == "retracted") & F.coalesce("live", "dataset").isNotNull()
    return control.withColumn("status", F.when(back, "promoted").otherwise(F.col("status")))


def tombstone(control: DataFrame, dataset: str) -> DataFrame:
    """The dataset is deleted; its row stays and answers citations."""
    gone = F.col("dataset") == dataset
    return control.select("dataset", F.when(gone, "deleted").otherwise(F.col("status")).alias("status"), *[F.when(~gone, F.col(c)).alias(c) for c in ("live", "staged")])


def resolve(cited: DataFrame, control: DataFrame) -> DataFrame:
    """(g, status) of cited graphs: live, retracted, deleted, or unknown."""
    known = control.select(F.col("dataset").alias("g"), F.when(F.col("status") == "promoted", "live").otherwise(F.col("status")).alias("status"))
    return cited.select("g").join(known, "g", "left").select("g", F.coalesce("status", F.lit("unknown")).alias("status"))


def vacuumed(q: DataFrame, control: DataFrame) -> DataFrame:
    """Quads without those of graphs that no dataset points at; in a table partitioned by graph, whole partitions go."""
    used = control.select(F.explode(F.array_compact(F.array("dataset", "live", "staged"))).alias("g")).distinct()
    return q.join(used, "g", "left_semi")


def migrated(q: DataFrame, old: str, new: str) -> DataFrame:
    """Quads with graph `old` merged into `new`, as a set: done again it changes nothing."""
    return q.withColumn("g", F.when(F.col("g") == old, new).otherwise(F.col("g"))).dropDuplicates(["g", "s", "p", "o", "kind", "dt", "lang"])


def snapshot(q: DataFrame, control: DataFrame, dataset: str) -> tuple[DataFrame, DataFrame]:
    """(triples, manifest) of a promoted dataset's live graph: counts and a digest that no order of rows changes."""
    live = live_graphs(control.where(F.col("dataset") == dataset))
    triples = q.join(live, "g", "left_semi").select("s", "p", "o", "kind", "dt", "lang")
    digest = F.sum(F.xxhash64(*triples.columns).cast("decimal(38,0)")).cast("string")
    return triples, triples.agg(F.lit(dataset).alias("dataset"), F.count(F.lit(1)).alias("triples"), digest.alias("digest"))


def restored(triples: DataFrame, manifest: DataFrame, control: DataFrame, version: str) -> DataFrame:
    """Control table with a snapshot's dataset added as staged and unpublished. An existing dataset, or triples that do not
    match the manifest, are errors."""
    want = manifest.first()
    if control.where(F.col("dataset") == want["dataset"]).limit(1).count():
        raise ValueError(f"dataset {want['dataset']!r} exists")
    got = triples.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*triples.columns).cast("decimal(38,0)")).cast("string")).first()
    if (got[0], got[1]) != (want["triples"], want["digest"]):
        raise ValueError("the snapshot does not match its manifest")
    row = manifest.select("dataset", F.lit("draft").alias("status"), F.lit(None).cast("string").alias("live"), F.lit(version).alias("staged"))
    return control.unionByName(row)


def rebased(triples: DataFrame, origin: str, local: str) -> DataFrame:
    """Triples with the issuer's base swapped in IRIs below <base>/datasets/; literals and other IRIs stay."""
    swap = lambda c: F.when(F.col(c).startswith(f"{origin}/datasets/"), F.concat(F.lit(local), F.substr(F.col(c), F.lit(len(origin) + 1)))).otherwise(F.col(c))
    return triples.withColumns({"s": swap("s"), "p": swap("p"), "o": F.when(F.col("kind") == "iri", swap("o")).otherwise(F.col("o"))})
