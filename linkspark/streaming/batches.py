"""Batches applied once: a log as the record of what counts, and derived tables kept up with what a batch touches."""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from linkspark.operators.crosswalk import hub, normalize

#: Rows whose digests one group of the first step holds, on average.
GROUP = 4096


@dataclass(frozen=True)
class Outcome:
    """What a batch did: its number in the log, the rows it brought and those that were new, and whether it had been
    applied before and nothing was done."""

    batch: str
    seq: int
    rows: int
    fresh: int
    replay: bool = False


def digest(df: DataFrame) -> str:
    """sha256 of a table's content, whatever the order and the partitions of its rows; repeats count.

    Each row is hashed, column by column in order of names with lengths before cells. Rows of one hash prefix are sorted
    and hashed together, then groups of a shorter prefix, until one is left: about GROUP rows and then at most 256 groups
    meet in one place.
    """
    cell = lambda c: F.coalesce(F.concat(F.octet_length(F.col(f"`{c}`").cast("string")).cast("string"), F.lit(":"), F.col(f"`{c}`").cast("string")), F.lit("-"))
    names = sorted(df.columns)
    rows = df.select(F.sha2(F.concat_ws(",", F.lit(len(names)), *[F.lit(n) for n in names], *[cell(n) for n in names]), 256).alias("d"))
    n, cut = rows.count(), 0
    while 16**cut * GROUP < n:
        cut += 1
    rows = rows.withColumn("p", F.substring("d", 1, cut) if cut else F.lit(""))
    while True:
        rows = rows.groupBy("p").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("d")), ""), 256).alias("d"))
        if not cut:
            break
        # groups keep their order by the prefix before their hash
        cut = max(0, cut - 2)
        rows = rows.select(F.substring("p", 1, cut).alias("p") if cut else F.lit("").alias("p"), F.concat("p", "d").alias("d"))
    found = rows.select("d").first()
    return found["d"] if found else hashlib.sha256(b"").hexdigest()


class Log:
    """Folder of one small file for each number, from 1: what counts, in order. A file is written under another name and
    renamed, never over one that is there, so of two writers one gets a number and the other none."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.folder = spark, f"{root.rstrip('/')}/log"
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.hadoop.Path(f"{self.folder}/{name}" if name else self.folder)

    def entries(self) -> list[dict]:
        """All entries with their numbers (seq); one line each, read in one job."""
        if not self.fs.exists(self._path("")) or not self.fs.globStatus(self._path("*.json")):
            return []
        return sorted((json.loads(r["value"]) for r in self.spark.read.text(f"{self.folder}/*.json").collect()), key=lambda e: e["seq"])

    def commit(self, entry: dict, after: int) -> dict | None:
        """The entry under the number behind `after`; None where another writer has taken that."""
        entry = entry | {"seq": after + 1}
        own, final = self._path(f"_{uuid.uuid4().hex}"), self._path(f"{after + 1:012d}.json")
        out = self.fs.create(own, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        context = self.hadoop.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        how = self.spark.sparkContext._gateway.new_array(getattr(self.hadoop, "Options$Rename"), 0)
        try:
            context.rename(context.makeQualified(own), context.makeQualified(final), how)
        except Exception:
            if not self.fs.exists(final):
                raise
            self.fs.delete(own, False)
            return None
        return entry


def live(spark: SparkSession, root: str, entries: list[dict] | None = None) -> DataFrame | None:
    """All rows of the batches that count, or of the given ones; None without any. Folders of batches that never came to
    count aren't read."""
    entries = Log(spark, root).entries() if entries is None else entries
    data = f"{root.rstrip('/')}/data"
    paths = [f"{data}/batch={e['batch']}" for e in entries if e["fresh"]]
    return spark.read.option("basePath", data).parquet(*paths).drop("batch") if paths else None


def append_batch(batch: DataFrame, root: str, key: list[str], control: DataFrame | None = None, dataset: str | None = None, by: str | None = None, tries: int = 10) -> Outcome:
    """Add a batch's new rows (by key, a set) to the table at root, once.

    control (dataset, status, ..): only a promoted dataset takes batches; others are a ValueError. A batch is named by its
    content's sha256; one that the log has is answered from the log and nothing is written. Else its new rows are written
    to a folder of their own, over what an earlier try left there, and then the log gets its entry: a run that ends between
    the two leaves nothing that counts, and the batch sent again does it all. If another writer's entry comes first, new
    rows are found again. by: column that the folders are parted by; the table is then compared only where the batch has
    rows (its distinct values come to the driver, up to 10,000). Rows are counted while they are written. Null keys are
    values. An empty batch has an entry and no rows.
    """
    spark = batch.sparkSession
    if control is not None:
        row = control.where(F.col("dataset") == dataset).select("status").head(1)
        if not row or row[0]["status"] != "promoted":
            raise ValueError(f"dataset {dataset!r} is not promoted")
    log = Log(spark, root)
    name = digest(batch)
    for _ in range(tries):
        entries = log.entries()
        for e in entries:
            if e["batch"] == name:
                return Outcome(e["batch"], e["seq"], e["rows"], e["fresh"], True)
        seen, new = Observation(), Observation()
        fresh = batch.observe(seen, F.count(F.lit(1)).alias("n")).dropDuplicates(key)
        held = live(spark, root, entries)
        if held is not None:
            values = [r[0] for r in batch.select(by).distinct().limit(10_001).collect()] if by else []
            if by and len(values) <= 10_000:
                held = held.where(F.col(by).isin([v for v in values if v is not None]) | (F.col(by).isNull() & F.lit(None in values)))
            same = reduce(lambda a, b: a & b, [F.col(f"f.`{k}`").eqNullSafe(F.col(f"h.`{k}`")) for k in key])
            fresh = fresh.alias("f").join(held.select(*key).alias("h"), same, "left_anti")
        writer = fresh.observe(new, F.count(F.lit(1)).alias("n")).write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(f"{root.rstrip('/')}/data/batch={name}")
        entry = {"batch": name, "rows": seen.get["n"], "fresh": new.get["n"]}
        done = log.commit(entry, entries[-1]["seq"] if entries else 0)
        if done:
            return Outcome(name, done["seq"], done["rows"], done["fresh"])
    raise RuntimeError(f"other writers came first {tries} times")


def keyed_values(values: DataFrame, recipe: str = "casefold,collapse_ws", buckets: int = 256, column: str = "value") -> DataFrame:
    """values (participant, entity, value) with the bucket of their key, the column that append_batch() is to part by."""
    return values.withColumn("bucket", F.pmod(F.xxhash64(normalize(F.col(column), recipe)), F.lit(buckets)).cast("int"))


def refreshed_hub(spark: SparkSession, root: str, hubs: str, concept: str, least: int = 2, recipe: str = "casefold,collapse_ws", buckets: int = 256) -> list[int]:
    """Bring the hub at `hubs` up to the table of values (keyed_values(), parted by bucket) at root; the buckets that were
    built anew.

    The hub's own log says up to which batch it stands and in which build each bucket was last made. Only buckets that the
    batches since then have new rows in are read and built, from all of their values: keys that come to be shared or gain
    an entity change, everything else stays as it is. However many batches have come, they are one build. A run that ends
    early leaves no entry and is done again.
    """
    own = Log(spark, hubs)
    entries, taken = Log(spark, root).entries(), own.entries()
    stands = taken[-1]["upto"] if taken else 0
    missing = [e for e in entries if e["seq"] > stands]
    if not missing:
        return []
    touched = live(spark, root, missing)
    numbers = sorted(r[0] for r in touched.select("bucket").distinct().collect()) if touched is not None else []  # `buckets` at most
    build = uuid.uuid4().hex
    if numbers:
        held = live(spark, root, entries).where(F.col("bucket").isin(numbers)).drop("bucket")
        links = keyed_values(hub(held, concept, least, recipe), recipe, buckets, "raw")
        links.write.mode("overwrite").partitionBy("bucket").parquet(f"{hubs.rstrip('/')}/data/build={build}")
    made = (taken[-1]["made"] if taken else {}) | {str(b): build for b in numbers}
    if own.commit({"upto": entries[-1]["seq"], "made": made}, taken[-1]["seq"] if taken else 0) is None:
        raise RuntimeError("another run has refreshed the hub meanwhile")
    return numbers


def hub_rows(spark: SparkSession, hubs: str) -> DataFrame | None:
    """Links (hub, participant, entity, raw) of the hub as it stands: each bucket from the build that made it last."""
    taken = Log(spark, hubs).entries()
    if not taken:
        return None
    data = f"{hubs.rstrip('/')}/data"
    builds = sorted(set(taken[-1]["made"].values()))
    if not builds:
        return None
    rows = spark.read.option("basePath", data).parquet(*[f"{data}/build={b}" for b in builds])
    current = F.array(*[F.lit(f"{b}/{k}") for k, b in taken[-1]["made"].items()])  # a name for each bucket
    return rows.where(F.array_contains(current, F.concat_ws("/", "build", F.col("bucket").cast("string")))).select("hub", "participant", "entity", "raw")


def touched(batch: DataFrame, q: DataFrame) -> DataFrame:
    """(s) of the subjects whose findings a batch of quads can change: its own, those that link to them, and those that
    they link to. Semi-joins over subject and link columns alone."""
    own = batch.select("s").distinct()
    links = q.where("kind = 'iri'").select("s", "o")
    to = links.join(own.withColumnRenamed("s", "o"), "o", "left_semi").select("s")
    from_ = links.join(own, "s", "left_semi").select(F.col("o").alias("s"))
    return own.unionByName(to).unionByName(from_).distinct()


def rechecked(findings: DataFrame, batch: DataFrame, q: DataFrame, check, subject: str = "s") -> DataFrame:
    """Findings brought up to the quads q, to which a batch was added: those of untouched subjects stay, touched ones are
    checked anew on their own quads and those one link away, either way. check: quads to findings with the column
    `subject`; what it says of a subject has to follow from these."""
    near = touched(batch, q)
    # what is a link away is needed to judge touched subjects, and judged only if touched itself
    links = q.where("kind = 'iri'").select("s", "o")
    to = links.join(near.withColumnRenamed("s", "o"), "o", "left_semi").select("s")
    from_ = links.join(near, "s", "left_semi").select(F.col("o").alias("s"))
    around = near.unionByName(to).unionByName(from_).distinct()
    fresh = check(q.join(around, "s", "left_semi")).join(near.withColumnRenamed("s", subject), subject, "left_semi")
    return findings.join(near.withColumnRenamed("s", subject), subject, "left_anti").unionByName(fresh)
