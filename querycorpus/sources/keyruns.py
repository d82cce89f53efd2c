"""Keys of an append-only table: bucketed runs beside it, each with Bloom filters, listed in a versioned manifest.

An append looks its keys up in the filters and opens only those buckets where a filter hits, so its cost follows the batch and
the filters (two bytes a key), not the stored rows. Runs of about one size are merged four at a time, so their number grows
with the logarithm of the table.
"""

from __future__ import annotations

import json
import math
import uuid
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querycorpus.functions.scale import cut_lineage

#: Bits of one filter page (the size of Spark's bitmaps), keys meant for it, and bits set for a key: about one false hit in 400.
PAGE_BITS = 32_768
PAGE_KEYS = 2_048
MARKS = 4
#: A bucket holds 16 pages of keys or more, a run at most 64 buckets.
BUCKETS, BUCKET_PAGES = 64, 16
MERGED_RUNS = 4


def _page(key: Column, pages: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(pages))


def _buckets(pages: int) -> int:
    return min(BUCKETS, math.ceil(pages / BUCKET_PAGES))


def _mark(key: Column, place: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(place)), F.lit(PAGE_BITS)).cast("int")


def _level(n: int) -> int:
    return int(math.log(max(n, 1) / PAGE_KEYS + 1, MERGED_RUNS))


class KeyRuns:
    """The keys stored in the table at ``path``; kept in its hidden folder ``_keys``.

    The manifest is a small JSON file per version: ``type`` of the key, ``runs`` (folder, n, pages), the ``pending`` run of an append that has
    not ended, and ``steps``, the last finished step of each named stream. A version is written once; a second writer of it fails.
    """

    def __init__(self, spark: SparkSession, path: str, key: str) -> None:
        self.spark, self.key, self.folder = spark, key, f"{path}/_keys"
        self.version, self.manifest = self._read()

    def _fs(self, path: str):
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark._jsc.hadoopConfiguration()), found

    def _read(self) -> tuple[int, dict | None]:
        fs, pattern = self._fs(f"{self.folder}/manifest-*.json")
        versions = sorted(s.getPath().getName() for s in fs.globStatus(pattern) or [])
        if not versions:
            return 0, None
        text = self.spark.read.text(f"{self.folder}/{versions[-1]}", wholetext=True).first()[0]
        return int(versions[-1].split("-")[1].split(".")[0]), json.loads(text)

    def write(self, **changes) -> None:
        """The next version of the manifest, seen whole or not at all."""
        self.manifest, self.version = {**self.manifest, **changes}, self.version + 1
        fs, target = self._fs(f"{self.folder}/manifest-{self.version:09d}.json")
        _, draft = self._fs(f"{self.folder}/_draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(self.manifest).encode()))
        out.close()
        if fs.exists(target) or not fs.rename(draft, target):
            raise RuntimeError(f"another append changed {self.folder}")

    def start(self, stored: DataFrame | None, key_type: str) -> None:
        """Take over a table without runs, or one whose last append broke off: what it stored of its keys is looked up in the table."""
        if self.manifest is None:
            self.manifest = {"type": key_type, "runs": [], "pending": None, "steps": {}}
            if stored is not None:
                self.write(runs=self.with_run(self.new_run(stored.select(self.key))))
        elif self.manifest["pending"]:
            run = self.manifest["pending"]["run"]
            there = self.keys([run]).join(stored.select(F.col(self.key).cast(self.manifest["type"])), self.key, "left_semi") if stored is not None else None
            self.write(runs=self.with_run(self.new_run(there)) if there is not None else self.manifest["runs"], pending=None)

    def new_run(self, keys: DataFrame) -> dict:
        """Write the keys in buckets, sorted, and a filter page for every 2,048 of them. Null keys equal nothing and are left out."""
        kept = keys.select(F.col(self.key).cast(self.manifest["type"])).where(F.col(self.key).isNotNull())
        n = kept.count()
        pages, folder = max(1, math.ceil(n / PAGE_KEYS)), uuid.uuid4().hex
        page = _page(F.col(self.key), pages)
        placed = kept.withColumn("_page", page).withColumn("_bucket", F.col("_page") % _buckets(pages))
        placed = placed.repartition("_bucket", (F.col("_page") / BUCKETS / 512).cast("long")).sortWithinPartitions("_bucket", self.key)
        placed.select(self.key, "_bucket").write.partitionBy("_bucket").parquet(f"{self.folder}/keys/_run={folder}")
        bits = F.explode(F.array(*[_mark(F.col(self.key), i) for i in range(MARKS)]))
        marks = kept.select(page.alias("_page"), bits.alias("_mark")).groupBy("_page").agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("_mark") + 1)).alias("_bits"))
        marks.write.parquet(f"{self.folder}/filters/_run={folder}")
        return {"folder": folder, "n": n, "pages": pages}

    def with_run(self, run: dict) -> list[dict]:
        """The runs and a new one; four of a level become one of a higher one."""
        runs = [*self.manifest["runs"], *([run] if run["n"] else [])]
        while full := [level for level, n in Counter(_level(r["n"]) for r in runs).items() if n >= MERGED_RUNS]:
            merged = [r for r in runs if _level(r["n"]) == full[0]]
            runs = [r for r in runs if r not in merged] + [self.new_run(self.keys(merged))]
        return runs

    def keys(self, runs: list[dict], buckets: dict[str, list[int]] | None = None) -> DataFrame:
        """The keys of runs, or of some buckets of them."""
        schema, paths = f"`{self.key}` {self.manifest['type']}, _run string, _bucket long", []
        for run in runs:
            folder = f"{self.folder}/keys/_run={run['folder']}"
            paths += [folder] if buckets is None else [f"{folder}/_bucket={b}" for b in buckets.get(run["folder"], [])]
        reader = self.spark.read.schema(schema).option("basePath", f"{self.folder}/keys")
        return (reader.parquet(*paths) if paths else self.spark.createDataFrame([], schema)).select(self.key)

    def stored(self, keys: DataFrame) -> tuple[DataFrame | None, int]:
        """(those of the keys that are stored, None if no filter hits; number of buckets opened)"""
        runs = self.manifest["runs"]
        if not runs:
            return None, 0
        key = F.col(self.key)
        asked = keys.select(key.cast(self.manifest["type"]).alias(self.key)).where(key.isNotNull())
        where = F.array(*[F.struct(F.lit(r["folder"]).alias("_run"), _page(key, r["pages"]).alias("_page"), F.lit(_buckets(r["pages"])).alias("_of")) for r in runs])
        asked = asked.select(key, *[_mark(key, i).alias(f"_m{i}") for i in range(MARKS)], F.inline(where))
        reader = self.spark.read.schema("_page long, _bits binary, _run string").option("basePath", f"{self.folder}/filters")
        pages = reader.parquet(*[f"{self.folder}/filters/_run={r['folder']}" for r in runs])
        is_set = " AND ".join(f"shiftright(CAST(conv(hex(substring(_bits, _m{i} div 8 + 1, 1)), 16, 10) AS INT), _m{i} % 8) & 1 = 1" for i in range(MARKS))
        hits = cut_lineage(asked.join(pages, ["_run", "_page"]).where(F.expr(is_set)).select(key, "_run", (F.col("_page") % F.col("_of")).alias("_bucket")))
        buckets: dict[str, list[int]] = {}
        for run, bucket in hits.select("_run", "_bucket").distinct().collect():  # at most 64 a run
            buckets.setdefault(run, []).append(bucket)
        if not buckets:
            return None, 0
        found = hits.select(key).distinct().join(self.keys(runs, buckets), self.key, "left_semi")
        return found, sum(map(len, buckets.values()))
