"""An index of word windows that is kept: each new batch is deduplicated against all earlier ones, whose texts aren't read again.

The index is a folder. Its runs are immutable tables of contexts (``repeats``: the words that a run of windows with one anchor
covers, at most ``2 * width - gram``), bucketed and sorted by the anchor's fingerprint. A batch's fingerprints are merge-joined with each run; what they
meet is compared by the words themselves, whole contexts first and then window by window. Contexts that no run has become a new
run; when ``fan_in`` runs of a level exist, they are merged into one of the next. A manifest, put in place by one rename, names the runs
that count: an append that was lost halfway leaves the index as it was, and one that is repeated gives the same rows.

A window is removed if its words also start earlier: in a batch before, or in the same batch at a smaller doc_id, or earlier in the
document. So batches by ascending doc_id give what ``fingerprint_index.deduplicate`` gives for the whole table. Null text has no words. A
row without doc_id takes no part and loses nothing. Rows of one doc_id and one text are the same document, in whichever batches they
come; other texts of a doc_id are documents of their own, ordered by a 64-bit hash. An empty batch changes nothing.
One writer at a time: of two that append at once, the later rename fails and its batch is to be appended again.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.blocks import BLANKS, find_words, map_batches, text_blocks, word_hashes
from emberline.llm.fingerprint_index import FAN_IN, GRAM, WIDTH, kept_words
from emberline.llm.repeats import Hashed, Windows, with_spans
from emberline.session import discard, stored

CONTEXT = "fp long, words string, batch int, doc_id long, version long, start int, count int"


def context_rows(docs: DataFrame, windows: Windows) -> DataFrame:
    """(fp, words, doc_id, version, start, count) of documents (doc_id, version, text): their contexts, words joined by one blank."""

    def run(batches):
        for batch in batches:
            ids, versions = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, hi, data, offsets in text_blocks(batch.column(2)):
                begin, end, offsets = find_words(data, offsets, BLANKS)
                g = Hashed(word_hashes(data, begin, end), offsets, windows).groups(contexts=False)
                raw = data.tobytes()
                last = g.start + g.count + windows.width - 2
                cut = [raw[a:b] for a, b in zip(begin[g.start].tolist(), end[last].tolist(), strict=True)]
                yield pa.record_batch(
                    [
                        pa.array(g.fp.view(np.int64)),
                        pa.array(cut, pa.binary()).cast(pa.string()),
                        pa.array(ids[lo:hi][g.row].astype(np.int64)),
                        pa.array(versions[lo:hi][g.row]),
                        pa.array((g.start - offsets[g.row]).astype(np.int32)),
                        pa.array(g.count.astype(np.int32)),
                    ],
                    names=["fp", "words", "doc_id", "version", "start", "count"],
                )

    rows = map_batches(docs.select("doc_id", "version", "text"), run, "fp long, words string, doc_id long, version long, start int, count int")
    return rows.withColumn("words", F.regexp_replace("words", r"[\x20\x09-\x0D]+", " "))


class KeptIndex:
    """The index in the folder ``path``, which all executors share; a new one, or the one that is there."""

    def __init__(self, spark: SparkSession, path: str, width: int = WIDTH, gram: int = GRAM, fan_in: int = FAN_IN):
        self.spark, self.path, self.fan_in = spark, path.rstrip("/"), fan_in
        self.windows = Windows(width, min(gram, width))
        self._jvm = spark._jvm.org.apache.hadoop.fs
        self._fs = self._jvm.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._tables: dict[str, str] = {}
        self._load()

    def _load(self) -> None:
        place = self._jvm.Path(f"{self.path}/manifests")
        self._fs.mkdirs(place)
        numbers = [int(s.getPath().getName()) for s in self._fs.listStatus(place) if s.getPath().getName().isdigit()]
        self.number = max(numbers, default=0)
        plain = {"width": self.windows.width, "gram": self.windows.gram, "buckets": int(self.spark.conf.get("spark.sql.shuffle.partitions")), "runs": []}
        self.manifest = plain
        if numbers:
            self.manifest = json.loads("".join(r.value for r in self.spark.read.text(f"{self.path}/manifests/{self.number}").collect()))  # a line a run
            if (self.manifest["width"], self.manifest["gram"]) != (plain["width"], plain["gram"]):
                raise ValueError(f"{self.path} holds windows of {self.manifest['width']} words with grams of {self.manifest['gram']}")

    @property
    def runs(self) -> list[dict]:
        return self.manifest["runs"]

    def _commit(self, runs: list[dict]) -> None:
        """Makes ``runs`` those that count, then deletes the others' files."""
        number, text = self.number + 1, json.dumps({**self.manifest, "runs": runs}, indent=0)
        draft, final = self._jvm.Path(f"{self.path}/manifests/.draft-{uuid.uuid4().hex}"), self._jvm.Path(f"{self.path}/manifests/{number}")
        out = self._fs.create(draft)
        out.write(bytearray(text, "utf-8"))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise RuntimeError(f"{self.path} was changed meanwhile: open it again and append the batch again")
        gone = [r for r in self.runs if r not in runs]
        self.number, self.manifest = number, {**self.manifest, "runs": runs}
        for run in gone:
            self._forget(run)
            self._fs.delete(self._jvm.Path(f"{self.path}/{run['name']}"), True)

    def _table(self, run: dict) -> DataFrame:
        """A run with its buckets known to the planner, so that a merge join doesn't move it."""
        if run["name"] not in self._tables:
            table = f"kept_{uuid.uuid4().hex[:12]}"
            buckets = f"clustered by (fp) sorted by (fp) into {self.manifest['buckets']} buckets"
            self.spark.sql(f"create table {table} ({CONTEXT}) using parquet {buckets} location '{self.path}/{run['name']}'")
            self._tables[run["name"]] = table
        return self.spark.table(self._tables[run["name"]])

    def _forget(self, run: dict) -> None:
        if table := self._tables.pop(run["name"], None):
            self.spark.sql(f"drop table {table}")  # its location stays

    def _write(self, level: int, rows: DataFrame) -> dict:
        run, table = {"name": f"run-{uuid.uuid4().hex}", "level": level}, f"kept_{uuid.uuid4().hex[:12]}"
        buckets = self.manifest["buckets"]
        rows.repartition(buckets, "fp").write.bucketBy(buckets, "fp").sortBy("fp").option("path", f"{self.path}/{run['name']}").saveAsTable(table)
        self._tables[run["name"]] = table
        return run

    def append(self, batch: DataFrame) -> DataFrame:
        """Adds a batch (doc_id, text); returns for each of its rows doc_id, n_units (its words), n_removed and kept (the words left, joined by a blank)."""
        number = self.number + 1
        docs = batch.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("version"), "text")
        each = docs.filter("doc_id is not null and text is not null")
        new = stored(context_rows(each, self.windows).withColumn("batch", F.lit(number)), "contexts")
        mine = stored(new.select("fp").distinct(), "fingerprints")
        met = new.select(*_names())
        for run in self.runs:
            met = met.unionByName(self._table(run).join(mine.hint("merge"), "fp", "left_semi").select(*_names()))
        order = F.struct("batch", "doc_id", "version", "start")
        firsts = stored(met.groupBy("fp", "words").agg(F.min(order).alias("first"), F.min("count").alias("count"), F.max("batch").alias("latest")), "firsts")
        spans = self._repeats(new, firsts, number)
        fresh = firsts.filter(F.col("first.batch") == number).select("fp", "words", "first.*", "count").select(*_names())
        if not fresh.isEmpty():
            self._commit([*self.runs, self._write(0, fresh)])
        discard(new, mine, firsts)
        self._compact()
        return kept_words(with_spans(docs, spans))

    def _repeats(self, new: DataFrame, firsts: DataFrame, number: int) -> DataFrame:
        """(doc_id, version, start, stop) of the batch's windows that also start earlier."""
        width = self.windows.width
        place = ("doc_id", "version", "start")
        other = F.struct(*place) != F.struct(*[f"first.{c}" for c in place])
        whole = new.join(firsts.select("fp", "words", "first"), ["fp", "words"]).filter(other)
        whole = whole.select("doc_id", "version", "start", (F.col("start") + F.col("count") - 1 + width).alias("stop"))
        # contexts that differ can still share windows, if their anchors are alike: each window by its words
        several = stored(firsts.groupBy("fp").agg(F.count("*").alias("m")).filter("m > 1").select("fp"), "several")
        words = F.split("words", " ")
        at = F.explode(F.transform(F.sequence(F.lit(0), F.col("count") - 1), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(words, k + 1, F.lit(width)), " ").alias("window"))))
        each = firsts.join(several, "fp").select("fp", "first", "latest", at.alias("at")).select("fp", "latest", "at.window", "first.batch", "first.doc_id", "first.version", (F.col("first.start") + F.col("at.k")).alias("start"))
        each = stored(each, "windows")
        least = each.groupBy("fp", "window").agg(F.min(F.struct("batch", *place)).alias("first"), F.count("*").alias("m")).filter("m > 1").drop("m")
        # of a batch that is appended again, the firsts are the index's own: what lies in other documents goes when spans meet the batch
        parts = each.filter(F.col("latest") == number).join(least, ["fp", "window"]).filter(other)
        spans = stored(whole.unionByName(parts.select("doc_id", "version", "start", (F.col("start") + width).alias("stop"))), "spans")
        discard(several, each)
        return spans

    def _compact(self) -> None:
        while True:
            levels = [run["level"] for run in self.runs]
            full = next((x for x in sorted(set(levels)) if levels.count(x) >= self.fan_in), None)
            if full is None:
                return
            old = [run for run in self.runs if run["level"] == full]
            rows = self._table(old[0])
            for run in old[1:]:
                rows = rows.unionByName(self._table(run))
            self._commit([run for run in self.runs if run not in old] + [self._write(full + 1, rows)])

    def close(self) -> None:
        """Forgets the session's names of the runs; the index stays in its folder."""
        for run in list(self.runs):
            self._forget(run)


def _names() -> list[str]:
    return [field.split()[0] for field in CONTEXT.split(", ")]
