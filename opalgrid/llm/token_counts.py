"""Token counts: delta-maintained rollups with idempotent batch commits.

A change is an insert, a delete or a revised count of one document. It becomes one or two
signed rows (a revision takes the old count back and adds the new one), summed by source,
language and tokenizer version before anything is written. The sums of a batch go to a folder of
their own; the batch is committed by a small file under its number that names the folder. That
file is written in full elsewhere and renamed without overwriting, which stores decide for one
writer, so a batch is there whole or not at all, and a number that is there already is left
alone: replays and races change nothing. Totals are the sum over committed batches; ``compact``
folds those into one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F

from opalgrid.llm.common import column_bytes, column_of, tune
from opalgrid.llm.tokens import encoder

KEYS = ["source", "lang", "tokenizer"]
DELTAS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
#: Version name of counts of ``[^\x20\x09-\x0D]+`` words.
WORDS = "words"


def token_counts(docs: DataFrame, tokenizer_paths: dict[str, str]) -> DataFrame:
    """doc_id, source, lang, tokenizer, tokens: a row for each document and version. Whole texts;
    null counts as empty. Null identifiers, sources and languages stay null; rows that repeat are
    counted each; an empty table gives an empty result; other columns are left out."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {v: encoder(p) for v, p in tokenizer_paths.items()}
        for batch in batches:
            ids, sources, langs = (column_of(batch, c) for c in ("doc_id", "source", "lang"))
            for version in [WORDS, *own]:
                if version == WORDS:
                    n = [len(t.split()) for t in column_bytes(column_of(batch, "text"))]
                else:
                    n = [own[version].count(t or "") for t in column_of(batch, "text").to_pylist()]
                yield pa.RecordBatch.from_arrays([ids, sources, langs, pa.array([version] * len(n), pa.string()), pa.array(n, pa.int64())], names=["doc_id", "source", "lang", "tokenizer", "tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "text").mapInArrow(run, "doc_id long, source string, lang string, tokenizer string, tokens long")


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(1).cast("long").alias("n_docs"), F.col("tokens").alias("n_tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, F.lit(-1).cast("long").alias("n_docs"), (-F.col("tokens")).alias("n_tokens"))


def revisions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old counts taken back, new ones added; a document may change its source or language."""
    return deletes(old).unionByName(inserts(new))


class Rollup:
    """Additive totals under ``path``, in any store that Spark's Hadoop client can rename files in.

    Keys may be null; rows of equal keys, in one batch or several, add up. An empty batch is
    committed like any other."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs

    def _at(self, name: str):
        place = self._fs.Path(f"{self.path}/{name}")
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def delete_on_exit(self) -> None:
        """For totals that only this session reads."""
        place, fs = self._at("")
        fs.deleteOnExit(place)

    def _publish(self, name: str, text: str) -> bool:
        """A file ``name`` that holds ``text``, unless there is one already."""
        (own, fs), (target, _) = self._at(f"_open-{uuid.uuid4().hex}"), self._at(name)
        out = fs.create(own, True)
        out.write(bytearray(text.encode()))
        out.close()
        context = self._fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(getattr(self._fs, "Options$Rename"), 0)
        try:
            context.rename(own, target, plain)
        except Py4JJavaError as error:
            fs.delete(own, False)
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        return True

    def _published(self, kind: str) -> dict[int, str]:
        """number -> text of the files ``kind=number``."""
        place, fs = self._at("")
        if not fs.exists(place):
            return {}
        out = {}
        for status in fs.listStatus(place):
            name = status.getPath().getName()
            if name.startswith(f"{kind}="):
                stream = fs.open(status.getPath())
                out[int(name.split("=")[1])] = bytes(stream.readAllBytes()).decode()
                stream.close()
        return out

    def _write(self, deltas: DataFrame) -> str:
        name = f"sums-{uuid.uuid4().hex}"
        summed = deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        summed.coalesce(16).write.parquet(f"{self.path}/{name}")
        return name

    def committed(self, batch: int) -> bool:
        place, fs = self._at(f"batch={batch}")
        return fs.exists(place)

    def commit(self, batch: int, deltas: DataFrame) -> bool:
        """Whether the batch was new. A run that dies before the last step leaves no trace in totals."""
        if self.committed(batch):
            return False
        name = self._write(deltas)
        if self._publish(f"batch={batch}", name):
            return True
        place, fs = self._at(name)  # another writer was first
        fs.delete(place, True)
        return False

    def batches(self) -> list[int]:
        return sorted(self._published("batch"))

    def _state(self) -> tuple[int, str | None, set[int], dict[int, str]]:
        """Number and folder of the last compaction, the batches in it, and the folders of the others."""
        bases, batches = self._published("base"), self._published("batch")
        last = max(bases, default=-1)
        folder, held = (bases[last].split(" ")[0], {int(b) for b in bases[last].split(" ")[1:]}) if bases else (None, set())
        return last, folder, held, {b: f for b, f in batches.items() if b not in held}

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], DELTAS)
        return self.spark.read.schema(DELTAS).parquet(*[f"{self.path}/{f}" for f in folders])

    def compact(self) -> list[int]:
        """Fold all committed batches into one folder; the numbers it now holds, none if there was nothing
        new. Numbers stay committed. Of writers that race one wins; the folders that it folded in
        are deleted, so compact when no reader is between ``totals`` and its action."""
        last, folder, held, open_ = self._state()
        if not open_:
            return []
        name = self._write(self._rows([*([folder] if folder else []), *open_.values()]))
        numbers = sorted(held | set(open_))
        if not self._publish(f"base={last + 1}", " ".join([name, *map(str, numbers)])):
            place, fs = self._at(name)
            fs.delete(place, True)
            return []
        for old in [*([folder] if folder else []), *open_.values()]:
            place, fs = self._at(old)
            fs.delete(place, True)
        return numbers

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens of groups that hold a document."""
        _, folder, _, open_ = self._state()
        rows = self._rows([*([folder] if folder else []), *open_.values()])
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")
