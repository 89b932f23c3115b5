"""Token counts as rollups maintained by deltas.

Changes of documents become signed rows: an insert adds its tokens, a delete takes them away, a revision does both. They are
summed by source, language and tokenizer version before they are shuffled, and written as a table of their own. A batch
counts from the moment its entry appears in the log, which a rename makes at once and for one writer only: committing the
same id again does nothing, whoever does it, and what a lost attempt wrote is never read. Totals are the sums over
the last compacted base and the batches since; compacting sums them into the next base, whose entry names all that it holds.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riffle.llm.common import slabs, small_batches, texts_of
from riffle.llm.token_ids import cache_for

KEYS = ("source", "lang", "tokenizer")
DELTA = "source string, lang string, tokenizer string, docs long, tokens long"
#: The version that counts words between ASCII white space.
WORDS = "words_1"


def signed(changes: DataFrame) -> DataFrame:
    """Signed rows (DELTA) of changes with an `old` and a `new` struct (source, lang, tokenizer, tokens), either null.

    Only old: a delete; only new: an insert; both: a revision; neither: nothing. Null keys are groups; null tokens count 0.
    """
    side = lambda c, sign: F.struct(*(F.col(f"{c}.{k}").cast("string").alias(k) for k in KEYS), F.lit(sign).cast("long").alias("docs"), (sign * F.coalesce(F.col(f"{c}.tokens"), F.lit(0))).cast("long").alias("tokens"))
    sides = F.array(F.when(F.col("old").isNotNull(), side("old", -1)), F.when(F.col("new").isNotNull(), side("new", 1)))
    return changes.select(F.explode(F.filter(sides, lambda s: s.isNotNull())).alias("s")).select("s.*")


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs != 0 or tokens != 0")


class RollupStore:
    """Committed batches of deltas in a folder that all executors share: data/ID (tables), log/BATCH and base/NUMBER (entries)."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs

    def _at(self, path: str):  # noqa: ANN202
        p = self._hadoop.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _entries(self, kind: str) -> dict[str, dict]:
        """What the entries of a folder say, by name."""
        fs, p = self._at(f"{self.path}/{kind}")
        out = {}
        for s in fs.listStatus(p) if fs.exists(p) else []:
            if not (name := s.getPath().getName()).startswith((".", "_")):
                stream = fs.open(s.getPath())
                try:
                    out[name] = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
                finally:
                    stream.close()
        return out

    def _claim(self, kind: str, name: str, entry: dict) -> bool:
        """Make an entry, whole and at once; False if there is one of this name."""
        fs, aside = self._at(f"{self.path}/{kind}/.{uuid.uuid4().hex}")
        stream = fs.create(aside, True)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        gateway = self.spark.sparkContext._gateway
        try:
            files = self._hadoop.FileContext.getFileContext(aside.toUri(), self.spark._jsc.hadoopConfiguration())
            files.rename(aside, self._hadoop.Path(f"{self.path}/{kind}/{name}"), gateway.new_array(gateway.jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as error:
            if "FileAlreadyExistsException" not in str(error):
                raise
            fs.delete(aside, False)
            return False
        return True

    def _write(self, rows: DataFrame) -> str:
        data = uuid.uuid4().hex
        _summed(rows).write.parquet(f"{self.path}/data/{data}")
        return data

    def _drop(self, data: str) -> None:
        fs, p = self._at(f"{self.path}/data/{data}")
        fs.delete(p, True)

    def _state(self) -> tuple[int, set[str], list[str]]:
        """Number of the last base, ids of all committed batches, and the tables that make up the totals."""
        bases, log = self._entries("base"), self._entries("log")
        last = max(map(int, bases), default=0)
        base = bases[str(last)] if last else {"data": None, "batches": []}
        held = set(base["batches"])
        tables = [*([base["data"]] if base["data"] else []), *(log[b]["data"] for b in sorted(log) if b not in held)]
        return last, held | set(log), tables

    def committed(self) -> list[str]:
        """Ids of the batches that count."""
        return sorted(self._state()[1])

    def commit(self, batch: str, rows: DataFrame) -> bool:
        """Sum signed rows and commit them as `batch`; False if it is there already, or another writer was first."""
        if not re.fullmatch(r"\w[\w.-]*", batch):
            raise ValueError(f"a batch id begins with a letter or digit and has letters, digits, dots and dashes only: {batch!r}")
        if batch in self._state()[1]:
            return False
        data = self._write(rows)
        if self._claim("log", batch, {"data": data}):
            return True
        self._drop(data)
        return False

    def _read(self, tables: list[str]) -> DataFrame:
        paths = [f"{self.path}/data/{t}" for t in tables]
        return self.spark.read.schema(DELTA).parquet(*paths) if paths else self.spark.createDataFrame([], DELTA)

    def compact(self) -> bool:
        """Sum all that is committed into the next base; False if another writer made that one.

        Entries of the log stay, as ids that count; tables that the new base replaces stay for readers that began before,
        until remove_replaced().
        """
        last, batches, tables = self._state()
        data = self._write(self._read(tables))
        if self._claim("base", str(last + 1), {"data": data, "batches": sorted(batches)}):
            return True
        self._drop(data)
        return False

    def remove_replaced(self) -> int:
        """Delete tables that the totals no longer read, attempts that were lost included. No commit may be under way."""
        fs, p = self._at(f"{self.path}/data")
        live = set(self._state()[2])
        gone = [n for s in (fs.listStatus(p) if fs.exists(p) else []) if (n := s.getPath().getName()) not in live]
        for n in gone:
            self._drop(n)
        return len(gone)

    def totals(self) -> DataFrame:
        """docs and tokens by key over all committed batches; keys without documents and tokens are left out."""
        return _summed(self._read(self._state()[2]))


def counted(docs: DataFrame, tokenizers: dict[str, str | None], text: str = "text") -> DataFrame:
    """Columns of docs but the text, tokenizer and tokens: a row for each document and version (a file, or None for words).

    Null and empty texts have 0 tokens and keep their row; repeated rows count each; an empty table gives none. Columns of
    docs must not be named tokenizer or tokens.
    """
    if clash := {"tokenizer", "tokens", "__text"} & set(docs.columns):
        raise ValueError(f"columns of docs that counted() adds itself: {sorted(clash)}")
    small_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != text]
    src = docs.select(*rest, F.col(text).alias("__text"))
    schema = src.drop("__text").withColumns({"tokenizer": F.lit(""), "tokens": F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = texts_of(b, "__text")
            for version, path in tokenizers.items():
                if path is None:
                    n = [len(t.split()) for t in texts]
                else:
                    n = [len(ids) // 4 for lo, hi in slabs(texts, 1 << 20) for ids in cache_for(path).ids(texts[lo:hi])]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.array([version] * b.num_rows, pa.string()), pa.array(n, pa.int64())], names=schema.names)

    return src.mapInArrow(run, schema)
