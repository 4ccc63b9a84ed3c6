"""A commit log for batches that write several tables of files.

A batch is staged by Spark's own writers below ``<base>/_staging``, which
readers skip. Its manifest, put in place by one atomic rename, names every
staged folder of files and its place; from then on the batch counts. The
folders are then moved, each as a whole or, where the place has one already,
file by file (Spark's file names are unique), and a marker says so. Whoever opens the log first finishes what a
killed driver left: a batch with a manifest is moved on, one without has
left nothing that a reader sees. A batch id that has a manifest is not
written again, so a batch run twice stands in the tables once, and the first
of two drivers with the same id wins.

Manifests hold names and a small state (a dict), no data. Of numbered batches
the last ``keep`` manifests are kept; the newest has the state.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.files import Files


class CommitLog:
    def __init__(self, spark: SparkSession, base_dir: str, log_dir: str | None = None, keep: int = 1000):
        self.spark, self.files, self.keep = spark, Files(spark), keep
        self.base = base_dir.rstrip("/")
        self.log = (log_dir or f"{self.base}/_commits").rstrip("/")
        self.recover()

    # ---- reading the log
    def _manifests(self) -> list[str]:
        return [n for n in self.files.names(self.log) if n.endswith(".json") and not n.startswith(".")]

    @staticmethod
    def _name(batch_id: int | str) -> str:
        """The newest commit is the last name: numbered batches sort by number, a name says its own place."""
        return f"{batch_id:020d}" if isinstance(batch_id, int) else str(batch_id)

    def committed(self, batch_id: int | str) -> bool:
        return self.files.exists(f"{self.log}/{self._name(batch_id)}.json")

    def state(self) -> dict:
        """The state that the last commit left; empty before the first."""
        names = self._manifests()
        return json.loads(self.files.read(f"{self.log}/{names[-1]}"))["state"] if names else {}

    def recover(self) -> None:
        """Finish the moves of every batch whose manifest stands without its marker."""
        names = set(self.files.names(self.log))
        for n in sorted(names):
            if n.endswith(".json") and not n.startswith(".") and n.replace(".json", ".done") not in names:
                self._move(n)

    def _move(self, name: str) -> None:
        told = json.loads(self.files.read(f"{self.log}/{name}"))
        for source, target in told["moves"]:
            self._move_folder(f"{self.base}/{source}", f"{self.base}/{target}")
        self.files.write(f"{self.log}/{name.replace('.json', '.done')}", "")
        self.files.remove(f"{self.base}/{told['staging']}")

    def _move_folder(self, source: str, target: str) -> None:
        """Nothing to do if an earlier attempt has moved it; another driver may be doing the same."""
        self.files.folder(target.rpartition("/")[0])
        if not self.files.exists(target):
            self.files.move(source, target)
            return
        for f in self.files.files_below(source):
            self.files.move(f"{source}/{f}", f"{target}/{f}")

    # ---- writing
    def begin(self, batch_id: int | str) -> Batch | None:
        """A batch to write, or None if this id is committed."""
        return None if self.committed(batch_id) else Batch(self, batch_id)

    def _commit(self, batch: Batch, state: dict) -> bool:
        name = f"{self._name(batch.id)}.json"
        moves = []
        for folder in batch.folders:
            top = f"{batch.staging}/{folder}"
            held = {f.rpartition("/")[0] for f in self.files.files_below(f"{self.base}/{top}")}
            moves += [[f"{top}/{f}" if f else top, f"{folder}/{f}" if f else folder] for f in sorted(held)]
        told = {"staging": batch.staging, "moves": moves, "state": state}
        draft = f"{self.log}/.{batch.token}.json"
        self.files.folder(self.log)
        self.files.write(draft, json.dumps(told))
        if not self.files.rename_new(draft, f"{self.log}/{name}"):
            self.files.remove(draft)
            self.files.remove(f"{self.base}/{batch.staging}")
            return False
        self._move(name)
        for old in [n for n in self._manifests() if n[:20].isdigit()][:-self.keep]:
            self.files.remove(f"{self.log}/{old}")
            self.files.remove(f"{self.log}/{old.replace('.json', '.done')}")
        return True


class Batch:
    """One attempt at a batch: tables staged by Spark, published together by ``commit``."""

    def __init__(self, log: CommitLog, batch_id: int | str):
        self.log, self.id, self.token = log, batch_id, uuid.uuid4().hex[:12]
        self.staging = f"_staging/{CommitLog._name(batch_id)}-{self.token}"
        self.folders: list[str] = []

    def write(self, df: DataFrame, folder: str, fmt: str = "parquet", partition_by: tuple[str, ...] = (), **options) -> str:
        """Stage ``df`` for ``<base>/<folder>``; returns the staged path, which may be read before the commit."""
        path = f"{self.log.base}/{self.staging}/{folder}"
        writer = df.write.mode("overwrite").format(fmt).options(**options)
        (writer.partitionBy(*partition_by) if partition_by else writer).save(path)
        if folder not in self.folders:
            self.folders.append(folder)
        return path

    def commit(self, state: dict | None = None) -> bool:
        """Publish everything staged; False if another attempt at the same id was first."""
        return self.log._commit(self, state or {})
