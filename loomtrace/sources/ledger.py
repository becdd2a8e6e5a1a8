"""Completions that are asked for once, whatever happens to the task or the run.

Every answer is written to a ledger as it comes: a small file of the task's attempt, put in place by a rename. A task that runs again reads what earlier attempts
have answered and asks for the rest; so does a run that is started again with the same ledger. Slots are dealt to buckets by hash of their key, so an answer is found
again however many tasks there are; a finished bucket's files become one.

A bucket's slots come in the order of their names, and so do the answers of an attempt's files. So a task reads what stands beside its slots and merges files as it goes:
it holds ``every`` answers and a line of each attempt's file, however many answers a bucket has.

The ledger is a folder that driver and executors reach by one address: a path, or an address of a store that pyarrow opens (file, s3, gs, hdfs).
A slot is known by its key columns and its prompt: another prompt is another question. With speculative execution two attempts
may ask at the same time; leave it off.
"""

from __future__ import annotations

import heapq
import io
import json
import time
import uuid
from collections.abc import Callable, Iterator
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .completions import BASE_DELAY, RETRIES, NotConfigured, no_llm

BUCKETS = 256
LINE = 100  # answers in a line of a file


def tried(call: Callable[[str], str], prompt: str, retries: int, base_delay: float, sleep: Callable[[float], None]) -> tuple[str | None, str | None, int]:
    """Completion, error and attempts. Pauses grow, and none of 0 s is made; a missing set-up ends the run."""
    error = None
    for attempt in range(retries):
        try:
            return call(prompt), None, attempt + 1
        except NotConfigured:
            raise
        except Exception as e:  # noqa: BLE001
            error = f"{type(e).__name__}: {e}"
            if base_delay:  # a sleep of 0 s takes some 0.1 ms, more than all else that a slot takes
                sleep(base_delay * 2**attempt)
    return None, error, retries


class Bucket:
    """The answers of a bucket of slots, in the order of their names: those of earlier attempts, and those of this one."""

    def __init__(self, ledger: str, number: int, every: int) -> None:
        self.every, self.waiting, self.n_files = every, {}, 0
        self.store, root = fs.FileSystem.from_uri(ledger)
        self.folder = f"{root}/bucket-{number:05d}"
        self.store.create_dir(self.folder, recursive=True)
        self.attempt = self._attempt()
        self.files = sorted(f.path for f in self.store.get_file_info(fs.FileSelector(self.folder)) if f.path.endswith(".json"))
        self.earlier = self._merged()
        self.now = next(self.earlier, None)

    @staticmethod
    def _attempt() -> str:
        return f"{time.time_ns():020d}-{uuid.uuid4().hex}"

    def _read(self, paths: list[str]) -> Iterator[tuple[str, list]]:
        """Answers of an attempt's files; a line holds an object of some."""
        for path in paths:
            with self.store.open_input_stream(path) as held:
                for line in io.BufferedReader(held):
                    yield from sorted(json.loads(line).items())

    def _merged(self) -> Iterator[tuple[str, list]]:
        """The answers of all files by name, the oldest of each. An attempt's files are numbered and read one after another; files without a number have no order and are held."""
        chains: dict[str, list[str]] = {}
        loose: dict[str, list] = {}
        for path in self.files:
            attempt, _, place = path.rpartition("-")
            if len(place) == len("00000000.json"):
                chains.setdefault(attempt, []).append(path)
            else:
                for name, answer in self._read([path]):
                    loose.setdefault(name, answer)
        last = None
        for name, answer in heapq.merge(sorted(loose.items()), *map(self._read, chains.values()), key=lambda x: x[0]):
            if name != last:
                yield name, answer
            last = name

    def _put(self, path: str, answers: Iterator[tuple[str, list]]) -> None:
        with self.store.open_output_stream(f"{path}.part") as out:
            while some := dict(islice(answers, LINE)):
                out.write(json.dumps(some).encode() + b"\n")
        self.store.move(f"{path}.part", f"{path}.json")
        self.files.append(f"{path}.json")

    def _join(self, path: str) -> None:
        """The files of this attempt alone stand in the order of names: their bytes go one after another."""
        with self.store.open_output_stream(f"{path}.part") as out:
            for own in self.files:
                with self.store.open_input_stream(own) as held:
                    while some := held.read(1 << 20):
                        out.write(some)
        self.store.move(f"{path}.part", f"{path}.json")
        self.files.append(f"{path}.json")

    def find(self, name: str) -> list | None:
        """The answer to a name, which must not come before the names asked for so far."""
        while self.now and self.now[0] < name:
            self.now = next(self.earlier, None)
        return self.now[1] if self.now and self.now[0] == name else None

    def add(self, name: str, answer: list) -> None:
        self.waiting[name] = answer
        if len(self.waiting) >= self.every:
            self.keep()

    def keep(self) -> None:
        if self.waiting:
            self._put(f"{self.folder}/{self.attempt}-{self.n_files:08d}", iter(self.waiting.items()))
            self.n_files, self.waiting = self.n_files + 1, {}

    def close(self) -> None:
        """One file for all; the others go once it stands."""
        self.keep()
        self.earlier.close()
        if len(self.files) > 1:
            old = list(self.files)
            path = f"{self.folder}/{self._attempt()}-{0:08d}"
            if all(p.startswith(f"{self.folder}/{self.attempt}-") for p in old):
                self._join(path)
            else:
                self._put(path, self._merged())
            for path in old:
                self.store.delete_file(path)
            self.files = self.files[len(old) :]


def complete_once(
    slots: DataFrame, prompt: str, keys: list[str], ledger: str, call: Callable[[str], str] = no_llm, retries: int = RETRIES, base_delay: float = BASE_DELAY, pause: float = 0.0,
    sleep: Callable[[float], None] = time.sleep, buckets: int = BUCKETS, every: int = 1,
) -> DataFrame:
    """Adds completion, error and attempts; each slot is asked for ``retries`` times at most in all runs that share the ledger. A slot that has failed stays failed there.

    A null prompt gets no question, but an error. Repeated slots share an answer. every: answers that a file takes; an executor that is lost loses those that wait for theirs.
    """
    known = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    # A slot's name in the ledger.
    name = F.sha2(F.concat("__key", F.lit("\n"), F.col(prompt).cast("string")).cast("binary"), 256)
    dealt = slots.withColumn("__key", known).withColumn("__bucket", F.pmod(F.xxhash64("__key"), F.lit(buckets)).cast("int")).withColumn("__name", name).drop("__key")
    # By number: hashed, some tasks would get three buckets and others none.
    dealt = dealt.repartitionById(min(buckets, 4 * int(slots.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "__bucket").sortWithinPartitions("__bucket", "__name")
    columns = slots.columns

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, bucket, last, answer = None, None, None, []
        try:
            for part in parts:
                out = []
                for at, name, text in zip(*(part.column(c).to_pylist() for c in ("__bucket", "__name", prompt)), strict=True):
                    if at != number:
                        if bucket:
                            bucket.close()
                        number, bucket, last = at, Bucket(ledger, at, every), None
                    if text is None:
                        out.append([None, "no prompt", 0])
                        continue
                    if name != last:
                        last, answer = name, bucket.find(name)
                        if answer is None:
                            answer = list(tried(call, text, retries, base_delay, sleep))
                            bucket.add(name, answer)
                            if pause:
                                time.sleep(pause)
                    out.append(answer)
                said = [pa.array([a[i] for a in out], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int32()))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), *said], names=[*columns, "completion", "error", "attempts"])
            if bucket:
                bucket.close()
        finally:
            if bucket:
                bucket.keep()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slots.schema.fields)
    return dealt.mapInArrow(run, f"{fields}, completion string, error string, attempts int")
