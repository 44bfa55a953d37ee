"""Asking a model from tasks that may run again.

Each reply is written to a store, under the digest of all that was asked, as soon as it is there; a task that runs again
after its calls finds the replies and asks nothing twice.  Stored replies of finished stages are gathered in one table, which
is joined to new prompts before any task asks.
"""

from __future__ import annotations

import hashlib
import inspect
import json
import threading
import time
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.documents import _file_system
from ..sources.versions import Folder, LatestRows
from ..tables import cut


class Provider(Protocol):
    """A model.  Must be picklable; it is used inside tasks.  The reply is a text, or its pieces as they come.

    A ``chat`` that takes ``options`` is told model, timeout, stream and max_output_tokens.
    """

    def chat(self, system: str, user: str) -> str | Iterable[str]: ...


@dataclass(frozen=True)
class Calls:
    """How a model is asked (L1, L2): ``in_flight`` calls of one task at a time, ``attempts`` for each, ``timeout`` seconds for an
    attempt.  ``store``: a folder that all executors share, for replies; without one nothing is remembered."""

    model: str = ""
    timeout: float = 60
    attempts: int = 3
    stream: bool = True
    max_output_tokens: int = 8192
    in_flight: int = 1
    store: str | None = None

    @property
    def options(self) -> dict:
        return {k: v for k, v in asdict(self).items() if k in ("model", "timeout", "stream", "max_output_tokens")}

    def head(self, system: str) -> str:
        """What stands before the prompt in all that is digested."""
        return json.dumps([self.model, self.max_output_tokens, system], ensure_ascii=False) + "\n"

    def digest(self, system: str, user: str) -> str:
        return hashlib.sha256((self.head(system) + user).encode()).hexdigest()

    def digest_of(self, system: str, user: Column) -> Column:
        return F.sha2(F.concat(F.lit(self.head(system)), user).cast("binary"), 256)


def _within(seconds: float, work: Callable[[], str]) -> str:
    """The result of work, or TimeoutError; a call that hangs is left to itself."""
    box: list = []

    def run():
        try:
            box.append((work(), None))
        except BaseException as e:  # noqa: BLE001  handed to the caller
            box.append((None, e))

    thread = threading.Thread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if not box:
        raise TimeoutError(f"no reply within {seconds:g} seconds")
    if box[0][1] is not None:
        raise box[0][1]
    return box[0][0]


def call(provider: Provider | None, system: str, user: str, calls: Calls = Calls(), wait: Callable[[float], None] | None = None) -> str:
    """The reply, or "" without a provider or after the last attempt; waits 2, 4, then 6 seconds between attempts (L1, L2)."""
    if provider is None:
        return ""
    wait, attempts = wait or time.sleep, max(1, calls.attempts)
    more = {"options": calls.options} if "options" in inspect.signature(provider.chat).parameters else {}

    def once() -> str:
        reply = provider.chat(system, user, **more) or ""
        return reply if isinstance(reply, str) else "".join(reply)

    for k in range(1, attempts + 1):
        try:
            return _within(calls.timeout, once)
        except Exception:  # a provider may fail in any way
            if k < attempts:
                wait(min(2 * k, 6))
    return ""


class Store:
    """One small file for each reply, by its digest; written whole or not at all."""

    def __init__(self, path: str):
        self.fs, self.root = _file_system(f"{path.rstrip('/')}/new")
        self.made: set[str] = set()

    def get(self, digest: str) -> str | None:
        try:
            with self.fs.open_input_stream(f"{self.root}/{digest[:2]}/{digest}") as f:
                return json.loads(f.read())["reply"]
        except FileNotFoundError:
            return None

    def put(self, digest: str, reply: str) -> None:
        folder = f"{self.root}/{digest[:2]}"
        if folder not in self.made:
            self.fs.create_dir(folder, recursive=True)
            self.made.add(folder)
        fresh = f"{folder}/.{digest}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(fresh) as f:
            f.write(json.dumps({"digest": digest, "reply": reply}, ensure_ascii=False).encode())
        self.fs.move(fresh, f"{folder}/{digest}")


def answers(provider: Provider, asked: list[tuple[str, str]], calls: Calls) -> list[str]:
    """Replies to (system, user), ``in_flight`` at a time and equal questions once; empty where none came.  Empty replies are not stored."""
    store = Store(calls.store) if calls.store else None

    def one(question: tuple[str, str]) -> str:
        digest = calls.digest(*question)
        known = store.get(digest) if store else None
        if known is not None:
            return known
        reply = call(provider, *question, calls)
        if store and reply:
            store.put(digest, reply)
        return reply

    unique = list(dict.fromkeys(asked))
    with ThreadPoolExecutor(max(1, calls.in_flight)) as pool:
        told = dict(zip(unique, pool.map(one, unique)))
    return [told[q] for q in asked]


def _table(spark: SparkSession, path: str) -> LatestRows:
    return LatestRows(spark, f"{path.rstrip('/')}/table", "digest", ["reply"])


def gather(spark: SparkSession, path: str) -> int:
    """Take the replies of finished stages into the store's table and remove their files; gives their number.  Not while tasks ask."""
    folder = Folder(spark, f"{path.rstrip('/')}/new")
    names = folder.names()
    if not names:
        return 0
    rows = cut(spark.read.schema("digest string, reply string").json([f"{folder.path}/{n}" for n in names]).where("digest is not null"))
    _table(spark, path).merge(rows)
    for n in names:
        folder.delete(n)
    return rows.count()


class _Watch:
    """Tells (done, total) while a stage asks: what its finished tasks have counted and, with a store, each reply as it is stored."""

    def __init__(self, told: Callable[[int, int], None], total: int, counts: list[Callable[[], int]], every: float):
        self.told, self.total, self.counts, self.every = told, total, counts, every
        self.stop, self.last = threading.Event(), -1

    def look(self) -> None:
        done = min(self.total, max(c() for c in self.counts))
        if done > self.last:
            self.last = done
            self.told(done, self.total)

    def __enter__(self):
        def run():
            while not self.stop.wait(self.every):
                self.look()

        self.look()
        self.thread = threading.Thread(target=run, daemon=True)
        self.thread.start()

    def __exit__(self, *_):
        self.stop.set()
        self.thread.join()
        self.look()


def ask(prompts: DataFrame, provider: Provider, system: str, callers: int = 2, calls: Calls = Calls(), keys: dict[str, str] | None = None, out: str = "reply", told: Callable[[int, int], None] | None = None, every: float = 1.0) -> DataFrame:
    """(keys, reply) for each row (keys, prompt) whose prompt is not blank, written so that nothing asks again.

    ``keys``: name -> type, ``doc_id long`` if left out.  Prompts that the store's table answers reach no task that asks; the rest are
    dealt to ``callers`` tasks by digest, which brings equal prompts together, so each is asked once.  ``told`` hears (done, total) of
    the rows to ask about every ``every`` seconds while the tasks run.
    """
    keys = keys or {"doc_id": "long"}
    rows = prompts.select(*[F.col(k).cast(t).alias(k) for k, t in keys.items()], "prompt").where("trim(prompt) <> ''").withColumn("digest", calls.digest_of(system, F.col("prompt")))
    spark, known = prompts.sparkSession, None
    if calls.store:
        gather(spark, calls.store)
        table = _table(spark, calls.store)
        if table.pointer()["schema"] is not None:
            rows = cut(rows)
            held = table.read().select("digest", "reply").join(rows.select("digest").distinct(), "digest", "left_semi")
            known = rows.join(held, "digest").select(*keys, F.col("reply").alias(out))
            rows = rows.join(held.select("digest"), "digest", "left_anti")

    spark_count = spark.sparkContext.accumulator(0)

    def run(frames):
        for pdf in frames:
            for at in range(0, len(pdf), step := 16 * max(1, calls.in_flight)):
                part = pdf.iloc[at : at + step].copy()
                part[out] = answers(provider, [(system, p) for p in part["prompt"]], calls)
                spark_count.add(len(part))
                yield part[[*keys, out]]

    kind = ", ".join([f"{k} {t}" for k, t in keys.items()] + [f"{out} string"])
    asking = rows.repartition(callers, "digest").select(*keys, "prompt").mapInPandas(run, kind)
    if told is None:
        new = cut(asking)
    else:
        counts = [lambda: spark_count.value]
        if calls.store:
            folder = Folder(spark, f"{calls.store.rstrip('/')}/new")
            counts.append(lambda: sum(not f.startswith(".") for n in folder.names() for f in folder.names(n)))
        with _Watch(told, rows.count(), counts, every):
            new = cut(asking)
    return new if known is None else new.unionByName(known)
