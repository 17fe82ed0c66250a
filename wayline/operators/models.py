"""Model calls: messages go out concurrently within a partition, pictures are read and encoded only by the task that sends them."""

from __future__ import annotations

import base64
import queue
import threading
import time
from collections import OrderedDict
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Message = list[tuple[str, str]]
Ask = Callable[[str, Message], str]


def offline_answer(system: str, message: Message) -> str:
    """Stands in for a model: says how much it was given."""
    return f"{len(message)} parts, {sum(len(c) for k, c in message if k == 'text')} characters, {sum(k != 'text' for k, _ in message)} pictures"


def read_file(path: str) -> bytes:
    """The bytes of a plain path or file: URI that the executors can open; other stores need a reader of their own."""
    with open(unquote(urlparse(path).path) if path.startswith("file:") else path, "rb") as f:
        return f.read()


class Pictures:
    """Data URIs by path, the latest used ones kept up to a number of bytes. Threads share one; a picture that can't be read is None."""

    def __init__(self, read: Callable[[str], bytes], most_bytes: int):
        self.read, self.most, self.held = read, most_bytes, 0
        self.kept: OrderedDict[str, str] = OrderedDict()
        self.lock = threading.Lock()

    def uri(self, path: str) -> str | None:
        with self.lock:
            if path in self.kept:
                self.kept.move_to_end(path)
                return self.kept[path]
        try:
            found = "data:image/png;base64," + base64.b64encode(self.read(path)).decode()
        except OSError:
            return None
        with self.lock:
            if path not in self.kept:
                self.kept[path] = found
                self.held += len(found)
            while self.held > self.most:
                self.held -= len(self.kept.popitem(last=False)[1])
        return found


class Caller:
    """Answers messages by up to ``pool`` clients at once. Clients are made when they are needed and used again."""

    def __init__(self, system: str, client: Callable[[], Ask], pool: int, tries: int, wait: float, pictures: Pictures | None):
        self.system, self.client, self.tries, self.wait, self.pictures = system, client, tries, wait, pictures
        self.idle: queue.SimpleQueue[Ask] = queue.SimpleQueue()
        self.threads = ThreadPoolExecutor(pool)

    def message(self, parts: list[dict]) -> Message:
        """With pictures as data URIs. One that can't be read leaves its placeholder as text where it has a slot, else nothing."""
        out: Message = []
        for p in parts:
            content = p["content"]
            if p["type"] == "text" or self.pictures is None:
                out.append((p["type"], content))
            elif (found := self.pictures.uri(content)) is not None:
                out.append((p["type"], found))
            elif p["slot"] is not None:
                out.append(("text", f"`{p['slot']}`"))
        return out

    def ask(self, message: Message) -> str:
        try:
            own = self.idle.get_nowait()
        except queue.Empty:
            own = self.client()
        try:
            return own(self.system, message)
        finally:
            self.idle.put(own)

    def answer(self, devid: object, parts: list[dict]) -> tuple:
        try:
            message = self.message(parts)
            for left in reversed(range(self.tries)):
                try:
                    return devid, self.ask(message), None, None
                except OSError:
                    if not left:
                        raise
                    time.sleep(self.wait * 2 ** (self.tries - 1 - left))
        except OSError as e:
            return devid, None, "api", str(e)
        except Exception as e:  # noqa: BLE001  whatever it is, it belongs to this row
            return devid, None, "general", str(e)
        raise ValueError("tries must be 1 or more")


def answers(
    parts: DataFrame, system: str, client: Callable[[], Ask] = lambda: offline_answer, pool: int = 32, tries: int = 3, wait: float = 0.5, read: Callable[[str], bytes] | None = None, cache_bytes: int = 64 << 20
) -> DataFrame:
    """devid, response, error_kind, error: a model's answer to every message (devid, pos, type, content, and slot if it is known).

    A partition has up to ``pool`` calls under way at once; ``client`` gives a function that answers, one for each of these, and
    credentials are its own matter. A call that raises OSError is tried ``tries`` times, after ``wait`` seconds, then twice as long. What fails
    in the end gives its row an error ('api' for OSError, else 'general') and never the job. With ``read`` the content of a picture's
    part is a path: the calling task reads it and sends a data URI, kept for others up to ``cache_bytes`` a task; no picture is shuffled. A
    message must fit a task, ``pool`` of them with their pictures its memory.
    """
    slot = F.col("slot") if "slot" in parts.columns else F.lit(None).cast("string").alias("slot")
    each = parts.groupBy("devid").agg(F.array_sort(F.collect_list(F.struct("pos", "type", "content", slot.alias("slot")))).alias("parts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        caller = Caller(system, client, pool, tries, wait, Pictures(read, cache_bytes) if read else None)
        with caller.threads:
            for b in batches:
                yield pd.DataFrame(list(caller.threads.map(caller.answer, b["devid"], b["parts"])), columns=["devid", "response", "error_kind", "error"])

    return each.mapInPandas(run, f"devid {parts.schema['devid'].dataType.simpleString()}, response string, error_kind string, error string")
