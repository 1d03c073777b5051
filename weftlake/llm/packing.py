"""Packing into fixed windows by the sum-of-squares rule (operator 9).

Each document's ids are cut into whole windows and a rest; each rest goes at once to the fill
level that makes the sum, over levels, of (number of windows partly filled to that level)
squared the least, or opens a window. The state is an array of counts by level and the open
windows themselves. Only rests wait in open windows, so a task holds at most the ids of its
own part of the input, and few where lengths vary; no window is closed early. When a task
ends, the emptiest open windows are cut up to top up the fullest: one window a task is padded.

Tokenizing and packing happen in the scan's tasks. Nothing is shuffled, a task that is run
again gives the same rows, and sequence ids are unique by the task's partition.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from weftlake.llm.bpe import vocabulary
from weftlake.llm.common import documents, idle, text_or_empty, text_runs

WINDOW = 2048
END_ID = 1
#: Fixed value: the pattern of the word-level vocabulary file.
UNITS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: Marks that, at the end of a run and behind letters only, are one unit.
MARKS = ".,;:!?"
#: Megabytes of a worker's caches of runs and of units, about: larger ones save time, not results. A cache that
#: is full starts anew. Runs and units longer than KEPT_CHARS are encoded each time.
CACHE_MB, STAGE_CACHE_MB = 320, 80
KEPT_CHARS = 64
#: Bytes of a cache entry besides its strings, about.
ENTRY = 200
ROWS_OUT = 20_000


class CachedTokenizer:
    """A tokenizers file behind bounded caches. Its pattern drops white space and no match crosses it,
    so a text's ids are those of its blank-separated runs in order. A run of letters below U+0250
    (where lower case and composition are the same everywhere) is split by the file's pattern,
    and each new unit is encoded once, many to a call: every unit ends in the one id of it that
    closes a word. Other runs, and any with a special token's bracket, go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        suffix = spec["model"]["end_of_word_suffix"]
        self.closes = {i for w, i in spec["model"]["vocab"].items() if w.endswith(suffix)}
        self.split = regex.compile(UNITS)
        self.known: dict[str, bytes] = {"": b""}
        self.units: dict[str, bytes] = {"": b""}
        self.known_bytes = self.unit_bytes = 0
        self.limit(CACHE_MB)

    def limit(self, megabytes: float) -> None:
        """Bound the caches: three fifths for runs, the rest for units."""
        self.most_known, self.most_units = megabytes * 600_000, megabytes * 400_000

    def _encode(self, units: list[str]) -> None:
        """Encode new units, joined by blanks, into the cache."""
        for i in range(0, len(units), 512):
            part = units[i : i + 512]
            (e,) = self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)
            found, ids = [], []
            for t in e.ids:
                ids.append(t)
                if t in self.closes:
                    found.append(ids)
                    ids = []
            if len(found) != len(part) or ids:
                found = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            for w, x in zip(part, found):
                self.units[w] = array("I", x).tobytes()
                self.unit_bytes += 2 * len(w) + ENTRY

    def _units(self, run: str) -> list[str] | None:
        """The units of a run in lower case, None if the library has to see it whole."""
        if "<|" in run or not (run.isascii() or max(run) < "\u0250"):
            return None
        return self.split.findall(run.lower())

    def learn(self, runs: list[str]) -> None:
        """Add the ids of new runs to the cache. Most are letters with a mark or two at the end
        (but U+0130 becomes two characters in lower case, the second no letter)."""
        words, others, rest = [], {}, []
        for w in runs:
            core = w.rstrip(MARKS)
            if core.isalpha() and (core.isascii() or (max(core) < "\u0250" and "\u0130" not in core)):
                words.append((w, core.lower(), w[len(core) :]))
            elif (parts := self._units(w)) is not None:
                others[w] = parts
            else:
                rest.append(w)
        need = {x for _, x, _ in words}.union({x for _, _, x in words}, *others.values())
        need.discard("")
        if self.unit_bytes > self.most_units:
            self.units, self.unit_bytes = {"": b""}, 0
        new = list(need.difference(self.units))
        self._encode(new)
        known, ids_of = self.known, self.units.__getitem__
        for w, core, tail in words:
            known[w] = ids_of(core) + ids_of(tail) if tail else ids_of(core)
        for w, parts in others.items():
            known[w] = b"".join(map(ids_of, parts))
        for w, e in zip(rest, self.tokenizer.encode_batch(rest, add_special_tokens=False)):
            known[w] = array("I", e.ids).tobytes()
        for w in [w for w in new if len(w) > KEPT_CHARS]:
            del self.units[w]
            self.unit_bytes -= 2 * len(w) + ENTRY

    def encode_batch(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = [t.replace("\n", " ").split(" ") for t in texts]
        if self.known_bytes > self.most_known:
            self.known, self.known_bytes = {"": b""}, 0
        new = list(set().union(*split).difference(self.known))
        self.learn(new)
        self.known_bytes += 2 * sum(map(len, new)) + ENTRY * len(new)
        ids_of = self.known.__getitem__
        for words in split:
            yield b"".join(map(ids_of, words))
        for w in [w for w in new if len(w) > KEPT_CHARS]:
            del self.known[w]
            self.known_bytes -= 2 * len(w) + ENTRY


_loaded: dict[str, CachedTokenizer] = {}


def loaded(path: str) -> CachedTokenizer:
    if path not in _loaded:
        _loaded[path] = CachedTokenizer(path)
    return _loaded[path]


class SumOfSquares:
    """Online packing. Finished rows are (doc_id, start, length, crc, doc_tokens, sequence, offset)."""

    def __init__(self, window: int = WINDOW, first_sequence: int = 0):
        self.window, self.next = window, first_sequence
        self.count = np.zeros(window + 1, dtype=np.int64)  # open windows by fill level
        self.open: list[list[list]] = [[] for _ in range(window)]  # the windows of each level
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: bytes) -> None:
        """Cut a document's ids into whole windows and place the rest."""
        total, size = len(ids) // 4, 4 * self.window
        whole = len(ids) // size * size
        for at in range(0, whole, size):
            self._close([(doc_id, at // 4, ids[at : at + size], total)])
        if len(ids) > whole:
            self._place((doc_id, whole // 4, ids[whole:], total))

    def level_for(self, size: int) -> int:
        """The level to fill up, 0 for a new window; the fullest of those that tie."""
        count, full = self.count, self.window
        best, cost = 0, 2 * count[size] + 1
        here = count[1 : full - size]
        if len(here):
            change = np.where(here > 0, 2 * (count[1 + size : full] - here) + 2, np.iinfo(np.int64).max)
            at = len(change) - 1 - int(change[::-1].argmin())
            if change[at] <= cost:
                best, cost = at + 1, change[at]
        if count[full - size] and 1 - 2 * count[full - size] <= cost:
            best = full - size
        return best

    def _place(self, piece: tuple) -> None:
        size = len(piece[2]) // 4
        level = self.level_for(size)
        held = self.open[level].pop() if level else []
        if level:
            self.count[level] -= 1
        held.append(piece)
        if level + size == self.window:
            self._close(held)
            return
        self.open[level + size].append(held)
        self.count[level + size] += 1

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, zlib.crc32(ids), total, self.next, offset))
            offset += n
        self.next += 1

    def flush(self) -> None:
        """Top up the fullest open windows with pieces of the emptiest; close them all."""
        windows = [(level, held) for level in range(self.window - 1, 0, -1) for held in self.open[level]]
        self.open = [[] for _ in range(self.window)]
        self.count[:] = 0
        i, j = 0, len(windows) - 1
        while i <= j:
            level, held = windows[i]
            while level < self.window and j > i:
                donor = windows[j][1]
                doc_id, start, ids, total = donor.pop()
                room = 4 * (self.window - level)
                held.append((doc_id, start, ids[:room], total))
                level += min(len(ids), room) // 4
                if len(ids) > room:
                    donor.append((doc_id, start + room // 4, ids[room:], total))
                if not donor:
                    j -= 1
            self._close(held)
            i += 1


def pack(docs: DataFrame, window: int = WINDOW, vocab_path: str | None = None, end_id: int = END_ID, cache_mb: float = CACHE_MB) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    docs needs doc_id and text; other columns are ignored, whatever their names. A null or
    empty text is the end id alone. Repeated rows are packed each. A document of any length
    is packed whole. An empty table gives no piece. cache_mb bounds a worker's caches; it changes
    the time, not the result.
    """
    path = vocab_path or vocabulary("word_bpe_49k.json")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    id_type = rows.schema["doc_id"].dataType

    def run(batches):
        tokens, end = loaded(path), array("I", [end_id]).tobytes()
        tokens.limit(cache_mb)
        packer = SumOfSquares(window, TaskContext.get().partitionId() << 40)
        kind = None

        def out():
            cols = list(zip(*packer.rows))
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *[pa.array(c, pa.int64()) for c in cols[1:]]], names)

        for batch in batches:
            kind = batch.column("doc_id").type
            ids = iter(batch.column("doc_id").to_pylist())
            for _, texts in text_runs(batch):
                for coded in tokens.encode_batch(texts):
                    packer.add(next(ids), coded + end)
                if len(packer.rows) >= ROWS_OUT:
                    yield out()
        packer.flush()
        if packer.rows:
            yield out()
        del packer
        idle()

    schema = f"doc_id {id_type.simpleString()}, " + ", ".join(f"`{n}` long" for n in names[1:])
    return rows.mapInArrow(run, schema)


def op9(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
