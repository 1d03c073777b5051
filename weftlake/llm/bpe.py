"""Byte-level BPE by prefix-sharing trie traversal (operator 5).

Every prefix of a word has one encoding, and all that later bytes need of it is its last
token: a prefix ends in the token t exactly if the prefix before t ends in a token that may
stand before t, and two tokens may stand together exactly if merging their joined bytes gives
them back. The distinct words of a batch are sorted, which is the order in which a depth-first
walk of their trie visits them; the walk keeps the last token of each byte of the current path,
so a prefix that many words share is encoded once. Encodings of words are kept between
batches in a cache bounded by bytes. Texts are split, encoded and decoded whole, in Arrow batches.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from weftlake.llm.common import documents, idle, text_or_empty, text_runs

#: White space as the tokenizer's pattern sees it (Unicode White_Space).
_S = r"\t-\r \x85\xa0  -     　"
#: The public splitting pattern of byte-level BPE, with white space spelled out.
SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+")

#: Bytes of a worker's word cache and entries of its cache of token pairs, about; beyond, a cache starts anew.
#: Words longer than KEPT_CHARS are encoded each time.
CACHED_BYTES = 60_000_000
CACHED_PAIRS = 500_000
KEPT_CHARS = 64
#: Bytes of a cache entry besides its strings, about.
ENTRY = 200


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabulary files."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class TrieBpe:
    """Encoder and decoder for a byte-level BPE vocabulary in the tokenizers JSON format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, model = byte_alphabet(), spec["model"]
        raw = {name: bytes(alphabet[c] for c in name) for name in model["vocab"]}
        self.token = {raw[name]: i for name, i in model["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = 1 + max([*model["vocab"].values(), *self.special.values()])
        self.bytes_of = [b""] * size
        for b, i in self.token.items():
            self.bytes_of[i] = b
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        self.longest = max(map(len, self.token))
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = model["vocab"]
        self.merge = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(merges)}
        self.by_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.held = 0

    def merged(self, data: bytes) -> list[int]:
        """Plain BPE: the lowest-ranked merge, leftmost first, until none is left."""
        ids = [self.token[data[i : i + 1]] for i in range(len(data))]
        while len(ids) > 1:
            best = min((self.merge[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.merge) if any(p in self.merge for p in zip(ids, ids[1:])) else None
            if best is None:
                break
            i = best[1]
            ids[i : i + 2] = [self.merge[ids[i], ids[i + 1]][1]]
        return ids

    def may_meet(self, a: int, b: int) -> bool:
        known = self.pairs.get(a << 32 | b)
        if known is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            known = self.pairs[a << 32 | b] = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def learn(self, words: set[str]) -> None:
        """Encode the words in one walk of their trie, into the cache."""
        token, longest, may_meet, bytes_of = self.token.get, self.longest, self.may_meet, self.bytes_of
        pairs = self.pairs.get
        last: list[int] = [-1]  # last[i]: the last token of the first i bytes of the path
        before = b""
        for data, word in sorted((w.encode(), w) for w in words):
            shared = 0
            for x, y in zip(before, data):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(data) + 1):
                for start in range(max(0, end - longest), end):
                    t = token(data[start:end])
                    if t is not None and (start == 0 or pairs(last[start] << 32 | t) or may_meet(last[start], t)):
                        last.append(t)
                        break
            ids, at = [], len(data)
            while at:
                ids.append(last[at])
                at -= len(bytes_of[last[at]])
            self.words[word] = array("I", ids[::-1]).tobytes()
            before = data

    def _parts(self, text: str) -> list[str]:
        return self.by_special.split(text) if self.by_special else [text]

    def encode_batch(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = []
        for text in texts:
            words: list[str] = []
            for i, part in enumerate(self._parts(text)):
                words += [part] if i % 2 else SPLIT.findall(part)
            split.append(words)
        if self.held > CACHED_BYTES:
            self.words.clear()
            self.held = 0
        for s, i in self.special.items():
            self.words[s] = array("I", [i]).tobytes()
        new = set().union(*split).difference(self.words)
        self.learn(new)
        self.held += sum(map(len, new)) * 2 + ENTRY * len(new)
        ids_of = self.words.__getitem__
        for words in split:
            yield b"".join(map(ids_of, words))
        for w in [w for w in new if len(w) > KEPT_CHARS and w not in self.special]:
            del self.words[w]
            self.held -= 2 * len(w) + ENTRY

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, array("I", ids))).decode("utf-8", "replace")


_loaded: dict[str, TrieBpe] = {}


def loaded(path: str) -> TrieBpe:
    """One coder a worker and vocabulary."""
    if path not in _loaded:
        _loaded[path] = TrieBpe(path)
    return _loaded[path]


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file, the same on the driver and every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_decode(docs: DataFrame, vocab_path: str | None = None) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes.

    docs needs doc_id and text; other columns are ignored, whatever their names. A null text
    counts as empty: no token, the digests of nothing. Strings of special tokens in a text
    become those tokens. Texts of any length are encoded whole; repeated rows are encoded each.
    An empty table gives an empty result. vocab_path is a vocabulary file that every executor has.
    """
    path = vocab_path or vocabulary("byte_bpe_50k.json")

    def run(batches):
        bpe = loaded(path)
        for batch in batches:
            out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": [], "n_bytes": []}
            for _, texts in text_runs(batch):
                for ids in bpe.encode_batch(texts):
                    decoded = bpe.decode(ids).encode()
                    out["n_tokens"].append(len(ids) // 4)
                    out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
                    out["n_bytes"].append(len(decoded))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(out["n_tokens"], pa.int64()), pa.array(out["ids_sha256"], pa.string()), pa.array(out["decoded_sha256"], pa.string()), pa.array(out["n_bytes"], pa.int64())],
                ["doc_id", *out],
            )
        idle()

    rows = docs.select("doc_id", text_or_empty().alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long")


def op5(spark, sf_dir: str) -> DataFrame:
    return encode_decode(documents(spark, sf_dir))
