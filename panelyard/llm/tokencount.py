"""Token counts with a whole-token shortcut.

Some vocabulary strings, met as a whole pre-token, are one token: their merges lead to the string
itself.  Which ones is proved once per process by running every vocabulary string through the merge
model.  Counting then splits a text as the tokenizer does, adds one for each pre-token in the proven
set and runs the merge model only on the rest, each distinct one once per task.

The splitting here is that of a lower-casing word tokenizer: special strings are cut out first (each
is one token), the pieces are normalized (NFC, white space, lower case) and split by the pattern in
the tokenizer's file.

Defined results: a null text counts as empty, with 0 bytes and 0 tokens; texts are taken whole at
any length; repeated rows are counted alike; an empty table gives an empty result.  Extra columns
are ignored.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from .common import in_arrow, slices, table
from .pretoken import splitter

#: Tokens that fit the model's context.
LIMIT = 2048
#: Pre-tokens whose counts a task remembers.
REMEMBER = 500_000

SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"

#: Below U+0250 every character is in NFC and lower-cases alike in Python and in the library.
_BEYOND = re.compile("[^\x00-ɏ]")


class Counter(dict):
    """Pre-token -> number of tokens; computes what it does not know yet."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.bytes_to_chars = _byte_chars()
        self.chars_to_bytes = {c: b for b, c in self.bytes_to_chars.items()}
        special = [re.escape(t["content"]) for t in spec["added_tokens"]]
        self.special = re.compile("|".join(special))
        self.split = splitter(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.suffix = spec["model"]["end_of_word_suffix"]
        self.whole = frozenset(self._proven(spec["model"]["vocab"]))

    def _proven(self, vocab: dict[str, int]) -> Iterator[str]:
        """Vocabulary strings that, as a whole pre-token, the merge model turns into themselves."""
        merge = self.tokenizer.model.tokenize
        for entry in vocab:
            if entry.endswith(self.suffix) and (chars := entry[: -len(self.suffix)]) and len(merge(chars)) == 1:
                try:
                    yield bytes(self.chars_to_bytes[c] for c in chars).decode()
                except (KeyError, UnicodeDecodeError):  # not a text of its own
                    continue

    def __missing__(self, word: str) -> int:
        if word in self.whole:
            n = 1
        else:
            n = len(self.tokenizer.model.tokenize("".join(map(self.bytes_to_chars.__getitem__, word.encode()))))
        if len(self) >= REMEMBER:
            self.clear()
        self[word] = n
        return n

    def normalize(self, text: str) -> str:
        return self.tokenizer.normalizer.normalize_str(text) if _BEYOND.search(text) else text.lower()

    def pieces(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text and the number of special strings in it."""
        if "<|" not in text:
            return self.split(self.normalize(text)), 0
        parts = self.special.split(text)
        return [w for p in parts for w in self.split(self.normalize(p))], len(parts) - 1

    def count(self, text: str) -> int:
        words, special = self.pieces(text)
        return sum(map(self.__getitem__, words)) + special


def _byte_chars() -> dict[int, str]:
    """The usual stand-ins of bytes in byte-level vocabularies: printable Latin-1 stays, the rest moves up."""
    stay = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, up = {b: chr(b) for b in stay}, 0x100
    for b in range(0x100):
        if b not in out:
            out[b] = chr(up)
            up += 1
    return out


@functools.cache
def counter(path: str) -> Counter:
    return Counter(path)


def count_batches(batches: Iterator[pa.RecordBatch], path: str, limit: int) -> Iterator[pa.RecordBatch]:
    own = counter(path)
    for batch in slices(batches):
        texts = [x or "" for x in batch.column("text").to_pylist()]
        n = list(map(own.count, texts))
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"),
            "n_bytes": pa.array([len(x.encode()) for x in texts], pa.int64()),
            "n_tokens": pa.array(n, pa.int64()),
            "over_limit": pa.array([x > limit for x in n], pa.bool_()),
        })


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit per document. Map-side only, no shuffle."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    return docs.select("doc_id", "text").transform(in_arrow, lambda it: count_batches(it, path, limit), SCHEMA)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
