"""Token counts of a byte-level BPE by whole pre-tokens, with merges for the rest."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import sliced, table

TOKENIZER, LIMIT = "byte_bpe_50k.json", 512
#: Bytes of pre-tokens other than whole tokens whose counts a Python worker remembers, and bytes that an entry takes besides its string.
REMEMBERED_BYTES, ENTRY_BYTES = 64_000_000, 110


def _byte_characters() -> dict[str, int]:
    """Byte-level alphabets spell a printable Latin-1 byte as itself and the others, in order, from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Counter(dict):
    """Pre-token: number of tokens. Starts with the proven whole tokens; learns the rest as texts need them."""

    def __init__(self, path: str, whole: list[str] | None = None) -> None:
        """whole: what proven() of the same file gave before, so that it need not be proven again."""
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = sorted((t.content for t in added.values()), key=len, reverse=True)
        self.apart = regex.compile("|".join(map(regex.escape, self.added))) if self.added else None
        self.whole = self.proven() if whole is None else whole
        super().__init__(dict.fromkeys(self.whole, 1))
        self.left = REMEMBERED_BYTES

    def proven(self) -> list[str]:
        """The vocabulary's strings that are one pre-token and that the library encodes as one token, themselves.

        A pre-token is encoded without regard to its neighbours, so this holds for it in every text.
        """
        of, out = _byte_characters(), []
        for spelled in self.tokenizer.get_vocab(with_added_tokens=False):
            try:
                text = bytes(of[c] for c in spelled).decode("utf-8")
            except (KeyError, UnicodeDecodeError):
                continue  # part of a character: no pre-token
            if text and self.split(text) == [text]:
                out.append(text)
        found = self.tokenizer.encode_batch(out, add_special_tokens=False)
        return [t for t, e in zip(out, found, strict=True) if len(e.ids) == 1 and not self.has_added(t)]

    def has_added(self, text: str) -> bool:
        return bool(self.apart and self.apart.search(text))

    def __missing__(self, piece: str) -> int:
        n = len(self.tokenizer.encode(piece, add_special_tokens=False).ids)
        cost = sys.getsizeof(piece) + ENTRY_BYTES
        if cost <= self.left:
            self.left -= cost
            self[piece] = n
        return n

    def count(self, text: str) -> int:
        if not self.has_added(text):
            return sum(map(self.__getitem__, self.split(text)))
        parts = self.apart.split(text)  # an added token is one wherever its string stands
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.split(p))) for p in parts)


def plain_added_tokens(path: str) -> bool:
    """Whether the file is of the kind that Counter knows: byte-level BPE, no normaliser, added tokens cut out as they stand."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec["pre_tokenizer"] or {}
    return spec["model"]["type"] == "BPE" and not spec["normalizer"] and not spec["post_processor"] and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])


@lru_cache(1)
def proven(path: str) -> list[str]:
    """Counter.proven() of a file that is of its kind; an error for other files."""
    if not plain_added_tokens(path):
        raise ValueError(f"{path}: not a plain byte-level BPE")
    return Counter(path).whole


_counters: dict[str, Counter] = {}


def counter(path: str, whole: list[str] | None = None) -> Counter:
    """This process's counter of the file, with its proven whole tokens or those it proves; another file's goes."""
    if path not in _counters:
        _counters.clear()
        _counters[path] = Counter(path, proven(path) if whole is None else whole)
    return _counters[path]


def token_counts(documents: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Per row of documents(doc_id, text): doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    path: a tokenizers file of byte-level BPE that every executor has. Tokens are those of
    encode(text, add_special_tokens=False): a special token's string inside a text is that token. Null
    text is empty: 0 bytes, 0 tokens; a very long one is counted whole, its pre-tokens in one list. Rows
    stream through; repeated ones stay, other columns go. The driver proves the whole tokens once and
    broadcasts them, a part of the file's vocabulary and so as bounded as it. A worker's table holds
    them and REMEMBERED_BYTES of further pre-tokens; later ones are merged anew. Empty table: no rows.
    """
    whole = documents.sparkSession.sparkContext.broadcast(proven(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, whole.value).count
        for batch in sliced(batches):
            texts = batch.column(1).fill_null("")
            n_tokens = pa.array([count(t) for t in texts.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_length(texts).cast(pa.int64()), n_tokens], ["doc_id", "n_bytes", "n_tokens"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
