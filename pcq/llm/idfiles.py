"""Token-ID output: texts as ids in shards of range-coded blocks (see idcoder), in ascending id order, and back.

A dataset is a Parquet container, so that Spark's writers commit it and any store that Spark reads can hold it. One row
is one shard: whole documents, about SHARD ids together, cut into blocks that are coded and checked each on its own.
Columns: part and shard (their order is the order of the documents), doc_ids, doc_tokens (ids of each document, its end
id counted), block_bytes, header (of the shard's model), payload (the blocks, one after another).
"""

from __future__ import annotations

import re
import sys
import types
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import idcoder
from .common import Scratch, slim, small_batches

SHARD = idcoder.BLOCK * idcoder.LANES
#: Words kept with their ids in a worker, twice: when the new ones are so many, they become the old ones.
CACHE = 200_000
#: Up to so many shards a row of three longs for each is broadcast.
BROADCAST_SHARDS = 100_000
SCHEMA = "part int, shard int, n_tokens long, doc_ids array<bigint>, doc_tokens array<bigint>, block_bytes array<int>, header binary, payload binary"
#: Texts with any other character are cut at white space only. Of these, every letter is one code point in lower case.
_UNUSUAL = re.compile("[^\t-\r\x20-;=-~À-ÖØ-öø-įıĲ-ɏ]")
#: Letters, then full stops and commas: such a word's ids are those of the letters, then of the marks.
_PLAIN = re.compile(r"([^\W\d_]+)([.,]*)")
#: A full stop or comma beside another mark makes one run with it.
_RUN = re.compile(r"[.,][^\w\s]|[^\w\s][.,]|_")
#: The same over texts of usual characters, for Arrow: their marks are those of ASCII.
_ARROW_RUN = r"[.,][!-/:-@\[-^`{-~]|[!-/:-@\[-^`{-~][.,]|_"
#: Texts and characters that are cut into words at once, about.
TEXTS, CHARS = 4_000, 8_000_000
#: Python's split() takes these for white space; the tokenizer's white space does not hold them.
_ODD_SPACE = re.compile("[\x1c-\x1f]")


def _byte_chars() -> dict[int, str]:
    """The printable characters that byte-level vocabularies write bytes with."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


_BYTE_CHARS = _byte_chars()


class WordTokenizer:
    """Ids by the tokenizers library, with a cache. Its pre-tokenizer never joins what white space parts, so a text's
    ids are those of its words in a row; texts with odd control characters are encoded as a whole. Where its rules allow
    (which is tested at the start), texts of usual characters are lower-cased and full stops and commas parted first."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_str(spec)
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        top = self.inner.get_vocab_size(with_added_tokens=True)
        if top > 1 << 16:
            raise ValueError(f"ids are stored as u16; this vocabulary has {top}")
        added = [t.content for t in self.inner.get_added_tokens_decoder().values()]
        self.direct = sys.byteorder == "little" and all("<" in t for t in added)
        # Words can go straight to the model, in lower case and without marks, if this tokenizer does what that assumes.
        probe = ["Abc don't, 1.5", "Éclair,x.y ÜBER.", "ñandú, a-b.c (d) e's", "ſǆ \"Q\" 3,000 it's."]
        self.direct = self.direct and self.encode(probe) == self._whole(probe) and self._letters("çeci") == self._whole(["Çeci"])[0]
        self.known = {}

    def _whole(self, words: list[str]) -> list[bytes]:
        return [array("H", e.ids).tobytes() for e in self.inner.encode_batch(words, add_special_tokens=False)]

    def _plain(self, word: str) -> bytes | None:
        m = _PLAIN.fullmatch(word)
        return m and self._letters(m[1]) + (self._letters(m[2]) if m[2] else b"")

    def _letters(self, word: str) -> bytes:
        # ASCII letters stand for themselves.
        mapped = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_CHARS)
        return array("H", [t.id for t in self.inner.model.tokenize(mapped)]).tobytes()

    def _learn(self, words: set[str], usual: bool) -> None:
        if len(self.known) > CACHE:
            self.known, self.old = {}, self.known
        ask = []
        for w in words:
            found = self.old.get(w)
            if found is None and usual:
                found = self._letters(w) if w.isalpha() else self._plain(w)
            if found is None:
                ask.append(w)
            else:
                self.known[w] = found
        for w, ids in zip(ask, self._whole(ask) if ask else [], strict=True):
            self.known[w] = ids

    def encode_column(self, texts: pa.Array, end_id: int) -> pa.Array:
        """The ids of each text and the end id, as encode() has them. Words of usual texts are cut and told apart by Arrow, so
        that each different one is looked up once; the others go through encode()."""
        usual = pc.invert(pc.match_substring_regex(texts, _UNUSUAL.pattern)).fill_null(False) if self.direct else pa.array(np.zeros(len(texts), bool))
        rest = [x for x, own in zip(texts, usual, strict=True) if not own.as_py()] if not pc.all(usual).as_py() else []
        odd = self.encode([x.as_py() for x in rest])
        lower = pc.utf8_lower(texts.filter(usual))
        parted = pc.replace_substring(pc.replace_substring(lower, ",", " , "), ".", " . ")
        words = pc.ascii_split_whitespace(pc.if_else(pc.match_substring_regex(lower, _ARROW_RUN), lower, parted))
        coded = words.flatten().dictionary_encode()
        # Behind the ids of different words: those of odd texts, each as one word, and the end id. Split leaves empty words at the ends.
        different = coded.dictionary.to_pylist()
        found = [*map(self.known.get, different)]
        if None in found:
            self._learn({w for w, x in zip(different, found, strict=True) if x is None and w}, True)
            known = self.known
            found = [(known[w] if w else b"") if x is None else x for w, x in zip(different, found, strict=True)]
        found += [*odd, np.array([end_id], "<u2").tobytes()]
        pool, size = np.frombuffer(b"".join(found), "<u2"), np.fromiter(map(len, found), np.int64, len(found)) // 2
        # Words of each text in a row, with the end after them.
        own = usual.to_numpy(zero_copy_only=False)
        many = np.ones(len(texts), np.int64)
        many[own] = np.diff(words.offsets.to_numpy())
        last = np.cumsum(many + 1) - 1
        word, inner = np.full(int(last[-1]) + 1, len(found) - 1), np.ones(int(last[-1]) + 1, bool)
        inner[last] = False
        if odd:
            at = last[~own] - 1
            word[at], inner[at] = len(different) + np.arange(len(odd)), False
        word[inner] = coded.indices.to_numpy()
        each = size[word]
        ends = np.cumsum(each)
        ids = pool[np.repeat((np.cumsum(size) - size)[word] - ends + each, each) + np.arange(int(ends[-1]))]
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(np.concatenate(([0], 2 * ends[last])).astype(np.int32)), pa.py_buffer(ids)])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian u16; none for null."""
        out = []
        for t in texts:
            if not t or _ODD_SPACE.search(t):
                out.append(array("H", self.inner.encode(t, add_special_tokens=False).ids).tobytes() if t else b"")
                continue
            usual = self.direct and not _UNUSUAL.search(t)
            if usual:
                t = t.lower()
                if not _RUN.search(t):
                    t = t.replace(",", " , ").replace(".", " . ")
            words = t.split()
            found = [*map(self.known.get, words)]
            if None in found:
                # Learning may retire the words known so far; those of this text are at hand.
                self._learn({w for w, x in zip(words, found, strict=True) if x is None}, usual)
                known = self.known
                found = [known[w] if x is None else x for w, x in zip(words, found, strict=True)]
            out.append(b"".join(found))
        return out


def _tokenizer(spec: str) -> WordTokenizer:
    """One for each worker process, so that its cache outlives a task."""
    store = sys.modules.setdefault("_pcq_worker", types.ModuleType("_pcq_worker"))
    key = zlib.crc32(spec.encode())
    if getattr(store, "key", None) != key:
        store.key, store.tokenizer = key, WordTokenizer(spec)
    return store.tokenizer


def tokenise(docs: DataFrame, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): each text's ids and the end id, as u16. A null or empty text has the end id alone."""
    small_batches(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = _tokenizer(spec.value)
        for batch in slim(batches):
            for at, n in _pieces(batch.column(1)):
                part = batch.slice(at, n)
                yield pa.RecordBatch.from_arrays([part.column(0), tokenizer.encode_column(part.column(1), end_id)], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text")).mapInArrow(run, "doc_id long, ids binary")


def _pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first, number) of texts that are encoded at once."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        most = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHARS, "right"))
        n = max(1, min(TEXTS, most - at))
        yield at, n
        at += n


def _shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    part = TaskContext.get().partitionId()
    held: list[bytes] = []
    names: list[int | None] = []
    size = shard = 0

    def row() -> pd.DataFrame:
        ids = np.frombuffer(b"".join(held), "<u2")
        header, blocks = idcoder.encode(ids)
        lengths = [len(x) // 2 for x in held]
        return pd.DataFrame({"part": [part], "shard": [shard], "n_tokens": [len(ids)], "doc_ids": [names], "doc_tokens": [lengths], "block_bytes": [[len(b) for b in blocks]], "header": [header], "payload": [b"".join(blocks)]})

    for batch in slim(batches):
        for name, ids in zip(batch["doc_id"], batch["ids"], strict=True):
            if held and size + len(ids) // 2 > SHARD:
                yield row()
                held, names, size, shard = [], [], 0, shard + 1
            held.append(ids)
            names.append(None if pd.isna(name) else int(name))
            size += len(ids) // 2
    if held:
        yield row()


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode docs into a dataset at path. Null ids come first; rows that share an id are ordered by their ids' bytes.
    Only ids are sorted and moved, not texts. An empty table makes an empty dataset. Other columns are not read."""
    spark = docs.sparkSession
    tmp = Scratch(spark, "idfiles")
    ids = tmp.save(tokenise(docs, tokenizer_path, end_id, id_col, text_col), "ids")
    total = (ids.agg(F.sum(F.length("ids"))).first()[0] or 0) // 2
    ordered = ids.repartitionByRange(max(1, -(-total // SHARD)), "doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInPandas(_shards, SCHEMA).write.parquet(path)
    tmp.drop()


def _unpack(row) -> Iterator[np.ndarray]:
    """The ids of each document of a shard."""
    cut = np.concatenate(([0], np.cumsum(np.asarray(row.block_bytes, np.int64))))
    blocks = [row.payload[cut[i] : cut[i + 1]] for i in range(len(cut) - 1)]
    ids = np.concatenate(idcoder.decode(row.header, blocks)) if blocks else np.empty(0, np.uint16)
    ends = np.concatenate(([0], np.cumsum(np.asarray(row.doc_tokens, np.int64))))
    if ends[-1] != len(ids):
        raise ValueError("a shard's blocks do not hold its documents' ids")
    return (ids[ends[i] : ends[i + 1]] for i in range(len(ends) - 1))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): start counts the ids of all documents before; ids are u16, the end id included."""
    shards = spark.read.schema(SCHEMA).parquet(path)
    totals = shards.select("part", "shard", "n_tokens")
    # One row for each writing task, at least SHARD ids each: a window over a table that short is one small task.
    parts = totals.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    parts = parts.withColumn("_before", F.sum("_n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n"))
    within = F.sum("n_tokens").over(W.partitionBy("part").orderBy("shard").rowsBetween(W.unboundedPreceding, 0)) - F.col("n_tokens")
    places = totals.withColumn("_within", within).join(parts, "part").select(F.col("part").alias("_p"), F.col("shard").alias("_s"), (F.col("_before") + F.col("_within")).alias("_start"))
    places = F.broadcast(places) if totals.count() <= BROADCAST_SHARDS else places
    placed = shards.join(places, (shards["part"] == places["_p"]) & (shards["shard"] == places["_s"])).drop("_p", "_s")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in slim(batches):
            for row in batch.itertuples():
                names = [None if pd.isna(x) else int(x) for x in row.doc_ids]
                lengths = np.asarray(row.doc_tokens, np.int64)
                yield pd.DataFrame({"doc_id": pd.array(names, "Int64"), "start": row.begin + np.cumsum(lengths) - lengths, "n_tokens": lengths, "ids": [x.tobytes() for x in _unpack(row)]})

    return placed.withColumnRenamed("_start", "begin").mapInPandas(run, "doc_id long, start long, n_tokens long, ids binary")


def digest(read_back: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32): the unsigned CRC-32 of the ids as little-endian u32."""

    @F.pandas_udf("long")
    def crc(ids: pd.Series) -> pd.Series:
        return pd.Series([zlib.crc32(np.frombuffer(x, "<u2").astype("<u4").tobytes()) for x in ids], dtype="int64")

    return read_back.select("doc_id", "start", "n_tokens", crc("ids").alias("ids_crc32"))
