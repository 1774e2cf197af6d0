"""Token ids in Parquet files: an encoder, a writer with controlled layout, and selective readers.

The files hold one row per document in ascending doc_id order: doc_id, shard, n_tokens and ids, a list of
32-bit integers, dictionary-encoded while the dictionary pays, else delta-encoded (Parquet version 2
pages). Row groups and pages are bounded and page indexes are written, so that a reader of some
documents opens the row groups and pages of their ids only, and a reader of metadata no ids at all.

Encoding is the tokenizers library's. White space other than single spaces and line feeds between other
characters, and added tokens, go to it whole; the rest of a text is cut where the vocabulary's own rule
always cuts (before a space, around a line feed), and each different piece is looked up and encoded once per batch:
Arrow numbers the pieces and puts their ids together. Of a word of letters only the library's merges are needed.

Null and empty texts have only the end id. Documents with equal ids stay separate rows, ordered by text.
Null ids come first. An empty input makes an empty table.
"""

from __future__ import annotations

import string
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common

#: Pieces whose ids a worker remembers.
REMEMBERED = 900_000
#: Bytes of text of a shard at most, or fewer with more shuffle partitions.
SHARD_BYTES = 128 << 20
#: White space as str.split has it, at an end of a text, beside other, or other than space and line feed.
ODD = "^[ \n]|[ \n]$|[ \n][ \n]|[" + "".join(f"\\x{{{c:x}}}" for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n") + "]"


#: Below it all that str.isalpha takes is a letter to the vocabulary's rule, too.
LATIN = "\u0250"
#: The signs that a byte-level vocabulary has for bytes: themselves where they can be seen, else those from 256 on.
_seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
SIGNS = {b: chr(b) for b in _seen} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)).difference(_seen)))}


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: a piece and its ids as packed 32-bit integers; the space before a piece is left out
        self.seen: dict[str, bytes] = {}
        self.ends: dict[str, bytes] = {}
        self.met = np.zeros(1 << 24, bool)
        self.tokenizer.model._resize_cache(0)  # pieces that come again are remembered here
        self.tokenize = self.tokenizer.model.tokenize
        (self.feed,) = self.tokenizer.encode("\n", add_special_tokens=False).ids

    def plain(self, column: pa.Array) -> np.ndarray:
        """Of each text, whether it has words and single spaces and line feeds between them only, and no added token.

        The library encodes the first word, and each other word with the space or line feed before it, independently.
        """
        odd = [pc.match_substring_regex(column, ODD), pc.equal(column, ""), *(pc.match_substring(column, a) for a in self.added)]
        return ~np.logical_or.reduce([x.to_numpy(zero_copy_only=False) for x in odd])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each text's ids, packed."""
        ids, at = self.ids(common.texts_of(pa.array(texts, pa.large_string())))
        return [ids[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a large_string column without nulls, and where each text's begin and end.

        Equal pieces are found by Arrow's dictionaries; each different one is looked up once.
        """
        plain = self.plain(column)
        cut = pc.split_pattern(pc.replace_substring(column.filter(pa.array(plain)), "\n", " \n"), " ")
        cuts = cut.offsets.to_numpy()
        pieces = cut.flatten().dictionary_encode()
        which = pieces.indices.to_numpy().astype(np.int64)
        first = np.zeros(len(which), bool)
        first[cuts[:-1] - cuts[0]] = True
        rest = np.zeros(len(pieces.dictionary), bool)
        rest[which[~first]] = True
        rest = np.flatnonzero(rest)
        words = _strings(pieces.dictionary.take(pa.array(rest)))
        got = list(map(self.seen.get, words))
        new = [k for k, x in enumerate(got) if x is None]
        added = self._learn([words[k] for k in new])
        for k in new:
            got[k] = self.seen[words[k]]
        heads, head = np.unique(which[first], return_inverse=True)
        # entries: the different pieces after a first word, the different first words, the other texts
        entries = [
            *got,
            *self._library(_strings(pieces.dictionary.take(pa.array(heads)))),
            *self._library(_strings(column.filter(pa.array(~plain)))),
        ]
        self._forget(added)
        entry = np.empty(len(pieces.dictionary), np.int64)
        entry[rest] = np.arange(len(rest))
        which = entry[which] if len(which) else which
        which[first] = len(rest) + head
        n_pieces = np.ones(len(column), np.int64)
        n_pieces[plain] = np.diff(cuts)
        ends = np.append(0, np.cumsum(n_pieces))
        order = np.empty(ends[-1], np.int64)
        whole = np.zeros(len(order), bool)
        whole[ends[:-1][~plain]] = True
        order[whole] = len(rest) + len(heads) + np.arange(len(column) - plain.sum())
        order[~whole] = which
        edges = np.append(0, np.cumsum(np.fromiter(map(len, entries), np.int64, len(entries)) // 4))
        lists = pa.LargeListArray.from_arrays(edges, np.frombuffer(b"".join(entries), np.int32)).take(pa.array(order))
        return lists.values.to_numpy(), lists.offsets.to_numpy()[ends]

    def _forget(self, added: list[str]) -> None:
        """Of new pieces, keeps all while there is much room, then those met before, then none."""
        if 2 * len(self.seen) < REMEMBERED:
            return
        at = np.fromiter(map(hash, added), np.int64, len(added)) & (len(self.met) - 1)
        again = self.met[at] & (len(self.seen) <= REMEMBERED)
        self.met[at] = True
        for w, keep in zip(added, again.tolist(), strict=True):
            if not keep:
                del self.seen[w]

    def _learn(self, words: list[str]) -> list[str]:
        """Puts words that are not there into seen; returns what was put.

        A letter or digit and the punctuation after it are always cut, so a word that ends in
        punctuation is its beginning and its end, and only new beginnings go to the library.
        """
        split = []
        need = set()
        for w in words:
            base = w.rstrip(string.punctuation)
            if len(base) != len(w) and base and base[-1].isalnum():
                split.append((w, base))
                need.add(base)
            else:
                need.add(w)
        new = list(need.difference(self.seen))
        letters = [w for w in new if w.isalpha() and (w.isascii() or max(w) < LATIN)]
        others = list(set(new).difference(letters))
        self.seen.update(zip(letters, map(self._lettered, letters)))
        self.seen.update(zip(others, self._listed(others), strict=True))
        ends = self.ends
        fresh = [w[len(base) :] for w, base in split if w[len(base) :] not in ends]
        ends.update(zip(fresh, self._library(fresh), strict=True))
        self.seen.update((w, self.seen[base] + ends[w[len(base) :]]) for w, base in split)
        return [*new, *(w for w, _ in split)]

    def _lettered(self, word: str) -> bytes:
        """Ids of a space and letters: one piece to the vocabulary's rule, so that the library's merges have the rest to do."""
        signs = word if word.isascii() else word.encode().decode("latin-1").translate(SIGNS)
        return np.array([t.id for t in self.tokenize(SIGNS[32] + signs)], np.int32).tobytes()

    def _listed(self, words: list[str], lines: int = 2000) -> list[bytes]:
        """Ids of words with what stands before them, many to a text, a line each."""
        out: list[bytes] = []
        pages = [words[k : k + lines] for k in range(0, len(words), lines)]
        texts = ["".join(w if w[0] == "\n" else "\n " + w for w in page) for page in pages]
        for page, e in zip(pages, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.int32)
            at = np.append(np.flatnonzero(ids == self.feed), len(ids))
            if len(at) != len(page) + 1 or at[0]:
                raise AssertionError("the vocabulary joins line feeds to other text")
            flat = ids.tobytes()
            a = (4 * at).tolist()
            out += [flat[x + 4 * (w[0] != "\n") : y] for w, x, y in zip(page, a[:-1], a[1:], strict=True)]
        return out

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.int32).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode(df: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """(doc_id, shard, place, n_tokens, ids) for df (doc_id, text), in df's partitions and order; ids end with end_id."""
    frame = df.select("doc_id", "text", F.spark_partition_id().alias("shard"))
    kind = frame.schema["doc_id"].dataType.simpleString()

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, done = encoder(path), 0
        for b in batches:
            column = common.texts_of(b.column(1))
            for low, high in common.steps(column, 1 << 20):
                ids, at = coder.ids(column.slice(low, high - low))
                n = np.diff(at) + 1
                at = at + np.arange(len(at))
                flat = np.full(at[-1], end_id, np.int32)
                inner = np.ones(len(flat), bool)
                inner[at[1:] - 1] = False
                flat[inner] = ids
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))
                place = pa.array(np.arange(done, done + len(n)))
                done += len(n)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(low, high - low), b.column(2).slice(low, high - low), place, pa.array(n), lists], ["doc_id", "shard", "place", "n_tokens", "ids"])

    return frame.mapInArrow(run, f"doc_id {kind}, shard int, place bigint, n_tokens bigint, ids array<int>")


def write(
    df: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = 0,
    row_group_bytes: int = 16 << 20,
    page_bytes: int = 256 << 10,
    page_rows: int = 256,
    shards: int | None = None,
) -> None:
    """Writes the ids of df (doc_id, text) to a folder of Parquet files, ascending in doc_id over files and rows."""
    spark = df.sparkSession
    if shards is None:
        size = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    # rows of one id, or without an id, may be many: their texts, and their own numbers, spread them over shards
    each = df.select("doc_id", "text", F.xxhash64("text").alias("_text"), F.monotonically_increasing_id().alias("_own"))
    ordered = each.repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), "_text", "_own").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_text", "_own").select("doc_id", "text")
    (
        encode(ordered, tokenizer, end_id)
        .write.option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.dictionary.page.size", 512 << 10)
        .option("parquet.page.row.count.limit", page_rows)
        .option("compression", "snappy")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids) of documents low to high; row groups and pages of others are skipped by their indexes."""
    df = spark.read.parquet(path).select("doc_id", "n_tokens", "ids")
    if low is not None:
        df = df.filter(F.col("doc_id") >= low)
    return df if high is None else df.filter(F.col("doc_id") <= high)


def read_offsets(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens) without reading ids: start counts the ids of all documents before.

    Sums run within shards; a shard's own start is the sum of the few shards before it.
    """
    meta = spark.read.parquet(path).select("doc_id", "shard", "place", "n_tokens")
    shards = meta.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
    ahead = shards.select("shard", (F.sum("_n").over(W.orderBy("shard")) - F.col("_n")).alias("_ahead"))
    return _started(meta, ahead).select("doc_id", "start", "n_tokens")


def _started(meta: DataFrame, ahead: DataFrame) -> DataFrame:
    inside = W.partitionBy("shard").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    return meta.withColumn("_before", before).join(ahead, "shard").withColumn("start", F.col("_ahead") + F.col("_before"))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files alone.

    Each file is read by one task from its beginning or by several from its row groups; ids are digested
    where they are read and only (doc_id, n_tokens, crc) moves on.
    """
    frame = spark.read.parquet(path).select("doc_id", "shard", "place", "ids")
    kind = frame.schema["doc_id"].dataType.simpleString()

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            values, at = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), lists.offsets.to_numpy()
            crc = [zlib.crc32(values[a:z]) for a, z in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "shard", "place", "n_tokens", "ids_crc32"])

    meta = common.table(frame.mapInArrow(run, f"doc_id {kind}, shard int, place bigint, n_tokens bigint, ids_crc32 bigint"), "token-digests")
    shards = meta.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
    ahead = shards.select("shard", (F.sum("_n").over(W.orderBy("shard")) - F.col("_n")).alias("_ahead"))
    return _started(meta, ahead).select("doc_id", "start", "n_tokens", "ids_crc32")


def folder(spark: SparkSession) -> str:
    """A new folder for a token table, gone with the application."""
    path = f"{common.shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path
