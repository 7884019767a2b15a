"""Token-ID output as a content-addressed store (op10).

Each document's ids, with an end id, are cut into chunks where a rolling hash of the last SPAN ids has
its low bits zero, so equal passages give equal chunks wherever they stand. A chunk is addressed by
the BLAKE2b hash of its bytes and stored once. A store is a folder of three Parquet tables:

* ``raw/kind=chunk``: key (the digest), n, payload (ids as little-endian unsigned integers of 16 bits, or 32
  where n * 2 is not its length);
* ``recipes``, in files of ascending doc_id (nulls last): doc_id, start (ids of all documents before),
  n_tokens, digests, sizes, root (the Merkle root of the digests);
* ``manifest``: for each recipe file its number, first start, documents, tokens and the Merkle root
  of its documents' roots.

Reading verifies: each payload is hashed again, each recipe's root and each manifest row is recomputed,
no manifest row or recipe file is without the other, and every recipe finds all its chunks, in its sizes. A chunk
that more than one in HOT of all recipes' places ask for is joined in as many copies as there are partitions.

Encoding is the library's. A text of plain Latin letters is encoded by its words, as neither
normalisation nor pre-tokenisation looks across white space there; each distinct word of a batch is cut into pre-tokens, the
library's model encodes each distinct one of these, and a bounded number is remembered, those met last before others. Any other text goes to the library whole.

Defined cases: a null or empty text is the end id alone; repeated rows are stored as recipes of their own; an empty
table gives an empty store. Texts of any length are encoded whole, in one row's memory. Extra columns take no part,
whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from outlyr.llm.common import HOT, drop_path, parts, running, scratch, shared_dir

#: The rolling hash's span; least, mean (a power of two, beyond the least) and most ids of a chunk.
SPAN, LEAST, MEAN, MOST = 16, 64, 256, 1024
_REMEMBERED = 1_000_000
#: Texts in which words can be encoded alone: letters with single-character lower case and no marks.
_PLAIN = re.compile("[\t\n\x0b\x0c\r\x20-\x7e\xa1-\xac\xae-įı-ɏ]*").fullmatch

#: The pre-token pattern that Arrow's expressions read as the library's do, over the characters of plain texts.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters beyond ASCII as the model has them: a character for each byte.
_SHOWN = [c for c in range(256) if 0x21 <= c <= 0x7E or 0xA1 <= c <= 0xAC or c >= 0xAE]
_BYTE = {b: chr(b) for b in _SHOWN} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}
_BYTES = {c: "".join(_BYTE[b] for b in chr(c).encode()) for c in {ord(chr(c).lower()) for c in range(0x80, 0x250) if len(chr(c).lower()) == 1}}
_PACK = [struct.Struct(f"<{k}I").pack for k in range(9)]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class WordEncoder:
    def __init__(self, path: str):
        import json
        import os

        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        model, added = spec["model"], [t["content"] for t in spec["added_tokens"]]
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        suffix = model.get("end_of_word_suffix")
        split = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
        self.pieces = regex.compile(split.get("pattern", {}).get("Regex", r"\S+")).findall
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)").search
        # words can be encoded alone where white space is dropped and pre-tokens end there
        self.by_word = bool(suffix) and steps == ["NFC", "Replace", "Lowercase"] and spec["post_processor"] is None
        # the model alone gives a word's ids where pre-tokens are letters, digits or marks, and bytes are written as characters
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.by_word &= len(steps) == 2 and steps[1].get("type") == "ByteLevel" and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]
        self.marks = split.get("pattern", {}).get("Regex") == _PATTERN
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of pre-tokens, by the library's model: they need no other step of the library."""
        out, tokenize = [], self.tok.model.tokenize
        for w in words:
            ids = [t.id for t in tokenize(w if w.isascii() else w.translate(_BYTES))] if w else []
            out.append(np.array(ids, dtype="<u4").tobytes() if len(ids) > 8 else _PACK[len(ids)](*ids))
        return out

    def _pieces(self, words: pa.Array) -> pa.Array:
        """The pre-tokens of lower-case words, a list for each; that of an empty word may be an empty one, without ids."""
        if self.marks:
            return pc.ascii_split_whitespace(pc.ascii_rtrim_whitespace(pc.replace_substring_regex(words, _PATTERN, r"\0 ")))
        return pa.array(list(map(self.pieces, words.to_pylist())), pa.large_list(pa.large_string()))

    def _ids(self, words: list[str]) -> list[bytes]:
        """The ids of distinct pre-tokens. Half of the remembered ones are those met last; the others give way when these are full."""
        found = list(map(self.known.get, words))
        missing = [k for k, f in enumerate(found) if f is None]
        again = list(map(self.older.get, [words[k] for k in missing]))
        new = iter(self._words([words[k] for k, f in zip(missing, again, strict=True) if f is None]))
        for k, f in zip(missing, again, strict=True):
            found[k] = next(new) if f is None else f
        if len(self.known) + len(missing) > _REMEMBERED // 2:
            self.known, self.older = {}, self.known
        if len(missing) <= _REMEMBERED // 2:
            self.known.update(zip([words[k] for k in missing], [found[k] for k in missing], strict=True))
        return found

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        plain = [self.by_word and _PLAIN(x) is not None and not self.added(x) for x in texts]
        other = iter(self.tok.encode_batch([x for x, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False))
        if not any(plain):
            return [np.array(x.ids, dtype="<u4") for x in other]
        # a batch's words are counted off by Arrow, each distinct one is cut into pre-tokens once, and of these each distinct one is looked up once
        split = pc.ascii_split_whitespace(pa.array([x.lower() for x, p in zip(texts, plain, strict=True) if p], pa.large_string()))
        words = split.flatten().dictionary_encode()
        cut_up = self._pieces(words.dictionary)
        pieces = cut_up.flatten().dictionary_encode()
        own = self._ids(pieces.dictionary.to_numpy(zero_copy_only=False).tolist())
        flat, ends = np.frombuffer(b"".join(own), "<u4"), np.concatenate((np.zeros(1, np.int64), np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) // 4)))
        for lists, coded in ((cut_up, pieces), (split, words)):
            flat, ends = _gathered(flat, ends, coded.indices.to_numpy(zero_copy_only=False))
            ends = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        known = iter(np.split(flat, ends[1:-1]))
        return [next(known) if p else np.array(next(other).ids, dtype="<u4") for p in plain]


def _gathered(flat: np.ndarray, ends: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``flat`` between ``ends`` that ``codes`` number, one after the other, and where these end, with 0 first."""
    n = np.diff(ends)[codes]
    out = np.concatenate((np.zeros(1, np.int64), np.cumsum(n)))
    return flat[np.repeat(ends[:-1][codes] - out[:-1], n) + np.arange(out[-1])], out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def cut(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream."""
    n = len(ids)
    if n <= LEAST:
        return [n]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(ids.astype(np.uint64) + np.uint64(1)))))
    roll = total[SPAN:] - total[:-SPAN]
    marks = np.flatnonzero(_mix(roll) & np.uint64(MEAN - 1) == 0) + SPAN
    ends, last = [], 0
    for m in [*marks.tolist(), n]:
        while m - last > MOST:
            ends.append(last + MOST)
            last += MOST
        if m - last >= LEAST or (m == n and m > last):
            ends.append(m)
            last = m
    return ends


def pack(ids: np.ndarray) -> bytes:
    return ids.astype("<u2" if not len(ids) or ids.max() < 65536 else "<u4").tobytes()


def unpack(payload: bytes, n: int) -> np.ndarray:
    return np.frombuffer(payload, "<u2" if len(payload) == 2 * n else "<u4").astype("<u4")


def address(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=16).digest()


def _leaf(x: bytes) -> bytes:
    return hashlib.sha256(b"\x00" + x).digest()


def _pair(x: bytes, y: bytes) -> bytes:
    return hashlib.sha256(b"\x01" + x + y).digest()


class Merkle:
    """The root over hashes that come one after the other: pairs are hashed together, an odd last one goes up as it is.

    Held are the roots of full trees, at most one of each height.
    """

    def __init__(self):
        self.full: list[tuple[int, bytes]] = []

    def add(self, x: bytes) -> None:
        height, x = 0, _leaf(x)
        while self.full and self.full[-1][0] == height:
            height, x = height + 1, _pair(self.full.pop()[1], x)
        self.full.append((height, x))

    def root(self) -> bytes:
        out = self.full[-1][1] if self.full else b"\x00" * 32
        for _, x in reversed(self.full[:-1]):
            out = _pair(x, out)
        return out


def merkle(leaves: list[bytes]) -> bytes:
    m = Merkle()
    for x in leaves:
        m.add(x)
    return m.root()


_RAW = T.StructType([
    T.StructField("key", T.BinaryType()), T.StructField("kind", T.StringType()), T.StructField("doc_id", T.LongType()), T.StructField("row", T.LongType()), T.StructField("n", T.LongType()),
    T.StructField("digests", T.ArrayType(T.BinaryType())), T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("payload", T.BinaryType()), T.StructField("root", T.BinaryType()),
])


def _chunked(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """A row for each document (its recipe) and one for each chunk."""
    arrow = pa.schema([("key", pa.binary()), ("kind", pa.string()), ("doc_id", pa.int64()), ("row", pa.int64()), ("n", pa.int64()), ("digests", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int64())), ("payload", pa.binary()), ("root", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), np.array([end_id], "<u4")
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                some = b.slice(i, 2000)
                rows, own = [], set()
                for doc_id, row, ids in zip(some.column("doc_id").to_pylist(), some.column("row").to_pylist(), enc.encode([x or "" for x in some.column("text").to_pylist()]), strict=True):
                    ids = np.concatenate((ids, end))
                    ends = cut(ids)
                    digests, sizes = [], []
                    for a, e in zip([0, *ends[:-1]], ends, strict=True):
                        payload = pack(ids[a:e])
                        d = address(payload)
                        digests.append(d)
                        sizes.append(e - a)
                        if d not in own:
                            own.add(d)
                            rows.append((d, "chunk", None, None, e - a, None, None, payload, None))
                    rows.append((row.to_bytes(9, "little"), "recipe", doc_id, row, len(ids), digests, sizes, None, merkle(digests)))
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), "text")
    return rows.mapInArrow(run, _RAW)


def write(docs: DataFrame, path: str, end_id: int, store: str) -> None:
    """Write the store of ``docs`` to the folder ``store``. Token data is shuffled once, by digest."""
    spark = docs.sparkSession
    raw = f"{store}/raw"
    # chunks meet by digest, each at most once from a task; recipes have keys of their own
    _chunked(docs, path, end_id).dropDuplicates(["key"]).write.partitionBy("kind").option("compression", "zstd").parquet(raw)
    recipes = spark.read.schema(_RAW).parquet(raw).where("kind = 'recipe'").select("doc_id", "row", "n", "digests", "sizes", "root")
    with scratch(spark):
        started = running(recipes, [], ["doc_id", "row"], {"start": "n"}, "starts")
        made = started.select("doc_id", "start", F.col("n").alias("n_tokens"), "digests", "sizes", "root")
        made.repartitionByRange(parts(spark), "start").sortWithinPartitions("start").withColumn("part", F.spark_partition_id()).write.parquet(f"{store}/recipes")
    drop_path(spark, f"{raw}/kind=recipe")
    _manifest(_recipes(spark, store)).write.parquet(f"{store}/manifest")


def _recipes(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.parquet(f"{store}/recipes")


def _chunks(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema(_RAW).parquet(f"{store}/raw").where("kind = 'chunk'").select(F.col("key").alias("digest"), "n", "payload")


def _manifest(recipes: DataFrame) -> DataFrame:
    """One row for each recipe file; a file's roots stream through one task in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, state = None, None
        for b in batches:
            for p, start, n, root in zip(b["part"], b["start"], b["n_tokens"], b["root"], strict=True):
                if p != part:
                    if state:
                        yield _file(part, state)
                    part, state = p, [start, 0, 0, Merkle()]
                state[1] += 1
                state[2] += n
                state[3].add(bytes(root))
        if state:
            yield _file(part, state)

    dealt = recipes.select("part", "start", "n_tokens", "root").repartition("part").sortWithinPartitions("part", "start")
    return dealt.mapInPandas(run, "part int, start long, documents long, tokens long, root binary")


def _file(part, state) -> pd.DataFrame:
    return pd.DataFrame([(part, state[0], state[1], state[2], state[3].root())], columns=["part", "start", "documents", "tokens", "root"])


def read_ids(spark: SparkSession, store: str) -> DataFrame:
    """doc_id, start and ids (packed as unsigned 32-bit) of every document, put together from the chunks."""
    links = _places(spark, store)
    payload = F.struct("pos", "digest", "n", "payload")
    rows = _found(links, _chunks(spark, store), _recipes(spark, store)).groupBy("doc_id", "start", "n_tokens").agg(F.array_sort(F.collect_list(payload)).alias("c"))

    def whole(c, n_tokens):
        for x in c:
            if x["payload"] is None:
                raise ValueError("the store lacks a chunk of a recipe")
            if address(bytes(x["payload"])) != bytes(x["digest"]):
                raise ValueError("a chunk does not have its digest")
        ids = b"".join(unpack(bytes(x["payload"]), x["n"]).astype("<u4").tobytes() for x in c)
        if len(ids) != 4 * n_tokens:
            raise ValueError("a document does not have its number of tokens")
        return ids

    return rows.select("doc_id", "start", F.udf(whole, T.BinaryType())("c", "n_tokens").alias("ids"))


def _places(spark: SparkSession, store: str) -> DataFrame:
    """doc_id, start, n_tokens, pos, digest, size, behind (bytes of ids after it): the chunks of all recipes, which are held against the manifest and their roots."""
    recipes = _recipes(spark, store)
    _verify_manifest(spark, store, recipes)

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            digests, pos, sizes, behind = [], [], [], []
            for ds, ns, root in zip(b["digests"], b["sizes"], b["root"], strict=True):
                if merkle([bytes(d) for d in ds]) != bytes(root):
                    raise ValueError("a recipe does not have its root")
                ends = np.cumsum(ns)
                digests.extend(ds)
                pos.append(np.arange(len(ds)))
                sizes.append(ns)
                behind.append((ends[-1] - ends) * 4)
            if not digests:
                continue
            out = b[["doc_id", "start", "n_tokens"]].loc[b.index.repeat([len(x) for x in pos])].reset_index(drop=True)
            yield out.assign(pos=np.concatenate(pos), digest=digests, size=np.concatenate(sizes), behind=np.concatenate(behind))

    return recipes.select("doc_id", "start", "n_tokens", "digests", "sizes", "root").mapInPandas(opened, "doc_id long, start long, n_tokens long, pos long, digest binary, size long, behind long")


def _found(links: DataFrame, chunks: DataFrame, recipes: DataFrame) -> DataFrame:
    """``links`` with what ``chunks`` has of their digest, null where there is none."""
    spark = links.sparkSession
    n = parts(spark)
    asked = recipes.select(F.explode("digests").alias("digest")).groupBy("digest").agg(F.count("*").alias("n"))
    total = recipes.agg(F.coalesce(F.sum(F.size("digests")), F.lit(0)).alias("n")).first().n
    hot = F.broadcast(asked.where(F.col("n") * HOT > total).where(F.col("n") > n).select("digest", F.lit(True).alias("hot")))  # HOT rows at most
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("start"), F.lit(n))).otherwise(F.lit(0).cast("long"))
    copies = F.explode(F.when(F.col("hot"), F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long"))))
    left = links.join(hot, "digest", "left").withColumn("salt", salt).drop("hot")
    right = chunks.join(hot, "digest", "left").withColumn("salt", copies).drop("hot")
    return left.join(right, ["digest", "salt"], "left").drop("salt")


_POLY = np.uint64(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials modulo the CRC-32 polynomial, bits reversed as in the checksum."""
    out, b = np.zeros_like(a), b.copy()
    for k in range(31, -1, -1):
        out ^= np.where((a >> np.uint64(k)) & np.uint64(1), b, np.uint64(0))
        b = np.where(b & np.uint64(1), (b >> np.uint64(1)) ^ _POLY, b >> np.uint64(1))
    return out


def shifted(crc: np.ndarray, size: np.ndarray) -> np.ndarray:
    """What checksums become by ``size`` bytes behind; the checksum of a whole is the XOR of its parts' so shifted."""
    power, size, out = np.full(len(crc), 1 << 23, np.uint64), size.astype(np.uint64), crc.astype(np.uint64)  # x^8
    while size.any():
        odd = (size & np.uint64(1)).astype(bool)
        out = np.where(odd, _times(power, out), out)
        power, size = _times(power, power), size >> np.uint64(1)
    return out


def checked(spark: SparkSession, store: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from verified files.

    Chunks are hashed and summed where they are read; only digests and checksums are joined, and
    the checksum of a document is put together from those of its chunks.
    """
    import zlib

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d, n, payload in zip(b["digest"], b["n"], b["payload"], strict=True):
                payload = bytes(payload)
                if address(payload) != bytes(d):
                    raise ValueError("a chunk does not have its digest")
                out.append((bytes(d), n, zlib.crc32(unpack(payload, n).tobytes())))
            yield pd.DataFrame(out, columns=["digest", "n", "crc"])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if b["n"].isna().any():
                raise ValueError("the store lacks a chunk of a recipe")
            if (b["n"] != b["size"]).any():
                raise ValueError("a chunk does not have its size")
            crc = shifted(b["crc"].to_numpy(np.uint64), b["behind"].to_numpy(np.uint64))
            yield b[["doc_id", "start", "n_tokens", "n"]].assign(crc=crc.astype(np.int64))

    links = _places(spark, store)
    sums = _chunks(spark, store).mapInPandas(verify, "digest binary, n long, crc long")
    rows = _found(links, sums, _recipes(spark, store)).mapInPandas(place, "doc_id long, start long, n_tokens long, n long, crc long")
    found = rows.groupBy("start").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("n").alias("_n"), F.bit_xor("crc").alias("ids_crc32"))
    whole = F.when(F.col("_n") == F.col("n_tokens"), F.lit(True)).otherwise(F.raise_error(F.lit("a document does not have its number of tokens")))
    return found.where(whole).select("doc_id", "start", "n_tokens", "ids_crc32")


def _verify_manifest(spark: SparkSession, store: str, recipes: DataFrame) -> None:
    stated = spark.read.parquet(f"{store}/manifest")
    both = stated.withColumn("_d", F.lit(1)).unionByName(_manifest(recipes).withColumn("_d", F.lit(-1)))
    if not both.groupBy(*stated.columns).agg(F.sum("_d").alias("_d")).where("_d <> 0").isEmpty():
        raise ValueError("the manifest is not that of the recipes")


def roundtrip(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """The query: write all documents to a new store in the shared folder and read it back."""
    spark = docs.sparkSession
    store = f"{shared_dir(spark)}/outlyr/store-{uuid.uuid4().hex}"
    write(docs, path, end_id, store)
    return checked(spark, store)
