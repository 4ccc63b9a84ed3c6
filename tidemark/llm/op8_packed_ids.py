"""Token ids in fixed-width bit packing.

A shard file holds the ids of one range of documents, in ascending document
order, each id in the fewest bits that the vocabulary needs:

    magic ``TMBITS01`` | block 0 | block 1 | ... | footer | footer length (u64) | magic

A block holds ``BLOCK`` ids (the last one fewer) as little-endian 64-bit
words: groups of 64 ids fill exactly ``bits`` words. The footer has, as u64:
bits, block size, number of ids, blocks and documents; then the block
offsets, the document ids (i64, with a byte mask of nulls) and the position
of each document's first id in the shard. Any id range is read by its blocks
alone and unpacked by numpy without a loop over ids.

Each task writes its shard under a name no other attempt uses; the manifest,
written by Spark, lists the shards that count, so a lost or repeated task
leaves at most an unlisted file.

Defined results: a null text is empty (the end id alone); a null document id
sorts first; repeated rows and rows of equal id are all written, ordered by
the hash of their text and the text; an empty table gives no shard and an
empty result; other columns are ignored. Texts are encoded whole.
"""

from __future__ import annotations

import copy
import hashlib
import itertools
import json
import os
import uuid
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Words, release, saved, scratch, shuffle_partitions, sliced, table, text_of, word_batches

MAGIC = b"TMBITS01"
BLOCK = 1 << 14  # ids, a multiple of 64
END_ID = 2
MANIFEST = "shard int, path string, n_docs bigint, n_ids bigint, n_bytes bigint"


def bits_for(vocab_size: int) -> int:
    return max(1, int(vocab_size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> np.ndarray:
    """Ids (below 2**bits, bits <= 32) -> little-endian 64-bit words; the tail is padded with zeros."""
    groups = -(-len(ids) // 64)
    lanes = np.zeros(groups * 64, np.uint64)
    lanes[:len(ids)] = ids
    lanes = lanes.reshape(groups, 64)
    out = np.zeros((groups, bits), np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        out[:, word] |= lanes[:, j] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= lanes[:, j] >> np.uint64(64 - shift)
    return out.reshape(-1).astype("<u8")


def unpack(packed: np.ndarray, bits: int, n: int) -> np.ndarray:
    packed = packed.reshape(-1, bits)
    out = np.empty((len(packed), 64), np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        out[:, j] = packed[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            out[:, j] |= packed[:, word + 1] << np.uint64(64 - shift)
    return (out & np.uint64((1 << bits) - 1)).reshape(-1)[:n].astype("<u4")


class ShardWriter:
    """Streams ids into a shard; holds one unfinished block and the document table."""

    def __init__(self, sink, bits: int, block: int = BLOCK):
        self.sink, self.bits, self.block = sink, bits, block
        self.offsets, self.docs, self.nulls, self.starts = [], [], bytearray(), []
        self.pending, self.held, self.n_ids, self.at = [], 0, 0, len(MAGIC)
        sink.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.starts.append(self.n_ids)
        self.pending.append(ids)
        self.n_ids += len(ids)
        self.held += len(ids)
        if self.held >= 16 * self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.empty(0, np.uint32)
        end = len(ids) if last else len(ids) // self.block * self.block
        for s in range(0, end, self.block):
            data = pack(ids[s:min(s + self.block, end)], self.bits).tobytes()
            self.offsets.append(self.at)
            self.sink.write(data)
            self.at += len(data)
        self.pending, self.held = [ids[end:]], len(ids) - end

    def close(self) -> int:
        self._flush(True)
        head = np.array([self.bits, self.block, self.n_ids, len(self.offsets), len(self.docs)], "<u8").tobytes()
        foot = (head + np.array(self.offsets, "<u8").tobytes() + np.array(self.docs, "<i8").tobytes()
                + np.array(self.starts, "<u8").tobytes() + bytes(self.nulls))
        self.sink.write(foot + np.array([len(foot)], "<u8").tobytes() + MAGIC)
        return self.at + len(foot) + 8 + len(MAGIC)


class ShardReader:
    """Random access to a shard through its footer."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        tail = source.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError("not a packed shard, or cut off")
        length = int(np.frombuffer(tail[:8], "<u8")[0])
        self.data_end = size - 16 - length
        foot = source.read_at(length, self.data_end)
        self.bits, self.block, self.n_ids, blocks, docs = (int(x) for x in np.frombuffer(foot, "<u8", 5))
        at = 40
        self.offsets = np.append(np.frombuffer(foot, "<u8", blocks, at), np.uint64(self.data_end)).astype(np.int64)
        at += 8 * blocks
        self.docs = np.frombuffer(foot, "<i8", docs, at)
        at += 8 * docs
        self.starts = np.append(np.frombuffer(foot, "<u8", docs, at), np.uint64(self.n_ids)).astype(np.int64)
        self.nulls = np.frombuffer(foot, np.uint8, docs, at + 8 * docs).astype(bool)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids [start, end) of the shard, from the blocks that hold them."""
        if start >= end:
            return np.empty(0, "<u4")
        a, b = start // self.block, -(-end // self.block)
        lo, hi = int(self.offsets[a]), int(self.offsets[b])
        words_ = np.frombuffer(self.source.read_at(hi - lo, lo), "<u8")
        got = unpack(words_, self.bits, min(b * self.block, self.n_ids) - a * self.block)
        return got[start - a * self.block:end - a * self.block]


# The rules that pieces rely on, as the tokenizer's file states them.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]


def follows_rules(tokenizer) -> bool:
    """Whether the tokenizer normalises, splits and maps bytes as ``RunIds`` expects."""
    spec = json.loads(tokenizer.to_str())
    steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
    return ((spec["normalizer"] or {}).get("normalizers") == NORMALIZERS and len(steps) == 2
            and steps[0].get("pattern") == {"Regex": SPLIT} and steps[0].get("invert") and steps[0]["behavior"] == "Removed"
            and steps[1]["type"] == "ByteLevel" and not steps[1]["add_prefix_space"] and not steps[1].get("use_regex", True)
            and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
            and all("<" in t["content"] and not t["content"].split()[1:] for t in spec["added_tokens"]))


SPACE, LETTER, DIGIT, SYMBOL, OTHER = range(5)
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
_CLASS[33:127] = SYMBOL
_CLASS[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3]] = LETTER
_CLASS[48:58] = DIGIT
_CLASS[[ord("'"), ord("<")]] = OTHER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def pieces_of(w: Words) -> tuple[Words, np.ndarray]:
    """The pieces that the tokenizer sees in ``w``, and each byte's class.

    Runs of ASCII and the Latin letters of U+00C0 to U+00FF are split into
    letters, single digits and symbols, in lower case. Runs with anything else
    stay whole and as they are (``OTHER``): apostrophes, since contractions
    depend on what follows, and "<", which begins a special string, included.
    """
    a = w.array
    kind, low = _CLASS[a], _LOWER[a]
    odd = kind == OTHER
    behind = np.flatnonzero((a & 0xC0) == 0x80)
    if len(behind):
        latin = (a[behind - 1] == 0xC3) & (a[behind] != 0x97) & (a[behind] != 0xB7)
        odd[behind[~latin]] = True
        upper = behind[latin & (a[behind] < 0x9F)]
        low[upper] += 32
    at = np.flatnonzero(odd)
    if len(at):
        runs = np.unique(np.searchsorted(w.starts, at, "right") - 1)
        edge = np.zeros(len(a) + 1, np.int8)
        edge[w.starts[runs]] += 1
        edge[w.ends[runs]] -= 1
        whole = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
        kind[whole] = OTHER
        low[whole] = a[whole]
    edge = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    out = copy.copy(w)
    out.array, out._hashes = low, None
    out.starts = np.flatnonzero(edge & (kind[1:] != SPACE)) + 1
    out.ends = np.flatnonzero((edge | (kind[:-1] == DIGIT)) & (kind[:-1] != SPACE)) + 1
    out.first = np.searchsorted(out.starts, w.text_starts)
    return out, kind


class RunIds:
    """Ids of texts from the ids of their pieces.

    No rule of the tokenizer reaches across white space (it splits words
    there and drops it; special strings hold none), nor from one piece of
    ``pieces_of`` to the next. Pieces are found and hashed by numpy and looked
    up in a hash table of numpy arrays; each new piece is encoded once. The
    store lives as long as the Python worker: beyond ``LIMIT`` pieces or
    ``IDS`` ids it keeps the more used half. A tokenizer of other rules
    encodes whole texts.
    """

    LIMIT = 1 << 18  # pieces, about 11 MB
    IDS = 1 << 21  # their ids, 8 MB
    LEARNT = 1 << 14  # new pieces encoded together: their ids are Python objects

    def __init__(self, tokenizer):
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.tokenizer, self.model, self.fits = tokenizer, tokenizer.model, follows_rules(tokenizer)
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [x for x in range(256) if x not in visible]
        #: The byte-level alphabet: visible bytes are themselves, others are moved up from 256.
        self.alphabet = {b: 256 + k for k, b in enumerate(hidden)}
        none = np.empty(0, np.int64)
        self._set(none.astype(np.uint64), none, none.astype(np.uint32), none)

    def _set(self, keys: np.ndarray, size: np.ndarray, flat: np.ndarray, uses: np.ndarray) -> None:
        """The store of these pieces: their hashes, numbers of ids, ids and uses."""
        self.keys, self.size, self.flat, self.uses = keys, size, flat, uses
        self.at = np.cumsum(size) - size
        self.mask = np.int64((1 << max(2 * max(len(keys), self.LIMIT) - 1, 1).bit_length()) - 1)
        self.slot = np.full(int(self.mask) + 1, -1, np.int32)
        self._place(0)

    def _home(self, h: np.ndarray) -> np.ndarray:
        return (h & np.uint64(self.mask)).astype(np.int64)

    def _place(self, n: int) -> None:
        """Put pieces n, n + 1, ... into the table."""
        todo = np.arange(n, len(self.keys))
        home = self._home(self.keys[n:])
        while len(todo):
            free = self.slot[home] < 0
            self.slot[home[free]] = todo[free]
            left = self.slot[home] != todo
            todo, home = todo[left], (home[left] + 1) & self.mask

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with these hashes, -1 for new ones."""
        home = self._home(h)
        out = self.slot[home].astype(np.int64)
        todo = np.flatnonzero(out >= 0)
        todo = todo[self.keys[out[todo]] != h[todo]]
        while len(todo):
            home[todo] = (home[todo] + 1) & self.mask
            out[todo] = self.slot[home[todo]]
            todo = todo[out[todo] >= 0]
            todo = todo[self.keys[out[todo]] != h[todo]]
        return out

    def _learn(self, hashes: np.ndarray, pieces: list[bytes], whole: np.ndarray) -> None:
        got, slow, tokenize = [None] * len(pieces), np.flatnonzero(whole).tolist(), self.model.tokenize
        for k in np.flatnonzero(~whole).tolist():
            piece = pieces[k]
            text = piece.decode() if piece.isascii() else piece.decode("latin-1").translate(self.alphabet)
            got[k] = [t.id for t in tokenize(text)]
        texts = [pieces[k].decode("utf-8", "replace") for k in slow]
        for k, e in zip(slow, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            got[k] = e.ids
        n, used = len(self.keys), len(self.flat)
        size = np.fromiter(map(len, got), np.int64, len(got))
        self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(got), np.uint32, int(size.sum()))])
        self.at = np.concatenate([self.at, used + np.cumsum(size) - size])
        self.size, self.keys = np.concatenate([self.size, size]), np.concatenate([self.keys, hashes])
        self.uses = np.concatenate([self.uses, np.zeros(len(got), np.int64)])
        if 2 * len(self.keys) > len(self.slot):
            self._set(self.keys, self.size, self.flat, self.uses)
        else:
            self._place(n)

    def _ids(self, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these pieces one after another, and where each one's end."""
        size = self.size[piece]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.at[piece] - ends + size, size) + np.arange(size.sum())], ends

    def _evict(self) -> None:
        """Keep the more used half; uses are halved, so that old ones fade."""
        order = np.argsort(-self.uses, kind="stable")[:self.LIMIT // 2]
        keep = np.sort(order[np.cumsum(self.size[order]) <= self.IDS // 2])
        self._set(self.keys[keep], self.size[keep], self._ids(keep)[0], self.uses[keep] >> 1)

    def encode(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the bounds of each text in them."""
        if not self.fits:
            cut = w.text_starts.tolist()
            texts = [w.buf[a:b - 1].decode("utf-8", "replace") for a, b in zip(cut, cut[1:])]
            got = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.concatenate([np.empty(0, np.uint32), *got]), np.cumsum([0, *map(len, got)])
        if len(self.keys) > self.LIMIT or len(self.flat) > self.IDS:
            self._evict()
        w, kind = pieces_of(w)
        piece = self._find(w.hashes)
        miss = np.flatnonzero(piece < 0)
        if len(miss):
            n = len(self.keys)
            new, seen = np.unique(w.hashes[miss], return_index=True)
            starts, ends, data = w.starts[miss[seen]], w.ends[miss[seen]], w.array.data
            for k in range(0, len(new), self.LEARNT):
                s, e = starts[k:k + self.LEARNT], ends[k:k + self.LEARNT]
                self._learn(new[k:k + self.LEARNT], [bytes(data[a:b]) for a, b in zip(s.tolist(), e.tolist())], kind[s] == OTHER)
            piece[miss] = n + np.searchsorted(new, w.hashes[miss])
        self.uses += np.bincount(piece, minlength=len(self.uses))
        ids, ends = self._ids(piece)
        return ids, np.concatenate([[0], ends])[w.first]


_known: dict[str, RunIds] = {}


def run_ids(model: bytes) -> RunIds:
    """The worker's store for this tokenizer (one at a time)."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _known:
        _known.clear()
        _known[key] = RunIds(load_tokenizer(model))
        release()  # what reading its file took
    return _known[key]


def load_tokenizer(model: bytes):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_buffer(model)


def write_shards(docs: DataFrame, model: bytes, out: str, end_id: int = END_ID, id_col="doc_id",
                 text_col="text", block: int = BLOCK) -> DataFrame:
    """Write the shards under ``out`` and return the manifest, one row per shard."""
    n = shuffle_partitions(docs.sparkSession)
    bits = bits_for(max(load_tokenizer(model).get_vocab_size(), end_id + 1))

    def write(batches):
        runs = run_ids(model)
        shard, writer = TaskContext.get().partitionId(), None
        path = f"{out}/shards/shard-{shard:06d}-{uuid.uuid4().hex}.ids"
        sink = None
        for b in sliced(batches, rows=250):
            doc_ids = b.column("doc_id").to_pylist()
            if doc_ids and writer is None:
                store, place = pafs.FileSystem.from_uri(path)
                store.create_dir(os.path.dirname(place), recursive=True)
                sink = store.open_output_stream(place, compression=None)
                writer = ShardWriter(sink, bits, block)
            for first, w in word_batches(b.column("text").to_pylist(), size=1 << 20):
                ids, bounds = runs.encode(w)
                for k, doc_id in enumerate(doc_ids[first:first + len(bounds) - 1]):
                    writer.add(doc_id, np.append(ids[bounds[k]:bounds[k + 1]], np.uint32(end_id)))
        if writer is not None:
            size = writer.close()
            sink.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([path]), pa.array([len(writer.docs)], pa.int64()),
                 pa.array([writer.n_ids], pa.int64()), pa.array([size], pa.int64())],
                ["shard", "path", "n_docs", "n_ids", "n_bytes"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_of(text_col).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    return saved(ordered.select("doc_id", "text").mapInArrow(write, MANIFEST), f"{out}/manifest")


def read_digests(manifest: DataFrame) -> DataFrame:
    """Per document, read back from the shards: doc_id, start, n_tokens, ids_crc32."""
    first = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    placed = manifest.select("shard", "path", F.coalesce(first, F.lit(0)).alias("base"))
    at_once = 1 << 20  # ids unpacked together

    def read(batches):
        for b in batches:
            for path, base in zip(b.column("path").to_pylist(), b.column("base").to_pylist()):
                store, place = pafs.FileSystem.from_uri(path)
                with store.open_input_file(place) as source:
                    r, d = ShardReader(source), 0
                    while d < len(r.docs):
                        e = max(d + 1, int(np.searchsorted(r.starts, r.starts[d] + at_once, "right")) - 1)
                        ids, s = r.ids(int(r.starts[d]), int(r.starts[e])), r.starts[d:e + 1] - r.starts[d]
                        crc = [zlib.crc32(ids[s[i]:s[i + 1]]) for i in range(e - d)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(r.docs[d:e], pa.int64(), mask=r.nulls[d:e]), pa.array(r.starts[d:e] + base),
                             pa.array(np.diff(s)), pa.array(crc, pa.int64())],
                            ["doc_id", "start", "n_tokens", "ids_crc32"])
                        d = e

    spread = placed.repartition(shuffle_partitions(manifest.sparkSession), "shard")
    return spread.mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def query(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), model_path)


def digests(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    import public_tokenizers

    model = Path(model_path or public_tokenizers.path("word_bpe_49k.json")).read_bytes()
    return read_digests(write_shards(docs, model, scratch(docs.sparkSession, "packed-ids")))
