"""Texts to token ids, written as wavelet-matrix shards and read back."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, pairwise
from string import punctuation
from unicodedata import category

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer, pre_tokenizers

from . import wavelet
from .common import kept, map_batches, scratch_path, small_batches, staged

#: Texts of these characters, with no two white spaces in a row, are cut before each space and line end, places
#: that byte-level BPE of this family never merges across.  Texts that match this go to the library whole.
ODD = r"[^\n\x20-\x7E\x{A1}-\x{17F}]|[\n ][\n ]"
FIRST = "\x00"  # marks the first unit of a text, or a piece inside a unit: no space stands before it
_PLAIN = [chr(c) for c in (10, *range(0x20, 0x7F), *range(0xA1, 0x180))]
_KIND = {k: "".join(re.escape(c) for c in _PLAIN if category(c)[0] == k) for k in "LN"}
#: What the library's byte-level splitter matches, for texts that ODD does not match.
PIECE = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_KIND['L']}]+| ?[{_KIND['N']}]+| ?[^ \n{_KIND['L']}{_KIND['N']}]+|[ \n]")
LETTERS = "".join(c for c in _PLAIN if category(c)[0] == "L")
#: Signs that stand for bytes in the library's vocabulary.
_SIGNS = np.arange(256, dtype="<u4")
for _c in _PLAIN:
    _SIGNS[list(_c.encode())] = [ord(x) for x in pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(_c)[0][0]]
APART = "\x01"  # stands behind each piece on its way to the model
CACHE_UNITS, CACHE_BYTES, ENCODE_BYTES = 1_500_000, 64 << 20, 10 << 20
TABLE_UNITS, UNITS_AT_ONCE = 1 << 18, 1 << 17  # hashed at once; laid out as ids at once
AT_ONCE = 32  # pieces merged in one call
SHARD_TOKENS = 2_000_000


@dataclass(frozen=True)
class Settings:
    """``tokenizer``: path of a tokenizers file.  ``end``: id after each document.  ``shard_rows``: documents
    of a range, about, and ``parts`` ranges at most; a shard file is closed at ``shard_tokens`` ids and holds whole documents."""

    tokenizer: str
    end: int = 0
    shard_rows: int = 4096
    shard_tokens: int = SHARD_TOKENS
    parts: int = 200_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _apart(model: dict) -> str | None:
    """A sign that no merge knows and no unit holds: pieces with it between them can be merged in one call."""
    if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk")):
        return None
    used = {chr(x) for x in _SIGNS}.union(*(m.split(" ") if isinstance(m, str) else m for m in model["merges"]))
    return min((t for t in model["vocab"] if len(t) == 1 and t not in used), default=None)


class Encoder:
    """The library's ids.  Merges never cross units, so each distinct unit is encoded once and kept in tables, which are
    searched one by one and emptied beyond CACHE_UNITS or CACHE_BYTES."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        pre = spec.get("pre_tokenizer") or {}
        self.by_unit = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer") and not (spec.get("model") or {}).get("dropout")
        self.apart = _apart(spec.get("model") or {})
        self.odd = "|".join([ODD, *(re.escape(x) for x in self.special)])
        self._empty()

    def _empty(self) -> None:
        self.tables: list[pa.Array] = []
        self.units = self.used = 0
        self.first, self.length, self.ids = np.zeros(1024, np.int64), np.zeros(1024, np.int32), np.zeros(4096, np.uint16)

    def held(self) -> int:
        """Bytes of the tables."""
        return sum(t.nbytes for t in self.tables) + self.first.nbytes + self.length.nbytes + self.ids.nbytes

    @staticmethod
    def _room(x: np.ndarray, n: int) -> np.ndarray:
        return x if n <= len(x) else np.concatenate([x, np.zeros(max(n, 5 * len(x) // 4) - len(x), x.dtype)])

    @staticmethod
    def _pieces(key: str) -> list[str]:
        """The unit cut as byte-level BPE cuts it before it merges; pieces are keys of units themselves."""
        found = PIECE.findall(key[1:] if key[:1] == FIRST else key if key[:1] == "\n" else " " + key)
        return [x[1:] if x[0] == " " else x if x == "\n" else FIRST + x for x in found] or [key]

    def _add(self, n: int, flat: np.ndarray, length: np.ndarray) -> None:
        """The ids of n more units."""
        if self.ids.dtype == np.uint16 and len(flat) and flat.max() > 0xFFFF:
            self.ids = self.ids.astype(np.uint32)
        self.ids, self.first, self.length = self._room(self.ids, self.used + len(flat)), self._room(self.first, self.units + n), self._room(self.length, self.units + n)
        self.ids[self.used : self.used + len(flat)] = flat
        self.length[self.units : self.units + n] = length
        self.first[self.units : self.units + n] = self.used + np.cumsum(length) - length
        self.used += len(flat)
        self.units += n

    def _flat(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units at these places in a row, and where each unit's end."""
        length = self.length[at]
        upto = np.cumsum(length, dtype=np.int64)
        return self.ids[np.repeat(self.first[at] - (upto - length), length) + np.arange(upto[-1] if len(at) else 0)], upto

    def _merged(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces in a row by the library's model, and how many each has."""
        bare = pc.or_(pc.starts_with(pieces, FIRST), pc.equal(pieces, "\n"))
        spaced = pc.binary_join_element_wise(pc.if_else(bare, "", " "), pieces, APART, "")
        ends = [*range(0, len(pieces), AT_ONCE if self.apart else 1), len(pieces)]
        signs, own = _SIGNS.copy(), self.library.token_to_id(self.apart) if self.apart else -1
        signs[ord(APART)] = ord(self.apart or APART)

        def ids() -> Iterator[int]:
            for group in pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spaced), "").to_pylist():
                text = signs[np.frombuffer(group.replace(FIRST, "").encode(), np.uint8)].tobytes().decode("utf-32-le")
                if self.apart:
                    yield from (t.id for t in self.library.model.tokenize(text))
                else:
                    yield from (t.id for t in self.library.model.tokenize(text[:-1])) if len(text) > 1 else ()
                    yield own

        flat = np.fromiter(ids(), np.int64)
        between = flat == own
        return flat[~between], np.diff(np.flatnonzero(between), prepend=-1) - 1

    def _learn(self, keys: pa.Array) -> pa.Array:
        """The library's model merges each piece once; units of several pieces take the ids of these.  Returns what was
        added, pieces first, in the order of places."""
        alpha = pc.utf8_is_alpha(keys)
        rest = keys.filter(pc.invert(alpha))
        head = pc.utf8_rtrim(rest, punctuation)
        two = pc.utf8_is_alpha(head)
        double, other = rest.filter(two), rest.filter(pc.invert(two)).to_pylist()
        marks = pc.binary_join_element_wise(FIRST, pc.utf8_ltrim(double, LETTERS), "")
        cut = [self._pieces(k) for k in other]
        folded = pa.concat_arrays([keys.filter(alpha), head.filter(two), marks, pa.array(chain.from_iterable(cut), pa.string())]).dictionary_encode()
        kinds, of = folded.dictionary, folded.indices.to_numpy()
        place = self._places(kinds, self.tables)
        new = kinds.filter(pa.array(place < 0))
        place[place < 0] = self.units + np.arange(len(new))
        for i in range(0, len(new), 8192):
            part = new.slice(i, 8192)
            self._add(len(part), *self._merged(part))
        lo, n = len(keys) - len(rest), len(double)
        many = np.fromiter((len(c) for c in cut), np.int64, len(cut))
        pairs, loose = place[of[lo : lo + 2 * n]].reshape(2, n).T.ravel(), place[of[lo + 2 * n :]][np.repeat(many > 1, many)]
        flat, upto = self._flat(np.concatenate([pairs, loose]))
        ends = upto[np.cumsum(np.concatenate([np.full(n, 2), many[many > 1]])) - 1]
        self._add(len(ends), flat, np.diff(ends, prepend=0))
        learned = pa.concat_arrays([new, double, pa.array((k for k, c in zip(other, cut, strict=True) if len(c) > 1), pa.string())])
        if self.tables and len(self.tables[-1]) + len(learned) <= TABLE_UNITS:
            self.tables[-1] = pa.concat_arrays([self.tables[-1], learned])
        else:
            self.tables.append(learned)
        return learned

    @staticmethod
    def _places(keys: pa.Array, tables: list[pa.Array], base: int = 0) -> np.ndarray:
        """Places of the keys in tables that begin at ``base``, -1 for those in none.  One table is hashed at a time."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for table in tables:
            if not len(left):
                break
            at = pc.index_in(keys, value_set=table)
            known = at.is_valid().to_numpy(zero_copy_only=False)
            out[left[known]] = base + at.drop_null().to_numpy()
            keys, left, base = keys.filter(at.is_null()), left[~known], base + len(table)
        return out

    def _find(self, keys: pa.Array) -> np.ndarray:
        """Places of the keys in the tables; new ones are learned at the end."""
        out, base = self._places(keys, self.tables), self.units
        if len(left := np.flatnonzero(out < 0)):
            keys = keys.take(pa.array(left))
            out[left] = self._places(keys, [self._learn(pc.unique(keys))], base)
        return out

    def __call__(self, text: str) -> np.ndarray:
        return self.many(pa.array([text]))[0]

    def many(self, batch: pa.Array) -> list[np.ndarray]:
        """Ids of each text of an Arrow array without nulls."""
        if self.units > CACHE_UNITS or self.held() > CACHE_BYTES:
            self._empty()
        whole = pc.match_substring_regex(batch, self.odd).to_numpy(zero_copy_only=False) if self.by_unit else np.ones(len(batch), bool)
        units = pc.split_pattern(pc.replace_substring(batch.filter(pa.array(~whole)), "\n", " \n"), " ")
        edges = units.offsets.to_numpy() - units.offsets[0].as_py()
        folded = units.flatten().dictionary_encode()
        del units
        kinds, of = folded.dictionary, folded.indices.to_numpy()
        found = self._find(pa.concat_arrays([kinds, pc.binary_join_element_wise(FIRST, kinds.take(pa.array(of[edges[:-1]])), "")]))
        plain = self._laid(found[: len(kinds)], of, found[len(kinds) :], edges)
        return [np.array(self.library.encode(batch[i].as_py(), add_special_tokens=False).ids, np.uint32) if w else next(plain) for i, w in enumerate(whole.tolist())]

    def _laid(self, found: np.ndarray, of: np.ndarray, opening: np.ndarray, edges: np.ndarray) -> Iterator[np.ndarray]:
        """Ids of each text, about UNITS_AT_ONCE units at a time; ``opening``: places of the texts' first units."""
        lo = 0
        while lo < len(opening):
            hi = max(lo + 1, int(np.searchsorted(edges, edges[lo] + UNITS_AT_ONCE, "right")) - 1)
            own = edges[lo : hi + 1] - edges[lo]
            at = found[of[edges[lo] : edges[hi]]]
            at[own[:-1]] = opening[lo:hi]
            flat, upto = self._flat(at)
            ends = np.concatenate([[0], upto])[own].tolist()
            yield from (flat[a:b] for a, b in pairwise(ends))
            lo = hi


def encoder(path: str) -> Encoder:
    """One encoder a worker process, kept while its tasks are of one kind."""
    return kept(path, Encoder)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about ENCODE_BYTES of text: the unit table is hashed once for each."""
    held, size = [], 0
    for batch in batches:
        for at in range(0, len(batch), 128):
            held.append(batch.slice(at, 128))
            size += pc.sum(pc.binary_length(held[-1].column("text"))).as_py() or 0
            if size >= ENCODE_BYTES:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _shards(batches: Iterator[pa.RecordBatch], folder: str, s: Settings) -> Iterator[pa.RecordBatch]:
    """Writes shards; yields (part, number, path, n_docs, n_tokens).  A retried task writes files of new names."""
    from pyspark import TaskContext

    part, encode = TaskContext.get().partitionId(), encoder(s.tokenizer)
    ids, docs, held, number, attempt = [], [], 0, 0, uuid.uuid4().hex[:10]

    def close() -> pa.RecordBatch:
        nonlocal ids, docs, held, number
        path = f"{folder}/shard-{part:06d}-{number:04d}-{attempt}.cwm"
        wavelet.put(path, wavelet.encode(np.concatenate(ids), docs))
        row = [[part], [number], [path], [len(docs)], [held]]
        ids, docs, held, number = [], [], 0, number + 1
        return pa.RecordBatch.from_arrays([pa.array(row[0], pa.int32()), pa.array(row[1], pa.int32()), pa.array(row[2]), pa.array(row[3], pa.int64()), pa.array(row[4], pa.int64())], ["part", "number", "path", "n_docs", "n_tokens"])

    for piece in _gathered(batches):
        for doc_id, got in zip(piece.column("doc_id").to_pylist(), encode.many(pc.fill_null(piece.column("text"), "")), strict=True):
            ids += [got, np.array([s.end], got.dtype if s.end < 1 << 16 else np.uint32)]
            docs.append((doc_id, len(got) + 1))
            held += len(got) + 1
            if held >= s.shard_tokens:
                yield close()
    if docs:
        yield close()


def write_shards(docs: DataFrame, settings: Settings, order: list[str] | None = None) -> DataFrame:
    """The shards' list.  ``docs`` comes by doc_id and a hash of the text or, with ``order``, by those columns; nulls first."""
    spark = docs.sparkSession
    own = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    keys = [F.col(c) for c in order] if order else [F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string"))]
    rows = docs.select(*own, *(k.alias(f"by{i}") for i, k in enumerate(keys)))
    parts = max(1, min(-(-docs.count() // settings.shard_rows), settings.parts))
    small_batches(spark)
    by = [F.col(f"by{i}").asc_nulls_first() for i in range(len(keys))]
    ranged = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by)
    folder = scratch_path(spark, "tokens")
    return staged(map_batches(ranged.select("doc_id", "text"), _shards, "part int, number int, path string, n_docs long, n_tokens long", folder, settings), "shards")


def laid_out(shards: DataFrame, block: int = 1024) -> DataFrame:
    """(i, path, base): each shard's number and the ids of all shards before it.

    Running sums over blocks of parts, then over the parts of a block, then over the shards of a part: no task or
    driver sees all shards.
    """
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    parts = shards.groupBy("part").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("ids")).withColumn("block", F.floor(F.col("part") / block))
    blocks = parts.groupBy("block").agg(F.sum("n").alias("n"), F.sum("ids").alias("ids"))
    blocks = blocks.select("block", before("n", Window.orderBy("block")).alias("n0"), before("ids", Window.orderBy("block")).alias("ids0"))
    of_block = Window.partitionBy("block").orderBy("part")
    parts = parts.select("block", "part", before("n", of_block).alias("n1"), before("ids", of_block).alias("ids1")).join(blocks, "block")
    parts = parts.select("part", (F.col("n0") + F.col("n1")).alias("n_before"), (F.col("ids0") + F.col("ids1")).alias("ids_before"))
    of_part = Window.partitionBy("part").orderBy("number")
    rows = shards.select("part", "path", (F.row_number().over(of_part) - 1).alias("at"), before("n_tokens", of_part).alias("ids")).join(parts, "part")
    return rows.select((F.col("n_before") + F.col("at")).alias("i"), "path", (F.col("ids_before") + F.col("ids")).alias("base"))


def read_shards(shards: DataFrame, most_parts: int = 200_000) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files: a shard a task, beyond ``most_parts`` several."""
    parts = max(1, min(shards.count(), most_parts))
    listed = staged(laid_out(shards), "laid")
    listed = listed.repartitionById(parts, (F.col("i") % parts).cast("int")).select("path", "base")
    return map_batches(listed, wavelet.read_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")


def report(docs: DataFrame, settings: Settings, order: list[str] | None = None) -> DataFrame:
    """Null texts are empty and hold the end id alone.  Null ids come first; rows that repeat an id follow each other,
    by a hash of their texts.  Other columns are not looked at; an empty table gives no rows."""
    return read_shards(write_shards(docs, settings, order))
