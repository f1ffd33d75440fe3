"""Best-fit packing: best-fit decreasing with a segment tree over remaining capacities.

What best-fit decreasing does with a piece depends on its length only, so it runs over the histogram of lengths (at most `capacity`
numbers, whatever the corpus): bins that look alike form one group, and a segment tree over remaining capacities finds the tightest
open group in logarithmic time. The placement is that of the sequential algorithm, piece by piece, over pieces in descending length.
Pieces find their place by their rank among pieces of the same length, which is counted in a distributed way.

Defined results: a null or empty text is the end token alone; repeated rows (also repeated ids) are packed as documents of their
own; an empty table gives an empty table; of the input only the two named columns are read, so other columns can't clash.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrain.llm.common import gapless, materialise

#: Distinct words whose ids a Python worker remembers.
MEMO_WORDS = 400_000


class CapacityTree:
    """Counts of open bins by remaining capacity; finds the smallest capacity >= x that has any, in logarithmic time."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.sums = [0] * (2 * self.leaves)

    def add(self, at: int, n: int) -> None:
        i = at + self.leaves
        while i:
            self.sums[i] += n
            i >>= 1

    def tightest(self, least: int) -> int | None:
        i = least + self.leaves
        if self.sums[i]:
            return least
        while i > 1:
            if not i & 1 and self.sums[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.sums[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over {length: number of pieces}.

    Returns runs (length, first rank, pieces, first bin, pieces a bin, offset in the bin): the piece of that length with rank
    first + t lies in bin first_bin + t // per at offset + (t % per) * length.
    """
    tree, open_bins, runs, bins = CapacityTree(capacity), {}, [], 0

    def put(left: int, first: int, count: int) -> None:
        if left and count:
            open_bins.setdefault(left, []).append((first, count))
            tree.add(left, count)

    for length in sorted(histogram, reverse=True):
        rank, todo = 0, histogram[length]
        while todo:
            left = tree.tightest(length)
            if left is None:
                left, per = capacity, capacity // length
                count = -(-todo // per)
                first, bins = bins, bins + count
            else:
                per = left // length
                first, count = open_bins[left].pop()
                tree.add(left, -count)
            whole = min(count, todo // per)
            if whole:
                runs.append((length, rank, whole * per, first, per, capacity - left))
                put(left - per * length, first, whole)
                rank, todo = rank + whole * per, todo - whole * per
            rest = 0
            if whole < count and 0 < todo < per:
                rest, at = todo, first + whole
                runs.append((length, rank, rest, at, per, capacity - left))
                put(left - rest * length, at, 1)
                rank, todo = rank + rest, 0
            used = whole + bool(rest)
            put(left, first + used, count - used)
    return runs


@lru_cache(maxsize=1)
def _encoder(tokenizer_json: str):
    """Texts to the bytes of their ids (little-endian unsigned 32-bit); words and their parts are remembered. A Python worker makes it once.

    A word of letters below U+0250 goes the short way if the tokenizer has the one normaliser and splitter known here: lower case,
    the splitter's pattern, then the tokenizer's own merges. Every other word goes through the whole tokenizer.
    """
    import json
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import regex
    from tokenizers import Tokenizer

    class Memo(dict):
        def __missing__(self, word: bytes) -> bytes:
            found = self[word] = word_ids(word)
            return found

    tokenizer, memo, parts = Tokenizer.from_str(tokenizer_json), Memo(), {}
    model, made = tokenizer.model, json.loads(tokenizer_json)
    split_by, byte_level = ([*((made["pre_tokenizer"] or {}).get("pretokenizers") or []), {}, {}])[:2]
    kinds = [x["type"] for x in (made["normalizer"] or {}).get("normalizers") or []]
    short = kinds == ["NFC", "Replace", "Lowercase"] and split_by.get("type") == "Split" and split_by.get("invert") and split_by.get("behavior") == "Removed"
    short = short and byte_level.get("type") == "ByteLevel" and not byte_level.get("add_prefix_space") and not byte_level.get("use_regex")
    find = regex.compile(split_by["pattern"]["Regex"]).findall if short else None
    plain = regex.compile("[\u0000-\u012f\u0131-\u024f]*").fullmatch
    special = [x["content"] for x in made["added_tokens"]]
    # Bytes that print stand for themselves, the others for the code points from 256 on: the published byte-level alphabet.
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    alphabet = {b: 256 + i for i, b in enumerate(hidden)}

    def part_ids(part: str) -> bytes:
        found = parts.get(part)
        if found is None:
            if len(parts) > MEMO_WORDS:
                parts.clear()
            shown = part if part.isascii() and part.isalpha() else part.encode().decode("latin-1").translate(alphabet)
            found = parts[part] = b"".join([x.id.to_bytes(4, "little") for x in model.tokenize(shown)])
        return found

    def word_ids(word: bytes) -> bytes:
        text = word.decode("utf-8", "surrogatepass")
        if short and plain(text):
            # Letters, or letters and one mark after them, need no splitter.
            if text.isalpha():
                return part_ids(text.lower())
            if text[:-1].isalpha() and text[-1] in ".,":
                return part_ids(text[:-1].lower()) + part_ids(text[-1])
            if not any(x in text for x in special):
                return b"".join([part_ids(x) for x in find(text.lower())])
        return np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(text: str) -> bytes:
        words = text.encode("utf-8", "surrogatepass").split()
        if len(memo) > MEMO_WORDS:
            memo.clear()
        return b"".join(map(memo.__getitem__, words))

    return encode


def tokenize_pieces(docs: DataFrame, tokenizer_json: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: id, piece, start, length, ids_crc32 and, if asked for, its ids (bytes, little-endian unsigned 32-bit).

    The tokenizer must not join what ASCII white space parts: its words are encoded one by one and remembered. Texts are taken in
    blocks, so memory follows a block and the longest text.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        encode = _encoder(tokenizer_json)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            texts, ids = batch.column(1), batch.column(0)
            for lo in range(0, len(texts), 500):
                found = [encode(t or "") for t in texts.slice(lo, 500).to_pylist()]
                rows, piece, start, length, crc, raw = [], [], [], [], [], []
                for k, x in enumerate(found):
                    x += end
                    for p, at in enumerate(range(0, len(x), 4 * capacity)):
                        part = x[at : at + 4 * capacity]
                        rows.append(lo + k)
                        piece.append(p)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            raw.append(part)
                columns = [ids.take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = [id_col, "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(raw, pa.binary())] if with_ids else []), names=names + ["ids"] * with_ids)

    schema = f"`{id_col}` {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def place(pieces: DataFrame, capacity: int = 4096, id_col: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces (columns piece, length, ids_crc32)."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    by_length: dict[int, list] = {}
    for run in plan(histogram, capacity):
        by_length.setdefault(run[0], []).append(run[1:])
    runs = {k: np.array(v, np.int64).T for k, v in by_length.items()}
    ranked = gapless(pieces, ["length"], [id_col, "piece", "ids_crc32"], "_place", sum(histogram.values()))
    names = [c for c in ranked.columns if c != "_place"]

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "_place"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                size = int(length[rows[0]])
                first_rank, _, first_bin, per, at = runs[size]
                k = np.searchsorted(first_rank, rank[rows], "right") - 1
                t = rank[rows] - first_rank[k]
                sequence[rows] = first_bin[k] + t // per[k]
                offset[rows] = at[k] + t % per[k] * size
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "_place")
    return ranked.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_json: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = True) -> DataFrame:
    """Tokenise documents, cut those longer than `capacity` and place every piece: a row for each piece."""
    return place(materialise(tokenize_pieces(docs, tokenizer_json, capacity, end_id, with_ids), "pieces"), capacity)
