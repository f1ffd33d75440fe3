"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces, with byte fallback.

A vocabulary of pieces comes from a public model file (nothing is trained). That file ranks its pieces; their log scores here follow
Zipf's law, -ln(rank + 2.7), as the file holds no probabilities; they are whole millionths, so that sums and ties are exact. A text's encoding is the sequence of pieces with the greatest sum of log scores; of equal sums the one whose
last pieces are longer, from the end on.

White space: a marker is put before the text and in place of every space. No piece but runs of markers has a marker behind another
character, so best paths never cross from a word into the next marker; words are solved one by one and remembered. Characters
that no piece covers, and the marker itself where a text holds it, become one byte piece for each UTF-8 byte. Decoding joins pieces
and bytes, turns markers into spaces and drops the one put in front, so every text comes back exactly.

Defined results: a null text has null ids; an empty one has none, and comes back empty; repeated rows get equal results; an empty table
gives an empty table. Columns other than the two named are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARKER = "▁"
_MARK = MARKER.encode()
#: Words that a Python worker remembers.
MEMO_WORDS = 500_000
#: Log score of a byte piece: below any piece, so bytes are used only where nothing else fits.
BYTE_SCORE = -30_000_000


class DoubleArray:
    """A trie over bytes in two arrays: from state s, byte b leads to base[s] + b + 1 if check there is s. value: piece or -1."""

    def __init__(self, base: list[int], check: list[int], value: list[int]):
        self.base, self.check, self.value = base, check, value

    @classmethod
    def build(cls, keys: list[bytes], values: list[int]) -> DoubleArray:
        tree: dict = {}
        for key, v in zip(keys, values, strict=True):
            node = tree
            for b in key:
                node = node.setdefault(b, {})
            node[-1] = v
        base, check, value = [0], [-1], [-1]

        def room(n: int) -> None:
            more = n + 1 - len(base)
            if more > 0:
                base.extend([0] * more)
                check.extend([-2] * more)
                value.extend([-1] * more)

        # A search begins where the last long one ended: some places stay empty, but building takes linear time.
        free, todo = 1, [(tree, 0)]
        while todo:
            node, state = todo.pop()
            value[state] = node.get(-1, -1)
            steps = sorted(b for b in node if b >= 0)
            if not steps:
                continue
            at, tried = max(0, free - steps[0] - 1), 0
            while True:
                room(at + steps[-1] + 1)
                if all(check[at + b + 1] == -2 for b in steps):
                    break
                at, tried = at + 1, tried + 1
            if tried > 64 or len(steps) == 1:
                free = at + steps[0] + 1
            base[state] = at
            for b in steps:
                check[at + b + 1] = state
            todo.extend((node[b], at + b + 1) for b in steps)
        return cls(base, check, value)

    def prefixes(self, text: bytes, start: int):
        """(end, value) of every key that begins at start."""
        base, check, value, state = self.base, self.check, self.value, 0
        for i in range(start, len(text)):
            to = base[state] + text[i] + 1
            if to >= len(check) or check[to] != state:
                return
            state = to
            if value[state] >= 0:
                yield i + 1, value[state]


class Vocabulary:
    """pieces: (id, piece, log score); byte_ids: the id of each byte's piece."""

    def __init__(self, pieces: list[tuple[int, str, int]], byte_ids: list[int]):
        if any(MARKER in p.lstrip(MARKER) for _, p, _ in pieces):
            raise ValueError("a piece has a white-space marker behind another character")
        self.pieces, self.byte_ids = pieces, byte_ids
        self.trie = DoubleArray.build([p.encode() for _, p, _ in pieces], list(range(len(pieces))))
        self.scores = [s for _, _, s in pieces]
        self.ids = [i for i, _, _ in pieces]
        self.lengths = [len(p.encode()) for _, p, _ in pieces]
        joined = [[False] * 256 for _ in range(256)]
        for _, p, _ in pieces:
            raw = p.encode()
            for a, b in zip(raw, raw[1:], strict=False):
                joined[a][b] = True
        self._joined = joined
        # Room past the end, so that a step from any state stays inside.
        base, check, value = (np.array([*x, *[fill] * 260], np.int64) for x, fill in ((self.trie.base, 0), (self.trie.check, -2), (self.trie.value, -1)))
        self._arrays = base, check, value, np.array(self.scores, np.int64), np.array(self.ids, np.int64)
        self.bytes_of = {i: p.encode() for i, p, _ in pieces} | {i: bytes([b]) for b, i in enumerate(byte_ids)}

    def viterbi(self, unit: bytes, literal: frozenset[int] = frozenset()) -> tuple[int, list[int]]:
        """(score, ids) of the best path over a unit. literal: places where a marker's bytes stand for themselves."""
        n = len(unit)
        least = -(10**18)
        best = [0] + [least] * n
        back: list[tuple[int, int]] = [(0, -1)] * (n + 1)
        trie, scores, lengths = self.trie, self.scores, self.lengths
        marks = sorted(literal)
        for i in range(n):
            here = best[i]
            if here == least:
                continue
            stop = next((m for m in marks if m >= i), n)  # no piece reaches into a literal marker
            for end, piece in trie.prefixes(unit, i):
                if end > stop:
                    break
                s = here + scores[piece]
                # Ties: the longer last piece, which is the one from the earliest place.
                if s > best[end]:
                    best[end], back[end] = s, (i, self.ids[piece])
            if (unit[i] & 0xC0) != 0x80:
                end = i + 1
                while end < n and (unit[end] & 0xC0) == 0x80:
                    end += 1
                s = here + BYTE_SCORE * (end - i)
                if s > best[end]:
                    best[end], back[end] = s, (i, -2)
        out, at = [], n
        while at:
            start, piece = back[at]
            out.extend([self.byte_ids[b] for b in reversed(unit[start:at])] if piece == -2 else [piece])
            at = start
        return best[n], out[::-1]

    def parts(self, unit: bytes) -> list[bytes]:
        """A unit cut where no piece has the two bytes beside the cut next to each other: every path has an end there."""
        joined, cuts = self._joined, [0]
        cuts += [i for i in range(1, len(unit)) if (unit[i] & 0xC0) != 0x80 and not joined[unit[i - 1]][unit[i]]]
        return [unit[i:j] for i, j in zip(cuts, [*cuts[1:], len(unit)], strict=True)]

    def viterbi_many(self, units: list[bytes]) -> list[list[int]]:
        """The best paths of many units: the same as viterbi() gives one by one, with the trie walked for all units at once."""
        out: list[list[int]] = [[]] * len(units)
        sizes = np.array([len(u) for u in units], np.int64)
        order = np.argsort(sizes, kind="stable")
        base, check, value, scores, ids = self._arrays
        for rows in np.split(order, np.arange(4096, len(order), 4096)):
            lengths = sizes[rows]
            width = int(lengths[-1]) if len(rows) else 0
            if width * len(rows) > 1 << 24:  # very long units go one by one
                for r in rows.tolist():
                    out[r] = self.viterbi(units[r])[1]
                continue
            m = len(rows)
            text = np.zeros((m, width + 1), np.int64)
            for k, r in enumerate(rows.tolist()):
                text[k, : lengths[k]] = np.frombuffer(units[r], np.uint8)
            least = -(10**18)
            best, back, piece_of = np.full((width + 1, m), least, np.int64), np.zeros((width + 1, m), np.int64), np.full((width + 1, m), -2, np.int64)
            best[0] = 0
            text = np.ascontiguousarray(text.T)
            for i in range(width):
                live = np.flatnonzero((best[i] > least) & (lengths > i))
                here, at, state, j = best[i], live, np.zeros(len(live), np.int64), i
                while len(at) and j < width:
                    to = base[state] + text[j, at] + 1
                    ok = (check[to] == state) & (lengths[at] > j)
                    at, state, j = at[ok], to[ok], j + 1
                    found = value[state]
                    good = found >= 0
                    w, found = at[good], found[good]
                    s = here[w] + scores[found]
                    good = s > best[j, w]
                    w = w[good]
                    best[j, w], back[j, w], piece_of[j, w] = s[good], i, ids[found[good]]
                lead = live[(text[i, live] & 0xC0) != 0x80]
                first = text[i, lead]
                n = 1 + (first >= 0xC0).astype(np.int64) + (first >= 0xE0) + (first >= 0xF0)
                end = np.minimum(i + n, lengths[lead])
                s = here[lead] + BYTE_SCORE * (end - i)
                good = s > best[end, lead]
                w, end = lead[good], end[good]
                best[end, w], back[end, w], piece_of[end, w] = s[good], i, -2
            back_rows, piece_rows = back.T.tolist(), piece_of.T.tolist()
            for k, r in enumerate(rows.tolist()):
                path, at, unit = [], int(lengths[k]), units[r]
                while at:
                    start, piece = back_rows[k][at], piece_rows[k][at]
                    if piece == -2:
                        path.extend(self.byte_ids[x] for x in reversed(unit[start:at]))
                    else:
                        path.append(piece)
                    at = start
                out[r] = path[::-1]
        return out

    def encoder(self):
        """texts -> for each, its ids as bytes (little-endian unsigned 32-bit)."""
        import regex

        memo: dict[bytes, bytes] = {}
        solved: dict[bytes, bytes] = {}
        units = regex.compile(rb" *[^ ]+| +").findall

        def learn(fresh: list[bytes]) -> None:
            # Spaces before a word are markers; so is the one before the text.
            cut = [self.parts(u.replace(b" ", _MARK)) for u in fresh]
            unknown = list({p for ps in cut for p in ps if p not in solved})
            solved.update((u, np.array(x, "<u4").tobytes()) for u, x in zip(unknown, self.viterbi_many(unknown), strict=True))
            memo.update((u, b"".join([solved[p] for p in ps])) for u, ps in zip(fresh, cut, strict=True))

        def with_literal(text: str) -> bytes:
            # A text that holds the marker itself: its places are kept from the pieces.
            out = []
            for unit in units(b" " + text.encode("utf-8", "surrogatepass")):
                raw, places, at = bytearray(), set(), 0
                while at < len(unit):
                    if unit.startswith(_MARK, at):
                        places.add(len(raw))
                        raw += _MARK
                        at += 3
                    else:
                        raw += _MARK if unit[at] == 32 else unit[at : at + 1]
                        at += 1
                out.append(np.array(self.viterbi(bytes(raw), frozenset(places))[1], "<u4").tobytes())
            return b"".join(out)

        def encode(texts: list[str]) -> list[bytes]:
            split = [units(b" " + t.encode("utf-8", "surrogatepass")) if t and MARKER not in t else None for t in texts]
            if len(memo) > MEMO_WORDS:
                memo.clear()
            if len(solved) > MEMO_WORDS:
                solved.clear()
            fresh = {u for us in split if us for u in us if u not in memo}
            if fresh:
                learn(list(fresh))
            return [b"".join(map(memo.__getitem__, us)) if us else with_literal(t) if t else b"" for us, t in zip(split, texts, strict=True)]

        return encode

    def decoder(self):
        """ids -> text."""
        # A byte piece may be part of a literal marker, so spaces are told apart by what a piece is, before bytes are joined.
        of_bytes = set(self.byte_ids)
        plain = {i: (b if i in of_bytes else b.replace(_MARK, b" ")) for i, b in self.bytes_of.items()}

        def decode(ids) -> str:
            raw = b"".join(map(plain.__getitem__, ids))
            return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "surrogatepass")

        return decode


def load(model_file: str) -> Vocabulary:
    """The pieces of a SentencePiece model file that stand for text, and its byte pieces."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=model_file)
    pieces, byte_ids, rank = [], [0] * 256, 0
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[1:-1], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            rank += 1
            pieces.append((i, piece, round(-1e6 * math.log(rank + 2.7))))
    return Vocabulary(pieces, byte_ids)


def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id, ids, n_byte_pieces, and whether decoding the ids gives the text back."""
    pieces, byte_ids = vocabulary.pieces, vocabulary.byte_ids
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        own = Vocabulary(pieces, byte_ids)
        encode_texts, decode = own.encoder(), own.decoder()
        is_byte = np.zeros(max(own.bytes_of) + 1, bool)
        is_byte[byte_ids] = True
        for batch in batches:
            for lo in range(0, len(batch), 500):
                texts = batch.column(1).slice(lo, 500).to_pylist()
                raw = [None if t is None else np.frombuffer(x, "<u4") for t, x in zip(texts, encode_texts([t or "" for t in texts]), strict=True)]
                offsets = np.zeros(len(raw) + 1, np.int32)
                np.cumsum([0 if x is None else len(x) for x in raw], out=offsets[1:])
                flat = np.concatenate([x for x in raw if x is not None] or [np.zeros(0, "<u4")]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array([x is None for x in raw]))
                fallback = pa.array([None if x is None else int(is_byte[x].sum()) for x in raw], pa.int64())
                back = pa.array([None if x is None else decode(x.tolist()) == t for x, t in zip(raw, texts, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 500), ids, fallback, back], names=[id_col, "ids", "n_byte_pieces", "comes_back"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, n_byte_pieces long, comes_back boolean")


def decode(encoded: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from (id, ids)."""
    pieces, byte_ids = vocabulary.pieces, vocabulary.byte_ids
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        decode_one = Vocabulary(pieces, byte_ids).decoder()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else decode_one(x) for x in batch.column(1).to_pylist()], pa.string())], names=[id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")
