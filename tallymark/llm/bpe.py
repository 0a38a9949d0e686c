"""Byte-level BPE by backtracking over longest matches (operator 7).

The bytes of a piece are written as Latin-1 text, in which an Aho-Corasick automaton over the whole vocabulary finds, in
one pass, the longest token that starts at each position. Encoding walks from left to right and takes the longest token
that is compatible with the token before it: two adjacent tokens are compatible when byte-pair merging their joint bytes
gives back these very two tokens. Where no token fits, the last one is taken back and the next shorter prefix of it
tried; a position once left behind that way is never entered again, so the work is linear in the bytes. Compatibility
is memoised by token pair: for a token and the next, the longest prefix of the next (or itself) that is compatible. The
result is that of merging pairs in rank order.

Texts are split by the pattern of the rank file. The ids of the pieces are kept in a bounded table: two generations, of
which a full one displaces the older, so that pieces in use stay. Pieces of a group of texts that the table lacks are
encoded together: one pass of the automaton, then the walks of all pieces step by step as arrays. Pieces over 64
characters, which are not kept, walk alone.

Workers outlive their tasks and stand beside the heap in an executor's memory. So tables are small, and an Arrow batch is
encoded and returned in slices.

Defined results: null and empty texts have no ids; lone surrogates cannot occur in Spark strings; rows are independent,
so repeated rows, ties and empty tables need no care; a very long text is one row, encoded as a whole in linear time; a
kept column with the name of a result is refused.
"""

from __future__ import annotations

import base64
import hashlib
import re
import sys
import types
from array import array
from collections.abc import Iterable, Iterator
from functools import partial
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Entries of a generation of a worker's pieces, and of its table of token pairs, which starts anew when full; neither
#: changes a result.
PIECES, PAIRS = 50_000, 300_000
#: Code points of texts that are split together (a longer text is alone), new pieces that walk together, ids that are
#: decoded at once.
POINTS, TOGETHER, IDS = 500_000, 20_000, 10_000
#: Between pieces that walk together: no byte, so no token has it.
BETWEEN = "\u0100"
#: Rows of a batch that are encoded and returned at once.
SLICE = 500

_kept = sys.modules.setdefault("_tallymark_kept", types.ModuleType("_tallymark_kept"))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


#: A text with each sort of character on both sides of a lone space, which no piece may go across.
PROBE = " ".join(["a", "1", ".", "é", "'s", "日", "_", "-1", "\u0301", "x\ny", "\U0001f389", "a1."] * 2 + ["a", ".", "1", "日", "'", "A"])


class Fit(dict):
    """By left * width + right: the longest of right and its prefixes that is compatible with left, or -1."""

    def __init__(self, codec: Codec):
        self.codec, self.width = codec, len(codec.length)

    def __missing__(self, key: int) -> int:
        left, right = divmod(key, self.width)
        base, tried = key - right, []
        while right >= 0 and (known := self.get(base + right)) is None:
            tried.append(right)
            if self.codec.compatible(left, right):
                break
            right = self.codec.shorter[right]
        found = right if right < 0 or known is None else known
        if len(self) + len(tried) > PAIRS:
            self.clear()
        self.update((base + token, found) for token in tried)
        return found


class Codec:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.pieces = regex.compile(pattern).findall
        self.ranks, self.bytes = ranks, {r: b for b, r in ranks.items()}
        automaton = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if len(token) > 1:
                automaton.add_word(token.decode("latin-1"), rank)
        automaton.make_automaton()
        self.matches = automaton.iter if len(automaton) else lambda text: ()
        # by byte or rank; -1: no such token
        self.single = array("i", [ranks.get(bytes([b]), -1) for b in range(256)])
        in_order = [self.bytes.get(r, b"") for r in range(max(ranks.values()) + 1)]
        self.length = array("i", map(len, in_order))
        self.shorter = array("i", map(self.prefix, in_order))
        self.first = np.array([*self.single, -1], np.int64)  # the last for BETWEEN
        self.prefixes = np.array(self.shorter, np.int64)
        self.sizes, self.joined = np.array(self.length, np.int64), np.frombuffer(b"".join(in_order), np.uint8)
        self.starts = self.sizes.cumsum() - self.sizes
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.fit = Fit(self)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes token; None for single bytes and tokens that no merge makes."""
        if token not in self.halves:
            parts, found = [bytes([b]) for b in self.bytes[token]], None
            while len(parts) > 2:
                rank, at = min((self.ranks.get(a + b, token), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                if rank >= token:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if len(parts) == 2:
                found = self.ranks[parts[0]], self.ranks[parts[1]]
            self.halves[token] = found
        return self.halves[token]

    def prefix(self, b: bytes) -> int:
        """The longest token that is a proper prefix of the token b, or -1."""
        return next((self.ranks[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in self.ranks), -1)

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joint bytes of left and right leaves these two tokens.

        Merges run in rank order, leftmost first. So only parts that lie at the border at the same time can merge
        across it: the two tokens themselves, then what was there before the later of their last merges, and so on.
        They do merge if that comes before the merges that use them up on the left (made_a) and on the right (made_b).
        """
        a, b = left, right
        made_a = made_b = len(self.ranks)
        fits = True
        while fits:
            across = self.ranks.get(self.bytes[a] + self.bytes[b])
            fits = across is None or not (across < made_a and across <= made_b)
            parts_a, parts_b = self.split(a), self.split(b)
            if parts_a and (a > b or not parts_b):
                made_a, a = a, parts_a[1]
            elif parts_b:
                made_b, b = b, parts_b[0]
            else:
                break
        return fits

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of a piece that the pattern has found."""
        data = piece.encode()
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        length, shorter, single = self.length, self.shorter, self.single
        longest = [single[b] for b in data]
        for end, rank in self.matches(data.decode("latin-1")):  # of matches from one start, the longest comes last
            longest[end - length[rank] + 1] = rank
        fit, width, n = self.fit, len(length), len(data)
        ids: list[int] = []
        left_behind: set[int] = set()
        at, before, token = 0, -1, longest[0]
        while True:
            if before >= 0 and token >= 0:
                token = fit[before * width + token]
            if token < 0:
                left_behind.add(at)
                token = ids.pop()
                at -= length[token]
                before, token = ids[-1] if ids else -1, shorter[token]
            elif (end := at + length[token]) in left_behind:
                token = shorter[token]
            else:
                ids.append(token)
                if end == n:
                    return ids
                at, before, token = end, token, longest[end]

    def encode_together(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces, as bytes. The walks of encode_piece, those of all pieces a step at a time."""
        text = BETWEEN.join([p.encode().decode("latin-1") for p in pieces]) + BETWEEN
        codes = np.frombuffer(text.encode("utf-16-le"), "<u2")
        longest = self.first[codes]
        ends, ranks = np.fromiter(chain.from_iterable(self.matches(text)), np.int64).reshape(-1, 2).T
        longest[ends - self.sizes[ranks] + 1] = ranks  # of matches from one start, the longest comes last
        stops = np.flatnonzero(codes == 256)
        starts = np.concatenate([[0], stops[:-1] + 1])
        ids, left_behind = np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)  # a piece's ids begin at its start
        counts = np.zeros(len(pieces), np.int64)
        walk, start, stop, at, top, token = np.arange(len(pieces)), starts, stops, starts.copy(), starts.copy(), longest[starts]
        while len(walk):
            asked = np.flatnonzero((top > start) & (token >= 0))
            keys = ids[top[asked] - 1] * len(self.length) + token[asked]
            token[asked] = np.fromiter(map(self.fit.__getitem__, keys.tolist()), np.int64, len(keys))
            none = token < 0
            end = np.where(none, at, at + self.sizes[token])
            blocked = left_behind[end] & ~none
            taken = np.flatnonzero(~(none | blocked))
            token[blocked] = self.prefixes[token[blocked]]
            if len(back := np.flatnonzero(none)):
                if (top[back] == start[back]).any():
                    raise ValueError("a byte has no token")
                left_behind[at[back]] = True
                top[back] -= 1
                last = ids[top[back]]
                at[back] -= self.sizes[last]
                token[back] = self.prefixes[last]
            ids[top[taken]] = token[taken]
            top[taken] += 1
            at[taken] = end[taken]
            token[taken] = longest[end[taken]]
            done = np.zeros(len(walk), bool)
            done[taken] = end[taken] == stop[taken]
            counts[walk[done]] = (top - start)[done]
            walk, start, stop, at, top, token = (x[~done] for x in (walk, start, stop, at, top, token))
        data = ids.astype("<u4").tobytes()
        return [data[4 * a : 4 * b] for a, b in zip(starts.tolist(), (starts + counts).tolist())]

    def encode_group(self, texts: list[str]) -> list[bytes]:
        split = [self.pieces(t) for t in texts]
        lacking = set().union(*split).difference(self.known)
        found = {p: self.older[p] for p in lacking if p in self.older}
        new = sorted(p for p in lacking if p not in found and len(p) <= 64)
        for k in range(0, len(new), TOGETHER):
            found.update(zip(new[k : k + TOGETHER], self.encode_together(new[k : k + TOGETHER])))
        keep = dict(islice(found.items(), PIECES))
        found.update((p, np.array(self.encode_piece(p), "<u4").tobytes()) for p in lacking if len(p) > 64)
        ids = {**self.known, **found}
        if len(self.known) + len(keep) > PIECES:
            self.older, self.known = self.known, {}
        self.known.update(keep)
        return [b"".join(map(ids.__getitem__, pieces)) for pieces in split]

    def encode_all(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        group: list[str] = []
        points = 0
        for text in texts:
            if group and points + len(text) > POINTS:
                yield from self.encode_group(group)
                group, points = [], 0
            group.append(text)
            points += len(text)
        yield from self.encode_group(group)

    def encode(self, text: str) -> bytes:
        return self.encode_group([text])[0]

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids, gathered from those of all tokens."""
        found = []
        every = np.frombuffer(ids, "<u4")
        for at in range(0, len(every), IDS):
            some = every[at : at + IDS]
            sizes = self.sizes[some]
            ends = sizes.cumsum()
            found.append(self.joined[np.arange(ends[-1]) + np.repeat(self.starts[some] - ends + sizes, sizes)].tobytes())
        return b"".join(found)


_FOLLOWED, _LED = re.compile(r" \s").search, re.compile(r"[^\S ] ").search


def spaces_stand_alone(text: str) -> bool:
    """Whether each space has a non-blank on both sides."""
    return text[:1] != " " and text[-1:] != " " and "  " not in text and not _FOLLOWED(text) and not _LED(text)


def chunks(text: str) -> list[str]:
    """text cut before each space that stands alone between non-blank characters; the space leads the chunk.

    A space next to other white space stays within its chunk, which the pattern then splits.
    """
    parts = text.split(" ")
    if spaces_stand_alone(text):
        return [parts[0], *map(" ".__add__, parts[1:])]
    out: list[str] = []
    open_part = None  # a chunk that may go on
    for part in parts:
        if open_part is None:
            open_part = part
        elif not part or not open_part or open_part[-1].isspace() or part[0].isspace():
            open_part = f"{open_part} {part}"
        else:
            out.append(open_part)
            open_part = " " + part
    out.append(open_part or "")
    return out


def codec(path: str, pattern: str) -> Codec:
    """One codec a worker process and file."""
    table = _kept.__dict__.setdefault("codecs", {})
    if (path, pattern) not in table:
        table[path, pattern] = Codec(read_ranks(path), pattern)
    return table[path, pattern]


def encoded_slices(batches: Iterator[pa.RecordBatch], path: str, pattern: str, keep: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of SLICE rows at most: the columns keep, n_tokens, ids and decoded of batches whose last column is the text."""
    own = codec(path, pattern)
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            rows = batch.slice(at, SLICE)
            ids = list(own.encode_all(t.as_py() or "" for t in rows.column(rows.num_columns - 1)))
            new = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(map(own.decode, ids), pa.binary())]
            yield pa.RecordBatch.from_arrays([*rows.columns[: len(keep)], *new], names=[*keep, "n_tokens", "ids", "decoded"])


def encoded(docs: DataFrame, path: str, pattern: str, keep: list[str]) -> DataFrame:
    """The columns keep of docs with n_tokens, ids (binary, little-endian 32-bit) and decoded (bytes made from ids)."""
    if clash := {"n_tokens", "ids", "decoded"} & set(keep):
        raise ValueError(f"columns that cannot be kept, as results have their names: {sorted(clash)}")
    kept = docs.select(*keep)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), "n_tokens long, ids binary, decoded binary"])
    # a text that is kept goes to the workers once
    rows = kept if keep[-1:] == ["text"] else docs.select(*keep, F.col("text").alias("tm_text"))
    return rows.mapInArrow(partial(encoded_slices, path=path, pattern=pattern, keep=keep), schema)


def token_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of docs. Digests are taken next to the encoder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            counts, hashes, texts = [], [], []
            for ids in own.encode_all(t.as_py() or "" for t in batch.column("text")):
                counts.append(len(ids) // 4)
                hashes.append(hashlib.sha256(ids).hexdigest())
                texts.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(hashes), pa.array(texts)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
