"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The ranks of a rank file become a vocabulary and merges: byte-level tokenizers spell each byte as
one printable character (the byte table), so a rank's bytes are spelled that way, and every pair
of known parts that makes a known whole is a merge, ordered by the whole's rank. Texts are encoded
in tasks, one Arrow batch after the other, without special tokens.

Texts are cut before each blank that stands between two visible characters. The split pattern never
matches across such a place, so chunks encode as the whole would, and an encoding never spans more
than a chunk. The chunks of two megabytes are numbered by Arrow, so that only distinct ones are
split and only matches that are not kept from before are encoded. Offsets count code points of the
whole text: a token that holds only part of a character's bytes covers that character. Decoding
reverses the byte table, so characters that tokens split come together again from their bytes.

Defined cases: a null or empty text has no tokens and decodes to no bytes; rows are independent, so
repeated rows and keys stay as they are; an empty table gives an empty result; clashing columns
are replaced.
"""

from __future__ import annotations

import array
import base64
import functools
import itertools
import os
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Matches whose tokens a worker keeps; a longer list is dropped and begun anew. Longer matches are not kept.
KEPT, LONGEST = 150_000, 64
# Bytes of text that are taken apart at once, or one chunk.
BLOCK = 1 << 21
# Numbers that are turned into bytes at once.
DECODED = 1 << 16
# By last byte: characters beyond ASCII that are, or may be, white space. Two bytes from C2; three from E1 to E3.
_SPACE_OF_TWO = np.isin(np.arange(256), [0x85, 0xA0])
_SPACE_OF_THREE = np.isin(np.arange(256), [*range(0x80, 0x8B), 0x8E, 0x9F, 0xA8, 0xA9, 0xAF])


def byte_table() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else the
    next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, spare = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in table:
            table[b], spare = chr(spare), spare + 1
    return [table[b] for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """All pairs of tokens that make a token, by the rank of what they make; of several pairs, the
    one with the longer left part first, as the leftmost of overlapping repeats would have it."""
    out = []
    for token in sorted((t for t in ranks if len(t) > 1), key=ranks.__getitem__):
        for cut in range(len(token) - 1, 0, -1):
            left, right = token[:cut], token[cut:]
            if left in ranks and right in ranks:
                out.append((left, right))
    return out


class Codec:
    """A tokenizers encoder for one rank file.

    The split pattern is matched first, and the library encodes each distinct match once; what it
    gave for a match is kept, up to KEPT of them.
    """

    def __init__(self, path: str, pattern: str):
        from tokenizers import Tokenizer, models, pre_tokenizers

        table = byte_table()
        spell = lambda token: "".join(table[b] for b in token)
        ranks = read_ranks(path)
        self.tokenizer = Tokenizer(models.BPE(
            vocab={spell(t): r for t, r in ranks.items()},
            merges=[(spell(a), spell(b)) for a, b in merges_of(ranks)],
            ignore_merges=True,  # a whole piece that is a token is that token
            cache_capacity=0,
        ))
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelling = dict(enumerate(table))
        self.pattern = regex.compile(pattern)
        # Numbers (and begins and ends) as int32 bytes: small, and nothing for the garbage collector.
        self.known: dict[str, bytes] = {}
        self.places: dict[str, bytes] = {}

    def _learn(self, pieces: Sequence[str], offsets: bool) -> list[bytes]:
        """The tokens of each match; those not known yet are encoded, each once."""
        known, wanted = self.places if offsets else self.known, set(pieces)
        new = list(wanted.difference(known))
        if len(known) + len(new) > KEPT:  # only what is needed now stays
            kept = {piece: known[piece] for piece in wanted.intersection(known)}
            known.clear()
            known.update(kept)
        if offsets:
            for low in range(0, len(new), 5000):
                part = new[low:low + 5000]
                for piece, x in zip(part, self.tokenizer.encode_batch(part, add_special_tokens=False)):
                    known[piece] = np.array([(i, a, b) for i, (a, b) in zip(x.ids, x.offsets)], np.int32).tobytes()
        else:
            spelling, tokens = self.spelling, self.tokenizer.model.tokenize
            for piece in new:
                spelled = piece.encode().decode("latin-1").translate(spelling)
                known[piece] = array.array("i", [token.id for token in tokens(spelled)]).tobytes()
        out = list(map(known.__getitem__, pieces))
        for piece in new:
            if len(piece) > LONGEST:
                del known[piece]
        return out

    def _matches(self, chunks: list[str], plain: int) -> tuple[list[str], np.ndarray]:
        """The pattern's matches in all chunks, one chunk after the other, and how many each has. The first
        `plain` chunks begin with a blank and a visible character and end with a visible one: they are split as
        one text."""
        text = "".join(chunks[:plain])
        pieces = self.pattern.findall(text)
        ends = np.cumsum(_lengths(pieces))
        if plain and (not pieces or ends[-1] != len(text)):  # a pattern that leaves characters out
            pieces, plain = [], 0
        upto = np.searchsorted(ends, np.cumsum(_lengths(chunks[:plain])), side="right")
        rest = list(map(self.pattern.findall, chunks[plain:]))
        pieces += itertools.chain.from_iterable(rest)
        return pieces, np.concatenate([np.diff(upto, prepend=0), _lengths(rest)])

    def _block(self, data: np.ndarray, begins: np.ndarray, safe: np.ndarray, offsets: bool
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of the chunks between `begins`, a row each; how many tokens and code points each chunk has.
        `safe` tells for each of `begins` whether it is a place between two visible characters."""
        places = pa.py_buffer((begins - begins[0]).astype(np.int32))
        coded = pa.StringArray.from_buffers(
            len(begins) - 1, places, pa.py_buffer(data[begins[0]:begins[-1]])).dictionary_encode()
        which = np.asarray(coded.indices)
        plain = np.zeros(len(coded.dictionary), bool)
        plain[which[safe[:-1] & safe[1:]]] = True
        order = np.argsort(~plain, kind="stable")  # plain ones first
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        chunks = coded.dictionary.to_numpy(zero_copy_only=False)[order].tolist()
        pieces, matches = self._matches(chunks, int(plain.sum()))
        which = place[which]
        rows = self._learn(pieces, offsets)
        width, last = 12 if offsets else 4, np.cumsum(matches)
        pool, sizes = np.frombuffer(b"".join(rows), np.int32), _lengths(rows) // width
        if offsets:
            before = np.cumsum(long := _lengths(pieces)) - long
            pool = pool.reshape(-1, 3).copy()
            within = before - np.repeat(np.append(before, 0)[last - matches], matches)
            pool[:, 1:] += np.repeat(within, sizes)[:, None].astype(np.int32)
        ends = np.append(0, np.cumsum(sizes))
        first, count = ends[last - matches], ends[last] - ends[last - matches]
        return pool[_ranges(first[which], count[which])], count[which], _lengths(chunks)[which]

    def encode_all(self, texts: pa.Array, offsets: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Token numbers of all texts one after the other, and how many each has; with `offsets` one row per
        token: number, begin and end in code points."""
        if not len(texts):
            return np.zeros((0, 3) if offsets else 0, np.int32), np.zeros(0, np.int64)
        texts = texts.cast(pa.large_string()).fill_null("")
        _, places, buffer = texts.buffers()
        bounds = np.frombuffer(places, np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(buffer or b"", np.uint8)[:bounds[-1]]
        begins, safe = _places(data, bounds)
        out, counts, points, low = [np.zeros((0, 3) if offsets else 0, np.int32)], [[0]], [[0]], 0
        while low < len(begins) - 1:
            high = max(low + 1, int(np.searchsorted(begins, begins[low] + BLOCK, side="right")) - 1)
            rows, count, long = self._block(data, begins[low:high + 1], safe[low:high + 1], offsets)
            out.append(rows)
            counts.append(count)
            points.append(long)
            low = high
        counts, points = (np.concatenate(x).astype(np.int64) for x in (counts, points))
        firsts = np.searchsorted(begins, bounds)
        sizes = np.diff(np.cumsum(counts)[firsts])
        rows = np.concatenate(out)
        if offsets:
            before = np.cumsum(points)
            starts = before[:-1] - np.repeat(before[firsts[:-1]], np.diff(firsts))
            rows[:, 1:] += np.repeat(starts, counts[1:])[:, None].astype(np.int32)
        return rows, sizes

    def encode(self, text: str, offsets: bool = False) -> np.ndarray:
        return self.encode_all(pa.array([text], pa.string()), offsets)[0]


def _lengths(items: Sequence) -> np.ndarray:
    return np.fromiter(map(len, items), np.int64, len(items))


def _ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges one after the other."""
    out = np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)
    out += np.arange(len(out))
    return out


def _places(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks of these texts in UTF-8 begin, and where the last one ends: at the bounds of texts and at
    blanks between two visible characters; which of these places are such blanks. A few visible characters whose
    bytes end as those of white space count as white space."""
    mark = np.zeros(len(data) + 1, bool)
    for low in range(int(bounds[0]) + 1, len(data) - 1, BLOCK):
        blanks = np.flatnonzero(data[low:min(low + BLOCK, len(data) - 1)] == 32) + low
        blanks = blanks[(data[blanks - 1] > 32) & (data[blanks + 1] > 32)]
        at = {step: data.take(blanks + step, mode="clip") for step in (-3, -2, -1, 1, 2, 3)}
        spaced = (at[-2] == 0xC2) & _SPACE_OF_TWO[at[-1]] | (at[1] == 0xC2) & _SPACE_OF_TWO[at[2]]
        for first, last in ((-3, -1), (1, 3)):
            spaced |= (at[first] >= 0xE1) & (at[first] <= 0xE3) & _SPACE_OF_THREE[at[last]]
        mark[blanks[~spaced]] = True
    safe = mark.copy()
    mark[bounds] = True
    places = np.flatnonzero(mark)
    return places, safe[places]


@functools.lru_cache(2)
def decoder(path: str) -> list[bytes]:
    """The bytes of each number: the byte table, reversed over the tokens' spellings."""
    table = byte_table()
    back = {c: b for b, c in enumerate(table)}
    spelled = {rank: "".join(table[b] for b in token) for token, rank in read_ranks(path).items()}
    return [bytes(back[c] for c in spelled.get(i, "")) for i in range(max(spelled) + 1)]


@functools.lru_cache(2)
def _byte_ranges(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all numbers one after the other, and where each number's begin (one more at the end)."""
    tokens = decoder(path)
    return np.frombuffer(b"".join(tokens), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in tokens])])


def decode_ids(path: str, ids: Sequence[int]) -> bytes:
    return decode_all(path, np.asarray(ids, np.int64))[0].tobytes()


def decode_all(path: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all these numbers, and how many bytes each gave."""
    data, places = _byte_ranges(path)
    sizes = places[ids + 1] - places[ids]
    return data[_ranges(places[ids], sizes)], sizes


@functools.lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    return Codec(path, pattern)


def _added(df: DataFrame, fields: list[T.StructField], drop: Sequence[str] = ()
           ) -> tuple[list[str], T.StructType]:
    new = {f.name.lower() for f in fields} | {d.lower() for d in drop}
    keep = [c for c in df.columns if c.lower() not in new]
    return keep, T.StructType([*(df.schema[c] for c in keep), *fields])


def encode(docs: DataFrame, path: str, pattern: str, *, text: str = "text", offsets: bool = True,
           drop: Sequence[str] = ()) -> DataFrame:
    """Adds `ids` (array<int>) and, with `offsets`, `starts` and `ends` in code points. Columns
    named in `drop` are left behind."""
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType()))]
    if offsets:
        fields += [T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("starts", "ends")]
    keep, schema = _added(docs, fields, drop)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            rows, sizes = bpe.encode_all(batch.column(batch.schema.get_field_index(text)), offsets)
            ends = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
            rows = rows.T if offsets else rows[None]
            arrays = [pa.ListArray.from_arrays(ends, pa.array(np.ascontiguousarray(r))) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in keep), *arrays], names=schema.names)

    return docs.mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, *, ids: str = "ids", text: bool = True) -> DataFrame:
    """Adds `decoded` (binary) and, with `text`, `decoded_text` with broken bytes replaced."""
    fields = [T.StructField("decoded", T.BinaryType())]
    if text:
        fields.append(T.StructField("decoded_text", T.StringType()))
    keep, schema = _added(tokens, fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids)).fill_null([])
            values, ends = np.asarray(column.flatten()), np.cumsum(column.value_lengths().to_numpy())
            raw, low = [], 0
            while low < len(ends):  # rows of about DECODED numbers, or one row
                begin = int(ends[low - 1]) if low else 0
                high = max(low + 1, int(np.searchsorted(ends, begin + DECODED, side="right")))
                data, sizes = decode_all(path, values[begin:int(ends[high - 1])])
                upto, whole = np.concatenate([[0], np.cumsum(sizes)])[np.append(0, ends[low:high] - begin)], data.tobytes()
                raw += [whole[a:b] for a, b in zip(upto.tolist(), upto[1:].tolist())]
                low = high
            arrays = [pa.array(raw, pa.binary())]
            if text:
                arrays.append(pa.array([r.decode("utf-8", "replace") for r in raw], pa.string()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in keep), *arrays], names=schema.names)

    return tokens.mapInArrow(run, schema)


def digests(tokens: DataFrame, *more: str) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 from `ids` and `decoded`, and the columns in `more`."""
    return tokens.select(
        "doc_id", *more, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.transform("ids", lambda i: i.cast("string"))), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )

