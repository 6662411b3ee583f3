"""Alignment of two tokenizers' tokens over the same bytes, and how often each pair of ids ends together.

A is a byte-level BPE read by ``tokenizers``, B a sentencepiece model with byte fallback; A encodes a space and the text,
B the text, in front of which it puts that space itself. The spans that the libraries report are coarse cuts: A's are
offsets of characters, so the tokens that share a multibyte character all claim the whole of it, and of the byte-fallback
tokens of a character B gives all but the last an empty span. Between two cuts that are sure, the ends are refined with
the lengths of the tokens' decoded bytes. (The installed sentencepiece has replaced its immutable proto by ``proto``, which
holds the same spans, in bytes.) Offsets where both tokenizers end a token cut the tokens into groups; the two tokens that
end there are linked.

Texts are encoded in segments: a cut in front of a space between two characters that are no white space is one that both
tokenizers make, whatever stands around it (A's pattern takes that space to what follows, and no piece of B has one inside
or at its end; both are looked up in the files, and without them a text is one segment). So a segment's tokens and groups
are those it has in any text, a worker keeps those of the last ``MOST_SEGMENTS`` distinct ones, and a text is their
concatenation.

Each text is aligned once: ids and ends of groups go to a stage table. Pairs of ids are counted over it, combined per batch
before the shuffle. The counts return as a broadcast of the ``most_pairs`` most frequent pairs (16 bytes each, so its size
is bounded) and, for the others, if there are any, by a join on the pair.
"""

from __future__ import annotations

import ctypes
import gc
import json
import os
import re
from contextlib import suppress
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from kerbside.llm import arrays as A
from kerbside.llm.storage import stage

TOKENIZERS = "/opt/tokenizers"
BYTE_LEVEL, PIECES = f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model"
#: Most pairs of ids whose counts are broadcast (32 MB).
MOST_PAIRS = 1 << 21
#: Bytes of text that are put together at once; a longer text is taken alone.
PORTION = 1 << 19
#: Characters of new segments that are encoded as one text.
ENCODED = 1 << 16
#: Distinct segments whose alignments a worker keeps, about 100 MB.
MOST_SEGMENTS = 500_000
#: Before a space between two characters that are no white space by any definition, nor the mark that stands for it.
_SOLID = "[^\\s\u2581\u180e\u200b\ufeff]"
_CUT = re.compile(f"(?<={_SOLID})(?= {_SOLID})")
#: A segment that may stand next to any other one of this kind.
_LOOSE = re.compile(f" {_SOLID}(?:.*{_SOLID})?", re.DOTALL)

_ALIGNED = "row long, doc_id long, a binary, b binary, a_last binary, b_last binary"
_COUNTS = "pair long, n long"
_LINKS = "row long, pair long, n long"
_RESULT = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
_loaded: dict[int, Codec] = {}


def byte_level_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable Latin-1 stands for itself, the other bytes follow from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in own]
    return {**{chr(b): b for b in own}, **{chr(256 + i): b for i, b in enumerate(others)}}


class Codec:
    """Both tokenizers, the bytes of every id and the pieces from which group strings are put together."""

    def __init__(self, a_file: bytes, b_file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_file.decode("utf-8"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor()
        self.b.LoadFromSerializedProto(b_file)
        alphabet = byte_level_alphabet()
        entries = sorted(self.a.get_vocab().items(), key=lambda e: e[1])
        self.a_bytes: list[bytes] = [b""] * (entries[-1][1] + 1)
        for entry, i in entries:
            self.a_bytes[i] = bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode()
        self.b_bytes = []
        for i in range(self.b.vocab_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        before = json.loads(a_file).get("pre_tokenizer") or {}
        a_cuts = before.get("type") == "ByteLevel" and before.get("use_regex", True)
        b_cuts = not any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(self.b.vocab_size()))
        self.cuts = bool(a_cuts and b_cuts)
        self.known: dict[str, int] = {}
        self.store = [Ragged() for _ in range(4)]
        self.a_lengths = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_lengths = np.array([len(x) for x in self.b_bytes], np.int64)

    def encode(self, texts: list[str]) -> tuple[tuple, tuple]:
        """(ids, begins, ends, first token of each text) of A in bytes of space+text, and the same of B."""
        found = self.a.encode_batch([" " + t for t in texts], add_special_tokens=False)
        a_ids = np.fromiter(chain.from_iterable(e.ids for e in found), np.int64)
        spans = np.fromiter(chain.from_iterable(chain.from_iterable(e.offsets for e in found)), np.int64).reshape(-1, 2)
        a_first = np.cumsum([0, *(len(e.ids) for e in found)])
        for i, text in enumerate(texts):
            if not text.isascii():
                data = np.frombuffer((" " + text).encode(), np.uint8)
                place = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
                part = slice(a_first[i], a_first[i + 1])
                spans[part] = place[spans[part]]
        protos = self.b.encode(texts, return_type="proto", num_threads=1)
        table = np.array([v for x in protos for p in x.pieces for v in (p.id, p.begin, p.end)], np.int64).reshape(-1, 3)
        b_first = np.cumsum([0, *(len(x.pieces) for x in protos)])
        table[:, 1:] += 1
        table[b_first[:-1][np.diff(b_first) > 0], 1] = 0
        return (a_ids, spans[:, 0], spans[:, 1], a_first), (table[:, 0], table[:, 1], table[:, 2], b_first)


class Ragged:
    """Lists of small numbers, one after the other in one growing array."""

    def __init__(self):
        self.data, self.first, self.lists = np.empty(1 << 16, np.int32), np.zeros(1 << 12, np.int32), 0

    def extend(self, values: np.ndarray, first: np.ndarray) -> None:
        size, more = int(self.first[self.lists]), len(first) - 1
        while size + len(values) > len(self.data):
            self.data = np.concatenate([self.data, np.empty_like(self.data)])
        while self.lists + more + 1 > len(self.first):
            self.first = np.concatenate([self.first, np.empty_like(self.first)])
        self.data[size : size + len(values)] = values
        self.first[self.lists + 1 : self.lists + 1 + more] = first[1:] + size
        self.lists += more

    def taken(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chosen lists one after the other, and where each begins."""
        begin, end = self.first[which].astype(np.int64), self.first[which + 1].astype(np.int64)
        size = end - begin
        at = np.concatenate([[0], np.cumsum(size)])
        return self.data[np.repeat(begin - at[:-1], size) + np.arange(at[-1])], at


def codec(a_file, b_file) -> Codec:
    """The codec of two broadcast files, once per worker."""
    name = hash((a_file.value, b_file.value))
    if name not in _loaded:
        _loaded.clear()
        _loaded[name] = Codec(a_file.value, b_file.value)
    return _loaded[name]


def id_strings(a_ids: int, b_ids: int) -> np.ndarray:
    """Decimal ids with what follows them: A inside and at the end of a group, then B likewise."""
    all_of = [x for i in range(a_ids) for x in (f"{i},", f"{i}|")] + [x for i in range(b_ids) for x in (f"{i},", f"{i};")]
    return np.array(all_of, object)


def refined_ends(begins: np.ndarray, ends: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Ends of tokens in the bytes of their texts.

    A cut is sure after a token whose span is not empty and does not reach into the next one's. From one sure cut on the
    lengths of the decoded bytes are added up. Where cuts and bytes disagree, the bytes count.
    """
    if not len(ends):
        return ends
    total = np.cumsum(lengths)
    counts = np.diff(first)
    before = np.repeat(np.concatenate([[0], total])[first[:-1]], counts)
    by_bytes = total - before
    last = np.zeros(len(ends), bool)
    last[first[1:][counts > 0] - 1] = True
    following = np.append(begins[1:], 0)
    sure = (ends > begins) & (last | (following >= ends))
    at = np.arange(len(ends))
    anchor = np.maximum.accumulate(np.where(sure, at, -1))
    inside = anchor >= np.repeat(first[:-1], counts)
    start = np.where(inside, ends[anchor], 0)
    reached = np.where(inside, by_bytes[anchor], 0)
    refined = start + by_bytes - reached
    return np.where(refined == by_bytes, refined, by_bytes)


def aligned_texts(c: Codec, texts: list[str]) -> list[np.ndarray]:
    """a ids, b ids, sizes of groups in A and in B, and their ends in bytes of space+text.

    Each as (values, first of each text); nothing where bytes differ.
    """
    (a, a_begin, a_end, a_first), (b, b_begin, b_end, b_first) = c.encode(texts)
    whole = np.zeros(len(texts), bool)
    for i, text in enumerate(texts):
        raw = b" " + text.encode()
        whole[i] = bool(text) and all(
            b"".join(map(table.__getitem__, ids[first[i] : first[i + 1]].tolist())) == raw
            for table, ids, first in ((c.a_bytes, a, a_first), (c.b_bytes, b, b_first))
        )
    a_ends = refined_ends(a_begin, a_end, a_first, c.a_lengths[a])
    b_ends = refined_ends(b_begin, b_end, b_first, c.b_lengths[b])

    def kept(ids, ends, first):
        stay = np.repeat(whole, np.diff(first))
        return ids[stay], ends[stay], np.concatenate([[0], np.cumsum(np.where(whole, np.diff(first), 0))])

    a, a_ends, a_first = kept(a, a_ends, a_first)
    b, b_ends, b_first = kept(b, b_ends, b_first)
    # one number line for all texts of the portion
    size = np.array([len(t.encode()) + 1 for t in texts], np.int64)
    base = np.cumsum(size) - size
    a_ends = a_ends + np.repeat(base, np.diff(a_first))
    b_ends = b_ends + np.repeat(base, np.diff(b_first))
    a_cut = np.flatnonzero(np.isin(a_ends, b_ends, assume_unique=True))
    b_cut = np.flatnonzero(np.isin(b_ends, a_ends, assume_unique=True))
    sizes = [np.diff(np.concatenate([[-1], cut])) for cut in (a_cut, b_cut)]
    groups = np.searchsorted(a_cut, a_first)
    ends = a_ends[a_cut] - np.repeat(base, np.diff(groups))
    return [(a, a_first), (b, b_first), (sizes[0], groups), (sizes[1], groups), (ends, groups)]


def aligned_segments(c: Codec, segments: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The first four parts of ``aligned_texts`` for loose segments, which are encoded as one text and cut apart again."""
    _, _, _, _, (ends, _) = whole = aligned_texts(c, ["".join(segments)[1:]])
    borders = np.cumsum([len(s.encode()) for s in segments])
    last = np.searchsorted(ends, borders)
    if not len(ends) or last[-1] >= len(ends) or (ends[last] != borders).any():
        # one of them is not given back, or sticks to its neighbour: each by itself
        return aligned_texts(c, [s[1:] for s in segments])[:4]
    groups = np.concatenate([[0], last + 1])
    tokens = [np.concatenate([[0], np.cumsum(sizes)])[groups] for sizes, _ in whole[2:4]]
    return [(whole[0][0], tokens[0]), (whole[1][0], tokens[1]), (whole[2][0], groups), (whole[3][0], groups)]


def concatenated(c: Codec, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """What ``aligned_texts`` gives for whole texts, put together from their segments."""
    split = [(_CUT.split(" " + t) if c.cuts else [" " + t]) if t else [] for t in texts]
    fresh = set(chain.from_iterable(split)).difference(c.known)
    if len(c.known) + len(fresh) > MOST_SEGMENTS:
        c.known, c.store, fresh = {}, [Ragged() for _ in range(4)], set(chain.from_iterable(split))
    fresh = sorted(fresh)
    loose = [_LOOSE.fullmatch(s) is not None for s in fresh]
    for kind, encode in ((True, aligned_segments), (False, lambda c, some: aligned_texts(c, [s[1:] for s in some])[:4])):
        waiting, size = [], 0
        chosen = [s for s, is_loose in zip(fresh, loose, strict=True) if is_loose == kind]
        for i, segment in enumerate(chosen):
            waiting.append(segment)
            size += len(segment)
            if size > ENCODED or i + 1 == len(chosen):
                for ragged, (values, first) in zip(c.store, encode(c, waiting), strict=True):
                    ragged.extend(values, first)
                c.known.update(zip(waiting, range(len(c.known), len(c.known) + len(waiting)), strict=True))
                waiting, size = [], 0
    which = np.fromiter(map(c.known.__getitem__, chain.from_iterable(split)), np.int64)
    of_text = np.concatenate([[0], np.cumsum([len(parts) for parts in split])])
    a_first = c.store[0].first
    # a segment without tokens is one that a tokenizer does not give back, and then its text has none
    broken = np.concatenate([[0], np.cumsum(a_first[which + 1] == a_first[which])])
    whole = broken[of_text[1:]] == broken[of_text[:-1]]
    which = which[np.repeat(whole, np.diff(of_text))]
    of_text = np.concatenate([[0], np.cumsum(np.where(whole, np.diff(of_text), 0))])
    out = []
    for ragged in c.store:
        values, at = ragged.taken(which)
        out.append((values, at[of_text]))
    return out


def narrow(ids: int) -> type:
    """Type in which ids below a number are kept."""
    return np.uint16 if ids <= 1 << 16 else np.uint32


def aligned(docs: DataFrame, id_col: str, text_col: str, a_file, b_file) -> DataFrame:
    """(row, doc_id, a, b, a_last, b_last): ids of both encodings, and a bit per token that ends a group."""

    def packed(ids, first, sizes, groups, kind) -> tuple[list[bytes], list[bytes]]:
        last = np.zeros(len(ids), np.uint8)
        last[np.cumsum(sizes) - 1] = 1
        ids = ids.astype(kind)
        parts = list(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
        return [ids[x:y].tobytes() for x, y in parts], [np.packbits(last[x:y]).tobytes() for x, y in parts]

    def encode(batches):
        c = codec(a_file, b_file)
        for batch in batches:
            data, starts = A.text_bytes(batch.column(2))
            for first, last in A.portions(starts, PORTION):
                texts = [bytes(data[x:y]).decode("utf-8", "replace") for x, y in zip(starts[first:last], starts[first + 1 : last + 1], strict=True)]
                a, b, a_sizes, b_sizes = concatenated(c, texts)
                a, a_last = packed(*a, *a_sizes, narrow(len(c.a_bytes)))
                b, b_last = packed(*b, *b_sizes, narrow(len(c.b_bytes)))
                columns = [batch.column(0)[first:last], batch.column(1)[first:last], *(pa.array(x, pa.binary()) for x in (a, b, a_last, b_last))]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "a", "b", "a_last", "b_last"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(encode, _ALIGNED)


def unpacked(batch: pa.RecordBatch, side: str, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all rows of a batch one after the other, where each row begins, and which tokens end a group."""
    rows = batch.column(side).to_pylist()
    ids = np.frombuffer(b"".join(rows), kind).astype(np.int64)
    counts = [len(x) // np.dtype(kind).itemsize for x in rows]
    bits = [np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(batch.column(f"{side}_last").to_pylist(), counts, strict=True)]
    return ids, np.concatenate([[0], np.cumsum(counts, dtype=np.int64)]), np.concatenate([np.empty(0, np.uint8), *bits]).astype(bool)


def released() -> None:
    """Give free memory back to the system: a reused worker would keep what an earlier pass has needed."""
    _loaded.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches, rows: int = 128):
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def linked_pairs(batch: pa.RecordBatch, a_kind: type, b_kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The two last ids of every group as one number, and where each row's groups begin."""
    a, first, a_last = unpacked(batch, "a", a_kind)
    b, _, b_last = unpacked(batch, "b", b_kind)
    groups = np.concatenate([[0], np.cumsum(a_last)])[first]
    return (a[a_last] << 32) | b[b_last], groups


def pair_counts(found: DataFrame, a_kind: type, b_kind: type) -> DataFrame:
    """(pair, n, best): links of every pair of ids, and whether no pair of its B id has more."""

    def count(batches):
        released()
        for batch in slices(batches, 2048):
            pairs, n = np.unique(linked_pairs(batch, a_kind, b_kind)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.int64()), pa.array(n, pa.int64())], names=["pair", "n"])

    counted = found.select("a", "b", "a_last", "b_last").mapInArrow(count, _COUNTS).groupBy("pair").agg(F.sum("n").alias("n"))
    counted = counted.withColumn("b_id", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    highest = counted.groupBy("b_id").agg(F.max("n").alias("highest"))
    return counted.join(highest, "b_id").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def align(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str = BYTE_LEVEL, b_path: str = PIECES, most_pairs: int = MOST_PAIRS
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every row. Group ends are the links: the token
    of A and the one of B that end there.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``: the ids of each group. ``n_best`` counts the links whose pair no other pair of the
    same B id exceeds in the whole table, ``count_sum`` adds up the links' counts. A text that is null, empty, not valid
    UTF-8 or that one of the tokenizers does not give back byte by byte has no tokens: zeros and an empty string; its
    tokens count nowhere. Strings of special tokens inside a text are plain text. Rows that repeat an id, or have none, are
    rows of their own. An empty table gives an empty table; other columns, whatever their names, play no part. Memory
    grows with the longest single text, which the tokenizers take whole.
    """
    context = docs.sparkSession.sparkContext
    with open(a_path, "rb") as a, open(b_path, "rb") as b:
        a_file, b_file = context.broadcast(a.read()), context.broadcast(b.read())
    both = Codec(a_file.value, b_file.value)
    b_base, b_ids = 2 * len(both.a_bytes), len(both.b_bytes)
    a_kind, b_kind = narrow(b_base // 2), narrow(b_ids)
    del both
    found = stage(aligned(docs, id_col, text_col, a_file, b_file), "aligned")
    counts = stage(pair_counts(found, a_kind, b_kind), "pair-counts")
    number = counts.count()
    heaviest = counts if number <= most_pairs else stage(counts.orderBy(F.desc("n"), "pair").limit(most_pairs), "heaviest-pairs")
    table = heaviest.select("pair", "n", "best").toArrow().sort_by("pair")
    known = np.stack([table["pair"].to_numpy(), table["n"].to_numpy() * 2 + table["best"].to_numpy(zero_copy_only=False)]).astype(np.int64)
    sent = context.broadcast(known.tobytes())

    def tables():
        return np.frombuffer(sent.value, np.int64).reshape(2, -1)

    def looked_up(pairs, keys, values):
        at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
        hit = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
        return hit, (values[at] if len(keys) else pairs)

    more_best, more_sum = F.lit(0).cast("long"), F.lit(0).cast("long")
    if number > most_pairs:

        def others(batches):
            keys, values = tables()
            for batch in slices(batches):
                pairs, groups = linked_pairs(batch, a_kind, b_kind)
                rows = np.repeat(batch.column("row").to_numpy(), np.diff(groups))
                rare = ~looked_up(pairs, keys, values)[0]
                yield pa.RecordBatch.from_arrays([pa.array(rows[rare]), pa.array(pairs[rare]), pa.array(np.ones(rare.sum(), np.int64))], names=["row", "pair", "n"])

        rest = counts.join(heaviest.select("pair"), "pair", "left_anti").withColumnRenamed("n", "times")
        hits = found.mapInArrow(others, _LINKS).groupBy("row", "pair").agg(F.sum("n").alias("n")).join(rest, "pair")
        extra = hits.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("x_best"), F.sum(F.col("n") * F.col("times")).alias("x_sum"))
        found = found.join(extra, "row", "left")
        more_best, more_sum = F.coalesce("x_best", F.lit(0).cast("long")), F.coalesce("x_sum", F.lit(0).cast("long"))
    found = found.select("doc_id", "a", "b", "a_last", "b_last", more_best.alias("more_best"), more_sum.alias("more_sum"))

    def finish(batches):
        keys, values = tables()
        released()
        strings = id_strings(b_base // 2, b_ids)
        for batch in slices(batches):
            a, a_first, a_last = unpacked(batch, "a", a_kind)
            b, b_first, b_last = unpacked(batch, "b", b_kind)
            # place of every token when each group's A tokens are followed by its B tokens
            a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
            a_to, b_to = np.flatnonzero(a_last) + 1, np.flatnonzero(b_last) + 1
            a_place = np.arange(len(a)) + np.concatenate([[0], b_to])[a_group]
            b_place = np.arange(len(b)) + a_to[b_group]
            codes = np.empty(len(a) + len(b), np.int64)
            codes[a_place], codes[b_place] = 2 * a + a_last, b_base + 2 * b + b_last
            pieces, cuts = strings[codes], a_first + b_first
            texts = ["".join(pieces[x:y].tolist())[:-1] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            pairs, groups = linked_pairs(batch, a_kind, b_kind)
            hit, value = looked_up(pairs, keys, values)
            value = np.where(hit, value, 0)
            best = np.concatenate([[0], np.cumsum(value & 1)])
            total = np.concatenate([[0], np.cumsum(value >> 1)])
            n_groups = np.diff(groups)
            longs = [
                np.diff(a_first), np.diff(b_first), n_groups, n_groups,
                best[groups[1:]] - best[groups[:-1]] + batch.column("more_best").to_numpy(),
                total[groups[1:]] - total[groups[:-1]] + batch.column("more_sum").to_numpy(),
            ]
            columns = [batch.column("doc_id"), *[pa.array(x, pa.int64()) for x in longs], pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *_RESULT, "groups"])

    schema = StructType().add("doc_id", LongType())
    for name in _RESULT:
        schema = schema.add(name, LongType())
    return found.mapInArrow(finish, schema.add("groups", StringType()))
