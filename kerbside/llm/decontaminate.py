"""Benchmark decontamination by latent semantic retrieval.

1. Words are hashed to ``DIMENSIONS`` columns; document frequencies come from all distinct texts. A word weighs its
   inverse document frequency, which falls smoothly to ``COMMON`` of it where the word is in more than ``MOST_SHARE`` of the texts.
2. A randomised SVD of TF-IDF passages (those of the benchmark, ``GROUP`` at a time, and all of the corpus) gives a latent
   space. The products A'(A Q) are summed over the tasks that hold the passages; only a matrix of words x components
   reaches the driver, which orthonormalises it. It begins with the space of the corpus passages folded into ``FIT_ROWS`` rows with
   random signs, which saves a round over all of them.
3. Every document is cut into overlapping windows of several lengths. Each window's cosine with the benchmark passages of
   fitting length is taken in the latent space, and the share of the passage that the window holds, which does not depend on
   how rare its other words are; one of the two must be large enough. Windows with too little weight on benchmark words
   cannot pass and are not projected. Beside that, every run of ``GRAM`` words of an item (of all its words if it has fewer) is looked up in the
   texts, so that an item that is there word for word is a candidate whatever its words or their neighbours weigh.
4. A candidate leaks if the longest common subsequence of words covers enough of the passage, and with a middling share only
   if the passage's answer, its last sentence, is there as well.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm import arrays as A
from kerbside.llm.storage import stage

DIMENSIONS = 1 << 18
MOST_SHARE, COMMON = 0.05, 0.1
#: Words of a run that is looked up as it is, and bits of the table that most runs of a text fail at.
GRAM, GRAM_BITS = 8, 20
COMPONENTS, EXTRA, ROUNDS, SEED = 256, 16, 2, 5
#: Rows that all corpus passages, of so many words, are folded into for the space that the fit begins with.
FIT_ROWS, FIT_WORDS = 512, 64
#: Words of a benchmark passage at most; longer items are several passages.
PASSAGE = 96
#: (window, step) in words; a passage of m words is sought in the first window of at least m + step words.
WINDOWS = ((16, 4), (32, 8), (64, 16), (128, 32))
#: Words that are added up once for all windows (the shortest step), and words of a text that are taken at a time.
UNIT, SEGMENT = 4, 1 << 14
#: Passages of the fit that are multiplied at a time.
AT_ONCE = 32
#: Tasks that hold the folded rows, whose number does not grow. Numbers of a product that a task hands on at a time.
FIT_TASKS, SLICE = 8, 1 << 16
COSINE = 0.3
#: Share of a passage's squared weight that a window may hold instead: other words of the window do not count.
HELD = 0.5
#: Share of a passage's words in common order: enough alone, enough with the answer; share of the answer.
LEAK, LEAK_WITH_ANSWER, ANSWER = 0.8, 0.6, 0.5
#: Passages that share one latent space: no more than it has components, so that rare words are not lost.
GROUP = 240
#: Length of a folded row of corpus passages; a benchmark passage has 1. All passages together weigh as much as all such rows.
CORPUS_WEIGHT = 0.25
#: Bytes of benchmark text that are sought in one pass over the corpus.
BLOCK_BYTES = 1 << 20
FREQUENCY_SLICES = 16

PASSAGES = "columns array<int>, values array<double>"
LEAKS = "array<struct<item_id: long, cosine: double, common: double, answer: double>>"


def hashed_words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes (runs of letters, A-Z lower-cased) and where each text's begin."""
    begins, ends, first = A.letter_words(data, starts)
    return A.run_hashes(data, begins, ends), first


def column_of(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(20)).astype(np.int64) & (DIMENSIONS - 1)


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """In how many distinct texts each column occurs, and how many there are. The vector has a fixed size."""
    width = DIMENSIONS // FREQUENCY_SLICES

    def count(batches):
        A.released()
        total, texts = np.zeros(DIMENSIONS, np.int64), 0
        for batch in batches:
            data, starts = A.text_bytes(batch.column(0))
            for a, b in A.portions(starts):
                h, first = hashed_words(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a])
                owner = np.repeat(np.arange(b - a), np.diff(first))
                both = A.distinct(owner * DIMENSIONS + column_of(h))
                total += np.bincount(both % DIMENSIONS, minlength=DIMENSIONS)
                texts += b - a
        for i in range(FREQUENCY_SLICES):
            part = A.zlib.compress(total[i * width : (i + 1) * width].tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([texts if i == 0 else 0]), pa.array([part])], names=["slice", "texts", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(A.zlib.decompress(x), np.int64) for x in table["counts"].to_pylist()], axis=0)
        return pa.table({"slice": table["slice"][:1], "texts": pa.array([sum(table["texts"].to_pylist())]), "counts": [A.zlib.compress(total.tobytes(), 1)]})

    schema = "slice int, texts long, counts binary"
    parts = docs.select(F.col(text_col).cast("string")).distinct().mapInArrow(count, schema).groupBy("slice").applyInArrow(add, schema)
    found = {r["slice"]: r for r in parts.collect()}
    if not found:
        return np.zeros(DIMENSIONS, np.int64), 0
    return np.concatenate([np.frombuffer(A.zlib.decompress(found[i]["counts"]), np.int64) for i in range(FREQUENCY_SLICES)]), found[0]["texts"]


def inverse_frequencies(frequencies: np.ndarray, documents: int) -> np.ndarray:
    """Weight of every column, by its share of the texts alone: the same course in small and large tables."""
    weight = np.log((documents + 1) / (frequencies + 0.5))
    weight *= COMMON + (1 - COMMON) / (1 + (frequencies / max(documents, 1) / MOST_SHARE) ** 8)
    return np.maximum(weight, 0)


class Item:
    """One benchmark passage: its words, those of its answer, its length class."""

    def __init__(self, item_id: int, words: np.ndarray, answer: np.ndarray):
        self.item_id, self.words, self.answer = item_id, words, answer
        self.kind = next((i for i, (window, step) in enumerate(WINDOWS) if window >= len(words) + step), len(WINDOWS) - 1)
        self.masks, self.answer_masks = _masks(words), _masks(answer)


def _masks(words: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words.tolist()):
        out[w] = out.get(w, 0) | (1 << i)
    return out


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words."""
    n = max(len(words) - size + 1, 0)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n]
    return A.mix(out)


class Grams:
    """Where the runs of words of some passages occur in a text."""

    def __init__(self, items: list[Item]):
        self.tables = []
        sizes = np.array([min(len(i.words), GRAM) for i in items])
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            keys = [gram_hashes(items[i].words, size) for i in own]
            owner, offset = np.repeat(own, [len(k) for k in keys]), np.concatenate([np.arange(len(k)) for k in keys])
            keys = np.concatenate(keys)
            order = np.argsort(keys, kind="stable")
            bits = np.zeros(1 << GRAM_BITS, bool)
            bits[(keys >> np.uint64(64 - GRAM_BITS)).astype(np.int64)] = True
            self.tables.append((size, bits, keys[order], owner[order], offset[order]))

    def found(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Passages and where each would begin in the text."""
        items, begins = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for size, bits, keys, owner, offset in self.tables:
            h = gram_hashes(words, size)
            at = np.flatnonzero(bits[(h >> np.uint64(64 - GRAM_BITS)).astype(np.int64)])
            low, high = np.searchsorted(keys, h[at]), np.searchsorted(keys, h[at], "right")
            n = high - low
            which = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            items.append(owner[which])
            begins.append(np.repeat(at, n) - offset[which])
        return np.concatenate(items), np.concatenate(begins)


def common_subsequence(masks: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence, a bit for every word of the one side."""
    full = (1 << size) - 1
    row = full
    for w in words:
        mask = masks.get(w)
        if mask:
            kept = row & mask
            row = ((row + kept) | (row - kept)) & full
    return size - row.bit_count()


def passages_of(items: list[tuple[int, str]]) -> list[Item]:
    """Benchmark items cut into passages of at most ``PASSAGE`` words; the last sentence or line is the answer."""
    out = []
    for item_id, text in items:
        data = np.frombuffer((text or "").encode(), np.uint8)
        words, _ = hashed_words(data, np.array([0, len(data)]))
        body = (text or "").rstrip(" \n.!?")
        cut = max(body.rfind("\n"), body.rfind(". "), body.rfind("? "), body.rfind("! "))
        tail = np.frombuffer(body[cut + 1 :].encode(), np.uint8)
        answer, _ = hashed_words(tail, np.array([0, len(tail)]))
        pieces = max(1, math.ceil(len(words) / PASSAGE))
        for part in np.array_split(words, pieces):
            if len(part):
                out.append(Item(item_id, part, answer[-PASSAGE:] if part[-1] == words[-1] and len(answer) <= len(part) else part[-min(8, len(part)) :]))
    return out


def latent_space(passages: DataFrame, dims: int, components: int, start: np.ndarray | None = None) -> np.ndarray:
    """Right singular vectors (dims x components) of the passages (columns array<int>, values array<double>).

    Every round multiplies all passages, however many they are. ``start`` (dims x any) is a space to begin with, from which one
    round less is enough.
    """
    wide = min(components + EXTRA, dims)
    q = np.random.default_rng(SEED).standard_normal((dims, wide))
    if start is not None:
        q[:, : min(start.shape[1], wide)] = start[:, :wide]
    step = max(1, SLICE // wide)

    def product(q: np.ndarray) -> np.ndarray:
        q = q.astype(np.float32)

        def run(batches):
            A.released()
            out, place = np.zeros(q.shape), np.empty(dims, np.int64)
            for batch in batches:
                starts = np.append(0, np.cumsum(batch.column(0).value_lengths().to_numpy(zero_copy_only=False)))
                columns = batch.column(0).flatten().to_numpy(zero_copy_only=False)
                values = batch.column(1).flatten().to_numpy(zero_copy_only=False)
                # a few passages at a time: their part of q is all that is held beside q
                for first in range(0, len(starts) - 1, AT_ONCE):
                    cut = starts[first : first + AT_ONCE + 1]
                    near = columns[cut[0] : cut[-1]]
                    own = A.distinct(near)
                    place[own] = np.arange(len(own))
                    some = np.zeros((len(cut) - 1, len(own)), np.float32)
                    some[np.repeat(np.arange(len(cut) - 1), np.diff(cut)), place[near]] = values[cut[0] : cut[-1]]
                    out[own] += some.T @ (some @ q[own])
            part = TaskContext.get().partitionId()
            for i in range(0, len(out), step):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part], pa.int32()), pa.array([out[i : i + step].tobytes()])], names=["at", "task", "part"])

        def add(batches):
            at, total = None, None
            for batch in batches:
                for i, part in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                    own = np.frombuffer(part.as_buffer())
                    if i == at:
                        total += own
                        continue
                    if at is not None:
                        yield _slice(at, total)
                    at, total = i, own.copy()
            if at is not None:
                yield _slice(at, total)

        # slices of the tasks are added up one after the other, in the order of the tasks: sums of any number of tasks agree
        parts = passages.mapInArrow(run, "at int, task int, part binary").repartition("at").sortWithinPartitions("at", "task")
        found = {r["at"]: np.frombuffer(r["part"]) for r in parts.mapInArrow(add, "at int, part binary").collect()}
        return np.concatenate([found[i] for i in sorted(found)]).reshape(q.shape) if found else np.zeros(q.shape)

    for _ in range(ROUNDS if start is None else ROUNDS - 1):
        q = np.linalg.qr(product(q))[0]
    square = q.T @ product(q)
    values, vectors = np.linalg.eigh((square + square.T) / 2)
    best = [i for i in np.argsort(-values)[:components] if values[i] > 1e-9 * max(values.max(), 1e-30)]
    return q @ vectors[:, best]


def _slice(at: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total.tobytes()])], names=["at", "part"])


class Search:
    """Windows of texts against one block of benchmark passages."""

    def __init__(self, items: list[Item], weight: np.ndarray, columns: np.ndarray, space: np.ndarray):
        self.items = items = sorted(items, key=lambda item: item.kind)
        self.weight = weight
        self.columns = columns
        self.grams = Grams(items)
        kinds = np.array([item.kind for item in items])
        self.kinds = [(int(np.searchsorted(kinds, k)), int(np.searchsorted(kinds, k, "right"))) for k in range(len(WINDOWS))]
        weighted = space.astype(np.float32) * weight[columns][:, None].astype(np.float32)
        latent = np.stack([weighted[self._known(item.words)].sum(axis=0) for item in items])
        #: Lengths of the passages in the latent space; those without weight are left to the runs of words.
        self.length = np.linalg.norm(latent, axis=1)
        #: What each word adds to a window's product with each passage of length 1.
        self.product = weighted @ (latent / np.maximum(self.length, 1e-12)[:, None]).T
        self.length[self.length < 1e-9] = np.inf
        #: Place of each column in ``columns``; those of other words come last, where the product is nothing.
        self.place = np.full(DIMENSIONS, len(columns), np.int32)
        self.place[columns] = np.arange(len(columns))
        self.product = np.concatenate([self.product, np.zeros((1, len(items)), np.float32)])

    def _known(self, words: np.ndarray) -> np.ndarray:
        column = column_of(words)
        at = np.minimum(np.searchsorted(self.columns, column), max(len(self.columns) - 1, 0))
        return at[self.columns[at] == column] if len(self.columns) else at[:0]

    def leaks(self, words: np.ndarray) -> list[dict]:
        """Leaking items of one text, each with its best window."""
        best: dict[int, dict] = {}
        if not len(words):
            return []
        for i, begin in self._runs(words):
            window = words[begin : begin + WINDOWS[self.items[i].kind][0]]
            if shares := self._shares(self.items[i], window.tolist()):
                norm = float(np.linalg.norm(self.weight[column_of(window)]))
                _keep(best, self.items[i].item_id, float(self.product[self._known(window), i].sum()) / max(norm, 1e-12), *shares)
        self._by_cosine(words, best)
        return [best[i] for i in sorted(best)]

    def _runs(self, words: np.ndarray) -> list[tuple[int, int]]:
        """Passages of which a run of words is in the text, and the windows around: each once a step."""
        at, begin = self.grams.found(words)
        if not len(at):
            return []
        step = np.array([WINDOWS[i.kind][1] for i in self.items])[at]
        begin = np.maximum(begin - step // 2, 0) // step * step
        return [(i, b) for i, b in np.unique(np.stack([at, begin], axis=1), axis=0).tolist()]

    @staticmethod
    def _shares(item: Item, text: list[int]) -> tuple[float, float] | None:
        """Shares of the item and of its answer that the window has in order; None if that is no leak."""
        size = len(item.words)
        common = common_subsequence(item.masks, size, text) / size
        if common < LEAK_WITH_ANSWER:
            return None
        answer = common_subsequence(item.answer_masks, len(item.answer), text) / len(item.answer)
        # a few words in order prove little
        return (common, answer) if common >= (LEAK if size >= 8 else 1.0) or (size >= 8 and answer >= ANSWER) else None

    def _by_cosine(self, words: np.ndarray, best: dict[int, dict]) -> None:
        if not len(self.columns):
            return
        column = column_of(words)
        w = self.weight[column]
        at = self.place[column]
        hit = np.flatnonzero(at < len(self.columns))
        if not len(hit):
            return
        square = np.concatenate([[0.0], np.cumsum(w * w)])
        inside = np.zeros(len(words))
        inside[hit] = w[hit] ** 2
        inside = np.concatenate([[0.0], np.cumsum(inside)])
        for start in range(0, len(words), SEGMENT):
            passing = []
            reach = np.zeros((min(SEGMENT, len(words) - start) + 2 * WINDOWS[-1][0]) // UNIT, np.int64)
            for (window, step), (low, high) in zip(WINDOWS, self.kinds, strict=True):
                if low == high:
                    continue
                begin = np.arange(start, min(max(len(words) - window + step, 1), start + SEGMENT), step)
                end = np.minimum(begin + window, len(words))
                norm = square[end] - square[begin]
                weight = inside[end] - inside[begin]
                # the part on benchmark words bounds both
                held = HELD * self.length[low:high]
                full = np.flatnonzero((weight > 0) & (weight >= np.minimum(COSINE**2 * norm, held.min() ** 2)))
                if len(full):
                    passing.append((window, step, low, high, held, full, begin[full], end[full], np.sqrt(norm[full])))
                    reach[full * step // UNIT] += 1
                    reach[(full * step + window) // UNIT] -= 1
            if not passing:
                continue
            # all windows begin at multiples of a unit: the words of each are added up once
            longest, wide = WINDOWS[-1][1] // UNIT, WINDOWS[-1][0] // UNIT
            in_units = np.full((len(reach), UNIT), len(self.columns), np.int32)
            near = at[start : start + in_units.size]
            in_units.ravel()[: len(near)] = near
            in_units[np.cumsum(reach) == 0] = len(self.columns)
            used = np.flatnonzero(in_units.min(axis=1) < len(self.columns))
            units = np.zeros(((int(used[-1]) // longest + 1) * longest + wide, len(self.items)), np.float32)
            in_units = in_units[used]
            added = self.product.take(in_units[:, 0], axis=0)
            for i in range(1, UNIT):
                added += self.product.take(in_units[:, i], axis=0)
            units[used] = added
            for window, step, low, high, held, full, begin, end, norm in passing:
                steps = units[:: step // UNIT, low:high].copy()
                for i in range(1, step // UNIT):
                    steps += units[i :: step // UNIT, low:high]
                score = steps.take(full, axis=0)
                for i in range(1, window // step):
                    score += steps.take(full + i, axis=0)
                # most windows are far from every passage; the few others are compared exactly
                close = np.flatnonzero(score.max(axis=1) >= np.minimum(COSINE * norm, held.min()) * (1 - 1e-6))
                score = score[close]
                cosine = score / norm[close][:, None]
                for i, j in zip(*np.nonzero((cosine >= COSINE) | (score >= held)), strict=True):
                    item, k = self.items[low + j], close[i]
                    if shares := self._shares(item, words[begin[k] : end[k]].tolist()):
                        _keep(best, item.item_id, float(cosine[i, j]), *shares)


def _keep(best: dict[int, dict], item_id: int, cosine: float, common: float, answer: float) -> None:
    old = best.get(item_id)
    if old is None or (common, cosine) > (old["common"], old["cosine"]):
        best[item_id] = {"item_id": item_id, "cosine": cosine, "common": float(common), "answer": float(answer)}


def merged(found: list[list[dict]]) -> list[dict]:
    """Leaks of several searches: each item once, with its best window."""
    best: dict[int, dict] = {}
    for leak in (x for part in found for x in part):
        old = best.get(leak["item_id"])
        if old is None or (leak["common"], leak["cosine"]) > (old["common"], old["cosine"]):
            best[leak["item_id"]] = leak
    return [best[i] for i in sorted(best)]


def text_passages(texts: DataFrame, columns: np.ndarray, weight: np.ndarray) -> DataFrame:
    """All passages of all texts that hold one of ``columns``: rows (columns, values) of length 1, and a hash of text and place."""
    place = np.full(DIMENSIONS, -1, np.int64)
    place[columns] = np.arange(len(columns))
    own_weight, width = weight[columns], len(columns)

    def cut(batches):
        A.released()
        for batch in batches:
            data, starts = A.text_bytes(batch.column(0))
            for a, b in A.portions(starts):
                h, first = hashed_words(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a])
                count = np.diff(first)
                # passages of each text, the texts one after the other
                pieces = -(-count // FIT_WORDS)
                before = np.cumsum(pieces) - pieces
                owner = np.repeat(np.arange(len(count)), count)
                within = np.arange(len(h)) - first[owner]
                passage = before[owner] + within // FIT_WORDS
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * (within.astype(np.uint64) * np.uint64(2) + np.uint64(1)), dtype=np.uint64)])
                text = np.repeat(sums[first[1:]] - sums[first[:-1]], pieces)
                deal = A.mix(text + (np.arange(len(text)) - np.repeat(before, pieces)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                at = place[column_of(h)]
                key = np.sort(passage[at >= 0] * width + at[at >= 0])
                begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
                key, times = key[begin], np.diff(np.append(begin, len(key)))
                passage, at = key // width, key % width
                value = own_weight[at] * times
                value /= np.sqrt(np.bincount(passage, value * value, len(deal)))[passage]
                held = np.bincount(passage, minlength=len(deal))
                ends = pa.array(np.append(0, np.cumsum(held[held > 0])), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, x) for x in (pa.array(at.astype(np.int32)), pa.array(value.astype(np.float32)))]
                yield pa.RecordBatch.from_arrays([*lists, pa.array(deal[held > 0].view(np.int64))], names=["columns", "values", "deal"])

    return texts.mapInArrow(cut, "columns array<int>, values array<float>, deal long")


def folded(texts: DataFrame, columns: np.ndarray, weight: np.ndarray) -> DataFrame:
    """All passages of all texts as at most ``FIT_ROWS`` rows (columns, values) of length ``CORPUS_WEIGHT``."""
    return folded_rows(text_passages(texts, columns, weight), len(columns))


def folded_rows(passages: DataFrame, width: int) -> DataFrame:
    """``text_passages`` as at most ``FIT_ROWS`` rows of length ``CORPUS_WEIGHT``: a first sight of the space to begin with.

    Each passage of length 1 is added to one row, with a sign; both are hashes of its text and its place there. The products
    of different passages of a row cancel out on average.
    """

    def fold(batches):
        A.released()
        rows = np.zeros(FIT_ROWS * width, np.float32)
        for batch in batches:
            at = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            value = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            deal = np.repeat(batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64), batch.column(0).value_lengths().to_numpy(zero_copy_only=False))
            np.add.at(rows, (deal % np.uint64(FIT_ROWS)).astype(np.int64) * width + at, np.where(deal >> np.uint64(63), -value, value))
        for i in range(FIT_ROWS):
            row = rows[i * width : (i + 1) * width]
            some = np.flatnonzero(row)
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([some.astype(np.int32)], pa.list_(pa.int32())), pa.array([row[some]], pa.list_(pa.float32()))], names=["at", "columns", "values"])

    def add(table: pa.Table) -> pa.Table:
        flat = [table[name].combine_chunks().flatten().to_numpy(zero_copy_only=False) for name in ("columns", "values")]
        row = np.bincount(flat[0], flat[1], width)
        row *= CORPUS_WEIGHT / max(float(np.linalg.norm(row)), 1e-12)
        some = np.flatnonzero(row)
        return pa.table({"columns": pa.array([some.astype(np.int32)], pa.list_(pa.int32())), "values": pa.array([row[some]], pa.list_(pa.float64()))})

    return passages.mapInArrow(fold, "at int, columns array<int>, values array<float>").groupBy("at").applyInArrow(add, PASSAGES)


def fitted_search(passages: list[Item], weight: np.ndarray, texts: DataFrame) -> Search:
    """Latent space of the passages and of all texts, and the search in it; an empty space if no word has a weight."""
    columns = A.distinct(np.concatenate([column_of(i.words) for i in passages] + [np.empty(0, np.int64)]))
    columns = columns[weight[columns] > 0]
    if not len(columns):
        return Search(passages, weight, columns, np.zeros((0, 1)))

    def sparse(words: np.ndarray) -> tuple[list[int], list[float]]:
        column = column_of(words)
        kept = np.searchsorted(columns, column)
        kept = kept[(kept < len(columns)) & (columns[np.minimum(kept, len(columns) - 1)] == column)]
        kinds, n = np.unique(kept, return_counts=True)
        value = weight[columns[kinds]] * n
        return kinds.tolist(), (value / max(float(np.linalg.norm(value)), 1e-12)).tolist()

    spark, own = texts.sparkSession, [sparse(i.words) for i in passages]

    def with_own(rows: DataFrame, length: float) -> DataFrame:
        scaled = spark.createDataFrame([(at, [length * v for v in values]) for at, values in own if at], PASSAGES).coalesce(1)
        rows = rows.select("columns", "values")
        return scaled.select("columns", F.col("values").cast(rows.schema["values"].dataType)).union(rows)

    corpus = stage(text_passages(texts, columns, weight), "corpus_passages")
    first = with_own(folded_rows(corpus, len(columns)).repartition(FIT_TASKS), 1.0)
    start = latent_space(stage(first, "passages"), len(columns), COMPONENTS)
    # all passages of the corpus, of length 1, weigh together as much as their rows above
    number = max(corpus.count(), 1)
    length = math.sqrt(number / min(number, FIT_ROWS)) / CORPUS_WEIGHT
    space = latent_space(with_own(corpus, length), len(columns), COMPONENTS, start)
    A.released()
    return Search(passages, weight, columns, space)


def marked(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", name: str = "leaks") -> DataFrame:
    """``docs`` with a column of the benchmark items that leak into each text: (item_id, cosine, common, answer).

    Whole texts are searched. A null or empty text leaks nothing; items with null text or id or without letters cannot leak;
    rows that repeat an item are one item with the texts of all. Documents need no id; repeated rows are each marked; an
    existing column ``name`` is replaced. An empty benchmark or corpus gives no leaks.
    """
    spark = docs.sparkSession
    docs = docs.drop(name)
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    items = items.filter("item_id is not null and text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    out = docs.withColumn(name, F.array().cast(LEAKS))
    if not size:
        return out
    frequencies, documents = document_frequencies(docs, text_col)
    weight = inverse_frequencies(frequencies, documents)
    texts = docs.select(F.col(text_col).cast("string").alias("text")).filter(F.col("text").isNotNull())

    for block in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()
        passages = passages_of([(r[0], r[1]) for r in own])
        groups = [passages[i : i + GROUP] for i in range(0, len(passages), GROUP)]
        searches = [fitted_search(group, weight, texts) for group in groups]
        shared = spark.sparkContext.broadcast(searches)
        fields, at = out.columns, out.columns.index(text_col)

        def run(batches, shared=shared, fields=fields, at=at):
            A.released()
            finders = shared.value
            for batch in batches:
                data, starts = A.text_bytes(batch.column(at))
                found = []
                for a, b in A.portions(starts):
                    h, first = hashed_words(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a])
                    found += [merged([f.leaks(h[x:y]) for f in finders]) for x, y in zip(first[:-1], first[1:], strict=True)]
                old = batch.column(len(fields) - 1)
                both = pa.array([merged([o, f]) for o, f in zip(old.to_pylist(), found, strict=True)], old.type)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], both], names=fields)

        out = out.mapInArrow(run, out.schema)
    return out
