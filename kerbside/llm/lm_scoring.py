"""Scoring with a weighted backoff automaton of word n-grams.

Model. Counts c over the training texts (a start symbol in front, an end symbol behind) give
  P(w)      = (c(w) + a) / (N + a (V + 1))
  P(w | v)  = (c(v w) + m P(w)) / (c(v) + m)          and so on for longer histories, m for each order,
so every conditional distribution sums to 1. As an automaton: a state for every history seen in training, an arc for
every n-gram seen after it that carries the smoothed log-probability, and a failure arc of weight m / (c(v) + m) to the
next shorter history. A text is one traversal from left to right that carries the state and adds up the weights.

Distribution. The automaton of a large corpus fits no machine, but the texts of one block only meet their own n-grams.
Each block sends its distinct n-grams with their training counts to hash ranges of the key space and gets the counts of
the whole corpus back (``exchange``); from these it builds the part of the automaton that its texts can reach and
traverses it, many texts at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.llm import arrays as A
from kerbside.llm import exchange as X

ORDER = 3
ADD = 0.1
#: Prior weight m of the shorter history, for orders 2 and 3.
PRIOR = (100.0, 400.0)
BLOCK_BYTES = 6 << 20
BUCKET_KEYS = 2_000_000
#: Bits left out of the hashes of n-grams of two words and more; single words keep all 64.
SHIFT = 18
#: Tokens of a lane: long texts are cut into lanes that start in the state that the words before them lead to.
LANE = 256

START, END = np.uint64(0x5DEECE66D0F1E2D3), np.uint64(0xB5297A4D3F84D5B5)
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out(doc_id: Column, mod: int, remainder: int) -> Column:
    """True where crc32 of the id as text leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == remainder, F.lit(False))


def _sequences(table: pa.Table, order: int):
    """Keys of all n-grams that end at each token, by order; where each text's tokens begin."""
    data, starts = A.text_bytes(table["text"])
    parts, first = [], [0]
    for a, b in A.portions(starts):
        h, at = A.words(data[starts[a] : starts[b]], starts[a : b + 1] - starts[a])
        for x, y in zip(at[:-1], at[1:], strict=True):
            parts.append(h[x:y])
            first.append(first[-1] + int(y - x) + 1)
    first = np.array(first)
    tokens = np.full(first[-1], END, np.uint64)
    inside = np.ones(len(tokens), bool)
    inside[first[1:] - 1] = False
    tokens[inside] = np.concatenate([*parts, np.empty(0, np.uint64)])
    keys = [A.mix(tokens + np.uint64(1))]
    history = tokens
    for n in range(2, order + 1):
        before = np.empty_like(history)
        before[1:] = history[:-1]
        before[first[:-1]] = START ^ np.uint64(n)
        history = A.mix(before * A.GRAM_BASE + tokens)
        keys.append((A.mix(history + np.uint64(n)) >> np.uint64(SHIFT)) << np.uint64(SHIFT))
    return keys, first


def _distinct(keys: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    return [np.unique(k, return_inverse=True) for k in keys]


def _train_mask(table: pa.Table, first: np.ndarray) -> np.ndarray:
    train = ~table["held_out"].to_numpy()
    return np.repeat(train, np.diff(first))


class Automaton:
    """The reachable part: states 0 (no history), then one for every seen history of 1 … order-1 words.

    ``arc[n]`` has the weight of each n-gram (NaN: no such arc), ``fail[n]`` the weight of leaving each history of n
    words, ``ids[n]`` the n-gram that ends at each token.
    """

    def __init__(self, ids: list[np.ndarray], counts: list[np.ndarray], first: np.ndarray, total: int, kinds: int, texts: int, add: float, prior):
        self.ids, self.counts, self.first = ids, counts, first
        self.order = len(ids)
        head = np.zeros(len(ids[0]), bool)
        head[first[:-1]] = True
        p = (counts[0] + add) / (total + add * (kinds + 1))
        self.arc = [np.log10(p)]
        self.base = self.arc[0]
        at_token = p[ids[0]]
        self.fail = []
        for n in range(1, self.order):
            m = prior[n - 1]
            context = np.empty(len(ids[0]))
            context[1:] = counts[n - 1][ids[n - 1]][:-1]
            context[head] = texts
            smoothed = (counts[n][ids[n]] + m * at_token) / (context + m)
            arc = np.full(len(counts[n]), np.nan)
            arc[ids[n]] = np.log10(smoothed)
            arc[counts[n] == 0] = np.nan
            self.arc.append(arc)
            # of histories by the n-gram that spells them; the history of a text's first token is the start symbol's
            self.fail.append((np.log10(m / (counts[n - 1] + m)), float(np.log10(m / (texts + m)))))
            at_token = smoothed
        if not total:
            self.arc[0] = np.log10(np.full(len(p), 1 / (kinds + 1)))

    def traverse(self) -> np.ndarray:
        """Log-probability of each text."""
        length = np.diff(self.first)
        lanes_of = -(-length // LANE)
        text = np.repeat(np.arange(len(length)), lanes_of)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(lanes_of) - lanes_of, lanes_of)
        begin = self.first[:-1][text] + nth * LANE
        size = np.minimum(LANE, self.first[1:][text] - begin)
        by_size = np.argsort(-size, kind="stable")
        begin, size = begin[by_size], size[by_size]
        # the state: how many words of history are known here (the history itself is what stands before the token)
        state = np.minimum(begin - self.first[:-1][text[by_size]], 1)
        state = np.where(state > 0, self._known(np.maximum(begin - 1, 0)), self.order - 1 if self.arc else 0)
        weight = np.zeros(len(begin))
        for step in range(int(size.max()) if len(size) else 0):
            live = int(np.searchsorted(-size, -step, side="left"))
            at = begin[:live] + step
            head = np.isin(at, self.first[:-1], assume_unique=False) if step == 0 else np.zeros(live, bool)
            level, todo = state[:live].copy(), np.arange(live)
            while len(todo):
                here, n = at[todo], level[todo]
                arc = np.full(len(todo), np.nan)
                leave = np.zeros(len(todo))
                for k in range(self.order):
                    of = np.flatnonzero(n == k)
                    if not len(of):
                        continue
                    arc[of] = self.arc[k][self.ids[k][here[of]]]
                    if k:
                        fail, at_start = self.fail[k - 1]
                        leave[of] = np.where(head[todo[of]], at_start, fail[self.ids[k - 1][np.maximum(here[of] - 1, 0)]])
                failed = np.isnan(arc)
                weight[todo] += np.where(failed, leave, arc)
                todo = todo[failed]
                level[todo] -= 1
            state[:live] = self._known(at)
        out = np.zeros(len(length))
        np.add.at(out, text[by_size], weight)
        return out

    def _known(self, at: np.ndarray) -> np.ndarray:
        """Words of the longest history, ending with the token at ``at``, that training has seen."""
        known = np.zeros(len(at), np.int64)
        for n in range(self.order - 1):
            known[self.counts[n][self.ids[n][at]] > 0] = n + 1
        return known


def score(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = ORDER,
    add: float = ADD,
    prior: tuple[float, ...] = PRIOR,
    mod: int = 10,
    remainder: int = 0,
) -> DataFrame:
    """Score of every text under the n-gram model learnt from the texts that are not held out.

    Words are split at ASCII white space with A-Z lower-cased; each text ends in one end token. A null text is empty (one
    token). ``base_score`` is the sum of the logarithms of P(w), ``score`` the automaton's. A document is held out when
    crc32 of its id leaves ``remainder`` by ``mod``. Without training texts every token has the same probability. Rows
    without an id are left out; rows that repeat an id count as one, with its smallest text; other columns are ignored.
    Words and n-grams are told apart by hashes of 64 and of 46 bits.
    """
    if not 1 <= order <= len(prior) + 1:
        raise ValueError("give one prior weight for each order from 2 on")
    _, size = X.measured(docs, text_col)
    blocks = X.dealt(docs, id_col, text_col, X.block_count(size, BLOCK_BYTES)).withColumn("held_out", held_out(F.col("doc_id"), mod, remainder))
    buckets = max(8, order * size // 6 // BUCKET_KEYS)
    lower = A.bucket_starts(buckets)

    def ask(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        table = X.one_per_id(table)
        keys, first = _sequences(table, order)
        train = _train_mask(table, first)
        rows = []
        packed = []
        for n, (k, at) in enumerate(_distinct(keys)):
            counts = np.bincount(at[train], minlength=len(k))
            cut = np.append(np.searchsorted(k, lower), len(k))
            packed.append([A.pack(k[a:b], SHIFT if n else 0, counts[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)])
        for bucket in range(buckets):
            rows.append((block, bucket, X.joined([p[bucket] for p in packed])))
        return X.letters(rows)

    def answer(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        senders = table["block"].to_pylist()
        parts = [X.split(x) for x in table["data"].to_pylist()]
        replies: list[list[bytes]] = [[] for _ in senders]
        tokens = kinds = 0
        for n in range(order):
            got = [A.unpack(p[n]) for p in parts]
            keys, at = np.unique(np.concatenate([k for k, _ in got]), return_inverse=True)
            total = np.bincount(at, weights=np.concatenate([v for _, v in got]), minlength=len(keys)).astype(np.int64)
            if n == 0:
                tokens, kinds = int(total.sum()), int((total > 0).sum())
            start = 0
            for i, (k, _) in enumerate(got):
                own = total[at[start : start + len(k)]]
                start += len(k)
                kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if not len(own) or own.max() <= np.iinfo(t).max)
                replies[i].append(np.dtype(kind).str.encode() + A.zlib.compress(own.astype(kind).tobytes(), 1))
        head = np.array([tokens, kinds], np.int64).tobytes()
        return X.letters([(block, bucket, X.joined([head, *r])) for block, r in zip(senders, replies, strict=True)])

    def finish(table: pa.Table, right: pa.Table) -> pa.Table:
        table = X.one_per_id(table)
        keys, first = _sequences(table, order)
        ids = [at for _, at in _distinct(keys)]
        got = [X.split(x) for x in X.by_bucket(right).values()]
        totals = np.sum([np.frombuffer(g[0], np.int64) for g in got], axis=0)
        counts = [np.concatenate([np.frombuffer(A.zlib.decompress(g[n + 1][3:]), np.dtype(g[n + 1][:3].decode())).astype(np.int64) for g in got]) for n in range(order)]
        tokens, kinds = int(totals[0]), int(totals[1])
        texts = int(counts[0][ids[0][first[1] - 1]])  # every training text has one end
        machine = Automaton(ids, counts, first, tokens, kinds, texts, add, prior)
        known = np.add.reduceat((counts[0][ids[0]] > 0).astype(np.int64), first[:-1])
        with np.errstate(divide="ignore"):
            base = np.add.reduceat(machine.base[ids[0]], first[:-1])
        n = len(first) - 1
        return pa.table(
            {
                "doc_id": table["doc_id"], "held_out": table["held_out"], "n_tokens": pa.array(np.diff(first), pa.int64()),
                "n_known": pa.array(known), "train_tokens": pa.array(np.full(n, tokens, np.int64)), "base_score": pa.array(base),
                "score": pa.array(machine.traverse()),
            }
        )

    return X.with_answers(blocks, X.ask_and_answer(blocks, ask, answer), finish, SCHEMA)
