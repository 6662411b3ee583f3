"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon is learnt from the labelled sample: words and beginnings of words that many different toxic texts hold and hardly
any other. Features of the whole text are densities of lexicon words (plain, and with digits and marks read as letters),
their number near a second-person word, and rates of capitals, marks and obfuscated words. Boosted trees are fitted on one
part of the sample, the monotone map from their margin to a probability on the other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm import arrays as A
from kerbside.llm.labelled import FIT_ROWS, fit_sample, per_text
from kerbside.llm.lm_scoring import held_out
from kerbside.llm.storage import stage

ROUNDS, DEPTH, SEED = 12, 3, 11
#: Terms looked at (those in the most toxic families), terms kept, and what a kept term needs: families, log odds.
CANDIDATES, LEXICON, LEAST_FAMILIES, LEAST_ODDS = 20_000, 1_000, 5, 2.5
#: Letters of a word's beginning that may be a term of its own.
BEGINNINGS = (4, 5, 6, 7)
#: Words within so many words of a second-person word count as near.
NEAR = 5
#: Share of the sample (by hash) that calibrates.
CALIBRATE = 0.3

#: Second-person words of the common languages.
SECOND_PERSON = [
    "you", "your", "yours", "yourself", "u", "ya", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi", "ton", "ta", "tes",
    "vous", "votre", "vos", "usted", "ustedes", "tú", "ti", "tuyo", "vosotros",
]
#: Digits and marks that stand for letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i"}

FEATURES = ["plain", "plain_density", "weight", "top_weight", "hidden", "hidden_density", "near_second", "second_density", "capitals", "marks", "exclamations", "obfuscated", "words"]

_DIGIT_OR_MARK = ~A.LETTER
_DIGIT_OR_MARK[[32, *range(9, 14)]] = False
_READ = np.arange(256, dtype=np.uint8)
for _k, _v in LOOKALIKES.items():
    _READ[ord(_k)] = ord(_v)
_READS = _READ != np.arange(256)


def prefix_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Hash of every word with capital A-Z lower-cased, and of its beginnings (0 where it is no longer than that)."""
    if not len(begins):
        return np.empty(0, np.uint64), [np.empty(0, np.uint64) for _ in BEGINNINGS]
    length = ends - begins
    offset = np.zeros(len(length), np.int64)
    np.cumsum(length[:-1], out=offset[1:])
    place = np.arange(int(length.sum())) - np.repeat(offset, length)
    at = place + np.repeat(begins, length)
    c = data[at]
    c = np.where((c >= 65) & (c <= 90), c + 32, c).astype(np.uint64) + np.uint64(1)
    c *= A.powers(int(length.max()))[place]
    whole = A.mix(np.add.reduceat(c, offset) + np.uint64(1))
    # characters, not bytes: continuation bytes do not count
    first_byte = (data[at] & 0xC0) != 0x80
    nth = np.cumsum(first_byte)
    nth -= np.repeat(nth[offset] - 1, length)
    chars = nth[offset + length - 1]
    out = []
    for n in BEGINNINGS:
        h = A.mix(np.add.reduceat(np.where(nth <= n, c, np.uint64(0)), offset) + np.uint64(2 + n))
        out.append(np.where(chars > n, h, np.uint64(0)))
    return whole, out


def terms_of(data: np.ndarray, starts: np.ndarray):
    """For each text the distinct hashes of its words and their beginnings, and a key that near copies mostly share."""
    begins, ends, first = A.letter_words(data, starts)
    whole, parts = prefix_hashes(data, begins, ends)
    for x, y in zip(first[:-1], first[1:], strict=True):
        own = np.unique(np.concatenate([whole[x:y], *[p[x:y] for p in parts]]))
        grams = A.grams(whole[x:y], min(3, max(1, int(y - x))))
        yield own[own > 0], (grams.min() if len(grams) else np.uint64(0))


def learn_lexicon(rows: DataFrame) -> dict[int, float]:
    """Hash of each term and its log odds, from rows with ``text`` and ``y``. Copies of one text count as one family."""

    def toxic(batches):
        for batch in batches:
            data, starts = A.text_bytes(batch.column(0))
            for terms, family in terms_of(data, starts):
                yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(np.full(len(terms), family).view(np.int64))], names=["term", "family"])

    positive, families = rows.filter("y = 1").select("text"), "count(distinct family)"
    found = positive.mapInArrow(toxic, "term long, family long")
    found = found.groupBy("term").agg(F.expr(families).alias("n")).filter(F.col("n") >= LEAST_FAMILIES)
    looked_at = {r[0]: r[1] for r in found.orderBy(F.desc("n"), "term").limit(CANDIDATES).collect()}
    if not looked_at:
        return {}
    keys = np.sort(np.array(list(looked_at), np.int64).view(np.uint64))

    def clean(batches):
        counts, texts = np.zeros(len(keys), np.int64), 0
        for batch in batches:
            data, starts = A.text_bytes(batch.column(0))
            for terms, _ in terms_of(data, starts):
                at = np.searchsorted(keys, terms)
                at = at[(at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == terms)]
                counts[at] += 1
                texts += 1
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(keys[full].view(np.int64), 0)), pa.array(np.append(counts[full], texts))], names=["term", "n"])

    others = rows.filter("y = 0").select("text").mapInArrow(clean, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    seen = {r[0]: r[1] for r in others.collect()}
    n_toxic, n_clean = positive.count(), seen.pop(0, 0)
    odds = {t: float(np.log((n + 0.5) / (n_toxic + 1)) - np.log((seen.get(t, 0) + 0.5) / (n_clean + 1))) for t, n in looked_at.items()}
    best = sorted((t for t in odds if odds[t] >= LEAST_ODDS), key=lambda t: (-odds[t] * np.log(looked_at[t] + 1), t))[:LEXICON]
    return {t: odds[t] for t in best}


def features(lexicon: dict[int, float]):
    """Function from portions of texts to the FEATURES of each."""
    keys = np.array(sorted(np.array([t], np.int64).view(np.uint64)[0] for t in lexicon), np.uint64)
    weights = np.array([lexicon[int(np.array([k], np.uint64).view(np.int64)[0])] for k in keys])
    text = " ".join(SECOND_PERSON).encode()
    data = np.frombuffer(text, np.uint8)
    begins, ends, _ = A.letter_words(data, np.array([0, len(data)]))
    second = np.sort(prefix_hashes(data, begins, ends)[0])

    def found(hashes: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(hashes))
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return np.where(keys[at] == hashes, weights[at], 0.0)

    def hits(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        whole, parts = prefix_hashes(data, begins, ends)
        best = found(whole)
        for p in parts:
            best = np.maximum(best, found(p))
        return best, whole

    def measure(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        begins, ends, first = A.letter_words(data, starts)
        weight, whole = hits(data, begins, ends)
        you = np.isin(whole, second)
        # words that mix letters with digits or marks inside, read with the letters these stand for
        read = _READ[data]
        inner = _READS[data].copy()
        inner[1:] &= A.LETTER[data[:-1]]
        inner[:-1] &= A.LETTER[data[1:]]
        if len(inner):
            inner[0] = inner[-1] = False
        for s in starts[1:-1]:
            inner[max(s - 1, 0)] = inner[min(s, len(inner) - 1)] = False
        shown = np.where(inner, read, data)
        begins_2, ends_2, first_2 = A.letter_words(shown, starts)
        many = np.concatenate([[0], np.cumsum(inner)])
        mixed = many[ends_2] > many[begins_2] if len(begins_2) else np.empty(0, bool)
        hidden, _ = hits(shown, begins_2[mixed], ends_2[mixed])
        at_mixed = np.flatnonzero(mixed)
        out = np.zeros((len(starts) - 1, len(FEATURES)))
        capital = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
        mark = np.concatenate([[0], np.cumsum(_DIGIT_OR_MARK[data])])
        call = np.concatenate([[0], np.cumsum(data == 33)])
        for i, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
            x, y = first[i], first[i + 1]
            n, size = max(int(y - x), 1), max(int(b - a), 1)
            own = weight[x:y]
            hit = np.flatnonzero(own > 0)
            of_you = np.flatnonzero(you[x:y])
            near = 0
            if len(hit) and len(of_you):
                k = np.searchsorted(of_you, hit)
                gap = np.minimum(np.abs(of_you[np.minimum(k, len(of_you) - 1)] - hit), np.abs(of_you[np.maximum(k - 1, 0)] - hit))
                near = int((gap <= NEAR).sum())
            covert = hidden[np.searchsorted(at_mixed, first_2[i]) : np.searchsorted(at_mixed, first_2[i + 1])]
            secret = int((covert > 0).sum())
            out[i] = (
                len(hit), len(hit) / n, own.sum() / n, own.max() if len(own) else 0.0, secret, secret / n, near, len(of_you) / n,
                (capital[b] - capital[a]) / size, (mark[b] - mark[a]) / size, (call[b] - call[a]) / size, len(covert) / n, y - x,
            )
        return out

    return measure


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", threshold: float = 0.5, fit_rows: int = FIT_ROWS
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``; ``score`` is the calibrated probability of label 1.

    Lexicon, trees and calibration are fitted on at most ``fit_rows`` labelled documents that are not held out (crc32 of the
    id by 5 is not 0). Null and empty texts have features of 0 and a score like any other; a row without an id is scored
    and not held out; repeated rows are each scored. Without both labels in the sample every score is the share of label 1
    (0 without labels).
    """
    sample = fit_sample(labels, label, fit_rows)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = stage(rows.join(F.broadcast(sample), "doc_id"), "toxicity-fit")
    positive, total = rows.agg(F.coalesce(F.sum("y"), F.lit(0.0)), F.count(F.lit(1))).first()
    flagged = held_out(F.col("doc_id"), 5, 0).alias("held_out")
    if positive in (0.0, float(total)):
        share = F.lit(positive / total if total else 0.0)
        return docs.select(F.col(id_col).alias("doc_id")).select("doc_id", flagged, share.alias("score"), (share >= threshold).cast("int").alias("predicted"))
    measure = features(learn_lexicon(rows))
    fitted = per_text(rows, "text", FEATURES, measure, ["doc_id", "y"])
    vector = VectorAssembler(inputCols=FEATURES, outputCol="features")
    fitted = stage(fitted, "toxicity-features")
    part = F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(1000)) < int(1000 * CALIBRATE)
    train, rest = fitted.filter(~part), fitted.filter(part)
    trees = GBTClassifier(labelCol="y", maxIter=ROUNDS, maxDepth=DEPTH, seed=SEED, stepSize=0.3, minInstancesPerNode=5)
    model = trees.fit(vector.transform(train).select("features", "y").coalesce(2))
    margin = vector_to_array("rawPrediction")[1]

    def margins(df: DataFrame) -> DataFrame:
        return model.transform(vector.transform(df)).withColumn("margin", margin)

    isotonic = IsotonicRegression(labelCol="y", featuresCol="margin", predictionCol="score")
    calibrated = isotonic.fit(margins(rest).select("margin", "y").coalesce(2))
    scored = margins(per_text(docs.withColumnRenamed(id_col, "doc_id"), text_col, FEATURES, measure, ["doc_id"])).select("doc_id", "margin")
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))).alias("score")
    scored = calibrated.transform(scored).select("doc_id", flagged, score)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
