"""Scores for abusive, hateful or sexual content: a string-kernel support vector machine on Nystrom landmarks.

The kernel counts the three-character subsequences that two passages share, gaps allowed and discounted, so that inserted,
dropped or swapped characters cost little. A few hundred landmark passages span the space (Nystrom's method); a linear machine
with squared hinge loss is trained on it. The labels stand for documents, so the passages that earn them are found in rounds:
of a bad document those that score best count as bad. As the kernel is a sum over hashed subsequences, the trained machine folds
into one weight for each of 2 ** HASH_BITS of them, and scoring a passage is a look-up of its subsequences.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronotext.session import materialize

HASH_BITS = 14
#: A subsequence spans at most so many characters, each character of it beyond the first two counting DECAY.
SPAN, DECAY = 5, 0.7
LANDMARKS = 320
#: The fit uses a bounded sample, always the first by hash: so many marked documents; of these whole documents until the bad ones and
#: the others have so many passages; and so many passages to choose landmarks from.
MARKED_DOCUMENTS = 50_000
BAD_PASSAGES, GOOD_PASSAGES, LANDMARK_POOL = 25_000, 45_000, 2_000
#: Documents of more passages are drawn last, so that none takes the place of all others.
VERY_LONG = 500
#: One in so many marked documents of a kind is held out.
FOLDS = 4
#: The cutoffs tried. How much rarer bad documents are in the corpus than among the marked, which were drawn to hold many, is counted
#: over all its documents at each of them.
GRID = np.linspace(-0.6, 1.2, 73)
ROUNDS, COST = 5, 5.0
#: The score of a text without passages.
NOTHING = -9.0
#: Sentences of more words are read in windows of so many, half of one overlapping the next.
LONG, WINDOW = 24, 16
SEED = 20261127

# Look-alikes of Latin letters, and digits and signs that stand for letters inside words.
LOOKALIKES = dict(zip("асеорхуіјѕһԁԛѡвнкмтгαορνικτυγεη", "aceopxyijshdqwbhkmtraopviktuyen"))
STANDINS = dict(zip("0134578$@!€|", "oieastbsaiel"))
_LOOKALIKES = str.maketrans(LOOKALIKES)
_STANDIN = re.compile("[0134578$@€!|](?=[a-z])|(?<=[a-z])[0134578$@€]")
# A line break ends a sentence only before an empty line, a list item, a heading, a quotation or a table row; others are layout.
_SPLIT = re.compile(r"(?<=[.!?\u2026])[\"\u201d\u2019)*_]*\s+|\n\s*\n|\n(?=\s*(?:[-*#>|{}]|\d+[.)]\s))|(?<=[\u3002\uff01\uff1f])")
# The same for plain ASCII, where the mark that ends a sentence may go with the break: marks are dropped later anyway.
_PLAIN_SPLIT = re.compile(r"[.!?\n](?:(?<=[.!?])[\")*_]*\s+|(?<=\n)(?:\s*\n|(?=\s*(?:[-*#>|{}]|\d+[.)]\s))))")
_UNSEEN = re.compile("[\u00ad\u034f\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff\u0300-\u036f\x00-\x08\x0e-\x1f\x7f]")
_LINE_TAG, _TAG = re.compile(r"</?(?:p|br|div|li|tr|td|h[1-6])\b[^<>]*>", re.I), re.compile(r"</?[A-Za-z][^<>]*>")
_NUMBER, _MARKS, _LINE_MARKS = re.compile(r"\d+"), re.compile(r"[^\w#* ]+"), re.compile(r"[^\w#* \n]+")
_LATIN, _SPACED = re.compile("[a-z]"), re.compile(r"(?<=\b\w)[.\-_*](?=\w\b)")


def tidy(sentence: str) -> str:
    """Case, marks, layout and disguises folded; numbers as #; blanks at both ends."""
    if sentence.isascii() and sentence.isprintable():
        text = sentence.lower()
    else:
        text = _UNSEEN.sub("", unicodedata.normalize("NFKD", sentence)).casefold()
        if not text.isascii():
            text = " ".join(w if w.isascii() or not _LATIN.search(w) else w.translate(_LOOKALIKES) for w in text.split())
    while (clean := _STANDIN.sub(lambda m: STANDINS[m.group()], text)) != text:
        text = clean
    text = _SPACED.sub("", _NUMBER.sub("#", " ".join(text.split())))
    return f" {' '.join(_MARKS.sub('', text).split())} "


def _plain_sentences(text: str) -> list[str]:
    """``tidy`` for all sentences of an ASCII text at once."""
    lines = "\n".join([" ".join(x.split()) for x in _PLAIN_SPLIT.split(text)]).lower()
    if not lines.replace("\n", "").isprintable():
        lines = _UNSEEN.sub("", lines)
    while (clean := _STANDIN.sub(lambda m: STANDINS[m.group()], lines)) != lines:
        lines = clean
    lines = _LINE_MARKS.sub("", _SPACED.sub("", _NUMBER.sub("#", lines)))
    return [f" {' '.join(x.split())} " for x in lines.split("\n")]


def passages(text: str | None) -> list[str]:
    """The distinct sentences of a text, long ones in overlapping windows."""
    found: dict[str, None] = {}
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub("", _LINE_TAG.sub("\n", text))
    if "&" in text:
        text = html.unescape(text)
    for clean in _plain_sentences(text) if text.isascii() else [tidy(x) for x in _SPLIT.split(text) if x and not x.isspace()]:
        if clean.count(" ") > LONG:
            words = clean.split()
            if len(words) > LONG:
                for i in range(0, len(words) - WINDOW // 2, WINDOW // 2):
                    found[f" {' '.join(words[i : i + WINDOW])} "] = None
                continue
        if not clean.isspace():
            found[clean] = None
    return list(found)


#: Texts that ``features`` reads at a time: their numbers, hashes and gaps fit in 32 bits.
MOST_TEXTS = 1 << 14
#: Passages that are scored at a time.
PIECE = 1_000
_ODD = np.random.default_rng(SEED).integers(1, 2**31, 5, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_DECAYS = (DECAY ** np.arange(8)).astype(np.float32)


def _subsequences(texts: list[str]) -> np.ndarray:
    """A sorted number for each subsequence of up to MOST_TEXTS texts: the text's number, HASH_BITS of hash, and three bits for its gaps."""
    gap = "\0" * SPAN
    codes = np.frombuffer((gap.join(texts) + gap).encode("utf-32-le"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.uint32) << np.uint32(HASH_BITS + 3), [len(t) + SPAN for t in texts])
    real = codes > 0
    mixed = []
    for odd in _ODD[:3]:
        h = (codes + np.uint32(1)) * odd
        mixed.append((h ^ (h >> np.uint32(15))) * _ODD[3])
    keys = []
    # The zeros between two texts are more than a subsequence spans, so its ends are in one text if they are characters.
    for b in range(2, SPAN):
        n = max(len(codes) - b, 0)
        at = np.flatnonzero(real[:n] & real[b : b + n])
        ends, own = mixed[0][at] + mixed[2][at + b], owner[at] | np.uint32(b - 2)
        for a in range(1, b):
            h = (ends + mixed[1][at + a]) * _ODD[4]
            h ^= h >> np.uint32(16)
            keys.append(own | ((h * _ODD[3]) >> np.uint32(32 - HASH_BITS)) << np.uint32(3))
    return np.sort(np.concatenate(keys))


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed subsequences of up to MOST_TEXTS texts: (text number, hash, weight), sorted; the weights of a text have norm 1."""
    key = _subsequences(texts)
    if not len(key):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
    weight = _DECAYS[key & np.uint32(7)]
    key >>= np.uint32(3)
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    weight, key = np.add.reduceat(weight, first), key[first].astype(np.int64)
    text, bucket = key >> HASH_BITS, key & (2**HASH_BITS - 1)
    norm = np.sqrt(np.bincount(text, weight * weight, len(texts)))
    return text, bucket, (weight / norm[text]).astype(np.float32)


def weighted(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """The sum of ``weights[hash] * weight`` over the ``features`` of each text (0 without any), without making these one by one.

    Before the norm a text's sum is linear in its subsequences, so they need no grouping by hash; the norm takes the sums of groups as
    differences of running sums.
    """
    out = np.zeros(len(texts))
    # By hash and gaps at once.
    table = (weights[:, None] * _DECAYS[None, :]).ravel()
    for at in range(0, len(texts), MOST_TEXTS):
        key = _subsequences(texts[at : at + MOST_TEXTS])
        if not len(key):
            continue
        edges = np.searchsorted(key, np.arange(len(texts[at : at + MOST_TEXTS]) + 1, dtype=np.uint64) << np.uint64(HASH_BITS + 3))
        some = np.flatnonzero(edges[1:] > edges[:-1])
        start = edges[some]
        total = np.add.reduceat(table[key & np.uint32(2 ** (HASH_BITS + 3) - 1)], start, dtype=np.float64)
        running = np.cumsum(_DECAYS[(key & np.uint32(7)).view(np.int32)], dtype=np.float64)
        key >>= np.uint32(3)
        ends = np.ones(len(key), bool)
        np.not_equal(key[1:], key[:-1], out=ends[:-1])
        last = np.flatnonzero(ends)
        groups = np.diff(running[last], prepend=0.0)
        groups *= groups
        out[at + some] = total / np.sqrt(np.add.reduceat(groups, np.searchsorted(last, start)))
    return out


def dense(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), 2**HASH_BITS), np.float32)
    text, bucket, weight = features(texts)
    out[text, bucket] = weight
    return out


def kernel_rows(texts: list[str], landmarks: np.ndarray) -> np.ndarray:
    """Kernel values of texts with landmarks; ``landmarks`` is (2 ** HASH_BITS, number)."""
    out = np.zeros((len(texts), landmarks.shape[1]), np.float32)
    for at in range(0, len(texts), PIECE):
        text, bucket, weight = features(texts[at : at + PIECE])
        edges = np.searchsorted(text, np.arange(len(texts[at : at + PIECE]) + 1))
        for i, (start, stop) in enumerate(zip(edges[:-1], edges[1:])):
            out[at + i] = weight[start:stop] @ landmarks[bucket[start:stop]]
    return out


def spread_out(pool: np.ndarray, number: int) -> np.ndarray:
    """Places of up to ``number`` rows, each the least similar to those before it."""
    chosen, nearest = [0], pool @ pool[0]
    while len(chosen) < min(number, len(pool)):
        i = int(np.argmin(nearest))
        if nearest[i] > 0.999:
            break
        chosen.append(i)
        nearest = np.maximum(nearest, pool @ pool[i])
    return np.array(chosen)


def machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float, steps: int = 15) -> np.ndarray:
    """Weights and bias of a linear machine with squared hinge loss, by Newton steps on the active rows."""
    wide = x.shape[1]
    w = np.zeros(wide + 1)
    for _ in range(steps):
        active = np.flatnonzero(y * (x @ w[:-1].astype(x.dtype) + w[-1]) < 1)
        xa, wa, ya = x[active], (2 * cost * weight[active]).astype(x.dtype), y[active]
        left, right = np.eye(wide + 1), np.zeros(wide + 1)
        left[-1, -1] = 1e-4
        right[:-1], right[-1] = xa.T @ (wa * ya).astype(x.dtype), float((wa * ya).sum())
        left[:-1, -1] = left[-1, :-1] = xa.T @ wa
        left[-1, -1] += float(wa.sum())
        xa *= np.sqrt(wa)[:, None]
        left[:-1, :-1] += xa.T @ xa
        new = np.linalg.solve(left, right)
        if np.abs(new - w).max() < 1e-4:
            return new
        w = new
    return w


def train(x: np.ndarray, doc: np.ndarray, bad: np.ndarray, use: np.ndarray) -> np.ndarray:
    """The machine on the passages ``use``; ``bad`` (+1, -1) is the mark of a passage's document ``doc`` (0, 1, ...)."""
    label = bad.copy()
    w = np.zeros(x.shape[1] + 1)
    for turn in range(ROUNDS):
        rows = np.flatnonzero(use & (label != 0))
        y = label[rows].astype(float)
        if not ((y > 0).any() and (y < 0).any()):
            return w
        heavy = np.where(y > 0, 1.0, 1.0 if turn else max(1.0, (y > 0).sum() / (y < 0).sum()))
        w = machine(x[rows], y, heavy, COST if turn else COST / 50)
        s = x @ w[:-1].astype(x.dtype) + w[-1]
        order = np.lexsort((s, doc))
        top = np.zeros(len(s), bool)
        top[order[np.r_[doc[order][1:] != doc[order][:-1], True]]] = True
        # Raters err: a bad document without a bad passage, and a bad-looking passage of a good one, are left out.
        earned = np.where((top & (s > -0.6)) | (s > 0.3), 1, np.where(s < -0.3, -1, 0))
        label = np.where(bad > 0, earned, np.where((s > 0.5) & (turn >= 1), 0, bad))
    return w


@dataclass
class Model:
    """``weights`` of hashed subsequences and what is added to a passage's sum, so that 0 is the cutoff."""

    weights: np.ndarray
    bias: float
    held_out_f1: float = float("nan")


def labelled(documents: DataFrame, marks: DataFrame) -> DataFrame:
    """``doc_id``, ``bad`` (1, -1), ``passage`` of marked documents; those with as many marks for as against are left out."""
    votes = marks.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.avg("toxic").alias("share")).where("share <> 0.5")
    # A bounded table, so that the corpus isn't shuffled to find its marked documents.
    sample = votes.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MARKED_DOCUMENTS)
    texts = documents.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(sample), "doc_id").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, 1 if s > 0.5 else -1, p) for d, t, s in zip(batch["doc_id"], batch["text"], batch["share"]) for p in passages(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "bad", "passage"])

    return texts.mapInPandas(run, "doc_id bigint, bad int, passage string")


#: Without marks of both kinds.
NEVER = Model(np.zeros(2**HASH_BITS, np.float32), -1.0)


@dataclass
class Held:
    """Marked documents that the machine hasn't seen: the score of each one's worst passage, and whether it is marked bad."""

    best: np.ndarray
    bad: np.ndarray


NONE_HELD = Held(np.empty(0), np.empty(0, bool))


def cutoff(scores: DataFrame, held: Held) -> tuple[float, float]:
    """The cutoff of best F1 on ``held``, good documents weighted by how much commoner they are in ``scores`` (all rows count) than there; and the F1.

    One aggregation, a number for each cutoff tried. Cutoffs that are equally good give their median. With no document of one of
    the kinds held out, nothing can be compared and the cutoff is the machine's own, 0, without an F1; any other number is enough.
    """
    bad, good = int(held.bad.sum()), int((~held.bad).sum())
    if not bad or not good:
        return 0.0, float("nan")
    counts = scores.where("doc_id IS NOT NULL").agg(F.count(F.lit(1)), *[F.count(F.when(F.col("score") > float(c), 1)) for c in GRID]).first()
    total = max(counts[0], 1)
    f1 = np.zeros(len(GRID))
    for i, c in enumerate(GRID):
        share = max(counts[i + 1], 1) / total
        rarer = max(1.0, (1 - share) / share / (good / bad))
        hit, false = ((held.best > c) & held.bad).sum(), ((held.best > c) & ~held.bad).sum()
        f1[i] = 2 * hit / max(1.0, hit + rarer * false + bad)
    return float(np.median(GRID[f1 >= f1.max() - 1e-9])), float(f1.max())


def fit(documents: DataFrame, marks: DataFrame) -> Model:
    """``machine_of`` with its ``cutoff``, for scoring other documents; ``scored`` is cheaper for these."""
    raw, held = machine_of(documents, marks)
    limit, f1 = cutoff(score(documents, raw), held)
    return Model(raw.weights, raw.bias - limit, f1)


def scored(documents: DataFrame, marks: DataFrame) -> DataFrame:
    """``score`` of ``documents`` by the machine fitted to them: they are scored once, for the cutoff and for the result."""
    raw, held = machine_of(documents, marks)
    scores = materialize(score(documents, raw))
    limit, _ = cutoff(scores, held)
    return scores.withColumn("score", F.when(F.col("score") > NOTHING, F.col("score") - limit).otherwise(NOTHING))


def machine_of(documents: DataFrame, marks: DataFrame) -> tuple[Model, Held]:
    """Train on the passages of ``drawn`` documents. Without marks of both kinds every score is below 0.

    A first machine sees three quarters of them; the marked documents that it hasn't seen, drawn or not, are judged by all their passages.
    """
    spark = documents.sparkSession
    rows = materialize(labelled(documents, marks)).withColumn("h", F.xxhash64("doc_id", "passage"))
    chosen = materialize(drawn(rows))
    sample = materialize(rows.join(F.broadcast(chosen.where("used").select("doc_id", "held")), "doc_id").repartition(12, "h"))
    # Hashes are sorted, not passages; these follow for the hashes that are first.
    first_of = lambda kind, most: sample.where(kind).select("h").distinct().orderBy("h").limit(most)
    pool = first_of("bad > 0", LANDMARK_POOL - LANDMARK_POOL // 3).unionByName(first_of("bad < 0", LANDMARK_POOL // 3))
    drawn_rows = sample.select("h", "bad", "passage").join(F.broadcast(pool), "h", "left_semi").distinct().collect()
    texts = [r.passage for r in sorted(drawn_rows, key=lambda r: (-r.bad, r.h, r.passage))]
    if not texts:
        return NEVER, NONE_HELD
    points = dense(texts)
    marked = points[spread_out(points, LANDMARKS)]
    del points
    values, vectors = np.linalg.eigh((marked @ marked.T).astype(np.float64))
    keep = values > 1e-3
    whiten = (vectors[:, keep] / np.sqrt(values[keep])).astype(np.float32)
    shared = spark.sparkContext.broadcast(np.ascontiguousarray(marked.T))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = kernel_rows(batch.column("passage").to_pylist(), shared.value)
            offsets = pa.array(np.arange(len(k) + 1, dtype=np.int32) * k.shape[1])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(offsets, pa.array(k.ravel()))], ["doc_id", "bad", "held", "k"])

    table = sample.select("doc_id", "bad", "held", "passage").mapInArrow(run, "doc_id bigint, bad int, held boolean, k array<float>").toArrow()
    ids, bad_of, held = table["doc_id"].to_numpy(), table["bad"].to_numpy(), table["held"].to_numpy()
    x = np.concatenate([c.flatten().to_numpy().reshape(len(c), -1) @ whiten for c in table["k"].chunks if len(c)])
    del table
    # In an order that doesn't depend on the tasks'.
    order = np.lexsort((x[:, 0], ids))
    ids, bad_of, held, x = ids[order], bad_of[order], held[order], x[order]
    doc = np.unique(ids, return_inverse=True)[1]

    def folded(w: np.ndarray) -> Model:
        return Model((marked.T @ (whiten @ w[:-1])).astype(np.float32), float(w[-1]))

    first = train(x, doc, bad_of, ~held)
    last = train(x, doc, bad_of, np.ones(len(doc), bool))
    if not last.any():
        return NEVER, NONE_HELD
    unseen = rows.join(F.broadcast(chosen.where("held OR NOT used").select("doc_id")), "doc_id")
    judged = worst(unseen, folded(first)).toPandas()
    return folded(last), Held(judged["best"].to_numpy(), judged["bad"].to_numpy() > 0)


def drawn(rows: DataFrame) -> DataFrame:
    """``doc_id``, ``used``, ``held`` of the marked documents in ``rows`` (a passage each): drawn for the fit with all passages or not, held out or not.

    A document is drawn while those before it have fewer passages than the bound. A table of MARKED_DOCUMENTS rows at most.
    """
    order = Window.partitionBy("bad").orderBy(F.col("n") > VERY_LONG, F.xxhash64(F.lit(SEED), "doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.groupBy("doc_id", "bad").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.sum("n").over(order) - F.col("n"))
    bound = F.when(F.col("bad") > 0, BAD_PASSAGES).otherwise(GOOD_PASSAGES)
    return placed.select("doc_id", (F.col("before") < bound).alias("used"), (F.count(F.lit(1)).over(order) % FOLDS == 0).alias("held"))


def worst(rows: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``bad``, ``best``: the highest score among all of a document's passages in ``rows``."""
    shared = rows.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            texts = batch.column("passage").to_pylist()
            sums = [weighted(texts[at : at + PIECE], weights) for at in range(0, len(texts), PIECE)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(np.concatenate([*sums, np.empty(0)]) + bias)], ["doc_id", "bad", "s"])

    scores = rows.select("doc_id", "bad", "passage").mapInArrow(run, "doc_id bigint, bad int, s double")
    return scores.groupBy("doc_id", "bad").agg(F.max("s").alias("best"))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``source``, ``score``: the score of a document's worst passage; from 0 on it counts as a case.

    Every row is scored, whole texts are read; a text without passages (null, empty, blank) has the score -9.
    """
    shared = documents.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            worst = np.full(len(texts), NOTHING)
            held: list[str] = []
            owner: list[int] = []
            size = 0
            for i, p in ((i, p) for i, text in enumerate([*texts, None]) for p in [*passages(text), None]):
                if p is not None:
                    held.append(p)
                    owner.append(i)
                    size += len(p)
                # Long documents are scored in parts, short ones together.
                if held and (size > 60_000 or i == len(texts)):
                    np.maximum.at(worst, np.array(owner), weighted(held, weights) + bias)
                    held, owner, size = [], [], 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(worst)], ["doc_id", "source", "score"])

    return documents.select("doc_id", "source", "text").mapInArrow(run, "doc_id bigint, source string, score double")


def rates(scores: DataFrame) -> DataFrame:
    """``source``, ``documents``, ``cases``, ``rate``; a null source is a source of its own."""
    case = F.count(F.when(F.col("score") >= 0, 1))
    return scores.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), case.alias("cases"), (case / F.count(F.lit(1))).alias("rate"))
