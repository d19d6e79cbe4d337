"""Quality scores from supervised subword embeddings."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnfield.llm._common import BASE, INVERSE, distinct, hash_below, powers, small

BUCKETS, DIMENSIONS = 1 << 17, 16
GRAMS = (3, 4, 5)
#: Expected number of rows of each label to fit on; with fewer, all are used.
FIT_ROWS = 1500
EPOCHS, RATE = 6, 0.5
#: Characters that are hashed at once.
PIECE = 1 << 19
#: A run of more characters without white space is several words of this size.
MOST_WORD = 4096
#: White space: control characters, the space and delete.
BLANK, SOLID = r"[\x00-\x20\x7f]", r"[^\x00-\x20\x7f]"
_BLANK, _START, _LONG = re.compile(BLANK), re.compile(BLANK + SOLID), re.compile(f"({SOLID}{{{MOST_WORD}}})(?={SOLID})")


def features(code: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words, word pairs and character n-grams of words, with the white space
    around them, and the place in ``code`` of each. Texts lie end to end in ``code``, each
    between two spaces; ``begin`` has where they begin, and the end of the last."""
    n = len(code)
    blank = (code <= 0x20) | (code == 0x7F)
    wide = np.where(blank, 0x20, code).astype(np.uint64) + np.uint64(1)
    before = np.concatenate(([0], np.cumsum(blank)))
    buckets, places = [], []
    rolling = np.zeros(n, np.uint64)
    power = 1
    for k in range(min(max(GRAMS), n)):
        rolling[: n - k] += wide[k:] * np.uint64(power)
        power = power * BASE % (1 << 64)
        if k + 1 in GRAMS:
            at = np.flatnonzero(before[k:n] == before[1 : n - k + 1])  # nothing blank in between
            buckets.append(_bucket(rolling[at], k + 1))
            places.append(at)
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    if len(starts):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(wide * powers(INVERSE, n), dtype=np.uint64)))
        words = (sums[ends] - sums[starts]) * powers(BASE, n)[starts]
        buckets.append(_bucket(words, 0))
        places.append(starts)
        # neighbouring words, hashed by difference: all immediate repeats share a bucket
        together = np.flatnonzero(np.diff(np.searchsorted(begin, starts, "right")) == 0)
        buckets.append(_bucket(words[together + 1] - words[together], 1))
        places.append(starts[together])
    return (np.concatenate(buckets), np.concatenate(places)) if buckets else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _bucket(hashes: np.ndarray, kind: int) -> np.ndarray:
    mixed = hashes ^ np.uint64((kind + 1) * 0xD6E8FEB86659FD93 % (1 << 64))
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(64 - 17)).astype(np.int64)


def _parts(text: str) -> Iterator[tuple[str, int]]:
    """A text between two spaces in parts, and how many characters of each are its own: a part
    ends with the first word of the next one, so that pairs and n-grams at its end are whole."""
    if len(text) > MOST_WORD:
        text = _LONG.sub(r"\1 ", text)
    text, at = f" {text} ", 0
    while len(text) - at > PIECE and (found := _START.search(text, at + PIECE)):
        word = found.start() + 1
        yield text[at : _BLANK.search(text, word).end()], found.start() - at
        at = found.start()
    yield text[at:], len(text) - at


def _packed(texts: Iterable[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of texts, about PIECE characters at once, and the number of the text of each."""
    held, owner, own, n = [], [], [], 0

    def block() -> tuple[np.ndarray, np.ndarray]:
        begin = np.concatenate(([0], np.cumsum([*map(len, held)])))
        code = np.frombuffer("".join(held).encode("utf-32-le", "surrogatepass"), np.uint32)
        buckets, places = features(code, begin)
        part = np.searchsorted(begin, places, "right") - 1
        mine = places - begin[part] < np.array(own)[part]
        return buckets[mine], np.array(owner)[part[mine]]

    for k, text in enumerate(texts):
        for part, size in _parts(text):
            held.append(part)
            owner.append(k)
            own.append(size)
            n += len(part)
            if n >= PIECE:
                yield block()
                held, owner, own, n = [], [], [], 0
    if held:
        yield block()


def _bags(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        for k, text in enumerate(batch.column("text").to_pylist()):
            total = np.zeros(BUCKETS, np.int64)
            for found, _ in _packed([text]):
                total += np.bincount(found, minlength=BUCKETS)
            ids = np.flatnonzero(total)
            counts = total[ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(k, 1), batch.column("quality").slice(k, 1), pa.array([ids.astype(np.int32).tobytes()], pa.binary()), pa.array([counts.astype(np.int32).tobytes()], pa.binary())],
                names=["doc_id", "quality", "ids", "counts"],
            )


def train(bags: list[tuple[int, float, np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 1) -> dict:
    """Embeddings and a softmax layer by stochastic gradient descent.

    ``bags``: label, weight, bucket ids and their counts in the text. Returns what scoring
    needs: for each bucket its vector's part in the difference of the two outputs, and the
    outputs' bias.
    """
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    layer, bias = random.uniform(-0.5, 0.5, (2, DIMENSIONS)).astype(np.float32), np.zeros(2, np.float32)
    steps, done = epochs * max(1, len(bags)), 0
    for _ in range(epochs):
        for k in random.permutation(len(bags)):
            label, weight, ids, counts = bags[k]
            share = counts.astype(np.float32) / np.float32(counts.sum())
            now = rate * (1 - done / steps) * weight
            done += 1
            hidden = share @ vectors[ids]
            outputs = layer @ hidden + bias
            chance = np.exp(outputs - outputs.max())
            chance /= chance.sum()
            chance[label] -= 1
            back = chance @ layer
            layer -= now * np.outer(chance, hidden)
            bias -= now * chance
            # each bucket's step is scaled up as its share in a text is small
            vectors[ids] -= now * np.minimum(1, share * 100)[:, None] * back
    return {"part": (vectors @ (layer[1] - layer[0])).astype(np.float32), "bias": float(bias[1] - bias[0])}


def fit(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> dict:
    """A classifier of ``labels.quality`` (0 or 1) from the texts of ``documents``.

    About ``fit_rows`` labelled rows of each class, chosen by a hash of doc_id, are used
    with their whole texts; their bags of buckets come to the driver, which fits on them.
    Weights restore the classes' shares. Null texts, ids and labels aren't learned from.
    """
    marked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    sizes = {r["quality"]: r["n"] for r in marked.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {"part": np.zeros(BUCKETS, np.float32), "bias": 0.0}
    share = F.lit(0.0)
    for label, n in sizes.items():
        share = F.when(F.col("quality") == label, min(1.1, fit_rows / n)).otherwise(share)
    chosen = marked.where(hash_below(F.col("doc_id"), share))
    rows = documents.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    found = rows.mapInArrow(_bags, "doc_id long, quality int, ids binary, counts binary").toPandas().sort_values(["doc_id", "quality"])
    total, used = sum(sizes.values()), found["quality"].value_counts().to_dict()
    bags = []
    for label, ids, counts in zip(found["quality"], found["ids"], found["counts"], strict=True):
        if len(ids):
            bags.append((int(label), sizes[label] / total / (used[label] / len(found)), np.frombuffer(ids, np.int32), np.frombuffer(counts, np.int32)))
    return train(bags)


def scores(model: dict, texts: list[str]) -> np.ndarray:
    """The chance of label 1 for each text."""
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    for buckets, whose in _packed(texts):
        total += np.bincount(whose, model["part"][buckets], len(texts))
        count += np.bincount(whose, minlength=len(texts))
    return 1 / (1 + np.exp(-(total / np.maximum(count, 1) + model["bias"])))


def _scored(model, column: str, names: list[str]) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, column):
            score = scores(model.value, [t or "" for t in batch.column(column).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(score, pa.float64())], names=[*names, "score"])

    return run


def predict(documents: DataFrame, model: dict, keep: Iterable[str] = ("doc_id",), column: str = "text") -> DataFrame:
    """The columns ``keep`` with ``score double``, the chance of label 1.

    A text's vector is the mean of the vectors of its words, word pairs and the character n-grams of words. As softmax
    over two outputs needs only their difference, each bucket's part in it is worked out
    once and a text's score is a mean of such parts. The broadcast model has a fixed size.

    Defined cases: null texts, empty ones and those without a word get the score of the bias
    alone; very long texts are read in pieces that overlap, so they count like others; a run
    of more than MOST_WORD characters without white space is several words; repeated rows
    score alike; an empty table gives no rows; a kept column named score is an error.
    """
    names = distinct(keep, "score")
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in documents.select(*names).schema)
    broadcast = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(*names, *([] if column in names else [column]))
    return rows.mapInArrow(_scored(broadcast, column, names), f"{fields}score double")
