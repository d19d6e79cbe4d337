"""Language identification with interpolated Kneser-Ney character models."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfield.llm._common import distinct, hash_below, small

UNKNOWN = "und"
ORDER = 4
#: Expected number of texts a language's model is fitted on; with fewer, all are used.
FIT_ROWS = 2000
#: Share of those texts that is kept from the counts and sets the limit of rejection.
CALIBRATION = 0.2
#: With fewer texts kept back, a language's limit comes from cross-validation in FOLDS parts.
FEW, FOLDS = 20, 5
PIECE = 1 << 19
#: Code points that a task works on at once, or one longer piece: their tables and log
#: probabilities are what a worker holds besides its input.
BLOCK = 1 << 17
BASE = 0x9E3779B97F4A7C15
#: Characters of a text whose evidence counts in its score.
SCORE_CHARS = 100


def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces of about PIECE characters, cut before white space if there is any."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and end < at + 2 * PIECE and not text[end].isspace():
            end += 1
        yield text[at:end]
        at = end


def normalised(texts: Iterable[str], is_letter: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts as code points in lower case, one space for each run of other characters than
    letters and one in front, in blocks of about BLOCK.

    For each part of a block: its text's number, its size, and how many of its code points
    only repeat the end of the text's part before, as the context of what follows; which is
    what makes a text in several parts count like one in one. Yields the code points and
    these three.
    """
    held: list[tuple[int, np.ndarray, int]] = []

    def block() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        owner, code, skip = zip(*held, strict=True)
        return np.concatenate(code), np.array(owner), np.array([*map(len, code)]), np.array(skip)

    n = 0
    for k, text in enumerate(texts):
        last = np.zeros(0, np.uint32)
        for piece in _pieces(text) if text else ("",):
            raw = np.frombuffer(((" " if not len(last) else "") + piece.lower()).encode("utf-32-le", "surrogatepass"), np.uint32)
            letter = is_letter[raw]
            keep = letter.copy()
            keep[1:] |= letter[:-1]
            if len(raw):
                keep[0] |= not len(last) or last[-1] != 32
            code = np.concatenate((last, np.where(letter, raw, 32)[keep].astype(np.uint32)))
            held.append((k, code, len(last)))
            last = code[-max(1, order - 1) :]
            n += len(code)
            if n >= BLOCK:
                yield block()
                held, n = [], 0
    if held:
        yield block()


def grams(code: np.ndarray, sizes: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the 1- to ``order``-grams that end at each place, and each place's number
    in its text; a hash whose gram would begin before its text means nothing."""
    wide = code.astype(np.uint64) + np.uint64(1)
    out, power = [wide * np.uint64(0xD6E8FEB86659FD93)], 1
    for k in range(1, order):
        power = power * BASE % (1 << 64)
        longer = out[-1].copy()
        longer[k:] += wide[: len(wide) - k] * np.uint64(power) * np.uint64(0xD6E8FEB86659FD93)
        out.append(longer)
    begin = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    return out, np.arange(len(code)) - np.repeat(begin, sizes)


def _counted(order: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_letter = letters()
        for batch in small(batches):
            by: dict[str, list[str]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                for code, _, sizes, skip in normalised(texts, is_letter, order):
                    hashes, place = grams(code, sizes, order)
                    new = place >= np.repeat(skip, sizes)
                    for k in range(order):
                        ends = np.flatnonzero((place >= k) & new)
                        found, first, count = np.unique(hashes[k][ends], return_index=True, return_counts=True)
                        at = ends[first]
                        suffix = hashes[k - 1][at] if k else np.zeros(len(at), np.uint64)
                        context = hashes[k - 1][at - 1] if k else np.zeros(len(at), np.uint64)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(found), pa.string()), pa.array(np.full(len(found), k, np.int32)), *(pa.array(x.view(np.int64)) for x in (found, suffix, context)), pa.array(count.astype(np.int64))],
                            names=["lang", "k", "gram", "suffix", "context", "n"],
                        )

    return run


def _lookup(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, keys), max(0, len(table) - 1))
    return at, (table[at] == keys) if len(table) else np.zeros(len(keys), bool)


def discount(n: np.ndarray) -> float:
    """The absolute discount that counts of one and of two call for, of one order and language."""
    once, twice = np.count_nonzero(n == 1), np.count_nonzero(n == 2)
    return min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.1


def estimate(counts, languages: list[str], order: int) -> dict:
    """Kneser-Ney tables from counts (a pandas frame lang, k, gram, suffix, context, n).

    For each k: ``grams[k]``, sorted hashes of the (k+1)-grams of any language, with
    ``logs[k]``, a row of log probabilities by language; and ``contexts[k]``, sorted hashes
    of contexts with ``weights[k]``, the log weights of the shorter context by language.
    """
    L = len(languages)
    model: dict = {"languages": languages, "grams": [], "logs": [], "contexts": [], "weights": []}
    frames = {(lang, k): f for (lang, k), f in counts.groupby(["lang", "k"])}
    u64 = lambda f, c: f[c].to_numpy(np.int64).view(np.uint64)
    alphabet = max(2, len(np.unique(np.concatenate([u64(frames[x, 0], "gram") for x in languages if (x, 0) in frames]))) + 1)
    for k in range(order):
        parts = [frames[x, k] for x in languages if (x, k) in frames]
        if not parts:
            break
        every = np.concatenate([u64(f, "gram") for f in parts])
        table, first = np.unique(every, return_index=True)
        suffix, context = (np.concatenate([u64(f, c) for f in parts])[first] for c in ("suffix", "context"))
        contexts = np.unique(context)
        p, w = np.zeros((len(table), L)), np.ones((len(contexts), L))
        for j, lang in enumerate(languages):
            if (lang, k) not in frames:
                continue
            own = frames[lang, k]
            gram, n = u64(own, "gram"), own["n"].to_numpy(np.float64)
            if k < order - 1 and (lang, k + 1) in frames:
                # continuation counts, but for grams that only begin texts
                followed, times = np.unique(u64(frames[lang, k + 1], "suffix"), return_counts=True)
                at, hit = _lookup(followed, gram)
                n = np.where(hit, times[at], 1.0)
            c, _ = _lookup(contexts, u64(own, "context"))
            total, kinds = np.bincount(c, n, len(contexts)), np.bincount(c, minlength=len(contexts))
            seen, off = total > 0, discount(n)
            w[seen, j] = np.minimum(1.0, off * kinds[seen] / total[seen])
            at, _ = _lookup(table, gram)
            p[at, j] += np.maximum(n - off, 0) / total[c]
        back, _ = _lookup(contexts, context)
        if k:
            below, _ = _lookup(model["grams"][k - 1], suffix)
            p += w[back] * np.exp(model["logs"][k - 1][below])
        else:
            p += w[back] / alphabet
        model["grams"].append(table)
        model["logs"].append(np.log(p).astype(np.float32))
        model["contexts"].append(contexts)
        model["weights"].append(np.log(w).astype(np.float32))
    model["unseen"] = (model["weights"][0][0] - np.log(alphabet)).astype(np.float32) if model["weights"] else np.zeros(L, np.float32)
    return model


def log_probabilities(model: dict, code: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row of log probabilities by language for each place."""
    order = len(model["grams"])
    hashes, place = grams(code, sizes, order)
    out = np.zeros((len(code), len(model["languages"])), np.float32)
    todo = np.arange(len(code))
    for k in range(order - 1, -1, -1):
        fit = todo[place[todo] >= k]
        rest = todo[place[todo] < k]
        at, hit = _lookup(model["grams"][k], hashes[k][fit])
        out[fit[hit]] += model["logs"][k][at[hit]]
        missed = fit[~hit]
        if k and len(missed):
            c, known = _lookup(model["contexts"][k], hashes[k - 1][missed - 1])
            out[missed[known]] += model["weights"][k][c[known]]
        elif len(missed):
            out[missed] += model["unseen"]
        todo = np.concatenate((rest, missed)) if k else todo
    return out


def cross_entropies(model: dict, texts: list[str], is_letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By text and language, nats for each code point after the first; and their number."""
    total, count = np.zeros((len(texts), len(model["languages"]))), np.zeros(len(texts))
    for code, owner, sizes, skip in normalised(texts, is_letter, len(model["grams"])):
        begin = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        logs = log_probabilities(model, code, sizes)
        skip = np.maximum(skip, 1)  # a text's first space is given
        for k in range(int(skip.max())):
            logs[(begin + k)[skip > k]] = 0
        np.subtract.at(total, owner, np.add.reduceat(logs, begin, axis=0, dtype=np.float64))
        np.add.at(count, owner, sizes - skip)
    return total / np.maximum(count, 1)[:, None], count


def counts(rows: DataFrame, order: int):
    """A pandas frame lang, k, gram, suffix, context, n of the texts of ``rows``."""
    return (
        rows.mapInArrow(_counted(order), "lang string, k int, gram long, suffix long, context long, n long")
        .groupBy("lang", "k", "gram")
        .agg(F.min("suffix").alias("suffix"), F.min("context").alias("context"), F.sum("n").alias("n"))
        .toPandas()
    )


def cross_validated(sample: DataFrame, named: Column, languages: list[str], order: int):
    """A pandas frame lang, entropy: each text's cross-entropy under the model of its
    language that was fitted on the other folds."""
    fold = F.pmod(F.xxhash64(F.lit("fold"), named), F.lit(FOLDS))
    found = []
    for k in range(FOLDS):
        counted = counts(sample.where(fold != k), order)
        if counted.empty:
            continue
        broadcast = sample.sparkSession.sparkContext.broadcast(estimate(counted, languages, order))
        found.append(sample.where(fold == k).mapInArrow(_measured(broadcast), "lang string, entropy double").toPandas())
        broadcast.unpersist()
    return pd.concat(found) if found else pd.DataFrame({"lang": [], "entropy": []})


def fit(rows: DataFrame, order: int = ORDER, fit_rows: int = FIT_ROWS) -> dict:
    """Models of all languages in ``rows`` (doc_id, text, lang; null text or lang is skipped).

    About ``fit_rows`` texts of each language, chosen by a hash of doc_id and text, are counted on
    the executors as a whole; the distinct grams of that bounded sample come to the driver.
    A share of them is kept back: the cross-entropies they get set each language's limit. A
    language with fewer than FEW of those takes its limit from cross-validation over its
    texts of the sample, or if that has none the highest limit of the others.
    """
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return {"languages": []}
    share = F.lit(0.0)
    for lang in languages:
        share = F.when(F.col("lang") == lang, min(1.1, fit_rows / sizes[lang])).otherwise(share)
    # with the text: rows without an id, or all with one, are chosen one by one too
    named = F.concat_ws(" ", F.col("doc_id").cast("string"), F.xxhash64("text").cast("string"))
    sample = rows.where(hash_below(named, share))
    kept_back = hash_below(F.concat(F.lit("limit"), named), F.lit(CALIBRATION))
    counted = counts(sample.where(~kept_back), order)
    if counted.empty:
        return {"languages": []}
    model = estimate(counted, languages, order)
    broadcast = rows.sparkSession.sparkContext.broadcast(model)
    limits = np.full(len(languages), np.inf)
    measured = sample.where(kept_back).mapInArrow(_measured(broadcast), "lang string, entropy double").toPandas()
    broadcast.unpersist()
    n_measured = measured["lang"].value_counts()
    few = [lang for lang in languages if n_measured.get(lang, 0) < FEW]
    crossed = cross_validated(sample.where(F.col("lang").isin(few)), named, few, order) if few else measured
    for j, lang in enumerate(languages):
        source = crossed if lang in few else measured
        own = source.loc[source["lang"] == lang, "entropy"].to_numpy()
        if len(own):
            middle, high = np.quantile(own, [0.5, 0.99])
            limits[j] = middle + 3 * (high - middle) + 1
    limits[np.isinf(limits)] = max(limits[np.isfinite(limits)], default=np.inf)
    return model | {"limits": limits}


def _measured(model) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_letter = letters()
        for batch in small(batches):
            langs = batch.column("lang").to_pylist()
            entropy, count = cross_entropies(model.value, batch.column("text").to_pylist(), is_letter)
            own = [model.value["languages"].index(x) for x in langs]
            keep = count > 0
            yield pa.RecordBatch.from_arrays([pa.array(np.array(langs, object)[keep].tolist(), pa.string()), pa.array(entropy[np.arange(len(langs)), own][keep])], names=["lang", "entropy"])

    return run


def _judged(model, column: str, names: list[str]) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        is_letter = m["letters"] if "letters" in m else m.setdefault("letters", letters())
        for batch in small(batches, column):
            texts = [t or "" for t in batch.column(column).to_pylist()]
            best, score, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            if m["languages"] and texts:
                entropy, count = cross_entropies(m, texts, is_letter)
                like = -entropy * np.minimum(count, SCORE_CHARS)[:, None]
                like -= like.max(axis=1, keepdims=True)
                chance = np.exp(like)
                chance /= chance.sum(axis=1, keepdims=True)
                pick = entropy.argmin(axis=1)
                rows = np.arange(len(texts))
                known = count > 0
                best = [m["languages"][j] if k else UNKNOWN for j, k in zip(pick.tolist(), known.tolist(), strict=True)]
                score = np.where(known, chance[rows, pick], 0.0)
                rejected = ~known | (entropy[rows, pick] > m["limits"][pick])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(best, pa.string()), pa.array(score), pa.array(rejected)], names=[*names, "lang_pred", "score", "rejected"])

    return run


def predict(documents: DataFrame, model: dict, keep: Iterable[str] = ("doc_id",), column: str = "text") -> DataFrame:
    """The columns ``keep`` with ``lang_pred string, score double, rejected boolean``.

    The language is the one with the lowest cross-entropy for each character of the whole
    text; ``score`` is its share of the likelihoods, of SCORE_CHARS characters at most. A text is
    rejected if it has no letter, or a cross-entropy above its language's limit.

    Defined cases: null texts and texts without a letter are ``und`` with score 0 and
    rejected, and so is everything if no language was learned; ties go to the language
    that sorts first; very long texts are read in pieces that carry their context over, so
    they count like others; repeated rows are judged alike; an empty table gives no rows;
    kept columns with the names of new ones are an error; the model's size is bounded by the
    sample it was fitted on.
    """
    names = distinct(keep, "lang_pred", "score", "rejected")
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in documents.select(*names).schema)
    broadcast = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(*names, *([] if column in names else [column]))
    return rows.mapInArrow(_judged(broadcast, column, names), f"{fields}lang_pred string, score double, rejected boolean")


def accepted(documents: DataFrame, model: dict, column: str = "text") -> DataFrame:
    """The rows of ``documents`` that aren't rejected, with the same columns."""
    others = F.struct(*[F.col(c) for c in documents.columns if c != column]).alias("others")
    judged = predict(documents.select(others, F.col(column).alias("passage")), model, ("others", "passage"), "passage")
    kept = judged.where(~F.col("rejected"))
    return kept.select(*(F.col("passage").alias(c) if c == column else F.col("others")[c].alias(c) for c in documents.columns))
