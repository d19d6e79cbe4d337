"""SentencePiece (merge type) encoding by a table of last tokens, and decoding."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cairnfield.llm._common import distinct, small

SPACE = "▁"
#: Entries of a worker's memory of encoded words in each of two generations, and of tested
#: pairs. What is forgotten is worked out anew. Longer words aren't remembered.
MEMORY, MEMORY_CHARS, PAIRS = 200_000, 64, 400_000
OUT_BYTES = 1 << 23
NEVER = float("-inf")


def load(path: str) -> dict:
    """What the encoder needs of a model file: pieces, scores and kinds, in plain types.

    Only merge-type models with the identity normaliser, a dummy prefix, escaped white
    space, byte fallback and no piece with a space after another character are taken; the
    last is what lets words be encoded on their own.
    """
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    spec, trained = model.normalizer_spec, model.trainer_spec
    ok = trained.model_type == 2 and trained.byte_fallback and not trained.treat_whitespace_as_suffix
    if not ok or spec.precompiled_charsmap or not spec.add_dummy_prefix or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
        raise ValueError(f"{path}: not a merge-type model with byte fallback and an identity normaliser")
    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    normal = {p.piece: (i, p.score) for i, p in enumerate(model.pieces) if p.type == 1}
    if any(p.type in (4, 5) for p in model.pieces) or any(SPACE in p.lstrip(SPACE) for p in normal):
        raise ValueError(f"{path}: user-defined or unused pieces, or pieces with a space inside, aren't supported")
    return {
        "pieces": normal,
        "bytes": {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == 6},
        "control": sorted(i for i, p in enumerate(model.pieces) if p.type in (2, 3)),
        "eos": processor.eos_id(),
    }


def merge(text: str, pieces: dict[str, tuple[int, float]]) -> list[str]:
    """Merging by definition: the best-scored neighbours first, the left ones among equals."""
    symbols = list(text)
    scores = [_score(pieces, a + b) for a, b in pairwise(symbols)]
    while scores and (best := max(scores)) > NEVER:
        at = scores.index(best)
        symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        del scores[at]
        if at:
            scores[at - 1] = _score(pieces, symbols[at - 1] + symbols[at])
        if at < len(scores):
            scores[at] = _score(pieces, symbols[at] + symbols[at + 1])
    return symbols


def _score(pieces: dict[str, tuple[int, float]], text: str) -> float:
    return pieces[text][1] if text in pieces else NEVER


class Encoder:
    """Encodes word by word with a table of each prefix's last token.

    The tokens of a text end in a token t, and those before it are the tokens of the text
    without t, as no merge ever crosses a final boundary. So each prefix has one last
    token: the match ending there that is compatible with the last token of the prefix
    before it, that is, the pair's text is merged back into that pair. The table is filled
    left to right from an automaton's matches and read backwards.
    """

    def __init__(self, model: dict):
        import ahocorasick

        self.pieces, self.bytes, self.eos = model["pieces"], model["bytes"], model["eos"]
        self.matches = ahocorasick.Automaton()
        self.texts, self.sizes, self.ids, self.decoded, self.numbers = [""], [0], [b""], [""], {}
        for piece, (number, _) in self.pieces.items():
            self.matches.add_word(piece, self._token(piece, [number], piece.replace(SPACE, " ")))
        self.matches.make_automaton()
        self.fits: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.newline = self._coded("\n")

    def _test(self, pair: int) -> bool:
        """Whether the pair's right token may follow the left one; at a text's start the
        left one is 0 and the right one has to be whole."""
        if len(self.fits) >= PAIRS:
            self.fits.clear()
        before, token = self.texts[pair >> 32], self.texts[pair & 0xFFFFFFFF]
        found = self.fits[pair] = merge(before + token, self.pieces) == ([before, token] if before else [token])
        return found

    def tokens(self, text: str) -> list[int]:
        """The tokens of ``text``, as numbers of this encoder's lists."""
        fits, test, size = self.fits.get, self._test, self.sizes
        last = [0] * (len(text) + 1)
        done = 0
        for end, token in self.matches.iter(text):
            if end < done:
                continue  # this prefix has its last token
            while done < end:
                done += 1
                if not last[done]:
                    last[done] = self._own(text[done - 1])
            pair = last[end + 1 - size[token]] << 32 | token
            if (fit := fits(pair)) is None:
                fit = test(pair)
            if fit:
                done = end + 1
                last[done] = token
        for k in range(done + 1, len(last)):
            last[k] = last[k] or self._own(text[k - 1])
        out, at = [], len(text)
        while at:
            out.append(last[at])
            at -= size[last[at]]
        return out[::-1]

    def _token(self, text: str, ids: list[int], decoded: str) -> int:
        self.texts.append(text)
        self.sizes.append(len(text))
        self.ids.append(np.array(ids, np.int32).tobytes())
        self.decoded.append(decoded)
        return len(self.texts) - 1

    def _own(self, character: str) -> int:
        """A token's number for a character without a piece, which falls back to bytes."""
        if (found := self.numbers.get(character)) is None:
            found = self.numbers[character] = self._token(character, [self.bytes[b] for b in character.encode()], character)
        return found

    def _coded(self, text: str) -> tuple[bytes, str]:
        """Ids as int32 bytes, and the text they decode to."""
        tokens = self.tokens(text)
        return b"".join([self.ids[t] for t in tokens]), "".join([self.decoded[t] for t in tokens])

    def word(self, text: str, prefix: str = SPACE) -> bytes:
        """Ids of a word after ``prefix``, which decode to it and to the prefix as a space.
        Frequent words survive the change of generations."""
        key = text if prefix else "\n" + text
        found = self.older.pop(key, None)
        if found is None:
            found, decoded = self._coded(prefix + text)
            if decoded != prefix.replace(SPACE, " ") + text:
                raise ValueError(f"the pieces of {text!r} don't decode to it")
        if len(key) <= MEMORY_CHARS:
            if len(self.known) >= MEMORY:
                self.older = dict(self.known)
                self.known.clear()
            self.known[key] = found
        return found

    def encode(self, text: str, end: bool = True) -> tuple[bytes, str]:
        """Ids of ``text`` as int32 bytes, and what they decode to."""
        known, word, last = self.known, self.word, np.int32(self.eos).tobytes() * end
        if not text:
            return last, ""
        if SPACE not in text and "  " not in text and " \n" not in text and "\n " not in text and text[0] != " " and text[-1] != " ":
            parts = []
            for k, line in enumerate(text.split("\n")):
                head, *rest = line.split(" ")
                if k:
                    parts.append(self.newline[0])
                    if head:
                        parts.append(known.get("\n" + head) or word(head, ""))
                else:
                    parts.append(known.get(head) or word(head))
                parts += [known.get(w) or word(w) for w in rest]
            # each word's ids were seen to decode to it, so all of them decode to the text
            return b"".join(parts) + last, text
        spaced = re.findall(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+", SPACE + text.replace(" ", SPACE))
        coded = [self._coded(x) for x in spaced]
        decoded = "".join([c[1] for c in coded])
        return b"".join([c[0] for c in coded]) + last, decoded[1:] if decoded[:1] == " " else decoded


def _encoding(model, column: str, names: list[str]) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = model.value
        encoder = held.get("encoder") or held.setdefault("encoder", Encoder(held))  # stays with the worker
        for batch in small(batches, column):
            at, size, ids, texts = 0, 0, [], []
            column_in = batch.column(column)
            for k in range(len(batch)):
                coded, decoded = encoder.encode(column_in[k].as_py() or "")
                ids.append(coded)
                texts.append(decoded)
                size += len(coded) + len(decoded)
                if size >= OUT_BYTES or k + 1 == len(batch):
                    offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32)
                    arrays = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), np.int32))), pa.array(texts, pa.string())]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, len(ids)) for c in names), *arrays], names=[*names, "ids", "decoded"])
                    at, size, ids, texts = k + 1, 0, [], []

    return run


def encode(documents: DataFrame, model_path: str, keep: Iterable[str] = ("doc_id",), column: str = "text") -> DataFrame:
    """The columns ``keep`` with ``ids array<int>`` and ``decoded string``.

    ``ids`` are the model's ids of the whole text followed by the end id; ``decoded`` is
    what they decode to. The model's pieces are broadcast: their number is fixed.

    Defined cases: null and empty texts give the end id alone and decode to the empty
    text; characters without a piece fall back to bytes; runs of spaces, leading and
    trailing spaces and the space mark itself follow the model's rules; rows are
    independent, so repeated rows give repeated results; an empty table gives no rows; kept
    columns with the names of new ones are an error.
    """
    names = distinct(keep, "ids", "decoded")
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in documents.select(*names).schema)
    model = documents.sparkSession.sparkContext.broadcast(load(model_path))
    return documents.select(*names, *([] if column in names else [column])).mapInArrow(_encoding(model, column, names), f"{fields}ids array<int>, decoded string")
