"""SentencePiece encoding and decoding by a forward pass over a trie of distinct words.

A text becomes marked words (blanks are the mark U+2581, and one mark leads the text). The distinct words of a block are
sorted, which lists their trie depth first: each word takes over the forward states of the prefix it shares with the word
before and goes on from there. A unigram model keeps the best score of each prefix (Viterbi). In a BPE model a piece may
follow another only if merging their joined text gives back these two; exactly one such path covers a prefix, so
the pass gives the merge result of the whole word without merging it.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytewise as bw

MARK = "▁"
UNIT = re.compile(f"\\n|{MARK}+[^{MARK}\\n]*|[^{MARK}\\n]+")
#: Entries of a worker's tables of piece pairs and trie steps, and of each half of its words; results do not depend on them.
CACHE, WORDS = 250_000, 150_000
#: Bytes of text whose distinct words are encoded together.
BLOCK_BYTES = 2 << 20
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: list[float]
    normal: list[bool]
    byte_ids: list[int]  # by byte value; empty without byte fallback
    unknown: int
    bpe: bool

    @staticmethod
    def load(path: str) -> Vocabulary:
        """Vocabulary of a model file (read on the driver; its size bounds what is sent to the tasks)."""
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) for i in range(n)]
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        has_bytes = all(sp.is_byte(i) for i in byte_ids)
        return Vocabulary([sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)], [not s for s in special],
                          byte_ids if has_bytes else [], sp.unk_id(), proto.trainer_spec.model_type == 2)


class Encoder:
    """Forward states along the current trie path; position i holds the state of the first i characters."""

    def __init__(self, vocab: Vocabulary):
        self.v = vocab
        self.ids = {p: i for i, (p, ok) in enumerate(zip(vocab.pieces, vocab.normal, strict=True)) if ok and p}
        self.pairs: dict[int, bool] = {}
        if vocab.bpe:  # pieces that merging never gives are of no use
            self.ids = {p: i for p, i in self.ids.items() if len(p) == 1 or self._merged(p) == [p]}
        #: Beginnings of pieces. The longest one that a prefix of the word ends with tells which pieces end there.
        self.heads = {p[:k] for p in self.ids for k in range(len(p) + 1)}
        self.steps: dict[str, tuple[str, tuple[tuple[int, int], ...]]] = {}
        self.floor = min(vocab.scores, default=0.0) - 10
        self.word, self.state, self.start, self.last, self.score = "", [""], [0], [-1], [0.0]

    def _step(self, x: str) -> tuple[str, tuple[tuple[int, int], ...]]:
        """From a beginning and one more character: the longest beginning that this ends with, and the (length, id) of
        the pieces that end here, longest first."""
        if len(self.steps) > CACHE:
            self.steps.clear()
        head = x
        while head not in self.heads:
            head = head[1:]
        ends = tuple((len(head) - k, self.ids[head[k:]]) for k in range(len(head)) if head[k:] in self.ids)
        self.steps[x] = head, ends
        return head, ends

    def _merged(self, text: str) -> list[str]:
        parts, ids, scores = list(text), self.ids, self.v.scores
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or scores[i] > best):
                    best, at = scores[i], k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _fits(self, a: int, b: int) -> bool:
        """Whether merging the joined text of two pieces gives these two."""
        if len(self.pairs) > CACHE:
            self.pairs.clear()
        x, y = self.v.pieces[a], self.v.pieces[b]
        ok = self.pairs[a << 32 | b] = self._merged(x + y) == [x, y]
        return ok

    def _forward(self, word: str, k: int) -> None:
        """States of all prefixes longer than ``k`` characters, each from those of shorter ones."""
        steps, pairs, start, last, score, state, v = self.steps, self.pairs, self.start, self.last, self.score, self.state, self.v
        head = state[k]
        for i in range(k, len(word)):
            x = head + word[i]
            found = steps.get(x)
            head, ends = found if found is not None else self._step(x)
            state.append(head)
            best, at, by = self.floor + (0.0 if v.bpe else score[i]), i, -1  # a character of no piece stands alone
            if v.bpe:
                for n, t in ends:
                    j = i + 1 - n
                    a = last[j]
                    ok = not j or a < 0 or pairs.get(a << 32 | t)
                    if ok or (ok is None and self._fits(a, t)):
                        at, by = j, t
                        break
            else:
                for n, t in ends:
                    if (s := score[i + 1 - n] + v.scores[t]) > best:
                        best, at, by = s, i + 1 - n, t
                score.append(best)
            start.append(at)
            last.append(by)

    def encode(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of each of the sorted distinct words."""
        out = {}
        for word in words:
            prev = self.word
            k = 0
            for x, y in zip(prev, word, strict=False):
                if x != y:
                    break
                k += 1
            del self.start[k + 1 :], self.last[k + 1 :], self.state[k + 1 :], self.score[k + 1 :]
            self.word = word
            self._forward(word, k)
            ids, i = [], len(word)
            while i:
                j, t = self.start[i], self.last[i]
                if t >= 0:
                    ids.append(t)
                elif self.v.byte_ids:
                    ids.extend(self.v.byte_ids[b] for b in reversed(word[j:i].encode()))
                else:
                    ids.append(self.v.unknown)
                i = j
            out[word] = ids[::-1]
        return out


class Decoder:
    def __init__(self, vocab: Vocabulary):
        self.bytes = [p.replace(MARK, " ").encode() if ok else b"" for p, ok in zip(vocab.pieces, vocab.normal, strict=True)]
        for b, i in enumerate(vocab.byte_ids):
            self.bytes[i] = bytes([b])

    def raw(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def plain(self, raw: bytes) -> str:
        """Text of decoded bytes, without the leading blank of the first mark."""
        out = raw.decode("utf-8", "replace")
        return out[1:] if out[:1] == " " else out

    def text(self, ids) -> str:
        return self.plain(self.raw(ids))


class _Words:
    """Ids of the words of one worker, and the words that do not decode to themselves.

    Words not met since the younger half was last full are dropped, so common ones stay. Tasks of one worker go on
    with the tables of the task before.
    """

    kept: tuple | None = None  # the broadcast vocabulary, and the tables made from it

    def __init__(self, vocab: Vocabulary):
        self.coder, self.decoder = Encoder(vocab), Decoder(vocab)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.changed: set[str] = set()

    @classmethod
    def of(cls, shared):
        if cls.kept is None or cls.kept[0] is not shared:
            cls.kept = shared, cls(shared.value)
        return cls.kept[1]

    @classmethod
    def drop(cls) -> None:
        cls.kept = None

    def table(self, units: list[list[str]]) -> dict[str, bytes]:
        """Ids of all words of a block of texts; new ones are encoded together, and decoded again."""
        if len(self.young) > WORDS:
            self.old, self.young = self.young, {}
        words = set().union(*units).difference(self.young)
        for w in words & self.old.keys():
            self.young[w] = self.old[w]
        for w, found in self.coder.encode(sorted(words.difference(self.young))).items():
            self.young[w] = array("i", found).tobytes()
            if self.decoder.raw(found) != w.replace(MARK, " ").encode():
                self.changed.add(w)
        return self.young


bw.KEPT.append(_Words.drop)


def encode(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_pieces, ids, round_trip) per row of ``docs``.

    Null text is read as empty and has no pieces. ``round_trip`` says whether decoding gives the text again (it does not where
    the text holds the mark itself). Rows are encoded one by one, repeated rows alike; other columns are ignored, and an
    empty table gives no rows. A very long word costs time and memory in proportion to its length.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))

    def run(batches):
        words = _Words.of(shared)
        for batch in batches:
            ids = batch.column(0)
            _, at = bw.flat(batch.column(1))
            for i, j in bw.pieces(at, BLOCK_BYTES):
                texts = batch.column(1).slice(i, j - i).to_pylist()
                units = [UNIT.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
                known, changed = words.table(units), words.changed
                codes = [b"".join(map(known.__getitem__, u)) for u in units]
                # decoded words put together are the text, but for the mark in front and marks of the text itself
                good = [not t or (MARK not in t and (not changed or changed.isdisjoint(u))) for t, u in zip(texts, units, strict=True)]
                size = np.cumsum([0, *(len(c) // 4 for c in codes)])
                values = pa.array(np.frombuffer(b"".join(codes), np.int32))
                yield pa.record_batch([ids.slice(i, j - i), pa.array(np.diff(size), pa.int64()),
                                       pa.ListArray.from_arrays(pa.array(size, pa.int32()), values), pa.array(good, pa.bool_())],
                                      names=["id", "n_pieces", "ids", "round_trip"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(id_col, text_col).mapInArrow(bw.released(run, keep=True), f"id {kind}, n_pieces long, ids array<int>, round_trip boolean")
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model: str = MODEL, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``encoded`` with the decoded text; null ids give null."""
    from pyspark.sql.functions import pandas_udf
    from pyspark.sql.types import StringType

    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(model))

    @pandas_udf(StringType())
    def text(ids: pd.Series) -> pd.Series:
        d = Decoder(shared.value)
        return ids.map(lambda x: None if x is None else d.text(x))

    return encoded.withColumn(text_col, text(F.col(ids_col)))
