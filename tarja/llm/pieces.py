"""Operator 4: encoding and decoding with a vocabulary of scored pieces.

An Aho-Corasick automaton over the pieces reads a text once; at each position the pieces that end
there come up along the output links, the longest first, and relax the best score of a
segmentation up to that position (Viterbi). The result is the segmentation of greatest total score;
of equal ones, the one whose last piece is longest, and so on to the left. A character that no
piece covers costs the lowest score less ten and becomes its bytes' pieces.

The model file gives pieces, scores and text normalisation. Where no piece crosses the start
of a word (checked on loading), words are segmented one by one and a bounded dictionary keeps the
commonest; otherwise a text is one word. All work is by row: no shuffle, and no state but the
dictionary, so a lost executor costs its rows only.

A null text is encoded as an empty one and decodes to one. Texts of any length are encoded whole. A
literal U+2581 decodes to a space, as the format has it, and ``round_trip`` then is false. Repeated
rows, null ids and extra columns pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import limit_batches, table

SPACE = "▁"
#: Words kept with their pieces in one Python worker, and the longest that are kept.
KEPT, LONGEST = 300_000, 48


class PieceCodec:
    def __init__(self, path: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        usable = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        self.pieces = [model.id_to_piece(i) for i in ids]
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in ids if model.is_byte(i)}
        self.id_bytes = {i: b for b, i in self.byte_ids.items()}
        self.unknown_id = model.unk_id()
        scores = {i: model.get_score(i) for i in usable}
        self.unknown = min(scores.values()) - 10.0
        self.automaton = ahocorasick.Automaton()
        for i in usable:
            self.automaton.add_word(self.pieces[i], (i, len(self.pieces[i]), scores[i]))
        self.automaton.make_automaton()
        by_word = not any(re.search(f"[^{SPACE}]{SPACE}", self.pieces[i]) for i in usable)
        self.words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if by_word else "(?s).+").findall
        self.prefixed = self.decode_raw([i for i in self.viterbi(model.normalize("a"))]).startswith(" ")
        self.known: dict[str, bytes] = {}

    def viterbi(self, word: str) -> list[int]:
        n = len(word)
        best = [float("-inf")] * (n + 1)
        best[0] = 0.0
        back: list[tuple[int, int]] = [(-1, 0)] * (n + 1)
        single, done, unknown = -1, 0, self.unknown
        for end, (i, size, score) in self.automaton.iter(word):
            while done < end:  # positions behind this one are final
                if single != done and best[done] + unknown > best[done + 1]:
                    best[done + 1], back[done + 1] = best[done] + unknown, (-1, 1)
                done += 1
            if size == 1:
                single = end
            total = best[end + 1 - size] + score
            if total > best[end + 1]:
                best[end + 1], back[end + 1] = total, (i, size)
        while done < n:
            if single != done and best[done] + unknown > best[done + 1]:
                best[done + 1], back[done + 1] = best[done] + unknown, (-1, 1)
            done += 1
        out: list[int] = []
        while n:
            i, size = back[n]
            n -= size
            if i >= 0:
                out.append(i)
            else:
                out.extend(self.byte_ids.get(b, self.unknown_id) for b in reversed(word[n].encode("utf-8")))
        return out[::-1]

    def _pieces(self, word: str) -> bytes:
        found = np.array(self.viterbi(word), dtype="<i4").tobytes()
        if len(word) <= LONGEST:
            if len(self.known) >= KEPT:
                self.known.clear()
            self.known[word] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        known, new = self.known, self._pieces
        return np.frombuffer(b"".join([known.get(w) or new(w) for w in self.words(self.model.normalize(text))]), dtype="<i4")

    def decode_raw(self, ids: list[int]) -> str:
        if self.id_bytes.keys().isdisjoint(ids):
            return "".join([self.pieces[i] for i in ids]).replace(SPACE, " ")
        out = b"".join(bytes([self.id_bytes[i]]) if i in self.id_bytes else self.pieces[i].replace(SPACE, " ").encode("utf-8") for i in ids)
        return out.decode("utf-8", errors="replace")

    def decode(self, ids: list[int]) -> str:
        text = self.decode_raw(ids)
        return text[1:] if self.prefixed and text.startswith(" ") else text


@cache
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def _coded(path: str):
    def run(batches):
        own = codec(path)
        for b in batches:
            texts = b.column("text").fill_null("")
            for a in range(0, len(texts), 256):
                part = texts.slice(a, 256).to_pylist()
                ids = [own.encode(t) for t in part]
                back = [own.decode(x.tolist()) for x in ids]
                size = [len(x) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").slice(a, 256),
                        pa.array(size, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(np.concatenate(ids) if ids else [], pa.int32())),
                        pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in back], pa.string()),
                        pa.array([t == o for t, o in zip(part, back, strict=True)], pa.bool_()),
                    ],
                    ["doc_id", "n_pieces", "ids", "decoded_sha256", "round_trip"],
                )

    return run


def encode_pieces(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_pieces, ids, decoded_sha256, round_trip) for every row: the piece ids of the
    text, the digest of their decoding, and whether that is the text. See the module."""
    limit_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(_coded(model), "doc_id long, n_pieces long, ids array<int>, decoded_sha256 string, round_trip boolean")


def decode_pieces(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids give null."""

    def run(batches):
        own = codec(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([None if x is None else own.decode(x) for x in b.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"), model_path())
