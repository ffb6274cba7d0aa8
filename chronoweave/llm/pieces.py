"""SentencePiece encoding and decoding with a streaming Viterbi search.

The lattice's nodes are character boundaries, its arcs vocabulary pieces. For each
boundary the search keeps the best path's score and a backpointer to the boundary and
piece before. In a unigram model a path scores the sum of its pieces' scores. In a merge
(BPE) model a path counts only if the model's merges, run on any two neighbours
together, leave the boundary between them alone: one path is left to each boundary, the
model's own encoding of what comes before, and the search gives the library's ids.

Only a window as long as the longest piece can still be extended: whenever the
backpointer paths of all its boundaries meet in one boundary, what lies before is
final, its ids are committed and forgotten.

Pieces hold the space mark at their front alone. All paths therefore meet where a word
begins, and what the window holds is committed there; a Python worker remembers the ids
that it has committed for a word, and reads them again when the stream brings that word.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.llm.common import column_of, map_arrow, texts_of

MARK = "▁"
#: Words that a worker has seen of late and those before them, as many again; pairs of pieces (about 200 and 100 bytes each).
MEMO_WORDS = 120_000
MEMO_PAIRS = 400_000
#: Characters of texts whose words are looked up together.
CHUNK = 1 << 18

SCHEMA = "doc_id long, n_ids long, ids array<int>, round_trip boolean"

_RUNS = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self._pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        plain = [i for i in range(len(self._pieces)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self._id = {self._pieces[i]: i for i in plain}
        self._score = {self._pieces[i]: sp.get_score(i) for i in plain}
        self._longest = max(map(len, self._id), default=1)
        self._ends = {p[k:] for p in self._id for k in range(len(p))}
        self._unknown = sp.unk_id()
        self._unigram = _model_type(sp.serialized_model_proto()) == 1
        # the library's score of a character that no piece covers
        self._unknown_score = min(self._score.values(), default=0.0) - 10.0
        self._byte = {int(self._pieces[i][3:5], 16): i for i in range(len(self._pieces)) if sp.is_byte(i)}
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self._id):
            raise ValueError(f"{path} has pieces that run over a word's end")
        self._bytes = [b"" if sp.is_control(i) else b" \xe2\x81\x87 " if sp.is_unknown(i) else bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(self._pieces)]
        self._pairs: dict[int, bool] = {}  # by piece, and the piece before it (0: none) shifted
        self._words: dict[str, bytes] = {}
        self._before: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """The model's merges, best score first, leftmost on a tie."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                if (s := self._score.get(parts[i] + parts[i + 1])) is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, before: int, piece: int) -> bool:
        """Whether piece may follow before; before < 0: nothing merges across the boundary."""
        key = (before + 1 if before >= 0 else 0) << 32 | piece
        if (known := self._pairs.get(key)) is None:
            if len(self._pairs) > MEMO_PAIRS:
                self._pairs.clear()
            own = self._pieces[piece]
            left = [self._pieces[before]] if before >= 0 else []
            known = self._pairs[key] = self.merged("".join(left) + own) == [*left, own]
        return known

    def _best(self, tail: str, end: int, base: int, back: list[tuple[int, int]], scores: list[float]) -> tuple[tuple[int, int], float]:
        """The best arc to the boundary end, in a unigram model: where it starts and its piece, and the path's score."""
        best, found = scores[end - 1 - base] + self._unknown_score, (end - 1, -2 - ord(tail[-1]))
        for n in range(1, len(tail) + 1):
            last = tail[-n:]
            if last not in self._ends:
                break
            if (piece := self._id.get(last)) is not None:
                score = scores[end - n - base] + self._score[last]
                if score >= best or n == 1:  # of equal paths, the one whose last piece is the longest
                    best, found = score, (end - n, piece)
        return found, best

    def _only(self, tail: str, end: int, base: int, back: list[tuple[int, int]]) -> tuple[int, int]:
        """The one arc to the boundary end that a merge model allows."""
        ends, ids_of, pairs = self._ends, self._id, self._pairs
        for n in range(1, len(tail) + 1):
            last = tail[-n:]
            if last not in ends:
                break
            if (piece := ids_of.get(last)) is not None:
                before = back[end - n - base][1]
                if (fits := pairs.get((before + 1 if before >= 0 else 0) << 32 | piece)) is None:
                    fits = self._fits(before, piece)
                if fits:
                    return end - n, piece
        return end - 1, -2 - ord(tail[-1])

    def search(self, text: Iterator[str]) -> Iterator[int]:
        """Ids of a stream of characters, spaces as marks; committed as soon as they are final.

        Unknown characters give their bytes, or one unknown id a run in a model without bytes.
        """
        before = -1
        for piece in self._stream(text):
            if piece != self._unknown or before != piece:
                yield piece
            before = piece

    def _stream(self, text: Iterator[str]) -> Iterator[int]:
        """The search itself: holds a window of a few piece lengths, however long the stream is, unless the model leaves more open.
        """
        back: list[tuple[int, int]] = [(-1, -1)]  # from boundary base on: previous boundary, piece
        scores: list[float] = [0.0]
        base, end, tail = 0, 0, ""
        longest = self._longest
        due = 2 * longest
        self.widest = 0
        for char in text:
            tail = (tail + char)[-longest:]
            end += 1
            if self._unigram:
                arc, score = self._best(tail, end, base, back, scores)
                scores.append(score)
            else:
                arc = self._only(tail, end, base, back)
            back.append(arc)
            if end - base >= due:
                self.widest = max(self.widest, end - base)
                meet, ids = self._settled(back, base, end)
                if meet > base:
                    yield from ids
                    back, scores = back[meet - base :], scores[meet - base :]
                    base = meet
                due = end - base + longest
        yield from self._path(back, base, end)

    def _settled(self, back: list[tuple[int, int]], base: int, end: int) -> tuple[int, list[int]]:
        """The boundary that the paths of all open boundaries share, and the ids before it."""
        open_ = set(range(max(base, end - self._longest), end + 1))
        while len(open_) > 1:
            last = max(open_)
            open_.remove(last)
            open_.add(max(back[last - base][0], base))
        meet = open_.pop()
        return meet, list(self._path(back, base, meet))

    def _path(self, back: list[tuple[int, int]], base: int, end: int) -> Iterator[int]:
        steps = []
        while end > base:
            before, piece = back[end - base]
            steps.append(piece)
            end = before
        for piece in reversed(steps):
            if piece >= 0:
                yield piece
            elif self._byte:
                yield from (self._byte[b] for b in chr(-2 - piece).encode("utf-8", "replace"))
            else:
                yield self._unknown

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text, committed word by word; an empty text has none."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each whole text; texts of CHUNK characters together, or one longer text, are searched at once."""
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            end, held = at, 0
            while end < len(texts) and (end == at or held + len(texts[end]) <= CHUNK):
                held += len(texts[end])
                end += 1
            split = [_RUNS.findall((MARK + t).replace(" ", MARK)) if t else [] for t in texts[at:end]]
            ids = self._words_of(set().union(*split))
            out += [np.frombuffer(b"".join(map(ids.__getitem__, words)), np.int32) for words in split]
            at = end
        return out

    def _words_of(self, words: set[str]) -> dict[str, bytes]:
        """Ids of different words; those met of late are remembered, and words met often outlive the others."""
        found, new = {}, []
        for word in words:
            if (ids := self._words.get(word)) is None and (ids := self._before.get(word)) is None:
                new.append(word)
            else:
                found[word] = ids
        short = not self._unigram
        found.update(self._searched(sorted(w for w in new if short and len(w) < 2 * self._longest)))
        found.update((w, np.fromiter(self.search(iter(w)), np.int32).tobytes()) for w in new if w not in found)
        for word, ids in found.items():
            if word not in self._words:
                if len(self._words) >= MEMO_WORDS:
                    self._before, self._words = self._words, {}
                self._words[word] = ids
        return found

    def _searched(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """The search over words that the window holds whole: no path is committed before its end.

        Arcs to the boundaries of a word's beginning are those of the word before it, as far as
        both begin alike; in order, words share much.
        """
        ends, id_of, fits_of, longest = self._ends, self._id.get, self._pairs.get, self._longest
        # by boundary: where the arc to it starts, its piece, and the key of pairs with that piece on the left
        starts, pieces, left, before = [0], [-1], [0], ""
        for word in words:
            n, same = len(word), 0
            for x, y in zip(word, before):  # noqa: B905
                if x != y:
                    break
                same += 1
            del starts[same + 1 :], pieces[same + 1 :], left[same + 1 :]
            for end in range(same + 1, n + 1):
                arc, own, key = end - 1, -2, 0
                for start in range(end - 1, max(end - longest, 0) - 1, -1):
                    last = word[start:end]
                    if last not in ends:
                        break
                    if (piece := id_of(last)) is not None:
                        fits = fits_of(left[start] | piece)
                        if fits or fits is None and self._fits(pieces[start], piece):
                            arc, own, key = start, piece, piece + 1 << 32
                            break
                starts.append(arc)
                pieces.append(own)
                left.append(key)
            before = word
            ids: list[int] = []
            end = n
            while end:
                piece = pieces[end]
                if piece >= 0:
                    ids.append(piece)
                elif self._byte:
                    ids.extend(self._byte[b] for b in reversed(word[end - 1].encode("utf-8", "replace")))
                elif not ids or ids[-1] != self._unknown:
                    ids.append(self._unknown)
                end = starts[end]
            ids.reverse()
            yield word, array("i", ids).tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: bytes joined, marks as spaces, the mark at the front left out."""
        text = b"".join(map(self._bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _model_type(proto: bytes) -> int:
    """The trainer's model type in a serialised model: 1 unigram, 2 merges (fields 2 and 3 of the public format)."""

    def fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
        at = 0

        def number() -> int:
            nonlocal at
            value, shift = 0, 0
            while True:
                byte = data[at]
                at += 1
                value |= (byte & 0x7F) << shift
                if byte < 0x80:
                    return value
                shift += 7

        while at < len(data):
            key = number()
            kind = key & 7
            if kind == 0:
                yield key >> 3, number()
            else:
                n = number() if kind == 2 else 8 if kind == 1 else 4
                yield key >> 3, data[at : at + n]
                at += n

    trainer = next((value for field, value in fields(proto) if field == 2), b"")
    return next((value for field, value in fields(trainer) if field == 3), 1)


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode_pieces(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text, and whether decoding them gives the text back.

    Null and empty texts have no ids and round_trip true. A text that itself holds the
    space mark decodes to a space there: round_trip false. Rows repeat if they repeat in
    docs; null ids stay null; other columns, of any name, are not read. No shuffle.
    """
    model_path = model_path or default_model()

    def encode(batch: pa.RecordBatch) -> pa.RecordBatch:
        m, texts = model(model_path), texts_of(batch)
        ids = m.encode_all(texts)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(np.concatenate(ids)))
        return pa.record_batch([column_of(batch, "doc_id"), pa.array(lengths), lists, pa.array([m.decode(i) == t for i, t in zip(ids, texts, strict=True)])], ["doc_id", "n_ids", "ids", "round_trip"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), encode, SCHEMA)


def decode_pieces(encoded: DataFrame, model_path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts of id lists: doc_id, text. A null or empty list gives the empty text."""
    model_path = model_path or default_model()

    def decode(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = model(model_path)
        return pa.record_batch([column_of(batch, "doc_id"), pa.array([m.decode(np.array(i or [], np.int32)) for i in column_of(batch, "ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return map_arrow(encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")), decode, "doc_id long, text string")
