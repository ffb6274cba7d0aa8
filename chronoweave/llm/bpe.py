"""Byte-level BPE encoding of whole texts with the tokenizers library.

The tokenizer's pattern always starts a new piece at a single space or line break
between two other characters. Texts are cut there; a Python worker has the library
merge each distinct piece once and remembers its ids, so a text's ids are looked
up chunk by chunk. Texts with any other white space are split by the pattern whole.
Strings of the tokenizer's special tokens stand for those tokens, as the library has
it by default; what lies between them is encoded by itself.
"""

from __future__ import annotations

import os

import numpy as np
import regex

#: Chunks that a worker remembers before it starts afresh (about 200 bytes each).
MEMO_CHUNKS = 1_000_000
#: Pieces that go to the library in one call.
PIECES_A_CALL = 64

_OTHER_SPACE = regex.compile(r"[^\S \n]")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[int, int]:
    """Byte-level BPE writes each byte as a letter: itself if printable, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: b for b in shown} | {b: 0x100 + i for i, b in enumerate(sorted(set(range(256)) - set(shown)))}


class ChunkEncoder:
    """Ids of whole texts."""

    def __init__(self, path: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self._merges = Tokenizer(self.library.model)  # the merges alone: pieces come ready split
        self._pattern = regex.compile(public_tokenizers.PATTERN)
        self._letters = _byte_letters()
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.dtype = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        #: Bytes of text behind each id.
        special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.id_bytes = np.zeros(max([*vocabulary.values(), *special.values()]) + 1, np.int64)
        for token, i in vocabulary.items():
            self.id_bytes[i] = len(token)
        for token, i in special.items():
            self.id_bytes[i] = len(token.encode())
        if len(self.id_bytes) > 1 << 16:
            self.dtype = np.dtype("<u4")
        self._special = {t: np.array([i], self.dtype).tobytes() for t, i in special.items()}
        self._special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")")
        # byte 0xFF is no part of UTF-8, so its letter can stand between pieces if nothing merges with it
        self._mark = chr(self._letters[0xFF])
        self._mark_id = vocabulary[self._mark]
        self._memo: dict[str, bytes] = {}  # by chunk, without the space before it
        self._bare: dict[str, bytes] = {}  # pieces that no space comes before
        probe = "It's 12  known,\n\nthat öther \ttexts<|endoftext|> split alike. "
        got = self.library.encode(probe, add_special_tokens=False).ids
        if any(self._mark in t for t in vocabulary if t != self._mark) or got != np.frombuffer(self.encode([probe])[0], self.dtype).tolist():
            raise ValueError(f"{path} does not split texts by the byte-level pattern")

    def _merge(self, pieces: list[str]) -> list[bytes]:
        mapped = "\x00".join(pieces).encode("utf-8", "replace").decode("latin-1")
        if mapped.count("\x00") != len(pieces) - 1:  # a zero byte inside a piece
            letters = [p.encode("utf-8", "replace").decode("latin-1").translate(self._letters) for p in pieces]
        else:
            letters = mapped.translate(self._letters).split(chr(self._letters[0]))
        joined = [self._mark.join(letters[k : k + PIECES_A_CALL]) for k in range(0, len(letters), PIECES_A_CALL)]
        ids: list[int] = []
        for e in self._merges.encode_batch_fast(joined, add_special_tokens=False):
            ids += e.ids
            ids.append(self._mark_id)
        flat = np.array(ids, self.dtype)
        ends = np.flatnonzero(flat == self._mark_id) * flat.itemsize
        data, out, start = flat.tobytes(), [], 0
        for end in ends.tolist():
            out.append(data[start:end])
            start = end + flat.itemsize
        return out

    def _learn(self, chunks: set[str], texts: list[str]) -> None:
        """Ids of new chunks (the space before them left out) and of the pieces of texts."""
        split = {c: [" " + c] if c.isalpha() else self._pattern.findall(c if c[0] == "\n" else " " + c) for c in chunks}
        pieces = {p for ps in split.values() for p in ps}
        for t in texts:
            pieces.update(self._pattern.findall(t))
        new = [p for p in pieces if self._known(p) is None]
        for p, ids in zip(new, self._merge(new) if new else [], strict=True):
            if p[0] == " " and len(p) > 1:
                self._memo[p[1:]] = ids
            else:
                self._bare[p] = ids
        for c, ps in split.items():
            if c not in self._memo:
                self._memo[c] = b"".join([self._known(p) for p in ps])

    def _known(self, piece: str) -> bytes | None:
        # "\nword" is a chunk of two pieces, never a piece, so keys do not clash
        return self._memo.get(piece[1:]) if piece[0] == " " and len(piece) > 1 else self._bare.get(piece)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each whole text as bytes of dtype; an empty text has none."""
        marked = [k for k, t in enumerate(texts) if any(x in t for x in self._special)]
        if not marked:
            return self._encode_plain(texts)
        plain = list(texts)
        parts = {k: self._special_pattern.split(texts[k]) for k in marked}
        for k in marked:
            plain[k] = ""
        out = self._encode_plain(plain)
        for k, found in parts.items():
            between = self._encode_plain(found[::2])
            ids = [between[0]]
            for token, after in zip(found[1::2], between[1:], strict=True):
                ids += [self._special[token], after]
            out[k] = b"".join(ids)
        return out

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        if len(self._memo) + len(self._bare) > MEMO_CHUNKS:
            self._memo.clear()
            self._bare.clear()
        get = self._memo.get
        parts: list[tuple] = []
        new: set[str] = set()
        whole: list[str] = []
        for text in texts:
            first, *rest = text.replace("\n", " \n").split(" ")
            if first and "" not in rest and "\n" not in rest and "\n" not in first and (text.replace("\n", "").isprintable() or not _OTHER_SPACE.search(text)):
                got = list(map(get, rest))
                if None in got:
                    new.update([c for c, g in zip(rest, got, strict=True) if g is None])
                    got = None
                parts.append((first, rest, got))
                whole.append(first)
            else:
                parts.append((text, None, None))
                whole.append(text)
        self._learn(new, whole)
        out = []
        for first, rest, got in parts:
            head = [self._known(p) for p in self._pattern.findall(first)]
            out.append(b"".join(head + (got or list(map(get, rest))) if rest else head))
        return out


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """The Python worker's encoder; it outlives a task, and its memo with it."""
    if path not in _encoders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def token_spans(ids: np.ndarray, text: str, id_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end character of each token; a token touches every character whose bytes it holds."""
    ends = np.cumsum(id_bytes[ids])
    starts = ends - id_bytes[ids]
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    if len(data) == len(text):
        return starts, ends
    char_of_byte = np.cumsum((data & 0xC0) != 0x80)
    return char_of_byte[starts] - 1, char_of_byte[ends - 1]
