"""Token ids by the tokenizers library, each distinct piece of text encoded once per task.

Both vocabularies split a text before they merge, and never across the edges used here, so the ids of a text are
those of its pieces in a row: byte-level BPE before every run of white space and before the last character of one, word-level BPE, which drops white space, at every blank or line end. Texts
with characters that regular-expression libraries class differently are encoded whole and not remembered; what is remembered is bounded by its bytes.
"""

from __future__ import annotations

import os
import re

import numpy as np

_ODD = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
_BLANK = re.compile(r"[\s\x1c-\x1f\x85\u180e\u200b-\u200d\u2060\ufeff]")
#: A run of white space but for its last character, what follows a run together with that, white space at the end.
_RUNS = re.compile(r"[ \n\t\r\x0b\x0c]+(?=[ \n\t\r\x0b\x0c][^ \n\t\r\x0b\x0c])|[ \n\t\r\x0b\x0c]?[^ \n\t\r\x0b\x0c]+|[ \n\t\r\x0b\x0c]+")
_WHITE = " \n\t\r\x0b\x0c"
_NONE = np.empty(0, np.uint32)
#: What a piece takes besides its characters and ids: entries of the index and of the arrays.
PIECE_BYTES = 180


def odd(text: str) -> bool:
    """Whether a text has to be encoded whole. Plain searches settle most texts."""
    if text.isascii():
        return "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text
    return _ODD.search(text) is not None


def in_runs(text: str) -> bool:
    """Whether white space comes in runs or is other than blanks and line ends."""
    return "  " in text or "\n\n" in text or " \n" in text or "\n " in text or "\t" in text or "\r" in text or "\x0b" in text or "\x0c" in text


class _Numbered(dict):
    """Numbers keys in the order they are first asked for; ``new`` has those without ids so far."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.new.append(key)
        return n


class PieceEncoder:
    """Encodes texts; remembers pieces up to ``most`` bytes, besides those of one call, those met again longest."""

    def __init__(self, path: str, byte_level: bool, most: int = 96 << 20) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task per core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.byte_level, self.most = byte_level, most
        self._reset()

    def _reset(self) -> None:
        self.index, self.held, self.used = _Numbered(), 0, 0
        self.start, self.length, self.pool, self.met = np.empty(0, np.int64), np.empty(0, np.int64), _NONE, np.empty(0, np.int64)

    def _forget(self) -> None:
        """Keep the pieces met more than once, if they take little enough."""
        keep = np.flatnonzero(self.met > 1)
        keys, start, length, pool = list(self.index), self.start[keep], self.length[keep], self.pool
        kept = [keys[n] for n in keep.tolist()]
        size = self._bytes(kept, int(length.sum()))
        self._reset()
        if size > self.most // 2:
            return
        for key in kept:
            self.index[key]
        self.index.new, self.held = [], size
        ends = np.cumsum(length)
        self.pool = pool[np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)]
        self.used = len(self.pool)
        self.start, self.length, self.met = ends - length, length, np.zeros(len(keep), np.int64)

    @staticmethod
    def _bytes(keys: list[str], ids: int) -> int:
        return sum(map(len, keys)) + PIECE_BYTES * len(keys) + 4 * ids

    def _learn(self, new: list[str]) -> None:
        """Encode pieces and remember their ids; the pool grows by half at least, so it is seldom copied."""
        ids, start, length = self._ids_of(new)
        if self.used + len(ids) > len(self.pool):
            grown = np.empty(max(self.used + len(ids), len(self.pool) * 3 // 2), np.uint32)
            grown[: self.used] = self.pool[: self.used]
            self.pool = grown
        self.pool[self.used : self.used + len(ids)] = ids
        self.start = np.concatenate([self.start, self.used + start])
        self.length = np.concatenate([self.length, length])
        self.used += len(ids)
        self.held += self._bytes(new, len(ids))

    def _whole(self, text: str) -> bool:
        return self.byte_level and (odd(text) or " \x00" in text)  # the latter looks like a marked key

    def _pieces(self, text: str) -> list[str]:
        """Keys of the pieces; a key's first character says what stands for it, see ``_text_of``."""
        if not self.byte_level:
            return text.replace("\n", " ").split(" ")
        if in_runs(text):
            return [self._key_of(piece) for piece in _RUNS.findall(text)]
        first, *rest = text.replace("\n", " \n").split(" ")
        if first:
            rest.insert(0, "\x00" + first)
        return rest

    @staticmethod
    def _key_of(piece: str) -> str:
        second = piece[1:2]
        if piece[0] == " " and (not second or second not in _WHITE):
            return piece[1:]
        return piece if piece[0] == "\n" and (not second or second not in _WHITE) else "\x00" + piece

    def _text_of(self, key: str) -> str:
        if not self.byte_level:
            return key
        if key[:1] == "\x00":
            return key[1:]
        return key if key[:1] == "\n" else " " + key

    def _ids_of(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, length) of pieces. Many go to the library in one text, with a mark between that is always a token of its own."""
        mark = "\n" if self.byte_level else "0"
        sep = mark if self.byte_level else f" {mark} "
        (mark_id,) = self.tokenizer.encode(mark, add_special_tokens=False).ids
        at, texts, lead, rest = [], [], [], []
        for n, key in enumerate(keys):
            text = self._text_of(key)
            core = text[1:] if self.byte_level and text[:1] in "\n " else text
            if core and not _BLANK.search(core) and (self.byte_level or mark not in core):
                line = self.byte_level and text[:1] == "\n"
                at.append(n)
                texts.append(core if line else text)
                lead.append(line)  # the line end before the piece is the mark itself
            else:
                rest.append(n)
        pool, lengths = [], []
        parts = [slice(i, i + 400) for i in range(0, len(texts), 400)]
        encoded = (e for i in range(0, len(parts), 16) for e in self.tokenizer.encode_batch_fast([sep.join(texts[p]) for p in parts[i : i + 16]], add_special_tokens=False))
        for part, e in zip(parts, encoded, strict=True):
            ids, leads = np.array([mark_id, *e.ids], np.uint32), np.array(lead[part])
            marks = np.flatnonzero(ids == mark_id)
            if len(marks) != len(leads):
                raise ValueError("the mark between pieces is no token of its own")
            lengths.append(np.diff(np.append(marks, len(ids))) - ~leads)
            keep = np.ones(len(ids), bool)
            keep[marks] = leads
            pool.append(ids[keep])
        for n in rest:
            pool.append(self._alone(self._text_of(keys[n])))
            lengths.append([len(pool[-1])])
        length, start, order = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64), np.array(at + rest, np.int64)
        inner = np.concatenate(lengths).astype(np.int64)
        length[order], start[order] = inner, np.cumsum(inner) - inner
        return np.concatenate(pool), start, length

    def _alone(self, text: str) -> np.ndarray:
        """Ids of one text; the library's own result takes some hundred bytes a token, so it is let go at once."""
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as unsigned 32-bit integers."""
        if self.held > self.most:
            self._forget()
        numbers, sizes, whole = [], [], {}
        get = self.index.__getitem__
        for i, text in enumerate(texts):
            if text and self._whole(text):
                whole[i] = text
            keys = self._pieces(text) if text and i not in whole else []
            numbers.append(np.fromiter(map(get, keys), np.int64, len(keys)))
            sizes.append(len(keys))
        if new := self.index.new:
            self._learn(new)
            self.index.new = []
        every = np.concatenate(numbers) if numbers else np.empty(0, np.int64)
        self.met = np.bincount(every, minlength=len(self.index)) + np.pad(self.met, (0, len(self.index) - len(self.met)))
        lengths = self.length[every]
        ends = np.cumsum(lengths)
        flat = self.pool[np.repeat(self.start[every] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)]
        edges = np.concatenate([[0], ends])[np.cumsum([0, *sizes])]
        out = [flat[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        for i, text in whole.items():
            out[i] = self._alone(text)
        return out


class _Encoders(dict):
    def __missing__(self, key: tuple[str, bool]) -> PieceEncoder:
        value = self[key] = PieceEncoder(*key)
        return value


_ENCODERS = _Encoders()


def encoder(path: str, byte_level: bool) -> PieceEncoder:
    """One per Python worker and vocabulary; what it remembers serves the worker's later tasks too."""
    return _ENCODERS[path, byte_level]
