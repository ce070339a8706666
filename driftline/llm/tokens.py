"""Token ids of whole texts by the tokenizers library, with a bounded cache of pre-tokens.

A byte-level BPE never merges across a pre-token. So a batch of texts is parted into pre-tokens in Arrow, the distinct
ones are looked up or encoded once by the library's BPE model, and ids are gathered by numpy. Texts with characters
whose class isn't sure go through the library in chunks that begin at single spaces (a pre-token always begins at a
space between two characters that are not white space); texts with a special token, or with such characters and longer
runs of white space, go through it as a whole.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Strings that a worker's cache holds at most; a full one starts anew.
CACHE = 700_000
#: Bytes of text that are encoded at once.
SLICE = 8 << 20
#: Chunks of a text with strange characters that are looked up at once.
CHUNKS = 500

#: Ranges of characters that have been letters since early versions of Unicode, and signs that have been punctuation.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏЀ-ҁぁ-ゖァ-ヺ一-龥가-힣"
SIGNS = "¡§«»¿‐-―‘-‟…"
_SPACE = r"\t-\r "
_STRANGE = rf"[^{_SPACE}!-~{LETTERS}{SIGNS}]"
#: The byte-level pre-tokens of plain text (RE2), but for the last of several white spaces, which belongs to what follows it.
_PIECE = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^{_SPACE}\x00{LETTERS}0-9]+|[{_SPACE}]+"
_LAST = rf"([{_SPACE}])([{_SPACE}][^{_SPACE}])"
#: White space behind a space, or before a last space.
_WHITE = "[\t-\r \x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_RUN = re.compile(rf" {_WHITE}|{_WHITE} \Z")


def byte_letters() -> list[str]:
    """The letter that byte-level BPE writes for each byte: printable ones for themselves, others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Pool(dict):
    """Where the ids of a string stand in a pool: first place * 2^24 + number."""

    def __init__(self) -> None:
        self.pool = array("I")

    def put(self, text: str, ids: list[int]) -> None:
        self[text] = len(self.pool) << 24 | len(ids)
        self.pool.extend(ids)

    def put_all(self, texts: list[str], ids: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> None:
        """Strings whose ids are runs of ``ids``."""
        places = (starts + len(self.pool)) << 24 | counts
        self.pool.frombytes(ids.astype("<u4", copy=False).tobytes())
        self.update(zip(texts, places.tolist(), strict=True))

    def gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids at places, one after the other, and where those of each place end."""
        starts, counts = places >> 24, places & 0xFFFFFF
        ends = np.cumsum(counts)
        at = np.repeat(starts - (ends - counts), counts)
        at += np.arange(len(at))
        return np.frombuffer(self.pool, "<u4")[at], ends


class _Ids(Pool):
    """Ids of pre-tokens; learns them when they are asked for."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer = tokenizer
        self.letters = dict(enumerate(byte_letters()))
        self.opens = np.zeros(tokenizer.get_vocab_size(), bool)  # ids of tokens that begin with a space
        for token, at in tokenizer.get_vocab().items():
            self.opens[at] = token.startswith("\u0120")
        self[""] = 0

    def _learn(self, pieces: list[str]) -> None:
        """Encodes distinct pre-tokens. Those that begin with a space go through the library many at once: a pre-token each."""
        behind = [p for p in pieces if p[0] == " " and not p[1:2].isspace() and len(p) > 1]
        for i in range(0, len(behind), 4096):
            part = behind[i : i + 4096]
            (made,) = self.tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)
            ids = np.array(made.ids, dtype="<u4")
            at = np.flatnonzero(self.opens[ids])
            if len(at) != len(part):
                raise AssertionError("a pre-token without a token of its own")
            self.put_all(part, ids, at, np.diff(at, append=len(ids)))
        tokenize = self.tokenizer.model.tokenize
        for piece in pieces:
            if piece not in self:
                self.put(piece, [t.id for t in tokenize(piece.encode().decode("latin-1").translate(self.letters))])

    def places(self, pieces: list[str]) -> np.ndarray:
        """Places of distinct pre-tokens."""
        if new := [p for p in pieces if p not in self]:
            self._learn(new)
        return np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))


class Encoder:
    """Encodes texts to uint32 ids; one for each worker process and vocabulary file. Without ``special``, strings of special
    tokens in texts are ordinary text."""

    _made: dict[tuple[str, bool], Encoder] = {}

    def __init__(self, path: str, special: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        pre, model = self.tokenizer.pre_tokenizer, self.tokenizer.model
        self.tokenizer.encode_special_tokens = not special
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        known = self.tokenizer.get_vocab()
        self.parted = (
            isinstance(pre, pre_tokenizers.ByteLevel) and not pre.add_prefix_space and pre.use_regex and self.tokenizer.normalizer is None
            and isinstance(model, models.BPE) and not model.dropout and not model.continuing_subword_prefix and not model.end_of_word_suffix
            and all(x in known for x in byte_letters())
        )
        self.ids, self.least = _Ids(self.tokenizer), None

    @classmethod
    def of(cls, path: str, special: bool = True) -> Encoder:
        if (path, special) not in cls._made:
            cls._made[path, special] = cls(path, special)
        return cls._made[path, special]

    def cache(self) -> int:
        """Strings that the table holds at most: CACHE, or ``least`` where a worker has other tables too."""
        return CACHE if self.least is None else min(self.least, CACHE)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids if text else [], "<u4")

    def _plain(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of texts without strange characters or special tokens."""
        if len(self.ids) > self.cache():
            self.ids = _Ids(self.tokenizer)
        texts = pc.replace_substring_regex(texts, _LAST, "\\1\x00\\2")
        lists = pc.split_pattern(pc.replace_substring_regex(texts, _PIECE, "\\0\x00"), "\x00")
        offsets = np.asarray(lists.offsets, np.int64)
        coded = lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        ids, ends = self.ids.gather(self.ids.places(pieces)[np.asarray(coded.indices)])
        marks = np.concatenate([[0], ends])[offsets - offsets[0]].tolist()
        return [ids[a:b] for a, b in zip(marks, marks[1:], strict=False)]

    def _strange(self, text: str) -> np.ndarray:
        """Ids of a text with characters whose class isn't sure."""
        if _RUN.search(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        chunks, out = [first, *[f" {w}" for w in rest]], []
        for at in range(0, len(chunks), CHUNKS):
            own = chunks[at : at + CHUNKS]
            new = [c for c in dict.fromkeys(own) if c not in self.ids]
            if len(self.ids) + len(new) > self.cache():
                self.ids, new = _Ids(self.tokenizer), list(dict.fromkeys(own))
            for i in range(0, len(new), 1024):
                part = new[i : i + 1024]
                for chunk, made in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                    self.ids.put(chunk, made.ids)
            out.append(self.ids.gather(np.fromiter(map(self.ids.__getitem__, own), np.int64, len(own)))[0])
        return np.concatenate(out)

    def encode(self, texts: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
        """uint32 ids of each whole text; none for null."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.parted:
            return [self.whole(t) for t in texts.to_pylist()]
        special = np.zeros(len(texts), bool)
        for s in self.specials:
            special |= np.asarray(pc.match_substring(texts, s))
        strange = np.asarray(pc.match_substring_regex(texts, _STRANGE)) & ~special
        out: list = [None] * len(texts)
        for i in np.flatnonzero(special).tolist():
            out[i] = self.whole(texts[i].as_py())
        for i in np.flatnonzero(strange).tolist():
            out[i] = self._strange(texts[i].as_py())
        plain = np.flatnonzero(~special & ~strange)
        if len(plain):
            slices = np.cumsum(np.asarray(pc.binary_length(texts))[plain]) // SLICE
            for own in np.split(plain, np.flatnonzero(np.diff(slices)) + 1):
                for i, ids in zip(own.tolist(), self._plain(texts.take(pa.array(own))), strict=True):
                    out[i] = ids
        return out

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian uint32 ids of each whole text; none for None."""
        return [ids.tobytes() for ids in self.encode(pa.array(texts, pa.large_string()))]
