"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

The encoding of a prefix of a word ends in one token, and that token decides what comes before it: it is the one token that
ends there and is compatible with the last token of the prefix before it. So one pass over a word stores the last token of
every prefix, and back-pointers from the end give the ids. Tokens that end at a place are found by a suffix automaton of the
vocabulary: its state is the longest run of symbols up to here that is part of a token, and the tokens among its suffixes
lie along the suffix links. Two tokens are compatible where no merge across their border comes before the merges that
make the two.

Texts are normalised and parted into words as the vocabulary file says: texts of well-known letters, digits and signs by
one pattern, all others by the tokenizers library's own normaliser and pre-tokenizer; only the merging is done here.
Ids of short words are kept for the next text, in a table that starts anew when it is full.

Defined results: null and empty texts, and texts of white space only, have no tokens and decode to the empty text; strings of special tokens
in a text are these tokens; equal texts, repeated rows and null keys are rows of their own; an empty table gives an empty table;
other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.tokens import LETTERS, SIGNS, byte_letters

#: Words whose ids are kept at most, the longest word that is kept, and pairs of tokens whose test is kept at most.
WORDS = 800_000
LONGEST = 48
PAIRS = 1_000_000
#: Bytes of text that make an output batch (about).
SLICE = 4 << 20


class SuffixAutomaton:
    """All runs of symbols that are part of a pattern. ``ends`` has for each state (length, name) of the patterns among the
    suffixes of its longest run, longest first."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = []

    def _state(self, size: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.size.append(size)
        return len(self.link) - 1

    def _parted(self, p: int, symbol: int, q: int) -> int:
        """The state for the runs of ``q`` no longer than one more than ``p``'s."""
        if self.size[q] == self.size[p] + 1:
            return q
        short = self._state(self.size[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = short
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = short
            p = self.link[p]
        return short

    def _longer(self, last: int, symbol: int) -> int:
        if (q := self.next[last].get(symbol)) is not None:
            return self._parted(last, symbol, q)
        new, p = self._state(self.size[last] + 1, {}, 0), last
        while p >= 0 and symbol not in self.next[p]:
            self.next[p][symbol] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._parted(p, symbol, self.next[p][symbol])
        return new

    def build(self, patterns: dict[int, tuple[int, ...]]) -> SuffixAutomaton:
        """Takes patterns by their names, and finds where each ends."""
        for symbols in patterns.values():
            at = 0
            for s in symbols:
                at = self._longer(at, s)
        self.ends = [[] for _ in self.size]
        for name, symbols in patterns.items():
            at = 0
            for s in symbols:
                at = self.next[at][s]
            self.ends[at].append((len(symbols), name))
        for state in sorted(range(1, len(self.size)), key=self.size.__getitem__):
            self.ends[state] = sorted(self.ends[state], reverse=True) + self.ends[self.link[state]]
        return self


class Merges:
    """Merge rules by rank, and the tests that follow from them. ``base`` names the symbols."""

    def __init__(self, rules: list[tuple[int, int, int]], base: list[int]):
        self.rank = {(a, b): k for k, (a, b, _) in enumerate(rules)}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for k, (a, b, made) in enumerate(rules):
            if made in self.parts or max(self.parts.get(x, (-1,))[0] for x in (a, b)) >= k:
                raise ValueError("two merge rules make one token, or a rule comes before those of its parts")
            self.parts[made] = (k, a, b)
        #: For each token how its first (and last) symbols grew: (rank, token) of each merge at that end.
        self.left: dict[int, tuple] = {}
        self.right: dict[int, tuple] = {}
        self.symbols: dict[int, tuple[int, ...]] = {}
        for s in base:
            self.left[s] = self.right[s] = ((-1, s),)
            self.symbols[s] = (s,)
        for made, (k, a, b) in sorted(self.parts.items(), key=lambda x: x[1][0]):
            if a not in self.symbols or b not in self.symbols or not self._apart(a, b, k):
                continue  # no text leads to this token
            self.left[made] = (*self.left[a], (k, made))
            self.right[made] = (*self.right[b], (k, made))
            self.symbols[made] = self.symbols[a] + self.symbols[b]
        self.known: dict[int, bool] = {}

    def _apart(self, a: int, b: int, until: int) -> bool:
        """Whether no merge across the border of ``a`` and ``b`` ranks before ``until`` while the two are made.

        Merges go by rank, and from the left at one rank: at equal rank one within ``a`` comes before one across, and one across
        before one within ``b``.
        """
        right, left, i, j = self.right[a], self.left[b], 0, 0
        while True:
            across = self.rank.get((right[i][1], left[j][1]), until)
            grows = right[i + 1][0] if i + 1 < len(right) else until
            follows = left[j + 1][0] if j + 1 < len(left) else until
            if across < min(grows, until) and across <= follows:
                return False
            if grows <= follows and i + 1 < len(right):
                i += 1
            elif j + 1 < len(left):
                j += 1
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        """Whether ``a`` followed by ``b`` is the encoding of their text."""
        if len(self.known) >= PAIRS:
            self.known.clear()
        found = self.known[a << 32 | b] = self._apart(a, b, len(self.rank))
        return found


class Codec:
    """Encodes and decodes with a vocabulary file of the tokenizers library; one for each worker process and file."""

    _made: dict[str, Codec] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as src:
            file = json.load(src)
        model = file["model"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd or file.get("decoder"):
            raise ValueError(f"not a plain BPE vocabulary: {model['type']} with {odd}")
        vocabulary, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.letters, self.bytes = dict(enumerate(letters)), set(letters)
        missing = [c for c in letters if c not in vocabulary or c + self.suffix not in vocabulary]
        if missing:
            raise ValueError(f"bytes without a token: {missing}")
        self.within = {c: vocabulary[c] for c in letters}
        self.last = {c: vocabulary[c + self.suffix] for c in letters}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = Merges([(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs], sorted({*self.within.values(), *self.last.values()}))
        self.automaton = SuffixAutomaton().build(self.merges.symbols)
        library = Tokenizer.from_file(path)
        self.normalise = library.normalizer.normalize_str if library.normalizer else lambda text: text
        self.part = library.pre_tokenizer.pre_tokenize_str
        added = file["added_tokens"]
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that take more than their own string")
        self.special = {t["content"]: t["id"] for t in added}
        names = sorted(self.special, key=len, reverse=True)
        self.border = re.compile(f"({'|'.join(map(re.escape, names))})") if names else None
        self.tokens = [""] * (1 + max([*vocabulary.values(), *self.special.values()]))
        for token, at in (vocabulary | self.special).items():
            self.tokens[at] = token
        self.plain = self._pattern(file)
        self.words: dict[str, bytes] = {}

    @staticmethod
    def _pattern(file: dict) -> re.Pattern | None:
        """The words of plain text where the file lower-cases and parts as expected, else None."""
        # How the vocabulary file normalises and parts text.
        steps = [n["type"] for n in (file["normalizer"] or {}).get("normalizers", [])]
        split = next((p["pattern"].get("Regex") for p in (file["pre_tokenizer"] or {}).get("pretokenizers", []) if p["type"] == "Split"), None)
        if steps != ["NFC", "Replace", "Lowercase"] or split != r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+":
            return None
        return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\t-\r {LETTERS}0-9]+")

    @classmethod
    def of(cls, path: str) -> Codec:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def merge(self, word: str) -> list[int]:
        """Ids of one word, given as byte letters."""
        symbols = [self.within[c] for c in word[:-1]] + [self.last[word[-1]]]
        moves, link, lengths, ends = self.automaton.next, self.automaton.link, self.automaton.size, self.automaton.ends
        known, compatible = self.merges.known, self.merges.compatible
        state = length = 0
        tokens: list[int] = []
        sizes: list[int] = []
        for i, s in enumerate(symbols):
            # The longest run that ends here and is part of a token; every symbol is one.
            to = moves[state].get(s)
            while to is None:
                state = link[state]
                length = lengths[state]
                to = moves[state].get(s)
            state, length = to, length + 1
            for size, token in ends[state]:
                if size > length:
                    continue
                if size <= i:
                    before = tokens[i - size]
                    fits = known.get(before << 32 | token)
                    if not (compatible(before, token) if fits is None else fits):
                        continue
                tokens.append(token)
                sizes.append(size)
                break
            else:
                raise AssertionError(f"no last token for a prefix of {word!r}")
        out, at = [], len(symbols) - 1
        while at >= 0:
            out.append(tokens[at])
            at -= sizes[at]
        return out[::-1]

    def _ids(self, word: str, lettered: str | None = None) -> bytes:
        """Ids of a word, kept for the next time; its byte letters are made here unless they are given."""
        if lettered is None:  # printable ASCII stands for itself
            lettered = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        made = array("I", self.merge(lettered)).tobytes()
        if len(word) <= LONGEST:
            if len(self.words) >= WORDS:
                self.words.clear()
            self.words[word] = made
        return made

    def _piece(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        known = self.words.get
        if self.plain is not None and not _STRANGE.search(text):
            return b"".join([known(w) or self._ids(w) for w in self.plain.findall(text.lower())])
        # Words in byte letters are kept under a name that no word of plain text has.
        return b"".join([known("\0" + w) or self._ids("\0" + w, w) for w, _ in self.part(self.normalise(text))])

    def encode(self, text: str | None) -> bytes:
        """Little-endian uint32 ids of a whole text."""
        if not text:
            return b""
        if self.border is None or "<" not in text:
            return self._piece(text)
        out = []
        for piece in self.border.split(text):
            if piece in self.special:
                out.append(np.uint32(self.special[piece]).tobytes())
            elif piece:
                out.append(self._piece(piece))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The text of ids, special tokens included: without a decoder tokens stand side by side with a space between."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_STRANGE = re.compile(rf"[^\t-\r !-~{LETTERS}{SIGNS}]")


def round_trip(documents: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every whole text; ``ids`` are little-endian uint32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(vocabulary)
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)) // SLICE
            for own in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(sizes)) + 1):
                if not len(own):
                    continue
                part = batch.slice(int(own[0]), len(own))
                ids = [codec.encode(t) for t in part.column(1).to_pylist()]
                counts = pa.array([len(x) // 4 for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), counts, pa.array(ids, pa.binary()), pa.array([codec.decode(x) for x in ids], pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("body"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded string")
