"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes, and how often over the whole corpus.

Both tokenizers encode space + text. Where both have a token's end at one byte the text is cut, so each group holds the
least tokens of both that cover the same bytes; a token of A and a token of B are linked where their bytes overlap.

Documents go through the tokenizers in chunks of bounded size. A chunk keeps its distinct linked pairs of ids, how often each
occurs, and for each document its links as places in that list, packed. The pairs' counts are summed in dense matrices:
B ids are dealt to ``STRIPES`` stripes, a task adds the counts of all chunks to the block of its stripe (B ids of the stripe x A
ids) with ``np.add.at``, and the row maxima tell the best A id of each B id. Scores then go back to the chunks: the pairs of
chunks and the scored pairs meet stripe by stripe, in groups of at most ``MEETING`` chunks, so neither a frequent id nor the size
of the corpus makes a group large; a chunk gets as many scores as it has distinct pairs, and adds them up by document.

Defined results: null and empty texts, and texts whose tokens of A or B don't spell space + text (such as those with the piece
model's own space sign), have no tokens: all numbers are 0 and the digest is empty; strings of special tokens are plain text; equal
texts, repeated rows and null keys are rows of their own; ties for the highest count are all best; an empty table gives
an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import Scratch, partitions
from driftline.llm.tokens import Encoder, Pool, byte_letters

#: Bytes of text and documents of a chunk (about; one document at least).
CHUNK_BYTES = 2 << 20
CHUNK_ROWS = 20_000
#: Stripes of B ids.
STRIPES = 512
#: Chunks whose pairs meet the scored pairs of a stripe in one group.
MEETING = 256
#: Units of text whose ids of either kind a worker keeps; it starts anew beyond them. A worker has both tables, so they are smaller
#: than that of the operators with one tokenizer.
UNITS = 200_000
#: Bits of an A id in a pair's code.
BITS = 20
_MASK = (1 << BITS) - 1

CHUNKS = "chunk long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, codes binary, counts binary, links binary"
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _spaced(texts: pa.Array) -> pa.Array:
    """Space + text."""
    return pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))


class Bytes:
    """The bytes of every id of a vocabulary: all one after the other, and where each begins."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def spell(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, one after the other."""
        sizes = self.sizes[ids]
        at = np.repeat(self.starts[ids] - (np.cumsum(sizes) - sizes), sizes)
        at += np.arange(len(at))
        return self.flat[at]


class Pieces:
    """Encodes with a sentencepiece BPE model; one for each worker process and file.

    No piece of the model has its space sign behind another character or a line feed beside one (this is checked), so merges never
    cross the borders before such spaces and around line feeds, and each distinct unit between borders is encoded once.
    """

    _made: dict[str, Pieces] = {}

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        if any("\u2581" in n.lstrip("\u2581") or "\n" in n for n in names):
            raise ValueError("a piece crosses the borders of words")
        spelt = [bytes([int(n[3:-1], 16)]) if self.model.is_byte(i) else b"" if self.model.is_control(i) or self.model.is_unknown(i) else n.replace("\u2581", " ").encode() for i, n in enumerate(names)]
        self.bytes = Bytes(spelt)
        self.feed = self.model.encode("\n")[-1]
        self._start()

    def _start(self) -> None:
        self.units = Pool()
        self.units.put("", [])
        self.units.put("\n", [self.feed])

    @classmethod
    def of(cls, path: str) -> Pieces:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _learn(self, units: list[str]) -> None:
        """Encodes distinct units, many at once: a line feed is a byte piece of its own and keeps them, and the space that the model
        puts first, apart. A unit that isn't spelt as it is, such as one with the model's own space sign, gets place -1."""
        self.units.update((u, -1) for u in units if "\u2581" in u)
        units = [u for u in units if "\u2581" not in u]
        for i in range(0, len(units), 4096):
            part = units[i : i + 4096]
            whole = "\n" + "\n".join(part)
            ids = np.array(self.model.encode(whole, num_threads=1), "<u4")
            if self.bytes.spell(ids).tobytes() == b" " + whole.encode():
                ends = np.cumsum([2, *[len(u.encode()) + 1 for u in part]])  # bytes up to the line feed behind each
                borders = np.searchsorted(np.cumsum(self.bytes.sizes[ids]), ends)
                self.units.put_all(part, ids, borders[:-1] + 1, borders[1:] - borders[:-1] - 1)
                continue
            for unit in part:
                own = np.array(self.model.encode("\n" + unit, num_threads=1)[2:], "<u4")
                if self.bytes.spell(own).tobytes() == unit.encode():
                    self.units.put(unit, own.tolist())
                else:
                    self.units[unit] = -1

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids one after the other, number of ids of each text, whether they spell it) of space + text."""
        if len(self.units) > UNITS:
            self._start()
        marked = pc.replace_substring_regex(_spaced(texts), r"([^ \n]+|\n)", "\\1\x00")
        # A unit is its spaces and what follows them; spaces before a line feed, or at the end, are a unit too.
        marked = pc.replace_substring_regex(marked, r"( )\n", "\\1\x00\n")
        lists = pc.split_pattern(marked, "\x00")
        offsets = np.asarray(lists.offsets, np.int64)
        offsets = offsets - offsets[0]
        coded = lists.flatten().dictionary_encode()
        units = coded.dictionary.to_pylist()
        if new := [u for u in units if u not in self.units]:
            self._learn(new)
        places = np.fromiter(map(self.units.__getitem__, units), np.int64, len(units))[np.asarray(coded.indices)]
        bad = np.concatenate([[0], np.cumsum(places < 0)])
        ids, ends = self.units.gather(np.where(places < 0, 0, places))
        marks = np.concatenate([[0], ends])[offsets]
        return ids, np.diff(marks), np.diff(bad[offsets]) == 0


class Aligner:
    """Both tokenizers of a worker."""

    def __init__(self, a: str, b: str):
        self.a, self.b = Encoder.of(a, special=False), Pieces.of(b)
        self.a.least = UNITS
        letters = {c: k for k, c in enumerate(byte_letters())}
        size = self.a.tokenizer.get_vocab_size()
        spelt = [b""] * size
        for token, at in self.a.tokenizer.get_vocab().items():
            if all(c in letters for c in token):
                spelt[at] = bytes([letters[c] for c in token])
        self.a_bytes = Bytes(spelt)
        # Decimal ids with the sign that follows: "," within a side, "|" after the last of A, ";" after the last of B.
        self.ids = max(size, len(self.b.bytes.sizes))
        written = [str(i).encode() + sign for sign in (b",", b"|", b";") for i in range(self.ids)]
        self.written, self.widths = np.array(written), np.array([len(x) for x in written])

    def chunk(self, number: int, keys: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        """The row of CHUNKS for some documents."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        rows, spaced = len(texts), _spaced(texts)
        sizes = np.asarray(pc.binary_length(spaced), np.int64)
        own = np.asarray(pc.binary_length(texts)) > 0
        a_ids = self.a.encode(spaced)
        n_a = np.array([len(x) for x in a_ids], np.int64)
        a = np.concatenate(a_ids).astype(np.int64) if rows else np.zeros(0, np.int64)
        b, n_b, own = self._pieces(texts, own)
        # Byte-level tokens spell any text, so their bytes are as many as the text's; pieces were compared unit by unit.
        own &= _sums(self.a_bytes.sizes[a], n_a) == sizes
        a, b = a[np.repeat(own, n_a)], b[np.repeat(own, n_b)].astype(np.int64)
        n_a, n_b = np.where(own, n_a, 0), np.where(own, n_b, 0)
        # Marks at the bytes where tokens end; every document's end is an end of both.
        a_ends, b_ends, doc_ends = np.cumsum(self.a_bytes.sizes[a]), np.cumsum(self.b.bytes.sizes[b]), np.cumsum(np.where(own, sizes, 0))
        ends = np.zeros((2, int(doc_ends[-1] if rows else 0) + 1), bool)
        ends[0, a_ends] = ends[1, b_ends] = True
        before = np.cumsum(ends, 1, dtype=np.int32)
        every = np.flatnonzero(ends[0] | ends[1])
        codes = b[before[1, every] - ends[1, every]] << BITS | a[before[0, every] - ends[0, every]]
        distinct, links, counts = _dealt(codes)
        n_links = np.diff(np.searchsorted(every, doc_ends, side="right"), prepend=0)
        digests, n_groups = self._digests(a, b, a_ends, b_ends, doc_ends, ends, before, n_a + n_b)
        columns = [
            pa.array([number]), _one(keys), *[_one(pa.array(v)) for v in (n_a, n_b, n_groups, n_links)], _one(pa.array(digests, pa.string())),
            pa.array([_packed(distinct)], pa.binary()), pa.array([_packed(counts)], pa.binary()), pa.array([_sorted_runs(links, n_links)], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in CHUNKS.split(", ")])

    def _pieces(self, texts: pa.Array, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(piece ids one after the other, how many a text has, whether they spell it) of texts that are ``own``."""
        # A NUL parts units, so texts that have one go through the model whole.
        odd = np.asarray(pc.match_substring(texts, "\x00"))
        if not odd.any():
            ids, n, spelt = self.b.encode(texts)
            return ids, n, own & spelt
        ids, n, spelt = self.b.encode(pc.if_else(pa.array(odd), pa.scalar("", pa.large_string()), texts))
        parts, own = np.split(ids, np.cumsum(n)[:-1]), own & spelt
        for i in np.flatnonzero(odd).tolist():
            parts[i] = np.array(self.b.model.encode(texts[i].as_py(), num_threads=1), "<u4")
            own[i] = self.b.bytes.spell(parts[i]).tobytes() == b" " + texts[i].as_py().encode()
        return np.concatenate(parts), np.array([len(x) for x in parts], np.int64), own

    def _digests(self, a, b, a_ends, b_ends, doc_ends, ends, before, n) -> tuple[list[str], np.ndarray]:
        """The digest of each document's groups as text, and the number of its groups."""
        both = ends[0] & ends[1]
        cuts, group = np.flatnonzero(both), np.cumsum(both, dtype=np.int32)
        a_group, b_group = group[a_ends] - both[a_ends], group[b_ends] - both[b_ends]
        # In writing, a token of A stands behind the tokens of B of earlier groups, one of B behind those of A up to its own group.
        begins = np.concatenate([[0], cuts[:-1]]).astype(np.int64)
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + before[1, begins[a_group]]] = a + np.where(both[a_ends], self.ids, 0)
        codes[np.arange(len(b)) + before[0, cuts[b_group]]] = b + np.where(both[b_ends], 2 * self.ids, 0)
        text = self.written[codes].tobytes().replace(b"\0", b"")
        marks = np.concatenate([[0], np.cumsum(_sums(self.widths[codes], n))]).tolist()
        # The last sign of a document is no part of the text.
        digests = [hashlib.sha256(text[p : q - 1]).hexdigest() if q > p else "" for p, q in zip(marks, marks[1:], strict=False)]
        return digests, np.diff(group[doc_ends], prepend=0)


def _sums(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of runs of ``n`` values."""
    ends = np.cumsum(n)
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[ends] - sums[ends - n]


def _one(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _dealt(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct codes by stripe and value, the place of each code among them, and how often each occurs."""
    coded = pa.array(code).dictionary_encode()
    found, places = coded.dictionary.to_numpy(), coded.indices.to_numpy()
    order = np.lexsort((found, (found >> BITS) % STRIPES))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    links = rank[places]
    return found[order], links, np.bincount(links, minlength=len(order))


def _packed(values: np.ndarray) -> bytes:
    return zstandard.compress(values.astype("<i8").tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw), "<i8")


def _sorted_runs(links: np.ndarray, n_links: np.ndarray) -> bytes:
    """Links of each document in rising order as differences, all low bytes first, packed: their order within a document doesn't count."""
    doc = np.repeat(np.arange(len(n_links)), n_links)
    key = np.sort(doc << 32 | links) & 0xFFFFFFFF
    first = np.cumsum(n_links)[:-1][n_links[1:] > 0]
    steps = np.diff(key, prepend=0)
    steps[first] = key[first]
    return zstandard.compress(steps.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _runs(raw: bytes, n_links: np.ndarray) -> np.ndarray:
    steps = np.ascontiguousarray(np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
    sums = np.cumsum(steps)
    starts = np.cumsum(n_links) - n_links
    some = n_links > 0
    before = np.where(starts[some] > 0, sums[starts[some] - 1], 0) if len(sums) else np.zeros(0, np.int64)
    return sums - np.repeat(before, n_links[some])


def chunks(documents: DataFrame, a: str, b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """CHUNKS of all documents under tokenizers ``a`` (a byte-level BPE file) and ``b`` (a sentencepiece model)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner, number = Aligner(a, b), TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = rows = 0

        def out() -> pa.RecordBatch:
            keys, texts = (pa.concat_arrays([h.column(c) for h in held]) for c in (0, 1))
            made = aligner.chunk(number, keys, texts)
            pa.default_memory_pool().release_unused()  # what a chunk needed is not kept beside the next worker's
            return made

        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            at = 0
            while at < batch.num_rows:
                room = max(CHUNK_BYTES - size, 1)
                n = int(min(max(np.searchsorted(np.cumsum(sizes[at:]), room, side="left") + 1, 1), batch.num_rows - at, CHUNK_ROWS - rows))
                held.append(batch.slice(at, n))
                size, rows, at = size + int(sizes[at : at + n].sum()), rows + n, at + n
                if size >= CHUNK_BYTES or rows >= CHUNK_ROWS:
                    yield out()
                    number, held, size, rows = number + 1, [], 0, 0
        if held:
            yield out()

    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("body"))
    return rows.mapInArrow(run, CHUNKS)


def _asked(made: DataFrame) -> DataFrame:
    """(stripe, chunk, codes, counts): the distinct pairs of every chunk, parted by stripe; values are eight bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, codes, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                codes, counts = _unpacked(codes), _unpacked(counts)
                stripes, at = np.unique((codes >> BITS) % STRIPES, return_index=True)
                marks = pa.py_buffer((8 * np.append(at, len(codes))).astype(np.int32))
                parts = [pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, marks, pa.py_buffer(np.ascontiguousarray(v))]) for v in (codes, counts)]
                yield pa.RecordBatch.from_arrays([pa.array(stripes.astype(np.int32)), pa.array(np.full(len(at), chunk)), *parts], ["stripe", "chunk", "codes", "counts"])

    return made.select("chunk", "codes", "counts").mapInArrow(run, "stripe int, chunk long, codes binary, counts binary")


def _values(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8")


def scored(made: DataFrame, a_size: int, b_size: int) -> DataFrame:
    """(stripe, codes, counts, best): the linked pairs of each stripe, how often each is linked, and whether that is the most of its B id."""
    names = ["stripe", "codes", "counts", "best"]

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripe = key[0].as_py()
        block = np.zeros((-(-(b_size - stripe) // STRIPES), a_size), np.int64)
        for batch in batches:
            codes = _values(batch.column(batch.schema.get_field_index("codes")))
            np.add.at(block, ((codes >> BITS) // STRIPES, codes & _MASK), _values(batch.column(batch.schema.get_field_index("counts"))))
        most = block.max(1)
        own, a = np.nonzero(block)
        counts = block[own, a]
        codes = (own * STRIPES + stripe) << BITS | a
        yield pa.RecordBatch.from_arrays([pa.array([stripe], pa.int32()), *[pa.array([v.tobytes()], pa.binary()) for v in (codes, counts, counts == most[own])]], names)

    return _asked(made).groupBy("stripe").applyInArrow(run, "stripe int, codes binary, counts binary, best binary")


def pair_counts(scores: DataFrame) -> DataFrame:
    """(a_id, b_id, count, best) of every linked pair, from :func:`scored`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = _values(batch.column(0))
            best = np.frombuffer(b"".join(batch.column(2).to_pylist()), bool)
            yield pa.RecordBatch.from_arrays([pa.array(codes & _MASK), pa.array(codes >> BITS), pa.array(_values(batch.column(1))), pa.array(best)], ["a_id", "b_id", "count", "best"])

    return scores.select("codes", "counts", "best").mapInArrow(run, "a_id long, b_id long, count long, best boolean")


def _answered(made: DataFrame, scores: DataFrame, n_chunks: int) -> DataFrame:
    """(stripe, chunk, counts, best): scores for the pairs of every chunk in their own order."""
    parts = -(-n_chunks // MEETING)
    here = _asked(made).select("stripe", F.pmod(F.xxhash64("chunk"), F.lit(parts)).cast("int").alias("part"), "chunk", "codes")
    there = scores.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        known, counts = (_values(right.column(c).combine_chunks()) for c in ("codes", "counts"))
        best = np.frombuffer(b"".join(right.column("best").to_pylist()), np.uint8)
        at = [np.searchsorted(known, np.frombuffer(c, "<i8")) for c in left.column("codes").to_pylist()]
        columns = [left.column("stripe"), left.column("chunk"), pa.array([counts[i].tobytes() for i in at], pa.binary()), pa.array([best[i].tobytes() for i in at], pa.binary())]
        return pa.table(columns, names=["stripe", "chunk", "counts", "best"])

    return here.groupBy("stripe", "part").cogroup(there.groupBy("stripe", "part")).applyInArrow(run, "stripe int, chunk long, counts binary, best binary")


def align(documents: DataFrame, a: str, b: str, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(ALIGNED of every document, (a_id, b_id, count, best) of every linked pair)."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "alignment")
    aligner = Aligner(a, b)  # for the sizes of both vocabularies
    made = scratch.write("chunks", chunks(documents, a, b, key, text))
    n_chunks = made.count()
    scores = scratch.write("scores", scored(made, len(aligner.a_bytes.sizes), len(aligner.b.bytes.sizes)))
    if not n_chunks:
        return spark.createDataFrame([], ALIGNED), pair_counts(scores)
    answers = _answered(made, scores, n_chunks).groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("stripe", "counts", "best"))).alias("answers"))
    full = made.drop("codes", "counts").join(answers.select("chunk", "answers.counts", "answers.best"), "chunk", "left")
    names = [c.split()[0] for c in ALIGNED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                lists = {n: batch.column(n)[i].values for n in ("doc_ids", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
                n_links = np.asarray(lists["n_links"], np.int64)
                links = _runs(batch.column("links")[i].as_py(), n_links)
                counts = np.frombuffer(b"".join(batch.column("counts")[i].as_py() or []), "<i8")
                best = np.frombuffer(b"".join(batch.column("best")[i].as_py() or []), np.uint8)
                ends = np.cumsum(n_links)
                sums = (np.concatenate([[0], np.cumsum(v[links].astype(np.int64))]) for v in (best, counts))
                n_best, count_sum = (s[ends] - s[ends - n_links] for s in sums)
                columns = [lists["doc_ids"], lists["n_a"], lists["n_b"], lists["n_groups"], lists["n_links"], pa.array(n_best), pa.array(count_sum), lists["groups_sha256"]]
                yield pa.RecordBatch.from_arrays(columns, names)

    return full.repartition(max(partitions(spark), min(n_chunks, 4096)), "chunk").mapInArrow(run, ALIGNED), pair_counts(scores)
