"""Language identification by compression.

Each language has a zstandard raw-content dictionary of its labelled texts. A text is reduced to its letters, in lower
case, cut into blocks, and every block is compressed with each dictionary; the language with the smallest total wins.
A relative lead over the runner-up below ``margin`` counts as narrow and rejects the text.

Defined results: null texts and texts without a letter give ``und`` with score 0 and are rejected; ties go to the
language that sorts first; repeated rows get equal results; an empty table gives an empty table; without any labelled
language every text is ``und``. Columns of the input stay, except that the four result columns replace clashing ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of labelled text in one language's dictionary, and about how many labelled rows are read for it.
DICTIONARY_BYTES = 112_640
ROWS_PER_LANGUAGE = 200
LEVEL = 5
BLOCK = 512
#: zstandard's frame header and block header without content size or checksum: no information about the text.
FRAME_BYTES = 6
#: Leads under this share of the smallest size are narrow.
MARGIN = 0.004
MAX_LANGUAGES = 200

RESULT = ("lang_pred", "score", "margin", "rejected")

_OTHER = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    return f" {_OTHER.sub(' ', text.lower())} ".encode()


@dataclass
class CompressionClassifier:
    """``dictionaries`` maps a language to its raw content."""

    dictionaries: dict[str, bytes]
    margin: float = MARGIN

    @classmethod
    def fit(cls, labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows_per_language: int = ROWS_PER_LANGUAGE, dictionary_bytes: int = DICTIONARY_BYTES, margin: float = MARGIN) -> CompressionClassifier:
        """Fits on about ``rows_per_language`` labelled rows of each language, chosen by a hash of ``key``."""
        have = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
        counts = {r[0]: r[1] for r in have.groupBy(F.col(lang)).count().limit(MAX_LANGUAGES + 1).collect()}
        if len(counts) > MAX_LANGUAGES:
            raise ValueError(f"over {MAX_LANGUAGES} languages")
        if not counts:
            return cls({}, margin)
        place = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1 << 30))
        share = F.coalesce(*[F.when(F.col(lang) == k, F.lit(min(1.0, rows_per_language / n))) for k, n in sorted(counts.items())])

        @F.pandas_udf("array<binary>")
        def blocks(texts: pd.Series) -> pd.Series:
            return pd.Series([[raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)] for raw in map(letters, texts)])

        # Blocks of the whole texts compete by a hash for the room of a dictionary, so no text fills it by its length.
        cut = have.where(place < share * (1 << 30)).select(F.col(lang).alias("l"), place.alias("p"), F.posexplode(blocks(F.col(text))).alias("k", "b"))
        own = Window.partitionBy("l").orderBy(F.xxhash64("p", "k"), "p", "k", "b")
        taken = cut.select("l", "b", F.sum(F.length("b")).over(own).alias("end"), F.row_number().over(own).alias("at")).where(F.col("end") - F.length("b") < dictionary_bytes)
        out = dict.fromkeys(sorted(counts), b"")
        for r in sorted(taken.collect(), key=lambda r: (r["l"], r["at"])):  # no more than a dictionary for each language
            out[r["l"]] += bytes(r["b"])
        return cls({k: v[:dictionary_bytes].ljust(8) for k, v in out.items()}, margin)

    def _compressors(self) -> list[tuple[str, object]]:
        import zstandard as z

        out = []
        for name, content in self.dictionaries.items():
            settings = z.ZstdCompressionParameters.from_level(LEVEL, source_size=len(content), write_content_size=False, write_checksum=False)
            own = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(compression_params=settings)
            out.append((name, z.ZstdCompressor(compression_params=settings, dict_data=own)))
        return out

    def score(self, text: str | None, compressors: list | None = None) -> tuple[str, float, float, bool]:
        """(language, score, margin, rejected) of one text."""
        if text is None or not self.dictionaries or not any(c.isalpha() for c in text):
            return "und", 0.0, 0.0, True
        raw = letters(text)
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        sizes = []
        for name, c in compressors or self._compressors():
            squeeze = c.compress
            sizes.append((sum(len(squeeze(b)) - FRAME_BYTES for b in blocks), name))
        sizes.sort()
        lead = 1.0 if len(sizes) == 1 else (sizes[1][0] - sizes[0][0]) / max(1, sizes[0][0])
        return sizes[0][1], 1 / (1 + 2.718281828459045 ** (-40 * lead)), lead, lead < self.margin

    def transform(self, df: DataFrame, text: str = "text") -> DataFrame:
        """Adds lang_pred, score, margin and rejected for every whole text."""
        model = self

        @F.pandas_udf("lang_pred string, score double, margin double, rejected boolean")
        def identify(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            own = model._compressors()
            for batch in texts:
                yield pd.DataFrame([model.score(t, own) for t in batch], columns=list(RESULT))

        out = df.select(*[c for c in df.columns if c not in RESULT], identify(F.col(text)).alias("_lid"))
        return out.select("*", *[F.col(f"_lid.{c}").alias(c) for c in RESULT]).drop("_lid")


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2


def classifier(documents: DataFrame) -> CompressionClassifier:
    """The classifier of query and pipeline: it learns from rows that aren't held out."""
    return CompressionClassifier.fit(documents.where(~held_out()))
