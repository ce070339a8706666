"""Quality rules: a table of thresholds compiled into one Spark projection.

``measures`` are columns made by built-in functions of a whole text; ``RULES`` bounds ratios of them; ``apply`` adds
``failed`` (names of the rules a document breaks, in table order) and ``kept``.

Defined results: null and empty texts have zeros everywhere and break the rules on least lengths; ratios with a zero
denominator are 0; repeated rows get equal results; identifiers aren't read; result columns replace clashing ones of the input.
Word windows are compared by 64-bit hashes: two different ones of a text of n words count as equal with odds of n^2 / 2^65 at most,
1 in 10^10 at 60,000 words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Function words of the supported languages.
STOP_WORDS = (
    "the of and to in is that it for was on are with as be by this at from or an "
    "der die das und ist in den von zu mit sich auf für nicht ein eine auch dem im "
    "le la les de et un une du des en est que qui dans pour par sur au plus il "
    "el los las y en un una que por con para del se su al es lo como más"
).split()

SPACE = r"[\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Rule:
    """``value`` / ``over`` has to lie in [low, high]; ``over`` None: the value itself."""

    name: str
    value: str
    over: str | None = None
    low: float | None = None
    high: float | None = None


#: The threshold table.
RULES = (
    Rule("words", "n_words", low=50, high=1_000_000),
    Rule("word_length", "word_chars", "n_words", low=2.0, high=15.0),
    Rule("symbols", "n_symbols", "n_words", high=0.5),
    Rule("stop_words", "n_stop_words", low=2),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=0.5),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", high=0.5),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", high=0.9),
    Rule("repeated_words", "n_repeat_words", "n_words", high=0.5),
)

#: Measures of a text, in the order of their columns.
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_ellipsis_lines", "n_bullet_lines")


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds MEASURES, all long."""
    taken = {*MEASURES, "failed", "kept", "_t", "_w", "_l", "_h", "_s", "_p"}
    base = df.select(*[F.col(c) for c in df.columns if c not in taken - {text}], F.coalesce(F.col(text), F.lit("")).alias("_t"))
    split = base.withColumn("_w", F.expr(rf"filter(split(_t, '{SPACE}'), w -> w <> '')".replace("\\", "\\\\")))
    split = split.withColumn("_l", F.expr(r"filter(split(_t, '\n'), l -> l rlike '[^\x20\x09-\x0D]')".replace("\\", "\\\\")))
    # One hash for each 3-word window; a window that occurs again shows as equal neighbours once (hash, place) is sorted.
    windows = "if(size(_w) < 3, cast(array() as array<bigint>), transform(sequence(0, size(_w) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])))"
    hashed = split.withColumn("_h", F.expr(windows))
    again = "if(size(array_distinct(_h)) = size(_h), cast(array() as array<struct<h: bigint, i: int>>), array_sort(transform(_h, (h, i) -> named_struct('h', h, 'i', i))))"
    ordered = hashed.withColumn("_s", F.expr(again))
    repeated = "filter(_s, (x, i) -> (i > 0 and _s[i - 1].h = x.h) or (i + 1 < size(_s) and _s[i + 1].h = x.h))"
    placed = ordered.withColumn("_p", F.expr(f"if(size(_s) = 0, cast(array() as array<int>), array_sort(transform({repeated}, x -> x.i)))"))
    # Every place covers three words, fewer where the next place begins before its end.
    covered = "if(size(_p) = 0, 0L, aggregate(_p, named_struct('n', 0L, 'end', 0), (a, p) -> named_struct('n', a.n + cast(p + 3 - greatest(p, a.end) as bigint), 'end', p + 3), a -> a.n))"
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    exprs = {
        "n_words": "cast(size(_w) as bigint)",
        "word_chars": "cast(length(array_join(_w, '')) as bigint)",
        "n_symbols": "cast(length(_t) - length(translate(_t, '#*$%&|<>', '')) as bigint)",
        "n_dup_lines": "cast(size(_l) - size(array_distinct(_l)) as bigint)",
        "n_repeat_words": covered,
        "n_lines": "cast(size(_l) as bigint)",
        "n_stop_words": f"cast(size(filter(_w, w -> lower(w) in ({stops}))) as bigint)",
        "n_ellipsis_lines": "cast(size(filter(_l, l -> endswith(rtrim(l), '...') or endswith(rtrim(l), '…'))) as bigint)",
        "n_bullet_lines": "cast(size(filter(_l, l -> substr(ltrim(l), 1, 1) in ('-', '*', '•'))) as bigint)",
    }
    return placed.select("*", *[F.expr(e).alias(n) for n, e in exprs.items()]).drop("_t", "_w", "_l", "_h", "_s", "_p")


def breaks(rule: Rule) -> Column:
    """Whether the measures break the rule."""
    value = F.col(rule.value) if rule.over is None else F.when(F.col(rule.over) > 0, F.col(rule.value) / F.col(rule.over)).otherwise(F.lit(0.0))
    bad = F.lit(False)
    if rule.low is not None:
        bad = bad | (value < F.lit(rule.low))
    if rule.high is not None:
        bad = bad | (value > F.lit(rule.high))
    return bad


def apply(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Adds the measures, ``failed`` and ``kept``."""
    names = F.array_compact(F.array(*[F.when(breaks(r), F.lit(r.name)) for r in rules]))
    return measures(df, text).withColumn("failed", names).withColumn("kept", F.size("failed") == 0)
