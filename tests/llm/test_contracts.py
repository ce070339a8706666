"""Equal texts, repeated and null identifiers, clashing columns and small optima of the training-data operators."""

import collections
import itertools
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from driftline.llm import language_id, mixing, near_dedup, packing, quality_model, quality_rules, records, sharding, substring_dedup  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")


# Sharding


def documents(spark, rows, more=""):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long" + more).repartition(4)


def test_equal_texts_share_a_shard_whatever_their_metadata(spark):
    """Copies of one text with languages and lengths of their own: only groups at a cut that weigh too much may straddle."""
    rng = np.random.default_rng(0)
    texts = [f"text {i} " + "x" * int(n) for i, n in enumerate(rng.integers(10, 400, 2000))]
    rows = [(5 * i + k, t, str(rng.choice(["en", "de", "fr", "es"])), int(rng.integers(1, 10**6))) for i, t in enumerate(texts) for k in range(5)]
    got = sharding.shard(documents(spark, rows), n_shards=8).toPandas()
    text = dict((r[0], r[1]) for r in rows)
    shards = collections.defaultdict(set)
    for doc, shard in zip(got["doc_id"], got["shard"], strict=True):
        shards[text[doc]].add(shard)
    assert sum(len(s) > 1 for s in shards.values()) == 0
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 8 and sizes.max() / sizes.mean() < 1.02 and sizes.min() / sizes.mean() > 0.98
    assert sorted(got["doc_id"]) == list(range(10_000))


def test_a_text_of_a_third_of_all_rows_is_split_and_others_stay_whole(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "the same text again", str(rng.choice(["en", "de"])), int(rng.integers(1, 99))) for i in range(1000)]
    rows += [(1000 + i, f"other {i // 4} " + "y" * (i // 4 % 50), str(rng.choice(["en", "de"])), int(rng.integers(1, 99))) for i in range(2000)]
    got = sharding.shard(documents(spark, rows), n_shards=4).toPandas().set_index("doc_id")
    sizes = got.groupby("shard")["size"].sum()
    assert sizes.max() / sizes.mean() < 1.03 and len(sizes) == 4
    groups = collections.defaultdict(set)
    for doc, text, *_ in rows[1000:]:
        groups[text].add(got.loc[doc, "shard"])
    assert sum(len(s) > 1 for s in groups.values()) <= 3  # one group a cut at most


def test_sharding_of_repeated_and_null_identifiers_and_clashing_columns(spark):
    rows = [(None, "a", None, None, 1, 2), (None, "a", "en", 3, 1, 2), (7, "b", "en", 1, 1, 2), (7, "b", "en", 1, 1, 2), (8, None, "en", 0, 1, 2), (9, "", "de", 0, 1, 2), (10, "z" * 20_000, "de", 20_000, 1, 2)]
    docs = documents(spark, rows, ", shard long, slot long")
    got = sharding.shard(docs, n_shards=2).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(r[0] for r in rows)
    assert {r["size"] for r in got} == {1, 2, 20_001} and {r["text_crc32"] for r in got if r["doc_id"] in (8, 9)} == {zlib.crc32(b"")}
    assert len({r["shard"] for r in got if r["doc_id"] in (8, 9)}) == 1
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_common_texts_get_their_coordinates_by_a_broadcast(spark, monkeypatch):
    rows = [(i, f"t{i % 7}", str(i % 3), i) for i in range(700)]
    table = documents(spark, rows).selectExpr("doc_id", "text _text", "n_chars d0", "cast(lang as int) d1")
    for common in (0.001, 0.9):
        monkeypatch.setattr(sharding, "COMMON", common)
        out = sharding._together(table, 2).collect()
        assert sorted((r["doc_id"], r["d0"], r["d1"]) for r in out) == sorted((i, i % 7, 0) for i in range(700))


# Records


def test_records_of_null_and_repeated_keys(spark, tmp_path):
    rows = [(None, "null key"), (3, "three"), (3, "three again"), (-5, None), (None, ""), (1 << 40, "é" * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 part", "'x' records_file", "2 n_tokens").repartition(3)
    records.write(docs, str(tmp_path / "set"), PATH, end_id=2, parts=3)
    got = records.read(spark, str(tmp_path / "set")).collect()
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(r[0] for r in rows)
    got.sort(key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, None, -5, 3, 3, 1 << 40]
    at = 0
    for r in got:
        assert r["start"] == at and r["ids_crc32"] == zlib.crc32(r["ids"])
        at += r["n_tokens"]


def test_starts_run_on_over_groups_of_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "FILES", 2)
    docs = spark.range(200).selectExpr("id doc_id", "repeat('word ', cast(id % 9 as int)) text")
    records.write(docs, str(tmp_path / "set"), PATH, end_id=2, parts=7)
    at = 0
    for r in sorted(records.read(spark, str(tmp_path / "set")).collect(), key=lambda r: r["doc_id"]):
        assert r["start"] == at
        at += r["n_tokens"]


# Near duplicates


def test_identifiers_that_stand_for_several_texts(spark):
    """(1, A), (1, B), (2, A + word), (3, B + word): each text of identifier 1 links by itself."""
    words = [f"w{i}" for i in range(130)]
    a, b, c = " ".join(words[:60]), " ".join(words[60:125]), "quite another text of more than five words"
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, c), (5, c + " and its end, which differs a lot from it"), (4, c), (None, a), (None, c + " ")]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    found = collections.defaultdict(set)
    for r in got:
        found[r["doc_id"]].add(r["component_id"])
    # The null identifier's texts are A and C, so it names their components; B's has 1 and 3.
    assert (found[1], found[2], found[3], found[4], found[5]) == ({None, 1}, {None}, {1}, {None}, {5})


# Packing and mixing


def fewest(lengths, capacity):
    """The least number of sequences, by search over all assignments."""
    best = [len(lengths)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(rooms)
            return
        tried = set()
        for i, room in enumerate(rooms):
            if room >= lengths[k] and room not in tried:
                tried.add(room)
                place(k + 1, [*rooms[:i], room - lengths[k], *rooms[i + 1 :]])
        place(k + 1, [*rooms, capacity - lengths[k]])

    lengths = sorted(lengths, reverse=True)
    place(0, [])
    return best[0]


def test_packing_against_the_optimum_of_small_cases():
    """Large pieces alone are matched in the fewest sequences there are; with small ones no case is over by more than one."""
    rng = np.random.default_rng(3)
    over = 0
    for case in range(150):
        capacity = int(rng.integers(9, 40))
        low = capacity // 3 + 1 if case % 2 else 1
        lengths = rng.integers(low, capacity + 1, 8).tolist()
        used = {s + i for *_, n, s, _ in packing.plan(collections.Counter(lengths), capacity) for i in range(n)}
        best = fewest(lengths, capacity)
        assert len(used) == best if case % 2 else len(used) <= best + 1
        over += len(used) - best
    assert over <= 8


def least_squares(a, b, upper):
    """min ||a r - b|| over 0 <= r <= upper for few columns: every choice of bound and free ones."""
    best, out = np.inf, None
    n = a.shape[1]
    for kinds in itertools.product((0, 1, 2), repeat=n):
        r = np.array([upper if k == 2 else 0.0 for k in kinds])
        free = [i for i, k in enumerate(kinds) if k == 1]
        if free:
            r[free] = np.linalg.lstsq(a[:, free], b - a @ r, rcond=None)[0]
        if (r >= -1e-9).all() and (r <= upper + 1e-9).all():
            loss = float(((a @ r - b) ** 2).sum())
            if loss < best:
                best, out = loss, r
    return best, out


def test_mixing_against_exact_least_squares(spark):
    """Documents of few kinds, so that rates of kinds are all that matters: the residual is that of exact bounded least squares."""
    kinds = [("good fine words here", "high", 30), ("bad poor words there", "low", 20), ("rude mean words now", "toxic", 10)]
    rows = [(100 * k + i, text, label) for k, (text, label, n) in enumerate(kinds) for i in range(n)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labelled = spark.createDataFrame(rows, "doc_id long, text string, domain string")
    targets = {"high": 0.7, "low": 0.2, "toxic": 0.1}
    out, domains = mixing.mix(docs, labelled, targets)
    got = out.toPandas()
    n = got["n_tokens"].to_numpy(float)
    p = np.array(got["posterior"].tolist())
    mass = (p * n[:, None]).T
    share = mass @ got["rate"].to_numpy()
    share = share / share.sum()
    kind = got["doc_id"] // 100
    merged = np.stack([mass[:, kind == k].sum(1) for k in range(3)], 1)
    total = merged.sum()
    want = np.array([targets[d] for d in domains])
    loss, rates = least_squares(merged / total, want, 1e9)
    exact = merged @ rates
    assert loss < 1e-12
    np.testing.assert_allclose(share, exact / exact.sum(), atol=5e-3)


# Passages


def vocabulary(rng, n):
    return ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(n)]


def passage_texts(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)


@pytest.mark.parametrize("parts", [3, 2])
def test_passages_whose_parts_stand_in_many_other_documents(spark, parts):
    """Pairs share a passage of 120 words; each of its parts, too short to report, also stands in an older document, in documents
    between the two, and in a younger one. At least nine in ten pairs are found."""
    rng = np.random.default_rng(11)
    words = vocabulary(rng, 5000)
    size = 40 if parts == 3 else 45
    around = lambda inner: " ".join([*rng.choice(words, 25), *inner, *rng.choice(words, 25)])
    texts, want, old, between, late = [], [], [], [], []
    passages = [[list(rng.choice(words, size)) for _ in range(parts)] for _ in range(30)]
    for own in passages:
        old += [around(p) for p in own]
        between += [around(p) for p in own for _ in range(2)]
        late += [around(p) for p in own]
    first = [around(sum(own, [])) for own in passages]
    second = [around(sum(own, [])) for own in passages]
    texts = old + first + between + second + late
    begin = len(old), len(old) + len(first) + len(between)
    want = {(begin[0] + k, begin[1] + k) for k in range(30)}
    got = {(r["match_doc_id"], r["doc_id"]) for r in substring_dedup.repeated_passages(passage_texts(spark, texts)).collect()}
    assert len(got & want) >= 27, len(got & want)
    assert got <= want


def test_short_passages_at_the_least_identity(spark):
    """Isolated pairs with 50 to 55 words of which eight in ten are equal: at least nine in ten of those that have such a passage are found."""
    rng = np.random.default_rng(12)
    words = vocabulary(rng, 5000)
    texts, want = [], set()
    for k in range(100):
        passage = list(rng.choice(words, int(rng.integers(50, 56))))
        edited = list(passage)
        for at in rng.choice(len(passage), int(0.2 * len(passage)), replace=False):
            edited[at] = f"new{rng.integers(0, 10**6)}"
        texts += [" ".join([*rng.choice(words, 30), *own, *rng.choice(words, 30)]) for own in (passage, edited)]
        want.add((2 * k, 2 * k + 1))
    got = {(r["match_doc_id"], r["doc_id"]): r for r in substring_dedup.repeated_passages(passage_texts(spark, texts)).collect()}
    assert set(got) <= want and len(got) >= 90, len(got)
    for r in got.values():
        assert r["n_words"] >= 50 and r["identity"] >= 0.8


def links_by_hand(spots):
    """Unordered pairs of occurrences (id, copy, at): each with its neighbour in order and with the first document's."""
    groups, want = {}, set()
    for seed, *own in sorted(spots):
        groups.setdefault(seed >> substring_dedup.CONTEXT, []).append(tuple(own))
    for own in groups.values():
        pairs = [*zip(own[1:], own, strict=False), *((x, min(own)) for x in own)]
        want |= {(max(a, b), min(a, b)) for a, b in pairs if a[:2] != b[:2]}
    return want


@pytest.mark.parametrize(("rows", "least"), [(1 << 16, 4096), (7, 40), (1, 2)])
def test_seeds_are_linked_across_ranges_whatever_their_number(spark, monkeypatch, rows, least):
    monkeypatch.setattr(substring_dedup, "HOT_ROWS", rows)
    monkeypatch.setattr(substring_dedup, "HOT_LEAST", least)
    monkeypatch.setattr(substring_dedup, "partitions", lambda *_: 9)
    rng = np.random.default_rng(13)
    spots = set()
    for group, n in [(5, 900), (-3, 300), (1 << 46, 60), *((int(g), int(rng.integers(1, 5))) for g in rng.integers(-(1 << 47), 1 << 47, 150))]:
        for _ in range(n):
            key = (group << substring_dedup.CONTEXT) | int(rng.integers(0, 3))
            spots.add((key, int(rng.choice([substring_dedup.NO_KEY, *range(40)])), int(rng.integers(0, 2)), int(rng.integers(0, 50))))
    spots = sorted({(x[0] >> substring_dedup.CONTEXT, *x[1:]): x for x in spots}.values())  # an occurrence has one context
    frame = spark.createDataFrame([spots[i] for i in rng.permutation(len(spots)).tolist()], "seed long, id long, copy int, at int")
    got = [((r[0], r[1], r[2]), (r[3], r[4], r[5])) for r in substring_dedup._links(substring_dedup._met(frame)).collect()]
    assert len(got) == len(set(got)) and set(got) == links_by_hand(spots)


@pytest.mark.parametrize("parts", [2, 9])
def test_links_of_one_seed_grow_with_its_occurrences(spark, monkeypatch, parts):
    """A seed in n documents makes two links an occurrence at most, in however many ranges it lies and whether or not they are open."""
    monkeypatch.setattr(substring_dedup, "partitions", lambda *_: parts)
    rng = np.random.default_rng(15)
    made = []
    for n in (500, 1000, 2000):
        spots = [((7 << substring_dedup.CONTEXT) | int(c), k, 0, 3) for k, c in enumerate(rng.integers(0, 1 << substring_dedup.CONTEXT, n).tolist())]
        frame = spark.createDataFrame([spots[i] for i in rng.permutation(n).tolist()], "seed long, id long, copy int, at int")
        met = substring_dedup._met(frame)
        assert met.where(met.kind == substring_dedup.OPEN).count() == n
        made.append(substring_dedup._links(met).count())
        assert n - 1 <= made[-1] <= 2 * n, made
    assert made[1] <= 2.1 * made[0] and made[2] <= 2.1 * made[1], made


def test_passages_do_not_depend_on_what_counts_as_frequent(spark, monkeypatch):
    """Pairs share 120 words whose thirds stand in many other documents too; all documents share a line. Frequent seeds keep their neighbours."""
    rng = np.random.default_rng(14)
    words = vocabulary(rng, 4000)
    line = list(rng.choice(words, 12))
    around = lambda inner: " ".join([*rng.choice(words, 20), *line, *inner, *rng.choice(words, 20)])
    passages = [[list(rng.choice(words, 40)) for _ in range(3)] for _ in range(6)]
    old = [around(p) for own in passages for p in own]
    texts = old + [around(sum(own, [])) for own in passages] + [around(p) for own in passages for p in own] + [around(sum(own, [])) for own in passages]
    want = sorted(substring_dedup.repeated_passages(passage_texts(spark, texts)).collect())
    pairs = {(r["match_doc_id"], r["doc_id"]) for r in want}
    assert len(pairs & {(len(old) + k, 2 * len(old) + 6 + k) for k in range(6)}) >= 5
    monkeypatch.setattr(substring_dedup, "HOT_ROWS", 1)
    monkeypatch.setattr(substring_dedup, "HOT_LEAST", 2)
    assert sorted(substring_dedup.repeated_passages(passage_texts(spark, texts)).collect()) == want


def test_words_are_not_moved_again_to_meet_their_pairs(spark):
    """Both texts of a pair come from buckets as they lie; only those of crowded anchors are dealt out."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        out = substring_dedup.repeated_passages(passage_texts(spark, ["some text " * 40, "other text " * 40]))
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(name, before)
    assert plan.count("Bucketed: true") >= 3, plan


def test_rows_without_identifier_lie_in_many_buckets(spark):
    """So a pair of them doesn't meet the words of all others; the first row of an identifier stays by it."""
    rows = [(substring_dedup.NO_KEY, bytes([k]), 1) for k in range(50)] + [(7, b"a", 1), (7, b"b", 1), (8, b"c", 1)]
    got = substring_dedup._numbered(spark.createDataFrame(rows, "id long, words binary, n long")).collect()
    assert len({r["bucket"] for r in got}) == len(rows)
    assert all((r["bucket"] == r["id"]) == (r["copy"] == 0) for r in got)


def test_contexts_order_seeds_by_what_follows():
    seeds = np.array([5, 9, 7, 5, 9, 8, 5], np.uint64) << np.uint64(40)
    text, at = np.array([0, 0, 0, 1, 1, 1, 2]), np.array([0, 3, 6, 10, 13, 16, 4])
    keys = substring_dedup.contexts(seeds, text, at)
    assert (keys >> np.uint64(16) == seeds >> np.uint64(16)).all()
    low = keys & np.uint64(0xFFFF)
    assert low[0] >> np.uint64(12) == low[3] >> np.uint64(12) and low[0] != low[3]  # one seed in common behind it, then another
    assert low[2] == low[5] == low[6] == 0  # nothing follows
    assert len(substring_dedup.contexts(seeds[:0], text[:0], at[:0])) == 0


def test_completed_passages_take_the_words_that_were_trimmed():
    a = np.arange(100)
    b = np.where(np.isin(a, [40, 42, 58, 60]), -1, a)
    start, end, match, match_end, equal = substring_dedup.completed(a, b, (43, 58, 43, 58, 15), 18, 0.8)
    assert end - start >= 18 and a[start] == b[match] and a[end - 1] == b[match_end - 1] and equal == (a[start:end] == b[match:match_end]).sum()
    assert substring_dedup.completed(a, b, (43, 58, 43, 58, 15), 18, 0.99) == (43, 58, 43, 58, 15)  # not alike enough
    assert substring_dedup.completed(a, b, (0, 100, 0, 100, 96), 50, 0.8) == (0, 100, 0, 100, 96)
    assert substring_dedup.completed(a[:10], b[:10], (2, 8, 2, 8, 6), 50, 0.8) == (2, 8, 2, 8, 6)  # no room
    other = np.where((a >= 43) & (a < 58), a, -1 - a)
    assert substring_dedup.completed(a, other, (43, 58, 43, 58, 15), 18, 0.8) == (43, 58, 43, 58, 15)  # it just ends there


# Odd rows of the scoring operators

LONG = "Many words stand in this rather long text, and they go on. " * 400


def odd_rows():
    rows = [(None, "a text without an identifier", "en"), (None, None, "en"), (3, "repeated", None), (3, "repeated", None), (3, "another one", "de"), (4, "", "en"), (5, LONG, "en"), (6, "\x00 odd \u2028 signs \U0001f600", "de")]
    return [(*r, "clash", 1.5, 7, False) for r in rows]


def odd_documents(spark, *clashing):
    names = ["doc_id long", "text string", "lang string", *[f"{c} {t}" for c, t in zip(clashing, ("string", "double", "int", "boolean"), strict=False)]]
    return spark.createDataFrame([r[: len(names)] for r in odd_rows()], ", ".join(names)).repartition(3)


def ids(df):
    return collections.Counter(r["doc_id"] for r in df.select("doc_id").collect())


def test_scores_of_odd_rows(spark):
    want = collections.Counter(r[0] for r in odd_rows())
    train = [(i, f"good fine words number {i}" if i % 2 else f"bad poor phrases item {i}", "en" if i % 2 else "de") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (7, None)], "doc_id long, quality int")
    labelled = spark.createDataFrame(train, "doc_id long, text string, lang string")
    out = quality_model.fit(labelled, labels).transform(odd_documents(spark, "score", "predicted").select("doc_id", "text"))
    assert ids(out) == want and all(0 <= r["score"] <= 1 for r in out.collect())
    out = language_id.CompressionClassifier.fit(labelled).transform(odd_documents(spark, "lang_pred", "score").select("doc_id", "text"))
    assert ids(out) == want and {r["lang_pred"] for r in out.collect() if r["text"] in (None, "")} == {"und"}


def test_rules_and_packing_of_odd_rows(spark):
    want = collections.Counter(r[0] for r in odd_rows())
    docs = odd_documents(spark, "n_words", "word_chars", "kept")
    got = quality_rules.apply(docs)
    assert ids(got) == want
    assert {(r["doc_id"], r["n_words"]) for r in got.collect()} >= {(5, 400 * 12), (4, 0), (None, 0)}
    pieces = packing.pack(odd_documents(spark, "piece", "sequence_id", "length"), PATH, capacity=512).collect()
    assert {r["doc_id"] for r in pieces} == set(want)
    assert sum(r["piece"] == 0 for r in pieces) == sum(want.values())
    by_sequence = collections.defaultdict(list)
    for r in pieces:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 512
