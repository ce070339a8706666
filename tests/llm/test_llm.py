"""Training-data operators against brute force, round trips and held-out accuracy, with odd rows in every table."""

import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from driftline.llm import common, exact_dedup, language_id, mixing, near_dedup, packing, quality_model, quality_rules, records, sharding, substring_dedup, tokens  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, **more):
    rows = [(i, t, more.get("lang", ["en"] * len(texts))[i], f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def vocabulary(rng, n=400):
    return ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(n)]


ODD = [None, "", " \t\n", "one", "two words", "One", "x\x0by", "a\x1cb  c", "é à  ü", "ab " * 5000]


def test_tokens_equal_the_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    e = tokens.Encoder(PATH)
    rng = np.random.default_rng(0)
    pool = ["a", " ", "  ", "\n", "\t", "é", "'s", "12", "<|endoftext|>", "!", "漢", "語", "ж", "😀", "İ", "“", "\u00a0", "\n\n", "\0", "\x1c", " The", "\r\n"]
    texts = ["".join(rng.choice(pool, rng.integers(0, 15))) for _ in range(3000)] + ODD
    for text, ids in zip(texts, e.encode_all(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == (t.encode(text, add_special_tokens=False).ids if text else [])


def test_records_round_trip_and_damage(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    texts = ODD + ["same text"] * 3
    docs = frame(spark, texts).withColumn("start", F.lit("clash"))
    folder = str(tmp_path / "set")
    records.write(docs, folder, PATH, end_id=2, parts=3)
    got = records.read(spark, folder).orderBy("doc_id").collect()
    at = 0
    for r, text in zip(got, texts, strict=True):
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    first = spark.read.parquet(f"{folder}/manifest").orderBy("part").first()
    store, base = records._store(folder)
    key, ids = records.read_record(store, f"{base}/{first['records_file']}", f"{base}/{first['index_file']}", first["n_records"] - 1)
    assert key == first["last_key"] and ids[-1] == 2
    framed = bytearray(records.frame(b"payload"))
    assert records.unframe(bytes(framed), 0) == (b"payload", len(framed))
    for i in range(len(framed)):
        broken = framed.copy()
        broken[i] ^= 1
        with pytest.raises(ValueError):
            records.unframe(bytes(broken), 0)
    assert records.deserialise(records.serialise(7, np.array([70000, 1], "<u4")))[1].tolist() == [70000, 1]


def test_packing_plan_is_whole_and_tight():
    rng = np.random.default_rng(1)
    for _ in range(30):
        cap = int(rng.integers(5, 60))
        counts = {int(k): int(rng.integers(1, 40)) for k in rng.integers(1, cap + 1, 12)}
        used = collections.defaultdict(list)
        placed = collections.Counter()
        for length, rank, n, sequence, offset in packing.plan(counts, cap):
            assert rank == placed[length]
            placed[length] += n
            for i in range(n):
                used[sequence + i].append((offset, length))
        assert placed == counts
        for items in used.values():
            at = 0
            for offset, length in sorted(items):
                assert offset == at
                at += length
            assert at <= cap
            assert sum(3 * length > cap for _, length in items) <= 2
        total = sum(k * v for k, v in counts.items())
        assert len(used) <= 11 / 9 * max(-(-total // cap), sum(v for k, v in counts.items() if 2 * k > cap)) + 4


def test_packing_pieces(spark):
    texts = ODD + ["word " * 3000, "copy"] * 3
    out = packing.pack(frame(spark, texts), PATH, capacity=64).toPandas().sort_values(["doc_id", "piece"])
    for doc, own in out.groupby("doc_id"):
        assert own["piece"].tolist() == list(range(len(own)))
        assert (own["start"].to_numpy() == np.concatenate([[0], np.cumsum(own["length"])[:-1]])).all()
        assert (own["length"][1:] == 64).all()
    for _, own in out.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own["offset"].tolist() == [0, *np.cumsum(own["length"])[:-1]] and own["length"].sum() <= 64
    assert set(out["doc_id"]) == set(range(len(texts)))


def brute_components(texts, percent=85, n=5):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def near_corpus(rng, groups=6, copies=25):
    words = vocabulary(rng)
    texts = list(ODD) + ["One"]
    for _ in range(groups):
        base = list(rng.choice(words, 120))
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.integers(0, 4)):
                own[rng.integers(0, len(own))] = rng.choice(words)
            texts.append(" ".join(own))
    texts += [" ".join(rng.choice(words, 80)) for _ in range(40)]
    return texts


def test_near_duplicates_against_brute_force(spark):
    texts = near_corpus(np.random.default_rng(2))
    want, sizes = brute_components(texts)
    got = near_dedup.near_duplicates(frame(spark, texts).withColumn("rep", F.lit("clash"))).orderBy("doc_id").collect()
    assert [r["n_shingles"] for r in got] == sizes
    assert [r["component_id"] for r in got] == want
    assert [r["kept"] for r in got] == [i == c for i, c in enumerate(want)]


def test_block_links_equal_all_pairs():
    texts = near_corpus(np.random.default_rng(3), 2, 20)[11:]
    sets = [near_dedup.shingles(t) for t in texts]
    ids = np.arange(len(texts))
    links = near_dedup.block_links(np.concatenate([ids, ids]), np.concatenate([ids, ids]), np.arange(2 * len(ids)) >= len(ids), sets + sets, 85)
    want = {(i, j) for j in ids for i in range(j) if near_dedup.linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]), 85)}
    assert set(links) == want


@pytest.mark.parametrize("percent", [80, 85])
def test_trees_have_the_recall_they_are_set_for(percent):
    """Pairs at the threshold that meet at the deepest level only: as many are parted as independent trees part."""
    rng = np.random.default_rng(18)
    n_trees, pairs, n = near_dedup.trees(percent / 100), 6000, 200
    own = n * (100 - percent) // (2 * percent)
    size = near_dedup.tokens(n_trees)
    both = own * 2 * percent // (100 - percent)
    parted = 0
    for _ in range(pairs):
        items = rng.integers(0, 1 << 63, both + 2 * own, dtype=np.uint64) * np.uint64(2)
        a, b = items[: both + own], np.concatenate([items[:both], items[both + own :]])
        sketches = np.stack([near_dedup.sketch(a, size), near_dedup.sketch(b, size)])
        x, y = near_dedup.paths(sketches, n_trees, near_dedup.DEPTH)
        parted += not (x == y).any()
    assert parted <= 0.0025 * pairs


def test_large_nodes_take_the_exact_way(spark, monkeypatch):
    """With nodes of three members counted as large, everything goes through blocks."""
    monkeypatch.setattr(near_dedup, "SMALL", 2)
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    texts = near_corpus(np.random.default_rng(4), 3, 20)
    got = near_dedup.near_duplicates(frame(spark, texts)).orderBy("doc_id").collect()
    assert [r["component_id"] for r in got] == brute_components(texts)[0]


def test_chains_and_alignment():
    rng = np.random.default_rng(5)
    passage = rng.integers(0, 1 << 60, 80).astype(np.uint64)
    edited = np.delete(passage, 40)
    edited[20] = 7
    a = np.concatenate([rng.integers(0, 1 << 60, 30).astype(np.uint64), passage, rng.integers(0, 1 << 60, 10).astype(np.uint64)])
    b = np.concatenate([edited, rng.integers(0, 1 << 60, 25).astype(np.uint64)])
    k = substring_dedup.K
    pairs = [(i, j) for i in range(len(a) - k + 1) for j in range(len(b) - k + 1) if (a[i : i + k] == b[j : j + k]).all()]
    x, y = (np.array(v) for v in zip(*pairs, strict=True))
    ((start, end, match, match_end, longest, equal),) = substring_dedup.passages(a, b, x, y, 50, 0.8)
    assert (start, end, match, match_end) == (30, 110, 0, 79) and longest == 80 and equal == 78


def test_second_passage_of_a_pair_is_chained():
    """The end of a long first passage is out of reach for the second one, which has a deleted word in its middle."""
    rng = np.random.default_rng(15)

    def fresh(n):
        return rng.integers(0, 1 << 60, n).astype(np.uint64)

    one, two = fresh(200), fresh(80)
    edited = np.delete(two, 40)
    a = np.concatenate([fresh(10), one, fresh(150), two, fresh(10)])
    b = np.concatenate([fresh(20), np.delete(one, 90), fresh(130), edited, fresh(10)])
    k = substring_dedup.K
    x, y = (np.array(v) for v in zip(*[(i, j) for i in range(len(a) - k + 1) for j in range(len(b) - k + 1) if (a[i : i + k] == b[j : j + k]).all()], strict=True))
    got = sorted(substring_dedup.passages(a, b, x, y, 50, 0.8))
    assert [p[:4] for p in got] == [(10, 210, 20, 219), (360, 440, 349, 428)]


def test_fenwick_equals_scan():
    rng = np.random.default_rng(6)
    tree, seen = substring_dedup.Fenwick(20), []
    for i in range(200):
        at, value = int(rng.integers(0, 20)), float(rng.normal())
        tree.add(at, value, i)
        seen.append((at, value))
        n = int(rng.integers(0, 21))
        assert tree.best(n)[0] == max([v for a, v in seen if a < n], default=float("-inf"))


def test_repeated_passages(spark):
    rng = np.random.default_rng(7)
    words = vocabulary(rng, 3000)
    passage = list(rng.choice(words, 60))
    texts = list(ODD)
    for k in range(12):
        own = list(passage)
        if k % 3 == 1:
            own[30] = "changed"
        texts.append(" ".join([*rng.choice(words, 40), *own, *rng.choice(words, 30)]))
    clean = len(texts)
    texts += [" ".join(rng.choice(words, 150)) for _ in range(20)]
    got = substring_dedup.repeated_passages(frame(spark, texts)).collect()
    assert {r["doc_id"] for r in got} == set(range(len(ODD) + 1, clean))
    for r in got:
        assert len(ODD) <= r["match_doc_id"] < r["doc_id"] and (r["start_word"], r["end_word"], r["match_start"]) == (40, 100, 40)
    assert {r["doc_id"] for r in got if r["match_doc_id"] == len(ODD)} == set(range(len(ODD) + 1, clean))


def test_every_alike_passage_shares_a_seed():
    """Random edits of passages of 50 words and more, at 80 to 95 % equal words."""
    rng = np.random.default_rng(19)
    for _ in range(2000):
        n = int(rng.integers(50, 90))
        a = rng.integers(0, 1 << 60, n).astype(np.uint64)
        b = a.copy()
        at = rng.choice(n, int(n * rng.uniform(0.05, 0.2)), replace=False)
        b[at] = rng.integers(0, 1 << 60, len(at)).astype(np.uint64)
        assert len(np.intersect1d(substring_dedup.seeds(a)[0], substring_dedup.seeds(b)[0]))


@pytest.mark.parametrize("every", [6, 8, 12])
def test_passages_with_many_edits(spark, every):
    rng = np.random.default_rng(20)
    words = vocabulary(rng, 3000)
    texts = []
    for _ in range(20):
        passage = list(rng.choice(words, 61))
        edited = [f"new{i}" if i % every == every - 1 and i < 60 else w for i, w in enumerate(passage)]
        texts += [" ".join([*rng.choice(words, 20), *own, *rng.choice(words, 20)]) for own in (passage, edited)]
    got = {(r["match_doc_id"], r["doc_id"]) for r in substring_dedup.repeated_passages(frame(spark, texts)).collect()}
    assert got == {(2 * k, 2 * k + 1) for k in range(20)}


def test_exact_dedup(spark):
    texts = ["Same", "same", "SAME", "É", "é", None, "", "other", "x" * 100_000, "X" * 100_000] + ["hot"] * 50
    docs = frame(spark, texts).withColumn("digest", F.lit(1))
    for keep, pick in (("smallest", min), ("largest", max)):
        got = {r["doc_id"]: r for r in exact_dedup.deduplicate(docs, keep=keep, memtable_rows=7).collect()}
        groups = collections.defaultdict(list)
        for i, t in enumerate(texts):
            groups["".join(c.lower() if c.isascii() else c for c in t or "")].append(i)
        for body, ids in groups.items():
            for i in ids:
                r = got[i]
                import hashlib

                assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (pick(ids), len(ids), i == pick(ids), hashlib.sha256(body.encode()).hexdigest())


def test_index_grows_by_batches_and_collisions_part(spark):
    index = exact_dedup.DigestIndex(spark, "smallest", 3)
    a = spark.createDataFrame([(bytearray([k % 4]), k) for k in range(10)], "digest binary, id long")
    b = spark.createDataFrame([(bytearray([k % 5]), k) for k in range(10, 20)], "digest binary, id long")
    index.flush(a, 10)
    index.flush(b, 10)
    before = sorted(map(tuple, index.lookup(a.select("digest").distinct()).select("keep_id", "group_size").collect()))
    index.compact()
    assert sorted(map(tuple, index.lookup(a.select("digest").distinct()).select("keep_id", "group_size").collect())) == before == [(0, 5), (1, 5), (2, 4), (3, 4)]
    assert index.find([bytes([3]), bytes([9])]) == {bytes([3]): (3, 4)}
    base = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id long, body string").withColumn("digest", F.lit(bytearray(b"d")))
    probed = spark.createDataFrame([(bytearray(b"d"), i, 1, 1, 3) for i in (1, 2, 3)], "digest binary, id long, n long, keep_id long, group_size long")
    bad = exact_dedup._unverified(common.Scratch(spark, "t"), base, probed.select("id", "digest"))
    parted = exact_dedup._by_text(index, base, probed, bad)
    assert sorted(map(tuple, parted.select("id", "keep_id", "group_size").collect())) == [(1, 1, 2), (2, 2, 1), (3, 1, 2)]


def test_exact_dedup_of_repeated_rows_and_identifiers(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, "a"), (3, "b"), (None, "c"), (None, "c"), (5, "C"), (6, None)]
    got = exact_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    import hashlib

    own = {body: sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["kept"], r["keep_id"], r["group_size"]) for r in got if r["text_sha256"] == hashlib.sha256(body.encode()).hexdigest()) for body in ("a", "b", "c", "")}
    assert own["a"] == [(1, False, 1, 3), (1, True, 1, 3), (2, False, 1, 3)] and own["b"] == [(1, True, 1, 2), (3, False, 1, 2)]
    assert own["c"] == [(-1, False, None, 3), (-1, True, None, 3), (5, False, None, 3)] and own[""] == [(6, True, 6, 1)]


def test_hot_groups_are_joined_by_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_ROWS", 5)
    monkeypatch.setattr(exact_dedup, "FAN_IN", 2)
    texts = ["hot"] * 40 + ["cold"] * 3 + ["one"]
    got = exact_dedup.deduplicate(frame(spark, texts), keep="largest", memtable_rows=4).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == [*[(i, 39, 40) for i in range(40)], *[(i, 42, 3) for i in range(40, 43)], (43, 43, 1)]


def test_near_duplicates_of_odd_rows(spark):
    text = "one two three four five six seven"
    rows = [(None, text), (4, text.upper()), (4, text), (9, None), (10, "x " * 20_000), (11, "x " * 20_001)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit(1))).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], r["kept"], r["component_id"]) for r in got) == [(-1, 3, True, None), (4, 3, False, None), (4, 3, False, None), (9, 0, True, 9), (10, 1, True, 10), (11, 1, False, 10)]


def test_dictionaries_hold_blocks_of_whole_texts(spark):
    long = "aaa " * 50_000 + "zebra " * 50_000
    docs = spark.createDataFrame([(0, long, "x"), (1, "k", "y")], "doc_id long, text string, lang string")
    model = language_id.CompressionClassifier.fit(docs)
    assert b"zebra" in model.dictionaries["x"] and b"aaa" in model.dictionaries["x"] and len(model.dictionaries["x"]) == language_id.DICTIONARY_BYTES
    assert model.score("zebra zebra zebra")[0] == "x" and set(model.dictionaries) == {"x", "y"}


def test_sharding(spark):
    rng = np.random.default_rng(8)
    texts = ODD[:-1] + ["w" * int(n) for n in rng.integers(1, 3000, 600)] + ["copy of a text"] * 400
    docs = frame(spark, texts, lang=[["en", "de", None][i % 3] for i in range(len(texts))])
    got = sharding.shard(docs, n_shards=5).toPandas()
    assert sorted(got["doc_id"]) == list(range(len(texts)))
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 5 and sizes.max() / sizes.mean() < 1.02
    for _, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    r = got.set_index("doc_id").loc[3]
    assert r["size"] == 4 and r["text_crc32"] == zlib.crc32(b"one")
    assert sharding.shard(docs, target_bytes=10**9).select("shard").distinct().count() == 1


def test_quality_rules_against_brute_force(spark):
    import re

    texts = ODD + ["the of " * 40, "a b c d a b c x\n\nline\nline\n \nline", "# $ %x " * 20, "The cat sat on the mat and it was of a kind. " * 3 + "\n- item\n* item…"]
    for r, t in zip(quality_rules.apply(frame(spark, texts)).orderBy("doc_id").collect(), texts, strict=True):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        often = {k for k, v in collections.Counter(windows).items() if v > 1}
        covered = {i + d for i, x in enumerate(windows) if x in often for d in range(3)}
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered))
        assert r["kept"] == (not r["failed"])


def corpus(spark, n=240):
    rng = np.random.default_rng(9)
    base = {"en": "the of and to house water green winter", "de": "der die und nicht haus wasser grün zeit", "fr": "le la et dans maison eau vert temps"}
    texts, langs = [], []
    for i in range(n):
        lang = list(base)[i % 3]
        texts.append(" ".join(rng.choice(base[lang].split(), 30)))
        langs.append(lang)
    return texts, langs


def test_language_id(spark):
    texts, langs = corpus(spark)
    docs = frame(spark, texts + ODD + ["12 34 !!"], lang=langs + [None] * (len(ODD) + 1))
    held = language_id.held_out()
    got = language_id.classifier(docs).transform(docs.withColumn("margin", F.lit("clash"))).withColumn("held", held).collect()
    judged = [r for r in got if r["held"] and r["lang"]]
    assert sum(r["lang_pred"] == r["lang"] for r in judged) / len(judged) > 0.95
    for r in got:
        if r["text"] is None or not any(c.isalpha() for c in r["text"]):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
        assert 0 <= r["score"] <= 1
    assert {r["lang_pred"] for r in language_id.classifier(docs.where("lang is null")).transform(docs).collect()} == {"und"}


def test_quality_model(spark):
    texts, _ = corpus(spark)
    marked = [t.replace(" ", "*** ") if i % 4 == 0 else t for i, t in enumerate(texts)]
    docs = frame(spark, marked + ODD, lang=["en"] * (len(texts) + len(ODD)))
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(len(texts))] + [(10_000, None)], "doc_id long, quality int")
    model = quality_model.fit(docs, labels.where(~quality_model.held_out()))
    got = model.transform(docs.withColumn("score", F.lit("clash"))).withColumn("held", quality_model.held_out()).collect()
    judged = [r for r in got if r["held"] and r["doc_id"] < len(texts)]
    assert all(r["predicted"] == int(r["doc_id"] % 4 != 0) for r in judged)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert quality_model.NaiveBayesSvm.fit(["a", "b"], [1, 1]).score([None])[0] > 0.99


def test_mixing_meets_targets(spark):
    texts, langs = corpus(spark)
    docs = frame(spark, texts + ODD, lang=langs + [None] * len(ODD)).withColumn("rate", F.lit("clash"))
    labelled = docs.select("doc_id", "text", F.col("lang").alias("domain"))
    targets = {"en": 0.6, "de": 0.3, "fr": 0.1}
    out, domains = mixing.mix(docs, labelled, targets)
    rows = out.collect()
    n, r = np.array([x["n_tokens"] for x in rows]), np.array([x["rate"] for x in rows])
    p = np.array([x["posterior"] for x in rows])
    assert (r >= 0).all() and len(rows) == len(texts) + len(ODD)
    np.testing.assert_allclose((r * n) @ p / n.sum(), [targets[d] for d in domains], atol=2e-3)
    capped = mixing.mix(docs, labelled, targets, max_rate=1.0)[0].agg(F.max("rate"), F.min("rate")).first()
    assert capped[0] <= 1 and capped[1] >= 0
    with pytest.raises(ValueError):
        mixing.mix(docs, labelled, {"xx": 1.0})


def test_mixing_learns_from_few_rows_and_rare_words(spark):
    """A hundred labelled rows tell domains apart; the residual is reported, also of targets out of reach."""
    rng = np.random.default_rng(17)
    common = vocabulary(rng, 50)
    kinds = ["ab"[i % 2] for i in range(100)]
    docs = frame(spark, [" ".join([*rng.choice(common, 20), *rng.choice([f"{k}{j}" for j in ("river", "stone", "paper", "garden")], 3)]) for k in kinds])
    labelled = docs.select("doc_id", "text", F.element_at(F.array(F.lit("a"), F.lit("b")), (F.col("doc_id") % 2 + 1).cast("int")).alias("domain"))
    out, domains = mixing.mix(docs, labelled, {"a": 0.8, "b": 0.2})
    rows = out.collect()
    right = sum(max(zip(r["posterior"], domains, strict=True))[1] == kinds[r["doc_id"]] for r in rows)
    assert right >= 90
    n, r, p = (np.array([x[c] for x in rows]) for c in ("n_tokens", "rate", "posterior"))
    np.testing.assert_allclose((r * n) @ p / n.sum(), [0.8, 0.2], atol=2e-3)
    assert rows[0]["residual"] <= 1e-3
    beyond = mixing.mix(docs, labelled, {"a": 0.8, "b": 0.2}, budget=float(3 * n.sum()), max_rate=1.0)[0].first()["residual"]
    assert beyond > 0.1


@pytest.mark.parametrize("share", [0.12, 0.01, 0.0])
def test_pipeline_mixing_keeps_clean_documents(spark, tmp_path, share):
    """A scarce unwanted domain doesn't thin the clean one; one in excess is thinned."""
    import corpus_pipeline

    rng = np.random.default_rng(16)
    pools = {"high": "river stone paper garden window letter".split(), "toxic": "grr argh ugh bah pfui tss".split()}
    n = 1200
    kinds = ["toxic" if i < share * n else "high" for i in range(n)]
    docs = frame(spark, [" ".join(rng.choice(pools[k], 30)) for k in kinds])
    labels = [(i, 1, int(k == "toxic")) for i, k in enumerate(kinds)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    left = {r["doc_id"] for r in corpus_pipeline.mix_domains(spark, docs, str(tmp_path)).select("doc_id").collect()}
    kept = collections.Counter(kinds[i] for i in left)
    assert kept["high"] >= 0.97 * kinds.count("high")
    assert kept["toxic"] <= 0.08 * len(left)
    assert kept["toxic"] >= 0.5 * min(kinds.count("toxic"), 0.05 * n)


def test_pipeline_mixing_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.mix_domains(spark, spark.createDataFrame([], SCHEMA), str(tmp_path)).count() == 0
    assert corpus_pipeline.mix_domains(spark, frame(spark, ODD), str(tmp_path)).count() == len(ODD)


def test_upper_totals():
    got = mixing.upper_totals(np.array([900.0, 500.0, 2.0]), np.array([0.9, 0.05, 0.05]), np.array([False, True, True]))
    assert got[0] == 900 and got[2] == 2
    np.testing.assert_allclose(got[1], 0.05 * got.sum(), rtol=1e-6)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_dedup.near_duplicates(empty).count() == 0
    mixed, domains = mixing.mix(empty, empty.select("doc_id", "text", F.lit("a").alias("domain")), {"a": 1.0})
    assert mixed.count() == 0 and domains == ["a"] and {"rate", "copies", "residual", "posterior", "n_tokens"} <= set(mixed.columns)
    assert substring_dedup.repeated_passages(empty).count() == 0
    assert exact_dedup.deduplicate(empty).count() == 0
    assert sharding.shard(empty, n_shards=8).count() == 0
    assert packing.pack(empty, PATH).count() == 0
    assert records.round_trip(empty, PATH, 2).count() == 0
    assert quality_rules.apply(empty).count() == 0
    assert language_id.classifier(empty).transform(empty).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_model.fit(empty, labels).transform(empty).count() == 0


def test_pipeline_stages(spark):
    import os

    import corpus_pipeline

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test data")
    sf = "/root/testdata/sf0.001"
    docs = common.documents(spark, sf)
    names = set(docs.columns)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        before = docs.count()
        docs = common.Scratch(spark, "test").write("docs", stage(spark, docs, sf))
        assert set(docs.columns) == names and 0 < docs.count() <= before
        if k == 1:
            assert docs.select(exact_dedup.normalised(F.col("text"))).distinct().count() == docs.count()
        if k == 2:
            texts = [r["text"] for r in docs.select("text").collect()]
            assert len(set(brute_components(texts, 80)[0])) == len(texts)
    packed = corpus_pipeline.STAGES[4][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_word_hashes_are_those_of_words():
    from driftline.llm import words

    texts = [*ODD, "A b  a\nB", "É é", "word" * 5000, "x " * 3000, ""]
    got = words.hash_all(texts)
    known = {}
    for text, own in zip(texts, got, strict=True):
        found = (text or "").encode().lower().split()
        assert len(found) == len(own)
        assert all(known.setdefault(a, b) == b for a, b in zip(found, own.tolist(), strict=True))
    assert len(set(known.values())) == len(known)


@pytest.mark.parametrize("identity", [0.8, 0.85, 0.9, 0.95, 1.0])
def test_recall_of_fuzzy_passages(spark, identity):
    """Pairs of documents with a passage of 55 to 90 words, words of it replaced, put in or left out at random; all pairs of
    documents are aligned word by word to know which have one. At least nine in ten are found."""
    rng = np.random.default_rng(23)
    words = vocabulary(rng, 2000)
    texts = []
    for _ in range(60):
        passage = list(rng.choice(words, int(rng.integers(55, 90))))
        edited = list(passage)
        for at in sorted(rng.choice(len(passage), int(round((1 - identity) * len(passage))), replace=False).tolist(), reverse=True):
            kind = rng.integers(0, 6)
            edited[at : at + 1] = [] if kind == 0 else [edited[at], "more"] if kind == 1 else [f"new{rng.integers(0, 10**6)}"]
        texts += [" ".join([*rng.choice(words, 30), *own, *rng.choice(words, 30)]) for own in (passage, edited)]
    hashed = [substring_dedup.words(t) for t in texts]
    want = set()
    for i in range(0, len(texts), 2):  # the common words of the two passages, without what stands around them
        a, b = hashed[i][30:-30], hashed[i + 1][30:-30]
        if substring_dedup.equal_words(a, b) >= 0.8 * max(len(a), len(b)):
            want.add((i, i + 1))
    got = {(r["match_doc_id"], r["doc_id"]) for r in substring_dedup.repeated_passages(frame(spark, texts)).collect()}
    assert len(want) >= 30 and got <= {(i, i + 1) for i in range(0, len(texts), 2)}
    assert len(got & want) >= 0.9 * len(want), (len(got & want), len(want))


def test_frequent_seeds_take_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT_ROWS", 1)
    monkeypatch.setattr(substring_dedup, "HOT_LEAST", 5)
    monkeypatch.setattr(substring_dedup, "ANCHOR_ROWS", 4)
    rng = np.random.default_rng(24)
    words = vocabulary(rng, 3000)
    passage = " ".join(rng.choice(words, 70))
    texts = [" ".join([*rng.choice(words, 20), passage, *rng.choice(words, 20)]) for _ in range(30)]
    got = {(r["match_doc_id"], r["doc_id"], r["start_word"], r["end_word"]) for r in substring_dedup.repeated_passages(frame(spark, texts)).collect()}
    assert {(0, i, 20, 90) for i in range(1, 30)} <= got


def test_odd_rows_of_passages(spark):
    rng = np.random.default_rng(25)
    text = " ".join(rng.choice(vocabulary(rng, 900), 300))
    rows = [(None, text), (5, text), (5, text), (2**60 + 1, "head " + text), (7, None), (8, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("clash")).withColumn("anchor", F.lit(1))
    got = substring_dedup.repeated_passages(docs).collect()
    assert {r["doc_id"] for r in got} == {5, 2**60 + 1} and {r["match_doc_id"] for r in got} >= {None}


def test_pipeline_of_odd_rows_and_empty_tables(spark, tmp_path):
    """Null, empty, repeated and very long texts, null identifiers and clashing columns go through all stages."""
    import corpus_pipeline

    texts, langs = corpus(spark, 60)
    rows = [(i, t, lang, "s", len(t)) for i, (t, lang) in enumerate(zip(texts, langs, strict=True))]
    long = " ".join(texts) * 20
    rows += [(100, None, "en", None, None), (101, "", None, None, 0), (102, texts[0], "en", "s", 1), (0, texts[0], "en", "s", 1), (None, "the house of green water and the winter " * 9, None, None, None), (103, long, "en", "s", 1), (104, long + " water", "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    names, empty = docs.columns, spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = common.Scratch(spark, "test").write("docs", stage(spark, docs.withColumn("margin", F.lit(1)).withColumn("digest", F.lit("x")), str(tmp_path)).select(*names))
        assert stage(spark, empty, str(tmp_path)).count() == 0
    kept = [r["doc_id"] for r in docs.collect()]
    assert sorted(kept, key=str) == sorted(set(kept), key=str) and {0, 103, None} <= set(kept) and not {100, 101, 102, 104} & set(kept)
    packed = corpus_pipeline.pack_sequences(spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(kept)
    assert corpus_pipeline.pack_sequences(spark, empty, str(tmp_path)).count() == 0
