"""Whitening, prefix-wise byte-pair encoding and cross-tokenizer alignment against dense algebra, the libraries and brute force."""

import collections
import hashlib
import json

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from driftline.llm import alignment, bpe, queries, tokens, whitening  # noqa: E402

BYTES, WORDS, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
VECTORS = "vec_id long, embedding array<float>, label int, n string"
ODD = [None, "", " ", " \t\n", "one", "One", "x\x0by", "a\x1cb  c", "é à  ü", "ab " * 3000, "a" * 3000, "same", "same", "x\0y", "▁a", "a▁", "<s> <|endoftext|>", "\n", " \n ", "   ", ";\r\n"]


def mixed(rng, n, pool):
    return ["".join(rng.choice(pool, rng.integers(0, 18))) for _ in range(n)]


POOL = ["a", " ", "  ", "\n", "\t", "é", "É", "'S", "'re", "12", "½", "<|endoftext|>", "<|StartOfText|>", "!", "漢", "ж", "😀", "İ", "Σ", "“", " ", "\0", "\x1c", " The", "\r\n", "é", "ing", "tion", "aaaa", "ß", "ǅ"]


# Whitening


def vectors(spark, x, **more):
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], 0, "clash") for i, v in enumerate(x)]
    return spark.createDataFrame(rows, VECTORS).repartition(3)


def dense(x):
    """Whole-number grid, eigenvalues and eigenvectors, by NumPy."""
    grid = np.floor(64 * np.asarray(x, np.float32).astype(float)).astype(np.int64) + 1_000_000
    moved = (grid * len(grid) - grid.sum(0)) / len(grid)
    values, turn = np.linalg.eigh(moved.T @ moved / len(grid))
    return grid, moved, values[::-1], turn[:, ::-1]


def test_whitening_equals_dense_algebra(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 12)) * np.linspace(3, 0.5, 12) @ np.linalg.qr(rng.normal(size=(12, 12)))[0] + 5
    odd = [None, [], [None] * 12, [float("nan"), *[1.0] * 11], [float("inf"), *[1.0] * 11], [1.0, 2.0], [1.0] * 11 + [None]]
    got = whitening.fit(vectors(spark, [*x, *odd]), components=5).transform().collect()
    assert len(got) == 400 * 5
    grid, moved, values, turn = dense(x)
    z = moved @ turn[:, :5] / np.sqrt(values[:5])
    signs = {}
    for r in got:
        i, k = r["vec_id"], r["component"] - 1
        signs.setdefault(k, np.sign(r["whitened"] * z[i, k]))
        assert r["n"] == 400 and abs(r["whitened"] - signs[k] * z[i, k]) < 1e-9
        assert r["deviation"] == sum((400 * int(v) - int(s)) ** 2 for v, s in zip(grid[i], grid.sum(0), strict=True))
        assert abs(r["explained"] - values[k] / values.sum()) < 1e-10 and r["identity_error"] < 1e-10


def test_whitening_steps_reach_certified_components():
    """More dimensions than three blocks: several steps, equal and near-equal eigenvalues."""
    rng = np.random.default_rng(1)
    values = np.concatenate([[50.0, 50.0, 9.0, 8.999999, 4.0], rng.random(295)])
    turn = np.linalg.qr(rng.normal(size=(300, 300)))[0]
    matrix = turn * values @ turn.T
    taken = []
    directions, found, residuals, steps = whitening.lobpcg(lambda b: taken.append(b.shape[1]) or matrix @ b, 300, 5)
    assert steps > 3 and max(taken) <= 2 * (5 + whitening.GUARD)
    np.testing.assert_allclose(found, values[:5], atol=1e-10)
    assert (residuals <= whitening.TOLERANCE * 50).all()
    np.testing.assert_allclose(directions.T @ directions, np.eye(5), atol=1e-12)
    np.testing.assert_allclose(np.linalg.norm(matrix @ directions - directions * found, axis=0), 0, atol=1e-9)


def test_whitening_raises_rather_than_give_uncertified_components():
    rng = np.random.default_rng(2)
    matrix = np.diag(rng.random(300))
    with pytest.raises(ArithmeticError):
        whitening.lobpcg(lambda b: matrix @ b, 300, 5, max_steps=2)


def test_whitening_of_few_constant_and_no_rows(spark):
    for x, rows in (([], 0), ([None], 0), ([[1.0, 2.0]], 0), ([[1.0, 2.0]] * 4, 0), ([[1.0, 2.0], [1.0, 5.0], [1.0, 9.0]], 3), ([[], []], 0)):
        out = whitening.fit(vectors(spark, x), components=2).transform()
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        assert out.count() == rows  # constant coordinates make no component
    huge = whitening.fit(vectors(spark, [[3e38, 0.0], [-3e38, 1.0], [0.0, 2.0]]), components=1).transform().collect()
    assert len(huge) == 3 and all(np.isfinite(r["whitened"]) for r in huge) and any(r["deviation"] is None for r in huge)


def test_whitening_takes_the_most_frequent_size(spark):
    out = whitening.fit(vectors(spark, [[1.0, 2.0], [2.0, 2.5], [3.0, 1.0], [1.0], [5.0], [float("nan"), 1.0]]), components=2).transform().collect()
    assert {r["vec_id"] for r in out} == {0, 1, 2} and {r["n"] for r in out} == {3}


def test_deviations_are_exact():
    moved = np.array([[1 << 31, 3], [(1 << 31) + 1, -3]])
    assert whitening.deviations(moved).to_pylist() == [(1 << 62) + 9, ((1 << 31) + 1) ** 2 + 9]
    assert whitening.deviations(np.array([[1 << 40, 1]])).to_pylist() == [None]


def test_query_of_whitening_by_numpy(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 40)).astype(np.float32)
    vectors(spark, x).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.QUERIES["op11_whitening"](spark, str(tmp_path)).collect()
    _, moved, values, turn = dense(x)
    assert len(got) == 90 * 32 and {r["component"] for r in got} == set(range(1, 33))
    z = moved @ turn[:, :32] / np.sqrt(values[:32])
    for r in got:
        assert abs(abs(r["whitened"]) - abs(z[r["vec_id"], r["component"] - 1])) < 1e-7


# Byte-pair encoding


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def test_prefix_encoding_equals_the_library(spark, tmp_path):
    rng = np.random.default_rng(4)
    texts = ODD + mixed(rng, 400, POOL) + ["".join(chr(c) for c in rng.integers(97, 123, n)) for n in rng.integers(1, 40, 600)]
    docs = spark.createDataFrame([(None if i == 3 else i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens long").repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    t = library(WORDS)
    want = collections.Counter()
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids
        want[None if i == 3 else i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert collections.Counter(map(tuple, queries.QUERIES["op12_bpe"](spark, str(tmp_path)).collect())) == want


def test_every_token_of_the_vocabulary():
    c, t = bpe.Codec.of(WORDS), library(WORDS)
    words = [w for w in list(t.get_vocab())[::37] if "<|" not in w]
    for w in words:
        text = w.replace("</w>", "")
        assert c.merge(text) == [x.id for x in t.model.tokenize(text)]


def merged(symbols, rules):
    """Plain byte-pair encoding: the lowest rule first, from the left."""
    out = list(symbols)
    while True:
        ranks = [(rules.get((a, b), (len(rules), 0))[0], i) for i, (a, b) in enumerate(zip(out, out[1:], strict=False))]
        if not ranks or min(ranks)[0] == len(rules):
            return out
        i = min(ranks)[1]
        out[i : i + 2] = [rules[out[i], out[i + 1]][1]]


def test_prefixes_of_random_rules_have_one_last_token():
    """Rules made at random, tokens that no text leads to among them: the prefix way equals plain merging."""
    rng = np.random.default_rng(5)
    for _ in range(60):
        base, rules, made, seen = [0, 1, 2], [], 3, set()
        for _ in range(14):
            a, b = (int(v) for v in rng.integers(0, made, 2))
            if (a, b) not in seen:
                seen.add((a, b))
                rules.append((a, b, made))
                made += 1
        m = bpe.Merges(rules, base)
        automaton = bpe.SuffixAutomaton().build(m.symbols)
        plain = {(a, b): (k, c) for k, (a, b, c) in enumerate(rules)}
        for _ in range(40):
            text = rng.integers(0, 3, rng.integers(1, 30)).tolist()
            codec = object.__new__(bpe.Codec)
            codec.merges, codec.automaton, codec.within, codec.last = m, automaton, {str(s): s for s in base}, {str(s): s for s in base}
            assert codec.merge("".join(map(str, text))) == merged(text, plain)


def test_suffix_automaton_finds_every_pattern_that_ends_here():
    rng = np.random.default_rng(6)
    patterns = {k: tuple(rng.integers(0, 3, rng.integers(1, 7)).tolist()) for k in range(40)}
    patterns = {k: p for k, p in patterns.items() if list(patterns.values()).index(p) == k} | {100: (0,), 101: (1,), 102: (2,)}
    patterns = {k: p for k, p in patterns.items() if k >= 100 or len(p) > 1}
    a = bpe.SuffixAutomaton().build(patterns)
    text = rng.integers(0, 3, 500).tolist()
    state = length = 0
    for i, s in enumerate(text):
        while s not in a.next[state]:
            state = a.link[state]
            length = a.size[state]
        state, length = a.next[state][s], length + 1
        got = [name for size, name in a.ends[state] if size <= length]
        assert sorted(got) == sorted(k for k, p in patterns.items() if tuple(text[max(0, i + 1 - len(p)) : i + 1]) == p)


def test_vocabularies_that_are_not_plain_are_refused(tmp_path):
    with open(WORDS, encoding="utf-8") as src:
        file = json.load(src)
    file["model"]["dropout"] = 0.1
    (tmp_path / "v.json").write_text(json.dumps(file))
    with pytest.raises(ValueError):
        bpe.Codec(str(tmp_path / "v.json"))
    with pytest.raises(ValueError):
        bpe.Merges([(0, 1, 3), (1, 0, 3)], [0, 1])


def test_words_kept_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "WORDS", 50)
    monkeypatch.setattr(bpe, "PAIRS", 50)
    c, t = bpe.Codec(WORDS), library(WORDS)
    rng = np.random.default_rng(7)
    for text in mixed(rng, 300, POOL):
        assert np.frombuffer(c.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
        assert len(c.words) <= 51 and len(c.merges.known) <= 51


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.round_trip(docs, WORDS).count() == 0
    out, pairs = alignment.align(docs, BYTES, PIECES)
    assert (out.count(), pairs.count()) == (0, 0) and out.columns[0] == "doc_id"


# Alignment


def by_hand(texts):
    import sentencepiece

    t, sp = library(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    t.encode_special_tokens = True
    letters = {c: k for k, c in enumerate(tokens.byte_letters())}
    names = {v: k for k, v in t.get_vocab().items()}
    found, pairs = [], collections.Counter()
    for text in texts:
        whole = f" {text}".encode()
        a, b = (t.encode(f" {text}", add_special_tokens=False).ids, sp.encode(text)) if text else ([], [])
        spelt = [bytes(letters[c] for c in names[i]) for i in a], [bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or any(b"".join(s) != whole for s in spelt):
            found.append(None)
            continue
        ends = [np.cumsum([len(v) for v in s]).tolist() for s in spelt]
        links, i, j = [], 0, 0
        groups, begin = [], (0, 0)
        while i < len(a) and j < len(b):
            links.append((a[i], b[j]))
            x, y = ends[0][i], ends[1][j]
            i, j = i + (x <= y), j + (y <= x)
            if x == y:
                groups.append(",".join(map(str, a[begin[0] : i])) + "|" + ",".join(map(str, b[begin[1] : j])))
                begin = i, j
        pairs.update(links)
        found.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = collections.Counter()
    for (_, b), n in pairs.items():
        most[b] = max(most[b], n)
    return [(0, 0, 0, 0, 0, 0, "") if f is None else (*f[:3], len(f[3]), sum(pairs[p] == most[p[1]] for p in f[3]), sum(pairs[p] for p in f[3]), f[4]) for f in found], pairs


def test_alignment_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    texts = ODD + mixed(rng, 500, POOL) + [" ".join(rng.choice(["the", "and", "shard", "tokens", "été", "naïve"], 30)) for _ in range(60)]
    docs = spark.createDataFrame([(None if i == 4 else i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_a string").repartition(3)
    want, pairs = by_hand(texts)
    out, counts = alignment.align(docs, BYTES, PIECES)
    assert collections.Counter(map(tuple, out.collect())) == collections.Counter((None if i == 4 else i, *w) for i, w in enumerate(want))
    got = counts.collect()
    assert {(r["a_id"], r["b_id"]): r["count"] for r in got} == dict(pairs)
    assert all(r["best"] == (r["count"] == max(n for (_, b), n in pairs.items() if b == r["b_id"])) for r in got[:200])


def test_many_chunks_meet_in_many_groups(spark, monkeypatch):
    """Chunks made of few documents each: links of one pair in many chunks, and several groups a stripe."""
    import pyarrow as pa

    rng = np.random.default_rng(9)
    texts = [" ".join(rng.choice(["the", "and", "shard", "tokens", "été", "naïve", "\n", "x1"], 12)) for _ in range(120)]
    aligner = alignment.Aligner(BYTES, PIECES)
    rows = [aligner.chunk(k, pa.array(range(4 * k, 4 * k + 4)), pa.array(texts[4 * k : 4 * k + 4])).to_pylist()[0] for k in range(30)]
    monkeypatch.setattr(alignment, "chunks", lambda *_: spark.createDataFrame(rows, alignment.CHUNKS))
    monkeypatch.setattr(alignment, "MEETING", 4)
    out, _ = alignment.align(spark.createDataFrame([], "doc_id long, text string"), BYTES, PIECES)
    assert sorted(map(tuple, out.collect())) == [(i, *w) for i, w in enumerate(by_hand(texts)[0])]


def test_packed_links_round_trip():
    rng = np.random.default_rng(10)
    n = np.array([0, 3, 0, 0, 5, 1, 0])
    links = rng.integers(0, 1 << 20, n.sum())
    back = alignment._runs(alignment._sorted_runs(links, n), n)
    at = 0
    for k in n:
        assert back[at : at + k].tolist() == sorted(links[at : at + k].tolist())
        at += k
    assert len(alignment._runs(alignment._sorted_runs(np.zeros(0, np.int64), n * 0), n * 0)) == 0


def test_cache_of_strange_texts_is_bounded(monkeypatch):
    """Texts in scripts that always take the careful way don't let the table grow."""
    monkeypatch.setattr(tokens, "CACHE", 1000)
    e, t = tokens.Encoder(BYTES), library(BYTES)
    rng = np.random.default_rng(11)
    letters = [chr(c) for c in range(0x0627, 0x064A)]
    for _ in range(10):
        text = " ".join("".join(rng.choice(letters, 6)) for _ in range(1000))
        (ids,) = e.encode_all([text])
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
        assert len(e.ids) <= 1001


def test_both_tables_of_an_aligner_stay_small():
    """Two tables of 700,000 strings in each of three workers took more than an executor's memory."""
    aligner = alignment.Aligner(BYTES, PIECES)
    for k in range(3):
        texts = pa.array([" ".join(f"w{k}x{i}y{j}" for j in range(100)) for i in range(900)], pa.large_string())
        aligner.a.encode(texts)
        aligner.b.encode(texts)
    assert max(aligner.a.cache(), alignment.UNITS) <= 200_000
    assert len(aligner.a.ids) <= 2 * alignment.UNITS and len(aligner.b.units) <= 2 * alignment.UNITS
