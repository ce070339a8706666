"""Near-duplicate detection: a chosen-path set similarity join.

Documents are sets of word shingles. Equal sets are one class from the start (one row in all that follows). Each class
has a sketch of minwise tokens, one of its own for each level of each tree, so that trees are independent. A node sends a
class to the child of the minwise token of its level, so two classes of similarity J stay together with probability J a
level. A node that has become small is compared exhaustively; the number of trees follows from the
recall wanted at the deepest level. A star pass comes first: members of a node are linked to its first member, and what
that confirms is contracted, so nodes within one component are done and large groups of copies never meet pair by pair.
Large nodes at the deepest level compare members outside their main component with all members, block by block, exactly.

Every link is confirmed on the full shingle sets (of 64-bit hashes). Candidates are confirmed in two rounds: first the
best for each class, then all that still join two components.

Defined results: null, empty and word-free texts have an empty set and are linked with nothing; texts with fewer words
than a shingle have one shingle, the whole sequence; repeated texts share a component; a null identifier is the least one
(-2^63 stands for it); rows that share an identifier but not the shingles are documents of their own, each linked by its own text,
and a component's identifier is the least of all its rows (such rows go by a hash of identifier and text inside); an empty table gives an empty table; only the key and the text of the input are read.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm import words as w
from driftline.llm.common import Scratch, partitions

WORDS = 5
SIMILARITY = 0.85
#: Minwise tokens that are compared for agreement (a sketch has more where trees need more), levels of a tree, recall wanted of a pair at the threshold that no node isolates early.
SKETCH = 64
DEPTH = 6
RECALL = 0.999
#: Level of the star pass; members of a small node; members of a block of a large one.
STAR = 3
SMALL = 32
BLOCK = 256
#: Sketches that agree in fewer places than this many standard deviations under the threshold aren't candidates.
SLACK = 5.0

#: Stands for a null identifier while classes are joined.
NO_KEY = -(1 << 63)


def shingle_sets(texts: list[str | None], n: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its word shingles; A-Z count as a-z, words part at ASCII white space."""
    out: list[np.ndarray] = []
    for _, hashes, at in w.batches(pa.array(texts, pa.large_string())):
        found, text, _ = w.runs(hashes, at, n)
        ends = np.searchsorted(text, np.arange(len(at)))
        for k, size in enumerate(np.diff(at).tolist()):
            whole = found[ends[k] : ends[k + 1]] if size >= n or not size else w.runs(hashes[at[k] : at[k + 1]], np.array([0, size]), size)[0]
            out.append(np.unique(whole))
    return out


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    return shingle_sets([text], n)[0]


@functools.cache
def _factors(n: int) -> np.ndarray:
    return np.random.default_rng(20).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(items: np.ndarray, n_tokens: int = SKETCH) -> np.ndarray:
    """uint32 minwise tokens."""
    out = np.full(n_tokens, 2**32 - 1, np.uint32)
    for i in range(0, len(items), 512):
        out = np.minimum(out, ((items[i : i + 512, None] * _factors(n_tokens)) >> np.uint64(32)).astype(np.uint32).min(0))
    return out


def trees(similarity: float = SIMILARITY, depth: int = DEPTH, recall: float = RECALL) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**depth))


def tokens(n_trees: int, depth: int = DEPTH) -> int:
    """Tokens of a sketch: one for each level of each tree."""
    return max(SKETCH, n_trees * depth)


def paths(sketches: np.ndarray, n_trees: int, depth: int) -> np.ndarray:
    """Node of each sketch in each tree at ``depth``: uint64 (rows, trees). No two trees or levels read the same token."""
    node = w.mix(np.broadcast_to(np.arange(1, n_trees + 1, dtype=np.uint64) * w.MIX, (len(sketches), n_trees)).copy())
    for level in range(depth):
        own = sketches[:, level * n_trees : (level + 1) * n_trees]
        node = w.mix(node * np.uint64(3) + own.astype(np.uint64) + np.uint64(1))
    return node


def least_agreement(similarity: float = SIMILARITY) -> int:
    return max(1, math.floor(SKETCH * (similarity - SLACK * math.sqrt(similarity * (1 - similarity) / SKETCH))))


def linked(both: int, a: int, b: int, percent: int) -> bool:
    return 100 * both >= percent * (a + b - both)


def _own() -> Column:
    """An identifier of a row by its identifier and text."""
    return F.xxhash64("id", "body")


def _known(name: str) -> Column:
    return F.when(F.col(name) != NO_KEY, F.col(name))


class ChosenPathJoin:
    """``rows`` of the result: doc_id, n_shingles, component_id, kept."""

    def __init__(self, documents: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, words: int = WORDS):
        self.spark = documents.sparkSession
        self.scratch = Scratch(self.spark, "near-dedup")
        self.base = documents.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("id"), F.col(text).alias("body"))
        self.percent, self.similarity, self.words = round(100 * similarity), similarity, words
        self.trees, self.least = trees(similarity), least_agreement(similarity)

    # Sets and classes

    def _sketched(self) -> DataFrame:
        n, n_tokens = self.words, tokens(self.trees)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for doc, own, items in zip(batch["id"], batch["own"], shingle_sets(batch["body"].tolist(), n), strict=True):
                    digest = hashlib.blake2b(items.tobytes(), digest_size=16).digest()
                    found = sketch(items, n_tokens)
                    out.append((doc, own, len(items), digest, found.tobytes(), (found[:SKETCH] & 255).astype(np.uint8).tobytes()))
                yield pd.DataFrame(out, columns=["id", "own", "n", "digest", "sketch", "bytes"])

        return self.base.select("id", _own().alias("own"), "body").mapInPandas(run, "id long, own long, n long, digest binary, sketch binary, bytes binary")

    def _apart(self, docs: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
        """(documents, texts, whether an identifier stands for several sets): where one does, its rows get identifiers of their own;
        ``doc`` keeps the given one."""
        several = docs.groupBy("id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo < hi").select("id")
        several = self.scratch.write("several", several.withColumn("_several", F.lit(True)))
        if several.isEmpty():
            return docs.withColumn("doc", F.col("id")), self.base, False
        docs = docs.join(several, "id", "left").withColumn("doc", F.col("id")).withColumn("id", F.when(F.col("_several"), F.col("own")).otherwise(F.col("id"))).drop("_several")
        base = self.base.join(several, "id", "left").select(F.when(F.col("_several"), _own()).otherwise(F.col("id")).alias("id"), "body")
        return self.scratch.write("apart", docs), base, True

    def _nodes(self, classes: DataFrame, depth: int) -> DataFrame:
        """(node, rep): a row for each class and tree."""
        n_trees, n_tokens = self.trees, tokens(self.trees)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    node = paths(np.frombuffer(b"".join(batch["sketch"]), np.uint32).reshape(-1, n_tokens), n_trees, depth)
                    yield pd.DataFrame({"node": node.view(np.int64).ravel(), "rep": np.repeat(batch["rep"].to_numpy(), n_trees)})

        return classes.select("rep", "sketch").mapInPandas(run, "node long, rep long")

    # Confirmation and components

    def _confirmed(self, pairs: DataFrame, name: str) -> DataFrame:
        """Pairs (a, b) whose full sets are similar enough."""
        pairs = self.scratch.write(f"{name}-pairs", pairs.distinct())
        # Texts lie in buckets: pairs come to those of b, whose texts move on to the distinct ones of a. A common a may be split there,
        # as both sides are shuffled.
        heads = self.scratch.write(f"{name}-heads", self.texts.join(pairs.select(F.col("a").alias("id")).distinct(), "id").select(F.col("id").alias("a"), F.col("body").alias("x")))
        both = pairs.join(self.texts.select(F.col("id").alias("b"), F.col("body").alias("y")), "b").join(heads, "a")
        n, percent = self.words, self.percent

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                bodies = dict(zip(batch["a"], batch["x"], strict=True)) | dict(zip(batch["b"], batch["y"], strict=True))
                sets = dict(zip(bodies, shingle_sets(list(bodies.values()), n), strict=True))
                keep = []
                for a, b in zip(batch["a"], batch["b"], strict=True):
                    p, q = sets[a], sets[b]
                    keep.append(linked(len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q), percent))
                yield batch.loc[keep, ["a", "b"]]

        out = self.scratch.write(name, both.select("a", "b", "x", "y").mapInPandas(run, "a long, b long"))
        self.scratch.drop(f"{name}-heads")
        return out

    def _components(self, links: DataFrame, name: str) -> DataFrame:
        """(rep, comp) of every class with a link, comp the smallest class reachable; by hooking and pointer jumping."""
        edges = self.scratch.write(f"{name}-0", links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
        parents = edges.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("p"))
        parents = self.scratch.write(f"{name}-p0", parents)
        step = 0
        while True:
            step += 1
            up = parents.select(F.col("a").alias("p"), F.col("p").alias("pp"))
            jumped = parents.join(up, "p").select("a", F.col("pp").alias("p"))
            near = edges.join(jumped.select(F.col("a").alias("b"), F.col("p").alias("q")), "b").groupBy("a").agg(F.min("q").alias("q"))
            # The root of a class hooks onto the least root that any of its members sees.
            seen = jumped.join(near, "a").select("a", "p", F.least("p", "q").alias("q"))
            seen = self.scratch.write(f"{name}-s{step}", seen)
            roots = seen.groupBy("p").agg(F.min("q").alias("r"))
            new = self.scratch.write(f"{name}-p{step}", seen.join(roots, "p").select("a", F.least("q", "r").alias("p"), (F.least("q", "r") != F.col("p")).alias("moved")))
            moved = new.where("moved").limit(1).count()
            self.scratch.drop(f"{name}-p{step - 1}", f"{name}-s{step}")
            parents = new.select("a", "p")
            if not moved:
                # Nothing moved on any edge or to any root: every pointer is a root.
                return parents.select(F.col("a").alias("rep"), F.col("p").alias("comp"))

    # Candidates

    def _alive(self, nodes: DataFrame, comps: DataFrame, name: str) -> DataFrame:
        """(node, rep, comp, size) of nodes with two components at least.

        Counts combine before they are shuffled; written down, they leave the join free to split a hot node.
        """
        known = nodes.join(comps, "rep", "left").select("node", "rep", F.coalesce("comp", "rep").alias("comp"))
        stats = known.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("size > 1 and lo < hi")
        return known.join(self.scratch.write(name, stats.select("node", "size")), "node")

    def _star(self, classes: DataFrame) -> DataFrame:
        """One pair for each class: the first member of a node that it shares most nodes with."""
        nodes = self._nodes(classes, STAR)
        first = nodes.groupBy("node").agg(F.min("rep").alias("a"), F.count(F.lit(1)).alias("size")).where("size > 1").select("node", "a")
        shared = nodes.join(self.scratch.write("star-first", first), "node").where("rep <> a").groupBy("rep", "a").count()
        return shared.groupBy(F.col("rep").alias("b")).agg(F.max_by("a", F.struct("count", -F.col("a"))).alias("a")).select("a", "b")

    def _small(self, members: DataFrame, classes: DataFrame) -> DataFrame:
        """(a, b, agree) of the candidates within small nodes."""
        least = self.least
        # One byte of each token goes along: equal tokens have equal bytes, so no candidate is lost, and one place in 256 agrees by chance.
        full = members.join(classes.select("rep", "bytes"), "rep").withColumnRenamed("bytes", "sketch")
        grouped = full.groupBy("node").agg(F.collect_list(F.struct("rep", "comp", "sketch")).alias("m"))
        lists = grouped.select(F.col("m.rep").alias("rep"), F.col("m.comp").alias("comp"), F.col("m.sketch").alias("sketch"))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for rep, comp, raw in batch.itertuples(index=False):
                    own = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, SKETCH)
                    i, j = np.triu_indices(len(own), 1)
                    apart = comp[i] != comp[j]
                    i, j = i[apart], j[apart]
                    agree = (own[i] == own[j]).sum(1)
                    good = agree >= least
                    out += [(min(a, b), max(a, b), c) for a, b, c in zip(rep[i[good]], rep[j[good]], agree[good], strict=True)]
                yield pd.DataFrame(out, columns=["a", "b", "agree"])

        return lists.mapInPandas(run, "a long, b long, agree int")

    def _large(self, members: DataFrame) -> DataFrame:
        """Confirmed links within large nodes at the deepest level: members outside the main component against all, in blocks."""
        counts = members.groupBy("node", "comp", "size").count()
        main = counts.groupBy("node").agg(F.max_by("comp", F.struct("count", -F.col("comp"))).alias("main"), F.max("size").alias("size"), F.max("count").alias("n_main"))
        own = members.select("node", "rep", "comp").join(main, "node")
        blocks = F.greatest(F.lit(1), F.ceil(F.col("size") / BLOCK)).cast("int")
        minors = F.greatest(F.lit(1), F.ceil((F.col("size") - F.col("n_main")) / BLOCK)).cast("int")
        own = own.withColumn("x", F.pmod(F.xxhash64("rep"), blocks)).withColumn("z", F.pmod(F.xxhash64("rep", F.lit(1)), minors)).withColumn("minor", F.col("comp") != F.col("main"))
        everyone = own.select("node", "rep", "comp", "x", F.explode(F.sequence(F.lit(0), minors - 1)).alias("z"), F.lit(False).alias("minor"))
        asking = own.where("minor").select("node", "rep", "comp", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("x"), "z", "minor")
        rows = everyone.unionByName(asking).withColumnRenamed("rep", "id").join(self.texts, "id")
        n, percent = self.words, self.percent

        def run(group: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame(block_links(group["id"].to_numpy(), group["comp"].to_numpy(), group["minor"].to_numpy(), shingle_sets(group["body"].tolist(), n), percent), columns=["a", "b"])

        return rows.groupBy("node", "x", "z").applyInPandas(run, "a long, b long").distinct()

    def components(self) -> DataFrame:
        s = self.scratch
        # Confirmation reads texts by identifier several times: in buckets they move once, and joins bring only identifiers.
        docs, base, apart = self._apart(s.write("sketches", self._sketched()))
        self.texts = s.buckets("texts", base, "id")
        groups = docs.groupBy("digest").agg(F.min("id").alias("rep"), F.max("n").alias("n"), F.first("sketch").alias("sketch"), F.first("bytes").alias("bytes"))
        classes = s.write("classes", groups.where("n > 0").select("rep", "n", "digest", "sketch", "bytes").repartition(partitions(self.spark)))
        star = self._confirmed(self._star(classes), "star")
        comps = self._components(star, "star-comp")
        links = star
        self.found: list[DataFrame] = []
        for depth in range(1, DEPTH + 1):
            # Only members of nodes that were too large a level above go on; their nodes have grown finer.
            pool = classes if depth == 1 else classes.join(s.write(f"open-{depth}", large.select("rep").distinct()), "rep", "left_semi")  # noqa: F821
            members = s.write(f"members-{depth}", self._alive(self._nodes(pool, depth), comps, f"sizes-{depth}"))
            large = members.where(F.col("size") > SMALL)
            self.found.append(s.write(f"found-{depth}", self._small(members.where(F.col("size") <= SMALL), classes)))
            if large.isEmpty():
                break
        else:
            links = links.union(s.write("large", self._large(large)))
        found = self.found[0]
        for more in self.found[1:]:
            found = found.union(more)
        pairs = s.write("candidates", found.groupBy("a", "b").agg(F.max("agree").alias("agree")))
        best = pairs.groupBy("b").agg(F.max_by("a", F.struct("agree", -F.col("a"))).alias("a")).select("a", "b")
        links = links.union(self._confirmed(best, "best"))
        comps = self._components(links, "best-comp")
        ca, cb = (comps.select(F.col("rep").alias(x), F.col("comp").alias(f"c{x}")) for x in "ab")
        open_ = pairs.join(best, ["a", "b"], "left_anti").join(ca, "a", "left").join(cb, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b"))
        more = self._confirmed(open_.select("a", "b"), "rest")
        if not more.isEmpty():
            comps = self._components(links.union(more), "all-comp")
        s.drop("texts")
        wide = classes.select("digest", "rep").join(comps, "rep", "left").select("digest", F.coalesce("comp", "rep").alias("component_id"))
        out = docs.select("id", "doc", "n", "digest").join(wide, "digest", "left")
        out = out.select("id", "doc", "n", F.coalesce("component_id", "id").alias("to"))
        if apart:  # the least given identifier of each component
            out = out.join(s.write("least", out.groupBy("to").agg(F.min("doc").alias("least"))), "to").select(F.col("doc").alias("id"), "n", F.col("least").alias("to"))
        return out.select(_known("id").alias("doc_id"), F.col("n").alias("n_shingles"), _known("to").alias("component_id"), (F.col("id") == F.col("to")).alias("kept"))


def block_links(ids: np.ndarray, comps: np.ndarray, minor: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between minor rows and rows of another component, by exact intersection counts of one block.

    One link for each minor row and component suffices for components, so no more are returned.
    """
    asking, others = np.flatnonzero(minor), np.flatnonzero(~minor)
    if not len(asking) or not len(others):
        return []
    sizes = np.array([len(x) for x in sets], np.int64)
    item, at = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    often = np.bincount(at, minlength=len(item)) > 1
    place = np.cumsum(often) - 1
    at, row = place[at[often[at]]], row[often[at]]
    width, both = 4096, np.zeros((len(asking), len(others)), np.int64)
    for first in range(0, int(often.sum()), width):
        here = (at >= first) & (at < first + width)
        grid = np.zeros((len(sets), width), np.float32)
        grid[row[here], at[here] - first] = 1
        both += np.rint(grid[asking] @ grid[others].T).astype(np.int64)
    union = sizes[asking][:, None] + sizes[others][None, :] - both
    i, j = np.nonzero((100 * both >= percent * union) & (comps[asking][:, None] != comps[others][None, :]))
    out = {}
    for a, b in zip(asking[i], others[j], strict=True):
        out.setdefault((ids[a], comps[b]), (min(ids[a], ids[b]), max(ids[a], ids[b])))
    return list({(int(a), int(b)) for a, b in out.values()})


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, words: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; the smallest identifier of a component stays."""
    return ChosenPathJoin(documents, key, text, similarity, words).components()
