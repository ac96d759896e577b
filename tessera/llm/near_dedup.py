"""Near-duplicate detection by a chosen-path set similarity join.

A document's set holds 64-bit hashes of its distinct word shingles. `TREES` independent trees branch the documents: every level of a tree has
CHOICE minwise coordinates of its own, of which the node's own hash chooses two, and a document goes to one child for each, named by its
minwise token there. So no coordinate comes twice on a path, and a node of depth d holds what agrees in d of them. Five trees miss one pair in about
520,000 at the threshold itself if it is compared at depth 3, 340,000 at depth 4 and 170,000 at depth 8 (`tests/llm` counts it, shared coordinates included), and fewer above it.

First each large node compares its members with two pivots (stars: as many pairs as members, never all pairs); then, level by level,
small nodes are compared exhaustively and large ones branch again. After every LEVELS levels the large nodes are searched for dense members, those
with a similarity of HOME or more to the node's pivot: tokens that they all share would never part them, so they branch by the rarest tokens of their
difference from the pivot instead, meet all members that differ from it alike, and leave the node. What is left has little in common and goes on with fresh
coordinates; at LAST_DEPTH all members count as dense. No pair of a node is lost on the way, whatever its size.
A sketch of 128 two-bit minwise values throws out
dissimilar pairs before they are written; what remains is confirmed on the full sets, in tasks keyed by one document of the pair and
salted where it has many partners. Confirmed links merge components (large-star / small-star, as joins), and a node whose
members are all in one component needs no more comparing: so a huge group of near copies collapses after its first star.
A pair is missed only if no tree keeps it together down to the node where it would be compared, or a sketch is 4.4 deviations off.
Texts with equal sets are one representative throughout.

Defined cases: null, empty or blank texts have the empty set, are linked with nothing and keep themselves; rows that share a
doc_id count as one vertex with the links of all its rows; rows with a null doc_id come back with a null component, kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, small, table, written

TREES, LEVELS, CHOICE, SKETCH, FIRST_DEPTH, LAST_DEPTH = 5, 4, 4, 128, 3, 8
#: 16-bit tokens of a tree, four to a long, for LEVELS levels.
POOL = LEVELS * CHOICE
POOLS = [f"pool{i}" for i in range(POOL // 4)]
SMALL_NODE, FAN, HOME = 16, 256, 60
#: Rows that a Python task works on at a time.
BLOCK = 256
#: Tokens in fewer differences of a node than this are all counted as rare.
COMMON = 32
#: Up to so many members with so many tokens in their differences meet in one task, all pairs counted at once; what is larger meets by its tokens.
WHOLE, WHOLE_TOKENS = 512, 1 << 18
#: Tokens whose holders are multiplied at a time.
COLUMNS = 4096
#: A sketch passes if its agreement is at most so many standard deviations below that of the threshold: of 128 two-bit minwise
#: values, 108.8 +- 4.0 agree at similarity 0.8, and 91 must.
SIGMAS = 4.4
SKETCHES = [f"sketch{i}" for i in range(SKETCH // 32)]
_MIX, _ROT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Hashes(dict):
    """64-bit hash of each word, computed once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _final(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, size: int, seen: Hashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of `size` words, A-Z lower-cased; the whole sequence if it is shorter."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter((seen[w] for w in found), np.uint64, len(found))
    width = min(size, len(h))
    out = np.full(len(h) - width + 1, np.uint64(width))
    for i in range(width):
        out = _final(out * _MIX + h[i : len(h) - width + 1 + i]) * _ROT
    return np.unique(out)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _coefficients(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)


def _minima(sets: list[np.ndarray], a: np.ndarray) -> np.ndarray:
    """The minwise values of each set, one a coefficient; those of an empty set mean nothing."""
    n = np.array([len(s) for s in sets], np.int64)
    full, mins = np.flatnonzero(n), np.zeros((len(sets), len(a)), np.uint64)
    if len(full):
        flat, at = np.concatenate([sets[i] for i in full]), np.concatenate([[0], np.cumsum(n[full])[:-1]])
        for j in range(len(a)):
            mixed = flat * a[j]
            mixed ^= mixed >> np.uint64(32)
            mins[full, j] = np.minimum.reduceat(mixed, at)
    return _final(mins)


def _two_bits(mins: np.ndarray) -> np.ndarray:
    """Two bits of each value, 32 to a long."""
    pairs = (mins & np.uint64(3)).reshape(len(mins), mins.shape[1] // 32, 32)
    return sum(pairs[:, :, i] << np.uint64(2 * i) for i in range(32)).view(np.int64)


def sketch_least(values: int, percent: int) -> int:
    """How many of the two-bit values must agree."""
    p = 0.25 + 0.75 * percent / 100
    return int(values * p - SIGMAS * (values * p * (1 - p)) ** 0.5)


def _pools(mins: np.ndarray) -> np.ndarray:
    """(documents, TREES * len(POOLS)) of longs with four tokens each."""
    tokens = (mins & np.uint64(0xFFFF)).reshape(len(mins), TREES * len(POOLS), 4)
    return sum(tokens[:, :, i] << np.uint64(16 * i) for i in range(4)).view(np.int64)


def signatures(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """doc_id, text -> doc_id, n, key1, key2 (hash of the set), pools, SKETCHES."""
    seen, a = Hashes(), _coefficients(20240229, TREES * POOL + SKETCH)
    for batch in batches:
        for start in range(0, len(batch), BLOCK):
            part = batch.iloc[start : start + BLOCK]
            sets = [shingles(t, size, seen) for t in part["text"]]
            n, mins = [len(x) for x in sets], _minima(sets, a)
            sketch = _two_bits(mins[:, TREES * POOL :])
            keys = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
            yield pd.DataFrame({
                "doc_id": part["doc_id"].to_numpy(), "n": n, "key1": [_signed(k >> 64) for k in keys], "key2": [_signed(k & (1 << 64) - 1) for k in keys],
                "pools": list(_pools(mins[:, : TREES * POOL])), **{c: sketch[:, i] for i, c in enumerate(SKETCHES)},
            })


def fresh(batches: Iterator[pd.DataFrame], size: int, turn: int) -> Iterator[pd.DataFrame]:
    """id, text -> rep, key1 (of the set), pools: the coordinates of a later turn of LEVELS levels."""
    seen, a = Hashes(), _coefficients(20240229 + turn, TREES * POOL)
    for batch in batches:
        for start in range(0, len(batch), BLOCK):
            part = batch.iloc[start : start + BLOCK]
            sets = [shingles(t, size, seen) for t in part["text"]]
            keys = [_signed(xxhash.xxh3_128_intdigest(s.tobytes()) >> 64) for s in sets]
            yield pd.DataFrame({"rep": part["id"].to_numpy(), "key1": keys, "pools": list(_pools(_minima(sets, a)))})


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(x) + len(y) - both)


def verify(batches: Iterator[pd.DataFrame], size: int, percent: int) -> Iterator[pd.DataFrame]:
    """Rows of one (hub, salt) in a run, the hub's own text first: yields the pairs whose full sets reach the threshold."""
    seen, hub, own = Hashes(), None, []
    for batch in batches:
        found: list[tuple[int, int]] = []
        for h, salt, role, other, text in zip(batch["hub"], batch["salt"], batch["role"], batch["other"], batch["text"], strict=True):
            mine = shingles(text, size, seen)
            if role == 0:  # a doc_id with several rows has several sets
                hub, own = (h, salt), [*own, mine] if (h, salt) == hub else [mine]
            elif (h, salt) != hub:
                raise ValueError(f"no text for document {h}")
            elif any(similar(x, mine, percent) for x in own):
                found.append((h, other))
        yield pd.DataFrame(found, columns=["a", "b"], dtype="int64")


def _beside(pairs: DataFrame, texts: DataFrame, work: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], made: str) -> DataFrame:
    """work over the pairs (a, b), distinct and written: a run for each a, salted where it has many partners, its own text first; texts: id, text."""
    n = pairs.count()
    degree = pairs.groupBy("a").agg(F.ceil(F.count("*") / FAN).cast("int").alias("_salts"))
    spread = pairs.join(degree, "a").select(F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.col("_salts")).cast("int").alias("salt"), F.lit(1).alias("role"), F.col("b").alias("other"))
    hubs = degree.select(F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("a").alias("other"))
    asked = spread.unionByName(hubs)
    asked = written(asked)
    wanted = texts.join(small(asked.select(F.col("other").alias("id")).distinct(), 2 * n, 16), "id", "left_semi")
    held = asked.join(wanted, asked["other"] == wanted["id"]).select("hub", "salt", "role", "other", "text")
    return held.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "role").mapInPandas(work, made)


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets are similar enough."""
    return _beside(pairs, texts, lambda b: verify(b, size, percent), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id of an edge (a, b) that is not the smallest itself. Alternating large-star and small-star."""
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while not _flat(now):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = written(large.distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(low, "u")
        nxt = tied.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v")
        nxt = written(nxt.distinct())
        release(large)
        release(now)
        now = nxt
    return now.select(F.col("u").alias("id"), F.col("v").alias("component"))


def _flat(edges: DataFrame) -> bool:
    """Whether every u has one v, smaller than it, that is no u itself: each component is a star round its smallest id then, and no round changes it."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("up")))
    held = ends.groupBy("id").agg(F.sum("up").alias("ups"), F.count("*").alias("n"))
    return held.where("ups > 1 or (ups = 1 and n > 1)").count() == 0


def _children(node: Column, level: int) -> Column:
    """array<long>: the two children of a node of this level for a document with these tokens."""
    at = [(level % LEVELS) * CHOICE + i for i in range(CHOICE)]
    tokens = F.array(*[F.shiftrightunsigned(F.col(POOLS[i // 4]), 16 * (i % 4)).bitwiseAND(F.lit(0xFFFF)) for i in at])
    first = F.pmod(F.xxhash64(node, F.lit(1)), F.lit(CHOICE)).cast("int")
    second = F.pmod(first + 1 + F.pmod(F.xxhash64(node, F.lit(2)), F.lit(CHOICE - 1)), F.lit(CHOICE)).cast("int")
    return F.array(*[F.xxhash64(node, F.lit(level), i, F.get(tokens, i)) for i in (first, second)])


def _branch(rows: DataFrame, level: int) -> DataFrame:
    kept = [c for c in rows.columns if c != "node"]
    return rows.select(F.explode(_children(F.col("node"), level)).alias("node"), *kept)


def _of_tree(pools: Column) -> list[Column]:
    """The POOLS of tree t out of those of all trees."""
    return [F.get(pools, F.col("t") * len(POOLS) + i).alias(c) for i, c in enumerate(POOLS)]


def _alike(a: Callable[[str], Column], b: Callable[[str], Column], percent: int) -> Column:
    """Whether two sketches agree in enough values for a similarity of percent; a and b give the column of each part."""
    differ = lambda x: F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    first, *rest = [differ(a(c).bitwiseXOR(b(c))) for c in SKETCHES]
    return sum(rest, first) <= SKETCH - sketch_least(SKETCH, percent)


def _star(rows: DataFrame, order: Column, percent: int) -> DataFrame:
    """Pairs of each member of a node with the node's pivot, the member least in `order`."""
    pivots = rows.groupBy("node").agg(F.min_by(F.struct("rep", "label", *SKETCHES), F.struct(order, F.col("rep"))).alias("p"))
    met = rows.join(pivots, "node").where((F.col("label") != F.col("p.label")) & _alike(F.col, lambda c: F.col(f"p.{c}"), percent))
    return met.select(F.least("rep", "p.rep").alias("a"), F.greatest("rep", "p.rep").alias("b"))


def _stars(rows: DataFrame, percent: int) -> DataFrame:
    """In small nodes none is needed; large ones have a random pivot and the most central member.

    Central is who shares its nodes with most documents (`weight`): the original of a group of copies that each went their own way.
    """
    large = rows.where(F.col("size") > SMALL_NODE)
    return _star(large, -F.col("weight"), percent).unionByName(_star(large, F.xxhash64("rep", "node"), percent))


def _exhaustive(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs of different labels that share a node."""
    x, y = rows.select("node", "rep", "label", *SKETCHES), rows.select(F.col("node").alias("node2"), F.col("rep").alias("rep2"), F.col("label").alias("label2"), *[F.col(c).alias(f"{c}_2") for c in SKETCHES])
    on = (x["node"] == y["node2"]) & (x["rep"] < y["rep2"]) & (x["label"] != y["label2"]) & _alike(F.col, lambda c: F.col(f"{c}_2"), percent)
    return x.join(y, on).select(F.col("rep").alias("a"), F.col("rep2").alias("b"))


def differences(batches: Iterator[pd.DataFrame], size: int, guest: int) -> Iterator[pd.DataFrame]:
    """Rows as `verify` takes them: yields a, b, node (hash of the hub's set), key (of the other's), n, m (their sizes) and the tokens that only one of them holds, where the similarity is guest percent or more."""
    seen, hub, own = Hashes(), None, []
    for batch in batches:
        for start in range(0, len(batch), BLOCK):
            part, found = batch.iloc[start : start + BLOCK], []
            for h, salt, role, other, text in zip(part["hub"], part["salt"], part["role"], part["other"], part["text"], strict=True):
                mine = shingles(text, size, seen)
                key = _signed(xxhash.xxh3_64_intdigest(mine.tobytes()))
                if role == 0:
                    hub, own = (h, salt), [*own, (key, mine)] if (h, salt) == hub else [(key, mine)]
                elif (h, salt) != hub:
                    raise ValueError(f"no text for document {h}")
                else:
                    for node, s in own:
                        apart = np.setxor1d(s, mine, assume_unique=True)
                        if (100 + guest) * len(apart) <= (100 - guest) * (len(mine) + len(s)):
                            found.append((h, other, node, key, len(mine), len(s), apart.view(np.int64)))
            yield pd.DataFrame(found, columns=["a", "b", "node", "key", "n", "m", "diff"])


def among(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """The links (a, b) among the members of one node, from how many tokens each two of their differences share."""
    d, n, label, core = (group[c].to_numpy() for c in ("d", "n", "label", "core"))
    _, at, holders = np.unique(np.concatenate(group["diff"].to_list()), return_inverse=True, return_counts=True)
    member, kept = np.repeat(np.arange(len(d)), d), holders[at] > 1
    member, column = member[kept], (np.cumsum(holders > 1) - 1)[at[kept]]
    order = np.argsort(column, kind="stable")
    member, column, both = member[order], column[order], np.zeros((len(d), len(d)), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        low, high = np.searchsorted(column, (start, start + COLUMNS))
        held = np.zeros((len(d), COLUMNS), np.float32)
        held[member[low:high], column[low:high] - start] = 1
        both += held @ held.T
    apart = d[:, None].astype(np.int64) + d - 2 * both.astype(np.int64)
    x, y = np.nonzero(np.triu((apart * (100 + percent) <= (n[:, None] + n) * (100 - percent)) & (label[:, None] != label) & ~(core[:, None] & core), 1))
    rep = group["rep"].to_numpy()
    return pd.DataFrame({"a": rep[x], "b": rep[y]}, dtype="int64")


def _prefixed(held: DataFrame) -> DataFrame:
    """held (node, rep, key, diff, take, ...) -> token, pos of the `take` rarest tokens of diff; the order is the same in all of a node.

    Tokens that no other difference of the node holds keep their places, but bring nobody together and get no row.
    """
    kept = [c for c in held.columns if c not in ("diff", "take")]
    each = held.select(*kept, "take", F.explode("diff").alias("token"))
    shared = written(each.groupBy("node", "token").agg(F.count("*").alias("_n")).where("_n > 1"))
    marked = each.join(small(shared, shared.count(), 40), ["node", "token"], "left")
    order = F.struct(F.when(F.col("_n") >= COMMON, F.col("_n")).otherwise(F.lit(0)).alias("_c"), "token", F.col("_n").isNotNull().alias("_s"))
    ranked = marked.groupBy(*kept, "take").agg(F.sort_array(F.collect_list(order)).alias("_o"))
    placed = F.transform(F.slice("_o", F.lit(1), F.col("take")), lambda x, i: F.struct(x["token"].alias("token"), (i + 1).alias("pos"), x["_s"].alias("_s")))
    return ranked.select(*kept, F.explode(F.filter(placed, lambda x: x["_s"])).alias("_t")).select(*kept, "_t.token", "_t.pos")


def _met(x: DataFrame, y: DataFrame, on: Column, shared: Callable[[Column, Column], Column]) -> DataFrame:
    """Pairs of rows of two labels that meet at a token so early that enough tokens can follow; `on` is a further condition, y's columns end in _2."""
    other = y.select(*[F.col(c).alias(f"{c}_2") for c in y.columns])
    need = shared(F.col("slack"), F.col("slack_2"))
    early = lambda e: F.col(f"pos{e}") <= F.col(f"d{e}") - need + 1
    room = F.least("pos", "pos_2") + F.least(F.col("d") - F.col("pos"), F.col("d_2") - F.col("pos_2"))
    on = on & (F.col("dense") | F.col("dense_2"))
    both = x.join(other, (F.col("node") == F.col("node_2")) & (F.col("token") == F.col("token_2")) & (F.col("label") != F.col("label_2")) & on & early("") & early("_2") & (room >= need))
    return both.select("node", "rep", "key", "rep_2", "key_2")


def _settled(rows: DataFrame, texts: DataFrame, size: int, percent: int, home: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) of the dense members of the nodes of rows, and the rows without those members.

    Dense is what has a similarity of `home` percent or more to the node's pivot; all that it may be linked with is then as similar to the pivot but for
    what the threshold leaves, and is met whether or not it is dense itself. With D the tokens that only one of a member and the pivot holds,
    x and y differ in |Dx| + |Dy| - 2 |Dx and Dy| tokens. So members close to the pivot are linked with it, and two that are not are linked only if
    Dx and Dy share many tokens, of which one is among the rarest of either. What they have in common with the pivot
    no longer brings them together: a dense group costs its members, not their square. In nodes of WHOLE members at most all pairs are counted in one
    task instead, so that no token becomes a row.
    """
    pivots = rows.groupBy("node").agg(F.min_by(F.struct("rep", "which", "label", *SKETCHES), F.struct(-F.col("weight"), F.col("rep"))).alias("p"))
    guest = max(0, home - (100 - percent))
    met = rows.join(pivots, "node")
    met = met.where(_alike(F.col, lambda c: F.col(f"p.{c}"), guest)) if guest else met
    asked = written(met.select(F.col("p.rep").alias("a"), F.col("rep").alias("b"), "label", F.col("p.label").alias("top")).distinct())
    made = "a long, b long, node long, key long, n long, m long, diff array<long>"
    diffs = _beside(asked.select("a", "b"), texts, lambda b: differences(b, size, guest), made)
    diffs = written(diffs.withColumn("dense", F.size("diff") * (100 + home) <= (F.col("n") + F.col("m")) * (100 - home)))
    alone = diffs.dropDuplicates(["node", "b", "key"])
    slack = F.size("diff").cast("long") * (100 + percent) - F.col("n") * (100 - percent)
    near = slack <= F.col("m") * (100 - percent)
    held = alone.join(small(asked, asked.count(), 40), ["a", "b"]).withColumn("slack", slack).withColumn("core", near | (F.col("label") == F.col("top")))
    direct = held.where(near & (F.col("label") != F.col("top"))).select("a", "b")
    # the least number of tokens that differences of these slacks must share
    shared = lambda s, t: F.greatest(F.ceil((s + t) / F.lit(2 * (100 + percent))), F.lit(1)).cast("int")
    # a node without members beyond the core has no more links
    counted = held.groupBy("node").agg(F.min(F.when(~F.col("core"), F.col("slack"))).alias("low"), F.count("*").alias("members"), F.sum(F.size("diff")).alias("tokens")).where("low is not null")
    counted = written(counted.select("node", "low", ((F.col("members") <= WHOLE) & (F.col("tokens") <= WHOLE_TOKENS)).alias("few")))
    sized = held.join(small(counted, counted.count(), 24), "node").select("node", F.col("b").alias("rep"), "key", "n", "label", "core", "dense", "slack", "low", "few", F.size("diff").alias("d"), (-F.col("m") * (100 - percent)).alias("least"), "diff")
    in_task = sized.where("few").select("node", "rep", "n", "label", "core", "d", "diff").groupBy("node").applyInPandas(lambda g: among(g, percent), "a long, b long")
    direct = direct.unionByName(in_task)
    if not counted.where("not few").isEmpty():
        direct = direct.unionByName(_by_tokens(sized.where("not few").drop("few", "n"), alone, shared, percent))
    gone = diffs.where("dense").select(F.col("a").alias("_a"), F.col("b").alias("_b")).distinct()
    # a doc_id with several sets stays: one of them being dense says nothing of the others
    left = rows.join(pivots.select("node", F.when(F.col("p.which") == 0, F.col("p.rep")).alias("_p")), "node")
    left = left.join(gone, (left["_p"] == gone["_a"]) & (left["rep"] == gone["_b"]) & (left["which"] == 0), "left_anti").drop("_p")
    return direct.distinct(), left


def _by_tokens(sized: DataFrame, alone: DataFrame, shared: Callable[[Column, Column], Column], percent: int) -> DataFrame:
    """Links (a, b) among the members of large nodes: who meets at one of the rarest tokens of both differences is compared."""
    thin = F.col("d") - shared(F.col("slack"), F.col("low")) + 1
    wide = F.when(F.col("core"), thin).otherwise(F.col("d") - shared(F.col("slack"), F.col("least")) + 1)
    taken = written(_prefixed(sized.withColumn("take", wide).where("take > 0").drop("least")))
    outer, core = taken.where(~F.col("core")), taken.where("core")
    narrow = outer.where(F.col("pos") <= thin)
    # members of a token's commonest label do not meet each other
    most = narrow.groupBy("node", "token", "label").agg(F.count("*").alias("_n")).groupBy("node", "token").agg(F.max_by("label", F.struct("_n", "label")).alias("top"))
    pairs = _met(narrow.join(most, ["node", "token"]).where("label <> top"), narrow, (F.col("label_2") == F.col("top")) | (F.col("rep") < F.col("rep_2")), shared)
    pairs = written(pairs.unionByName(_met(outer, core, F.lit(True), shared)).distinct())
    side = lambda e: alone.select("node", F.col("b").alias(f"rep{e}"), F.col("key").alias(f"key{e}"), F.col("n").alias(f"n{e}"), F.col("diff").alias(f"diff{e}"))
    full = pairs.join(side(""), ["node", "rep", "key"]).join(side("_2"), ["node", "rep_2", "key_2"])
    apart = F.size("diff") + F.size("diff_2") - 2 * F.size(F.array_intersect("diff", "diff_2"))
    return full.where(apart * (100 + percent) <= (F.col("n") + F.col("n_2")) * (100 - percent)).select(F.col("rep").alias("a"), F.col("rep_2").alias("b"))


def _renewed(rows: DataFrame, texts: DataFrame, size: int, turn: int) -> DataFrame:
    """rows with the coordinates of a later turn."""
    known = written(rows.select(F.col("rep").alias("id"), "which").distinct())
    wanted = texts.join(small(known.select("id").distinct(), known.count(), 16), "id", "left_semi")
    made = wanted.mapInPandas(lambda b: fresh(b, size, turn), "rep long, key1 long, pools array<long>")
    # `which` is 0 but for the sets of a doc_id that has several
    sets = made.select("rep", F.explode(F.array(F.lit(0), "key1")).alias("which"), "pools").join(small(known.withColumnRenamed("id", "rep"), known.count(), 24), ["rep", "which"], "left_semi")
    one = written(sets.groupBy("rep", "which").agg(F.first("pools").alias("pools")))
    return rows.drop(*POOLS).join(one, ["rep", "which"]).select("*", *_of_tree(F.col("pools"))).drop("pools")


def _nodes(rows: DataFrame) -> DataFrame:
    """Rows of nodes that hold two labels or more, with the node's size."""
    held = rows.groupBy("node").agg(F.count("*").alias("size"), F.min("label").alias("_l"), F.max("label").alias("_h")).where("_l <> _h")
    return rows.join(held.select("node", "size"), "node")


def linked(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, set_rep (smallest doc_id with the same set), component_id, kept.

    Documents are linked if 100 * intersection >= percent * union of their sets of `size`-word shingles.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    made = "doc_id long, n long, key1 long, key2 long, pools array<long>, " + ", ".join(f"{c} long" for c in SKETCHES)
    signed = written(docs.where("doc_id is not null").mapInPandas(lambda b: signatures(b, size), made))
    null_ids = docs.where("doc_id is null")
    filled = signed.where("n > 0")
    classes = written(filled.groupBy("key1", "key2").agg(F.min("doc_id").alias("rep")))
    # a doc_id with several rows may stand for several sets; they are linked through it, and told apart by `which`
    members = filled.select("doc_id", "key1", "key2").join(classes, ["key1", "key2"]).select("doc_id", "rep")
    several = written(filled.groupBy("doc_id").agg((F.min("key1") != F.max("key1")).alias("_s")).where("_s").select(F.col("doc_id").alias("rep"), "_s"))
    first = filled.join(classes.withColumnRenamed("rep", "doc_id"), ["key1", "key2", "doc_id"]).groupBy("key1", "key2").agg(
        F.min("doc_id").alias("rep"), F.min_by(F.struct("pools", *SKETCHES), "doc_id").alias("s")
    )
    first = first.join(small(several, several.count(), 24), "rep", "left")
    first = written(first.select("rep", F.when(F.col("_s"), F.col("key1")).otherwise(F.lit(0)).alias("which"), "s.*"))
    rows = first.select("rep", "which", "pools", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("t"))
    rows = rows.select(F.xxhash64(F.lit("tree"), F.col("t")).alias("node"), "rep", "which", "t", *_of_tree(F.col("pools")))
    for level in range(FIRST_DEPTH):
        rows = _branch(rows, level)
    # what shares a node with another set is sought among bare ids: most nodes hold one
    bare = written(_nodes(rows.select("node", "rep", "which", "t", F.col("rep").alias("label"))))
    weighed = first.join(bare.groupBy("rep").agg(F.sum("size").alias("weight")), "rep")
    rows = bare.drop("size").join(weighed, ["rep", "which"]).select("node", "rep", "which", "t", "label", "weight", *_of_tree(F.col("pools")), *SKETCHES)
    texts = docs.where("doc_id is not null").select(F.col("doc_id").alias("id"), "text")
    links = tried = None

    def confirm(pairs: DataFrame) -> None:
        """Verify what has not been tried."""
        nonlocal links, tried
        new = pairs.distinct() if tried is None else pairs.distinct().join(tried, ["a", "b"], "left_anti")
        new = written(new)
        tried = new if tried is None else tried.unionByName(new)
        if not new.isEmpty():
            found = written(_confirmed(new, texts, size, percent))
            links = found if links is None else links.unionByName(found)

    depth = FIRST_DEPTH
    while True:
        rows = written(_nodes(rows))
        if rows.isEmpty():
            break
        if depth == FIRST_DEPTH:
            confirm(_stars(rows, percent))
            if links is not None:  # the one time that labels are brought up to date: they only save work, and large groups are joined by now
                joined = components(links)
                given = rows.drop("size").join(joined, rows["rep"] == joined["id"], "left").withColumn("label", F.coalesce("component", "label")).drop("id", "component")
                rows = written(_nodes(given))
        confirm(_exhaustive(rows.where(F.col("size") <= SMALL_NODE), percent))
        rows = rows.where(F.col("size") > SMALL_NODE)
        if rows.isEmpty():
            break
        if depth == LAST_DEPTH or depth % LEVELS == 0:
            settled, rows = _settled(rows, texts, size, percent, HOME if depth < LAST_DEPTH else 0)
            settled = written(settled)
            links = settled if links is None else links.unionByName(settled)
            if depth == LAST_DEPTH:
                break
            rows = written(_nodes(rows.drop("size")))
            if rows.isEmpty():
                break
            rows = _renewed(rows, texts, size, depth // LEVELS)
        rows, deeper = rows.drop("size"), min(depth + (1 if depth < LEVELS else 2), LAST_DEPTH)
        for level in range(depth, deeper):
            rows = _branch(rows, level)
        depth = deeper
    ties = members.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    joined = components(ties if links is None else ties.unionByName(links))
    out = signed.select("doc_id", F.col("n").alias("n_shingles"), "key1", "key2").join(classes, ["key1", "key2"], "left")
    out = out.join(joined, out["doc_id"] == joined["id"], "left").select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("set_rep"), F.coalesce("component", "doc_id").alias("component_id"))
    blank = null_ids.withColumn("doc_id", F.lit(0).cast("long")).mapInPandas(lambda b: signatures(b, size), made).select(F.lit(None).cast("long").alias("doc_id"), F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("set_rep"), F.lit(None).cast("long").alias("component_id"))
    return out.unionByName(blank).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Documents whose doc_id is the smallest of their component, with their own columns; rows with a null doc_id stay."""
    gone = written(linked(docs, size, percent).where("not kept").select("doc_id").distinct())
    return docs.join(small(gone, gone.count(), 16), "doc_id", "left_anti").select(*docs.columns)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicates over whole documents, on 2-word shingles at 0.8."""
    return linked(table(spark, sf_dir, "documents"), size=2, percent=80).select("doc_id", "n_shingles", "component_id", "kept", "set_rep")
