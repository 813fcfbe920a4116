"""N-gram Jaccard self-join of documents by filtering under several global orders.

A document is the set of its distinct word shingles.  Two sets that share k
tokens or more share one of the first ``n - k + 1`` of either in *any* global
order of tokens.  Candidates come from the prefixes under a first order and stay
only if their prefixes under every further order meet as well; the filters are
intersected before exact sets are compared.  What is joined are classes of
copies, first within groups of near copies, then across them.

* *Exact copies* (equal sets) collapse to one class each.
* *Homes.*  Classes share keys (minimum hashes); a key is led by the class whose
  keys most others have, which in a group of near copies is the text that the
  others were made from, or one close to it.  A class that agrees with such a
  leader in several keys, and then in enough of its tokens, has it as its home.
* *Within a home* a set is written as its difference from the leader's: ``r``
  tokens that it lacks and ``a`` that it adds.  With the cost
  ``c = 100 r + p a`` two members x and y, whose differences share s tokens,
  are linked exactly when ``(100 + p) s >= c_x + c_y - (100 - p) |leader|``.
  Members with c of at most ``(100 - p) |leader|`` are linked with the leader,
  so only pairs with a member beyond that are looked for, and these must
  share more than half of the smaller difference.  Text that the whole home has
  in common is in no difference, so however many copies a group has, they
  do not meet on it.
* *Across homes* documents go on whose longer prefix, under the order of token
  hashes, is shared with other homes as far as a link needs.  Among them tokens
  are counted exactly and ranked by frequency, those of one home only first.
* *Orders.*  The join runs over prefixes by ascending frequency, with the bound
  of each pair's own sizes on both places; then the prefixes under the other
  (seeded) orders have to meet, too; then the sets are intersected in full.

Everything is exact but for tokens: 64-bit hashes, unequal ones of a pair
of texts meeting by chance with 2**-64.  Homes only decide where a pair is
looked for: every pair is, in its home or across homes.

Defined results: texts without words (also null or empty) have no shingles and
link with nothing; shorter texts than a shingle are one shingle of all their
words; rows with equal ids are one node of the link graph, with the links of
all their sets; rows with a null id keep a null component and link with nothing;
an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, handing_back, keep_possible_ids, text_batches, written
from .components import connected_components
from .hashing import find_words, hash_words, mix

#: Minimum hashes of a set, and how many must lead to the same leader.
KEYS, SAME_KEYS = 8, 2
#: Percent of similarity with its leader below which a set has no home.
ALIKE = 40

_U = np.uint64
_P = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
#: Seeds of the orders and of the keys.
_SEEDS = [_U(0xA0761D6478BD642F + 0x9E3779B97F4A7C15 * k & 0xFFFFFFFFFFFFFFFF) for k in range(16)]


def shingle_sets(texts: list[bytes | None], size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word shingles of each text."""
    lengths = np.array([len(text or b"") + 1 for text in texts], np.int64)
    raw, starts, ends = find_words(b"\n".join([text or b"" for text in texts]).lower())
    h = hash_words(raw, starts, ends)
    upto = np.searchsorted(starts, np.cumsum(lengths))
    total = h * _P[0]
    for k in range(1, size):
        total[: len(h) - k] = (total[: len(h) - k] ^ (total[: len(h) - k] >> _U(29))) * _P[k % 4] + h[k:]
    total = mix(total + _U(size))
    out, begin = [], 0
    for end in upto.tolist():
        if end - begin >= size:
            out.append(np.unique(total[begin : end - size + 1]))
        elif end > begin:  # fewer words than a shingle: all of them
            short = h[begin : begin + 1] * _P[0]
            for k in range(begin + 1, end):
                short = (short ^ (short >> _U(29))) * _P[(k - begin) % 4] + h[k : k + 1]
            out.append(mix(short + _U(end - begin)))
        else:
            out.append(np.empty(0, np.uint64))
        begin = end
    return out


def prefix_length(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def further(n: int, percent: int) -> int:
    """Tokens that the longer prefix has beyond the prefix.

    Prefixes that are longer by l - 1 tokens share l tokens at least, so a
    document has a link only if that many tokens of its longer prefix occur
    elsewhere; one passage in common with others is not enough.
    """
    return min(prefix_length(n, percent) // 2, -(-n * percent // 100) - 1)


def _least_shared(n: str, percent: int) -> str:
    """SQL: how many tokens of a longer prefix a link shares at least; the smaller of both texts decides."""
    smaller = f"(({n} * {percent} + 99) div 100)"
    still = f"(({smaller} * {percent} + 99) div 100)"
    return f"(1 + least(({smaller} - {still} + 1) div 2, {still} - 1))"


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays)))


def _digest(tokens: np.ndarray) -> bytes | None:
    import xxhash

    return xxhash.xxh3_128_digest(tokens.tobytes()) if len(tokens) else None


def _orders(tokens: np.ndarray, length: int, orders: int) -> list[np.ndarray]:
    """The first ``length`` tokens under each further order, as 32-bit hashes."""
    out = []
    for k in range(1, orders):
        ranks = mix(tokens ^ _SEEDS[8 + k])
        chosen = tokens if length >= len(tokens) else tokens[np.argpartition(ranks, length - 1)[:length]]
        out.append(chosen.astype(np.uint32).view(np.int32))
    return out


def _sets(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Per document its set's size and digest, KEYS keys, and the longer prefix under the order of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd = [s | _U(1) for s in _SEEDS[:KEYS]]
        for batch, texts in text_batches(batches, 1):
            sets = shingle_sets(texts, size)
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            keys = [np.zeros(len(sets), np.int64) for _ in odd]
            if len(full):
                every, at = np.concatenate([sets[i] for i in full]), np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
                for k, factor in enumerate(odd):
                    keys[k][full] = mix(np.minimum.reduceat(every * factor, at) + _SEEDS[k]).view(np.int64)
            prefixes = [s[: prefix_length(len(s), percent) + further(len(s), percent)].view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array([_digest(s) for s in sets], pa.binary()), *map(pa.array, keys), _lists(prefixes)], names=names)

    key_names = [f"key{k}" for k in range(KEYS)]
    names = ["doc_id", "n", "set_hash", *key_names, "prefix"]
    return docs.mapInArrow(handing_back(run), f"doc_id bigint, n bigint, set_hash binary, {', '.join(f'{k} bigint' for k in key_names)}, prefix array<bigint>")


def _homes(nodes: DataFrame) -> DataFrame:
    """(rep, home): the most central leader that a class shares keys with, where that is not itself."""
    keyed = nodes.select("rep", F.explode(F.array(*(f"key{k}" for k in range(KEYS)))).alias("key"))
    counts = written(keyed.groupBy("key").agg(F.count("*").alias("times")).where("times > 1"), "join-keys")
    shared = keep_possible_ids(keyed, "key", counts, "key").join(counts.hint("merge"), "key")
    # A class has KEYS rows at most.
    score = F.sum(F.round(16 * F.log2("times")).cast("bigint")).over(Window.partitionBy("rep"))
    shared = written(shared.select("rep", "key", score.alias("score")), "join-scores")
    lead = shared.groupBy("key").agg(F.max(F.struct("score", (-F.col("rep")).alias("order"))).alias("lead"))
    led = shared.join(lead.hint("merge"), "key").select("rep", "lead").repartition("rep")
    most = led.groupBy("rep", "lead").agg(F.count("*").alias("times")).where(f"times >= {SAME_KEYS} or rep = -lead.order").groupBy("rep").agg(F.max("lead").alias("lead"))
    homes = written(most.select("rep", (-F.col("lead.order")).alias("home")).where("rep <> home"), "join-homes")
    discard(counts, shared)
    return homes


def _texts(docs: DataFrame, ids: DataFrame, repeated: DataFrame | None) -> DataFrame:
    """(doc_id, text) of the given ids (column doc_id, distinct), equal rows once."""
    # An inner join, as a semi-join would be planned below the filter and shuffle every text.  Tables of ids and of
    # tokens grow with the corpus: they are merged at every size, never sent through the driver.
    found = keep_possible_ids(docs, "doc_id", ids, "doc_id").join(ids.hint("merge"), "doc_id")
    if repeated is None:
        return found
    again = F.broadcast if repeated.count() < 100_000 else (lambda x: x)
    return found.join(again(repeated), "doc_id", "left_anti").unionByName(found.join(again(repeated), "doc_id", "left_semi").distinct())


def _deltas(docs: DataFrame, homes: DataFrame, repeated: DataFrame | None, size: int, percent: int, orders: int) -> DataFrame:
    """Members of homes (rep, home, n_home, cost, least: tokens shared with a partner) with their difference from the leader.

    Tokens are salted by home, one to one within it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaders: dict[int, np.ndarray] = {}
        kept = 0
        for batch, texts in text_batches(batches, 2):
            ids, homes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            new = {home: k for k, home in enumerate(homes) if home not in leaders}
            if new:
                if kept > 4_000_000:
                    leaders, kept = {}, 0
                    new = {home: k for k, home in enumerate(homes)}
                for home, k in new.items():
                    leaders[home] = shingle_sets([batch.column(3)[k].cast(pa.binary()).as_py()], size)[0]
                    kept += len(leaders[home])
            rows, deltas, prefixes = [], [], [[] for _ in range(orders - 1)]
            for rep, home, tokens in zip(ids, homes, shingle_sets(texts, size), strict=True):
                lead = leaders[home]
                every, times = np.unique(np.concatenate([lead, tokens]), return_counts=True)
                once = every[times == 1]
                both = len(every) - len(once)
                if 100 * both < ALIKE * len(every):
                    continue
                lacks, adds = len(lead) - both, len(tokens) - both
                cost, limit = 100 * lacks + percent * adds, (100 - percent) * len(lead)
                least = -(-(cost - limit) // 100) if cost > limit else (cost + 100 + percent) // (100 + percent)
                rows.append((rep, home, len(lead), cost, max(1, least)))
                salted = mix(once + mix(np.array([home]).astype(np.uint64)))
                deltas.append(salted.view(np.int64))
                for k, chosen in enumerate(_orders(salted, max(1, len(once) - max(1, least) + 1), orders)):
                    prefixes[k].append(chosen)
            if rows:
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in zip(*rows, strict=True)), _lists(deltas), *map(_lists, prefixes)], names=names)

    ids = homes.select(F.col("rep").alias("doc_id")).union(homes.select("home")).distinct()
    texts = written(_texts(docs, ids, repeated), "join-texts")
    members = texts.join(homes.withColumnRenamed("rep", "doc_id").hint("merge"), "doc_id")
    rows = members.hint("merge").join(texts.select(F.col("doc_id").alias("home"), F.col("text").alias("leader")), "home").select("doc_id", "home", "text", "leader")
    others = [f"order{k}" for k in range(1, orders)]
    names = ["rep", "home", "n_home", "cost", "least", "delta", *others]
    found = written(rows.mapInArrow(handing_back(run), f"rep bigint, home bigint, n_home bigint, cost bigint, least bigint, delta array<bigint>, {', '.join(f'{o} array<int>' for o in others)}"), "join-deltas")
    discard(texts)
    if repeated is not None:  # texts of one id and set
        found = written(found.dropDuplicates(["rep"]), "join-deltas")
    return found


def _ranked(rows: DataFrame, counts: DataFrame, by: list[str], n: str, least: Column) -> DataFrame:
    """Rows (by, token) within the prefix that a partner with ``least`` common tokens needs, by ascending frequency.

    ``counts`` (token, df) has the tokens that can be shared at all; the others come first.
    """
    rows = keep_possible_ids(rows, "token", counts, "token").join(counts.hint("merge"), "token")
    of_set = Window.partitionBy(*by)
    place = F.row_number().over(of_set.orderBy("df", "token")) + F.col(n) - F.count("*").over(of_set)
    return rows.withColumn("place", place).where(F.col("place") <= F.col(n) - least + 1).drop("df")


def _orders_meet(orders: int) -> Column:
    meet = F.lit(True)
    for k in range(1, orders):
        meet = meet & F.arrays_overlap(f"x.order{k}", f"y.order{k}")
    return meet


def _home_links(deltas: DataFrame, percent: int, orders: int) -> DataFrame:
    """Links (a, b) that join the members of homes as far as links within them do."""
    limit = f"{100 - percent} * n_home"
    deltas = deltas.withColumn("far", F.expr(f"cost > {limit}")).withColumn("n", F.size("delta").cast("bigint"))
    near = deltas.where("not far").select(F.col("rep").alias("a"), F.col("home").alias("b"))
    rows = deltas.select("rep", "home", "n_home", "cost", "least", "far", "n", F.explode("delta").alias("token"))
    counts = written(rows.groupBy("token").agg(F.count("*").alias("df"), F.max("far").alias("any_far")).where("df > 1 and any_far").select("token", "df"), "join-delta-tokens")
    prefix = written(_ranked(rows, counts, ["rep"], "n", F.col("least")), "join-delta-prefix")
    # At least one of a pair is far from the leader.
    need = f"int((x.cost + y.cost - {100 - percent} * x.n_home + {99 + percent}) div {100 + percent})"
    pairs = (
        prefix.where("far").alias("x")
        .join(prefix.alias("y"), F.expr(f"x.token = y.token and x.home = y.home and x.rep <> y.rep and (not y.far or x.rep < y.rep) and x.place <= x.n - {need} + 1 and y.place <= y.n - {need} + 1"))
        .select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
        .distinct()
    )
    pairs = written(pairs, "join-home-candidates")
    some = deltas.join(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "rep", "left_semi")
    met = pairs.join(some.alias("x"), F.expr("a = x.rep")).join(some.alias("y"), F.expr("b = y.rep")).where(_orders_meet(orders))
    far = written(met.where(F.expr(f"size(array_intersect(x.delta, y.delta)) >= {need}")).select("a", "b"), "join-home-links")
    discard(counts, prefix, pairs)
    return near.union(far)


def _token_sets(texts: DataFrame, size: int, percent: int, orders: int) -> DataFrame:
    """The whole sets of (doc_id, text) with their prefixes under the further orders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in text_batches(batches, 1):
            sets = shingle_sets(found, size)
            prefixes = [_orders(s, prefix_length(len(s), percent), orders) for s in sets]
            columns = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.binary()), _lists([s.view(np.int64) for s in sets])]
            yield pa.RecordBatch.from_arrays([*columns, *(_lists([p[k] for p in prefixes]) for k in range(orders - 1))], names=names)

    others = [f"order{k}" for k in range(1, orders)]
    names = ["doc_id", "n", "set_hash", "tokens", *others]
    return texts.mapInArrow(handing_back(run), f"doc_id bigint, n bigint, set_hash binary, tokens array<bigint>, {', '.join(f'{o} array<int>' for o in others)}")


def _mixed(rows: DataFrame, group: str = "grp") -> DataFrame:
    """The tokens of rows that occur in more than one group."""
    return rows.groupBy("token").agg(F.min(group).alias("low"), F.max(group).alias("high")).where("low <> high").select("token")


def _sharing(rows: DataFrame, percent: int, label: str, group: str = "grp") -> DataFrame:
    """doc_id of the rows (doc_id, n, group, token) of longer prefixes that share as many tokens with other groups as a link needs."""
    mixed = written(_mixed(rows, group), f"{label}-tokens")
    shared = keep_possible_ids(rows, "token", mixed, "token").join(mixed.hint("merge"), "token").groupBy("doc_id", "n").agg(F.count("*").alias("shared"))
    found = written(shared.where(f"shared >= {_least_shared('n', percent)}").select("doc_id").distinct(), label)
    discard(mixed)
    return found


def _cross_links(sets: DataFrame, known: DataFrame, docs: DataFrame, repeated: DataFrame | None, size: int, percent: int, orders: int) -> DataFrame:
    """Links (a, b) between classes of different homes.

    ``known`` (set_hash, rep, grp) has the classes of several rows or with a home; any other stands for itself.
    """
    # Documents that share enough of the longer prefix under the order of hashes with other sets, and of these with
    # other homes; the first needs no join with homes.  Equal sets have equal halves of their digests.
    half = F.conv(F.substring(F.hex("set_hash"), 1, 15), 16, 10).cast("bigint")
    near = _sharing(sets.select("doc_id", "n", half.alias("part"), F.explode("prefix").alias("token")), percent, "join-near", "part")
    some = keep_possible_ids(sets, "doc_id", near, "doc_id").join(near.hint("merge"), "doc_id").join(known.hint("merge"), "set_hash", "left").where("rep is null or rep = doc_id")
    involved = _sharing(some.select("doc_id", "n", F.coalesce("grp", "doc_id").alias("grp"), F.explode("prefix").alias("token")), percent, "join-involved")

    whole = _token_sets(_texts(docs, involved, repeated), size, percent, orders)
    if repeated is not None:  # texts of one id and set
        whole = whole.dropDuplicates(["doc_id", "set_hash"])
    whole = written(whole.join(known.hint("merge"), "set_hash", "left").where("rep is null or rep = doc_id").withColumn("grp", F.coalesce("grp", "doc_id")).drop("rep"), "join-sets")
    rows = whole.select("set_hash", "doc_id", "n", "grp", F.explode("tokens").alias("token"))
    counts = rows.groupBy("token").agg(F.count("*").alias("df"), F.min("grp").alias("low"), F.max("grp").alias("high")).where("low <> high").select("token", "df")
    counts = written(counts, "join-tokens")
    prefix = written(_ranked(rows, counts, ["set_hash", "doc_id"], "n", F.expr(f"(n * {percent} + 99) div 100")), "join-prefix")
    # A token may be one home's but for a few rows: these meet all rows, and the home's rows not each other.
    of_group = prefix.groupBy("token", "grp").agg(F.count("*").alias("times"))
    major = of_group.groupBy("token").agg(F.max_by("grp", F.struct("times", "grp")).alias("major"), F.count("*").alias("groups")).where("groups > 1").select("token", "major")
    prefix = written(prefix.join(major, "token"), "join-meeting")
    need = f"int(({percent} * (x.n + y.n) + {99 + percent}) div {100 + percent})"
    pairs = (
        prefix.where("grp <> major").alias("x")
        .join(
            prefix.alias("y"),
            F.expr(
                f"x.token = y.token and x.grp <> y.grp and (y.grp = y.major or x.set_hash < y.set_hash) and 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"
                f" and x.place <= x.n - {need} + 1 and y.place <= y.n - {need} + 1"
            ),
        )
        .select(F.col("x.set_hash").alias("a"), F.col("y.set_hash").alias("b"))
        .distinct()
    )
    pairs = written(pairs, "join-candidates")
    some = whole.join(pairs.select(F.explode(F.array("a", "b")).alias("set_hash")).distinct(), "set_hash", "left_semi")
    light = some.select("set_hash", *(f"order{k}" for k in range(1, orders)))
    met = written(pairs.join(light.alias("x"), F.expr("a = x.set_hash")).join(light.alias("y"), F.expr("b = y.set_hash")).where(_orders_meet(orders)).select("a", "b"), "join-met")
    both = met.join(some.alias("x"), F.expr("a = x.set_hash")).join(some.alias("y"), F.expr("b = y.set_hash"))
    links = written(both.where(F.expr(f"size(array_intersect(x.tokens, y.tokens)) >= {need}")).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct(), "join-links")
    discard(near, involved, whole, counts, prefix, pairs, met)
    return links


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, percent: int = 85, orders: int = 3
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Documents link when ``100 * |A & B| >= percent * |A | B|`` for their sets of
    ``size``-word shingles; component_id is the smallest id reachable by links.
    """
    docs = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sets = written(_sets(docs, size, percent), "join-rows")
    named = sets.where("doc_id is not null and n > 0")
    keys = [f"key{k}" for k in range(KEYS)]
    nodes = written(named.groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), *(F.min(k).alias(k) for k in keys)), "join-classes")

    # Ids of several rows are nodes that tie their sets; where these differ, they have no home.
    of_id = sets.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("set_hash").alias("low"), F.max("set_hash").alias("high"))
    several = written(of_id.where("rows > 1"), "join-repeated")
    repeated = None if several.isEmpty() else several.select("doc_id")
    settled, ties = nodes, None
    if repeated is not None:
        unlike = several.where("low <> high").select("doc_id")
        settled = nodes.join(unlike, nodes["rep"] == unlike["doc_id"], "left_anti")
        ties = named.join(repeated, "doc_id").join(nodes, "set_hash").where("doc_id <> rep").select("doc_id", "rep").distinct()

    homes = _homes(settled)
    deltas = _deltas(docs, homes, repeated, size, percent, orders)
    links = _home_links(deltas, percent, orders)
    known = nodes.join(deltas.select("rep", "home"), "rep", "left").where("copies > 1 or home is not null")
    known = written(known.select("set_hash", "rep", F.coalesce("home", "rep").alias("grp")), "join-known")
    links = links.union(_cross_links(named.select("set_hash", "doc_id", "n", "prefix"), known, docs, repeated, size, percent, orders))
    final = written(connected_components(links if ties is None else links.union(ties)), "join-components")
    discard(nodes, several, homes, deltas)

    of_set = sets.select("doc_id", F.col("n").alias("n_shingles"), F.expr("if(doc_id is null, null, set_hash)").alias("set_hash")).join(known.select("set_hash", "rep"), "set_hash", "left")
    of_set = of_set.select("doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("rep"))
    return of_set.join(final, of_set["rep"] == final["node"], "left").select("doc_id", "n_shingles", F.expr("if(doc_id is null, null, coalesce(component, rep))").alias("component_id"))
