"""N-gram Jaccard join: a size-aware heavy-light join over sets of word shingles.

Equal sets are one class. Whatever the order of the tokens, if two different sets overlap by more
than half, they have two tokens in common, and so have the first n - ceil(0.8 n) + 2 of both. That is used twice. First with
the tokens whose hash falls into a fixed share of the hash space, rarest first, before all
others: a set with fewer than two tokens in that prefix that any other class has is done.
Then the whole sets of the rest are ordered by rarity among themselves. Small sets are joined
on every two-token subset of the prefix, large ones by scanning the inverted lists of its
single tokens; the size between them is where the summed cost is least. Pairs are verified
on whole sets.

For components not every pair is needed: in each list all are first compared with one pivot,
and only lists that still hold several components are compared in full. Lists with many common
classes, as of a large group of near copies, are not read pair by pair: their classes are dealt
into blocks, and the overlaps of two blocks are one product of their incidence matrices.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from careflow.llm.common import free, remove, slices, small, text_key, written
from careflow.llm.components import components
from careflow.llm.shingles import shingle_sets
from careflow.llm.vectors import grouped, merge

SHINGLE, PERCENT = 5, 80
# Share of the hash space whose tokens are counted over all documents and ordered by rarity.
COUNTED = 0.3
CUT = int(COUNTED * 2**64)
# Pivot rounds end when they no longer halve the pairs that are left, or after this many;
# what is left is compared in full either way.
PIVOT_ROUNDS = 4
# Cost of meeting another class of a list, against that of one row put into a list: rows are
# written and shuffled every turn, classes are met in memory, once for all the lists they have
# in common (in blocks), and most are never met because a pivot closes the list before.
SCANNED = 0.02

# Sets and tokens of a block, and tokens that a product takes at once.
BLOCK_SETS, BLOCK_TOKENS, AT_ONCE = 2048, 1 << 20, 4096

ROW = "rid bigint, doc_id bigint, text_key bigint, n bigint, d1 bigint, d2 bigint, counted bigint, prefix bigint, tokens array<bigint>"


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 2


def _digest(found: np.ndarray) -> tuple[int, int]:
    both = np.frombuffer(xxhash.xxh3_128_digest(found.tobytes()), "<i8")
    return int(both[0]), int(both[1])


def measure(shingle: int, percent: int):
    """Arrow batches of (doc_id, text_key, text) to the set's size, digest and first tokens of each row."""

    def run(batches):
        rid = TaskContext.get().partitionId() << 33
        for batch in slices(batches, "text"):
            ids = zip(batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist())
            out, tokens = [], []
            for (doc_id, key), found in zip(ids, shingle_sets(batch.column("text"), shingle)):
                n = len(found)
                counted, prefix = int(np.searchsorted(found, np.uint64(CUT))), prefix_length(n, percent) if n else 0
                out.append((rid, doc_id, key, n, *_digest(found), counted, prefix))
                tokens.append(found[: max(counted, prefix)].view(np.int64))
                rid += 1
            ends = np.cumsum([0, *map(len, tokens)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(tokens)))
            columns = [pa.array(c, pa.int64()) for c in zip(*out)]
            yield pa.RecordBatch.from_arrays([*columns, lists], names=[x.split()[0] for x in ROW.split(", ")])

    return run


def whole_sets(shingle: int):
    """Arrow batches of (text) to (d1, d2, found): the digest and the whole set."""

    def run(batches):
        for batch in slices(batches, "text"):
            sets = shingle_sets(batch.column("text"), shingle)
            d1, d2 = zip(*map(_digest, sets))
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
            columns = [pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["d1", "d2", "found"])

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many tokens each set of the one list has in common with each of the other."""
    ends = np.cumsum([0, *map(len, left), *map(len, right)])
    tokens, code = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    common = np.zeros((len(left), len(right)), np.float32)
    # Tokens of one side only are in no overlap.
    mine = np.bincount(code[row < len(left)], minlength=len(tokens)) > 0
    theirs = np.bincount(code[row >= len(left)], minlength=len(tokens)) > 0
    place = np.cumsum(mine & theirs) - 1
    kept = (mine & theirs)[code]
    row, code = row[kept], place[code[kept]]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, AT_ONCE):
        part = slice(*np.searchsorted(code, [at, at + AT_ONCE]))
        dense = np.zeros((len(ends) - 1, AT_ONCE), np.float32)
        dense[row[part], code[part] - at] = 1
        common += dense[: len(left)] @ dense[len(left) :].T
    return common


def compare_blocks(percent: int, every: bool):
    """Arrow batches of (super, a, b, block, cls, found), sorted, to links (a, b) of each pair of blocks:
    all of them, or a star per component."""

    def run(batches):
        for (_, a, b), block, cls, found in grouped(batches, ("super", "a", "b"), ("block", "cls", "found")):
            sets, cls = [np.array(f, np.int64) for f in found], np.array(cls, np.int64)
            sizes, block = np.array([len(x) for x in sets]), np.array(block)
            one, two = np.flatnonzero(block == a), np.flatnonzero(block == b)
            # Rows of the left block some at a time, so the overlaps stay small.
            label = np.arange(len(sets))
            for at in range(0, len(one), 256):
                rows = one[at : at + 256]
                common = overlaps([sets[i] for i in rows], [sets[i] for i in two])
                both = sizes[rows][:, None] + sizes[two][None, :]
                linked = 100 * common >= percent * (both - common)
                i, j = np.nonzero(linked)
                i, j = rows[i], two[j]
                i, j = (i[i < j], j[i < j]) if a == b else (i, j)
                if not every:
                    merge(label, i, j)
                elif len(i):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.minimum(cls[i], cls[j])), pa.array(np.maximum(cls[i], cls[j]))], names=["a", "b"]
                    )
            if not every:
                i = np.flatnonzero(label != np.arange(len(sets)))
                j = label[i]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(cls[i], cls[j])), pa.array(np.maximum(cls[i], cls[j]))], names=["a", "b"]
                )

    return run


class Join:
    """The steps over one table of documents."""

    def __init__(self, docs: DataFrame, shingle: int, percent: int, most_bytes: int | None):
        if not 50 < percent <= 100:
            raise ValueError(f"percent is above 50 and at most 100, not {percent}: at 50 one common token may be enough")
        self.docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.shingle, self.percent, self.most_bytes = shingle, percent, most_bytes
        keyed = self.docs.select("doc_id", text_key(F.col("text")).alias("text_key"), "text")
        self.rows = written(keyed.mapInArrow(measure(shingle, percent), ROW), "sets")
        self.facts = written(self.rows.select("rid", "doc_id", "text_key", "n", "d1", "d2"), "set-facts")
        by_set = self.facts.where(F.col("n") > 0).groupBy("d1", "d2")
        self.classes = written(
            by_set.agg(F.min("rid").alias("cls"), F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")), "classes"
        )

    def representatives(self) -> DataFrame:
        """One row per class. Only the classes of several rows need the join."""
        many = written(self.classes.where(F.col("copies") > 1).select("d1", "d2", "cls"), "copied")
        joined = self.rows.where(F.col("n") > 0).join(small(many, 24, self.most_bytes), ["d1", "d2"], "left")
        return joined.where(F.coalesce("cls", "rid") == F.col("rid")).drop("cls")

    def shared(self, tokens: DataFrame) -> DataFrame:
        """(cls, shared): each class's tokens that other classes have too, with how many have them."""
        counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > 1)
        # A row per token at most, so the counted side is even however long one list is.
        both = tokens.join(counts.hint("shuffle_hash"), "token")
        return both.groupBy("cls").agg(F.collect_list(F.struct("df", "token")).alias("shared"))

    def candidates(self) -> DataFrame:
        """(cls, doc_id) of the classes that may have a partner, judged by the counted tokens."""
        # A set of n tokens and a different one at least as large are at most n / (n + 1) similar.
        reps = self.representatives().where(F.col("n") * (100 - self.percent) >= self.percent)
        by_set = self.shared(reps.select(F.col("rid").alias("cls"), F.explode("tokens").alias("token")))
        known = by_set.join(reps.select(F.col("rid").alias("cls"), "doc_id", "counted", "prefix"), "cls")
        inner = F.size(F.filter("shared", lambda t: (t["token"] >= 0) & (t["token"] < CUT)))
        # Tokens that no other class has come first in the order; what is sent beyond the
        # counted share is all in the prefix.
        alone = F.col("counted") - inner
        chosen = F.least(inner, F.greatest(F.col("prefix") - alone, F.lit(0))) + F.size("shared") - inner
        return written(known.where(chosen > 1).select("cls", "doc_id"), "candidates")

    def survivors(self, sets: DataFrame) -> DataFrame:
        """(cls, n, prefix tokens, cost of listing and scanning them) of candidates that may have a partner.

        Only candidates can be partners, so their whole sets are counted among themselves:
        the prefix is the rarest tokens of the set, those of no other candidate first.
        """
        by_set = self.shared(sets.select("cls", F.explode("found").alias("token")))
        known = by_set.join(sets.select("cls", F.size("found").cast("bigint").alias("n")), "cls")
        # n - ceil(percent n / 100) + 2, less the tokens no other candidate has.
        prefix = F.col("n") - F.ceil(self.percent * F.col("n") / 100) + 2
        left = prefix - (F.col("n") - F.size("shared"))
        known = known.withColumn("left", left.cast("int")).where(F.col("left") > 1)
        chosen = F.slice(F.array_sort("shared"), F.lit(1), F.col("left"))
        known = known.withColumn("chosen", chosen).where(F.size("chosen") > 1)
        scan = F.size("chosen") + SCANNED * F.array_max(F.transform("chosen", lambda t: t["df"]))
        ordered = F.array_sort(F.transform("chosen", lambda t: t["token"]))
        return written(known.select("cls", "n", ordered.alias("tokens"), scan.alias("scan")), "survivors")

    def boundary(self, survivors: DataFrame) -> int:
        """The size up to which subsets are enumerated, at the least summed cost."""
        subsets = F.size("tokens").cast("double") * (F.size("tokens") - 1) / 2
        # Sizes in steps of a tenth: a few hundred sums, whatever the data.
        step = F.floor(F.log(1.1, F.col("n"))).alias("step")
        sums = survivors.groupBy(step).agg(F.max("n").alias("n"), F.sum(subsets).alias("subsets"), F.sum("scan").alias("scan"))
        rows = sorted(tuple(r)[1:] for r in sums.collect())
        best, total = (sum(r[2] for r in rows), 0), sum(r[2] for r in rows)
        for n, enumerated, scanned in rows:
            total += enumerated - scanned
            best = min(best, (total, n))
        return best[1]

    def lists(self, survivors: DataFrame) -> DataFrame:
        """(twos, key, cls, n): the inverted lists of two-token subsets and of single tokens."""
        light = self.boundary(survivors)
        pairs = F.flatten(F.transform("tokens", lambda a, i: F.transform(F.slice("tokens", i + 2, F.size("tokens")), lambda b: F.xxhash64(a, b))))
        subsets = survivors.where(F.col("n") <= light).select(F.lit(True).alias("twos"), F.explode(pairs).alias("key"), "cls", "n")
        # Sets under the boundary that a set above it can be near to are in its lists as well.
        near = 100 * F.col("n") > self.percent * light
        single = survivors.where(near).select(F.lit(False).alias("twos"), F.explode("tokens").alias("key"), "cls", "n")
        return written(subsets.unionByName(single), "lists")

    def fits(self, n: Column, m: Column) -> Column:
        """The sizes allow the similarity."""
        return 100 * F.least(n, m) >= self.percent * F.greatest(n, m)

    def sets_of(self, candidates: DataFrame) -> DataFrame:
        """(cls, found): the whole sets of the candidates, from the texts again."""
        ids = written(candidates.select("doc_id").distinct(), "candidate-ids")
        ids = small(ids, 16, self.most_bytes).toDF("__id")
        texts = self.docs.join(ids, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").select("text")
        found = texts.mapInArrow(whole_sets(self.shingle), "d1 bigint, d2 bigint, found array<bigint>")
        named = found.join(self.classes.select("d1", "d2", "cls"), ["d1", "d2"])
        return written(named.join(candidates.select("cls"), "cls", "left_semi").dropDuplicates(["cls"]).select("cls", "found"), "whole-sets")

    def verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (a, b) whose similarity reaches the threshold, written."""
        left, right = sets.toDF("a", "set_a"), sets.toDF("b", "set_b")
        both = pairs.join(left, "a").join(right, "b")
        common = F.size(F.array_intersect("set_a", "set_b"))
        linked = 100 * common >= self.percent * (F.size("set_a") + F.size("set_b") - common)
        return written(both.where(linked).select("a", "b"), "links")

    def open_lists(self, lists: DataFrame, labels: DataFrame | None, turn: int) -> DataFrame:
        """The rows of lists that hold several components, each with its list's length and this turn's pivot."""
        lists = lists.select("twos", "key", "cls", "n")
        if labels is not None:
            named = small(labels, 16, self.most_bytes)
            lists = lists.join(named, F.col("cls") == F.col("node"), "left").drop("node")
            lists = lists.withColumn("component", F.coalesce("component", "cls"))
        else:
            lists = lists.withColumn("component", F.col("cls"))
        by = F.struct(F.xxhash64(F.col("cls"), F.lit(turn)).alias("h"), F.col("cls").alias("p"), F.col("n").alias("m"), F.col("component").alias("other"))
        ends = (F.min("component"), F.max("component"))
        pivots = lists.groupBy("twos", "key").agg(F.count(F.lit(1)).alias("length"), ends[0].alias("lo"), ends[1].alias("hi"), F.min(by).alias("pivot"))
        pivots = pivots.where(F.col("lo") < F.col("hi")).select("twos", "key", "length", "pivot")
        return written(lists.join(pivots, ["twos", "key"]).select("twos", "key", "cls", "n", "component", "length", "pivot"), "open-lists")

    def all_pairs(self, lists: DataFrame) -> DataFrame:
        """Pairs across components that sizes and the number of common prefix tokens allow.

        All lists that such a pair shares are still open, so they count its common prefix
        tokens c. Of the set whose prefix ends first, only the tokens after it can be common
        as well: the overlap is at most c plus their number, which is ceil(0.8 n) - 2.
        """
        lists = lists.select("twos", "key", "cls", "n", "component")
        other = lists.toDF("twos", "key", "b", "m", "other")
        joined = lists.withColumnRenamed("cls", "a").join(other, ["twos", "key"])
        wanted = (F.col("a") < F.col("b")) & (F.col("component") != F.col("other")) & self.fits(F.col("n"), F.col("m"))
        counted = joined.where(wanted).groupBy("a", "b", "n", "m", "twos").agg(F.count(F.lit(1)).alias("lists"))
        # c tokens make c (c - 1) / 2 subsets of two.
        common = F.when(F.col("twos"), F.floor((1 + F.sqrt(1 + 8 * F.col("lists"))) / 2)).otherwise(F.col("lists"))
        needed = F.ceil(self.percent * (F.col("n") + F.col("m")) / (100 + self.percent))
        after = F.ceil(self.percent * F.greatest("n", "m") / 100) - 2
        # The sums are whole numbers; a rounded quotient may not cost a pair.
        return counted.where(common + after >= needed - 1).select("a", "b").distinct()

    def in_blocks(self, lists: DataFrame, sets: DataFrame, every: bool) -> tuple[DataFrame, DataFrame]:
        """Links of the classes that lists connect densely, and the rows of all other lists.

        Classes of one list are in one group. A group is compared in blocks where its pairs are no
        more than its lists' pairs, which meet the same two classes once per common list.
        """
        stars = lists.select(F.col("cls").alias("a"), F.col("pivot.p").alias("b")).distinct()
        named = written(components(stars).select(F.col("node").alias("cls"), F.col("component").alias("super")), "list-groups")
        sizes = named.join(sets.select("cls", F.size("found").cast("bigint").alias("tokens")), "cls")
        sizes = sizes.groupBy("super").agg(F.count(F.lit(1)).alias("sets"), F.sum("tokens").alias("tokens"))
        work = lists.select("cls", "length").groupBy("cls").agg(F.sum("length").alias("met"))
        work = work.join(named, "cls").groupBy("super").agg(F.sum("met").alias("met"))
        many = F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("tokens") / BLOCK_TOKENS))
        dense = sizes.join(work, "super").where(F.col("sets") * F.col("sets") <= F.col("met"))
        dense = written(dense.select("super", many.cast("int").alias("blocks")), "dense-groups")
        members = written(named.join(small(dense, 16, self.most_bytes), "super"), "dense-classes")
        block = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
        dealt = members.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        ends = [F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b")]
        dealt = dealt.select("super", *ends, "block", "cls").join(sets, "cls").select("super", "a", "b", "block", "cls", "found")
        sorted_ = dealt.repartition("super", "a", "b").sortWithinPartitions("super", "a", "b", "block", "cls")
        links = written(sorted_.mapInArrow(compare_blocks(self.percent, every), "a bigint, b bigint"), "block-links")
        return links, lists.join(small(members.select("cls"), 16, self.most_bytes), "cls", "left_anti")

    def pivot_pairs(self, lists: DataFrame) -> DataFrame:
        """Every class with one pivot: the first in this turn's order among those of its lists."""
        wanted = (F.col("component") != F.col("pivot.other")) & self.fits(F.col("n"), F.col("pivot.m"))
        first = lists.where(wanted).groupBy("cls").agg(F.min("pivot").alias("pivot"))
        return first.select(F.least("cls", "pivot.p").alias("a"), F.greatest("cls", "pivot.p").alias("b")).distinct()

    def links(self, every: bool) -> DataFrame:
        """Verified pairs of classes: all of them, or enough to connect every component."""
        candidates = self.candidates()
        remove(self.rows)
        sets = self.sets_of(candidates)
        survivors = self.survivors(sets)
        lists = self.lists(survivors)
        found, labels, before = None, None, None
        for turn in range(PIVOT_ROUNDS + 1):
            closed, lists = lists, self.open_lists(lists, labels, turn)
            remove(closed)
            # An upper bound of the pairs that full comparison would look at, and the rows now.
            pairs, rows = lists.agg(F.sum((F.col("length") - 1) / 2), F.count(F.lit(1))).first()
            done = every or turn == PIVOT_ROUNDS or not rows or pairs <= 2 * rows or (before is not None and 2 * pairs > before)
            if done:
                links, rest = self.in_blocks(lists, sets, every)
                new = self.verified(self.all_pairs(rest), sets).unionByName(links)
            else:
                new = self.verified(self.pivot_pairs(lists), sets)
            found, before = new if found is None else found.unionByName(new), pairs
            if done:
                remove(lists)
                remove(sets)
                return found
            labels = written(components(found), "labels")


def similar_pairs(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, most_bytes: int | None = None):
    """(links, members): every pair (a, b) of classes that are similar enough, and (doc_id, n_shingles, cls) per row."""
    join = Join(docs, shingle, percent, most_bytes)
    members = join.facts.join(join.classes.select("d1", "d2", "cls"), ["d1", "d2"], "left")
    return join.links(every=True), members.select("doc_id", F.col("n").alias("n_shingles"), "cls")


def _labelled(join: Join) -> DataFrame:
    """The rows of the join with the component (a class; null for empty sets) and its smallest doc_id."""
    named = components(join.links(every=False))
    labelled = join.classes.join(named, F.col("cls") == F.col("node"), "left")
    labelled = labelled.select("d1", "d2", "first_id", F.coalesce("component", "cls").alias("component"))
    least = labelled.groupBy("component").agg(F.min("first_id").alias("component_id"))
    ids = labelled.join(least, "component").select("d1", "d2", "component", "component_id")
    ids = small(written(ids, "component-ids"), 32, join.most_bytes)
    return join.facts.join(ids, ["d1", "d2"], "left")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, most_bytes: int | None = None) -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles, component_id.

    Null, empty and wordless texts have an empty set, are linked with nothing and are their
    own component. Repeated rows and copies are one component; a component's id is its
    smallest doc_id that is not null (null if all are). No rows give no rows; columns other
    than doc_id and text are not read.
    """
    rows = _labelled(Join(docs, shingle, percent, most_bytes))
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, most_bytes: int | None = None) -> DataFrame:
    """One row of `docs`, with all its columns, of each component: that of the smallest doc_id.

    Rows without words all stay. Of equal rows under one id one stays.
    """
    rows = _labelled(Join(docs, shingle, percent, most_bytes)).where(F.col("n") > 0)
    order = F.struct(F.col("doc_id").isNull().alias("nobody"), "doc_id", "rid")
    chosen = rows.groupBy("component").agg(F.min(order).alias("f")).select(F.col("f.rid").alias("chosen"))
    marked = rows.select("rid", "doc_id", "text_key").join(chosen, F.col("rid") == F.col("chosen"), "left")
    texts = marked.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("rows"), F.count("chosen").alias("stay"))
    own, key, many, stay = free(docs, "__id", "__key", "__rows", "__stay")
    texts = written(texts.toDF(own, key, many, stay), "component-rows")
    same = F.col("doc_id").eqNullSafe(F.col(own)) & (text_key(F.col("text")) == F.col(key))
    gone = small(written(texts.where((F.col(stay) == 0) | (F.col(many) > 1)), "component-gone"), 32, most_bytes)
    kept = docs.join(gone, same, "left_anti")
    again = texts.where((F.col(stay) > 0) & (F.col(many) > 1))
    if again.isEmpty():
        return kept
    first = docs.join(again, same, "left_semi").withColumn(key, text_key(F.col("text"))).dropDuplicates(["doc_id", key])
    return kept.unionByName(first.drop(key))
