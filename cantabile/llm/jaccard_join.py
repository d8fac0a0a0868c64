"""Exact similarity join of documents on word shingles, and the components its links make.

The join is a prefix filter with set relations used to skip work:

* Documents with the same shingle set are one set from the start.
* An ordering of all shingles puts those that only one set holds first, then rare before frequent. Two sets that reach the
  threshold share a shingle among the first few of each, so only those few are indexed. A set whose
  first few are its own alone is done without a single comparison. Exact counts are kept for a fixed
  share of all shingles (`ZONE`, chosen by hash), wide enough to hold a whole prefix; what
  a set lacks there it takes from beyond, in hash order.
* First the sets of an index list are compared only with the list's hub, the set with the fewest
  shingles of its own: the copies of a text fall into one component in a number of comparisons that
  is linear in their number.
* Then only links between different components matter. The sets whose lists still mix components, and
  no others, are indexed again by all their shingles, now with exact counts among them: a shingle that one component alone
  has can't be part of such a link, and comes before all others. Index lists are cut into blocks by set
  size and position. A pair of blocks is skipped whole if it lies in one component, or if the
  shingles left behind its positions can't reach the overlap its sizes ask for.
* For the pairs that remain, the answer of a set highly similar to each (its hub) is computed
  once, and theirs derived from it: the overlap of x and y lies within |hub(x) n hub(y)| plus or minus
  what x and y add to or lack of their hubs, which is known. Only pairs that these bounds
  leave open are compared themselves.

Nothing is sampled or capped, and a common shingle or a group of copies makes no quadratic work
inside a component. Counts are partial aggregates and joins are splittable, so a hot shingle or
group does not meet in one task.

Defined results: a null text, or one without words, has an empty set and is linked with nothing; rows
with equal ids are rows of their own with the same smallest id; null ids are ignored when the
smallest is sought, and a component without another id gets null; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cantabile.llm.common import Shelf, bounded_batches, checked_join, checkpoint, release, row_key, table
from cantabile.llm.components import components
from cantabile.llm.shingles import K, mix, overlap, shingle_sets

PERCENT = 80
#: Share of all shingles with exact counts, as a multiple of the prefix's share of a set.
ZONE = 1.25
#: Width of the classes of size and position that blocks of an index list are made of, as a share.
STEP = 0.02
#: Rounds of comparing with hubs, at most, before pairs between components are listed.
TURNS = 3


def prefix_length(n: int, percent: int) -> int:
    return n - (n * percent + 99) // 100 + 1


def _needed(n_a: str, n_b: str, percent: int) -> str:
    """SQL for the least overlap of two sets that reaches the threshold."""
    return f"(({percent} * ({n_a} + {n_b}) + {99 + percent}) div {100 + percent})"


def sketch(text: Column, k: int, percent: int) -> Column:
    """n: size of the set; sid: its identity; tokens: the shingles it may be indexed by; n_zone: how many of these have exact counts.

    Shingles are shifted so that the order of signed numbers is that of the hashes.
    """
    limit = np.uint64(min(1.0, ZONE * (100 - percent) / 100) * 2**64 - 1024)
    flip = np.uint64(1 << 63)

    @F.arrow_udf("struct<n:long,sid:long,n_zone:long,tokens:array<long>>")
    def _sketch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sets = shingle_sets(batch.to_pylist(), k)
            n = np.asarray([len(s) for s in sets], np.int64)
            sid = np.asarray([(mix(s).sum(dtype=np.uint64) ^ np.uint64(len(s))) for s in sets], np.uint64)
            zone = np.asarray([np.searchsorted(s, limit) for s in sets], np.int64)
            first = [s[: max(z, prefix_length(len(s), percent))] if len(s) else s for s, z in zip(sets, zone, strict=True)]
            offsets = np.cumsum([0, *map(len, first)]).astype(np.int32)
            flat = (np.concatenate(first) if first else np.zeros(0, np.uint64)) ^ flip
            tokens = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))
            yield pa.StructArray.from_arrays([pa.array(n), pa.array(sid.view(np.int64), mask=n == 0), pa.array(zone), tokens], ["n", "sid", "n_zone", "tokens"])

    return _sketch(text)


def all_shingles(text: Column, k: int) -> Column:
    """The whole set as array<long>."""

    @F.arrow_udf("array<long>")
    def _all(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([s.view(np.int64) for s in shingle_sets(batch.to_pylist(), k)], pa.list_(pa.int64()))

    return _all(text)


def _overlap(k: int):
    @F.arrow_udf("long")
    def both(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for a, b in batches:
            a, b = a.to_pylist(), b.to_pylist()
            texts = list(dict.fromkeys([*a, *b]))
            sets = dict(zip(texts, shingle_sets(texts, k), strict=True))
            yield pa.array([overlap(sets[x], sets[y]) for x, y in zip(a, b, strict=True)], pa.int64())

    return both


class SetJoin:
    """The steps of one join; `links` gives the links found and `members` the sets of the rows."""

    def __init__(self, docs: DataFrame, k: int = K, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> None:
        bounded_batches(docs.sparkSession)
        self.k, self.percent, self.shelf = k, percent, Shelf(docs.sparkSession)
        text = F.col(text_col)
        self.source = docs.select(F.col(id_col).alias("doc_id"), *row_key(text, F.col(id_col)), text.alias("_text"))
        sketched = self.source.withColumn("_s", sketch(F.col("_text"), k, percent))
        self.rows = self.shelf.put(sketched.select("doc_id", "_row1", "_row2", "_s.*"))
        one = F.min(F.struct("doc_id", "_row1", "_row2")).alias("_one")  # any row of the set will do for its text
        self.sets = self.shelf.put(
            self.rows.where("n > 0")
            .groupBy("sid", "n", "n_zone", F.size("tokens").alias("n_tokens"))
            .agg(one, F.min("doc_id").alias("least_id"))
            .select("sid", "n", "n_zone", "n_tokens", "least_id", "_one._row1", "_one._row2")
        )

    def index(self) -> DataFrame:
        """Entries (token, sid, n, own, pos) of the index: of each set the part of its prefix that other sets have too.

        own: how many of the set's indexed shingles no other set has; they come before all entries.
        """
        entries = self.rows.where("n > 0").select("sid", F.explode("tokens").alias("token"))
        counts = entries.groupBy("token").agg(F.min("sid").alias("_lo"), F.max("sid").alias("_hi"), F.count("*").alias("_count")).where("_lo < _hi").select("token", "_count")
        limit = int(min(1.0, ZONE * (100 - self.percent) / 100) * 2**64 - 1024) - 2**63
        ranked = F.struct((F.col("token") >= limit).cast("int").alias("beyond"), F.col("_count").alias("count"), F.col("token").alias("token"))
        shared = entries.join(counts, "token").groupBy("sid").agg(F.collect_set(ranked).alias("_shared"))
        prefix = f"n - (n * {self.percent} + 99) div 100 + 1"
        out = (
            shared.join(self.sets, "sid")
            .withColumn("own", F.col("n_tokens") - F.size("_shared"))
            .withColumn("_left", F.expr(f"cast({prefix} - own as int)"))
            .where("_left > 0")
            .withColumn("_before", F.col("n_zone") - F.size(F.filter("_shared", lambda x: x["beyond"] == 0)))
            .select("sid", "n", "own", "_before", F.posexplode(F.slice(F.sort_array("_shared"), F.lit(1), F.col("_left"))).alias("_i", "_e"))
        )
        return self.shelf.put(out.select("_e.token", "sid", "n", "own", (F.greatest("_before", F.lit(0)) + F.col("_i")).alias("pos")))

    def texts(self, wanted: DataFrame) -> DataFrame:
        """Adds _text, a text of the set, to rows with distinct sid."""
        known = self.shelf.put(wanted.join(self.sets.select("sid", "n", "_row1", "_row2"), "sid"))
        # rows that agree in id and text are one row here
        return checked_join(self.source.select("_row1", "_row2", "_text"), known, ["_row1", "_row2"], "inner").drop("_row1", "_row2").dropDuplicates(["sid"])

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Adds n_a, n_b and inter to distinct pairs (a, b) of sets, from their whole texts."""
        mark = self.shelf.mark()
        pairs = self.shelf.put(pairs)
        texts = self.texts(pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct())
        side = lambda s: texts.select(F.col("sid").alias(s), F.col("n").alias(f"n_{s}"), F.col("_text").alias(f"_text_{s}"))
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        out = self.shelf.put(both.select("a", "b", "n_a", "n_b", _overlap(self.k)("_text_a", "_text_b").alias("inter")))
        self.shelf.drop_since(mark, out)
        del pairs, texts, both
        release(out.sparkSession)
        return out

    def reaches(self, inter: str = "inter", n_a: str = "n_a", n_b: str = "n_b") -> str:
        return f"100 * {inter} >= {self.percent} * ({n_a} + {n_b} - {inter})"

    def _may_link(self, a: str, b: str) -> str:
        """SQL: sizes allow a link, and so do the shingles from these positions on, if this is the first that both have."""
        return f"least({a}.n - {a}.pos, {b}.n - {b}.pos) >= {_needed(f'{a}.n', f'{b}.n', self.percent)}"

    def stars(self, entries: DataFrame, turn: int, apart: str) -> DataFrame:
        """Pairs (a, b) of a set and the hub of an index list that both are in; apart: SQL, which pairs of x and h to look at.

        The hub is the set with the fewest shingles of its own, in later turns any.
        """
        rank = F.col("own") if turn == 0 else F.xxhash64(F.lit(turn), "sid")
        hubs = entries.groupBy("token").agg(F.min(F.struct(rank.alias("_rank"), *(c for c in entries.columns if c != "token"))).alias("h"), F.count("*").alias("_c")).where("_c > 1").select("token", "h.*")
        met = entries.alias("x").join(hubs.alias("h"), "token").where(apart).where(self._may_link("x", "h"))
        return met.select(F.col("x.sid").alias("a"), F.col("h.sid").alias("b")).distinct()

    def links(self) -> tuple[DataFrame, DataFrame]:
        """Links (a, b) that connect what the join connects, and (node, root): the components they make."""
        index = self.index()
        tested = self.verified(self.stars(index, 0, "x.sid <> h.sid"))
        good = tested.where(self.reaches())
        mark = self.shelf.mark()
        found = self.shelf.put(components(good.select("a", "b"), self.shelf))
        entries = self.shelf.put(self.crossing(index, found))
        self.shelf.drop(index)
        self.shelf.drop_since(mark, found, entries)
        for turn in range(TURNS):
            if entries.isEmpty():
                return good.select("a", "b"), found
            more = self.verified(self.stars(entries, turn, "x.root <> h.root").join(tested.select("a", "b"), ["a", "b"], "left_anti"))
            fresh = more.where(self.reaches())
            tested = tested.union(more)
            if fresh.isEmpty():
                break
            good = good.union(fresh)
            mark, before = self.shelf.mark(), (found, entries)
            found = self.shelf.put(components(good.select("a", "b"), self.shelf))
            entries = self.shelf.put(self.rooted(entries.drop("root"), found))
            self.shelf.drop(*before)
            self.shelf.drop_since(mark - len(before), found, entries)
        cross = self.across(entries, tested)
        if cross.isEmpty():
            return good.select("a", "b"), found
        links = good.select("a", "b").union(self.derived(cross, good))
        return links, self.shelf.put(components(links, self.shelf))

    def rooted(self, entries: DataFrame, found: DataFrame) -> DataFrame:
        """Entries with the root of their component, of the lists that mix components."""
        where = entries.join(found.select(F.col("node").alias("sid"), "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        mixed = where.groupBy("token").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).where("_lo < _hi").select("token")
        return where.join(mixed, "token")

    def crossing(self, index: DataFrame, found: DataFrame) -> DataFrame:
        """Entries (token, sid, root, n, own, pos) for links between components: of each set the part of its prefix that other components have too.

        A set's shingles that no other component has come first, so pos counts them.
        """
        asked = self.rooted(index.select("token", "sid"), found).groupBy("sid").agg(F.first("root").alias("root"))
        sets = self.shelf.put(self.texts(asked).select("sid", "root", "n", all_shingles(F.col("_text"), self.k).alias("_all")))
        entries = sets.select("sid", "root", F.explode("_all").alias("token"))
        counts = entries.groupBy("token").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi"), F.count("*").alias("_count")).where("_lo < _hi").select("token", "_count")
        shared = entries.join(counts, "token").groupBy("sid").agg(F.first("root").alias("root"), F.collect_list(F.struct("_count", "token")).alias("_shared"))
        prefix = f"n - (n * {self.percent} + 99) div 100 + 1"
        ranked = shared.join(self.sets.select("sid", "n"), "sid").withColumn("own", F.col("n") - F.size("_shared")).withColumn("_left", F.expr(f"cast({prefix} - own as int)")).where("_left > 0")
        out = ranked.select("sid", "root", "n", "own", F.posexplode(F.slice(F.sort_array("_shared"), F.lit(1), F.col("_left"))).alias("_i", "_e"))
        return out.select("_e.token", "sid", "root", "n", "own", (F.col("own") + F.col("_i")).alias("pos"))

    def across(self, entries: DataFrame, tested: DataFrame) -> DataFrame:
        """Candidates (a, n_a, b, n_b) between different components that have not been compared yet, by way of blocks."""
        # sets that may link are so many size classes apart at most
        reach = math.ceil(math.log(100 / self.percent) / STEP)
        entries = entries.withColumn("size", F.floor(F.log("n") / STEP)).withColumn("part", F.floor((F.col("n") - F.col("pos")) / F.col("n") / STEP))
        entries = self.shelf.put(entries)
        blocks = entries.groupBy("token", "size", "part").agg(F.min("n").alias("n"), F.max(F.col("n") - F.col("pos")).alias("rest"), F.min("root").alias("lo"), F.max("root").alias("hi"))
        other = blocks.select("token", F.col("size").alias("size_b"), F.col("part").alias("part_b"), F.col("n").alias("n_b"), F.col("rest").alias("rest_b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"))
        near = blocks.withColumn("size_b", F.explode(F.sequence(F.col("size"), F.col("size") + reach)))
        pairs = (
            near.join(other, ["token", "size_b"])
            .where("size < size_b or part <= part_b")
            .where("not (lo = hi and lo_b = hi_b and lo = lo_b)")
            .where(f"least(rest, rest_b) >= {_needed('n', 'n_b', self.percent)}")
            .select("token", "size", "part", "size_b", "part_b")
        )
        y = entries.select("token", *(F.col(c).alias(f"{c}_b") for c in ("size", "part", "sid", "root", "n", "pos")))
        met = pairs.join(entries, ["token", "size", "part"]).join(y, ["token", "size_b", "part_b"])
        met = met.where("root <> root_b").where(f"least(n - pos, n_b - pos_b) >= {_needed('n', 'n_b', self.percent)}")
        swap = F.col("sid") < F.col("sid_b")
        cols = [F.when(swap, F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in (("sid", "sid_b", "a"), ("n", "n_b", "n_a"), ("sid_b", "sid", "b"), ("n_b", "n", "n_b"))]
        done = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        return self.shelf.put(met.select(*cols).distinct().join(done, ["a", "b"], "left_anti"))

    def derived(self, cross: DataFrame, good: DataFrame) -> DataFrame:
        """The links among candidates: from what their hubs share if that settles it, from their own texts if not."""
        both = good.select("a", "b", "n_a", "n_b", "inter").union(good.select("b", "a", "n_b", "n_a", "inter"))
        closeness = F.col("inter") / (F.col("n_a") + F.col("n_b") - F.col("inter"))
        hub = both.groupBy("a").agg(F.max_by(F.struct("b", "n_b", "inter"), F.struct(closeness, F.col("b"))).alias("_h"))
        hub = hub.select(F.col("a").alias("sid"), F.col("_h.b").alias("hub"), F.col("_h.n_b").alias("hub_n"), F.col("_h.inter").alias("hub_inter"))
        side = lambda s: hub.select(*(F.col(c).alias(d) for c, d in (("sid", s), ("hub", f"hub_{s}"), ("hub_n", f"hub_n_{s}"), ("hub_inter", f"hub_inter_{s}"))))
        x = cross.join(side("a"), "a", "left").join(side("b"), "b", "left")
        for s in "ab":
            x = x.withColumns({f"hub_inter_{s}": F.coalesce(f"hub_inter_{s}", f"n_{s}"), f"hub_n_{s}": F.coalesce(f"hub_n_{s}", f"n_{s}"), f"hub_{s}": F.coalesce(f"hub_{s}", s)})
        x = self.shelf.put(x)
        asked = x.select(F.least("hub_a", "hub_b").alias("a"), F.greatest("hub_a", "hub_b").alias("b")).distinct()
        answers = self.verified(asked).select(F.col("a").alias("_lo"), F.col("b").alias("_hi"), F.col("inter").alias("_base"))
        bound = x.withColumns({"_lo": F.least("hub_a", "hub_b"), "_hi": F.greatest("hub_a", "hub_b")}).join(answers, ["_lo", "_hi"])
        bound = bound.withColumn("most", F.expr("least(n_a, n_b, _base + (n_a - hub_inter_a) + (n_b - hub_inter_b))"))
        bound = bound.withColumn("least", F.expr("_base - (hub_n_a - hub_inter_a) - (hub_n_b - hub_inter_b)"))
        bound = self.shelf.put(bound.select("a", "b", "n_a", "n_b", "most", "least"))
        sure = bound.where(self.reaches("least"))
        open_ = bound.where(f"{self.reaches('most')} and not {self.reaches('least')}")
        return sure.select("a", "b").union(self.verified(open_.select("a", "b")).where(self.reaches()).select("a", "b"))

    def roots(self) -> DataFrame:
        """(sid, least_id, root) for every set."""
        _, found = self.links()
        return self.sets.select("sid", "least_id").join(found, F.col("sid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "sid"))

    def surplus(self) -> DataFrame:
        """Keys (_row1, _row2) of rows of which another row of their component is kept: that with the least id, null ids last, and of these the least key."""
        first = F.min(F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "_row1", "_row2")).alias("_first")
        held = self.rows.where("n > 0")
        least = held.groupBy("sid").agg(first).join(self.roots().select("sid", "root"), "sid")
        kept = least.groupBy("root").agg(F.min("_first").alias("_first")).select("_first._row1", "_first._row2")
        return held.select("_row1", "_row2").distinct().join(kept, ["_row1", "_row2"], "left_anti")

    def repeated(self) -> DataFrame:
        """Keys (_row1, _row2) that several rows have, and whether their text has no words (_empty)."""
        many = self.rows.groupBy("_row1", "_row2").agg(F.count("*").alias("_rows"), F.max("n").alias("_n")).where("_rows > 1")
        return many.select("_row1", "_row2", (F.col("_n") == 0).alias("_empty"))

    def members(self) -> DataFrame:
        """One row for each row of docs: doc_id, n_shingles, component_id."""
        rooted = self.roots()
        least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
        named = rooted.join(least, "root").select("sid", "component_id")
        out = self.rows.select("doc_id", "n", "sid").join(named, "sid", "left")
        made = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
        made = checkpoint(made)
        self.shelf.drop_since(0)
        return made


def similar_components(docs: DataFrame, k: int = K, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return SetJoin(docs, k, percent, id_col, text_col).members()


def one_of_each(docs: DataFrame, k: int = K, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component; of rows without words, one of those equal in every column."""
    join = SetJoin(docs, k, percent, id_col, text_col)
    gone, repeated = checkpoint(join.surplus()), checkpoint(join.repeated())
    join.shelf.drop_since(0)
    keys = ["_row1", "_row2"]
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_in"), *row_key(F.col(text_col), F.col(id_col)))
    left = checked_join(checked_join(whole, gone, keys, "left_anti"), repeated, keys, "left")
    # rows with a key of their own aren't shuffled
    all_of_it = F.xxhash64(*(F.col("_in")[c] for c in docs.columns))
    many = left.where("_empty is not null").withColumn("_all", all_of_it).withColumn("_apart", F.when(F.col("_empty"), F.col("_all")))
    one = many.groupBy(*keys, "_apart").agg(F.min_by("_in", "_all").alias("_in"))
    return left.where("_empty is null").select("_in.*").union(one.select("_in.*"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"))
