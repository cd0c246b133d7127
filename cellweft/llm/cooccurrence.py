"""Items that appear together, kept as a table that changes of baskets update.

A store is a folder that outlives the session: who is in which basket, how many baskets of each section hold each item, how many
baskets a section has, and how many baskets hold each pair. Each of these tables is cut into hash buckets with files of their own, and a
manifest says which files are in force. A change turns a basket's old item set into a new one; it emits -1 for each pair of the old
set and +1 for each of the new one, and the same for members and marginals. Those deltas are summed into the buckets they fall in;
other buckets keep their files. Scores are recomputed for pairs whose counts or marginals changed.

Items that cannot be part of a wanted pair are not paired: one in fewer baskets than a pair needs, or one so common in every section it
occurs in that no pair with it can reach the wanted ratio. Both follow exactly from the marginals, which are merged first; when an
item starts or ceases to qualify, its baskets count as changed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweft.operators.pairs import BLOCK_ITEMS, basket_pairs
from cellweft.session import cut, folder_names, remove_path, shared_path

MEMBER = "section string, basket string, item string"
#: Keys of each table; its bucket comes from the hash of the first columns named.
TABLES = {"members": (["section", "basket", "item"], ["basket"]), "marginals": (["section", "item"], ["item"]), "totals": (["section"], ["section"]),
          "live": (["item"], ["item"]), "pairs": (["left", "right"], ["left", "right"])}


class PairStore:
    """Counts of pairs in the folder ``path``, opened if it holds some already.

    Pairs in fewer than ``min_count`` baskets or under ``min_ratio`` need not be kept; these two and ``buckets`` are fixed when the
    store is made, and opening it with others is an error.
    """

    def __init__(self, spark: SparkSession, path: str, min_count: int = 1, min_ratio: float = 0.0, buckets: int = 24, block_items: int = BLOCK_ITEMS) -> None:
        self.spark, self.path, self.min_count, self.min_ratio, self.buckets, self.block_items = spark, path.rstrip("/"), min_count, min_ratio, buckets, block_items
        done = [n for n in folder_names(spark, f"{self.path}/manifest") if "_SUCCESS" in folder_names(spark, f"{self.path}/manifest/{n}")]
        self.generation = int(done[-1]) if done else 0
        self.files: dict[tuple[str, int], str] = {}
        if done:
            for r in spark.read.parquet(f"{self.path}/manifest/{done[-1]}").collect():  # a row a bucket
                self.files[r["table"], r["bucket"]] = r["file"]
            said = self.files.pop(("settings", 0))
            if said != self._settings():
                raise ValueError(f"the store was made with {said}, not {self._settings()}")

    def _settings(self) -> str:
        return f"min_count={self.min_count} min_ratio={self.min_ratio!r} buckets={self.buckets}"

    def table(self, name: str, only: set[int] | None = None) -> DataFrame:
        """(keys, n) of a table, of the given buckets or all."""
        keys = TABLES[name][0]
        schema = ", ".join(f"{k} string" for k in keys) + ", n long"
        files = [f for (t, b), f in sorted(self.files.items()) if t == name and (only is None or b in only)]
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def _bucketed(self, name: str, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.hash(*TABLES[name][1]), F.lit(self.buckets)))

    def _merge(self, name: str, delta: DataFrame, files: dict[tuple[str, int], str]) -> None:
        """Sum ``delta`` (keys, n; written) into the buckets it falls in, whose new files replace the old ones in ``files``."""
        keys = TABLES[name][0]
        signed = self._bucketed(name, delta)
        base = signed
        if any(t == name for t, _ in files):
            hit = {r["bucket"] for r in signed.select("bucket").distinct().collect()}
            base = signed.unionByName(self._bucketed(name, self.table(name, hit)))
        else:
            hit = set(range(self.buckets))
        out = f"{self.path}/{name}/{self.generation + 1:06d}"
        summed = base.groupBy("bucket", *keys).agg(F.sum("n").alias("n")).where("n <> 0")
        # Buckets may be uneven: rows of one spread over several tasks by key, which write files of their own.
        summed.repartition(self.buckets, "bucket").write.partitionBy("bucket").parquet(out)
        for b in hit:
            files.pop((name, b), None)
        for n in folder_names(self.spark, out):
            if n.startswith("bucket="):
                files[name, int(n[7:])] = f"{out}/{n}"

    def _commit(self, files: dict[tuple[str, int], str]) -> None:
        """The new files are in force once their manifest is written; superseded ones go afterwards."""
        self.generation += 1
        rows = [(t, b, f) for (t, b), f in files.items()] + [("settings", 0, self._settings())]
        self.spark.createDataFrame(rows, "table string, bucket int, file string").coalesce(1).write.parquet(f"{self.path}/manifest/{self.generation:06d}")
        gone = set(self.files.values()) - set(files.values())
        self.files = files
        for f in gone:
            remove_path(self.spark, f)

    def _live(self, files: dict[tuple[str, int], str]) -> DataFrame:
        """Items that may be in a wanted pair.

        A basket with rows in one section only adds at most min(n_left, n_right) of that section to a pair, and expected is the sum of
        n_left * n_right / n over sections; so for an item whose baskets all lie in one section each, observed / expected is at most
        the largest n / n_item over its sections. Nothing of the kind holds for an item of a basket with rows in several
        sections (a partner may be in another section), so such items are paired whatever their ratio.
        """
        now = PairStore.__new__(PairStore)
        now.__dict__ = {**self.__dict__, "files": files}
        m = now.table("marginals").join(now.table("totals").withColumnRenamed("n", "n_all"), "section").groupBy("item").agg(
            F.sum("n").alias("n"), F.max(F.col("n_all") / F.col("n")).alias("ceiling"))
        enough = m.where(F.col("n") >= self.min_count)
        if self.min_ratio <= 0:
            return enough.select("item")
        members = now.table("members")
        wide = cut(members.groupBy("basket").agg(F.min("section").alias("a"), F.max("section").alias("b")).where("a <> b").select("basket"))
        # A hair of slack, so that rounding never drops an item that just reaches the ratio.
        low = F.col("ceiling") >= self.min_ratio * (1 - 1e-9)
        if wide.isEmpty():
            return enough.where(low).select("item")
        across = members.join(wide, "basket", "left_semi").select("item", F.lit(True).alias("across")).distinct()
        return enough.join(across, "item", "left").where(low | F.col("across")).select("item")

    def apply(self, old: DataFrame | None, new: DataFrame) -> DataFrame:
        """Turn the baskets in ``old`` (their whole former item sets) into ``new``; gives the items whose pairs are affected.

        Both have section, basket, item; rows are taken as sets, and rows with a null basket or item are ignored. A basket that only
        ``new`` has is added, one that only ``old`` has is removed. A null section is a section.
        """
        def tidy(df: DataFrame) -> DataFrame:
            return df.where("basket IS NOT NULL AND item IS NOT NULL").select(F.coalesce("section", F.lit("")).alias("section"), "basket", "item").distinct()

        keys = ["section", "basket", "item"]
        plus = tidy(new).withColumn("n", F.lit(1).cast("long"))
        signed = plus if old is None else plus.unionByName(tidy(old).withColumn("n", F.lit(-1).cast("long"))).groupBy(*keys).agg(F.sum("n").alias("n")).where("n <> 0")
        signed = cut(signed)
        files = dict(self.files)
        self._merge("members", signed, files)
        self._merge("marginals", signed.groupBy("section", "item").agg(F.sum("n").alias("n")), files)
        # A basket counts for a section while it has an item there.
        has = plus.select("section", "basket").distinct().withColumn("n", F.lit(1).cast("long"))
        if old is not None:
            has = has.unionByName(tidy(old).select("section", "basket").distinct().withColumn("n", F.lit(-1).cast("long")))
        self._merge("totals", has.groupBy("section").agg(F.sum("n").alias("n")), files)
        later = PairStore.__new__(PairStore)
        later.__dict__ = {**self.__dict__, "files": files}
        live_now = cut(self._live(files))
        if not self.files:
            # Nothing was there before: every basket is new and every item that qualifies began to.
            self._merge("live", live_now.withColumn("n", F.lit(1).cast("long")), files)
            rows = cut(signed.join(live_now, "item", "left_semi").select("basket", "item").distinct())
            self._merge("pairs", cut(basket_pairs(rows, self.block_items)), files)
            self._commit(files)
            return signed.select("item").distinct()
        was = self.table("live").select("item")
        began, ended = live_now.join(was, "item", "left_anti"), was.join(live_now, "item", "left_anti")
        switched = cut(began.withColumn("n", F.lit(1).cast("long")).unionByName(ended.withColumn("n", F.lit(-1).cast("long"))))
        # Changed baskets, and those with an item that began or ceased to qualify.
        hit = cut(signed.select("basket").unionByName(self.table("members").join(switched, "item", "left_semi").select("basket")).distinct())

        def pairs_of(store: PairStore, live: DataFrame) -> DataFrame:
            m = store.table("members").join(live, "item", "left_semi").join(hit, "basket", "left_semi").select("basket", "item").distinct()
            return basket_pairs(cut(m), self.block_items)

        delta = pairs_of(self, was).withColumn("n", -F.col("n")).unionByName(pairs_of(later, live_now))
        self._merge("pairs", cut(delta.groupBy("left", "right").agg(F.sum("n").alias("n")).where("n <> 0")), files)
        self._merge("live", switched, files)
        self._commit(files)
        return signed.select("item").unionByName(switched.select("item")).distinct()

    def scores(self, only: DataFrame | None = None) -> DataFrame:
        """(left, right, observed, expected, ratio) of pairs in at least ``min_count`` baskets whose ratio reaches ``min_ratio``.

        expected = sum over sections of n_left * n_right / n; a pair that shares no section has expected 0 and an infinite ratio.
        ``only`` (item) limits it to pairs with an affected item.
        """
        p = self.table("pairs").where(F.col("n") >= self.min_count).withColumnRenamed("n", "observed")
        if only is not None:
            sides = [p.join(only.withColumnRenamed("item", s), s, "left_semi").select("left", "right", "observed") for s in ("left", "right")]
            p = reduce(DataFrame.unionByName, sides).distinct()
        p = cut(p)
        m, total = self.table("marginals"), self.table("totals").withColumnRenamed("n", "na")
        left = p.join(m.select(F.col("item").alias("left"), "section", F.col("n").alias("nl")), "left")
        both = left.join(m.select(F.col("item").alias("right"), "section", F.col("n").alias("nr")), ["right", "section"])
        e = both.join(total, "section").groupBy("left", "right").agg(F.sum(F.col("nl") * F.col("nr") / F.col("na")).alias("e"))
        full = p.join(e, ["left", "right"], "left").select("left", "right", "observed", F.coalesce("e", F.lit(0.0)).alias("expected"))
        ratio = F.when(F.col("expected") > 0, F.col("observed") / F.col("expected")).otherwise(F.lit(float("inf")))
        return full.withColumn("ratio", ratio).where(F.col("ratio") >= self.min_ratio)


def feature_baskets(evidence: DataFrame) -> DataFrame:
    """(section, basket, item) of evidence rows that detect something: slice, cell key, ``assay::feature``."""
    from cellweft.functions.keys import cell_key, feature_key, filled, key

    return evidence.where("count > 0").select(
        key("slice_id").alias("section"), F.coalesce(filled("cell_key"), cell_key("sample_id", "slice_id", "cellbin_id")).alias("basket"),
        feature_key("assay", "feature_id").alias("item"))


def feature_pairs(evidence: DataFrame, min_count: int, min_ratio: float = 0.0) -> DataFrame:
    """Pairs of features found together: the scores of a store in the shared folder after its first change, all baskets."""
    store = PairStore(evidence.sparkSession, shared_path(evidence.sparkSession, "pairs"), min_count, min_ratio)
    store.apply(None, feature_baskets(evidence))
    return store.scores()


__all__ = ["PairStore", "feature_pairs"]
